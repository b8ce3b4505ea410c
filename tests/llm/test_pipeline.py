"""The corpus pipeline, stage by stage, against plain loops over a small corpus."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as c
from rowaccord.llm import quality, queries, secret_scan
from rowaccord.llm.common import remainder, settled

from test_decontaminate import words
from test_jaccard import brute as near_groups
from test_tokens_packing import BPE

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _runs string"


def corpus(rng):
    word = lambda: rng.choice(["alpha", "river", "stone", "under", "cloud", "Ünder"]) + str(rng.randrange(40))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, " ".join(f"bench{i}x{k}" for k in range(14))) for i in range(3)]
    texts = [text(rng.randrange(8, 90)) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), texts[1] + " tail", *(f"{text(30)}, {t}; {text(9)}" for _, t in items), items[0][1]]
    texts += [f'{text(20)} token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1{k}" {text(5)}' for k in range(4)]
    texts += ["### $$$ %%% " * rng.randrange(4, 30) for _ in range(30)] + ["", None, text(3000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], (None, text(12))]
    labels = [(i, 0 if t and t.startswith("###") else 1, 0) for i, t in rows if i is not None]
    return rows, items, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, items, labels = corpus(random.Random(6))
    full = [(i, t, "en", "s", None if t is None else len(t), "k", "r") for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{path}/labels.parquet")
    return path


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def cut_out(text, items, share):
    """Text without benchmark passages, or nothing where they are most of it."""
    spots, at, w = [], 0, words(text)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for x in w:
        at = low.index(x, at)
        spots.append(at)
        at += len(x)
    hit = set()
    for _, t in items:
        b = words(t)
        for s in range(len(b) - 9):
            for p in range(len(w) - 9):
                if w[p : p + 10] == b[s : s + 10]:
                    hit.update(range(p, p + 10))
    if not hit:
        return text, True
    ends = [*spots[1:], len(text)]
    kept = text[: spots[0]] + "".join(text[a:b] for k, (a, b) in enumerate(zip(spots, ends)) if k not in hit)
    return kept, len(hit) < share * len(w)


def test_stages_against_loops(spark, folder):
    rows, items, _ = corpus(random.Random(6))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    model = quality.fit_quality(docs, labels, remainder(labels["doc_id"], 5) != 0)
    want = [(i, t) for i, t in rows if model.score(t) >= queries.LEAST_QUALITY]
    kept = settled(c.good_documents(spark, docs, folder), "test")
    assert pairs(kept) == sorted(want, key=str) and kept.columns == docs.columns
    assert not any((t or "").startswith("###") for _, t in want) and len(want) > 60

    # One row of each group: ids of repeated rows are equal, a null id is nobody's copy here.
    least = {i: root for i, _, root in near_groups([(i, t) for i, t in want if i is not None])}
    want = sorted({(i, t) for i, t in want if i is None or least[i] == i}, key=str)
    kept = settled(c.distinct_documents(spark, kept, folder), "test")
    assert pairs(kept) == want and kept.columns == docs.columns
    assert {r["_key"] for r in kept.collect()} == {"k"}

    cleaned = [(i, *cut_out(t, items, c.LEAK_SHARE)) for i, t in want]
    want = [(i, t) for i, t, stays in cleaned if stays]
    kept = settled(c.clean_of_benchmarks(spark, kept, folder), "test")
    assert pairs(kept) == sorted(want, key=str) and {r["_runs"] for r in kept.collect()} == {"r"}
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept.collect())

    model = secret_scan.fit_from_documents(kept, remainder(kept["doc_id"], 5) != 0)
    want = [(i, model.redact(t)) for i, t in want]
    kept = settled(c.without_secrets(spark, kept, folder), "test")
    assert pairs(kept) == sorted(want, key=str) and not any("9f86d081" in (t or "") for _, t in want)

    placed = c.sequences(spark, kept, folder).collect()
    public, ids = Tokenizer.from_file(BPE), {}
    for i, t in want:
        ids[i] = [*public.encode(t or "", add_special_tokens=False).ids, 0]
    sequences = {}
    for r in placed:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in placed) == sum(map(len, ids.values()))
    for found in sequences.values():
        assert [a for a, _ in sorted(found)] == [sum(n for _, n in sorted(found)[:k]) for k in range(len(found))]
        assert sum(n for _, n in found) <= 2048


def test_whole_run_and_empty_table(spark, folder, tmp_path):
    assert c.run(spark, folder).count() > 50
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert c.run(spark, str(tmp_path)).collect() == []

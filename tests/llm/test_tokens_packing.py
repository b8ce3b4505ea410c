"""Token counts and packing against the public tokenizers and brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter as Tally

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from rowaccord.llm import packing as p
from rowaccord.llm.token_counts import Counter, Unigram, token_counts

PIECES = Unigram(public_tokenizers.path("piece_bpe_32k.model"))
BPE = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts(seed, n=800):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a  b", " lead", "trail ", "▁x", "日本語 😀😀 x", "\n\n", "á\t b", "x" * 3000, "<|endoftext|> x", "it's we'll  'll", "a\x1f b"]
    return fixed + ["".join(rng.choice("ab ▁é😀\nthe1!'s \x1c") for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("ties", [True, False])
def test_counts_of_the_public_tokenizer(fallback, ties):
    own, _ = PIECES.pieces()
    if ties:
        own = [(piece, -float(i % 7) - 1) for i, (piece, _) in enumerate(own)]
    low = min(s for _, s in own)
    extra = [(f"<0x{i:02X}>", low) for i in range(256)] if fallback else []
    public = Tokenizer(models.Unigram([("<unk>", low), *extra, *own], 0, fallback))
    public.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="first")
    texts = odd_texts(1)
    counter = Counter(own, fallback, remember=50)
    assert [counter.of_text(t) for t in texts] == [len(e.ids) for e in public.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, "", "z"), (1, "", "z")], "doc_id bigint, text string, n_tokens string")
    got = sorted((tuple(r) for r in token_counts(df, PIECES).collect()), key=str)
    assert got == [(1, 0, 0), (1, 0, 0), (1, 0, 0), (None, 3, 2)]
    assert token_counts(df.limit(0), PIECES).collect() == []


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_ids_of_the_public_tokenizer(block):
    public = Tokenizer.from_file(BPE)
    encode = p.Encoder(BPE, block)
    texts = [*odd_texts(2), "a <|endoftext|> b", "a b c d e f<|endoftext|><|endoftext|>g h i j", "é<|endoftext|>", "<|endoftext| > x"]
    assert [encode(t) for t in texts] == [np.array([*e.ids, 0], dtype="<u4").tobytes() for e in public.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 2048])
    counts = Tally(rng.randint(max(1, capacity // 5), capacity // 2 + 5) for _ in range(rng.randint(0, 40)))
    plan = p.bin_completion(counts, capacity)
    used = Tally()
    for filling, copies in plan:
        assert sum(x * n for x, n in filling) <= capacity
        for x, n in filling:
            used[x] += n * copies
    assert used == counts
    size = sum(n for _, n in plan)
    assert -(-sum(k * v for k, v in counts.items()) // capacity) <= size <= sum(n for _, n in p.best_fit(counts, capacity))


def test_completion_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 4, 2: 4, 1: 0}
    exact = lambda left: 0 if not any(left.values()) else min(1 + exact(r) for r in rests(left))

    def rests(left):
        top = max(k for k, v in left.items() if v)

        def fill(room, keys, rest):
            yield rest
            for i, k in enumerate(keys):
                if k <= room and rest[k]:
                    yield from fill(room - k, keys[i:], {**rest, k: rest[k] - 1})

        yield from fill(10 - top, sorted(left, reverse=True), {**left, top: left[top] - 1})

    small = {6: 1, 5: 2, 4: 2, 3: 2}
    assert sum(n for _, n in p.bin_completion(small, 10)) == exact(small)
    assert sum(n for _, n in p.bin_completion(counts, 10)) == -(-sum(k * v for k, v in counts.items()) // 10)


def test_search_goes_below_the_root_with_many_lengths():
    rng, counts = random.Random(1), Tally()
    while counts.total() < 6000:
        a, b = rng.randint(300, 1448), rng.randint(300, 1448)
        if 300 <= 2048 - a - b <= 1448:
            counts.update([a, b, 2048 - a - b])
    assert len(counts) > 1000
    size = sum(n for _, n in p.bin_completion(counts, 2048))
    assert 2000 <= size <= 2025 < sum(n for _, n in p.best_fit(counts, 2048))


@pytest.mark.parametrize("seed", range(20))
def test_fullest_filling(seed):
    rng = random.Random(seed)
    counts = Tally(rng.randint(3, 40) for _ in range(rng.randint(1, 9)))
    largest = max(counts)
    sums = {largest}
    for x in (counts - Tally([largest])).elements():
        sums |= {y + x for y in sums if y + x <= 50}
    filling = p.Fullest(counts, 50)(largest)
    assert sum(x * n for x, n in filling) == max(sums) and all(n <= counts[x] for x, n in filling) and dict(filling)[largest]


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "Ünder", "x9"]) for _ in range(rng.choice([0, 3, 30, 30, 30, 200])))) for i in range(300)]
    rows += [(500, None), (500, None), (None, "a b"), (None, "a b"), (501, "w " * 900)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, length string")
    pieces = p.document_pieces(docs, BPE, 64).cache()
    placed = p.pack(pieces.drop("ids"), 64).collect()
    assert len(placed) == pieces.count()
    places = {}
    for r in placed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= 64
    long = sorted((r["piece"], r["start"], r["length"]) for r in placed if r["doc_id"] == 501)
    assert [x[2] for x in long[1:]] == [64] * (len(long) - 1) and [x[1] for x in long] == [0, *(long[0][2] + 64 * i for i in range(len(long) - 1))]
    sequences = p.packed_sequences(docs, BPE, 64).collect()
    assert sum(r["length"] for r in sequences) == sum(r["length"] for r in placed) and all(len(r["ids"]) == 4 * r["length"] for r in sequences)
    whole = Tally(zlib.crc32(r["ids"]) for r in pieces.collect())
    assert whole == Tally(zlib.crc32(r["ids"][4 * m["offset"] : 4 * (m["offset"] + m["length"])]) for r in sequences for m in r["members"])
    assert p.pack(p.document_pieces(docs.limit(0), BPE).drop("ids")).collect() == []


def test_pack_keeps_other_columns(spark):
    own = {"_bucket": "b", "_place": "p", "l": "l", "n": "n", "first": "f", "a.b": "d", "offset": "old"}
    schema = "doc_id bigint, piece int, length bigint, " + ", ".join(f"`{c}` string" for c in own)
    pieces = spark.createDataFrame([(i, 0, 3 + i % 4, *own.values()) for i in range(40)], schema)
    rows = [r.asDict() for r in p.pack(pieces, 10).collect()]
    assert len(rows) == 40 and all({k: v for k, v in r.items() if k in own} == {**own, "offset": r["offset"]} for r in rows)
    assert sum(r["length"] for r in rows) == 40 * 4.5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 40
    with pytest.raises(ValueError):
        p.pack(spark.createDataFrame([(1, 0, None)], "doc_id bigint, piece int, length bigint"), 10)

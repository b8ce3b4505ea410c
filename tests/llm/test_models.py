"""Quality, language and secrets: accuracy on rows that were not learnt from, and odd rows."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowaccord.llm import language as lang
from rowaccord.llm import quality as q
from rowaccord.llm import queries
from rowaccord.llm import secret_scan as sec

FOLDER = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


def good(rng):
    return " ".join(rng.choice(["alpha", "river", "stone", "under"]) for _ in range(int(rng.integers(3, 200))))


def test_filters_see_the_whole_text():
    rng = np.random.default_rng(1)
    rows = [(good(rng), 1) for _ in range(150)]
    rows += [(good(rng) + " ### $$$ %%% " + good(rng), 0) for _ in range(150)]
    model = q.ByteCnn(filters=8).fit([t for t, _ in rows], [y for _, y in rows], epochs=6)
    clean, late = good(rng) * 400, good(rng) * 400 + " ### $$$ %%% "
    assert model.score(clean) > 0.5 > model.score(late)
    assert 0 <= model.score("") <= 1 and model.score(None) == model.score("")
    top, at = model.pooled(q.padded(late))
    assert np.allclose(top, model.maxima(q.padded(late))) and at.max() >= len(late) // q.STRIDE - 4


def test_gradients_by_differences():
    model = q.ByteCnn(dim=3, filters=4)
    model.start()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rows, y = [q.padded("some words here"), q.padded("other %% text of words")], np.array([1.0, 0.0])
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip((model.probability(model.maxima(r)[None, :])[0] for r in rows), y)])
    found = model.gradients(rows, y)
    for name in ("left", "right", "bytes", "shift", "out", "bias"):
        flat = model.p[name].reshape(-1)
        i = int(np.abs(found[name] - 1e-4 * model.p[name]).argmax())
        old, e = flat[i], 1e-5
        flat[i] = old + e
        up = loss()
        flat[i] = old - e
        down = loss()
        flat[i] = old
        assert (up - down) / (2 * e) == pytest.approx(found[name].reshape(-1)[i] - 1e-4 * old, abs=1e-4)


@needs_data
def test_quality_held_out(spark):
    labels = queries.table(spark, FOLDER, "labels").select("doc_id", "quality")
    rows = queries.op2_quality(spark, FOLDER).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    clean = [r for r in rows if r["quality"] == 1]
    assert np.mean([r["predicted"] for r in clean]) > 0.98
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


@needs_data
def test_language_held_out(spark):
    truth = queries.table(spark, FOLDER, "documents").select("doc_id", "lang")
    rows = queries.op8_language(spark, FOLDER).where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "123 !?"), (3, "alpha river " * 5000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, score string")
    model = q.ByteCnn().fit([], [])
    assert {r["score"] for r in q.quality_scores(docs, model).collect()} == {0.5}
    assert q.keep_good(docs, model, 0.3).count() == 5 and q.keep_good(docs, model, 0.6).columns == docs.columns
    known = lang.fit(["alpha river stone"] * 10 + ["über äußer straße"] * 10, ["en"] * 10 + ["de"] * 10)
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in lang.languages(docs, known).collect()), key=str)
    assert got == [(1, "und"), (1, "und"), (2, "und"), (3, "en"), (None, "und")]
    assert lang.fit([], []).predict("text") == ("und", 0.0)
    assert lang.languages(docs.limit(0), known).collect() == []
    found = sec.fit_from_documents(docs.limit(0), F.lit(True))
    assert sec.secrets(docs, found).collect() == [] and sec.redacted(docs, found).count() == 5


def test_long_texts_in_blocks(monkeypatch):
    known = lang.fit(["alpha river stone"] * 10 + ["über äußer straße"] * 10, ["en"] * 10 + ["de"] * 10)
    text = "über river äußer stone " * 300
    whole = known.logits(text)
    monkeypatch.setattr(lang, "BLOCK", 64)
    assert np.allclose(known.logits(text), whole)


def test_secrets(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rng = np.random.default_rng(2)
    texts = [good(rng) for _ in range(50)]
    found, labels = sec.examples(texts, 600)
    model = sec.fit_secrets(found, labels, texts)
    other, truth = sec.examples(texts, 200, seed=9)
    scores = model.forest.predict(np.array([model.describe(f) for f in other]))
    assert np.mean((scores >= 0.5) == np.array(truth)) > 0.97
    text = f'Ünï river token = "{key}" stone 4952935900253052 and alpha/river/2041/stone-under'
    assert model.redact(text) == f'Ünï river token = "{sec.MARK}" stone 4952935900253052 and alpha/river/2041/stone-under'
    docs = spark.createDataFrame([(1, text), (None, "clean"), (2, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in sec.redacted(docs, model).collect()} == {1: model.redact(text), None: "clean", 2: None}
    rows = [r for r in sec.secrets(docs, model).collect() if r["is_secret"]]
    assert [(r["doc_id"], text[r["start"] : r["start"] + r["length"]]) for r in rows] == [(1, key)]


def test_secret_candidates_are_whole():
    one = lambda t: [(f.text, f.named) for f in sec.candidates(t)]
    assert one("password      =      hunter2abc") == [("hunter2abc", True)]
    assert one("password\t\t\t\t\t:\thunter2abc") == [("hunter2abc", True)]
    for name in ("secret_key", "private_key", "AWS_SECRET_ACCESS_KEY", "privateKey", "signing-key", "token_v2", "passphrase", "credentials"):
        assert one(f'{name} = "abc12def"') == [("abc12def", True)], name
    long = "k" * 300 + "7" + "q" * 20
    assert one(f"see {long} there") == [(long, False)]
    assert one("the monkey: banana12 and a key word") == []


def test_bare_keys_are_no_negatives():
    bare = sec.candidates("see 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b and alpha/river/2041/stone-under")
    assert [sec.key_shaped(f) for f in bare] == [True, False]
    assert not any(sec.key_shaped(f) for f in sec.candidates("token = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"))


def test_words_of_all_documents(spark):
    rows = [(i, "alpha river stone " * 20) for i in range(30)] + [(i, "x " * 15_000 + "zürqow zürqow zürqow token = zürqow9zürqow") for i in range(30, 33)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    model = sec.fit_from_documents(docs, F.lit(True), most_texts=3)
    assert {"alp", "qow", "zür"} <= model.describe.trigrams
    whole, _ = sec.grams([t for _, t in rows])
    assert {g: n for g, n in whole.items() if g in model.describe.pairs}.keys() == model.describe.pairs.keys()
    every = sec.Describer()
    every.learn_grams(whole)
    assert all(every.pairs[p] == s for p, s in model.describe.pairs.items()) and "9zü" not in every.trigrams


def test_every_language_is_learnt(spark):
    rows = [(1000 * k + i, f"w{k}ord text{k} of{k} its own", f"l{k:03}") for k in range(230) for i in range(2 if k < 200 else 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert lang.fit_language(docs, F.lit(True), epochs=1).names == sorted({r[2] for r in rows})
    assert len(lang.fit_language(docs, F.lit(True), most_languages=3, epochs=1).names) == 3
    assert lang.fit_language(docs.limit(0), F.lit(True)).names == []


def test_language_learns_from_whole_texts(spark):
    rows = [(i, "0123456789 " * 1000 + ("alpha river stone " if i % 2 else "über äußer straße ") * 2000, "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:2] * 30], "doc_id bigint, text string, lang string").repartition(4)
    known = lang.fit_language(docs, F.lit(True), sample_chars=120 * 1500)
    assert known.predict("the river alpha stone")[0] == "en" and known.predict("äußer über straße")[0] == "de"


def test_planted_secrets(spark):
    """Recall and precision on documents that the model has not learnt from, against a scan of the planted places."""
    rng = np.random.default_rng(8)
    draw = lambda alphabet, n: "".join(rng.choice(list(alphabet)) for _ in range(n))
    rows, truth = [], {}
    for i in range(400):
        text = good(rng)
        if i % 4 == 0:
            key = draw("0123456789abcdef", 40)
            text = f'{text} token = "{key}" {good(rng)}'
            truth[i] = {(text.index(key), 40)}
        elif i % 4 == 1:
            text += f" see alpha/river/{rng.integers(1000, 9999)}/stone-under and order {draw('0123456789', 18)}"
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    model = sec.fit_from_documents(docs.where("doc_id < 200"), F.lit(True))
    held = docs.where("doc_id >= 200")
    found = {(r["doc_id"], r["start"], r["length"]) for r in sec.secrets(held, model).collect() if r["is_secret"]}
    planted = {(i, a, n) for i, places in truth.items() if i >= 200 for a, n in places}
    assert len(planted & found) >= 0.95 * len(planted) and len(found - planted) <= 0.05 * len(planted)
    assert found == {(i, f.start, f.end - f.start) for i, t in rows[200:] for f, s in model.findings(t) if s >= model.least_score}

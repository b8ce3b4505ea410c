"""Language identification by averaged hashed subword embeddings and a linear softmax, in numpy.

Runs of two to four bytes of the lower-cased text, word borders included, are hashed to rows of an embedding
table; a text is the average of its rows, and a linear layer with softmax gives the languages. Stochastic gradient
descent trains both. Afterwards table and layer are multiplied once, so that scoring adds one short row per run. A
part of the sample is kept apart to set the temperature of the softmax and the score below which a prediction counts
as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch

UNDETERMINED = "und"
BITS = 16
ORDERS = (2, 3, 4)
PAD = b"    "
BLOCK = 1 << 18  # bytes hashed at once


def buckets(data: np.ndarray) -> np.ndarray:
    """Buckets of the runs that start at each byte; the last ``len(PAD)`` bytes start none. Orders x starts."""
    n = len(data) - len(PAD)
    x = data.astype(np.uint32)
    key, out = x[:n].copy(), []
    for k in range(1, max(ORDERS)):
        key = key * np.uint32(257) + x[k : k + n]
        if k + 1 in ORDERS:
            out.append(((key + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS))
    return np.stack(out)


def letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def prepared(text: str) -> np.ndarray:
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + PAD, dtype=np.uint8)


@dataclass
class Language:
    names: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        data, total = prepared(text), np.zeros(len(self.names))
        n = len(data) - len(PAD)
        for i in range(0, n, BLOCK):
            b = buckets(data[i : min(i + BLOCK, n) + len(PAD)])
            for row in b:
                total += self.table[row].sum(axis=0, dtype=np.float64)
        return total / (n * len(ORDERS)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; texts without a letter are undetermined, with score 0."""
        if not self.names or not letters(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    texts: list[str],
    names: list[str],
    dim: int = 16,
    epochs: int = 4,
    rate: float = 8.0,
    seed: int = 3,
    most_bytes: int = 4096,
    error: float = 0.01,
) -> Language:
    """Train on four fifths of the rows and calibrate on the others.

    ``most_bytes`` bounds what one row gives to training; predictions read whole texts. ``error`` is the share
    of wrong predictions that the accepted rows of the calibration part may have.
    """
    kinds = sorted(set(names))
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, len(kinds))).astype(np.float32), np.zeros(len(kinds))
    if not kinds:
        return Language([], table @ layer, bias)
    bags = []
    for t in texts:
        found, counts = np.unique(buckets(prepared(t)[: most_bytes + len(PAD)]), return_counts=True)
        bags.append((found, (counts / counts.sum()).astype(np.float32)))
    y = np.array([kinds.index(n) for n in names])
    order = rng.permutation(len(texts))
    held, used = order[::5], np.delete(order, np.s_[::5])
    if not len(used):
        used = held
    steps, done = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            found, share = bags[i]
            pace = rate * (1 - done / steps)
            done += 1
            x = share @ table[found]
            g = softmax(x @ layer + bias)
            g[y[i]] -= 1
            gx = layer @ g
            layer -= (pace * 0.1 * np.outer(x, g)).astype(np.float32)
            bias -= pace * 0.01 * g
            table[found] -= (pace * share[:, None] * gx[None, :]).astype(np.float32)
    model = Language(kinds, (table @ layer).astype(np.float32), bias)
    calibrate(model, [texts[i] for i in held], y[held], error)
    return model


def calibrate(model: Language, texts: list[str], y: np.ndarray, error: float) -> None:
    z = np.array([model.logits(t) for t in texts]).reshape(len(texts), len(model.names))
    rows = np.arange(len(y))
    loss = lambda t: -np.log(softmax(z / t)[rows, y] + 1e-12).mean()
    model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=loss)
    p = softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= error)
    model.least_score = float(top[order[fine[-1]]]) if len(fine) else 1.0


def fit_language(
    docs: DataFrame,
    learn: Column,
    rows_per_language: int = 800,
    most_languages: int | None = None,
    row_chars: int = 6000,
    sample_chars: int = 32_000_000,
    **options,
) -> Language:
    """A model fitted on a bounded sample: per language about ``rows_per_language`` rows, chosen by their hashes.

    ``learn`` says which rows may be learnt from; rows without language or letters are not, and repeated rows are one. All
    languages that occur are learnt, or the ``most_languages`` most frequent ones if given. A row gives a part of at most
    ``row_chars`` characters, of which ``fit`` trains on 4,096 bytes; it lies at a place drawn by hash from its whole text.
    Where the sample would hold more than ``sample_chars`` characters, its parts are shorter, so the driver holds a
    bounded sample whatever the number of languages. Without rows the model predicts ``und``.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = (counts if most_languages is None else counts.limit(most_languages)).collect()
    shares = docs.sparkSession.createDataFrame([(r["lang"], rows_per_language / r["n"]) for r in sizes], "lang string, p double")
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(shares), "lang").where(hashed < F.col("p"))
    most = 2 * rows_per_language * len(sizes)
    chars = max(1, min(row_chars, 2 * sample_chars // max(most, 1)))
    start = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    part = F.substring("text", start.cast("int"), F.lit(chars)).alias("text")
    parts = sample.select(F.xxhash64("doc_id").alias("h"), "lang", part).distinct().orderBy("h", "lang", "text").limit(most)
    found = [(r["lang"], r["text"]) for r in parts.collect() if letters(r["text"])]
    return fit([t for _, t in found], [n for n, _ in found], **options)


def languages(
    docs: DataFrame, model: Language, reject: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, lang_pred, score, accepted) per document, over whole texts, without a shuffle.

    ``accepted`` says that the calibrated score reaches the model's least score; with ``reject`` other
    predictions become "und". Null, empty and letterless texts are "und" with score 0 and not accepted. Null ids,
    repeated rows and other columns do not matter; an empty table gives no rows.
    """
    df = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def predict(batch: dict[str, list]) -> dict[str, list]:
        found = [model.predict(t) for t in batch["text"]]
        accepted = [n != UNDETERMINED and s >= model.least_score for n, s in found]
        lang = [n if a or not reject else UNDETERMINED for (n, _), a in zip(found, accepted)]
        return {"id": batch["id"], "lang": lang, "score": [s for _, s in found], "accepted": accepted}

    kind = df.schema["id"].dataType.simpleString()
    out = by_batch(df, predict, f"id {kind}, lang_pred string, score double, accepted boolean")
    return out.withColumnRenamed("id", id_col)

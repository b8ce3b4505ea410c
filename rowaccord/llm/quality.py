"""Document quality by a convolutional network over bytes, in numpy.

Every byte has a learned vector; a text is read in overlapping chunks of ``2 * STRIDE`` bytes, one every ``STRIDE``
bytes, from its first byte to its last. Each learned filter gives one number per chunk, the largest of which over the
whole text is kept, and a logistic layer combines what the filters found into one probability. Training sends each
gradient back through the chunk that was the largest. Texts of any length are read in blocks of bounded size.

Only the fit runs on the driver, on a bounded sample of labelled rows; scoring is one pass over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, id_and_text

STRIDE = 8
BLOCK = 1 << 17  # bytes convolved at once


def padded(text: str | None) -> np.ndarray:
    """The UTF-8 bytes in rows of ``STRIDE``, zeros at the end; at least two rows, so at least one chunk."""
    data = (text or "").encode("utf-8", "replace")
    rows = max(2, -(-len(data) // STRIDE))
    return np.frombuffer(data.ljust(rows * STRIDE, b"\0"), dtype=np.uint8).reshape(rows, STRIDE)


@dataclass
class ByteCnn:
    dim: int = 8
    filters: int = 32
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self) -> None:
        rng = np.random.default_rng(self.seed)
        width = STRIDE * self.dim
        self.p = {
            "bytes": rng.normal(0, 0.5, (256, self.dim)),
            "left": rng.normal(0, 1 / np.sqrt(2 * width), (width, self.filters)),
            "right": rng.normal(0, 1 / np.sqrt(2 * width), (width, self.filters)),
            "shift": np.zeros(self.filters),
            "out": rng.normal(0, 0.3, self.filters),
            "bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def chunks(self, rows: np.ndarray) -> np.ndarray:
        """What the filters give for each chunk of padded rows."""
        x = self.p["bytes"][rows].reshape(len(rows), -1)
        return (x @ self.p["left"])[:-1] + (x @ self.p["right"])[1:]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter, and the chunk that has it."""
        step, best, at = BLOCK // STRIDE, None, None
        for i in range(0, len(rows) - 1, step):
            z = self.chunks(rows[i : i + step + 1])
            k = z.argmax(axis=0)
            top = z[k, np.arange(z.shape[1])]
            if best is None:
                best, at = top, k + i
            else:
                at = np.where(top > best, k + i, at)
                best = np.maximum(top, best)
        return best, at

    def maxima(self, rows: np.ndarray) -> np.ndarray:
        step, best = BLOCK // STRIDE, None
        for i in range(0, len(rows) - 1, step):
            top = self.chunks(rows[i : i + step + 1]).max(axis=0)
            best = top if best is None else np.maximum(top, best)
        return best

    def probability(self, best: np.ndarray) -> np.ndarray:
        logit = np.tanh(best + self.p["shift"]) @ self.p["out"] + self.p["bias"]
        return 1.0 / (1.0 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.probability(self.maxima(padded(text))[None, :])[0])

    def scores(self, texts: list[str | None]) -> list[float]:
        return [self.score(t) for t in texts]

    def fit(self, texts: list[str], labels: list[int], epochs: int = 12, batch: int = 32, rate: float = 0.01) -> ByteCnn:
        """Adam on the logistic loss; the order of the rows and the start are fixed by ``seed``."""
        self.start()
        rng = np.random.default_rng(self.seed)
        rows, y = [padded(t) for t in texts], np.asarray(labels, dtype=np.float32)
        if not len(rows) or y.min() == y.max():
            # One class only: its smoothed share is the score of every text.
            share = (y.sum() + 1) / (len(y) + 2)
            self.p["out"][:] = 0
            self.p["bias"][:] = np.log(share / (1 - share))
            return self
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                step += 1
                grads = self.gradients([rows[k] for k in order[i : i + batch]], y[order[i : i + batch]])
                pace = rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    unbiased = second[k] / (1 - 0.99**step)
                    self.p[k] -= (pace * first[k] / (1 - 0.9**step) / (np.sqrt(unbiased) + 1e-7)).astype(np.float32)
        return self

    def gradients(self, rows: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        found = [self.pooled(r) for r in rows]
        best = np.stack([b for b, _ in found])
        hidden = np.tanh(best + self.p["shift"])
        error = ((self.probability(best) - y) / len(y)).astype(np.float32)
        back = error[:, None] * self.p["out"] * (1 - hidden * hidden)  # documents x filters
        left = np.stack([r[at] for r, (_, at) in zip(rows, found)])  # documents x filters x STRIDE bytes
        right = np.stack([r[at + 1] for r, (_, at) in zip(rows, found)])
        table, out = self.p["bytes"], {}
        of_bytes = np.zeros_like(table)
        for name, seen in (("left", left), ("right", right)):
            x = table[seen].reshape(*seen.shape[:2], -1)
            out[name] = np.einsum("df,dfw->wf", back, x)
            gx = (back[:, :, None] * self.p[name].T[None, :, :]).reshape(-1, self.dim)
            np.add.at(of_bytes, seen.reshape(-1), gx)
        out |= {"bytes": of_bytes, "shift": back.sum(axis=0), "out": error @ hidden, "bias": error.sum(keepdims=True)}
        decay = 1e-4
        return {k: g + decay * self.p[k] for k, g in out.items()}


def labelled_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, most_rows: int, most_chars: int
) -> list[tuple[str, int]]:
    """At most ``most_rows`` labelled texts of at most ``most_chars`` characters: those with the least hashes.

    ``learn`` says which rows of ``labels`` may be learnt from. The order does not depend on partitions.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1)).select(
        labels["doc_id"].alias("lid"), F.col(label_col).cast("int").alias("y")
    )
    texts = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text")).where("text is not null")
    short = texts.where(F.length("text") <= most_chars).withColumn("h", F.xxhash64("id"))
    # The hash that the last chosen row has, found from ids alone: of texts only those up to it are shuffled.
    first = short.select("id", "h").join(known, F.col("id") == F.col("lid")).select("h").orderBy("h").limit(most_rows)
    last = first.agg(F.max("h")).first()[0]
    if last is None:
        return []
    pool = short.where(F.col("h") <= last).join(known, F.col("id") == F.col("lid"))
    chosen = pool.select("text", "y", "h").orderBy("h", "text", "y").limit(most_rows)
    return [(r["text"], r["y"]) for r in chosen.collect()]


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label_col: str = "quality",
    most_rows: int = 4000,
    most_chars: int = 12_000,
    **options,
) -> ByteCnn:
    """A model fitted on a bounded sample; without labelled rows it scores every text 0.5."""
    rows = labelled_sample(docs, labels, learn, label_col, most_rows, most_chars)
    return ByteCnn().fit([t for t, _ in rows], [y for _, y in rows], **options)


def quality_scores(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, score) per document, whole texts, no shuffle.

    Null texts are scored like empty ones. Null ids, repeated rows and other columns do not matter; an empty table
    gives no rows.
    """
    df = id_and_text(docs, id_col, text_col)

    def score(batch: dict[str, list]) -> dict[str, list]:
        return {"id": batch["id"], "score": model.scores(batch["text"])}

    kind = df.schema["id"].dataType.simpleString()
    return by_batch(df, score, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: ByteCnn, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``least_score``, unchanged and with all their columns."""

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: model.score(t if isinstance(t, str) else None))

    return docs.where(score(docs[text_col].cast("string")) >= least_score)

"""Secret scans: patterns propose candidates, a random forest removes false positives.

Candidates are long runs of key-like characters with a digit, and values that are assigned to names such as ``token``.
Each is described by its length, its character transitions, how far words of the corpus cover it, whether it looks like
part of a path, and the words beside it; the forest learns from labelled findings which descriptions are secrets.
The words' letter pairs and trigrams are counted over all documents. Only the fit of the forest runs on the driver, on a
bounded sample of findings; the scan is one pass over whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, id_and_text, settled

LONG = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}")
_BLANK = r"(?:\s{0,3}|[^\S\r\n]*+)"
NAMED = re.compile(
    r"(?:token|secret|passw(?:or)?d|passphrase|passcode|pwd|credential|authorization|[a-z0-9][_-]key"
    r"|(?:api|access|secret|private|auth|encryption|signing|master|shared|session|account|storage|client|service|license|ssh|host|deploy)key)"
    rf"[\w-]{{0,40}}+[\"']?{_BLANK}(?:=>|:=|[:=]){_BLANK}[\"']?([^\s\"'<>&;,]{{6,}})",
    re.I,
)
CONTEXT = 24
#: Words that made findings are put together from, drawn by hash.
MOST_WORDS = 20_000
MARK = "[secret]"


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    text: str
    before: str
    after: str
    named: bool


def candidates(text: str | None) -> list[Finding]:
    """Candidates in text order; where both patterns overlap, the named one stays."""
    if not text:
        return []
    found = {}
    if "=" in text or ":" in text:
        found = {m.span(1): True for m in NAMED.finditer(text)}
    taken = list(found)
    for m in LONG.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            found[m.span()] = False
    return [
        Finding(a, b, text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], named)
        for (a, b), named in sorted(found.items())
    ]


# ---- features --------------------------------------------------------------------------

_WORD = re.compile(r"[^\W\d_]+")
FEATURES = (
    "length", "transitions", "digits", "upper", "lower", "other", "distinct", "entropy", "hex", "word_cover",
    "pair_surprise", "longest_letters", "slashes", "path_beside", "quoted", "assigned", "word_before", "word_after",
)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def grams(texts: list[str | None]) -> tuple[Counter[str], set[str]]:
    """Counts of the first letters of pairs, the pairs and the trigrams of words, and those pairs and trigrams that candidates have.

    Words are counted outside candidates: otherwise keys would teach their own trigrams, more so the larger the corpus.
    """
    words: Counter[str] = Counter()
    inside: set[str] = set()
    for t in texts:
        at = 0
        for f in candidates(t):
            words.update(_WORD.findall(t[at : f.start].lower()))
            at = f.end
            inside |= _parts(f.text)
        words.update(_WORD.findall((t or "")[at:].lower()))
    counts: Counter[str] = Counter()
    for w, n in words.items():
        for i in range(len(w) - 1):
            counts[w[i]] += n
            counts[w[i : i + 2]] += n
            if i + 2 < len(w):
                counts[w[i : i + 3]] += n
    return counts, inside


def _parts(text: str) -> set[str]:
    low = text.lower()
    return {low[i : i + k] for k in (2, 3) for i in range(len(low) - k + 1) if low[i : i + k].isalpha()}


@dataclass
class Describer:
    """Turns findings into numbers, with what it knows of the corpus's words and of words beside secrets."""

    trigrams: set[str] = field(default_factory=set)
    pairs: dict[str, float] = field(default_factory=dict)
    beside: tuple[dict[str, float], dict[str, float]] = field(default_factory=lambda: ({}, {}))

    def learn_words(self, texts: list[str]) -> None:
        self.learn_grams(grams(texts)[0])

    def learn_grams(self, counts: dict[str, int]) -> None:
        """``counts`` has how often each first letter of a pair, each pair and each trigram occurs in words."""
        self.pairs = {p: -math.log((n + 1) / (counts[p[0]] + 30)) for p, n in counts.items() if len(p) == 2}
        self.trigrams = {t for t, n in counts.items() if len(t) == 3 and n > 2}

    def learn_neighbours(self, findings: list[Finding], labels: list[int]) -> None:
        share = (sum(labels) + 1) / (len(labels) + 2)
        for side in (0, 1):
            seen: dict[str, list[int]] = {}
            for f, y in zip(findings, labels):
                seen.setdefault(self._neighbour(f, side), []).append(y)
            logit = lambda p: math.log(p / (1 - p))
            odds = {w: logit((sum(ys) + 2 * share) / (len(ys) + 2)) - logit(share) for w, ys in seen.items() if len(ys) >= 3}
            self.beside[side].clear()
            self.beside[side].update(odds)

    @staticmethod
    def _neighbour(f: Finding, side: int) -> str:
        words = _WORD.findall((f.before, f.after)[side].lower())
        return (words[-1] if side == 0 else words[0]) if words else ""

    def __call__(self, f: Finding) -> list[float]:
        s, n = f.text, len(f.text)
        kinds = [_kind(c) for c in s]
        share = [kinds.count(k) / n for k in range(4)]
        counts = np.unique(list(s), return_counts=True)[1] / n
        low = s.lower()
        covered = np.zeros(n, dtype=bool)
        for i in range(n - 2):
            if low[i : i + 3] in self.trigrams:
                covered[i : i + 3] = True
        surprise = [self.pairs.get(low[i : i + 2], 7.0) for i in range(n - 1) if low[i : i + 2].isalpha()]
        runs = [len(w) for w in _WORD.findall(s)]
        return [
            math.log(n),
            sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
            *share,
            len(counts) / n,
            float(-(counts * np.log2(counts)).sum()),
            float(all(c in "0123456789abcdef" for c in low)),
            float(covered.mean()),
            sum(surprise) / len(surprise) if surprise else 7.0,
            max(runs, default=0) / n,
            (s.count("/") + s.count("-") + s.count("_")) / n,
            float("/" in f.before[-2:] or "/" in f.after[:1] or "." in f.after[:1] and f.after[1:2].isalpha()),
            float(f.before[-1:] in "\"'`" and f.after[:1] in "\"'`") if f.before and f.after else 0.0,
            float(f.named or bool(re.search(r"[=:]\s*[\"']?$", f.before))),
            self.beside[0].get(self._neighbour(f, 0), 0.0),
            self.beside[1].get(self._neighbour(f, 1), 0.0),
        ]


# ---- forest ----------------------------------------------------------------------------


@dataclass
class Forest:
    """Classification trees on bootstrap samples with random features at each split, as flat arrays."""

    trees: int = 40
    depth: int = 8
    least: int = 3
    seed: int = 11
    nodes: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            out: list[list[float]] = []
            self._grow(x[rows], y[rows].astype(float), 0, rng, out)
            self.nodes.append(tuple(np.array(c) for c in zip(*out)))
        return self

    def _grow(self, x, y, depth, rng, out) -> int:
        """Rows of (feature, threshold, left, right, share); a leaf's feature is -1."""
        me = len(out)
        out.append([-1, 0.0, 0, 0, (y.sum() + 0.5) / (len(y) + 1)])
        if depth == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return me
        best = (0.0, -1, 0.0)
        pure = y.mean() * (1 - y.mean())
        for f in rng.permutation(x.shape[1])[: max(1, round(math.sqrt(x.shape[1])))]:
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            split = np.flatnonzero((v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least))
            if not len(split):
                continue
            left, k = hits[split] / n[split], n[split]
            right = (hits[-1] - hits[split]) / (len(y) - k)
            gain = pure - (k * left * (1 - left) + (len(y) - k) * right * (1 - right)) / len(y)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-12:
                best = (float(gain[i]), int(f), float((v[split[i]] + v[split[i] + 1]) / 2))
        if best[1] < 0:
            return me
        goes = x[:, best[1]] <= best[2]
        out[me][:2] = best[1], best[2]
        out[me][2] = self._grow(x[goes], y[goes], depth + 1, rng, out)
        out[me][3] = self._grow(x[~goes], y[~goes], depth + 1, rng, out)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.nodes:
            return np.full(len(x), 0.5)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, share in self.nodes:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at].astype(np.int64)
                goes = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(goes, left[at], right[at]).astype(np.int64))
            total += share[at]
        return total / len(self.nodes)


@dataclass
class SecretModel:
    describe: Describer
    forest: Forest
    least_score: float = 0.5

    def findings(self, text: str | None) -> list[tuple[Finding, float]]:
        found = candidates(text)
        if not found:
            return []
        scores = self.forest.predict(np.array([self.describe(f) for f in found]))
        return list(zip(found, scores.tolist()))

    def redact(self, text: str | None) -> str | None:
        """The text with every secret replaced by a mark; a text without any is returned as it is."""
        spans = [(f.start, f.end) for f, s in self.findings(text) if s >= self.least_score]
        for a, b in reversed(spans):
            text = text[:a] + MARK + text[b:]
        return text


def fit_secrets(findings: list[Finding], labels: list[int], texts: list[str] | dict[str, int]) -> SecretModel:
    """Fit on labelled findings; ``texts``, or their ``grams``, teach the words of the corpus."""
    describe = Describer()
    describe.learn_grams(texts if isinstance(texts, dict) else grams(texts)[0])
    describe.learn_neighbours(findings, labels)
    forest = Forest()
    if findings and min(labels) != max(labels):
        forest.fit(np.array([describe(f) for f in findings]), np.array(labels))
    return SecretModel(describe, forest)


# ---- labelled findings -----------------------------------------------------------------


def label(f: Finding) -> int:
    """The label of a finding by rule: the value of a named secret that mixes letters and digits.

    It stands in for a reviewer where no reviewed findings are at hand.
    """
    mixed = bool(re.search(r"\d", f.text)) and bool(re.search(r"[A-Za-z]", f.text))
    return int(f.named and mixed and len(set(f.text)) >= 6)


def key_shaped(f: Finding) -> bool:
    """Whether a bare finding could be a key as well as not: no rule labels it, so it teaches nothing."""
    shaped = (len(w) >= 12 and re.search("[0-9]", w) and re.search("[A-Za-z]", w) for w in re.split(r"[/_=\-]+", f.text))
    return not f.named and any(shaped)


def examples(texts: list[str], n: int, seed: int = 5) -> tuple[list[Finding], list[int]]:
    """Findings made by rule around words of ``texts``: keys of common shapes, and what is often taken for one."""
    rng = np.random.default_rng(seed)
    every_word = {w for t in texts for w in _WORD.findall(t)}
    words = sorted(every_word, key=lambda w: (zlib.crc32(w.encode()), w))[:MOST_WORDS] or ["word"]
    word = lambda: words[rng.integers(len(words))]
    letters = "abcdefghijklmnopqrstuvwxyz"
    every = letters + letters.upper() + "0123456789"
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    names = ("token", "secret", "password", "api_key", "access_key", "TOKEN", "Password")
    secrets = (
        lambda: draw("0123456789abcdef", 40), lambda: draw("0123456789ABCDEF", 40), lambda: draw("0123456789abcdef", 32),
        lambda: draw(every, 40), lambda: draw(every + "+/", 43) + "=", lambda: f"{draw(letters, 3)}_{draw(every, 36)}",
        lambda: draw(letters.upper() + "0123456789", 20),
    )
    others = (
        lambda: "/".join([word(), word(), str(rng.integers(1, 9999)), word()]), lambda: "-".join([word(), str(rng.integers(1, 3000)), word(), word()]),
        lambda: draw("0123456789", int(rng.integers(16, 24))), lambda: f"{word()}_{word()}_{rng.integers(10, 99)}_{word()}",
        lambda: f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 28)}T{rng.integers(10, 24)}-00-00", lambda: word() + word() + str(rng.integers(1, 99)) + word(),
    )
    found, labels = [], []
    for k in range(n):
        secret = k % 2
        value = (secrets if secret else others)[k // 2 % (7 if secret else 6)]()
        named, quoted = bool(secret and rng.random() < 0.7), rng.random() < 0.5
        name = names[rng.integers(len(names))] if named else word()
        before = f"{word()} {name}{' = ' if named or rng.random() < 0.1 else ' '}" + '"' * quoted
        found.append(Finding(0, len(value), value, before[-CONTEXT:], '"' * quoted + f" {word()} {word()}", named))
        labels.append(secret)
    return found, labels


def fit_from_documents(docs: DataFrame, learn: Column, most_findings: int = 3000, most_texts: int = 400) -> SecretModel:
    """A model from a bounded sample of the documents that ``learn`` admits, chosen by their hashes.

    Of at most a third of ``most_findings`` whole documents with candidates, at most ``most_findings`` findings are
    drawn by hash and labelled by ``label``; as many are made by ``examples`` from words of ``most_texts`` whole
    documents, drawn by hash too. The corpus's pairs and trigrams are counted in all documents. Repeated rows are drawn
    once, null texts teach nothing; without documents the made findings teach alone.
    """
    text = F.col("text").cast("string")
    rows = docs.where(learn & text.isNotNull()).select(F.xxhash64(docs["doc_id"], text).alias("h"), text.alias("text"))
    likely = rows.where(F.col("text").rlike(r"[A-Za-z0-9+/_\-]{16,}") & F.col("text").rlike(r"[0-9][A-Za-z0-9+/_\-]{11,}|[=:]"))

    def listed(batch: dict[str, list]) -> dict[str, list]:
        found = [(h, f) for h, t in zip(batch["h"], batch["text"]) for f in candidates(t) if not key_shaped(f)]
        columns = zip(*[(h, f.start, f.end, f.text, f.before, f.after, f.named) for h, f in found]) if found else [()] * 7
        return dict(zip(("h", "start", "end", "text", "before", "after", "named"), map(list, columns)))

    schema = "h bigint, start bigint, end bigint, text string, before string, after string, named boolean"
    drawn = by_batch(least_hashes(likely, "h", most_findings // 3), listed, schema)
    drawn = settled(drawn.withColumn("place", F.xxhash64("h", "start", "end")), "secret-findings")
    chosen = least_hashes(drawn, "place", most_findings).collect()
    real = [Finding(r["start"], r["end"], r["text"], r["before"], r["after"], r["named"]) for r in sorted(chosen, key=lambda r: (r["place"], r["text"]))]

    words = by_batch(
        least_hashes(rows, "h", most_texts), lambda b: {"w": sorted({w for t in b["text"] for w in _WORD.findall(t)})}, "w string"
    )
    words = settled(words.distinct().withColumn("h", F.xxhash64("w")), "secret-words")
    made, of_made = examples([r["w"] for r in least_hashes(words, "h", MOST_WORDS).collect()], max(len(real), 600))
    found = real + made
    return fit_secrets(found, [label(f) for f in real] + of_made, corpus_grams(docs, {p for f in found for p in _parts(f.text)}))


def least_hashes(df: DataFrame, hash_col: str, n: int) -> DataFrame:
    """One row of ``df`` for each of the ``n`` least values of ``hash_col``.

    The last of these values is found from hashes alone, so other columns of only the chosen rows are moved.
    """
    last = df.select(hash_col).distinct().orderBy(hash_col).limit(n).agg(F.max(hash_col)).first()[0]
    return df.where(F.lit(False) if last is None else F.col(hash_col) <= last).dropDuplicates([hash_col])


def corpus_grams(docs: DataFrame, wanted: set[str]) -> dict[str, int]:
    """``grams`` of the whole texts of all documents: those of ASCII letters, of candidates, and the ``wanted`` ones.

    Others are of no use, since only candidates are described; without them the driver gets a bounded table also from
    scripts with very many letters. First letters are all kept.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        counts, inside = grams(batch["text"])
        inside |= wanted
        found = counts.keys() | inside
        return {"g": list(found), "n": [counts[g] for g in found], "used": [len(g) == 1 or g.isascii() or g in inside for g in found]}

    rows = by_batch(docs.select(F.col("text").cast("string").alias("text")), run, "g string, n bigint, used boolean")
    kept = rows.groupBy("g").agg(F.sum("n").alias("n"), F.bool_or("used").alias("used")).where("used and n > 0")
    return {r["g"]: r["n"] for r in kept.collect()}


def secrets(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, start, length, score, is_secret, named) per candidate, in code points of the whole text.

    Null and empty texts have no candidates; repeated rows give repeated findings, null ids are kept, other columns
    are ignored, an empty table gives no rows.
    """
    df = id_and_text(docs, id_col, text_col)

    def run(batch: dict[str, list]) -> dict[str, list] | None:
        rows = [(i, f, s) for i, t in zip(batch["id"], batch["text"]) for f, s in model.findings(t)]
        if not rows:
            return None
        return {
            "id": [i for i, _, _ in rows],
            "start": [f.start for _, f, _ in rows],
            "length": [f.end - f.start for _, f, _ in rows],
            "score": [s for _, _, s in rows],
            "is_secret": [s >= model.least_score for _, _, s in rows],
            "named": [f.named for _, f, _ in rows],
        }

    kind = df.schema["id"].dataType.simpleString()
    out = by_batch(df, run, f"id {kind}, start bigint, length bigint, score double, is_secret boolean, named boolean")
    return out.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, model: SecretModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in their texts replaced; all other columns and all rows stay. Null texts stay null."""

    @F.pandas_udf("string")
    def redact(texts):
        return texts.map(lambda t: model.redact(t) if isinstance(t, str) else None)

    return docs.withColumn(text_col, redact(F.col(text_col).cast("string"))).select(*docs.columns)

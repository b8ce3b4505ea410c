"""Packing of documents into token sequences by bin completion.

A document's tokens end with one end mark. Only documents longer than a sequence are cut: every piece but the
first fills a sequence of its own, so what is left to pack are lengths between 1 and the capacity. All that
matters for a packing is how many pieces have each length, a table of at most ``capacity`` rows whatever the
size of the corpus. Bin completion runs on that table: a best-fit packing is the first incumbent, then a
branch-and-bound takes the largest length left and commits the fullest filling around it, found exactly, level by
level down to the last piece. From there it goes back, enumerates the other fillings that no filling dominates, and
prunes by the waste that a better packing could still afford. A filling is used for as many
sequences at once as its counts allow. The plan comes back as runs: the ranks from a to b of one length go, m to
a sequence, to the sequences from s on. Each piece finds its run by its rank among the pieces of its length; ranks
come from counts per length and hash bucket, so that a length that a third of all pieces have is split.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowaccord.functions.names import col

from .common import by_batch, free_name, id_and_text, settled

#: The id 0 that ends a document.
MARK = bytes(4)
#: Steps of one enumeration of fillings.
STEPS = 100_000
#: Packings by best fit on the way down: at so many first levels, and at so many parts of the total.
TRIES, PARTS = 8, 32
#: Hash buckets of each length when ranks are dealt out.
RANK_BUCKETS = 256


# ---- tokens ----------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, as ``tokenizers`` gives them.

    An added token of the vocabulary, such as its end mark, is one id wherever its string stands in a text; a text that
    holds one is never cut into blocks. Texts of plain Latin letters take the faster of two public libraries, fed with the same vocabulary and merges;
    others, and vocabularies whose ids are not in the order of their merges, do not. Very long texts are encoded in
    blocks that end before a space between two letters, where the byte-level pattern always begins a new piece.
    """

    #: Fixed value: the pattern of byte-level tokenizers.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _PLAIN = re.compile("[\n -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
    _GAP = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

    def __init__(self, path: str, block: int = 1 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        self.block = block
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.added = [t["content"] for t in model.get("added_tokens", [])]
        self.fast = self._fast(model["model"], model.get("pre_tokenizer") or {})

    def _fast(self, model: dict, pattern: dict) -> tiktoken.Encoding | None:
        simple = pattern.get("type") == "ByteLevel" and not pattern["add_prefix_space"] and pattern.get("use_regex", True)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        if not simple or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merged)):
            return None
        # Byte-level vocabularies write visible Latin bytes as themselves and the others as 256 and up, in order.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if i < 256 + len(merged)}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _blocks(self, text: str) -> Iterator[str]:
        start = 0
        while self.fast is not None and len(text) - start > self.block and (m := self._GAP.search(text, start + self.block)):
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def __call__(self, text: str | None) -> bytes:
        """The ids of one document, with the end mark."""
        text, out = text or "", []
        special = any(t in text for t in self.added)
        for part in [text] if special else self._blocks(text):
            if self.fast is not None and not special and self._PLAIN.fullmatch(part):
                ids = self.fast.encode_ordinary(part)
            else:
                ids = self.tokenizer.encode(part, add_special_tokens=False).ids
            out.append(np.array(ids, dtype="<u4").tobytes())
        return b"".join(out) + MARK


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: all but the first are full."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def document_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (id, piece, start, length, ids) per piece of a document; ids are little-endian 32-bit numbers.

    A null text is an empty one, whose only id is the end mark.
    """

    def run(batch: dict[str, list]) -> dict[str, list] | None:
        out: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "ids")}
        encode = encoder(tokenizer)
        for key, text in zip(batch["id"], batch["text"], strict=True):
            ids = encode(text)
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                piece = ids[4 * start : 4 * (start + length)]
                for name, value in zip(out, (key, k, start, length, piece), strict=True):
                    out[name].append(value)
        return out

    df = id_and_text(docs, id_col, text_col)
    kind = df.schema["id"].dataType.simpleString()
    return by_batch(df, run, f"id {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("id", id_col)


# ---- the plan --------------------------------------------------------------------------

Filling = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: groups of equal sequences share one entry."""
    groups: dict[int, dict[Filling, int]] = defaultdict(dict)  # by room left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        # Best fit fills the sequences with least room first, each one as far as it goes.
        for room in sorted(r for r in groups if r >= length):
            for filling, n in list(groups[room].items()):
                if not left:
                    break
                per = room // length
                whole = min(n, left // per)
                parts = [(whole, per)] if whole else []
                if whole < n and left - whole * per:
                    parts.append((1, left - whole * per))
                for copies, per_one in parts:
                    if groups[room][filling] == copies:
                        del groups[room][filling]
                    else:
                        groups[room][filling] -= copies
                    new = (*filling, (length, per_one))
                    to = groups[room - per_one * length]
                    to[new] = to.get(new, 0) + copies
                    left -= copies * per_one
        if left:
            per = capacity // length
            for copies, per_one in ((left // per, per), (1, left % per)):
                if copies and per_one:
                    to = groups[capacity - per_one * length]
                    to[(length, per_one),] = to.get(((length, per_one),), 0) + copies
    return [(f, n) for g in groups.values() for f, n in g.items()]


def completions(largest: int, counts: dict[int, int], capacity: int, most_waste: int, most: int) -> list[Filling]:
    """Undominated fillings around one piece of the largest length, least waste first.

    A filling is dropped where a length that is left could still be added, or where one of its lengths could give
    way to a longer one that fits: the longer one dominates it.
    """
    lengths = sorted((x for x in counts if counts[x] > (x == largest)), reverse=True)
    have = {x: counts[x] - (x == largest) for x in lengths}
    found: list[tuple[int, Filling]] = []
    steps = [STEPS]

    def extend(i: int, room: int, chosen: list[tuple[int, int]]) -> None:
        steps[0] -= 1
        if steps[0] < 0 or len(found) >= most:
            return
        while i < len(lengths):
            if (x := lengths[i]) <= room:
                for n in range(min(have[x], room // x), 0, -1):
                    extend(i + 1, room - n * x, [*chosen, (x, n)])
                    if len(found) >= most or found and found[-1][0] == 0 and len(found) >= most // 2:
                        return
                steps[0] -= 1
                if steps[0] < 0:
                    return
            i += 1
        if room <= most_waste and not dominated(room, chosen):
            found.append((room, tuple(chosen)))

    def dominated(room: int, chosen: list[tuple[int, int]]) -> bool:
        used = dict(chosen)
        for x in lengths:
            if have[x] > used.get(x, 0) and (x <= room or any(y < x <= y + room for y in used)):
                return True
        return False

    extend(0, capacity - largest, [])
    merged = []
    for room, chosen in sorted(found):
        filling = {largest: 1}
        for x, n in chosen:
            filling[x] = filling.get(x, 0) + n
        merged.append(tuple(sorted(filling.items(), reverse=True)))
    return merged


class Fullest:
    """The fullest filling around one piece of the largest length, longest lengths first: exact, by sums as bits.

    ``sums[i]`` has the bit of each sum that pieces of the ``i`` shortest lengths can reach; a change of a length
    touches only those from there on. No filling dominates the fullest one.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = counts, capacity
        self.lengths = sorted(counts)
        self.sums = [1]

    def changed(self, length: int) -> None:
        del self.sums[bisect.bisect_left(self.lengths, length) + 1 :]

    def reach(self, sums: int, length: int, n: int) -> int:
        n = min(n, self.capacity // length)
        part, every = 1, (1 << self.capacity + 1) - 1
        while n > 0:
            sums |= sums << length * min(part, n) & every
            part, n = 2 * part, n - part
        return sums

    def __call__(self, largest: int) -> Filling:
        room = self.capacity - largest
        top = bisect.bisect_right(self.lengths, min(room, largest))
        for i in range(len(self.sums), top + 1):
            x = self.lengths[i - 1]
            self.sums.append(self.reach(self.sums[-1], x, self.counts.get(x, 0) - (x == largest)))
        left = (self.sums[top] & (1 << room + 1) - 1).bit_length() - 1
        filling = {largest: 1}
        for i in range(top, 0, -1):
            if not left:
                break
            x = self.lengths[i - 1]
            n = min(self.counts.get(x, 0) - (x == largest), left // x)
            while n > 0 and not self.sums[i - 1] >> left - n * x & 1:
                n -= 1
            if n > 0:
                filling[x] = filling.get(x, 0) + n
                left -= n * x
        if top and self.lengths[top - 1] == largest:
            self.changed(largest)
        return tuple(sorted(filling.items(), reverse=True))


def bin_completion(
    counts: dict[int, int], capacity: int, effort: int = 400, branches: int = 64
) -> list[tuple[Filling, int]]:
    """Fillings with their numbers of copies that use up ``counts`` in few sequences.

    The search goes down to the last piece once, whatever that takes, with the fullest filling of each level. It ends
    at a proven optimum, or with the best packing seen after ``effort`` more fillings, from the last levels
    up. The levels depend on the number of different lengths, never on the number of documents.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    bound = -(-total // capacity)
    size = lambda plan: sum(n for _, n in plan)
    best = best_fit(counts, capacity)
    fewest = size(best)
    rest, waste = dict(counts), 0
    fullest = Fullest(rest, capacity)
    done: list[tuple[Filling, int]] = []

    def use(filling: Filling, copies: int) -> None:
        """Take ``copies`` of a filling out of the rest, or put them back where negative."""
        nonlocal waste
        for x, n in filling:
            rest[x] = rest.get(x, 0) - n * copies
            if not rest[x]:
                del rest[x]
        waste += (capacity - sum(x * n for x, n in filling)) * copies
        fullest.changed(min(filling)[0])

    def options() -> Iterator[Filling]:
        largest = max(rest)
        yield (first := fullest(largest))
        afford = (fewest - 1) * capacity - total - waste
        if afford >= 0:
            yield from (f for f in completions(largest, rest, capacity, min(afford, capacity), branches) if f != first)

    levels, down, mark = [options()] if rest else [], True, PARTS - 1
    while levels and fewest > bound and effort > 0:
        filling = next(levels[-1], None)
        if filling is None:
            levels.pop()
            if done:
                f, copies = done.pop()
                use(f, -copies)
            continue
        effort -= not down
        # A better packing has at most one sequence less: what it may waste in all is known.
        afford = (fewest - 1) * capacity - total - waste
        room = capacity - sum(x * n for x, n in filling)
        copies = min(rest[x] // n for x, n in filling)
        if not down and room:
            copies = min(copies, max(0, afford) // room)
        if not copies:
            continue
        done.append((filling, copies))
        use(filling, copies)
        if rest:
            levels.append(options())
            # On the way down the rest is also packed by best fit, at the first levels and at even parts of the total.
            if down and (len(done) <= TRIES or sum(k * v for k, v in rest.items()) * PARTS <= total * mark):
                mark = sum(k * v for k, v in rest.items()) * PARTS // total
                whole = done + best_fit(rest, capacity)
                if size(whole) < fewest:
                    best, fewest = whole, size(whole)
            continue
        down = False
        if size(done) < fewest:
            best, fewest = list(done), size(done)
        f, copies = done.pop()
        use(f, -copies)
    return best


def runs(plan: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, pieces a sequence, first sequence, first offset) of each filling's lengths."""
    out, used, sequence = [], defaultdict(int), 0
    for filling, copies in plan:
        offset = 0
        for length, n in filling:
            out.append((length, used[length], used[length] + n * copies, n, sequence, offset))
            used[length] += n * copies
            offset += n * length
        sequence += copies
    return out


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Give each row of ``pieces`` (id, piece, length and any others) its ``sequence_id`` and ``offset``.

    Rows with a null length or one outside 1 to ``capacity`` cannot be packed and raise. Repeated rows are packed one by
    one, rows with null ids as well, an empty table gives no rows. Other columns stay, but for earlier ones named
    ``sequence_id`` or ``offset``, which are replaced. The driver sees one count per length.
    """
    spark = pieces.sparkSession
    own = free_name(pieces, "place")
    bucket, row = F.col(f"{own}.bucket"), F.col(f"{own}.row")
    salted = pieces.withColumn(own, F.struct(F.pmod(F.xxhash64(id_col, "piece"), F.lit(RANK_BUCKETS)).alias("bucket")))
    cells = settled(salted.groupBy(F.col("length").alias("l"), bucket.alias("b")).agg(F.count("*").alias("n")), "pack-counts")
    counts = {r["l"]: r["n"] for r in cells.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    if any(x is None or not 1 <= x <= capacity for x in counts):
        raise ValueError("pieces must have lengths from 1 to the capacity")
    plan = spark.createDataFrame(
        runs(bin_completion(counts, capacity)),
        "l bigint, first bigint, last bigint, per bigint, sequence bigint, offset bigint",
    )
    before = F.sum("n").over(Window.partitionBy("l").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select(F.struct("l", "b", F.coalesce(before, F.lit(0)).alias("before")).alias(f"{own}_cell"))
    plan = plan.select(F.struct("*").alias(f"{own}_run"))
    in_cell = Window.partitionBy("length", bucket).orderBy(id_col, "piece")
    ranked = salted.withColumn(own, F.struct(bucket.alias("bucket"), F.row_number().over(in_cell).alias("row")))
    # At most capacity x RANK_BUCKETS offsets and a few thousand runs: both fit any executor.
    cell = {k: F.col(f"{own}_cell.{k}") for k in ("l", "b", "before")}
    ranked = ranked.join(F.broadcast(offsets), (F.col("length") == cell["l"]) & (bucket == cell["b"]))
    rank = cell["before"] + row - 1
    run = {k: F.col(f"{own}_run.{k}") for k in plan.schema[0].dataType.names}
    placed = ranked.join(
        F.broadcast(plan), (F.col("length") == run["l"]) & (rank >= run["first"]) & (rank < run["last"])
    )
    k = rank - run["first"]
    return placed.select(
        *(col(c) for c in pieces.columns if c not in ("sequence_id", "offset")),
        (run["sequence"] + F.floor(k / run["per"])).alias("sequence_id"),
        (run["offset"] + F.pmod(k, run["per"]) * F.col("length")).alias("offset"),
    )


def packed_sequences(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (sequence_id, length, ids, members) per training sequence: the ids themselves, in order.

    ``members`` lists (id, piece, start, length, offset). A sequence holds at most ``capacity`` ids, so a
    group is small. Null texts are empty documents, repeated rows and rows with null ids are packed one by one, other
    columns are ignored, and an empty table gives no rows.
    """
    pieces = settled(document_pieces(docs, tokenizer, capacity, id_col, text_col), "pack-pieces")
    placed = pack(pieces.drop("ids"), capacity, id_col).withColumn("_copy", _copy_of(id_col))
    ids = pieces.select(F.col(id_col).alias("_id"), F.col("piece").alias("_piece"), "ids", _copy_of(id_col).alias("_copy"))
    same = placed[id_col].eqNullSafe(ids["_id"]) & (placed["piece"] == ids["_piece"])
    joined = placed.join(ids.dropDuplicates(["_id", "_piece", "_copy"]), [placed["_copy"] == ids["_copy"], same]).drop(ids["_copy"])
    member = F.struct("offset", id_col, "piece", "start", "length", "ids")
    rows = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(member)).alias("m"))
    return rows.select(
        "sequence_id",
        F.expr("aggregate(m, 0L, (a, x) -> a + x.length)").alias("length"),
        F.expr("aggregate(m, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"),
        F.expr(f"transform(m, x -> named_struct('{id_col}', x.`{id_col}`, 'piece', x.piece, 'start', x.start, 'length', x.length, 'offset', x.offset))").alias("members"),
    )


def _copy_of(id_col: str):
    return F.xxhash64(id_col, "piece", "start", "length")

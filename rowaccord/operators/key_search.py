"""All smallest keys of a table, among all its columns: non-keys prune the search, exact counts confirm it.

Two rows that agree on some columns prove that no group of these columns is a key. A group can be a key only if it has
a column outside each such non-key, so the candidates are the smallest column groups that reach into the complement
of every non-key known. They are tested many at a time on a sample that keeps equal values together: rows whose hash
of the group's columns falls in one of many slots. Two rows that meet there are the next non-keys, and one pair usually
rules out very many groups. What the sample leaves is tested on all rows, several groups per scan.

A non-key is always read off two actual rows, value by value, and a key is confirmed by all rows: where no two hashes
of its values are equal, no two values are. The sample decides nothing but the order of the work. The driver holds
column groups and non-keys, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import chunks, col, require_columns
from .keys import null_counts

# Bounds of the work, not of the result: (row, group) entries and groups of one sample, and groups tested on all rows in one job and
# (row, group) entries of it if that is more than one group: each task holds a map of its entries.
SAMPLE_ENTRIES = 4_000_000
SAMPLE_ROWS = 20_000
GROUPS_PER_SAMPLE = 2_000
GROUPS_PER_COUNT = 20
COUNT_ENTRIES = 20_000_000


def _can_group(t: T.DataType) -> bool:
    """Maps and intervals of calendars have no equality; nor has what holds them."""
    if isinstance(t, T.ArrayType):
        return _can_group(t.elementType)
    if isinstance(t, T.StructType):
        return all(_can_group(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.CalendarIntervalType, T.VariantType))


class NonKeys:
    """Column groups known not to be keys, as bit masks; only the largest ones are kept."""

    def __init__(self, n: int):
        self.all = (1 << n) - 1
        self.missing: list[int] = []  # complements of the largest non-keys, smallest first

    def add(self, mask: int) -> None:
        gap = self.all & ~mask
        if any(m & gap == m for m in self.missing):
            return
        self.missing = sorted([m for m in self.missing if m & gap != gap] + [gap], key=lambda m: (m.bit_count(), m))

    def candidates(self, size: int, columns: int, keys: Sequence[int]) -> Iterator[int]:
        """Groups of ``size`` columns that lie in no non-key and hold no known key.

        Depth first: the columns of the first complement not reached yet are tried in turn, each without those before
        it, so no group comes twice; free places are filled with any later column.
        """

        def grow(group: int, banned: int, left: int) -> Iterator[int]:
            if any(k & group == k for k in keys):
                return
            gap = next((m for m in self.missing if not m & group), None)
            if gap is None and not left:
                yield group
            if not left:
                return
            choice = (self.all if gap is None else gap) & ~banned & ~group
            while choice:
                bit = choice & -choice
                choice ^= bit
                yield from grow(group | bit, banned, left - 1)
                banned |= bit

        if size <= columns:
            yield from grow(0, 0, size)


def _row_hash(names: Sequence[str]) -> Column:
    """A hash of hashes: a hash of the values themselves would pass over nulls, wherever they stand."""
    return F.xxhash64(*[F.xxhash64(col(c)) for c in names])


def _hashed_pairs(df: DataFrame, names: list[str], groups: list[list[int]], slots: int) -> dict[int, list[tuple[int, int]]]:
    """By group: up to two pairs of row hashes that agree on the group's hash, from one slot of its values.

    Equal values have equal hashes, so with a single slot a group without pairs is a key for certain.
    """
    hashes = F.array(*[F.xxhash64(col(c)) for c in names])
    spelled = ", ".join(f"array({', '.join(map(str, g))})" for g in groups)
    entries = F.expr(
        f"transform(array({spelled}), (g, i) -> struct(i AS g, aggregate(g, 7L, (a, c) -> xxhash64(a, _h[c])) AS h))"
    )
    rows = df.select(hashes.alias("_h"), _row_hash(names).alias("_r"))
    rows = rows.select("_r", F.explode(F.filter(entries, lambda e: F.pmod(e["h"], F.lit(slots)) == 0)).alias("e"))
    met = rows.groupBy("e.g", "e.h").agg(F.count("*").alias("n"), F.min("_r").alias("lo"), F.max("_r").alias("hi")).where("n > 1")
    one = F.struct("h", "lo", "hi")
    found = met.groupBy("g").agg(F.min(one).alias("x"), F.max(one).alias("y")).collect()
    return {r.g: sorted({(r.x.lo, r.x.hi), (r.y.lo, r.y.hi)}) for r in found}


def _exact_pairs(df: DataFrame, names: list[str], groups: list[list[int]]) -> dict[int, list[tuple[int, int]]]:
    """By group that is no key: the hashes of two rows that agree on it, on its values themselves."""
    parts = []
    for i, g in enumerate(groups):
        keyed = df.select(*[col(names[c]).alias(f"k{c}") for c in g], _row_hash(names).alias("_r"))
        met = keyed.groupBy(*[f"k{c}" for c in g]).agg(F.count("*").alias("n"), F.min("_r").alias("lo"), F.max("_r").alias("hi"))
        parts.append(met.where("n > 1").select(F.lit(i).alias("g"), "lo", "hi").limit(1))
    return {r.g: [(r.lo, r.hi)] for r in reduce(DataFrame.unionAll, parts).collect()} if parts else {}


def _agreements(df: DataFrame, names: list[str], pairs: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """The columns on which the two rows of each pair agree, as bits; nulls agree with nulls.

    Rows with equal hashes are compared too: one row stands for the smallest, one for the largest of them.
    """
    if not pairs:
        return {}
    spark = df.sparkSession
    numbered = list(enumerate(sorted(pairs)))
    sides = [(r, i, side) for i, pair in numbered for side, r in enumerate(pair)]
    row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = df.select(_row_hash(names).alias("_r"), row.alias("row"))
    rows = rows.join(F.broadcast(spark.createDataFrame(sides, "_r bigint, pair int, side int")), "_r")
    both = rows.groupBy("pair").agg(F.min(F.struct("side", "row")).alias("x"), F.max(F.struct("side", "row")).alias("y"))
    agree = F.concat(*[F.when(F.expr(f"x.row.c{i} <=> y.row.c{i}"), "1").otherwise("0") for i in range(len(names))])
    masks = {r["pair"]: int(r["bits"][::-1], 2) for r in both.select("pair", agree.alias("bits")).collect()}
    return {pair: masks[i] for i, pair in numbered}


def smallest_keys(
    df: DataFrame, columns: Sequence[str] | None = None, max_columns: int = 4, min_columns: int = 1, every: bool = False
) -> DataFrame:
    """Column groups in which all rows differ, no column of which can be left out, over the whole table.

    Columns: ``rank, columns, n_columns, null_rows, null_rate``, best first: fewest columns, then fewest rows with a
    null, then the table's column order. Only groups of the smallest number of columns that gives a key are returned,
    or with ``every`` those of all numbers from ``min_columns`` to ``max_columns``. Null counts as a value like any
    other. Columns whose type has no equality are left out. No rows, repeated rows or no key of that size: no groups.
    """
    names = list(columns) if columns is not None else df.columns
    require_columns(df, names, "key search")
    names = [c for c in names if _can_group(df.schema[c].dataType)]
    # One scan tells the number of rows and which columns hold nulls at all.
    first = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in names]).first()
    spark, total = df.sparkSession, first[0]
    full = {c for c, n in zip(names, first[1:]) if n == total}
    known, keys = NonKeys(len(names)), []
    slots = max(1, total // SAMPLE_ROWS)
    at_once = min(GROUPS_PER_SAMPLE, max(1, SAMPLE_ENTRIES * slots // max(total, 1)))

    def bits(group: int) -> list[int]:
        return [i for i in range(len(names)) if group >> i & 1]

    def tested(found: dict[int, list[tuple[int, int]]], groups: list[int]) -> tuple[list[int], list[int]]:
        """Learn from the pairs found: the groups without a pair, and those whose rows differ on them after all."""
        masks = _agreements(df, names, {p for pairs in found.values() for p in pairs})
        for mask in masks.values():
            known.add(mask)
        unsure = [groups[i] for i, pairs in found.items() if not any(masks[p] & groups[i] == groups[i] for p in pairs)]
        return [g for i, g in enumerate(groups) if i not in found], unsure

    def whole(groups: list[int]) -> list[int]:
        """Those of some groups that are keys of the whole table."""
        keys_of, unsure = tested(_hashed_pairs(df, names, [bits(g) for g in groups], 1), groups)
        if unsure:  # hashes of different values met: the values themselves decide
            pairs = _exact_pairs(df, names, [bits(g) for g in unsure])
            keys_of += tested(pairs, unsure)[0]
            for i in pairs:
                known.add(unsure[i])
        return keys_of

    for size in range(min_columns, max_columns + 1) if total and names else []:
        confirmed: list[int] = []
        while True:
            group_of = (g for g in known.candidates(size, len(names), keys) if g not in confirmed)
            batch = [g for g, _ in zip(group_of, range(at_once))]
            if not batch:
                break
            if slots == 1:
                confirmed += whole(batch)
                continue
            left, unsure = tested(_hashed_pairs(df, names, [bits(g) for g in batch], slots), batch)
            for part in chunks(left + unsure, min(GROUPS_PER_COUNT, max(1, COUNT_ENTRIES // total))):
                # A pair of this batch may have ruled it out already.
                if part := [g for g in part if all(m & g for m in known.missing)]:
                    confirmed += whole(part)
        keys += confirmed
        if keys and not every:
            break

    groups = [tuple(names[i] for i in bits(k)) for k in keys]
    holed = [g for g in groups if not full.issuperset(g)]
    counts = {holed[r.candidate]: r.null_rows for r in null_counts(df, holed).collect()} if holed else {}
    nulls = [counts.get(g, 0) for g in groups]
    order = sorted(range(len(keys)), key=lambda k: (len(groups[k]), nulls[k], bits(keys[k])))
    return spark.createDataFrame(
        [(i + 1, list(groups[k]), len(groups[k]), nulls[k], nulls[k] / total) for i, k in enumerate(order)],
        "rank int, columns array<string>, n_columns int, null_rows bigint, null_rate double",
    )

"""Mixing sources to target weights by weighted fair queueing.

Each source has a target number of words: its share of the budget by weight, at most a number of times its own
size, the excess shared again by weight. Its documents queue in shuffled order, once per repeat; a document's
virtual finish time is the words of its source's queue up to and with it, divided by the source's target. All
queues reach their targets at time one, so the documents in the order of their finish times, cut where the budget
is spent, are the mix. That order also interleaves the sources at any length of the mix.

Running totals (of words along a queue, of words along the mix, of sources by rank) never gather a source, or
anything that grows with the data, in one task: rows are sorted by ranges, written, and the totals of whole ranges,
a few numbers per range, are added to running totals inside each. Texts are read once, for their sizes only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: The weights of the sources in order, repeating; words of the mix by words of all documents; and
#: the most times a document is taken.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2

WORDS = r"[^\x20\x09-\x0D]+"


def running_totals(df: DataFrame, totals: Mapping[str, str], order: Sequence[Column], name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of each column in ``totals`` up to and with the row, in this order.

    ``order`` must tell rows apart where their order matters and begin with ``within``, whose groups each have
    totals of their own; one group may be most of the table. ``totals`` maps new names to columns without nulls.
    """
    parts = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), f"{name}-ranges")
    keys = [*within, "_part"]
    group = [F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)]
    sums = parts.groupBy(*group).agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    # One row per range, and one per group that begins inside a range: what came before it in its group.
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(within))]).orderBy(f"_g{len(within)}").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[f"_g{i}" for i in range(len(keys))], *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals])
    match = F.lit(True)
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = parts.select("*", *[F.sum(c).over(inside).alias(n) for n, c in totals.items()])
    return inner.join(sums, match, "left").select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in totals])


def _weighted(sources: DataFrame, weights: Sequence[float] | Mapping[str, float]) -> DataFrame:
    """``source, source_size, weight`` of each source, null last in the order."""
    if isinstance(weights, Mapping):
        known = F.create_map(*[F.lit(x) for x in chain(*((k, float(w)) for k, w in weights.items()))]) if weights else None
        weight = F.lit(0.0) if known is None else F.coalesce(F.try_element_at(known, F.col("source")), F.lit(0.0))
        return sources.withColumn("weight", weight)
    ranked = running_totals(sources.withColumn("_one", F.lit(1).cast("bigint")), {"rank": "_one"}, [F.asc_nulls_last("source")], "mix-sources")
    in_turn = F.array(*[F.lit(float(w)) for w in weights])
    return ranked.select("source", "source_size", F.get(in_turn, F.pmod(F.col("rank") - 1, F.lit(len(weights)))).alias("weight"))


def targets(sources: DataFrame, weights: Sequence[float] | Mapping[str, float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``, one row per source.

    A target is min(repeats x size, level x weight) with the one level at which the targets add up to the budget,
    ``share`` times all sizes. Sharing the excess again until none is above its bound ends there. With the sources
    sorted by the level at which they reach their bound, that level is the greatest that any first sources leave to
    the others: no loop, and no source goes to the driver.
    """
    rows = settled(_weighted(sources, weights), "mix-weights")
    # Where a source has no weight its bound is never reached; it gets nothing.
    full = rows.withColumn("bound", F.col("source_size") * repeats).withColumn(
        "full_at", F.when(F.col("weight") > 0, F.col("bound") / F.col("weight")).otherwise(F.lit(float("inf")))
    )
    order = [F.asc("full_at"), F.asc_nulls_last("source")]
    sums = running_totals(full, {"bounds": "bound", "weights": "weight"}, order, "mix-levels")
    whole = full.agg(F.sum("weight").alias("all_weights"), (F.sum("source_size") * F.lit(float(share))).alias("budget"))
    # Both are one row.
    left = F.when(F.col("all_weights") > F.col("weights"), (F.col("budget") - F.col("bounds")) / (F.col("all_weights") - F.col("weights")))
    none_full = F.when(F.col("all_weights") > 0, F.col("budget") / F.col("all_weights"))
    level = sums.join(F.broadcast(whole)).agg(F.greatest(F.max(none_full), F.max(left), F.lit(0.0)).alias("level"))
    target = F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight"))
    return full.join(F.broadcast(level)).select("source", "source_size", "weight", target.alias("target"))


def mixture_plan(
    docs: DataFrame,
    weights: Sequence[float] | Mapping[str, float] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Which documents the mix takes, one row per document and repeat that it could take.

    Columns: the id under its own name, ``source, size, source_size, target, repeat`` (from 0), ``finish`` (virtual
    time; null where the source has no target or the document no words), ``row`` (tells rows of this plan apart) and
    ``taken`` (boolean). Documents are taken whole; the one that the budget ends in is taken if more than half of it fits.

    ``weights`` are given by source, or in turn to the sources in the order of their code points, null last.
    The order of a source's queue comes from a hash of seed and id, so reruns agree; repeated rows of one id are
    documents of their own, and which of several equal ones comes first does not show in any column but ``row``. Null
    texts have no words, null ids are hashed as an empty text, a null source is a source. Other columns are not read.
    """
    size = F.regexp_count(F.coalesce(docs[text_col].cast("string"), F.lit("")), F.lit(WORDS)).cast("bigint")
    place = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("")))), 1, 16)
    sizes = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), size.alias("size"), place.alias("place"))
    sizes = settled(sizes.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = settled(targets(sources, weights, share, repeats), "mix-targets")

    order = [F.asc_nulls_last("source"), F.col("place"), F.asc_nulls_last("id"), F.col("size"), F.col("row")]
    queued = running_totals(sizes, {"served": "size"}, order, "mix-queues", ["source"])
    # One row per source: a broadcast where Spark finds it small, else a join that AQE splits at the hot source.
    joined = queued.join(wanted.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    turns = joined.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    served = F.col("repeat") * F.col("source_size") + F.col("served")
    finish = F.when((F.col("target") > 0) & (F.col("size") > 0), served / F.col("target"))
    turns = turns.select("id", "source", "size", "source_size", "target", "repeat", finish.alias("finish"), "place", "row")

    in_mix = [F.asc_nulls_last("finish"), *order[:1], F.col("repeat"), *order[1:]]
    words = turns.withColumn("words", F.when(F.col("finish").isNotNull(), F.col("size")).otherwise(F.lit(0)))
    mix = running_totals(words, {"until": "words"}, in_mix, "mix-order")
    budget = sizes.agg((F.sum("size") * F.lit(float(share))).alias("budget"))  # one row
    taken = F.col("finish").isNotNull() & (F.col("until") - F.col("words") / 2 < F.col("budget"))
    return mix.join(F.broadcast(budget)).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "repeat", "finish", "row", taken.alias("taken")
    )


def words_taken(plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, size, source_size, target, taken`` of each document of a plan: its words in the mix, repeats counted."""
    taken = F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0))
    keys = [id_col, "source", "size", "source_size", "target"]
    return plan.groupBy(*keys, "row").agg(taken.alias("taken")).select(id_col, "size", "source_size", "target", "taken")

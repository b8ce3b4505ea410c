"""Helpers shared by the operators: settled tables, batches of texts, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowaccord.functions.storage import written


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Later jobs neither repeat the work nor depend on the disks of executors that may be lost.
    """
    return written(df, f"llm-{name}")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own: other columns cannot clash."""
    return df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` begins with."""
    name = f"_{name}"
    while any(c.lower().startswith(name) for c in df.columns):
        name = f"_{name}"
    return name


def by_batch(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """Apply ``f`` to the columns of each Arrow batch of ``df``; it returns the columns of ``schema``.

    Spark bounds a batch by rows and bytes, so memory does not depend on the size of a partition.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True)))
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out.values(), types, strict=True)],
                    names=names,
                )

    names, types = _arrow(schema)
    return df.mapInArrow(run, schema)


ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def _arrow(schema: str) -> tuple[list[str], list[pa.DataType]]:
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    return [n for n, _ in fields], [ARROW[t.strip()] for _, t in fields]


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus, F.lit(0))


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Connected components of the edges ``a``-``b`` as (node, root): root is the least node reached.

    Large-star and small-star rounds: edges move towards least nodes until they form stars, which
    takes a number of rounds that grows with the logarithm of a component's size. The least
    neighbours are pre-aggregated before the shuffle, and no component is gathered in a task.
    Nodes without edges are not returned; null ends are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = settled(e, f"{name}-edges")
    before = None
    while not e.isEmpty():
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Every neighbour above u now hangs on the least of u and its neighbours.
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        # The lower neighbours of u, and u itself, hang on the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        e = settled(e.where("u > v").distinct(), f"{name}-edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

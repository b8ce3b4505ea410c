"""Benchmark decontamination with DataFrame operations only.

Every window of consecutive words of the benchmark items is known by a hash. The training texts are scanned word by
word; a place whose window hash is known is verified word by word, and overlapping hits are merged. The set of
windows is broadcast while it is small enough; a larger one is joined by a shuffle of hashes instead, which gives the
same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowaccord.functions.names import col

from .common import free_name, settled

WINDOW = 10
#: Windows that may be broadcast: 500,000 rows of ten words are about 100 MB.
BROADCAST_WINDOWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything in ASCII but digits and letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case; null has none."""
    parts = F.split(F.translate(text, UPPER, LOWER), SEPARATORS)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, win, size): the windows of each item, distinct. An item of fewer words is one window, an empty one has none."""
    w = items.select(items[id_col].alias("item"), words(items[text_col].cast("string")).alias("ws")).where(F.size("ws") > 0)
    n = F.size("ws")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    rows = w.select("item", "ws", F.explode(starts).alias("p"))
    return rows.select("item", F.slice("ws", F.col("p"), window).alias("win")).distinct().withColumn("size", F.size("win"))


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(rid, p, win_id, size) for every place p of a document where a window begins.

    ``windows`` has distinct (win_id, win, size). The hash is compared first, then the words themselves.
    """
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most WINDOW numbers
    known = windows.select("win_id", "win", "size", F.xxhash64("win").alias("h"))
    if windows.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    placed = docs.select("rid", "ws", F.posexplode("ws").alias("p", "_w"))
    parts = []
    for size in sorted(sizes):
        here = F.slice("ws", F.col("p") + 1, size)
        rows = placed.where(F.col("p") + size <= F.size("ws")).select("rid", "p", here.alias("here"), F.xxhash64(here).alias("h"))
        same = (rows["h"] == known["h"]) & (rows["here"] == known["win"])
        parts.append(rows.join(known, same).select("rid", "p", "win_id", "size"))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _row_key(id_col: Column, text: Column) -> Column:
    """Equal rows share their key, and with it their result; null ids are allowed."""
    return F.struct(id_col.alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _scan(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text: str):
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("doc"), _row_key(docs[id_col], text).alias("rid"), words(text).alias("ws"))
    found = settled(benchmark_windows(items, window, item_col, item_text), "leak-windows")
    distinct = found.select("win", "size").distinct()
    ids = F.concat(F.hex(F.xxhash64("win")), F.hex(F.xxhash64(F.lit(1), "win")))
    windows = settled(distinct.withColumn("win_id", ids), "leak-set")
    if windows.isEmpty():
        hits = docs.sparkSession.createDataFrame([], rows.select("rid").schema).selectExpr(
            "rid", "0 as p", "'' as win_id", "0 as size"
        )
    else:
        # Repeated rows have equal hits: those are kept once.
        hits = settled(_hits(rows, windows).distinct(), "leak-hits")
    by_item = found.join(windows, ["win", "size"]).select("win_id", "item")
    return rows, hits, by_item


def spans(hits: DataFrame) -> DataFrame:
    """(rid, first, end) of the merged runs of hit words, counted in words from 0."""
    w = Window.partitionBy("rid").orderBy("p", "size")
    reach = F.max(F.col("p") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("p")).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(w))
    return runs.groupBy("rid", "run").agg(F.min("p").alias("first"), F.max(F.col("p") + F.col("size")).alias("end")).drop("run")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row (id, n_words, n_hit, item_ids, spans, contaminated) per document.

    A word is hit where it lies inside an occurrence of a window of any item; ``item_ids`` are the items with
    occurring windows as strings in order, ``spans`` the merged runs of hit words as (first, end). Null texts have no
    words. Repeated rows get equal results, null ids are kept, null item ids count as hits but are not listed. Without
    items or documents nothing is hit. Other columns are ignored.
    """
    rows, hits, by_item = _scan(docs, items, window, id_col, text_col, item_col, item_text)
    run = F.sort_array(F.collect_list(F.struct("first", "end")))
    per_row = spans(hits).groupBy("rid").agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), run.alias("spans"))
    named = hits.select("rid", "win_id").distinct().join(by_item, "win_id").select("rid", F.col("item").cast("string").alias("item"))
    per_item = named.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    counts = rows.select("doc", "rid", F.size("ws").cast("bigint").alias("n_words"))
    out = counts.join(per_row.join(per_item, "rid", "left").withColumnRenamed("rid", "_rid"), F.col("rid").eqNullSafe(F.col("_rid")), "left")
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>")).alias("spans"),
        F.col("_rid").isNotNull().alias("contaminated"),
    )


def remove_spans(
    docs: DataFrame,
    items: DataFrame,
    least_share: float = 0.5,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` without benchmark passages, all columns kept.

    Where the hit words are at least ``least_share`` of a document's words the document goes; otherwise each run of
    hit words is cut out of its text, with the separators inside the run, and the words around it stay. Documents
    without hits are unchanged, byte by byte: null and empty texts too. Repeated rows have equal results, rows with null
    ids are treated alike, columns of any other name stay as they are. Without items nothing changes.
    """
    _, hits, _ = _scan(docs, items, window, id_col, text_col, item_col, item_text)
    own = free_name(docs, "leak")
    runs = F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs")
    cut = spans(hits).groupBy("rid").agg(runs, F.sum(F.col("end") - F.col("first")).alias("n"))
    cut = cut.select(F.struct("rid", "runs", "n").alias(f"{own}_cut"))
    body = docs[text_col].cast("string")
    marked = docs.withColumn(own, _row_key(docs[id_col], body))
    marked = marked.join(cut, F.col(own).eqNullSafe(F.col(f"{own}_cut.rid")), "left")
    # Words and separators of a hit text in turns: the k-th word with the separators that follow it.
    body, cuts = col(text_col).cast("string"), F.col(f"{own}_cut.runs")
    pieces = F.regexp_extract_all(body, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), 1)
    kept = F.filter(pieces, lambda _, i: ~F.exists(cuts, lambda r: (i >= r["first"]) & (i < r["end"])))
    cleaned = F.concat(F.regexp_extract(body, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0), F.array_join(kept, ""))
    keep = cuts.isNull() | (F.col(f"{own}_cut.n") < least_share * F.size(pieces))
    new = F.when(cuts.isNull(), col(text_col)).otherwise(cleaned)
    return marked.where(keep).withColumn(text_col, new).select(*(col(c) for c in docs.columns))

"""Delimited text: encoding, delimiter, types."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..functions.names import chunks, lit, quote, require_distinct_names

# Delimiters looked for, in order of preference.
DELIMITERS = (",", "\t", "|", ";")

# Encoding names found, the reader's name for each, and how sure the finding is.
READER_ENCODINGS = {
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "utf-16-le": "UTF-16LE",
    "utf-16-be": "UTF-16BE",
    "latin-1": "ISO-8859-1",
    "cp1252": "windows-1252",
}

# Never occurs in files, so the reader keeps "" apart from an empty cell.
_NO_NULL_TEXT = "\u0001"

COLUMNS_PER_SCAN = 40


def detect_encoding(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``encoding, confidence, has_bom``, from every line of the files.

    A byte order mark at the start of a file decides; then UTF-8 if all lines are valid UTF-8. Other bytes are
    taken for windows-1252 when bytes 80–9F occur, which are control characters in
    ISO-8859-1, and for ISO-8859-1 otherwise.
    """
    # Lines come as raw bytes, whatever the encoding.
    bytes_ = "CAST(value AS BINARY)"
    lines = spark.read.text(path).selectExpr("value", f"decode({bytes_}, 'ISO-8859-1') AS latin")
    found = lines.groupBy().agg(
        F.coalesce(F.bool_and(F.expr("is_valid_utf8(value)")), F.lit(True)).alias("utf8"),
        F.coalesce(F.bool_or(F.expr("latin RLIKE '[\\u0080-\\u009F]'")), F.lit(False)).alias("c1"),
    )
    # The text reader drops marks and lines may begin with the same bytes, so they come from the files themselves.
    mark = _mark(spark, path)
    if mark:
        return found.select(F.lit(mark).alias("encoding"), F.lit(1.0).alias("confidence"), F.lit(True).alias("has_bom"))
    encoding = F.when(F.col("utf8"), "utf-8").when(F.col("c1"), "cp1252").otherwise("latin-1")
    confidence = F.when(F.col("utf8"), 0.99).otherwise(0.5)
    return found.select(encoding.alias("encoding"), confidence.alias("confidence"), F.lit(False).alias("has_bom"))


# The byte order marks.
MARKS = {b"\xef\xbb\xbf": "utf-8-sig", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}


def _mark(spark: SparkSession, path: str) -> str | None:
    """The encoding that the first bytes of some file below a path name; reads three bytes of each until one does."""
    conf = spark._jsc.hadoopConfiguration()

    def marked(file: str) -> str | None:
        target = spark._jvm.org.apache.hadoop.fs.Path(file)
        stream = target.getFileSystem(conf).open(target)
        try:
            start = bytes(b for b in (stream.read() for _ in range(3)) if b >= 0)
        finally:
            stream.close()
        return next((name for mark, name in MARKS.items() if start.startswith(mark)), None)

    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        names = (name for part in chunks(files, 256) for name in pool.map(marked, part))
        return next(filter(None, names), None)


def _reader_encoding(spark: SparkSession, encoding: str) -> str:
    """The reader's name of an encoding; windows-1252 has to be allowed in the session first."""
    if encoding == "cp1252":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return READER_ENCODINGS[encoding]


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Whole lines as ``value``, decoded: a CSV scan with a separator that no file has."""
    reader = spark.read.schema("value string").option("sep", _NO_NULL_TEXT).option("quote", "")
    reader = reader.option("encoding", _reader_encoding(spark, encoding))
    return reader.option("multiLine", encoding.startswith("utf-16")).csv(path)


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """The delimiter that most lines have equally often, and often, over all lines; a comma if none occurs.

    A count per line scores its square share of the lines times itself, so that lines before the table and signs within
    texts weigh little. Quoted cells are not looked into.
    """
    bare = F.regexp_replace("value", '"[^"]*"', "")
    per_line = [(F.char_length("bare") - F.char_length(F.translate("bare", d, ""))).alias(f"n{i}") for i, d in enumerate(DELIMITERS)]
    lines = _lines(spark, path, encoding).where("value <> ''").select(bare.alias("bare")).select(*per_line)
    # Lines with equal counts collapse before the shuffle.
    counts = lines.groupBy(*lines.columns).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"n{i}").alias("per")) for i in range(len(DELIMITERS))])
    sizes = counts.select("n", F.inline(each)).groupBy("i", "per").agg(F.sum("n").alias("n"))
    found = sizes.groupBy("i").agg(F.max(F.col("per") * F.col("n") * F.col("n").cast("double")).alias("score"))
    best = max(found.collect(), key=lambda r: (r["score"], -r["i"]), default=None)
    return DELIMITERS[best["i"]] if best is not None and best["score"] > 0 else DELIMITERS[0]


def has_quoted_newlines(spark: SparkSession, path: str, sep: str, encoding: str = "utf-8") -> bool:
    """Whether some cell runs over a line end: a line with a quoted cell that it does not close."""
    quotes = "char_length(value) - char_length(translate(value, '\"', ''))"
    opens = f"(startswith(value, '\"') OR contains(value, concat({lit(sep)}, '\"')))"
    lines = _lines(spark, path, encoding)
    found = lines.groupBy().agg(F.expr(f"coalesce(bool_or({opens} AND ({quotes}) % 2 = 1), false)").alias("found"))
    return found.first()["found"]


def read_text_table(
    spark: SparkSession, path: str, sep: str, encoding: str, quoted_newlines: bool = False
) -> DataFrame:
    """Delimited files with a header, all columns as text.

    An empty cell is null and ``""`` an empty text; short rows are padded with nulls. Files
    in UTF-16 and files with line ends inside cells cannot be split, so that each is read by
    one task; all others are read in splits.
    """
    options = {
        "header": True,
        "sep": sep,
        "encoding": _reader_encoding(spark, encoding),
        "nullValue": _NO_NULL_TEXT,
        "escape": '"',
        "multiLine": quoted_newlines or encoding.startswith("utf-16"),
        "mode": "PERMISSIVE",
    }
    return spark.read.options(**options).csv(path)


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str | None = None,
    typed: bool = True,
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """Read delimited text; what is not given is detected from the files."""
    encoding = encoding or detect_encoding(spark, path).first()["encoding"]
    if encoding not in READER_ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}; use one of {sorted(READER_ENCODINGS)}")
    sep = sep or detect_delimiter(spark, path, encoding)
    if quoted_newlines is None:
        quoted_newlines = has_quoted_newlines(spark, path, sep, encoding)
    table = read_text_table(spark, path, sep, encoding, quoted_newlines)
    return infer_types(table) if typed else table


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Type text columns from all their values: bigint, double, boolean, else text.

    A column gets a type only if every present value reads as it. Numbers that a type would show otherwise stay text,
    so that codes such as ``00501`` are kept: no value of the column may begin with ``+`` or with a zero before another
    digit. Dates stay text. One counting job decides; the casts are lazy.
    """
    require_distinct_names(df)
    names = [f.name for f in df.schema.fields if text.is_text(f.dataType)]
    if columns is not None:
        names = [n for n in names if n in set(columns)]
    types: dict[str, str] = {}
    for part in chunks(names, COLUMNS_PER_SCAN):
        aggs = []
        for i, n in enumerate(part):
            c = quote(n)
            aggs += [
                f"count({c}) AS n{i}",
                f"count_if({parsing.is_integer(c)}) AS i{i}",
                f"count_if({parsing.is_float(c)}) AS f{i}",
                f"count_if({parsing.is_boolean(c)}) AS b{i}",
                f"count_if({c} RLIKE '^\\\\s*([+]|-?0[0-9])') AS z{i}",
            ]
        row = df.groupBy().agg(*[F.expr(a) for a in aggs]).first()
        for i, n in enumerate(part):
            present = row[f"n{i}"]
            for counter, dtype in (("i", "bigint"), ("f", "double"), ("b", "boolean")):
                if present and row[f"{counter}{i}"] == present and (counter == "b" or not row[f"z{i}"]):
                    types[n] = dtype
                    break
    return df.selectExpr(
        *[f"try_cast({quote(c)} AS {types[c]}) AS {quote(c)}" if c in types else quote(c) for c in df.columns]
    )


def table_metadata(df: DataFrame, count: bool = True) -> DataFrame:
    """``position, name, dtype`` per column, with ``row_count`` of the table unless ``count=False``."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    columns = df.sparkSession.createDataFrame(rows, "position int, name string, dtype string")
    if not count:
        return columns
    # A one-row table next to each column.
    rows = df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).withColumn("_one", F.lit(1))
    return columns.withColumn("_one", F.lit(1)).join(F.broadcast(rows), "_one").drop("_one")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``path, size_bytes`` per file, from the listing; no content is read."""
    return spark.read.format("binaryFile").load(path).selectExpr("path", "length AS size_bytes")

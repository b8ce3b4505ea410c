"""Exports: summaries, JSON, tables on disk, and the log of runs."""

from __future__ import annotations

import copy
import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.names import lit, quote
from ..operators.checks import check_summary
from ..operators.diff import Diff
from .compare import Comparison

JSON_SAMPLE_ROWS = 100

STEP_COLUMNS = "step string, request string, finished_at timestamp"
MANIFEST_COLUMNS = "position int, table string, format string, rows bigint, columns array<string>"

RUN_COLUMNS = (
    "job_id string, run_type string, table1 string, table2 string, started_at timestamp, "
    "duration_s double, status string, summary string, deleted boolean, logged_at timestamp"
)


def diff_summary(diff: Diff, name_1: str = "table 1", name_2: str = "table 2") -> DataFrame:
    """The summary as ``position, field, value`` rows."""
    fields = {
        "Table 1": lit(name_1),
        "Table 2": lit(name_2),
        "Table 1 rows": "total_rows_f1",
        "Table 2 rows": "total_rows_f2",
        "Added rows": "added_rows",
        "Removed rows": "removed_rows",
        "Modified rows": "modified_rows",
        "Formatting-only rows": "formatting_only_rows",
        "Key columns": lit(", ".join(diff.spec.keys)),
    }
    entries = ", ".join(
        f"named_struct('position', {i}, 'field', {lit(k)}, 'value', CAST({v} AS STRING))"
        for i, (k, v) in enumerate(fields.items())
    )
    return diff.counts().select(F.expr(f"inline(array({entries}))"))


def _column_diffs() -> str:
    """Statistics array as a map by column name, rates with four digits."""
    return (
        "map_from_entries(transform(column_stats, s -> struct(s.column, named_struct("
        "'modified', s.modified, 'formatting_only', s.formatting_only, 'null_introduced', s.null_introduced, "
        "'null_resolved', s.null_resolved, 'change_rate', round(s.change_rate, 4)))))"
    )


def diff_json(diff: Diff, sample_rows: int = JSON_SAMPLE_ROWS) -> DataFrame:
    """One row with one column ``json``: summary, column differences and the first sample rows."""
    place = ", ".join(["-severity", *(quote(k) for k in diff.spec.keys), "change_type"])
    sample = (
        diff.sample(sample_rows)
        .selectExpr(
            f"struct({place}) AS place",
            "named_struct('key', key, 'change_type', change_type, 'columns_changed', columns_changed, "
            "'f1', f1, 'f2', f2, 'join_rows', join_rows) AS row",
        )
        .groupBy()
        .agg(F.collect_list(F.struct("place", "row")).alias("entries"))
        .selectExpr(
            "transform(array_sort(entries, (x, y) -> CASE WHEN x.place < y.place THEN -1 "
            "WHEN x.place > y.place THEN 1 ELSE 0 END), e -> e.row) AS sample_rows"
        )
    )
    keys = ", ".join(lit(k) for k in diff.spec.keys)
    summary = (
        "named_struct('added', added_rows, 'removed', removed_rows, 'modified', modified_rows, "
        "'formatting_only', formatting_only_rows, 'total_f1', total_rows_f1, 'total_f2', total_rows_f2, "
        f"'rows_scanned', rows_scanned, 'is_full_count', is_full_count, "
        f"'confidence_score', round(confidence_score, 3), 'key_columns', array({keys}))"
    )
    # Two one-row tables side by side.
    one = diff.statistics().withColumn("_one", F.lit(1))
    return one.join(F.broadcast(sample.withColumn("_one", F.lit(1))), "_one").selectExpr(
        f"to_json(named_struct('summary', {summary}, 'column_diffs', {_column_diffs()}, "
        "'sample_rows', sample_rows)) AS json"
    )


def _json_rows(df: DataFrame, column: str) -> DataFrame:
    """A table of a few rows per column or check, as one JSON array in one row, by position where it has one."""
    place = F.col("position") if "position" in df.columns else F.lit(0)
    rows = df.select(F.struct(place.alias("place"), F.to_json(F.struct("*")).alias("r")).alias("x"))
    rows = rows.groupBy().agg(F.array_sort(F.collect_list("x")).alias("rows"))
    return rows.select(F.concat(F.lit("["), F.array_join("rows.r", ","), F.lit("]")).alias(column))


def report_json(c: Comparison) -> DataFrame:
    """``part, json``: the schema comparison, its score, the checks and the profiles of a comparison.

    These parts have one row per column or check; rows of the tables are in :func:`write_report`.
    """
    parts = {
        "schema": c.schemas(),
        "score": c.score().withColumn("score", F.round("score", 1)),
        "checks": c.checks(),
        "profile_1": _rounded(c.profiles[0]),
        "profile_2": _rounded(c.profiles[1]),
        "column_diffs": c.column_stats().withColumn("change_rate", F.round("change_rate", 4)),
    }
    frames = [_json_rows(df, "json").select(F.lit(name).alias("part"), "json") for name, df in parts.items()]
    result = frames[0]
    for f in frames[1:]:
        result = result.unionAll(f)
    return result


def _rounded(profile: DataFrame) -> DataFrame:
    return profile.withColumn("null_variant_rate", F.round("null_variant_rate", 4))


REPORT_TABLES: dict[str, Callable[[Comparison], DataFrame]] = {
    "key": lambda c: c.key_report(),
    "counts": lambda c: c.counts(),
    "column_stats": lambda c: c.column_stats(),
    "summary": lambda c: diff_summary(c.diff),
    "schema": lambda c: c.schemas(),
    "renames": lambda c: c.renames(),
    "score": lambda c: c.score(),
    "profile_1": lambda c: c.profiles[0],
    "profile_2": lambda c: c.profiles[1],
    "checks": lambda c: c.checks(),
    "check_summary": lambda c: c.check_summary(),
    "multiplicity": lambda c: c.multiplicity(),
    "contents": lambda c: c.contents(),
    "sample": lambda c: c.sample(),
    "before_after": lambda c: c.diff.before_after(),
    "json": lambda c: diff_json(c.diff),
}


def report_tables(c: Comparison) -> dict[str, DataFrame]:
    """Every table of a comparison's report by name."""
    return {name: make(c) for name, make in REPORT_TABLES.items()}


# Blanks around a value are part of it: they may be the very change.
CSV_OPTIONS = {
    "header": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_changes(diff: Diff, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write all changed rows, in parallel, as a folder of files: keys, type, values 1, values 2."""
    changes = diff.changes().drop("changed", "changed_raw") if fmt == "csv" else diff.changes()
    options = CSV_OPTIONS if fmt == "csv" else {}
    changes.write.mode(mode).options(**options).format(fmt).save(path)


def write_report(c: Comparison, folder: str, run_id: str | None = None, resume: bool = False) -> str:
    """Write all tables of the report below ``folder/run_id=…`` and return that path.

    The join runs once: changed rows are stored first and every other table of the comparison is made from them; the
    checks read the stored profiles. Each finished table is noted in ``steps``, and ``manifest``, which lists all tables,
    is written last, so a report without it is unfinished (see :func:`read_report`).

    An existing run is never overwritten. With ``resume`` an unfinished one goes on: noted tables stay as they are and
    what a broken write left of the others is replaced; a finished one stays untouched. The comparison must be the same
    (keys, rules, columns, row counts); another one is refused. One writer at a time may work on a run.
    """
    spark = c.df1.sparkSession
    base = f"{folder.rstrip('/')}/run_id={run_id or uuid.uuid4().hex}"
    request = _request(c)
    noted = _rows(spark, f"{base}/steps", STEP_COLUMNS)
    if noted and not resume:
        raise FileExistsError(f"{base} already exists; resume=True goes on where it is unfinished")
    if any(s.request != request for s in noted):
        raise ValueError(f"{base} was started for another comparison")
    if _rows(spark, f"{base}/manifest", MANIFEST_COLUMNS):
        return base
    done = {s.step for s in noted}
    mode = "overwrite" if noted else "errorifexists"

    def step(name: str, write: Callable[[], object] = lambda: None) -> None:
        if name not in done:
            write()
            note = spark.range(1).select(F.lit(name).alias("step"), F.lit(request).alias("request"), F.current_timestamp().alias("finished_at"))
            note.write.mode("append").parquet(f"{base}/steps")

    step("start")
    step("join", lambda: c.diff.stored(f"{base}/join", mode))
    stored = copy.copy(c)
    stored.diff = c.diff.read_stored(f"{base}/join")
    step("changes", lambda: write_changes(stored.diff, f"{base}/changes", mode=mode))
    ready: dict[str, DataFrame] = {}
    for name, make in REPORT_TABLES.items():
        if name == "checks":
            table = lambda: c.checks((ready["profile_1"], ready["profile_2"]))
        elif name == "check_summary":
            table = lambda: check_summary(ready["checks"])
        else:
            table = lambda make=make: make(stored)
        step(name, lambda: table().write.mode(mode).parquet(f"{base}/{name}"))
        ready[name] = spark.read.parquet(f"{base}/{name}")
    ready["join"] = stored.diff._stored
    rows = _count_each(ready)
    listed = [(i, n, "parquet", rows[n], ready[n].columns) for i, n in enumerate(ready)]
    listed.append((len(ready), "changes", "csv", rows["join"], spark.read.options(**CSV_OPTIONS).csv(f"{base}/changes").columns))
    spark.createDataFrame(listed, MANIFEST_COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest")
    return base


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a finished report by name, ``manifest`` included; an unfinished one is refused."""
    listed = _rows(spark, f"{path.rstrip('/')}/manifest", MANIFEST_COLUMNS)
    if not listed:
        raise FileNotFoundError(f"{path} holds no finished report")
    tables = {}
    for r in sorted(listed, key=lambda r: r.position):
        options = CSV_OPTIONS if r.format == "csv" else {}
        tables[r.table] = spark.read.options(**options).format(r.format).load(f"{path.rstrip('/')}/{r.table}")
    tables["manifest"] = spark.read.schema(MANIFEST_COLUMNS).parquet(f"{path.rstrip('/')}/manifest")
    return tables


def _request(c: Comparison) -> str:
    """What a comparison asks and what its key scan counted, as text."""
    schemas = [df.schema.simpleString() for df in (c.df1, c.df2)]
    fields = {"keys": c.keys, "rules": asdict(c.spec.rules), "columns": [x.name for x in c.diff.columns], "tables": schemas}
    return json.dumps({**fields, "preview": c.spec.preview, "counted": asdict(c.diff.check)}, sort_keys=True, default=str)


def _rows(spark: SparkSession, path: str, columns: str) -> list[Row]:
    """A small table's rows; none where it does not exist."""
    try:
        return spark.read.schema(columns).parquet(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _count_each(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of each written table, from the files' footers, in one job."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionAll(one)
    return {r["table"]: r["rows"] for r in counts.collect()}


# ---- run log ------------------------------------------------------------------------------


def append_run(
    spark: SparkSession,
    path: str,
    job_id: str,
    run_type: str,
    table1: str,
    table2: str,
    duration_s: float,
    status: str,
    summary: Mapping | None = None,
    started_at: float | None = None,
    deleted: bool = False,
) -> None:
    """Append one run to the log; the entry that is written last replaces earlier ones with the same id."""
    started = started_at if started_at is not None else time.time()
    values = [
        (job_id, run_type, table1, table2, started, round(duration_s, 2), status, dict(summary or {}), deleted, time.time())
    ]
    schema = (
        "job_id string, run_type string, table1 string, table2 string, started double, duration_s double, "
        "status string, summary map<string,string>, deleted boolean, logged double"
    )
    texts = [(*v[:7], {k: str(x) for k, x in v[7].items()}, *v[8:]) for v in values]
    row = spark.createDataFrame(texts, schema)
    row.selectExpr(
        "job_id", "run_type", "table1", "table2", "timestamp_micros(bigint(started * 1000000)) AS started_at",
        "duration_s", "status", "to_json(summary) AS summary", "deleted",
        "timestamp_micros(bigint(logged * 1000000)) AS logged_at",
    ).write.mode("append").parquet(path)


def current_runs(log: DataFrame) -> DataFrame:
    """The entry of each run id that was written last, deleted ones left out.

    Logs without ``logged_at`` fall back to the start of the run.
    """
    fields = [c for c in log.columns if c not in ("job_id", "logged_at")]
    order = [c for c in ("logged_at", "started_at", "deleted") if c in log.columns]
    newest = F.max_by(F.struct(*fields), F.struct(*order)).alias("r")
    return log.groupBy("job_id").agg(newest).select("job_id", "r.*").where(~F.col("deleted")).drop("deleted")


def latest_runs(log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs first."""
    return current_runs(log).orderBy(F.desc("started_at"), "job_id").limit(limit)


def get_run(log: DataFrame, job_id: str) -> DataFrame:
    return current_runs(log.where(F.col("job_id") == job_id))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_COLUMNS).parquet(path)


def delete_run(spark: SparkSession, path: str, job_id: str) -> None:
    """Mark a run as deleted by appending a later entry."""
    append_run(spark, path, job_id, "", "", "", 0.0, "deleted", deleted=True)


def clear_runs(spark: SparkSession, path: str) -> None:
    """Mark every current run as deleted, in one write."""
    runs = current_runs(read_runs(spark, path))
    marks = runs.select(
        "job_id", "run_type", "table1", "table2",
        F.current_timestamp().alias("started_at"), "duration_s", F.lit("deleted").alias("status"), "summary",
        F.lit(True).alias("deleted"), F.current_timestamp().alias("logged_at"),
    )
    marks.write.mode("append").parquet(path)

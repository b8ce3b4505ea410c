from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("rowaccord-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def depot(spark):
    """Two snapshots of a depot's stock, made by arithmetic, that differ in every way a diff knows.

    Table 2 swaps two columns, holds grams as a float, repeats key 16, lacks keys 4 and 11 and has 31 to 33.
    """
    before = [
        (i, f"bolt {i}", f"bay {i % 5}", ("steel", "brass", "zinc")[i % 3], 40 * i + 7, f"2019-{1 + i % 12:02}-{3 + i:02}")
        for i in range(1, 17)
    ]
    after = {i: {"label": a, "place": b, "kind": c, "grams": float(g), "checked": d} for i, a, b, c, g, d in before}
    del after[4], after[11]
    after[2]["label"] = "BOLT 2"
    after[5]["place"] = " bay 0 "
    after[6]["checked"] = "07/09/2019"  # another layout of the same date
    after[7]["grams"] = None
    after[8]["grams"] += 1
    after[9]["kind"] = "lead"
    after |= {i: {"label": f"nut {i}", "place": "bay 9", "kind": "tin", "grams": 5.0, "checked": "2020-02-02"} for i in (31, 32, 33)}
    order = ("place", "label", "kind", "grams", "checked")
    rows = [(i, *[r[c] for c in order]) for i, r in [*after.items(), (16, after[16])]]
    one = spark.createDataFrame(before, "id bigint, label string, place string, kind string, grams bigint, checked string")
    two = spark.createDataFrame(rows, "id bigint, place string, label string, kind string, grams double, checked string")
    return one, two


def only(df):
    """The single row of a DataFrame as a dict."""
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}

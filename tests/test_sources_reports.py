from __future__ import annotations

import csv
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import rowaccord as ra
from rowaccord.plans import report
from rowaccord.sources.delimited import detect_delimiter, file_sizes, has_quoted_newlines
from rowaccord.sources.workbooks import file_types
from tests.conftest import by, only


def put(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize(
    ("data", "encoding", "bom"),
    [
        (b"nr,fruit\n8,plum\n9,fig\n", "utf-8", False),
        ("nr,fruit\n8,açaí\n".encode(), "utf-8", False),
        (b"\xef\xbb\xbfnr\n8\n", "utf-8-sig", True),
        ("nr,dish\n8,p\xe2t\xe9\n".encode("latin-1"), "latin-1", False),
        ("nr,price\n8,30 €\n".encode("cp1252"), "cp1252", False),
        ("nr,fruit\n8,açaí\n".encode("utf-16"), "utf-16-le", True),
        (b"\xfe\xff" + "nr,fruit\n8,açaí\n".encode("utf-16-be"), "utf-16-be", True),
        (b"", "utf-8", False),
    ],
)
def test_detect_encoding(spark, tmp_path, data, encoding, bom):
    r = only(ra.detect_encoding(spark, put(tmp_path / "f.csv", data)))
    assert (r["encoding"], r["has_bom"]) == (encoding, bom)


def test_a_late_byte_decides(spark, tmp_path):
    data = b"shelf;herb\n" + b"14;dried thyme\n" * 20000 + b"15;menthe poivr\xe9e\n"
    assert only(ra.detect_encoding(spark, put(tmp_path / "f.csv", data)))["encoding"] == "latin-1"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1", "cp1252", "utf-16"])
def test_read_any_encoding(spark, tmp_path, encoding):
    note = "5 € Zoë" if encoding != "latin-1" else "5 Zoë"
    path = put(tmp_path / "f.csv", f"id;name\n1;{note}\n2;x\n".encode(encoding))
    rows = ra.read_delimited(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, note), (2, "x")]


@pytest.mark.parametrize(
    ("text", "delimiter"),
    [
        ("x,y\n4,5\n6,7\n8,9\n", ","),
        ("p\tq\n0\t1\n2\t3\n", "\t"),
        ("a|b\n1|x, y, z\n2|w\n", "|"),
        ("a;b;c\n1,5;2,5;x\n", ";"),
        ("one\ntwo\n", ","),
        ("", ","),
    ],
)
def test_detect_delimiter(spark, tmp_path, text, delimiter):
    assert detect_delimiter(spark, put(tmp_path / "f.csv", text.encode())) == delimiter


@pytest.mark.parametrize(
    "lines",
    [
        ["one, two, three, four"] * 25 + ["a;b;c"] + [f"{i};x;y" for i in range(200)],
        [f"note {i}" for i in range(25)] + ["a;b;c"] + [f"{i};x, y, z;w" if i % 3 else f"{i};x;w" for i in range(60)],
        ["a;b;c"] + [f'{i};"x, y, z, u, v";w' for i in range(60)],
    ],
)
def test_delimiter_of_all_lines(spark, tmp_path, lines):
    assert detect_delimiter(spark, put(tmp_path / "f.csv", "\n".join(lines).encode())) == ";"


def test_mark_of_any_file(spark, tmp_path):
    (tmp_path / "m").mkdir()
    put(tmp_path / "m" / "a.csv", b"x,y\n1,2\n")
    put(tmp_path / "m" / "b.csv", b"\xef\xbb\xbfx,y\n3,4\n")
    found = ra.detect_encoding(spark, str(tmp_path / "m")).first()
    assert (found["encoding"], found["has_bom"]) == ("utf-8-sig", True)
    table = ra.read_delimited(spark, str(tmp_path / "m"))
    assert table.columns == ["x", "y"] and sorted(tuple(r) for r in table.collect()) == [(1, 2), (3, 4)]


def test_cells_types_and_late_values(spark, tmp_path):
    lines = "id,n,f,b,s,day\n" + "1,5,1.5,TRUE,x,2020-01-01\n" * 3 + '2,,2,false,"",2020-01-02\n3,oops\n'
    df = ra.read_delimited(spark, put(tmp_path / "f.csv", lines.encode()))
    assert dict(df.dtypes) == {"id": "bigint", "n": "string", "f": "double", "b": "boolean", "s": "string", "day": "string"}
    rows = {r["id"]: r for r in df.collect()}
    assert rows[2]["s"] == "" and rows[2]["n"] is None
    assert rows[3]["n"] == "oops" and rows[3]["day"] is None


def test_quotes_in_cells(spark, tmp_path):
    path = put(tmp_path / "f.csv", b'a,b\n"say ""hi"", now",1\n')
    assert ra.read_delimited(spark, path, sep=",").first()["a"] == 'say "hi", now'


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_line_ends_in_cells(spark, tmp_path, encoding):
    text = 'id;note;size\n1;"two\nlines; é";5\n2;plain;6" wide\n3;"say ""x""";7\n'
    path = put(tmp_path / "f.csv", text.encode(encoding))
    rows = {r["id"]: r for r in ra.read_delimited(spark, path, sep=";").collect()}
    assert rows[1]["note"] == "two\nlines; é" and rows[2]["size"] == '6" wide' and rows[3]["note"] == 'say "x"'
    inches = put(tmp_path / "g.csv", b'id;size\n1;6" wide\n')
    assert has_quoted_newlines(spark, inches, ";") is False


def test_metadata(spark, tmp_path):
    df = spark.range(7).selectExpr("id", "cast(id as string) as t")
    assert [tuple(r) for r in ra.table_metadata(df).orderBy("position").collect()] == [(0, "id", "bigint", 7), (1, "t", "string", 7)]
    assert ra.table_metadata(df, count=False).columns == ["position", "name", "dtype"]
    put(tmp_path / "f.csv", b"abc")
    assert only(file_sizes(spark, str(tmp_path)))["size_bytes"] == 3


# ---- workbooks -------------------------------------------------------------------------------


def workbook(path, sheets: dict[str, list[list]]) -> None:
    """A minimal workbook: texts shared or inline, numbers and booleans as values, None left out."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared: list[str] = []
    members = {}
    for n, rows in enumerate(sheets.values(), 1):
        out = []
        for r, cells in enumerate(rows, 1):
            parts = []
            for c, v in enumerate(cells):
                at = f'r="{chr(65 + c)}{r}"'
                if v is None:
                    continue
                if isinstance(v, bool):
                    parts.append(f'<c {at} t="b"><v>{int(v)}</v></c>')
                elif isinstance(v, str) and n == 1:
                    shared.append(v)
                    parts.append(f'<c {at} t="s"><v>{len(shared) - 1}</v></c>')
                elif isinstance(v, str):
                    parts.append(f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>')
                else:
                    parts.append(f"<c {at}><v>{v}</v></c>")
            out.append(f'<row r="{r}">{"".join(parts)}</row>')
        members[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet {ns}><sheetData>{''.join(out)}</sheetData></worksheet>"
    listed = "".join(f'<sheet name="{s}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
    members["xl/workbook.xml"] = f'<workbook {ns} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{n}" Type="t" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    members["xl/_rels/workbook.xml.rels"] = (
        f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    )
    members["xl/sharedStrings.xml"] = f"<sst {ns}>{''.join(f'<si><t>{t}</t></si>' for t in shared)}</sst>"
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)


@pytest.fixture
def books(tmp_path):
    workbook(tmp_path / "a.xlsx", {"People": [["ID", "Name", None, "Pay"], [1, "Ann", "x", 5000], [2, None, None, 60.5]],
                                   "Teams": [["Team", "Open"], ["R&amp;D", True]]})
    workbook(tmp_path / "b.xlsx", {"People": [["ID", "Name", None, "Pay"], [3, "Cy", None, 7]], "Other": [["Z"]]})
    (tmp_path / "c.csv").write_text("x\n")
    return str(tmp_path)


def test_sheets(spark, books):
    rows = ra.list_workbook_sheets(spark, books).collect()
    names = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["sheet_no"])):
        names.setdefault(os.path.basename(r["path"]), []).append(r["sheet"])
    assert names == {"a.xlsx": ["People", "Teams"], "b.xlsx": ["People", "Other"]}


def test_read_workbooks(spark, books):
    df = ra.read_workbooks(spark, books)
    assert df.columns == ["ID", "Name", "col_2", "Pay"]
    assert sorted(tuple(r) for r in df.collect()) == [("1", "Ann", "x", "5000"), ("2", "", "", "60.5"), ("3", "Cy", "", "7")]
    assert dict(ra.infer_types(df).dtypes)["Pay"] == "double"
    assert [tuple(r) for r in ra.read_workbooks(spark, books, "Teams").collect()] == [("R&D", "True")]
    with pytest.raises(ValueError, match="no sheet"):
        ra.read_workbooks(spark, books, "Nope")


def test_file_types(spark, books):
    types = {os.path.basename(r["path"]): (r["file_type"], r["confirmed"]) for r in file_types(spark, books).collect()}
    assert types == {"a.xlsx": ("xlsx", True), "b.xlsx": ("xlsx", True), "c.csv": ("csv", True)}


# ---- reports ---------------------------------------------------------------------------------


def test_json_document(depot):
    d = ra.diff(*depot, ["id"])
    doc = json.loads(only(ra.diff_json(d))["json"])
    assert doc["summary"]["modified"] == 6 and doc["summary"]["key_columns"] == ["id"]
    assert set(doc["column_diffs"]["grams"]) == {"modified", "formatting_only", "null_introduced", "null_resolved", "change_rate"}
    assert [r["key"] for r in doc["sample_rows"][:2]] == ["4", "11"]
    assert len(doc["sample_rows"]) == 20
    assert len(json.loads(only(ra.diff_json(d, sample_rows=3))["json"])["sample_rows"]) == 3


def test_summary_rows(depot):
    rows = by(ra.diff_summary(ra.diff(*depot, ["id"]), "old", "new"), "field")
    assert rows["Table 1"]["value"] == "old" and rows["Added rows"]["value"] == "3"


def test_csv_export(spark, depot, tmp_path):
    out = str(tmp_path / "changes")
    ra.write_changes(ra.diff(*depot, ["id"]), out)
    rows = []
    for f in os.listdir(out):
        if f.endswith(".csv"):
            with open(os.path.join(out, f), newline="") as handle:
                rows += list(csv.DictReader(handle))
    assert len(rows) == 20
    assert list(rows[0])[:3] == ["id", "_change_type", "label_f1"]
    assert {r["id"]: r["place_f2"] for r in rows}["5"] == " bay 0 "


def test_report_folder(spark, depot, tmp_path):
    c = ra.compare(*depot, keys=["id"])
    path = ra.write_report(c, str(tmp_path), run_id="r1")
    assert path.endswith("/run_id=r1")
    for name, rows in {"counts": 1, "column_stats": 5, "summary": 9, "changes": None, "join": 20, "check_summary": 4}.items():
        if rows is not None:
            assert spark.read.parquet(f"{path}/{name}").count() == rows
    with pytest.raises(Exception, match="already exists"):
        ra.write_report(c, str(tmp_path), run_id="r1")


def test_report_holds_every_table(spark, depot, tmp_path):
    c = ra.compare(*depot, keys=["id"])
    path = ra.write_report(c, str(tmp_path), run_id="full")
    tables = ra.read_report(spark, path)
    manifest = by(tables.pop("manifest"), "table")
    assert set(manifest) == set(tables) == {*report.REPORT_TABLES, "join", "changes"}
    assert {n: df.count() for n, df in tables.items()} == {n: r["rows"] for n, r in manifest.items()}
    assert all(df.columns == manifest[n]["columns"] for n, df in tables.items())
    assert [tuple(r) for r in tables["multiplicity"].collect()] == [tuple(r) for r in c.multiplicity().collect()]
    assert tables["multiplicity"].first()["id"] == 16 and tables["contents"].count() == 0
    assert tables["profile_1"].orderBy("position").collect() == c.profiles[0].collect()
    assert sorted(map(repr, tables["checks"].collect())) == sorted(map(repr, c.checks().collect()))


def test_report_of_repeated_keys(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x")], "k bigint, v string")
    two = spark.createDataFrame([(1, "a"), (1, "c"), (2, "x")], "k bigint, v string")
    tables = ra.read_report(spark, ra.write_report(ra.compare(one, two, keys=["k"]), str(tmp_path)))
    assert {(r["values"]["v"], r["rows_f1"], r["rows_f2"]) for r in tables["contents"].collect()} == {("a", 2, 1), ("b", 1, 0), ("c", 0, 1)}
    assert [tuple(r)[:3] for r in tables["multiplicity"].collect()] == [(1, 3, 2)]


def test_report_goes_on_after_a_failure(spark, depot, tmp_path):
    def fail():
        raise RuntimeError("lost")

    broken = ra.compare(*depot, keys=["id"])
    broken.sample = fail
    with pytest.raises(RuntimeError, match="lost"):
        ra.write_report(broken, str(tmp_path), run_id="r")
    base = f"{tmp_path}/run_id=r"
    # What a write that broke off may leave: files of a table that is not noted as finished.
    spark.range(3).write.parquet(f"{base}/before_after")
    files = {f: os.stat(os.path.join(base, "join", f)).st_mtime_ns for f in os.listdir(f"{base}/join")}
    with pytest.raises(FileNotFoundError, match="no finished report"):
        ra.read_report(spark, base)
    with pytest.raises(FileExistsError, match="already exists"):
        ra.write_report(ra.compare(*depot, keys=["id"]), str(tmp_path), run_id="r")
    with pytest.raises(ValueError, match="another comparison"):
        ra.write_report(ra.compare(*depot, keys=["id"], rules=ra.IgnoreRules(case=True)), str(tmp_path), run_id="r", resume=True)
    assert ra.write_report(ra.compare(*depot, keys=["id"]), str(tmp_path), run_id="r", resume=True) == base
    tables = ra.read_report(spark, base)
    assert tables["before_after"].count() == tables["changes"].count() == 20
    assert files == {f: os.stat(os.path.join(base, "join", f)).st_mtime_ns for f in os.listdir(f"{base}/join")}
    steps = spark.read.parquet(f"{base}/steps")
    assert steps.count() == steps.select("step").distinct().count()
    assert ra.write_report(ra.compare(*depot, keys=["id"]), str(tmp_path), run_id="r", resume=True) == base
    assert spark.read.parquet(f"{base}/steps").count() == steps.count()


def test_run_log(spark, tmp_path):
    log = str(tmp_path / "runs")
    for i, job in enumerate(["a", "b", "c", "a"]):
        report.append_run(spark, log, job, "compare", "t1", "t2", 1.234, "complete", {"added": i}, started_at=1000.0 + i)
    runs = report.latest_runs(report.read_runs(spark, log)).collect()
    assert [r["job_id"] for r in runs] == ["a", "c", "b"]
    assert json.loads(runs[0]["summary"]) == {"added": "3"} and runs[0]["duration_s"] == 1.23
    assert len(report.latest_runs(report.read_runs(spark, log), 2).collect()) == 2
    report.append_run(spark, log, "b", "compare", "t1", "t2", 2.0, "late", started_at=1.0)
    assert report.get_run(report.read_runs(spark, log), "b").first()["status"] == "late"
    report.delete_run(spark, log, "c")
    assert report.get_run(report.read_runs(spark, log), "c").count() == 0
    assert only(report.get_run(report.read_runs(spark, log), "b"))["table1"] == "t1"
    report.clear_runs(spark, log)
    assert report.latest_runs(report.read_runs(spark, log)).count() == 0


def test_marks_count_at_the_start_of_a_file_only(spark, tmp_path):
    data = b"nr,dish\n" + b"\xff\xfe5,p\xe2t\xe9\n"
    assert only(ra.detect_encoding(spark, put(tmp_path / "f.csv", data))) == {"encoding": "latin-1", "confidence": 0.5, "has_bom": False}
    assert only(ra.detect_encoding(spark, put(tmp_path / "e.csv", b"")))["has_bom"] is False


def test_codes_with_leading_zeros_stay_text(spark):
    rows = [("00501", "7", "+49", "0.5", "-0", "-07", "0"), ("10001", "12", "+1", "10.25", "3", "5", "1")]
    df = ra.infer_types(spark.createDataFrame(rows, "zip string, n string, dial string, x string, z string, s string, b string"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types["zip"] == types["dial"] == types["s"] == "string" and df.first().zip == "00501"
    assert (types["n"], types["x"], types["z"]) == ("bigint", "double", "bigint")


def test_rows_of_json_stand_by_position(spark):
    import json

    from rowaccord.plans.report import _json_rows

    df = spark.range(13).selectExpr("id AS position", "concat('c', id) AS column").repartition(4)
    assert [r["position"] for r in json.loads(_json_rows(df, "j").first()["j"])] == list(range(13))


def test_no_preview_is_empty(spark):
    df = spark.range(50).selectExpr("id", "id AS v")
    assert only(ra.compare(df, df.withColumn("v", F.lit(1)), keys=["id"], preview=1e-9).counts())["rows_scanned"] == 1
    with pytest.raises(ValueError, match="preview"):
        ra.compare(df, df, keys=["id"], preview=0.0)

"""Spreadsheets: cells and types, written and read back, broken files, whole files or none."""

import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fathomline.sources import sheets

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PLACE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(named: dict[str, str], strings: list[str] | None = None) -> bytes:
    """A workbook of sheets with the given XML of their rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{PLACE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(named, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(named) + 1)) + "</Relationships>")
        for k, rows in enumerate(named.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if strings is not None:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(strings) + "</sst>")
    return out.getvalue()


def test_column_letters():
    assert [sheets.column_number(x) for x in ("A", "z", "AA", "XFD")] == [1, 26, 27, 16384]
    assert all(sheets.column_number(sheets.column_letters(k)) == k for k in range(1, 1000))
    assert sheets.column_range("B:Y") == (2, 25) and sheets.column_range("C") == (3, 3)


def test_cells_of_all_kinds(spark, tmp_path):
    rows = """<row r="1"><c r="A1" t="inlineStr"><is><t>skipped</t></is></c></row>
    <row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="C3" t="inlineStr"><is><r><t>Pri</t></r><r><t>ce </t></r></is></c><c r="D3" t="str"><v>flag</v></c><c r="E3" t="s"><v>0</v></c><c r="F3" t="s"><v>2</v></c></row>
    <row r="4"><c r="A4"><v>45000</v></c><c r="B4"><f>1+1</f><v>2</v></c><c r="C4"><v>1.5E-3</v></c><c r="D4" t="b"><v>1</v></c><c r="E4"><v>9</v></c><c r="F4" t="s"><v>3</v></c></row>
    <row r="5"/><row><c><v>45000.75</v></c><c t="e"><v>#N/A</v></c><c t="n"><v>7</v></c><c t="b"><v>0</v></c></row>
    <row r="9"><c r="A9" t="inlineStr"><is><t>2024-02-29</t></is></c><c r="C9" t="inlineStr"><is><t>x</t></is></c></row><row r="10"><c r="Z10"><v>1</v></c></row>"""
    strings = ["<si><t>Day</t></si>", "<si><r><t>n </t></r><r><t>um</t></r><rPh><t>no</t></rPh></si>", "<si><t>extra</t></si>", "<si><t>a&lt;b</t></si>"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(workbook({"Data": rows, "Other": ""}, strings))
    good, bad = sheets.read_sheets(spark, str(tmp_path / "in"), "day date, `n um` int, price double, FLAG boolean, absent string", columns="A:F", skip=1)
    got = sorted(map(tuple, good.select("_sheet", "_row", "day", "`n um`", "price", "FLAG", "absent", F.map_entries("_rest").alias("r")).collect()))
    assert [r[:7] for r in got] == [
        ("Data", 4, dt.date(2023, 3, 15), 2, 0.0015, True, None),
        ("Data", 6, dt.date(2023, 3, 15), None, 7.0, False, None),
        ("Data", 9, dt.date(2024, 2, 29), None, None, None, None),
    ]
    assert [[tuple(x) for x in r[7]] for r in got] == [[("extra", "a<b")], [], []] and bad.count() == 0
    times, _ = sheets.read_sheets(spark, str(tmp_path / "in"), "day timestamp", sheet="Da.*", skip=1)
    assert times.where("_row = 6").first().day == dt.datetime(2023, 3, 15, 18)
    assert sheets.read_sheets(spark, str(tmp_path / "in"), "day date", sheet="Dat")[0].count() == 0


def test_broken_files_are_set_aside(spark, tmp_path):
    good = workbook({"S": '<row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2"><v>5</v></c></row>'})
    cut = workbook({"S": '<row r="1"><c r="A1" t="inlineStr"><is><t>x</t></is></c></row>', "T": '<row r="1"><c r="A1" t="s"><v>4</v></c></row>'}, ["<si><t>x</t></si>"])
    unclosed = workbook({"S": '<row r="1"><c r="A1"><v>5</v></c></row><row>'})
    for name, data in {"a.xlsx": good, "b.xlsx": b"", "c.xlsx": b"no zip", "d.xlsx": good[:-40], "e.xlsx": cut, "f.xlsx": unclosed}.items():
        (tmp_path / name).write_bytes(data)
    rows, bad = sheets.read_sheets(spark, str(tmp_path), "x int")
    assert [r.x for r in rows.collect()] == [5]
    # files of no bytes are passed over by Spark's reader
    assert sorted((os.path.basename(r._path), r._sheet) for r in bad.collect()) == [("c.xlsx", None), ("d.xlsx", None), ("e.xlsx", "T"), ("f.xlsx", "S")]
    # sheets that nothing asks for aren't looked into
    assert sheets.read_sheets(spark, str(tmp_path / "e.xlsx"), "x int", sheet="S")[1].count() == 0


ROWS = [
    (1, "a & <b> \"c\"", 1.5, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 13, 30, 15), True, 2**60),
    (2, " two \n lines", None, None, None, None, None),
    (3, "漢字 é \U0001f600", -1e300, dt.date(1901, 1, 1), dt.datetime(1999, 12, 31, 23, 59, 59), False, -5),
    (4, "ctrl\x01gone", float("inf"), None, None, None, 0),
]
SCHEMA = "id int, name string, x double, d date, t timestamp, flag boolean, big long"


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = f"file://{tmp_path}/out"
    sheets.write_sheets(df.repartition(3, "id"), path)
    files = sorted(os.listdir(tmp_path / "out"))
    assert 1 <= len(files) <= 3 and all(x.endswith(".xlsx") for x in files)
    good, bad = sheets.read_sheets(spark, path, SCHEMA)
    want = [tuple(r) for r in ROWS]
    want[3] = (4, "ctrlgone", None, None, None, None, 0)
    assert sorted(map(tuple, good.select("id", "name", "x", "d", "t", "flag", "big").collect())) == want and bad.count() == 0
    pd = pytest.importorskip("pandas")
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        return
    assert len(pd.concat(pd.read_excel(tmp_path / "out" / f) for f in files)) == 4


def test_sheets_by_column_and_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(40).select("id", F.concat(F.lit("S&"), (F.col("id") % 4).cast("string")).alias("kind"))
    sheets.write_sheets(df, path, sheet="kind")
    rows, _ = sheets.read_sheets(spark, path, "id long")
    got = rows.groupBy("_sheet").agg(F.count("*").alias("n"), F.countDistinct("_path").alias("files"), F.min("id").alias("low")).collect()
    assert sorted(map(tuple, got)) == [(f"S&{k}", 10, 1, k) for k in range(4)]
    sheets.write_sheets(df.limit(0), path, sheet="kind")
    assert rows.count() == 40
    sheets.write_sheets(df.where("id < 3"), path, sheet="kind", mode="overwrite")
    assert sheets.read_sheets(spark, path, "id long")[0].count() == 3


def test_full_sheets_go_on_in_another(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 4)
    book = sheets.WorkbookFile(str(tmp_path / "a.xlsx"), ["id"])
    for k in range(7):
        book.add("S", [k])
    book.close()
    rows, _ = sheets.read_sheets(spark, str(tmp_path), "id int")
    assert sorted((r._sheet, r.id) for r in rows.collect()) == [("S", 0), ("S", 1), ("S", 2), ("S 2", 3), ("S 2", 4), ("S 2", 5), ("S 3", 6)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sheets.write_sheets(spark.range(3), path)
    before = sorted(os.listdir(path))
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sheets.write_sheets(bad, path, mode="overwrite")
    assert sorted(os.listdir(path)) == before


def test_a_task_for_each_sheet(spark, tmp_path):
    rows = "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, 4))
    (tmp_path / "a.xlsx").write_bytes(workbook({f"S{k}": rows for k in range(12)}))
    good, _ = sheets.read_sheets(spark, str(tmp_path), "`1` int")
    tasks = good.select("_sheet", F.spark_partition_id().alias("p")).distinct()
    assert good.count() == 24 and tasks.count() == 12 and tasks.select("p").distinct().count() > 3


def test_a_sheet_is_never_held_as_a_whole(monkeypatch):
    import tracemalloc
    import zlib

    n = 40_000
    xml = ("<worksheet><sheetData>" + "".join(f'<row r="{k}"><c r="A{k}"><v>{k}</v></c></row>' for k in range(1, n + 1)) + "</sheetData></worksheet>").encode()
    packed = zlib.compress(xml, 1)
    tracemalloc.start()
    assert sum(1 for _ in sheets._cells(packed, None, 1, 9)) == n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(xml) > 1_800_000 and peak < 1_200_000  # before: its text and all rows at once
    with pytest.raises(zlib.error):
        list(sheets._cells(packed[:-9], None, 1, 9))


def test_a_full_sheet_goes_on_in_another_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 4)
    writer = sheets.SheetWriter({"path": str(tmp_path / "out")}, spark.range(0).schema, False)
    writer.commit([writer.write(iter([(k,) for k in range(7)])), writer.write(iter([]))])
    rows, _ = sheets.read_sheets(spark, str(tmp_path / "out"), "id long")
    assert sorted(r.id for r in rows.collect()) == list(range(7))
    assert sorted(r["count"] for r in rows.groupBy("_path").count().collect()) == [1, 3, 3]

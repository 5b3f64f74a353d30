"""The .xlsx data source: round trips, workbooks as spreadsheet programs write them, ranges of rows."""

import random
import zipfile

import pytest

from graphloom.sources import files as S
from graphloom.sources import xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets, strings=None, styles=None, prefix=""):
    """A workbook whose parts are given as XML, with the names and places that programs use."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<{prefix}sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 7}"/>' for i, n in enumerate(sheets))
        ns = f'xmlns{":" + prefix[:-1] if prefix else ""}="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><{prefix}workbook {ns} xmlns:r="{REL}"><{prefix}sheets>{listed}</{prefix}sheets></{prefix}workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 7}" Type="x" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", xml)
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")


def test_workbook_of_a_spreadsheet_program(spark, tmp_path):
    strings = "<si><t>name</t></si><si><t>when</t></si><si><r><t>Phở </t></r><r><rPr><b/></rPr><t>bò</t></r><rPh><t>no</t></rPh></si><si><t>a&lt;b_x000D_\n_x005F_x0041_</t></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="21"/></cellXfs>'
    sheet = f"""<?xml version="1.0"?><worksheet {MAIN} xmlns:x14ac="http://ac" xmlns:mc="http://mc" mc:Ignorable="x14ac"><dimension ref="A1:H9"/><sheetData>
<row r="1" spans="1:8" x14ac:dyDescent="0.25"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>0</v></c><c r="E1" t="inlineStr"><is><t>flag</t></is></c><c r="F1" t="str"><v>made</v></c><c r="G1" t="inlineStr"><is><t>err</t></is></c><c r="H1" t="inlineStr"><is><t>n</t></is></c></row>
<row r="2" x14ac:dyDescent="0.25"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>45000</v></c><c r="D2" s="3"><v>8.5999999999999996</v></c><c r="E2" t="b"><v>1</v></c><c r="F2" t="str"><f>A2&amp;"x"</f><v>formula</v></c><c r="G2" t="e"><v>#N/A</v></c><c r="H2"><v>1E3</v></c></row>
<row r="5"><c r="B5" s="2"><v>45000.75</v></c><c r="A5" t="s"><v>3</v></c><c r="H5" s="4"><v>0.25</v></c></row>
<row r="9"><c t="b"><v>0</v></c><c s="1"><v>59</v></c><c s="0"/></row></sheetData><rowBreaks count="1"/></worksheet>"""
    workbook(tmp_path / "w.xlsx", {"Other": f"<worksheet {MAIN}><sheetData/></worksheet>", "Foods": sheet}, strings, styles)
    df = xlsx.read_xlsx(spark, str(tmp_path / "w.xlsx"), sheet="Foods")
    assert df.columns == ["name", "when", "_c2", "name.1", "flag", "made", "err", "n"]
    assert [tuple(r) for r in df.collect()] == [
        ("Phở bò", "2023-03-15", None, "8.6", "true", "formula", None, "1000"),
        ("a<b\r\n_x0041_", "2023-03-15 18:00:00", None, None, None, None, None, "06:00:00"),
        ("false", "1900-02-28", None, None, None, None, None, None),
    ]
    plain = xlsx.read_xlsx(spark, str(tmp_path / "w.xlsx"), sheet="1", header="false", rowNumber="at")
    assert [(r["at"], r["_c0"]) for r in plain.collect()] == [(0, "name"), (1, "Phở bò"), (2, "a<b\r\n_x0041_"), (3, "false")]
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read_xlsx(spark, str(tmp_path / "w.xlsx"), sheet="Missing").collect()


def test_prefixed_names_and_wrong_dimension(spark, tmp_path):
    rows = "".join(f'<x:row r="{i + 1}"><x:c r="A{i + 1}"><x:v>{i}</x:v></x:c></x:row>' for i in range(60))
    sheet = f'<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:dimension ref="A1:A10"/><x:sheetData>{rows}</x:sheetData></x:worksheet>'
    workbook(tmp_path / "p.xlsx", {"S": sheet}, prefix="x:")
    for n in ("3", "7", "1000"):
        df = xlsx.read_xlsx(spark, str(tmp_path / "p.xlsx"), header="false", rows=n, rowNumber="at")
        assert [(r["at"], r["_c0"]) for r in df.collect()] == [(i, str(i)) for i in range(60)]


@pytest.mark.parametrize("chunk", [80, 1 << 18])
def test_ranges_see_every_row_once(tmp_path, monkeypatch, chunk):
    """Whatever the pieces in which a sheet is inflated, and wherever tags are cut by them."""
    monkeypatch.setattr(xlsx, "_CHUNK", chunk)
    rng = random.Random(chunk)
    cells = [["".join(rng.choice("ab<&\" é\n") for _ in range(rng.randint(0, 30))) for _ in range(3)] for _ in range(200)]
    xml = "".join(f'<row r="{i + 1}">{"".join(xlsx._cell(c, i + 1, v) for c, v in enumerate(r))}</row>' for i, r in enumerate(cells))
    workbook(tmp_path / "r.xlsx", {"S": f"<worksheet {MAIN}><sheetData>{xml}</sheetData></worksheet>"})
    fs, at = xlsx._file_system(str(tmp_path / "r.xlsx"))
    with xlsx.Workbook(fs, at) as w:
        part = w.sheet("0")
        for a, b in ((0, 1), (0, None), (17, 40), (199, 200), (199, None), (200, None), (150, 260)):
            got = w.texts(list(w.rows(part, a, b)))
            assert [[t.get(c) for c in range(3)] for t in got] == [[v or None for v in r] for r in cells[a:b]]


def test_round_trip_modes_and_food(spark, tmp_path):
    path = str(tmp_path / "f.xlsx")
    rows = [(i, f"n{i} <&> \x0b_x0041_\r\n\t ", None if i % 3 == 0 else i / 4, i % 2 == 0, None) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, name string, x double, flag boolean, nothing string").repartitionByRange(3, "id").sortWithinPartitions("id")
    xlsx.write_xlsx(df, path, rows="9")
    assert not [p.name for p in (tmp_path / "f.xlsx").iterdir() if not p.name.endswith(".xlsx")]
    assert len(list((tmp_path / "f.xlsx").iterdir())) >= 6
    want = [(str(i), n, None if x is None else f"{x:g}", str(f).lower(), None) for i, n, x, f, _ in rows]
    read = lambda: [tuple(r) for r in xlsx.read_xlsx(spark, path, rows="4").collect()]
    assert read() == want
    xlsx.write_xlsx(df.limit(5), path)
    assert sorted(read()) == sorted([*want, *want[:5]])
    xlsx.write_xlsx(df.limit(5), path, overwrite=True)
    assert read() == want[:5]
    food = spark.createDataFrame([("Cơm", "8,6", "a"), ("cơm ", "x", "b")], "`TÊN THỨC ĂN` string, `Fat (g)` string, `Loại` string").coalesce(1)
    xlsx.write_xlsx(food, str(tmp_path / "food.xlsx"))
    assert [(r["key"], r["fat"], r["food_group"]) for r in S.read_food(spark, str(tmp_path / "food.xlsx")).collect()] == [("cơm", None, "b")]
    assert S.read_cells(spark, str(tmp_path / "food.xlsx")).count() == 6


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="stop"):
        xlsx.write_xlsx(bad, str(tmp_path / "b.xlsx"))
    assert list((tmp_path / "b.xlsx").iterdir()) == []


def test_order_of_more_than_a_thousand_files_of_a_task(spark, tmp_path):
    path = str(tmp_path / "many.xlsx")
    xlsx.write_xlsx(spark.range(1, 1212, 1, 1).selectExpr("cast(id AS string) AS n"), path, rows="1")
    df = xlsx.read_xlsx(spark, path)
    assert [int(r["n"]) for r in df.collect()] == list(range(1, 1212))
    assert [(r["row"], r["value"]) for r in S.read_cells(spark, path).orderBy("row").collect()] == [(i - 1, str(i)) for i in range(1, 1212)]


def test_small_workbooks_share_a_partition(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "small.xlsx")
    xlsx.write_xlsx(spark.range(0, 400, 1, 2).selectExpr("cast(id AS string) AS n"), path, rows="10")
    assert len(xlsx._files(path)) == 40
    df = xlsx.read_xlsx(spark, path, rowNumber="at")
    assert df.rdd.getNumPartitions() == 1
    assert [(r["at"], r["n"]) for r in df.collect()] == [(i % 10, str(i)) for i in range(400)]
    # by size, and with larger ones between that are cut for themselves
    monkeypatch.setattr(xlsx, "TOGETHER_BYTES", 1)
    assert len(xlsx._Reader({"path": path}, df.schema).partitions()) == 40
    assert len(xlsx._Reader({"path": path, "rows": "4"}, df.schema).partitions()) == 40

import zipfile
from datetime import datetime

import pytest

from clientele.session import shared_folder
from clientele.sources import database, files, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def two_sheet_book(path):
    """A workbook as spreadsheet programs write it: shared texts, date styles, gaps."""
    sheet = ('<worksheet {m}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
             '<c r="C1" t="s"><v>2</v></c></row><row r="2"><c r="A2"><v>{v}</v></c><c r="C2" s="1"><v>43831.5</v></c>'
             '</row></sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>'
                   '<sheet name="Control Group" sheetId="1" r:id="rId1"/>'
                   '<sheet name="Test Group" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="rId2" Type="t" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml",
                   f"<sst {MAIN}><si><t>Click</t></si><si><r><t>Na</t></r><r><t>me</t></r></si><si><t>Day</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(m=MAIN, v=5))
        z.writestr("xl/worksheets/sheet2.xml", sheet.format(m=MAIN, v=7))


def test_workbook_sheets(spark, tmp_path):
    two_sheet_book(tmp_path / "a.xlsx")
    two_sheet_book(tmp_path / "b.xlsx")
    df = workbook.read_workbooks(spark, str(tmp_path), "Click double, Name string, Day timestamp_ntz", "Test Group")
    assert [tuple(r) for r in df.collect()] == [(7.0, None, datetime(2020, 1, 1, 12))] * 2
    with pytest.raises(Exception, match="no columns"):
        workbook.read_workbooks(spark, str(tmp_path / "a.xlsx"), "Other double").collect()


def test_workbook_splits_full_sheets(spark, tmp_path):
    spark.dataSource.register(workbook.WorkbookSource)
    df = spark.range(25).selectExpr("id", "concat('a&<', id) as t").coalesce(1)
    df.write.format("xlsx").option("rowspersheet", 10).mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 3
    back = workbook.read_workbooks(spark, str(tmp_path / "out"), "id long, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_keeps_nulls_and_micros(spark):
    # a text file cannot tell empty text from a missing one: both are read as NULL
    df = spark.createDataFrame([(1, datetime(2020, 1, 1, 1, 2, 3, 4), ""), (2, None, None), (3, None, 'a,"b"')],
                               "i long, t timestamp_ntz, s string")
    path = files.write_csv(df, shared_folder(spark, "t"))
    back = files.read_csv(spark, path, df.schema).orderBy("i").collect()
    assert [tuple(r) for r in back] == [(1, datetime(2020, 1, 1, 1, 2, 3, 4), None), (2, None, None), (3, None, 'a,"b"')]


def test_jdbc_options():
    base = database.jdbc_options("jdbc:x:y", user="u", password="p")
    assert database.read_options(base, query="select 1")["query"] == "select 1"
    split = database.read_options(base, table="t", split_on="id", bounds=(0, 100), splits=4)
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "4"
    for bad in ({}, {"table": "t", "query": "q"}, {"table": "t", "split_on": "id"},
                {"query": "q", "split_on": "id", "bounds": (0, 1)}):
        with pytest.raises(ValueError):
            database.read_options(base, **bad)


def test_checkpoint_folder_comes_from_the_session(spark):
    from clientele.session import ensure_checkpoint_dir, stage
    assert shared_folder(spark, "x").startswith(ensure_checkpoint_dir(spark).rstrip("/"))
    df = stage(spark.createDataFrame([], "a long, b string"))
    assert df.count() == 0 and df.columns == ["a", "b"]


def test_scratch_deletes_its_stages(spark):
    from clientele.session import scratch, stage
    kept = stage(spark.range(5), "kept")
    with scratch(spark):
        gone = stage(spark.range(7), "gone")
        assert gone.count() == 7
        folder = gone.inputFiles()[0].rsplit("/", 1)[0]
    assert kept.count() == 5
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

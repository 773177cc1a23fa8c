"""Files: ragged CSV, workbooks, refused uploads, seals."""

import zipfile

import pytest

from riskweave.sources import files


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tolerant_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", "x,y,z\n1, NA ,null\n2,N/A\n3,b,c,extra\n,,\n")
    rows = files.read_csv_tolerantly(spark, path).collect()
    assert [(r.x, r.y, r.z) for r in rows] == [("1", None, None), ("2", None, None), ("3", "b", "c"), (None, None, None)]
    assert [r._corrupt is not None for r in rows] == [False, True, True, False]


@pytest.mark.parametrize("name,text", [("a.txt", "x\n1\n"), ("a.csv", "x,x\n1,2\n"), ("b.csv", "x\n"), ("c.csv", "")])
def test_refused_uploads(spark, tmp_path, name, text):
    with pytest.raises(files.UploadError):
        files.read_upload(spark, write(tmp_path / name, text))


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="D1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="D2" t="inlineStr"><is><t>NA</t></is></c></row><row r="3"/><row r="4"><c r="B4" t="s"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>a</t></si><si><r><t>d</t></r><r><t>!</t></r></si></sst>")
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    return str(path)


def test_workbook(spark, tmp_path):
    df = files.read_upload(spark, workbook(tmp_path / "w.xlsx"))
    assert df.columns == ["a", "b", "_c2", "d!"]
    assert [tuple(r) for r in df.collect()] == [("1.5", None, None, None), (None, "d!", None, None)]


def test_a_changed_seal_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id int, score double")
    files.seal(df, f"{tmp_path}/s", "id", {"model": "x"})
    assert files.verify_seal(spark, f"{tmp_path}/s")
    df.withColumn("score", df.score + 1).write.mode("append").parquet(f"{tmp_path}/s/rows")
    assert not files.verify_seal(spark, f"{tmp_path}/s")
    with pytest.raises(files.UploadError):
        files.reveal(spark, f"{tmp_path}/s", df.select("id"))


def test_digests_and_appends(spark, tmp_path):
    write(tmp_path / "a.bin", "abc")
    assert files.file_digests(spark, f"{tmp_path}/a.bin").first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    df = spark.createDataFrame([(1, 0.5), (2, 1.5), (3, None)], "id int, risk double")
    assert files.append_checked(df, f"{tmp_path}/t", "risk BETWEEN 0 AND 1") == 2
    assert files.append_checked(df, f"{tmp_path}/t", "risk BETWEEN 0 AND 1") == 2
    assert spark.read.parquet(f"{tmp_path}/t/rows").count() == 2

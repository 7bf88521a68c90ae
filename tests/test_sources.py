"""Files in and out."""

import zipfile

import pytest

from tabulon.operators import prep as P
from tabulon.sources import files


def test_names():
    assert files.legal_names(["Country Code", "GDP growth (%)", "1960", "gdp_pc", "x", "x"]) == ["countrycode", "gdpgrowth", "v3", "gdp_pc", "x", "v6"]
    assert files.legal_names(["1a", ""], "preserve", letters=True) == ["A", "B"] and files.column_letter(27) == "AB" and files.cell_at("AB10") == (9, 27)


def test_delimited(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('junk,,\nmore,,\nName,"A, b",Z\nx,1,"two\nlines"\ny,.,"q ""r"""\n', encoding="utf-8-sig")
    df = files.read_delimited(spark, str(p), rows=(3, None))
    assert df.columns == ["name", "ab", "z"] and [tuple(r) for r in df.collect()] == [("x", 1.0, "two\nlines"), ("y", None, 'q "r"')]
    assert files.read_delimited(spark, str(p), rows=(3, 4), cols=(2, 3)).count() == 1
    out = str(tmp_path / "o.csv")
    files.save(df, out)
    with pytest.raises(Exception, match="(?i)exist"):
        files.save(df, out)
    assert sorted(map(tuple, files.use(spark, out).collect())) == sorted(map(tuple, df.collect()))


def test_ranges_below_narrow_lines(spark, tmp_path):
    p = tmp_path / "junk.csv"
    p.write_text('Some junk title\nmore junk, with, commas\n"quoted ""junk"" line"\n\nIndexCol,Region Name,Val A,Val B,Trailing\n1,"Country, One",10,20,x\n2,CountryTwo,30,40,x\n3,Three,50,60,x,extra\n4,Four\n')
    df = files.read_delimited(spark, str(p), rows=(5, 7), cols=(1, 4), case="upper")
    assert df.columns == ["INDEXCOL", "REGIONNAME", "VALA", "VALB"] and sorted(map(tuple, df.collect())) == [(1.0, "Country, One", 10.0, 20.0), (2.0, "CountryTwo", 30.0, 40.0)]
    df = files.read_delimited(spark, str(p), rows=(5, None))
    assert df.columns == ["indexcol", "regionname", "vala", "valb", "trailing", "v6"] and df.count() == 4
    assert {tuple(r)[5] for r in df.collect()} == {"", "extra"} and {tuple(r)[2] for r in df.collect()} == {10.0, 30.0, 50.0, None}


def test_every_file_gives_up_its_header(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_text(f"a,b\r\n{i},{i}5\r\n,\r\n")
    df = files.read_delimited(spark, str(tmp_path))
    assert df.columns == ["a", "b"] and dict(df.dtypes) == {"a": "double", "b": "double"}
    assert sorted(tuple(r) for r in df.dropna().collect()) == [(0.0, 5.0), (1.0, 15.0), (2.0, 25.0)] and df.count() == 6
    assert files.read_delimited(spark, str(tmp_path), rows=(1, 2)).count() == 3
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    assert files.read_delimited(spark, str(tmp_path / "empty")).count() == 0


def test_formats_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "x double, s string")
    for ext in ("orc", "json", "parquet", "tsv"):
        files.save(df, str(tmp_path / f"o.{ext}"))
        got = files.use(spark, str(tmp_path / f"o.{ext}"), ["x", "s"])
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, df.collect()))), ext


def test_dta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a", 3), (None, "", 4)], "x double, s string, n int")
    df = P.label(df, "n", "a count", values={3: "three"})
    p = str(tmp_path / "a.dta")
    files.save(df, p)
    back = files.use(spark, p)
    assert [tuple(r) for r in back.orderBy("n").collect()] == [(1.0, "a", 3.0), (None, "", 4.0)]
    assert P.labels(back)["n"]["label"] == "a count" and back.schema["n"].metadata["values"] == {"3": "three"}
    with pytest.raises(P.DataError):
        files.save(df, p)


def test_dta_files_of_several_tasks(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "many.dta")
    many = spark.range(0, 1000, 1, 3).selectExpr("id", "cast(id % 7 as string) s")
    files.save(many.limit(0), p)
    assert files.use(spark, p).columns == ["id", "s"] and files.use(spark, p).count() == 0  # no rows: columns only
    monkeypatch.setattr(files, "DTA_ROWS", 200)
    files.save(many, p, replace=True)
    back = files.use(spark, p)
    assert back.count() == back.distinct().count() == 1000 and back.filter("s <> cast(cast(id % 7 as int) as string)").isEmpty()
    assert sum(f.suffix == ".dta" for f in (tmp_path / "many.dta").iterdir()) >= 3 and len(list(tmp_path.iterdir())) == 1


def test_workbooks(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>b</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>2000</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>')
    df = files.use(spark, p)
    assert df.columns == ["name", "B"] and tuple(df.first()) == ("b", 4.5)
    assert files.read_workbook(spark, p, "S", "B1:B2", firstrow=False).columns == ["B"]
    gap = str(tmp_path / "gap.xlsx")
    with zipfile.ZipFile(p) as old, zipfile.ZipFile(gap, "w") as new:
        for n in old.namelist():
            text = old.read(n).decode()
            new.writestr(n, text.replace('row r="2"', 'row r="6"').replace('r="A2"', 'r="A6"').replace('r="B2"', 'r="B6"'))
    assert [tuple(r) for r in files.read_workbook(spark, gap, cellrange="A5:B6", firstrow=False).collect()] == [("", None), ("b", 4.5)]
    both = tmp_path / "books"
    both.mkdir()
    for n in ("x.xlsx", "y.xlsx"):  # each gives up its own first row
        (both / n).write_bytes((tmp_path / "a.xlsx").read_bytes())
    assert [tuple(r) for r in files.read_workbook(spark, str(both)).collect()] == [("b", 4.5)] * 2
    with pytest.raises(Exception, match="no sheet T"):
        files.read_workbook(spark, p, "T").collect()
    q = str(tmp_path / "a.ods")
    with zipfile.ZipFile(q, "w") as z:
        z.writestr("content.xml", '<o:d xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:t="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:x="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><t:table t:name="S"><t:table-row><t:table-cell><x:p>k</x:p></t:table-cell></t:table-row><t:table-row><t:table-cell o:value="7"/></t:table-row></t:table></o:d>')
    assert [tuple(r) for r in files.use(spark, q).collect()] == [(7.0,)]


def test_columns_and_filter_reach_the_scan(spark, sf):
    plan = files.use(spark, f"{sf}/orders.parquet", ["o_orderkey"], "o_totalprice > 5")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and "GreaterThan(o_totalprice,5.0)" in plan

"""Scans against small texts with known cells, and helpers against plain Python."""

import struct

import pytest

from cellweave.functions import colors, refs, text, units
from cellweave.functions.formulas import ptg, r1c1
from cellweave.sources import delimited, markup
from cellweave.sources.binary import stream
from cellweave.sources.reader import extension, read_workbook, scan_files, workbook_json


def grid_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_idx, {})[r.col_idx] = r.formula or (r.v_str if r.v_num is None else r.v_num) if r.v_bool is None else r.v_bool
    return [[out[i].get(j) for j in sorted(out[i])] for i in sorted(out)]


def docs(spark, value):
    return spark.createDataFrame([(1, value)], "doc_id long, text string")


@pytest.mark.parametrize(
    ("given", "cells"),
    [
        ("a,b\nc,d", [["a", "b"], ["c", "d"]]),
        ("a,b\r\nc,d\r\n", [["a", "b"], ["c", "d"]]),
        ("", [[""]]),
        (",,,", [["", "", "", ""]]),
        ("\n\n", [[""], [""]]),
        ('"a,b","c\nd","e""f"', [["a,b", "c\nd", 'e"f']]),
        ('"a"b,c', [["ab", "c"]]),
        ('a"b,c', [['a"b', "c"]]),
        ('"""x""",1', [["x", "1"]]),
        ('"""x"""', [['"x"']]),
        ("a,b,c\nd", [["a", "b", "c"], ["d"]]),
        ("x\n\ny", [["x"], [""], ["y"]]),
        ("ünï,日本", [["ünï", "日本"]]),
    ],
)
def test_delimited(spark, given, cells):
    assert grid_of(delimited.scan_csv(docs(spark, given))) == cells


def test_delimited_null_and_long(spark):
    assert delimited.scan_csv(docs(spark, None)).count() == 0
    assert grid_of(delimited.scan_csv(docs(spark, "x" * 100_000 + ",y"))) == [["x" * 100_000, "y"]]


def test_dif(spark):
    t = 'TABLE\n0,1\n"v"\nLABEL\n1,0\n"K"\n1,0\n"N"\nDATA\n0,0\n""\n-1,0\nBOT\n0,7\nV\n1,0\n"k"\n-1,0\nBOT\n2,1\nTRUE\n2,-2\nNA\n-1,0\nEOD\n'
    assert grid_of(delimited.scan_dif(docs(spark, t))) == [[7.0, "k"], [True, "#N/A"]]


def test_sylk(spark):
    t = 'ID;P\nC;Y1;X1;K"a;;b"\nC;X2;K5\nC;Y2;X1;ER[-1]C[1]*2;K10\nF;W1 2 10\nE\n'
    assert grid_of(delimited.scan_sylk(docs(spark, t))) == [["a;b", 5.0], ["=B1*2"]]
    assert sorted((r.col_idx, r.width_px) for r in delimited.sylk_columns(docs(spark, t)).collect()) == [(0, 72), (1, 72)]


def test_html(spark):
    t = "<table><thead><tr><td>x</td><th>h</th></tr></thead><tr><td rowspan=2>a</td><td data-formula='A1+1' title=note>b</td></tr><tr><td> c </td></tr></table>"
    got = markup.scan_html(docs(spark, t), html="text")
    assert grid_of(got) == [["a", "=A1+1"], ["c"]]
    assert {(r.row_idx, r.col_idx, r.title) for r in got.collect()} == {(0, 0, "h"), (0, 1, "x"), (1, 1, "x")}
    assert [(r.address, r.colspan, r.rowspan) for r in markup.merges(got).collect()] == [("A1", 1, 2)]
    assert markup.scan_html(docs(spark, "<p>none</p>"), html="text").count() == 0


def test_xml2003(spark):
    t = """<Workbook><Styles><Style ss:ID="s1"><Font ss:Bold="1" ss:Color="#FF0000"/></Style></Styles><Names><NamedRange ss:Name="_xlnm.Area" ss:RefersTo="=S!R1C1"/></Names>
<Worksheet ss:Name="S"><Table><Row><Cell ss:MergeAcross="1"><Data ss:Type="Number">100</Data></Cell><Cell><Data ss:Type="Boolean">1</Data></Cell></Row>
<Row ss:Index="3"><Cell ss:Index="2" ss:Formula="=RC[-1]+R1C1" ss:StyleID="s1"><Data ss:Type="Number">1</Data><Comment><Data>hi</Data></Comment></Cell></Row></Table>
<WorksheetOptions><FreezePanes/><SplitHorizontal>2</SplitHorizontal></WorksheetOptions></Worksheet></Workbook>"""
    d = docs(spark, t)
    got = {(r.row_idx, r.col_idx): (r.v_num, r.v_bool, r.formula, r.colspan, r.comment) for r in markup.scan_xml2003(d, xml="text").collect()}
    assert got == {(0, 0): (100.0, None, None, 2, None), (0, 2): (None, True, None, 1, None), (2, 1): (1.0, None, "=A3+$A$1", 1, "hi")}
    assert [(r.name, r.refers_to) for r in markup.xml_names(d, xml="text").collect()] == [("Area", "S!R1C1")]
    assert [r.css for r in markup.xml_styles(d, xml="text").collect()] == ["font-weight: bold; color: #FF0000"]
    assert [(r.sheet_name, r.state, r.freeze_rows) for r in markup.xml_worksheets(d, xml="text").collect()] == [("S", "visible", 2)]


@pytest.mark.parametrize(
    ("tokens", "said"),
    [
        ("1E0500", "5"), ("16", ""), ("1D01", "TRUE"), ("1E02001E030003151E040005", "(2+3)*4"), ("24000000C0", "A1"), ("2400000000", "$A$1"), ("2400000040", "A$1"),
        ("25" + "0000" + "0100" + "00C0" + "01C0", "A1:B2"), ("1E0A001E140022020400", "SUM(10,20)"), ("1E0500211300", "PI()"), ("22001300", "PI()"), ("03", "0+0"), ("08", '""&""'), ("1702006162", '"ab"'), ("1E05", ""),
    ],
)
def test_formula_tokens(tokens, said):
    assert ptg(bytes.fromhex(tokens)) == said


def test_formula_tokens_strict():
    assert ptg(bytes.fromhex("1E0500211300"), strict=True) == "PI(5)"
    assert ptg(b"\x1f" + struct.pack("<d", 1.5)) == "1.5"
    assert ptg(None) == ""


@pytest.mark.parametrize(
    ("given", "row", "col", "said"),
    [("R1C1", 0, 0, "$A$1"), ("RC", 5, 3, "D6"), ("R[1]C[1]", 0, 0, "B2"), ("R[-1]C[-1]", 5, 5, "E5"), ("R1C[1]", 0, 0, "B$1"), ("=R1C1&amp;R2C2", 0, 0, "=$A$1&$B$2"), ("=SUM(A1:A10)", 0, 0, "=SUM(A1:A10)"), (None, 0, 0, None), ("=SEARCH(RC,1)", 0, 0, "=SEARCH(A1,1)")],
)
def test_r1c1(given, row, col, said):
    assert r1c1(given, row, col) == said


def test_references(spark):
    from pyspark.sql import functions as F

    names = spark.range(20_000).select("id", refs.column_name("id").alias("s")).select("id", "s", refs.column_index("s").alias("back")).collect()
    assert all(r.id == r.back for r in names)
    assert [names[i].s for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    good = ["A1", "A1:B2", "A:A", "1:1", "$A$1", "$A1", "A$1", "Sheet1!A1", "'My Sheet'!A1"]
    bad = ["", None, "'Sheet:1'!A1", "AAAA1", "123"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "t string").select("t", refs.is_token("t").alias("ok")).collect()
    assert [r.ok for r in rows] == [True] * 9 + [False] * 5
    r = spark.createDataFrame([("S!AA10:ZZ100",), ("A:A",), ("B3",)], "t string").select(refs.range_coords("t").alias("r")).collect()
    assert [tuple(x.r) for x in r] == [(26, 9, 701, 99), (0, 0, 0, 0), (1, 2, 1, 2)]
    w = spark.createDataFrame([(10.0, "pt"), (10.0, "char"), (10.7, "px"), (10.0, "unknown"), (None, "pt"), (float("nan"), "pt")], "w double, u string")
    assert [r.p for r in w.select(units.width_px(F.col("w"), F.col("u")).alias("p")).collect()] == [72, 84, 11, 72, 100, 100]


def test_colours_and_text(spark):
    import colorsys

    from pyspark.sql import functions as F

    c = spark.range(0, 256, 5).select(F.col("id").alias("r"), (F.col("id") * 7 % 256).alias("g"), (255 - F.col("id")).alias("b"))
    for r in c.select("r", "g", "b", colors.rgb_hsl(F.col("r"), F.col("g"), F.col("b")).alias("x")).collect():
        h, light, s = colorsys.rgb_to_hls(r.r / 255, r.g / 255, r.b / 255)
        assert r.x == pytest.approx((h, s, light), abs=1e-9)
    t = spark.createDataFrame([("&amp;lt;b&apos;",)], "t string")
    assert t.select(text.decode_entities(F.col("t")).alias("t")).first().t == "<b'"
    css = spark.createDataFrame([("border-left: 1px; color: red;",)], "t string")
    assert css.select(text.without_property(F.col("t"), "border-left").alias("t")).first().t == "color: red"


def test_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,1\ny,2", encoding="utf-8")
    (tmp_path / "b.slk").write_text('ID;P\nC;Y1;X1;K"q"\nE\n')
    assert grid_of(read_workbook(spark, str(tmp_path / "a.csv"))) == [["x", "1"], ["y", "2"]]
    both = scan_files(spark.read.format("binaryFile").load(str(tmp_path)), {"csv", "slk"})
    assert sorted(r.v_str for r in both.collect()) == ["1", "2", "q", "x", "y"]
    assert '{"worksheets":[{"data":[["x","1"],["y","2"]]}]}' in {r.json for r in workbook_json(both).collect()}
    assert [extension(x) for x in ("A.B.XLSX", r"C:\d\e.Csv", "none", "ü.ods")] == ["xlsx", "csv", "", "ods"]
    for bad in ("a.pdf", "none", "", None, 3):
        with pytest.raises(ValueError):
            read_workbook(spark, bad)
    assert stream(b"no container", ("Workbook",)) is None


def test_arrivals(spark, tmp_path):
    from cellweave.streaming.arrivals import arrivals, write_cells

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,1")
    q = write_cells(arrivals(spark, str(tmp_path / "in"), "*.csv"), {"csv"}, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_delimiter_of_several_characters(spark):
    assert grid_of(delimited.scan_csv(docs(spark, "a||b\nc"), delimiter="||")) == [["a||b"], ["c"]]


def test_names_lose_prefixes_in_tags_only():
    from cellweave.sources.xmltext import bare_names

    xml = "<x:a xmlns:x='u' x:b=\"c:d=1\" y:b='2'>ratio x:y=3 use xmlns=\"q\" <![CDATA[<q:z>]]><!-- <x:n> --><x:e c='>'/></x:a>"
    assert bare_names(xml) == "<a b=\"c:d=1\">ratio x:y=3 use xmlns=\"q\" <![CDATA[<q:z>]]><e c='>'/></a>"


def test_formula_text_never_fails():
    import random

    from cellweave.functions.formulas import ptg, r1c1

    rng = random.Random(2)
    assert r1c1("=RC", None, 1) is None and r1c1("=RC", 0, None) is None
    for _ in range(3000):
        assert isinstance(ptg(bytes(rng.randrange(256) for _ in range(rng.randrange(40))), 3, 3), str)


def test_detected_encodings():
    from cellweave.sources.encodings import detect, detect_dif

    assert [detect(x) for x in ("é".encode(), "é".encode("latin1"), b"\xef\xbb\xbfa", b"", None, "abcd".encode("utf-16-be"))] == ["utf-8", "latin1", "utf-8", "utf-8", "utf-8", "utf-16be"]
    assert detect_dif("20 °C".encode("cp850")) == "cp850" and detect_dif(b"plain") == "utf-8"


def test_paths_and_call_backs(spark, tmp_path):
    from cellweave.sources import reader

    (tmp_path / "a.b").mkdir()
    (tmp_path / "a.b" / "c").write_text("x")
    (tmp_path / "a.b" / "t.csv").write_text("1,2\n")
    cells, errors = reader.read_folder(spark, str(tmp_path), encoding=None)
    assert [r.message for r in errors.collect()] == ["Unsupported file type: "]
    assert [r.v_str for r in cells.orderBy("col_idx").collect()] == ["1", "2"]
    seen = []
    assert reader.read_workbook(spark, "x.pdf", onerror=lambda e: seen.append(str(e))) is None
    reader.read_workbook(spark, str(tmp_path / "a.b" / "t.csv"), onload=lambda c: seen.append(c.count()))
    assert seen == ["Unsupported file type: pdf", 2]


def test_command_line(tmp_path, capsys):
    from cellweave.__main__ import main

    assert main([]) == 1 and main([str(tmp_path / "none.csv")]) == 1
    assert "Usage" in capsys.readouterr().out


def test_command_line_prints_whole_workbooks(spark, tmp_path, capsys):
    import json

    from cellweave.__main__ import main
    from cellweave.plans.showcase import ods, xls, xlsx

    (tmp_path / "a.csv").write_text("x,1\ny\n")
    (tmp_path / "b.html").write_text("<table><tr><th>t<th>u<tr><td colspan=2>v</table>")
    (tmp_path / "c.xlsx").write_bytes(xlsx(1, "X"))
    (tmp_path / "d.xlsx").write_bytes(b"PK")
    (tmp_path / "e.none").write_text("")
    out = []
    for name in ("a.csv", "b.html", "c.xlsx"):
        assert main([str(tmp_path / name)]) == 0
        out.append(json.loads(capsys.readouterr().out)["worksheets"])
    assert [[c["value"] for c in r["cells"]] for r in out[0][0]["data"]] == [["x", "1"], ["y"]]
    assert out[1][0]["merges"][0]["colspan"] == 2 and out[1][0]["data"][0]["cells"][0]["value"] == "v"
    first = out[2][0]
    assert list(first) == ["sheet", "columns", "rows", "merges", "comments", "styles", "validations", "data"] and first["sheet"][0]["state"] == "visible"
    assert {c["col_idx"] for c in first["columns"]} == {0, 1, 3} and all("css" in s for s in first["styles"]) and len(out[2]) > 1
    for name, form, parts in (("f.xls", xls, {"sheet", "columns", "merges", "styles", "data"}), ("g.ods", ods, {"sheet", "columns", "merges", "comments", "styles", "data"})):
        (tmp_path / name).write_bytes(form(1, "X"))
        assert main([str(tmp_path / name)]) == 0
        sheets = json.loads(capsys.readouterr().out)["worksheets"]
        assert parts <= {p for s in sheets for p in s} and sheets[0]["sheet"][0]["sheet_name"] and sheets[0]["data"][0]["row"] == 0
    assert main([str(tmp_path / "d.xlsx")]) == 1 and main([str(tmp_path / "e.none")]) == 1
    assert "Not a zip archive" in (err := capsys.readouterr().err) and "Unsupported file type: none" in err


def test_compound_file_with_a_small_stream():
    """A stream under the cut-off lies in the mini stream."""
    import struct

    from cellweave.sources.binary import stream

    def entry(title, kind, child, start, size):
        raw = title.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII36xIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child, start, size, 0)

    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0)
    head = head.ljust(76, b"\0") + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    fat = struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, 0xFFFFFFFE, *[0xFFFFFFFF] * 124)
    directory = entry("Root Entry", 5, 1, 3, 128) + entry("book", 2, 0xFFFFFFFF, 0, 70) + bytes(256)
    mini_fat = struct.pack("<128I", 1, 0xFFFFFFFE, *[0xFFFFFFFF] * 126)
    store = bytes(range(70)).ljust(512, b"\0")
    assert stream(head + fat + directory + mini_fat + store, ("Workbook", "Book")) == bytes(range(70))

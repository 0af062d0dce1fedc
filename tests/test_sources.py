"""Data sources, splits, spans, directories and mergeable scans against whole-file scans and brute force."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cellweave.operators import relational as R
from cellweave.plans import fixtures
from cellweave.sources import binary, delimited, markup, streams, zipped
from cellweave.sources import datasource as D
from cellweave.sources.compound import Compound, compound_entries
from cellweave.sources.reader import file_errors, scan_files
from cellweave.sources.splits import Quotes, scan_csv_files

SF = "/root/testdata/sf0.001"
CELL = ["sheet_idx", "row_idx", "col_idx", "v_type", "v_str", "v_num", "v_bool", "formula"]
SCANS = {
    "dbf": ("dbf", binary.scan_dbf), "wk1": ("lotus", binary.scan_lotus), "xls": ("xls", binary.scan_xls), "xlsx": ("xlsx", zipped.scan_xlsx), "ods": ("ods", zipped.scan_ods),
    "csv": ("csv", delimited.scan_csv), "dif": ("dif", delimited.scan_dif), "slk": ("sylk", delimited.scan_sylk), "xml": ("xml", markup.scan_xml2003), "html": ("html", markup.scan_html),
}


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    """A folder of workbooks by extension, and what they were made of."""
    D.register(spark)
    top, made = tmp_path_factory.mktemp("books"), {}
    for ext, (form, scan) in SCANS.items():
        docs = (fixtures.binary_docs if form in fixtures.ENCODERS else fixtures.text_docs)(spark, SF, form).cache()
        column = docs.columns[1]
        D.write_files(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("." + ext)).alias("name"), F.col(column).cast("binary").alias("content")), f"{top}/{ext}")
        made[ext] = scan(docs, "doc_id", column)
    return top, made


@pytest.mark.parametrize("ext", list(SCANS))
def test_source_gives_what_scans_give(spark, books, ext):
    top, made = books
    got = spark.read.format("cellweave").load(f"{top}/{ext}").select(F.regexp_extract("workbook_id", r"(\d+)\.\w+$", 1).cast("long").alias("workbook_id"), *CELL)
    want = made[ext].select("workbook_id", *CELL)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def sheets_of(names, rows=6):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    files = {"xl/workbook.xml": f"<workbook {main}><sheets>{''.join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(names))}</sheets></workbook>"}
    files["xl/_rels/workbook.xml.rels"] = f"<Relationships>{''.join(f'<Relationship Id="r{i}" Target="worksheets/{n}.xml"/>' for i, n in enumerate(names))}</Relationships>"
    files["xl/sharedStrings.xml"] = f"<sst {main}><si><t>hello</t></si></sst>"
    for i, n in enumerate(names):
        body = "".join(f'<row r="{r + 1}"><c r="A{r + 1}"><v>{100 * i + r}</v></c><c r="B{r + 1}" t="s"><v>0</v></c></row>' for r in range(rows))
        files[f"xl/worksheets/{n}.xml"] = f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>"
    return files


def test_sheets_are_partitions_and_filters_reach_them(spark, tmp_path):
    D.register(spark)
    for name in ("one", "two"):
        (tmp_path / f"{name}.xlsx").write_bytes(fixtures._zip(sheets_of(["alpha", "beta", "gamma"])))
    df = spark.read.format("cellweave").option("perSheet", "true").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 6 and spark.read.format("cellweave").load(str(tmp_path)).rdd.getNumPartitions() == 1
    some = df.where("sheet_idx = 1 and row_idx < 2 and endswith(workbook_id, 'two.xlsx')")
    assert sorted((r.row_idx, r.col_idx, r.v_str, r.v_num) for r in some.collect()) == [(0, 0, None, 100.0), (0, 1, "hello", None), (1, 0, None, 101.0), (1, 1, "hello", None)]
    assert some.rdd.getNumPartitions() == 1 and " Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert df.where("v_num > 101").count() == 2 * sum(100 * i + r > 101 for i in range(3) for r in range(6))
    assert spark.read.format("cellweave").option("worksheetIndex", "2").load(str(tmp_path)).select("v_num").where("v_num >= 200").count() == 12


def parts_read(tmp_path, filters, schema=D.CELLS, **options):
    from pyspark.sql import types as T

    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    reader = D.WorkbookReader({"path": str(tmp_path), **options}, T.StructType([T.StructField(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]))
    rest = list(reader.pushFilters(filters))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    return reader.seen, rows, rest


def test_unwanted_sheets_files_and_strings_are_not_opened(tmp_path, monkeypatch):
    (tmp_path / "a.xlsx").write_bytes(fixtures._zip(sheets_of(["alpha", "beta", "gamma"])))
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    (tmp_path / "_c.csv").write_text("no")
    opened = []
    real = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: (opened.append(str(name)), real(self, name, *a, **k))[1])
    seen, rows, rest = parts_read(tmp_path, [D.EqualTo(("sheet_idx",), 1), D.LessThan(("row_idx",), 2), D.StringContains(("workbook_id",), ".xlsx"), D.GreaterThan(("v_num",), 3)])
    assert [type(f).__name__ for f in rest] == ["GreaterThan"] and len(rows) == 4
    assert [s.rsplit("/", 1)[-1] for s in seen] == ["a.xlsx", "beta.xml"] and not {"xl/worksheets/alpha.xml", "xl/worksheets/gamma.xml"} & set(opened)
    opened.clear()
    _, rows, _ = parts_read(tmp_path / "a.xlsx", [], "workbook_id string, row_idx int, v_num double")
    assert len(rows) == 36 and set(rows[0]) == {"workbook_id", "row_idx", "v_num"}
    assert opened.count("xl/sharedStrings.xml") == 1  # looked through, not kept
    with pytest.raises(ValueError):
        parts_read(tmp_path, [], "row_idx int, other string")


def test_damaged_archives_have_an_error_and_no_cells(spark, tmp_path):
    files = sheets_of(["alpha", "beta"])
    cut = dict(files)
    cut["xl/worksheets/beta.xml"] = cut["xl/worksheets/beta.xml"][:-60]
    odd = dict(files)
    odd["xl/worksheets/beta.xml"] = odd["xl/worksheets/beta.xml"].replace('<row r="3"', '<row r="x"')
    gone = {k: v for k, v in files.items() if "beta" not in k or "_rels" in k}
    sound, torn = fixtures._zip(files), bytearray(fixtures._zip(files))
    torn[len(torn) // 3] ^= 0xFF
    made = {"sound": sound, "cut": fixtures._zip(cut), "odd": fixtures._zip(odd), "gone": fixtures._zip(gone), "torn": bytes(torn), "none": b"PK", "empty": b""}
    for name, data in made.items():
        (tmp_path / f"{name}.xlsx").write_bytes(data)
    ods = fixtures._zip({"content.xml": "<office:document-content><office:body><office:spreadsheet><table:table><table:table-row>"})
    (tmp_path / "cut.ods").write_bytes(ods)
    docs = spark.read.format("binaryFile").load(str(tmp_path))  # which gives no row for an empty file
    cells = scan_files(docs, {"xlsx", "ods"}).groupBy("workbook_id").count().collect()
    assert [(r.workbook_id.rsplit("/", 1)[-1], r["count"]) for r in cells] == [("sound.xlsx", 24)]
    wrong = {r.path.rsplit("/", 1)[-1]: r.message for r in file_errors(docs).collect()}
    assert set(wrong) == {"cut.ods"} | {f"{n}.xlsx" for n in made if n not in ("sound", "empty")} and "beta.xml" in wrong["cut.xlsx"] and "row r='x'" in wrong["odd.xlsx"]
    D.register(spark)
    read = spark.read.format("cellweave").load(str(tmp_path))
    assert read.count() == 24
    with pytest.raises(Exception, match="A damaged part"):
        spark.read.format("cellweave").option("mode", "FAILFAST").load(str(tmp_path)).count()


def test_table_source_has_types_and_ranges(spark, tmp_path):
    from datetime import date, datetime
    from decimal import Decimal

    D.register(spark)
    fields = [("KEY", "N", 6, 0), ("PRICE", "N", 9, 2), ("RATE", "F", 8, 3), ("NAME", "C", 8, 0), ("OK", "L", 1, 0), ("DAY", "D", 8, 0), ("AT", "T", 8, 0), ("MONEY", "Y", 8, 0), ("N", "I", 4, 0), ("X", "B", 8, 0), ("name", "C", 2, 0)]
    size = 1 + sum(f[2] for f in fields)
    out = struct.pack("<B3BIHH20x", 0x30, 124, 1, 2, 50, 33 + 32 * len(fields), size)
    out += b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), w, d) for n, t, w, d in fields) + b"\r"
    for i in range(50):
        out += b"*" if i % 7 == 3 else b" "
        out += f"{i:6d}{i / 4:9.2f}{i / 8:8.3f}{'n' + str(i):8}{'TF? '[i % 4]}".encode() + (b"20240229" if i % 3 else b"        ")
        out += struct.pack("<II", 2440588 + i, 1500) + struct.pack("<q", 12345 * i) + struct.pack("<i", -i) + struct.pack("<d", i / 3) + b"zz"
    (tmp_path / "t.dbf").write_bytes(out + b"\x1a")
    t = spark.read.format("cellweave_dbf").option("partitionBytes", str(size * 8)).load(str(tmp_path))
    assert t.rdd.getNumPartitions() == 7
    assert dict(t.dtypes) == {"KEY": "bigint", "PRICE": "decimal(9,2)", "RATE": "double", "NAME": "string", "OK": "boolean", "DAY": "date", "AT": "timestamp", "MONEY": "decimal(19,4)", "N": "int", "X": "double", "name_10": "string", "_file": "string", "_record": "bigint", "_deleted": "boolean"}
    rows = sorted(t.collect(), key=lambda r: r.KEY)
    assert [r.KEY for r in rows] == [i for i in range(50) if i % 7 != 3] == [r._record for r in rows]
    r = rows[-1]
    assert (r.PRICE, r.RATE, r.NAME, r.OK, r.DAY, r.MONEY, r.N, r.X) == (Decimal("12.25"), 6.125, "n49", False, date(2024, 2, 29), Decimal("60.4905"), -49, 49 / 3)
    assert r.AT.replace(tzinfo=None) == datetime(1970, 2, 19, 0, 0, 1, 500000) and rows[2].OK is None and rows[0].DAY is None
    assert t.select("KEY").count() == 43 and spark.read.format("cellweave_dbf").option("deleted", "true").load(str(tmp_path)).where("_deleted").count() == 7


def plain_after(text, delimiter, inside):
    """Character by character."""
    start, quoted = not inside, inside
    i = 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    quoted = False
        elif c == delimiter:
            start = True
            i += 1
            continue
        elif start and c == '"':
            quoted = True
        start = False
        i += 1
    return quoted


def test_quotes_of_lines():
    rng = random.Random(5)
    for d in (",", ";"):
        q = Quotes(d)
        for _ in range(4000):
            line = "".join(rng.choice('"",,;ab') for _ in range(rng.randint(0, 12)))
            assert [q.after(line, s) for s in (False, True)] == [plain_after(line, d, s) for s in (False, True)], line


@pytest.mark.parametrize("split", [7, 40, 1000])
def test_splits_give_what_whole_files_give(spark, tmp_path, split):
    rng = random.Random(split)
    texts = {f"f{k}.csv": "".join(rng.choice(['"', '"', ",", "\n", "\n", "a", "bc", "é", '""', "\r\n", "xyz"]) for _ in range(150)) for k in range(8)}
    texts |= {"long.csv": 'a,"' + "line\n" * 60 + '",z\nlast,1\n', "open.csv": 'a,b\nc,"never\nclosed\n', "end.csv": 'a\n"x', "pair.csv": 'a\n"""x"""', "pairs.csv": 'a\n"""x"""\n', "bom.csv": "﻿a,b\nc"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for key, value in (("maxPartitionBytes", split), ("openCostInBytes", 0)):
        spark.conf.set(f"spark.sql.files.{key}", str(value))
    try:
        got = scan_csv_files(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > (20 if split < 100 else 1)
        rows = {}
        for r in got.collect():
            rows.setdefault(r.workbook_id.rsplit("/", 1)[-1], {})[r.row_idx, r.col_idx] = r.v_str
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")
    for name, text in texts.items():
        bare = text.removeprefix("﻿")
        assert rows.get(name) == {(r, c): v for r, c, v in streams.csv_values(bare.replace("\r", ""))}, name


def test_delimiters_of_several_characters_part_nothing(spark):
    docs = spark.createDataFrame([(1, "a||b￿c\nd")], "doc_id long, text string")
    assert sorted((r.row_idx, r.col_idx, r.v_str) for r in delimited.scan_csv(docs, delimiter="||").collect()) == [(0, 0, "a||b￿c"), (1, 0, "d")]


def plain_places(cells):
    """Slot by slot."""
    rows = sorted({(c[1], c[3]) for c in cells})
    taken, out, row, col = set(), [], -1, 0
    for c in sorted(cells, key=lambda c: (c[1], c[3], c[4], c[5])):
        if rows.index((c[1], c[3])) != row:
            row, col = rows.index((c[1], c[3])), 0
        while (row, col) in taken:
            col += 1
        out.append((row, col))
        taken.update((row + i, col + j) for i in range(1, c[9]) for j in range(c[8]))
        col += c[8]
    return out


def test_spans_by_a_skyline():
    rng = random.Random(2)
    for _ in range(400):
        cells = [[0, 1, 0, r, 1, 10 * r + k, "", None, rng.choice((1, 1, 2, 3, 7)), rng.choice((1, 1, 2, 3, 5)), None, None] for r in range(rng.randint(1, 7)) for k in range(rng.randint(0, 4))]
        assert [(row, col) for _, row, col in markup._placed(cells)] == plain_places(cells)


def test_wide_and_deep_spans(spark):
    html = "<table><tr><td colspan=1200 rowspan=2>a<td>b<tr><td>c<tr><td>d<td rowspan=100000 colspan=1000>e</table>"
    docs = spark.createDataFrame([(1, html), (2, None)], "doc_id long, html string")
    t = markup.scan_html(docs, first_row_as_header=False)
    assert sorted((r.v_str, r.row_idx, r.col_idx) for r in t.collect()) == [("a", 0, 0), ("b", 0, 1200), ("c", 1, 1200), ("d", 2, 0), ("e", 2, 1)]
    small = t.where("v_str <> 'e'")
    assert markup.spanned_slots(small).count() == 2399
    b = R.bounds(t, markup.merges(t)).first()
    assert (b.max_row, b.max_col) == (100001, 1200)


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_mergeable_cursors(spark, segment):
    rng = random.Random(segment)
    rows = [(k, i, rng.randint(1, 9) if rng.random() < 0.2 else None, rng.randint(1, 9) if rng.random() < 0.2 else None, rng.random() < 0.6, rng.choice("abc") if rng.random() < 0.3 else None) for k in (1, 2, None) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, pos long, x int, y int, m boolean, v string")
    got = {(r.k, r.pos): (r.row_idx, r.col_idx) for r in R.cursor(df, ["k"], "pos", "x", "y", "m", segment).collect()}
    stuck = {(r.k, r.pos): r.v for r in R.sticky(df, ["k"], "pos", "v", segment=segment).collect()}
    for k in (1, 2, None):
        row, col, v = 0, 0, None
        for _, i, x, y, m, own in (r for r in rows if r[0] == k):
            row, col, v = y - 1 if y else row, x - 1 if x else col, own or v
            assert got[k, i] == (row, col) and stuck[k, i] == v
            col += m


def test_range_join_on_dyadic_blocks(spark):
    rng = random.Random(4)
    ranges = [(rng.randint(0, 2), a, a + rng.choice((0, 1, 5, 63, 64, 1000, 1048575)), c, c + rng.randint(0, 3), i) for i in range(120) for a in (rng.randint(0, 200),) for c in (rng.randint(0, 6),)]
    points = [(rng.randint(0, 3), rng.randint(0, 1500), rng.randint(0, 9)) for _ in range(800)]
    r = spark.createDataFrame(ranges, "k int, r1 long, r2 long, c1 int, c2 int, rank int")
    p = spark.createDataFrame(points, "k int, row_idx int, col_idx int")
    got = {(x.k, x.row_idx, x.col_idx): x["rank"] for x in R.range_join(p, r, ["k"], "rank").collect()}
    assert got == {(k, y, x): min((i for kk, a, z, c, d, i in ranges if kk == k and a <= y <= z and c <= x <= d), default=None) for k, y, x in points}
    blocks = r.select("r1", "r2", F.explode(R.dyadic_blocks(F.col("r1"), F.col("r2"), 24)).alias("b"))
    laid = {}
    for x in blocks.collect():
        laid.setdefault((x.r1, x.r2), set()).update([(x.b.level, x.b.block)])
    for (a, z), own in laid.items():
        assert len(own) <= 2 * 21
        if z - a < 2000:
            assert sorted(y for level, b in own for y in range(b << level, (b + 1) << level)) == list(range(a, z + 1))
    whole = spark.createDataFrame([(0, 1048575), (7, 9), (5, 4)], "a long, z long").select(R.dyadic_blocks(F.col("a"), F.col("z"), 10).alias("b")).collect()
    assert [len(x.b) for x in whole] == [1024, 2, 0]


def test_compound_directory(spark):
    tree = {"Workbook": b"W" * 9000, "Small": b"s" * 70, "Empty": b"", "Box/Deep/Inner": b"i" * 100, "Box/Other": b"o" * 5000, **{f"S{k:03d}": bytes([k]) * (k * 7 % 130) for k in range(60)}}
    data = fixtures.compound_tree(tree)
    c = Compound(io.BytesIO(data))
    assert {e.path: c.read(e) for e in c.entries if e.kind == "stream"} == tree
    assert [e.path for e in c.entries if e.kind == "storage"] == ["Box", "Box/Deep"]
    docs = spark.createDataFrame([(1, data), (2, b"no"), (3, None)], "doc_id long, content binary")
    assert {r.path: r.size for r in compound_entries(docs).where("kind = 'stream'").collect()} == {k: len(v) for k, v in tree.items()}
    for cut in (0, 100, 600, 3000):
        binary.sound_stream(data[:cut])


def test_compound_with_many_allocation_sectors():
    """More than 109 sectors of the allocation table: their list goes on outside the header."""
    body = bytes(range(256)) * 4 * 8000
    c = Compound(io.BytesIO(fixtures.compound_tree({"Workbook": body, "x": b"1"})))
    assert len(c.heads) > 109 and c.read(c.find("workbook")) == body and c.read(c.find("X")) == b"1"


def test_files_that_change_replace_their_cells(spark, tmp_path):
    import os

    from cellweave.streaming import arrivals as A

    box, out = tmp_path / "in.box", str(tmp_path / "out")
    box.mkdir()

    def put(name, data, at):
        (box / name).write_bytes(data)
        os.utime(box / name, ns=(at, at))

    def turn():
        A.write_changes(A.changes(A.versions(spark, str(box))), out, str(tmp_path / "checkpoint")).awaitTermination()
        cells, errors = A.current(spark, out)
        found = sorted((r.workbook_id.rsplit("/", 1)[-1], r.row_idx, r.col_idx, r.v_str if r.v_num is None else r.v_num) for r in cells.collect())
        return found, sorted((r.path.rsplit("/", 1)[-1], r.message) for r in errors.collect())

    second = 10**9
    put("a.csv", b"1,2\n3", 1000 * second)
    put("b.xlsx", fixtures._zip(sheets_of(["s"], rows=1)), 1001 * second)
    put("plain", b"?", 1002 * second)
    b = [("b.xlsx", 0, 0, 0.0), ("b.xlsx", 0, 1, "hello")]
    first = [("a.csv", 0, 0, "1"), ("a.csv", 0, 1, "2"), ("a.csv", 1, 0, "3")]
    assert turn() == (first + b, [("plain", "Unsupported file type: ")])
    put("a.csv", b"9", 1003 * second)  # fewer cells
    put("b.xlsx", fixtures._zip(sheets_of(["s"], rows=1))[:-30], 1004 * second)  # damaged: the old cells stay
    assert turn() == ([("a.csv", 0, 0, "9"), *b], [("b.xlsx", "Not a zip archive"), ("plain", "Unsupported file type: ")])
    put("a.csv", b"9", 1005 * second)  # touched only
    put("b.xlsx", fixtures._zip(sheets_of(["s"], rows=2)), 1006 * second)
    assert turn() == ([("a.csv", 0, 0, "9"), *b, ("b.xlsx", 1, 0, 1.0), ("b.xlsx", 1, 1, "hello")], [("plain", "Unsupported file type: ")])
    assert spark.read.parquet(out).where("action = 'version' and path like '%a.csv'").count() == 2


def test_table_functions(spark):
    from cellweave.sources import table_functions as U

    U.register(spark)
    docs = spark.createDataFrame([(1, "a,b\nc", "<table><tr><th>t<tr><td colspan=2>x</table>", fixtures._zip(sheets_of(["s"], rows=1))), (2, None, None, None), (3, "", "none", b"PK")], "k long, t string, h string, x binary")
    docs.createOrReplaceTempView("given")
    sql = spark.sql
    assert sorted(map(tuple, sql("SELECT k, c.* FROM given, LATERAL scan_cells(t, 'csv', columns => 'row_idx, col_idx, v_str') c").collect())) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (3, 0, 0, "")]
    assert sql("SELECT c.title, c.v_str, c.colspan FROM given, LATERAL scan_cells(h, 'html') c").collect() == [("t", "x", 2)]
    assert sorted(map(tuple, sql("SELECT k, c.v_num, c.v_str FROM given, LATERAL scan_cells(x, 'xlsx') c").collect()), key=str) == [(1, 0.0, None), (1, None, "hello")]
    for wrong in ("scan_cells(t, 'xlsx')", "scan_cells(t, 'none')", "scan_cells(t, 'csv', columns => 'title')"):
        with pytest.raises(Exception, match="scan_cells"):
            sql(f"SELECT * FROM given, LATERAL {wrong} c").collect()
    spark.createDataFrame([(1, 0, 1, 2, "z"), (1, 0, 0, 0, "a"), (1, 0, 0, 1, None), (2, 0, 5, 0, "q")], "workbook_id long, sheet_idx int, row_idx int, col_idx int, v string").createOrReplaceTempView("some_cells")
    rows = sql("SELECT * FROM sheet_rows(TABLE(some_cells) PARTITION BY (workbook_id, sheet_idx) ORDER BY (row_idx, col_idx))").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, ["a", ""]), (1, 0, 1, ["", "", "z"]), (2, 0, 5, ["q"])]


def test_workbooks_written_and_read_again(spark, tmp_path):
    import json

    from cellweave.operators import workbooks as B

    docs = fixtures.text_docs(spark, SF, "csv")
    cells = delimited.scan_csv(docs)
    merges = cells.where("col_idx = 0 and row_idx % 3 = 0").select("workbook_id", "sheet_idx", "row_idx", F.lit(2).alias("colspan"))
    B.write_workbooks(B.workbook_lines(cells, merges=(merges, "row_idx")), str(tmp_path / "out"))
    want, spans = {}, {}
    for r in cells.collect():
        want.setdefault(str(r.workbook_id), {}).setdefault(r.row_idx, {})[r.col_idx] = r.v_str
    for r in merges.collect():
        spans.setdefault(str(r.workbook_id), []).append(r.row_idx)
    names = sorted(p.stem for p in (tmp_path / "out").glob("*.json"))
    assert names == sorted(want) and not list((tmp_path / "out").glob("_*"))
    for p in (tmp_path / "out").glob("*.json"):
        (sheet,) = json.loads(p.read_text())["worksheets"]
        assert list(sheet) == ["merges", "data"] and [m["row_idx"] for m in sheet["merges"]] == sorted(spans[p.stem])
        assert [d["row"] for d in sheet["data"]] == sorted(want[p.stem])
        assert {d["row"]: {c["col_idx"]: c["value"] for c in d["cells"]} for d in sheet["data"]} == want[p.stem]
    with pytest.raises(Exception):  # a job that fails leaves nothing
        bad = cells.withColumn("v_str", F.when(F.col("row_idx") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("v_str")))
        B.write_workbooks(B.workbook_lines(bad), str(tmp_path / "failed"))
    assert not list((tmp_path / "failed").glob("*")) if (tmp_path / "failed").exists() else True

"""Workbooks of driver tables, to be scanned again: text by expressions, binary files by small encoders."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a workbook at most, well under the 65,536 that Lotus and Excel 97-2003 can number: what a task holds stays small.
PAGE = 1 << 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, c_custkey, c_name, c_mktsegment): each customer's workbook, which has at most PAGE of a nation's, in order of their keys.

    doc_id has the nation in its upper 32 bits and the number of the workbook among the nation's in the lower."""
    at = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    c = table(spark, sf_dir, "customer").select("c_nationkey", at.alias("at"), "c_custkey", "c_name", "c_mktsegment")
    doc_id = F.shiftleft(F.col("c_nationkey").cast("long"), 32) + F.floor(F.col("at") / PAGE)
    return c.select(doc_id.alias("doc_id"), "c_custkey", "c_name", "c_mktsegment")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, rows): the workbooks of paged()."""
    return paged(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rows"))


def rejoined(cells: DataFrame) -> DataFrame:
    """Cells scanned from the workbooks of customers(), under their nation: rows, also those in formulas, count on from workbook to workbook."""
    before = (F.col("workbook_id").bitwiseAND(0xFFFFFFFF) * PAGE).cast("int")
    row = "(?<=[A-Z])[0-9]+"
    moved = F.transform(F.regexp_extract_all("formula", F.lit(row), F.lit(0)), lambda n: (n.cast("int") + before).cast("string"))
    formula = F.array_join(F.zip_with(F.split("formula", row), moved, lambda text, n: F.concat(text, F.coalesce(n, F.lit("")))), "")
    cells = cells.withColumns({"row_idx": F.col("row_idx") + before, "formula": formula})
    return cells.withColumn("workbook_id", F.shiftright("workbook_id", 32))  # apart: within a lambda, the new column would be taken


def text_docs(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """(doc_id, text) of customers() in a text format."""
    t = customers(spark, sf_dir)

    def quoted(x):
        return F.concat(F.lit('"'), F.replace(x.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))

    def joined(row, head: str = "", tail: str = "", between: str = "\n"):
        return F.concat(F.lit(head), F.array_join(F.transform("rows", row), between), F.lit(tail))

    s = F.lit
    forms = {
        "csv": lambda: joined(lambda r: F.concat_ws(",", r["c_custkey"], r["c_name"], r["c_mktsegment"])),
        "tsv": lambda: joined(lambda r: F.concat_ws("\t", r["c_custkey"], r["c_name"], r["c_mktsegment"]), tail="\n"),
        "semicolon": lambda: joined(lambda r: F.concat_ws(";", r["c_custkey"], r["c_name"], r["c_mktsegment"]), between="\r\n"),
        "quoted": lambda: joined(lambda r: F.concat_ws(",", quoted(r["c_custkey"]), quoted(r["c_name"]), quoted(r["c_mktsegment"])), tail="\n"),
        "html": lambda: joined(lambda r: F.concat(s("<tr><td>"), r["c_custkey"], s("</td><td> "), r["c_name"], s(" </td><td>"), r["c_mktsegment"], s("</td></tr>")), "<table><tr><th>key</th><th>name</th><th>segment</th></tr>", "</table>"),
        "xml": lambda: joined(
            lambda r: F.concat(s('<Row><Cell><Data ss:Type="Number">'), r["c_custkey"], s('</Data></Cell><Cell><Data ss:Type="String">'), r["c_name"], s('</Data></Cell><Cell ss:Index="3"><Data ss:Type="String">'), r["c_mktsegment"], s("</Data></Cell></Row>")),
            '<?xml version="1.0"?><Workbook xmlns:ss="urn:x"><Worksheet ss:Name="C"><Table>', "</Table></Worksheet></Workbook>", "",
        ),
        "dif": lambda: joined(lambda r: F.concat(s("-1,0\nBOT\n0,"), r["c_custkey"], s('\nV\n1,0\n"'), r["c_name"], s('"\n1,0\n"'), r["c_mktsegment"], s('"')), 'TABLE\n0,1\n"x"\nVECTORS\n0,3\n""\nTUPLES\n0,0\n""\nDATA\n0,0\n""\n', "\n-1,0\nEOD\n"),
        "sylk": lambda: F.concat(s("ID;P\n"), F.array_join(F.transform("rows", lambda r, i: F.concat(s("C;Y"), i + 1, s(";X1;K"), r["c_custkey"], s('\nC;K"'), r["c_name"], s('"\nC;X3;K"'), r["c_mktsegment"], s('"'))), "\n"), s("\nE\n")),
    }
    return t.select("doc_id", forms[form]().alias("text"))


def _dbf(rows: list) -> bytes:
    fields = [("KEY", "N", 12), ("NAME", "C", 40), ("SEG", "C", 20)]
    out = struct.pack("<B3BIHH20x", 3, 124, 1, 2, 2 * len(rows), 33 + 32 * len(fields), 1 + sum(f[2] for f in fields))
    out += b"".join(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), w, 0) for n, t, w in fields) + b"\r"
    for r in rows:
        cells = str(r[0]).rjust(12).encode() + str(r[1]).ljust(40).encode() + str(r[2]).ljust(20).encode()
        out += b" " + cells + b"*" + cells  # each record again, deleted
    return out + b"\x1a"


def _lotus(rows: list) -> bytes:
    def record(t: int, data: bytes) -> bytes:
        return struct.pack("<HH", t, len(data)) + data

    out = record(0, b"\x04\x04")
    for i, r in enumerate(rows):
        out += record(14, struct.pack("<BHHd", 0, 0, i, r[0]))
        for j in (1, 2):
            out += record(15, struct.pack("<BHH", 0, j, i) + b"'" + r[j].encode() + b"\0")
    return out + record(1, b"")


def compound_tree(tree: dict[str, bytes]) -> bytes:
    """A compound file of streams by path: small ones in the root's own stream, siblings as a balanced tree in the order of their names."""
    size, mini, cutoff, end, free = 512, 64, 4096, 0xFFFFFFFE, 0xFFFFFFFF
    nodes: list[dict] = [{"name": "Root Entry", "kind": 5, "data": b"", "children": {}}]

    def child(at: int, name: str, kind: int, data: bytes = b"") -> int:
        if name not in nodes[at]["children"]:
            nodes[at]["children"][name] = len(nodes)
            nodes.append({"name": name, "kind": kind, "data": data, "children": {}})
        return nodes[at]["children"][name]

    for path, data in tree.items():
        at, *names = 0, *path.split("/")
        for name in names[:-1]:
            at = child(at, name, 1)
        child(at, names[-1], 2, data)

    def balanced(ids: list[int]) -> int:
        if not ids:
            return free
        m = len(ids) // 2
        nodes[ids[m]]["left"], nodes[ids[m]]["right"] = balanced(ids[:m]), balanced(ids[m + 1 :])
        return ids[m]

    for n in nodes:
        n["child"] = balanced(sorted(n["children"].values(), key=lambda i: (len(nodes[i]["name"]), nodes[i]["name"].upper())))
    small, small_fat = b"", []
    for n in nodes:
        if n["kind"] == 2 and 0 < len(n["data"]) < cutoff:
            count, n["start"] = -(-len(n["data"]) // mini), len(small_fat)
            small_fat += [*range(n["start"] + 1, n["start"] + count), end]
            small += n["data"].ljust(count * mini, b"\0")
    directory = -(-len(nodes) // 4)
    small_table = struct.pack(f"<{len(small_fat)}I", *small_fat)
    bodies = [(None, bytes(directory * size)), ("small", small_table), ("store", small), *((n, n["data"]) for n in nodes if n["kind"] == 2 and len(n["data"]) >= cutoff)]
    chains = [-(-len(data) // size) for _, data in bodies]
    n_fat = n_more = 0
    while n_fat * 128 < sum(chains) + n_fat + n_more:
        n_fat += 1
        n_more = -(-max(0, n_fat - 109) // 127)
    first, fat, starts = n_fat + n_more, [0xFFFFFFFD] * n_fat + [0xFFFFFFFC] * n_more, {}
    for (who, _), count in zip(bodies, chains, strict=True):
        starts[who if isinstance(who, str) else id(who)] = len(fat) if count else end
        fat += [*range(len(fat) + 1, len(fat) + count), end] if count else []
    fat += [free] * (n_fat * 128 - len(fat))

    def entry(n: dict) -> bytes:
        raw = n["name"].encode("utf-16-le")
        start, length = (starts["store"], len(small)) if n["kind"] == 5 else (starts.get(id(n), n.get("start", end)), len(n["data"]))
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII36xIII", len(raw) + 2, n["kind"], 1, n.get("left", free), n.get("right", free), n["child"], start, length, 0)

    bodies[0] = (None, b"".join(map(entry, nodes)).ljust(directory * size, b"\0"))
    lists = [list(range(n_fat))[109 + 127 * k : 109 + 127 * (k + 1)] for k in range(n_more)]
    more = b"".join(struct.pack("<128I", *(x + [free] * 127)[:127], n_fat + k + 1 if k + 1 < n_more else end) for k, x in enumerate(lists))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first, 0, cutoff, starts["small"], chains[1], n_fat if n_more else end, n_more)
    heads = struct.pack("<109I", *(list(range(min(n_fat, 109))) + [free] * 109)[:109])
    return head + heads + struct.pack(f"<{len(fat)}I", *fat) + more + b"".join(data.ljust(count * size, b"\0") for (_, data), count in zip(bodies, chains, strict=True))


def compound(name: str, data: bytes) -> bytes:
    """A compound file with one stream, of at least the size that is kept in whole sectors."""
    return compound_tree({name: data.ljust(4096, b"\0")})


def _xls(rows: list) -> bytes:
    def record(t: int, data: bytes) -> bytes:
        return struct.pack("<HH", t, len(data)) + data

    strings = sorted({x for r in rows for x in r[1:3]})
    blocks, block = [], struct.pack("<II", 2 * len(rows), len(strings))
    for x in strings:
        item = struct.pack("<HB", len(x), 0) + x.encode("latin-1")
        if len(block) + len(item) > 8000:
            blocks, block = [*blocks, block], b""
        block += item
    blocks.append(block)
    sst = b"".join(record(0xFC if i == 0 else 0x3C, b) for i, b in enumerate(blocks))
    name = b"Customers"
    tail = sst + record(0x0A, b"")
    at = len(record(0x809, bytes(16))) + 4 + 8 + len(name) + len(tail)
    out = record(0x809, struct.pack("<HH12x", 0x600, 5)) + record(0x85, struct.pack("<IBBBB", at, 0, 0, len(name), 0) + name) + tail
    out += record(0x809, struct.pack("<HH12x", 0x600, 0x10))
    where = {x: i for i, x in enumerate(strings)}
    for i, r in enumerate(rows):
        out += record(0x27E, struct.pack("<HHHI", i, 0, 0, (r[0] << 2 | 2) & 0xFFFFFFFF))
        out += b"".join(record(0xFD, struct.pack("<HHHI", i, j, 0, where[r[j]])) for j in (1, 2))
        out += record(0x06, struct.pack("<HHHdHIH", i, 3, 0, r[0] + 1, 0, 0, 9) + struct.pack("<BHHBHB", 0x24, i, 0xC000, 0x1E, 1, 0x03))
    return compound("Workbook", out + record(0x0A, b""))


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def _xlsx(rows: list) -> bytes:
    strings = sorted({r[2] for r in rows})
    where = {x: i for i, x in enumerate(strings)}
    body = "".join(f'<row r="{i + 1}"><c r="A{i + 1}"><v>{r[0]}</v></c><c r="B{i + 1}" t="inlineStr"><is><t>{r[1]}</t></is></c><c r="C{i + 1}" t="s"><v>{where[r[2]]}</v></c><c r="D{i + 1}"><f>_xlfn.SUM(A{i + 1},1)</f><v>{r[0] + 1}</v></c></row>' for i, r in enumerate(rows))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return _zip(
        {
            "xl/workbook.xml": f'<?xml version="1.0"?><workbook {main}><sheets><sheet name="Customers" sheetId="1" r:id="rId7"/></sheets><definedNames><definedName name="_xlnm.Print_Area">Customers!$A$1</definedName></definedNames></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Target="worksheets/data.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {main}>{''.join(f'<si><r><t>{x[:3]}</t></r><r><t>{x[3:]}</t></r></si>' for x in strings)}</sst>",
            "xl/worksheets/data.xml": f'<worksheet {main}><cols><col min="1" max="2" width="10"/></cols><sheetData>{body}</sheetData><mergeCells><mergeCell ref="E1:F2"/></mergeCells></worksheet>',
        }
    )


def _ods(rows: list) -> bytes:
    body = "".join(
        f'<table:table-row><table:table-cell office:value-type="float" office:value="{r[0]}"><text:p>{r[0]}</text:p></table:table-cell><table:table-cell office:value-type="string"><text:p>{r[1]}</text:p></table:table-cell>'
        f'<table:table-cell office:value-type="string"><text:p>{r[2]}</text:p></table:table-cell><table:table-cell table:formula="of:=SUM([.A{i + 1}:.B{i + 1}];1)" office:value-type="float" office:value="{r[0] + 1}"><text:p>x</text:p></table:table-cell></table:table-row>'
        for i, r in enumerate(rows)
    )
    return _zip({"content.xml": f'<?xml version="1.0"?><office:document-content><office:body><office:spreadsheet><table:table table:name="C">{body}<table:table-row table:number-rows-repeated="900"><table:table-cell/></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'})


ENCODERS = {"dbf": _dbf, "lotus": _lotus, "xls": _xls, "xlsx": _xlsx, "ods": _ods}


def encoded(rows: DataFrame, encode: Callable[[list[tuple]], bytes]) -> DataFrame:
    """(doc_id, content): a file of the rows (doc_id, ...) of each doc_id, in their order. A task has one file's rows in Python at a time."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        own = own.drop_columns(["doc_id"])
        own = own.sort_by([(c, "ascending") for c in own.column_names])
        content = encode(list(zip(*(c.to_pylist() for c in own.columns), strict=True)))
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([content], pa.binary())})

    return rows.groupBy("doc_id").applyInArrow(run, "doc_id long, content binary")


def binary_docs(spark: SparkSession, sf_dir: str, form: str, where: str = "true") -> DataFrame:
    """(doc_id, content) of the workbooks of paged() as binary files; where: which of them."""
    return encoded(paged(spark, sf_dir).where(where), ENCODERS[form])

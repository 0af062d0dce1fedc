"""Queries on the data sources, split files, table functions, sinks and streams: files of driver tables, written and read again."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cellweave.operators import workbooks
from cellweave.plans.fixtures import ENCODERS, _zip, binary_docs, compound_tree, encoded, rejoined, table, text_docs
from cellweave.sources import delimited, markup, xlsx_parts, zipped
from cellweave.sources.compound import compound_entries
from cellweave.sources.datasource import register, write_files
from cellweave.sources.files import shared_folder
from cellweave.sources.reader import file_errors, scan_files
from cellweave.sources.splits import scan_csv_files
from cellweave.sources.table_functions import register as register_functions
from cellweave.streaming import arrivals

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return add


def stored(spark: SparkSession, files: DataFrame, ext: str | None = None) -> str:
    """A new shared folder with the files (doc_id, content), named by doc_id and extension, or (name, content)."""
    if ext is not None:
        files = files.select(F.concat(F.col("doc_id").cast("string"), F.lit("." + ext)).alias("name"), F.col(files.columns[1]).cast("binary").alias("content"))
    path = shared_folder(spark, "files")
    write_files(files, path)
    return path


def by_name(cells: DataFrame, column: str = "workbook_id") -> DataFrame:
    """Cells under the number that their file is named by."""
    return cells.withColumn(column, F.regexp_extract(column, r"(\d+)\.\w+$", 1).cast("long"))


_SHOWN = ["workbook_id", "row_idx", "col_idx", "v_type", "v_str", "v_num", "formula"]


def _cells_sql(typed: bool, formula: str | None = None, where: str = "true") -> str:
    number = "'number' AS v_type, CAST(NULL AS VARCHAR) AS v_str, CAST(c_custkey AS DOUBLE) AS v_num" if typed else "'string' AS v_type, CAST(c_custkey AS VARCHAR) AS v_str, CAST(NULL AS DOUBLE) AS v_num"
    last = f"UNION ALL SELECT w, i, 3, 'formula', NULL, CAST(c_custkey + 1 AS DOUBLE), {formula} FROM r" if formula else ""
    return f"""WITH r AS (SELECT c_nationkey AS w, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS i, * FROM customer),
x AS (SELECT w AS workbook_id, i AS row_idx, 0 AS col_idx, {number}, CAST(NULL AS VARCHAR) AS formula FROM r
UNION ALL SELECT w, i, 1, 'string', c_name, NULL, NULL FROM r UNION ALL SELECT w, i, 2, 'string', c_mktsegment, NULL, NULL FROM r {last}) SELECT * FROM x WHERE {where}"""


def _sources() -> None:
    forms = {
        "csv": ("csv", False, None), "tsv": ("tsv", False, None), "dif": ("dif", True, None), "slk": ("sylk", True, None), "xml": ("xml", True, None), "html": ("html", False, None), "dbf": ("dbf", True, None), "wk1": ("lotus", True, None),
        "xls": ("xls", True, "'=A' || (i + 1) || '+1'"), "xlsx": ("xlsx", True, "'=SUM(A' || (i + 1) || ',1)'"), "ods": ("ods", True, "'=SUM(A' || (i + 1) || ':B' || (i + 1) || ',1)'"),
    }
    for ext, (form, typed, formula) in forms.items():

        def run(spark: SparkSession, sf_dir: str, ext: str = ext, form: str = form) -> DataFrame:
            path = stored(spark, (binary_docs if form in ENCODERS else text_docs)(spark, sf_dir, form), ext)
            return rejoined(by_name(spark.read.format("cellweave").load(path))).select(*_SHOWN)

        query(_cells_sql(typed, formula), f"source_{ext}")(run)


_sources()


@query(_cells_sql(True, "'=SUM(A' || (i + 1) || ',1)'", "row_idx < 3 AND col_idx <> 1 AND v_num IS NOT NULL"))
def source_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of the first workbook of each nation: rows, columns, sheet and path are the source's filters, the value is Spark's."""
    path = stored(spark, binary_docs(spark, sf_dir, "xlsx", "doc_id % 4294967296 = 0"), "xlsx")
    some = spark.read.format("cellweave").load(path).where("row_idx < 3 and col_idx in (0, 2, 3) and sheet_idx = 0 and workbook_id like '%.xlsx' and v_num is not null")
    return rejoined(by_name(some)).select(*_SHOWN)


_FIELDS = [("OKEY", "N", 12, 0), ("TOTAL", "N", 14, 2), ("RATE", "F", 14, 4), ("PRIO", "C", 15, 0), ("OPEN", "L", 1, 0), ("DAY", "D", 8, 0), ("AT", "T", 8, 0), ("MONEY", "Y", 8, 0), ("CUST", "I", 4, 0), ("X", "B", 8, 0)]


def _orders_dbf(rows: list) -> bytes:
    """Orders as a table with a field of each type; every tenth is marked as deleted."""
    out = [struct.pack("<B3BIHH20x", 0x30, 124, 1, 2, len(rows), 33 + 32 * len(_FIELDS), 1 + sum(f[2] for f in _FIELDS)), *(struct.pack("<11sc4xBB14x", n.encode(), t.encode(), w, d) for n, t, w, d in _FIELDS), b"\r"]
    for key, cents, prio, status, day, days, cust in rows:
        out.append(b"*" if key % 10 == 0 else b" ")
        out.append(f"{key:12d}{cents / 100:14.2f}{cents / 1000:14.4f}{prio:15}{'T' if status == 'O' else 'F' if status == 'F' else '?'}{day}".encode())
        out.append(struct.pack("<IIqid", 2440588 + days, 1000 * (key % 86400), 100 * cents, cust, cents / 8))
    return b"".join(out) + b"\x1a"


@query("""SELECT o_orderkey AS okey, round(o_totalprice * 100) / 100 AS total, round(o_totalprice * 100) / 1000 AS rate, o_orderpriority AS prio, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS open,
CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS moment, round(o_totalprice * 100) / 100 AS money, CAST(o_custkey AS INTEGER) AS cust, round(o_totalprice * 100) / 8 AS x
FROM orders WHERE o_orderkey % 10 <> 0""")
def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of dBase tables, each read by ranges of records. The session's time zone is UTC, as that of the tables is."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 16384).alias("doc_id"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderpriority", "o_orderstatus", F.date_format(day, "yyyyMMdd").alias("day"), F.unix_date(day).alias("days"), "o_custkey")
    path = stored(spark, encoded(o, _orders_dbf), "dbf")
    register(spark)
    t = spark.read.format("cellweave_dbf").option("partitionBytes", str(1 << 18)).load(path)
    return t.select(F.col("OKEY").alias("okey"), F.col("TOTAL").cast("double").alias("total"), F.col("RATE").alias("rate"), F.col("PRIO").alias("prio"), F.col("OPEN").alias("open"), F.col("DAY").cast("string").alias("day"), F.date_format("AT", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.col("MONEY").cast("double").alias("money"), F.col("CUST").alias("cust"), F.col("X").alias("x"))


@query("""SELECT doc_id, replace(text, chr(13), '') AS text FROM documents WHERE text IS NOT NULL AND NOT (starts_with(text, '"') AND ends_with(text, '"'))""")
def scan_csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in delimited files, their newlines inside quotes, read by splits: each row's key beside its text."""
    d = table(spark, sf_dir, "documents").where(~(F.col("text").startswith('"') & F.col("text").endswith('"')))
    path = shared_folder(spark, "splits")
    d.select(F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))).write.text(path)
    cells = scan_csv_files(spark, path)
    rows = cells.groupBy("workbook_id", "row_idx").agg(F.max(F.when(F.col("col_idx") == 0, F.col("v_str"))).cast("long").alias("doc_id"), F.max(F.when(F.col("col_idx") == 1, F.col("v_str"))).alias("text"), F.max("col_idx").alias("last"))
    return rows.where("last = 1").select("doc_id", "text")


@query("""WITH x AS (SELECT n_regionkey AS workbook_id, 'Nations/' || n_name || '/Name' AS path, octet_length(encode(n_name)) AS size FROM nation UNION ALL SELECT n_regionkey, 'Big ' || n_nationkey, 6000 + n_nationkey FROM nation),
s AS (SELECT workbook_id, path, 'stream' AS kind, CAST(size AS BIGINT) AS size FROM x UNION ALL SELECT DISTINCT n_regionkey, 'Nations', 'storage', 0 FROM nation UNION ALL SELECT n_regionkey, 'Nations/' || n_name, 'storage', 0 FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'Root Entry', 'root', 0 FROM nation)
SELECT * FROM s""")
def compound_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a compound file for each region, with a storage and two streams for each of its nations."""

    @F.pandas_udf("binary")
    def encoded(rows: pd.Series) -> pd.Series:
        return pd.Series([compound_tree({k: v for r in x for k, v in ((f"Nations/{r['n_name']}/Name", r["n_name"].encode()), (f"Big {r['n_nationkey']}", b"x" * (6000 + r["n_nationkey"])))}) for x in rows], dtype=object)

    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))
    return compound_entries(n.select("doc_id", encoded("rows").alias("content"))).select("workbook_id", F.regexp_replace("path", "^Root Entry/", "").alias("path"), "kind", "size")


@query("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 + 1 AS w, s_suppkey % 4 + 1 AS h FROM supplier), y AS (SELECT s.*, unnest(range(0, h)) AS y FROM s), x AS (SELECT y.*, unnest(range(0, w)) AS x FROM y)
SELECT k AS workbook_id, CAST(y AS INTEGER) AS row_idx, CAST(x + 1 AS INTEGER) AS col_idx FROM x WHERE x > 0 OR y > 0""")
def html_spanned_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots under spans that reach below the last row: a table of two rows for each supplier."""
    k, text = F.col("s_suppkey"), lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
    html = text("<table><tr><th>a<th>b<tr><td>", k, "<td colspan=", k % 7 + 1, " rowspan=", k % 4 + 1, ">", F.col("s_name"), "</table>")
    t = markup.scan_html(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), html.alias("html")))
    return markup.spanned_slots(t).select("workbook_id", "row_idx", "col_idx")


@query(r"""SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS row_idx, u.line AS v_str FROM (SELECT doc_id, string_split(CASE WHEN t LIKE '%' || chr(10) THEN t[:-2] ELSE t END, chr(10)) AS l FROM (SELECT doc_id, replace(replace(text, chr(13), ''), '"', '') AS t FROM documents WHERE text IS NOT NULL)),
unnest(l) WITH ORDINALITY AS u(line, i)""")
def table_function_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents without quotes, by the table function in SQL, with a delimiter that parts nothing."""
    register_functions(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("cellweave_documents")
    return spark.sql("SELECT d.doc_id, c.row_idx, c.v_str FROM cellweave_documents d, LATERAL scan_cells(replace(d.text, '\"', ''), 'csv', columns => 'row_idx, v_str', delimiter => '||') c")


@query("""SELECT c_nationkey AS workbook_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS row_idx, CAST(c_custkey AS VARCHAR) || '|' || c_name || '||' || c_mktsegment AS cells FROM customer""")
def table_function_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sheets as arrays, by the table function over a partitioned table; a column without cells is a hole."""
    register_functions(spark)
    cells = rejoined(delimited.scan_csv(text_docs(spark, sf_dir, "csv"))).select("workbook_id", F.lit(0).alias("sheet_idx"), "row_idx", F.when(F.col("col_idx") == 2, 3).otherwise(F.col("col_idx")).alias("col_idx"), "v_str")
    cells.createOrReplaceTempView("cellweave_cells")
    rows = spark.sql("SELECT * FROM sheet_rows(TABLE(cellweave_cells) PARTITION BY (workbook_id, sheet_idx) ORDER BY (row_idx, col_idx))")
    return rows.select("workbook_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("""WITH r AS (SELECT c_nationkey AS w, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS i, * FROM customer)
SELECT CAST(w AS VARCHAR) AS workbook_id, 'data' AS part, i AS row_idx, CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || c_mktsegment AS text FROM r
UNION ALL SELECT CAST(w AS VARCHAR), 'merges', i, 'A' || (i + 1) FROM r WHERE i % 3 = 0 UNION ALL SELECT DISTINCT CAST(w AS VARCHAR), 'columns', k, ['key', 'name', 'segment'][k + 1] FROM r, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS k)""")
def workbook_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks with columns, merges and cells, written as JSON files by the sink, read again as JSON."""
    cells = rejoined(delimited.scan_csv(text_docs(spark, sf_dir, "csv")))
    cells = cells.withColumn("sheet_idx", F.lit(0))
    merges = cells.where("col_idx = 0 and row_idx % 3 = 0").select("workbook_id", "sheet_idx", "row_idx", F.concat(F.lit("A"), F.col("row_idx") + 1).alias("address"))
    titles = F.array(*map(F.lit, ("key", "name", "segment")))
    columns = cells.select("workbook_id", "sheet_idx", "col_idx").distinct().withColumn("title", F.get(titles, F.col("col_idx")))
    path = shared_folder(spark, "workbooks")
    workbooks.write_workbooks(workbooks.workbook_lines(cells, merges=(merges, "row_idx"), columns=(columns, "col_idx")), path)
    schema = "worksheets array<struct<columns:array<struct<col_idx:int,title:string>>,merges:array<struct<row_idx:int,address:string>>,data:array<struct<row:int,cells:array<struct<col_idx:int,value:string>>>>>>"
    back = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("workbook_id"), F.explode("worksheets").alias("s"))
    parts = {"data": ("s.data", "x.row", F.array_join(F.col("x.cells.value"), "|")), "merges": ("s.merges", "x.row_idx", F.col("x.address")), "columns": ("s.columns", "x.col_idx", F.col("x.title"))}
    out = [back.select("workbook_id", F.explode(items).alias("x")).select("workbook_id", F.lit(name).alias("part"), F.col(at).alias("row_idx"), text.alias("text")) for name, (items, at, text) in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT n_nationkey AS workbook_id, CASE n_nationkey % 4 WHEN 1 THEN 'sheet1.xml' WHEN 2 THEN 'sheet1.xml' ELSE 'Not a zip archive' END AS part, CAST(0 AS BIGINT) AS n FROM nation WHERE n_nationkey % 4 <> 0
UNION ALL SELECT n_nationkey, NULL, 20 FROM nation WHERE n_nationkey % 4 = 0""")
def damaged_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of which one in four is sound, one has a cut part, one a row without a number and one is cut itself: cells, or what is wrong."""

    @F.pandas_udf("binary")
    def encoded(keys: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            body = "".join(f'<row r="{r + 1}"><c r="A{r + 1}"><v>{k}</v></c><c r="B{r + 1}"><v>{r}</v></c></row>' for r in range(10))
            sheet = f"<worksheet><sheetData>{body}</sheetData></worksheet>"
            sheet = {1: sheet[: len(sheet) // 2], 2: sheet.replace('r="5"', 'r="x"')}.get(k % 4, sheet)
            data = _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="a"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet})
            return data[: len(data) // 2] if k % 4 == 3 else data

        return pd.Series([one(k) for k in keys], dtype=object)

    files = table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".xlsx")).alias("path"), encoded("n_nationkey").alias("content"))
    cells = scan_files(files, {"xlsx"}).groupBy("workbook_id").agg(F.count("*").alias("n")).select("workbook_id", F.lit(None).cast("string").alias("part"), "n")
    part = F.coalesce(F.nullif(F.regexp_extract("message", r"(\w+\.xml)", 1), F.lit("")), F.col("message"))
    errors = file_errors(files).select(F.col("path").alias("workbook_id"), part.alias("part"), F.lit(0).cast("long").alias("n"))
    return by_name(cells.unionByName(errors))


@query("""SELECT n_nationkey AS workbook_id, CAST(u.i - 1 AS INTEGER) AS col_idx, u.v AS v_str FROM nation, unnest(CASE WHEN n_nationkey % 2 = 1 THEN [n_name] ELSE [n_name, 'first'] END) WITH ORDINALITY AS u(v, i)""")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of nations; then those of odd ones are written again with less, and one in four even ones is damaged: the cells as they stand."""
    n = table(spark, sf_dir, "nation")
    folder, out = shared_folder(spark, "arrivals"), shared_folder(spark, "changes")

    def named(ext: str):
        return F.concat(F.col("n_nationkey").cast("string"), F.lit(ext)).alias("name")

    def turn() -> None:
        arrivals.write_changes(arrivals.changes(arrivals.versions(spark, folder)), out, f"{out}-checkpoint").awaitTermination()

    write_files(n.select(named(".csv"), F.concat("n_name", F.lit(",first")).cast("binary").alias("content")), folder)
    turn()
    write_files(n.where("n_nationkey % 2 = 1").select(named(".csv"), F.col("n_name").cast("binary").alias("content")), folder)
    write_files(n.where("n_nationkey % 4 = 0").select(named(".xlsx"), F.lit(b"PK").alias("content")), folder)
    turn()
    cells, _ = arrivals.current(spark, out)
    return by_name(cells).select("workbook_id", "col_idx", "v_str")


_FRAME = '<draw:frame svg:x="1cm" svg:y="2in" svg:width="{w}px" svg:height="10pt" draw:z-index="{z}">{inner}</draw:frame>'


@F.pandas_udf(BinaryType())
def _drawn_ods(keys: pd.Series) -> pd.Series:
    """A sheet with an image in its second column, a chart in its third row, and a comment."""

    def one(k: int) -> bytes:
        image = _FRAME.format(w=k + 1, z=k, inner=f'<draw:image xlink:href="Pictures/{k}.png"/>')
        chart = _FRAME.format(w=9, z=0, inner='<draw:object xlink:href="./Object 1"/><draw:image xlink:href="./ObjectReplacements/Object 1"/>')
        note = f'<office:annotation office:display="true"><dc:creator>A{k}</dc:creator><dc:date>2024-01-0{k % 9 + 1}</dc:date><text:p>one</text:p><text:p>n{k}</text:p></office:annotation>'
        rows = f'<table:table-row><table:table-cell/><table:table-cell>{image}</table:table-cell></table:table-row><table:table-row table:number-rows-repeated="{k + 1}"><table:table-cell/></table:table-row><table:table-row><table:table-cell table:number-columns-repeated="3"/><table:table-cell>{note}{chart}</table:table-cell></table:table-row>'
        return _zip({"content.xml": f'<office:document-content><office:body><office:spreadsheet><table:table table:name="a">{rows}</table:table></office:spreadsheet></office:body></office:document-content>'})

    return pd.Series([one(k) for k in keys], dtype=object)


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), _drawn_ods((F.col("s_suppkey") % 40).cast("long")).alias("content"))


_GUID = "(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) FROM (SELECT upper(md5(s_suppkey || '/0/' || nth)) AS h))"


@query(f"""WITH s AS (SELECT s_suppkey, s_suppkey % 40 AS k FROM supplier), m AS (SELECT *, 0 AS nth, 0 AS row_idx, 1 AS col_idx, 'image' AS kind, 'Pictures/' || k || '.png' AS href, k + 1 AS width, k AS z_index FROM s
UNION ALL SELECT *, 1, CAST(k + 2 AS INTEGER), 3, 'chart', './Object 1', 9, 0 FROM s)
SELECT s_suppkey AS workbook_id, row_idx, col_idx, kind, href, 37.795::DOUBLE AS "left", 192.0::DOUBLE AS top, CAST(width AS DOUBLE) AS width, 10 * 7.15::DOUBLE AS height, CAST(z_index AS INTEGER) AS z_index, {_GUID} AS id FROM m""")
def ods_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipped.ods_media(drawn(spark, sf_dir)).select("workbook_id", "row_idx", "col_idx", "kind", "href", "left", "top", "width", "height", "z_index", "id")


@query("""SELECT s_suppkey AS workbook_id, CAST(s_suppkey % 40 + 2 AS INTEGER) AS row_idx, 3 AS col_idx, 'A' || (s_suppkey % 40) AS author, '2024-01-0' || (s_suppkey % 40 % 9 + 1) AS date, 'one' || chr(10) || 'n' || (s_suppkey % 40) AS text, true AS visible FROM supplier""")
def ods_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipped.ods_comments(drawn(spark, sf_dir)).select("workbook_id", "row_idx", "col_idx", "author", "date", "text", "visible")


@F.pandas_udf(BinaryType())
def _ruled_xlsx(keys: pd.Series) -> pd.Series:
    """A sheet whose dimension, merged range and cell each reach farthest for one key in three, with rules."""

    def one(k: int) -> bytes:
        far = [5, 5, 5]
        far[k % 3] = 10 + k
        rules = f'<dataValidations><dataValidation type="whole" sqref="A1:A{k + 1}" errorStyle="{"warning" if k % 2 else "stop"}"><formula1>1</formula1></dataValidation></dataValidations>'
        cond = f'<conditionalFormatting sqref="B1:B{k + 1}"><cfRule type="cellIs" operator="equal" priority="1"><formula>1</formula></cfRule></conditionalFormatting>'
        sheet = f'<worksheet><dimension ref="A1:B{far[0]}"/><sheetData><row r="{far[1]}"><c r="A{far[1]}"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:C{far[2]}"/></mergeCells>{cond}{rules}</worksheet>'
        return _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/worksheets/sheet1.xml": sheet})

    return pd.Series([one(k) for k in keys], dtype=object)


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), _ruled_xlsx((F.col("s_suppkey") % 50).cast("long")).alias("content"))


@query("SELECT s_suppkey AS workbook_id, CAST(9 + s_suppkey % 50 AS INTEGER) AS max_row, 2 AS max_col FROM supplier")
def xlsx_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sheets reach by cells, merged ranges and stated dimensions."""
    return xlsx_parts.xlsx_bounds(ruled(spark, sf_dir)).select("workbook_id", "max_row", "max_col")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 50 AS k FROM supplier) SELECT s_suppkey AS workbook_id, 'S!A1:A' || (k + 1) AS range, 'validation' AS kind, 'whole' AS type, CASE WHEN k % 2 = 1 THEN 'warning' ELSE 'reject' END AS action FROM s
UNION ALL SELECT s_suppkey, 'S!B1:B' || (k + 1), 'format', 'cellIs', 'format' FROM s""")
def xlsx_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validations and conditional formats of all sheets together."""
    return xlsx_parts.xlsx_rules(ruled(spark, sf_dir)).select("workbook_id", "range", "kind", "type", "action")


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), r AS (SELECT k, CAST(unnest(range(0, k % 4 + 1)) AS INTEGER) AS y FROM s), c AS (SELECT k, y, CAST(unnest(range(0, k % 4 + 1)) AS INTEGER) AS x FROM r)
SELECT k AS workbook_id, y AS row_idx, x AS col_idx, CASE WHEN x <= y THEN y || '.' || x ELSE '' END AS v_str, chr(CAST(65 + x AS INTEGER)) AS title FROM c""")
def csv_rectangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged text as rectangles, with the letters of their columns."""
    k = F.col("s_suppkey").cast("int")
    line = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), y), lambda x: F.concat(y.cast("string"), F.lit("."), x.cast("string"))), ",")
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), k % 4), line), "\n").alias("text"))
    cells, columns = delimited.csv_sheet(docs)
    return cells.join(columns.select("workbook_id", "sheet_idx", "col_idx", "title"), ["workbook_id", "sheet_idx", "col_idx"]).select("workbook_id", "row_idx", "col_idx", "v_str", "title")

"""Every query of the spreadsheet engine with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions import colors, formulas, palettes, refs, text, units
from cellweave.operators import relational as R
from cellweave.plans import intake, looks
from cellweave.plans.fixtures import binary_docs, rejoined, table, text_docs
from cellweave.plans.showcase import showcase
from cellweave.sources import binary, delimited, markup, xlsx_parts, zipped

QUERIES: dict[str, Callable] = looks.QUERIES | intake.QUERIES
ORACLES: dict[str, str] = looks.ORACLES | intake.ORACLES


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# scalar functions, over part: n is the key, p_size 1 to 50


def _letters(n: str) -> str:
    """SQL letters of a 0-based column below 18278."""
    return f"""CASE WHEN {n} < 26 THEN chr(CAST(65 + {n} AS INTEGER)) WHEN {n} < 702 THEN chr(CAST(64 + {n} // 26 AS INTEGER)) || chr(CAST(65 + {n} % 26 AS INTEGER))
    ELSE chr(CAST(65 + ({n} - 702) // 676 AS INTEGER)) || chr(CAST(65 + ({n} - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + ({n} - 702) % 26 AS INTEGER)) END"""


def part(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("n", F.col("p_partkey") % 16384)


_PART = "(SELECT *, p_partkey % 16384 AS n FROM part)"


@query(f"SELECT p_partkey, {_letters('n')} AS name FROM {_PART}")
def fn_column_name(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", refs.column_name("n").alias("name"))


@query(f"SELECT p_partkey, CAST(n AS INTEGER) AS idx FROM {_PART}")
def fn_column_index(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", refs.column_index(refs.column_name("n")).alias("idx"))


@query(f"SELECT p_partkey, {_letters('n')} || (p_size + 1) AS name FROM {_PART}")
def fn_cell_name(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", refs.cell_name("n", "p_size").alias("name"))


@query(f"SELECT p_partkey, CAST(n AS INTEGER) AS col_idx, p_size AS row_idx FROM {_PART}")
def fn_coords_from_cell(spark, sf_dir):
    c = refs.coords(F.concat(F.lit("$"), refs.column_name("n"), F.lit("$"), F.col("p_size") + 1))
    return part(spark, sf_dir).select("p_partkey", c["col"].alias("col_idx"), c["row"].alias("row_idx"))


@query(f"SELECT p_partkey, CAST(n AS INTEGER) AS x1, p_size - 1 AS y1, CAST(n + 3 AS INTEGER) AS x2, p_size + 1 AS y2 FROM {_PART}")
def fn_range_coords(spark, sf_dir):
    ref = F.concat(F.lit("'My Sheet'!"), refs.cell_name("n", F.col("p_size") - 1), F.lit(":"), refs.cell_name(F.col("n") + 3, F.col("p_size") + 1))
    r = refs.range_coords(ref)
    return part(spark, sf_dir).select("p_partkey", *(r[c].alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"SELECT p_partkey, 'S!' || {_letters('x')} || (y + 1) AS token FROM (SELECT p_partkey, n + i AS x, p_size + j AS y FROM {_PART}, generate_series(0, 2) a(i), generate_series(0, 1) b(j))")
def fn_range_expand(spark, sf_dir):
    n, s = F.col("n"), F.col("p_size")
    return part(spark, sf_dir).select("p_partkey", F.explode(refs.range_tokens(n, s, n + 2, s + 1, F.lit("S"))).alias("token"))


@query(r"SELECT p_partkey, regexp_full_match(t, '(''[^'':]+''!|[A-Za-z0-9_.]+!)?(\$?[A-Z]{1,3}\$?[0-9]+(:\$?[A-Z]{1,3}\$?[0-9]+)?|\$?[A-Z]{1,3}:\$?[A-Z]{1,3}|\$?[0-9]+:\$?[0-9]+)') AS ok FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'Sheet1!$A$' || p_size END AS t FROM part)")
def fn_is_token(spark, sf_dir):
    t = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("Sheet1!$A$"), "p_size"))
    return part(spark, sf_dir).select("p_partkey", refs.is_token(t).alias("ok"))


@query("SELECT p_partkey, '=SEARCH($C$2,' || chr(CAST(66 + p_size % 20 AS INTEGER)) || (p_size + 2) || ')+A$' || p_size AS a1 FROM part")
def fn_r1c1(spark, sf_dir):
    f = F.concat(F.lit("=SEARCH(R2C3,R[1]C[1])+R"), "p_size", F.lit("C[-"), F.col("p_size") % 20, F.lit("]"))
    return part(spark, sf_dir).select("p_partkey", formulas.r1c1_to_a1(f, F.col("p_size"), F.col("p_size") % 20).alias("a1"))


@query("SELECT p_partkey, CAST(floor(p_retailprice * 8.43::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS px_char, CAST(floor(p_size * 7.15::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS px_pt FROM part")
def fn_width_px(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", units.width_px(F.col("p_retailprice"), F.lit("char")).alias("px_char"), units.width_px(F.col("p_size")).alias("px_pt"))


@query("SELECT p_partkey, CAST(floor(p_partkey * 1000 / 9525.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS px FROM part")
def fn_emu_px(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", units.emu_px(F.col("p_partkey") * 1000).alias("px"))


_RGB = "(SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r, CAST(p_partkey * 7 % 256 AS INTEGER) AS g, CAST(p_size * 5 AS INTEGER) AS b FROM part)"


def rgb(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir).select("p_partkey", (F.col("p_partkey") % 256).cast("int").alias("r"), (F.col("p_partkey") * 7 % 256).cast("int").alias("g"), (F.col("p_size") * 5).cast("int").alias("b"))


@query(f"SELECT p_partkey, printf('%02X%02X%02X', r, g, least(b + 100, 255)) AS hex FROM {_RGB}")
def fn_rgb_hex(spark, sf_dir):
    return rgb(spark, sf_dir).select("p_partkey", colors.rgb_hex(F.col("r"), F.col("g"), F.col("b") + 100).alias("hex"))


@query(f"SELECT p_partkey, r, g, b FROM {_RGB}")
def fn_hex_rgb(spark, sf_dir):
    c = colors.hex_rgb(F.concat(F.lit("#"), colors.rgb_hex(F.col("r"), F.col("g"), F.col("b"))))
    return rgb(spark, sf_dir).select("p_partkey", *(c[x].alias(x) for x in "rgb"))


@query(f"SELECT p_partkey, r, g, b, round((greatest(r, g, b) + least(r, g, b)) / 510.0::DOUBLE, 9) AS light FROM {_RGB}")
def fn_rgb_hsl(spark, sf_dir):
    """There and back again: the components, and the lightness on the way."""
    c = colors.rgb_hsl(F.col("r"), F.col("g"), F.col("b"))
    back = colors.hsl_rgb(c)
    return rgb(spark, sf_dir).select("p_partkey", *(back[x].alias(x) for x in "rgb"), F.round(c["l"], 9).alias("light"))


@query(f"SELECT p_partkey, printf('%02X%02X%02X', CAST(floor(102.5::DOUBLE + r * 0.6::DOUBLE) AS INTEGER), CAST(floor(102.5::DOUBLE + r * 0.6::DOUBLE) AS INTEGER), CAST(floor(102.5::DOUBLE + r * 0.6::DOUBLE) AS INTEGER)) AS lighter FROM {_RGB}")
def fn_tint(spark, sf_dir):
    """Tints of greys; two fifths of the way to white."""
    r = F.col("r")
    return rgb(spark, sf_dir).select("p_partkey", colors.tint(colors.rgb_hex(r, r, r), F.lit(0.4)).alias("lighter"))


@query("SELECT p_partkey, replace(replace(replace(replace(replace(t, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&apos;', '''') AS t FROM (SELECT p_partkey, '&quot;' || p_name || '&amp;lt;&gt;&apos;' AS t FROM part)")
def fn_decode_entities(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", text.decode_entities(F.concat(F.lit("&quot;"), "p_name", F.lit("&amp;lt;&gt;&apos;"))).alias("t"))


@query("SELECT p_partkey, '=SUM(A' || p_size || ')' AS f FROM part")
def fn_clean_formula(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", text.with_equals(text.clean_formula(F.concat(F.lit("_xlfn.SUM(A"), "p_size", F.lit(")")))).alias("f"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS whole, CAST(p_size AS DOUBLE) AS prefix FROM part")
def fn_number_text(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", units.number_text(F.col("p_partkey").cast("double")).alias("whole"), units.number_prefix(F.concat("p_size", F.lit("px"))).alias("prefix"))


@query("SELECT p_partkey, 'SUM(' || p_size || ',3)+B' || p_size || '*(' || p_size || '>=2)' AS f FROM part")
def ptg_decode(spark, sf_dir):
    def token(head: str, value, size: int, tail: str = ""):
        low = F.lpad(F.hex(value % 256), 2, "0")
        return F.concat(F.lit(head), low, F.lpad(F.hex(F.floor(value / 256).cast("long")), 2, "0") if size == 2 else F.lit(""), F.lit(tail))

    n = F.col("p_size").cast("long")
    tokens = F.concat(token("1E", n, 2), F.lit("1E0300"), F.lit("22020400"), token("44", n - 1, 2, "01C0"), token("1E", n, 2), F.lit("1E0200"), F.lit("0C15"), F.lit("0503"))
    zero = F.lit(0)
    return part(spark, sf_dir).select("p_partkey", formulas.ptg_decode(F.unhex(tokens), zero, zero, zero, zero).alias("f"))


#: Hexadecimal tokens of one formula each, and what they decompile to in the fifth row and third column.
_TOKENS = {
    "1E02001E0300215101": "POWER(2,3)", "1E01001E02001E0300213D00": "MIRR(1,2,3)", "211300": "PI()", "161E030022020400": "SUM(,3)", "1E010022017101": "FUNC369(1)",
    "3A0100000000C01E010003": "SHEET2!A1+1", "3B00000000010000C001C0": "SHEET1!A1:B2", "3C000000000000": "#REF!", "23050000001E020005": "NAME5*2", "2A00000000": "#REF!", "2000000000000000": "{}",
    "1F000000000000F07F": "#NUM!", "1F000000000000F83F": "1.5", "170300616263": '"abc"', "1702016100E700": '"aç"', "1C2A": "#N/A", "1D01": "TRUE", "1E070013": "-7", "1E070014": "7%", "1E070015": "(7)",
    "2500000300004001C0": "C$1:D8", "2CFFFFFFC0": "B4", "440000000019100000": "SUM($A$1)", "1E07001E080011": "7:8", "1E01001E020010": "1,2", "1E01001E020009": "1<2", "1E01001E020008": "1&2", "03": "0+0",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS tokens, '{v}' AS f" for k, v in _TOKENS.items()))
def ptg_token_classes(spark, sf_dir):
    """A formula of each class of tokens."""
    one = F.explode(F.array(*map(F.lit, _TOKENS))).alias("tokens")
    return table(spark, sf_dir, "region").where("r_regionkey = 0").select(one).select("tokens", formulas.ptg_decode(F.unhex("tokens"), F.lit(4), F.lit(2), F.lit(0), F.lit(0)).alias("f"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN '=B' || (p_size + 1) END AS a1 FROM part")
def fn_r1c1_nulls(spark, sf_dir):
    """A null place gives null."""
    row = F.when(F.col("p_size") % 3 > 0, F.col("p_size"))
    return part(spark, sf_dir).select("p_partkey", formulas.r1c1_to_a1(F.lit("=RC2"), row, F.lit(0)).alias("a1")).withColumn("a1", F.replace("a1", F.lit("$"), F.lit("")))


@query("SELECT p_partkey, CASE p_size % 13 WHEN 0 THEN 'FFFFFF' WHEN 1 THEN '000000' WHEN 4 THEN '4472C4' WHEN 11 THEN '954F72' END AS theme, CASE p_size % 3 WHEN 0 THEN 'ED7D31' WHEN 1 THEN '44546A' END AS scheme, CASE p_size WHEN 8 THEN '000000' WHEN 2 THEN 'FF0000' WHEN 10 THEN 'FF0000' WHEN 22 THEN 'C0C0C0' END AS indexed FROM part")
def fn_theme_colors(spark, sf_dir):
    """Colours by theme number, theme name and index; only those that the SQL lists."""
    n = F.col("p_size") % 13
    name = F.get(F.array(F.lit("accent2"), F.lit("tx2"), F.lit("other")), F.col("p_size") % 3)
    return part(spark, sf_dir).select(
        "p_partkey", F.when(n.isin(0, 1, 4, 11, 12), palettes.theme_color(n)).alias("theme"), palettes.scheme_color(name).alias("scheme"), F.when(F.col("p_size").isin(2, 8, 10, 22), palettes.indexed_color(F.col("p_size"))).alias("indexed"),
    )


# scans: customers of each nation as a workbook, read back


def _scan_sql(typed: bool, formula: str | None = None, first: int = 0) -> str:
    number = "'number' AS v_type, CAST(NULL AS VARCHAR) AS v_str, CAST(c_custkey AS DOUBLE) AS v_num" if typed else "'string' AS v_type, CAST(c_custkey AS VARCHAR) AS v_str, CAST(NULL AS DOUBLE) AS v_num"
    last = f"UNION ALL SELECT w, i, 3, 'formula', NULL, CAST(c_custkey + 1 AS DOUBLE), {formula} FROM r" if formula else ""
    return f"""WITH r AS (SELECT c_nationkey AS w, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 + {first} AS INTEGER) AS i, * FROM customer)
SELECT w AS workbook_id, i AS row_idx, 0 AS col_idx, {number}, CAST(NULL AS VARCHAR) AS formula FROM r
UNION ALL SELECT w, i, 1, 'string', c_name, NULL, NULL FROM r UNION ALL SELECT w, i, 2, 'string', c_mktsegment, NULL, NULL FROM r {last}"""


_SHOWN = ["workbook_id", "row_idx", "col_idx", "v_type", "v_str", "v_num", "formula"]


def _scans() -> None:
    texts = {
        "scan_csv": ("csv", lambda d: delimited.scan_csv(d), False), "scan_tsv": ("tsv", lambda d: delimited.scan_csv(d, delimiter="\t"), False),
        "scan_csv_semicolon": ("semicolon", lambda d: delimited.scan_csv(d, delimiter=";"), False), "scan_csv_quoted": ("quoted", lambda d: delimited.scan_csv(d), False),
        "scan_html": ("html", lambda d: markup.scan_html(d, html="text"), False), "scan_xml2003": ("xml", lambda d: markup.scan_xml2003(d, xml="text"), True),
        "scan_dif": ("dif", delimited.scan_dif, True), "scan_sylk": ("sylk", delimited.scan_sylk, True),
    }
    for name, (form, scan, typed) in texts.items():
        query(_scan_sql(typed), name)(lambda spark, sf_dir, form=form, scan=scan: rejoined(scan(text_docs(spark, sf_dir, form))).select(*_SHOWN))
    files = {
        "scan_dbf": ("dbf", binary.scan_dbf, None), "scan_lotus": ("lotus", binary.scan_lotus, None), "scan_xls": ("xls", binary.scan_xls, "'=A' || (i + 1) || '+1'"),
        "scan_xlsx": ("xlsx", zipped.scan_xlsx, "'=SUM(A' || (i + 1) || ',1)'"), "scan_ods": ("ods", zipped.scan_ods, "'=SUM(A' || (i + 1) || ':B' || (i + 1) || ',1)'"),
    }
    for name, (form, scan, formula) in files.items():
        query(_scan_sql(True, formula), name)(lambda spark, sf_dir, form=form, scan=scan: rejoined(scan(binary_docs(spark, sf_dir, form))).select(*_SHOWN))


_scans()


@query(r"""WITH d AS (SELECT doc_id, replace(text, chr(13), '') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS workbook_id, 0 AS row_idx, 0 AS col_idx, CASE WHEN t = '' THEN 'empty' ELSE 'string' END AS v_type, t AS v_str FROM d""")
def scan_csv_documents(spark, sf_dir):
    """Whole documents as one quoted cell each."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    d = d.select("doc_id", F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')).alias("text"))
    return delimited.scan_csv(d).select("workbook_id", "row_idx", "col_idx", "v_type", "v_str")


@query("SELECT page_id AS workbook_id, 'no table' AS message FROM pages WHERE html IS NULL OR NOT contains(lower(html), '<table')")
def scan_html_errors(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    some = markup.html_cells(p, "page_id").select(F.col("workbook_id").alias("page_id")).distinct()
    return p.join(some, "page_id", "left_anti").select(F.col("page_id").alias("workbook_id"), F.lit("no table").alias("message"))


@query("SELECT c_nationkey AS workbook_id, 'A' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)) AS address, 2 AS colspan, 1 AS rowspan FROM customer")
def scan_html_spans(spark, sf_dir):
    d = text_docs(spark, sf_dir, "html").withColumn("text", F.replace("text", F.lit("<tr><td>"), F.lit("<tr><td colspan=2>")))
    return markup.merges(rejoined(markup.scan_html(d, html="text"))).select("workbook_id", "address", "colspan", "rowspan")


# transforms, over line items as sparse sheets: 16 workbooks, an order a row

_CELLS = """(SELECT CAST(l_orderkey % 16 AS INTEGER) AS workbook_id, 0 AS sheet_idx, CAST(l_orderkey // 16 AS INTEGER) AS row_idx, l_linenumber - 1 AS col_idx, max(l_quantity) AS v, max(l_discount) AS d FROM lineitem GROUP BY ALL)"""


def sparse(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).cast("int").alias("workbook_id"), F.lit(0).alias("sheet_idx"), F.floor(F.col("l_orderkey") / 16).cast("int").alias("row_idx"), (F.col("l_linenumber") - 1).alias("col_idx"), "l_quantity", "l_discount")
    return t.groupBy("workbook_id", "sheet_idx", "row_idx", "col_idx").agg(F.max("l_quantity").alias("v"), F.max("l_discount").alias("d"))


_BOUNDS = f"(SELECT workbook_id, sheet_idx, max(row_idx) AS max_row, max(col_idx) AS max_col FROM {_CELLS} GROUP BY ALL)"


@query(f"SELECT * FROM {_BOUNDS}")
def r1_bounds(spark, sf_dir):
    return R.bounds(sparse(spark, sf_dir))


@query(f"""WITH b AS {_BOUNDS}, s AS (SELECT b.workbook_id, b.sheet_idx, CAST(r AS INTEGER) AS row_idx, CAST(c AS INTEGER) AS col_idx FROM b, unnest(generate_series(0, max_row)) x(r), unnest(generate_series(0, max_col)) y(c))
SELECT s.*, coalesce(t.v, 0.0::DOUBLE) AS v FROM s LEFT JOIN {_CELLS} t USING (workbook_id, sheet_idx, row_idx, col_idx)""")
def r2_densify(spark, sf_dir):
    return R.densify(sparse(spark, sf_dir), "v", 0.0)


@query(f"""WITH t AS {_CELLS} SELECT workbook_id, row_idx, {" || '|' || ".join(f"coalesce(CAST(CAST(max(CASE WHEN col_idx = {i} THEN v END) AS INTEGER) AS VARCHAR), '')" for i in range(7))} AS cells FROM t GROUP BY ALL""")
def r3_pivot(spark, sf_dir):
    t = sparse(spark, sf_dir).withColumn("v", F.col("v").cast("int"))
    return R.grid(t, "v").select("workbook_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS workbook_id, i AS sheet_idx, CASE WHEN i = 0 THEN 7 ELSE 1 END AS n, CASE WHEN i = 0 THEN 'Main' ELSE 'Hid' END AS sheet_name FROM nation, (SELECT unnest([0, 1]) AS i)")
def r4_sheet_groups(spark, sf_dir):
    """Cells of the sheets of workbooks, by sheet."""
    d = showcase(spark, sf_dir, "xlsx")
    n = zipped.scan_xlsx(d).groupBy("workbook_id", "sheet_idx").agg(F.count("*").alias("n"))
    return n.join(zipped.xlsx_worksheets(d).select("workbook_id", "sheet_idx", "sheet_name"), ["workbook_id", "sheet_idx"])


@query("SELECT c_nationkey AS workbook_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS row_idx, c_mktsegment AS v_str FROM customer")
def r5_sst_lookup(spark, sf_dir):
    """Cells whose text is a number of the string table."""
    return rejoined(zipped.scan_xlsx(binary_docs(spark, sf_dir, "xlsx"))).where("col_idx = 2").select("workbook_id", "row_idx", "v_str")


@query("""SELECT CAST(n_nationkey AS BIGINT) AS workbook_id, r AS row_idx, c AS col_idx, CASE x WHEN 1 THEN '0.000 "k"' WHEN 2 THEN 'mm-dd-yy' ELSE 'General' END AS number_format
FROM nation, (VALUES (0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, 0), (1, 2, 0), (1, 3, 0), (3, 0, 0)) v(r, c, x)""")
def r6_style_join(spark, sf_dir):
    """Cells with the number format of their style index."""
    d = showcase(spark, sf_dir, "xlsx")
    cells = zipped.scan_xlsx(d).where("sheet_idx = 0").join(xlsx_parts.xlsx_styles(d), ["workbook_id", "xf"], "left")
    return cells.select("workbook_id", "row_idx", "col_idx", "number_format")


@query("SELECT c_custkey, o.target FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS target FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def r7_rel_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("target"))
    return R.first_match(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], "o_orderkey", "target")


@query(f"""WITH r AS (SELECT CAST(s_suppkey % 16 AS INTEGER) AS workbook_id, s_suppkey * 3 AS r1, s_suppkey * 3 + 5 AS r2, 1 AS c1, 3 AS c2, s_suppkey FROM supplier)
SELECT t.workbook_id, t.row_idx, t.col_idx, min(s_suppkey) AS s_suppkey FROM {_CELLS} t LEFT JOIN r ON r.workbook_id = t.workbook_id AND t.row_idx BETWEEN r1 AND r2 AND t.col_idx BETWEEN c1 AND c2 GROUP BY ALL""")
def r8_range_join(spark, sf_dir):
    s = F.col("s_suppkey")
    r = table(spark, sf_dir, "supplier").select((s % 16).cast("int").alias("workbook_id"), (s * 3).alias("r1"), (s * 3 + 5).alias("r2"), F.lit(1).alias("c1"), F.lit(3).alias("c2"), s)
    return R.range_join(sparse(spark, sf_dir), r, ["workbook_id"], "s_suppkey").select("workbook_id", "row_idx", "col_idx", "s_suppkey")


_CSS = f"""(SELECT *, concat_ws('; ', 'border-left: 1px', CASE WHEN v > 25 THEN 'border-right: 1px' END, 'border-top: 1px', CASE WHEN d > 0.05 THEN 'border-bottom: 1px' END) AS css FROM {_CELLS})"""


def styled(spark, sf_dir) -> DataFrame:
    css = F.concat_ws("; ", F.lit("border-left: 1px"), F.when(F.col("v") > 25, "border-right: 1px"), F.lit("border-top: 1px"), F.when(F.col("d") > 0.05, "border-bottom: 1px"))
    return sparse(spark, sf_dir).withColumn("css", css)


@query(f"""WITH t AS {_CSS}, f AS (SELECT workbook_id, css, min(row_idx * 100 + col_idx) AS first FROM t GROUP BY ALL), s AS (SELECT *, CAST(row_number() OVER (PARTITION BY workbook_id ORDER BY first) - 1 AS INTEGER) AS style_idx FROM f)
SELECT workbook_id, row_idx, col_idx, style_idx FROM t JOIN s USING (workbook_id, css)""")
def r9_style_dictionary(spark, sf_dir):
    return R.style_dictionary(styled(spark, sf_dir))[1].select("workbook_id", "row_idx", "col_idx", "style_idx")


@query(f"""WITH t AS {_CSS} SELECT t.workbook_id, t.row_idx, t.col_idx, concat_ws('; ', CASE WHEN l.v > 25 THEN NULL ELSE 'border-left: 1px' END, CASE WHEN t.v > 25 THEN 'border-right: 1px' END, CASE WHEN u.d > 0.05 THEN NULL ELSE 'border-top: 1px' END, CASE WHEN t.d > 0.05 THEN 'border-bottom: 1px' END) AS css
FROM t LEFT JOIN t l ON l.workbook_id = t.workbook_id AND l.row_idx = t.row_idx AND l.col_idx = t.col_idx - 1 LEFT JOIN t u ON u.workbook_id = t.workbook_id AND u.col_idx = t.col_idx AND u.row_idx = t.row_idx - 1""")
def r10_border_dedup(spark, sf_dir):
    return R.border_dedup(styled(spark, sf_dir)).select("workbook_id", "row_idx", "col_idx", "css")


@query("SELECT s_suppkey, CAST(r AS BIGINT) AS row_idx, CAST(c AS INTEGER) AS col_idx FROM supplier, unnest(generate_series(s_suppkey, s_suppkey + 3)) x(r), unnest(generate_series(1, 4)) y(c)")
def r11_range_explode(spark, sf_dir):
    s = F.col("s_suppkey")
    return R.range_explode(table(spark, sf_dir, "supplier").select(s, s.alias("r1"), (s + 3).alias("r2"), F.lit(1).alias("c1"), F.lit(4).alias("c2")))


@query("""WITH r AS (SELECT p_brand, p_partkey, p_size % 4 AS k, coalesce(sum(p_size % 4) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM part)
SELECT p_brand, p_partkey, CAST(i AS BIGINT) AS at FROM r, unnest(generate_series(CAST(a AS BIGINT), CAST(a + k - 1 AS BIGINT))) t(i) WHERE k > 0""")
def r12_repeat_explode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 4).alias("k"))
    return R.repeat_explode(p, ["p_brand"], "p_partkey", "k", "at").select("p_brand", "p_partkey", "at")


@query(f"WITH t AS {_CELLS} SELECT b.workbook_id, b.row_idx - 1 AS row_idx, b.col_idx, coalesce(CAST(h.v AS INTEGER)::VARCHAR, chr(65 + b.col_idx)) AS title FROM t b LEFT JOIN t h ON h.workbook_id = b.workbook_id AND h.col_idx = b.col_idx AND h.row_idx = 0 WHERE b.row_idx > 0")
def r13_header_promote(spark, sf_dir):
    t = sparse(spark, sf_dir).withColumn("v_str", F.col("v").cast("int").cast("string"))
    return R.header_promote(t).select("workbook_id", "row_idx", "col_idx", "title")


@query("SELECT n_name AS sheet_name, CASE WHEN n_regionkey = 0 THEN 'X!A' || n_nationkey ELSE n_name || '!A' || n_nationkey END AS range FROM nation UNION ALL SELECT r_name, r_name || '!B' || r_regionkey FROM region")
def r14_validation_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("sheet_name"), F.concat(F.when(F.col("n_regionkey") == 0, "X!A").otherwise("A"), "n_nationkey").alias("range"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("sheet_name"), F.concat(F.lit("B"), "r_regionkey").alias("range"))
    return R.validation_union(n, r)


@query("SELECT l_partkey, min(l_linenumber) AS c1, max(l_linenumber + 1) AS c2, min(l_orderkey) AS r1, max(l_orderkey + 2) AS r2 FROM lineitem GROUP BY l_partkey")
def r15_bounding_box(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("r1"), (F.col("l_orderkey") + 2).alias("r2"), F.col("l_linenumber").alias("c1"), (F.col("l_linenumber") + 1).alias("c2"))
    return R.bounding_box(t, ["l_partkey"])


@query("SELECT c_nationkey AS workbook_id, count(*) AS n, count(*) AS n_deleted FROM customer GROUP BY c_nationkey")
def r16_deleted_filter(spark, sf_dir):
    """Records of the dBase files: each customer once live, once deleted."""
    r = binary.dbf_records(binary_docs(spark, sf_dir, "dbf"))
    return r.groupBy(F.shiftright("workbook_id", 32).alias("workbook_id")).agg(F.count_if(~F.col("deleted")).alias("n"), F.count_if("deleted").alias("n_deleted"))


@query(f"SELECT workbook_id, CAST(c AS INTEGER) AS col_idx, chr(CAST(65 + c AS INTEGER)) AS title, CASE WHEN c = workbook_id % 5 THEN 55.5 ELSE 100.0 END::DOUBLE AS width_px FROM {_BOUNDS}, unnest(generate_series(0, max_col)) t(c)")
def r17_default_columns(spark, sf_dir):
    t = sparse(spark, sf_dir)
    own = t.select("workbook_id", "sheet_idx").distinct().select("workbook_id", "sheet_idx", (F.col("workbook_id") % 5).alias("col_idx"), F.lit(55.5).alias("width_px"))
    return R.default_columns(t, own).select("workbook_id", "col_idx", "title", "width_px")


@query("SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM events")
def r18_sticky_cursor(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("kind"))
    return R.sticky(e, ["user_id"], "at", "kind", segment=F.unix_date(F.to_date("at.ts"))).select("event_id", "kind")


# relational work on scanned data is ordinary Spark


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def native_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def native_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def native_semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def native_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS rk, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def native_windows(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderstatus")).alias("rk"), F.lag("o_orderkey").over(w).alias("before"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def native_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("(SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT s_suppkey FROM supplier")
def native_set_operations(spark, sf_dir):
    c, o, s = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey")))
    return c.intersect(o).subtract(s)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def native_session_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def native_tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")

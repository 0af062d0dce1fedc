"""Queries of looks and parts over the showcase workbooks, with SQL over nation that states what each holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.plans.showcase import showcase
from cellweave.sources import binary, delimited, encodings, markup, ods_styles, reader, xls_styles, xlsx_parts, zipped

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
K, N = "n_nationkey", "n_name"
HEX = f"printf('%02X', {K})"
CELLS = "sheet_idx INTEGER, row_idx INTEGER, col_idx INTEGER, v_type VARCHAR, v_str VARCHAR, v_num DOUBLE, v_bool BOOLEAN, formula VARCHAR"
SHOWN = ["workbook_id", "sheet_idx", "row_idx", "col_idx", "v_type", "v_str", "v_num", "v_bool", "formula"]
LETTER = f"chr(CAST(65 + {K} AS INTEGER))"


def each(columns: str, *rows: tuple) -> str:
    """SQL of these rows for every nation: columns are `name TYPE`, values are SQL; None is null."""
    pairs = [c.strip().split(" ", 1) for c in columns.split(",")]
    some = [f"SELECT CAST({K} AS BIGINT) AS workbook_id, " + ", ".join(f"CAST({'NULL' if v is None else v} AS {t}) AS {n}" for v, (n, t) in zip(r, pairs, strict=True)) + " FROM nation" for r in rows]
    return " UNION ALL ".join(some)


def look(name: str, form: str, columns: str, *rows: tuple, show: list[str] | None = None):
    """Registers a query that scans the showcase of a form, with the rows that it must give for each nation."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        wanted = show or ["workbook_id", *(c.strip().split(" ", 1)[0].strip('"') for c in columns.split(","))]

        def query(spark, sf_dir):
            return f(showcase(spark, sf_dir, form)).selectExpr(*(f"`{w}`" if w.isidentifier() else w for w in wanted))

        QUERIES[name], ORACLES[name] = query, each(columns, *rows)
        return f

    return add


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cell(sheet: int, row: int, col: int, kind: str, string: str | None = None, num: str | None = None, flag: str | None = None, formula: str | None = None) -> tuple:
    return (str(sheet), str(row), str(col), text(kind), string, num, flag, formula)


def joined(column: str) -> str:
    return f"array_join(cast({column} AS array<string>), '|') AS {column}"


# Excel 2007+

_BOX = "border-left: 1px solid #0000FF; border-right: 2px solid #000000; border-bottom: 3px double #000"
_X1 = f"'font-family: Arial; font-size: ' || ({K} + 10) || 'pt; font-weight: bold; text-decoration: underline; color: #AA00' || {HEX} || '; background-color: #00FF00; "
_X1_ALIGN = "; text-align: center; vertical-align: middle; white-space: pre-wrap'"
_X2 = "'font-family: Cambria; font-size: 9pt; font-style: italic; text-decoration: line-through; color: #4472C4; background-color: #FFFF00; vertical-align: top'"

look("xlsx_cells", "xlsx", CELLS, cell(0, 0, 0, "string", f"{N} || ' ratio x:y=3'"), cell(0, 0, 1, "number", None, K), cell(0, 1, 0, "boolean", None, None, "true"), cell(0, 1, 1, "error", "'#DIV/0!'"), cell(0, 1, 2, "formula", "'x'", None, None, "'=SUMPRODUCT( A:A=B:B)'"), cell(0, 1, 3, "string", "'use xmlns=\"q\" here'"), cell(0, 3, 0, "number", None, "0"), cell(1, 0, 0, "number", None, "7"))(lambda d: zipped.scan_xlsx(d))
look("xlsx_worksheets", "xlsx", "sheet_idx INTEGER, sheet_name VARCHAR, state VARCHAR, part VARCHAR", ("0", "'Main'", "'visible'", "'xl/worksheets/a.xml'"), ("1", "'Hid'", "'hidden'", "'xl/worksheets/b.xml'"))(lambda d: zipped.xlsx_worksheets(d))
look("xlsx_strings", "xlsx", "sst INTEGER, text VARCHAR", ("0", f"{N} || ' ratio x:y=3'"))(lambda d: zipped.xlsx_strings(d))
look("xlsx_styles", "xlsx", "xf INTEGER, css VARCHAR, number_format VARCHAR, align VARCHAR, wrap BOOLEAN", ("0", "''", "'General'", None, "false"), ("1", f"{_X1}{_BOX}{_X1_ALIGN}", "'0.000 \"k\"'", "'center'", "true"), ("2", _X2, "'mm-dd-yy'", None, "false"))(lambda d: xlsx_parts.xlsx_styles(d))
look("xlsx_styled_cells", "xlsx", "sheet_idx INTEGER, row_idx INTEGER, col_idx INTEGER, style_idx INTEGER, css VARCHAR", ("0", "0", "0", "0", f"{_X1}{_BOX}{_X1_ALIGN}"), ("0", "0", "1", "1", f"{_X1}{_BOX.split('; ', 1)[1]}{_X1_ALIGN}"), ("0", "1", "0", "2", _X2))(lambda d: xlsx_parts.xlsx_styled_cells(d)[1].where("css is not null"))
look("xlsx_rule_styles", "xlsx", "dxf INTEGER, css VARCHAR", ("0", "'color: #FF0000; background-color: #FFFF00; font-weight: bold; border-left: 1px solid #00FF00'"))(lambda d: xlsx_parts.xlsx_rule_styles(d))
look("xlsx_comments", "xlsx", "sheet_idx INTEGER, address VARCHAR, text VARCHAR", ("0", f"'B' || ({K} + 1)", f"{N} || ' a:b=1'"))(lambda d: xlsx_parts.xlsx_sheet_comments(d))
look("xlsx_hyperlinks", "xlsx", "sheet_idx INTEGER, address VARCHAR, url VARCHAR", ("0", "'A1'", f"'https://example.org/' || {K}"), ("0", "'B1'", "'Hid!A1'"))(lambda d: xlsx_parts.xlsx_hyperlinks(d))
look("xlsx_rows", "xlsx", "sheet_idx INTEGER, row_idx INTEGER, height DOUBLE, visible BOOLEAN", ("0", "0", "30.5", "true"), ("0", "1", "21", "false"), ("0", "3", "21", "true"), ("1", "0", "21", "true"))(lambda d: xlsx_parts.xlsx_rows(d))
look("xlsx_dimensions", "xlsx", "sheet_idx INTEGER, max_row INTEGER, max_col INTEGER", ("0", f"{K} + 4", "4"))(lambda d: xlsx_parts.xlsx_dimensions(d))
look("xlsx_frozen", "xlsx", "sheet_idx INTEGER, rows VARCHAR, cols VARCHAR", ("0", "'2|3'", "'1'"), show=["workbook_id", "sheet_idx", joined("rows"), joined("cols")])(lambda d: xlsx_parts.xlsx_frozen(d))
look("xlsx_views", "xlsx", "sheet_idx INTEGER, gridlines BOOLEAN, freeze_rows INTEGER, freeze_cols INTEGER, locked BOOLEAN", ("0", "false", "2", "1", "true"), ("1", "true", None, None, "false"))(lambda d: zipped.xlsx_views(d))
look("xlsx_columns", "xlsx", "sheet_idx INTEGER, col_idx INTEGER, width_px BIGINT, visible BOOLEAN", ("0", "0", "84", "true"), ("0", "1", "84", "true"), ("0", "3", f"floor(({K} + 1) * 8.43::DOUBLE + 0.5::DOUBLE)", "false"))(lambda d: zipped.xlsx_columns(d))
look("xlsx_merges", "xlsx", "sheet_idx INTEGER, address VARCHAR, row_idx INTEGER, col_idx INTEGER, colspan INTEGER, rowspan INTEGER", ("0", "'A1'", "0", "0", "2", "2"), ("0", "'D1'", "0", "3", "1", f"{K} + 2"))(lambda d: zipped.xlsx_merges(d))
look("xlsx_protected", "xlsx", "sheet_idx INTEGER, row_idx INTEGER, col_idx INTEGER", ("0", "0", "0"), ("0", "0", "1"), ("0", "3", "3"))(lambda d: zipped.xlsx_protected(d))
look("xlsx_validations", "xlsx", "range VARCHAR, type VARCHAR, action VARCHAR, criteria VARCHAR, value VARCHAR, allow_blank BOOLEAN", ("'Main!A1'", "'list'", "'reject'", None, "'a|b|c'", "true"), ("'Main!B1:B9'", "'number'", "'warning'", "'>'", f"{K}", "false"), show=["workbook_id", "range", "type", "action", "criteria", joined("value"), "allow_blank"])(lambda d: zipped.xlsx_validations(d))
look("xlsx_names", "xlsx", "name VARCHAR, refers_to VARCHAR", ("'Print_Area'", f"'Main!$A$1:$B$' || ({K} + 1)"))(lambda d: zipped.xlsx_names(d))
_RULE = "'background-color=#FFFF00|border-left=1px solid #00FF00|color=#FF0000|font-weight=bold'"
look(
    "xlsx_conditional_formats", "xlsx", "range VARCHAR, nth INTEGER, type VARCHAR, criteria VARCHAR, value VARCHAR, format VARCHAR",
    ("'Main!A1:A9'", "0", "'number'", "'between'", f"{K} || '|9.5'", _RULE), ("'Main!A1:A9'", "1", "'text'", "'contains'", "'abc'", None), ("'Main!B1'", "2", "'formula'", None, "'=ISEVEN(A1)'", None),
    ("'Main!B1'", "3", "'dataBar'", None, None, None), ("'Main!B1'", "4", "'empty'", None, None, _RULE), ("'Main!B1'", "5", "'text'", "'='", "'t'", None),
    show=["workbook_id", "range", "nth", "type", "criteria", joined("value"), "array_join(array_sort(transform(map_entries(format), e -> concat(e.key, '=', e.value))), '|') AS format"],
)(lambda d: xlsx_parts.xlsx_conditional_formats(d))
_PLACE = "sheet_idx INTEGER, nth INTEGER, left BIGINT, top BIGINT, width BIGINT, height BIGINT, cell VARCHAR"
look("xlsx_images", "xlsx", f"{_PLACE}, src VARCHAR".replace("left", '"left"'), ("0", "0", "65", "42", "127", "98", "'B3'", f"'data:image/jpeg;base64,' || base64(encode('image of ' || {K}))"), show=["workbook_id", "sheet_idx", "nth", "left", "top", "width", "height", "cell", "src"])(lambda d: xlsx_parts.xlsx_images(d))
look(
    "xlsx_shapes", "xlsx", f"{_PLACE}, type VARCHAR, background VARCHAR, border_color VARCHAR, border_width BIGINT, text VARCHAR, font_color VARCHAR".replace("left", '"left"'),
    ("0", "1", f"{K} * 64 + 1", "2", "63", "18", f"{LETTER} || '1'", "'ellipse'", f"'#1234' || {HEX}", "'#ED7D31'", "3", f"{N} || '!' || chr(10) || 'two'", "'#000000'"),
    show=["workbook_id", "sheet_idx", "nth", "left", "top", "width", "height", "cell", "type", "background", "border_color", "border_width", "text", "font_color"],
)(lambda d: xlsx_parts.xlsx_shapes(d))
look(
    "xlsx_charts", "xlsx", f"{_PLACE}, type VARCHAR, title VARCHAR, legend VARCHAR, base VARCHAR, side VARCHAR, range VARCHAR, orientation BOOLEAN, datasets VARCHAR, labels INTEGER, colors VARCHAR".replace("left", '"left"'),
    ("0", "2", "10", "20", "100", "50", "'A1'", "'line'", N, "'bottom'", "'false|base'", f"'true|' || {K} || '.5'", f"'Main!A2:E' || ({K} + 9)", "true", "'2|4'", "0", "'#AABBCC|#AABBCC'"),
    show=["workbook_id", "sheet_idx", "nth", "left", "top", "width", "height", "cell", "type", "title", "legend", "concat_ws('|', cast(base_axis.display AS string), base_axis.title) AS base", "concat_ws('|', cast(side_axis.reverse AS string), cast(side_axis.max AS string)) AS side", "range", "orientation", joined("datasets"), "labels", "array_join(series.color, '|') AS colors"],
)(lambda d: xlsx_parts.xlsx_charts(d))

# OpenDocument

_O1 = f"'font-size: ' || ({K} + 8) || 'pt; font-weight: bold; color: #' || lower({HEX}) || '0000; background-color: #ffff00; border-left: 1px solid #000000; border-right: 1px solid #000000; border-top: 1px solid #000000; border-bottom: 1px solid #000000; text-align: end'"
_TEXT = f"{N} || chr(10) || 'ratio x:y=3 <use xmlns=\"q\">'"
look("ods_cells", "ods", f"{CELLS}, colspan INTEGER, url VARCHAR, comment VARCHAR", *((*c, *rest) for c, rest in (
    (cell(0, 0, 0, "number", None, f"{K} + 0.25"), ("1", None, None)), (cell(0, 0, 1, "string", _TEXT), ("2", f"'https://example.org/' || {K}", None)),
    *((cell(0, r, c, "number", None, "2"), ("1", None, f"'note ' || {K}")) for r in (1, 2) for c in (0, 1, 2)),
    (cell(0, 3, 0, "boolean", None, None, "true"), ("1", None, None)), (cell(0, 3, 1, "string", f"'2020-01-0' || ({K} % 9 + 1)"), ("1", None, None)),
)))(lambda d: zipped.scan_ods(d).withColumn("comment", F.nullif("comment", F.lit(""))))
look("ods_styles", "ods", "style_name VARCHAR, style_rank INTEGER, css VARCHAR, number_format VARCHAR", ("'co1'", "0", "''", None), ("'ta1'", "1", "''", None), ("'ce1'", "2", _O1, "'0.000'"), ("'ce2'", "3", "'border-top: 2px dashed #00ff00'", "'€#,##0.00'"), ("'Default'", "4", "'font-style: italic'", None))(lambda d: ods_styles.ods_styles(d))
look("ods_number_formats", "ods", "format_name VARCHAR, mask VARCHAR", ("'N1'", "'0.000'"), ("'N2'", "'0.0%'"), ("'N3'", "'€#,##0.00'"))(lambda d: ods_styles.ods_number_formats(d))
look("ods_frozen", "ods", "sheet_idx INTEGER, freeze_rows INTEGER, freeze_cols INTEGER", ("0", f"{K} + 1", "1"))(lambda d: ods_styles.ods_frozen(d))
look("ods_styled_cells", "ods", "row_idx INTEGER, col_idx INTEGER, style_idx INTEGER, number_format VARCHAR", ("0", "0", "0", "'0.000'"), ("0", "1", "3", None), *(("1", str(c), None, "'€#,##0.00'") for c in range(3)), *(("2", str(c), "1", "'€#,##0.00'") for c in range(3)), ("3", "0", None, None), ("3", "1", None, None))(lambda d: ods_styles.ods_styled_cells(d)[1])
look("ods_style_dictionary", "ods", "style_idx INTEGER, css VARCHAR", ("0", _O1), ("1", "'border-top: 2px dashed #00ff00'"), ("2", "'font-style: italic'"), ("3", _O1.replace("border-left: 1px solid #000000; ", "")))(lambda d: ods_styles.ods_styled_cells(d)[0])
look("ods_columns", "ods", "sheet_idx INTEGER, col_idx INTEGER, width_px DOUBLE", ("0", "0", f"({K} + 1) * 37.795::DOUBLE"), ("0", "1", f"({K} + 1) * 37.795::DOUBLE"), ("0", "2", "100"))(lambda d: zipped.ods_columns(d))
look("ods_worksheets", "ods", "sheet_idx INTEGER, sheet_name VARCHAR, state VARCHAR", ("0", "'First'", "'visible'"), ("1", "'Second'", "'hidden'"))(lambda d: zipped.ods_worksheets(d))
look("ods_names", "ods", "name VARCHAR, refers_to VARCHAR", ("'area'", "'First.A1'"))(lambda d: zipped.ods_names(d))

# Excel 97-2003

_C0 = "'font-family: Arial; font-size: 10pt; vertical-align: bottom'"
_C1 = f"'font-family: Courier; font-size: ' || ({K} + 8) || 'pt; font-style: italic; text-decoration: underline; text-align: center; vertical-align: middle; white-space: pre-wrap; background-color: #FFFF00; color: #FF0000; border-left: 1px solid #000; border-right: 1px solid #000; border-top: 1px solid #000; border-bottom: 1px solid #000'"
_C2 = "'font-family: Grüße; font-size: 9pt; text-decoration: line-through; text-align: right; vertical-align: top; background-color: #00FF00; color: #0000FF; border-right: 1px solid #000'"
_C3 = "'font-family: Fifth; font-size: 12pt; vertical-align: bottom; color: #008000'"
look(
    "xls_cells", "xls", CELLS, cell(0, 0, 0, "string", N), cell(0, 0, 1, "number", None, K), cell(0, 0, 2, "number", None, f"{K} + 0.25"), cell(0, 0, 3, "error", "'#DIV/0!'"), cell(0, 0, 4, "boolean", None, None, "true"),
    cell(0, 1, 0, "empty"), cell(0, 1, 1, "empty"), cell(0, 1, 2, "number", None, f"{K} / 4.0"), cell(0, 2, 0, "formula", N, None, None, f"'=\"' || substr({N}, 1, 1) || '\"'"),
    cell(0, 3, 1, "formula", None, "1.5", None, "'=A3+1'"), cell(0, 4, 1, "formula", None, "1.5", None, "'=A4+1'"),
)(lambda d: binary.scan_xls(d))
look("xls_fonts", "xls", "font INTEGER, name VARCHAR, size_pt DOUBLE, italic BOOLEAN, strike BOOLEAN, underline BOOLEAN, color INTEGER", ("0", "'Arial'", "10", "false", "false", "false", "32767"), ("1", "'Courier'", f"{K} + 8", "true", "false", "true", "10"), ("2", "'Grüße'", "9", "false", "true", "false", "12"), ("3", "'Arial'", "9", "false", "false", "false", "8"), ("5", "'Fifth'", "12", "false", "false", "false", "17"))(lambda d: xls_styles.xls_fonts(d))
look("xls_formats", "xls", "format INTEGER, mask VARCHAR", ("164", "'0.0\"k'"), ("165", "'€0'"))(lambda d: xls_styles.xls_formats(d))
look("xls_styles", "xls", "xf INTEGER, css VARCHAR, number_format VARCHAR, wrap BOOLEAN", ("0", _C0, None, "false"), ("1", _C1, "'0.0\"k'", "true"), ("2", _C2, "'€0'", "false"), ("3", _C3, None, "false"))(lambda d: xls_styles.xls_styles(d))
look("xls_styled_cells", "xls", "row_idx INTEGER, col_idx INTEGER, style_idx INTEGER", *((str(r), str(c), str(s)) for r, c, s in ((0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (1, 0, 5), (1, 1, 2), (1, 2, 3), (2, 0, 3), (3, 1, 3), (4, 1, 3))))(lambda d: xls_styles.xls_styled_cells(d)[1])
look("xls_rows", "xls", "sheet_idx INTEGER, row_idx INTEGER, height_pt DOUBLE, visible BOOLEAN", ("0", "0", f"{K} + 15", "false"))(lambda d: xls_styles.xls_rows(d))
look("xls_columns", "xls", "sheet_idx INTEGER, col_idx INTEGER, width_px DOUBLE, visible BOOLEAN", ("0", "1", f"({K} + 1) * 8.43::DOUBLE", "false"), ("0", "2", f"({K} + 1) * 8.43::DOUBLE", "false"))(lambda d: binary.xls_columns(d))
look("xls_merges", "xls", "sheet_idx INTEGER, row_idx INTEGER, col_idx INTEGER, colspan INTEGER, rowspan INTEGER", ("0", "0", "0", "2", "2"), ("0", "2", "2", "1", f"{K} + 2"))(lambda d: binary.xls_merges(d))
look("xls_worksheets", "xls", "sheet_idx INTEGER, sheet_name VARCHAR, state VARCHAR", ("0", "'Looks'", "'visible'"))(lambda d: binary.biff_sheets(binary.biff_records(d)))

# dBase, Lotus

_DAY = f"printf('%02d', {K} + 1)"
look(
    "dbf_cells", "dbf", "col_idx INTEGER, title VARCHAR, v_type VARCHAR, v_str VARCHAR, v_num DOUBLE, v_bool BOOLEAN",
    ("0", "'C'", "'string'", N, None, None), ("1", "'N'", "'number'", None, f"{K} + 0.25", None), ("2", "'F'", "'number'", None, f"-{K}", None), ("3", "'L'", "'boolean'", None, None, f"{K} % 2 = 0"), ("4", "'D'", "'string'", f"'2020-01-' || {_DAY}", None, None), ("5", "'I'", "'number'", None, f"-{K}", None),
    ("6", "'Y'", "'number'", None, f"{K} + 0.25", None), ("7", "'T'", "'string'", f"'1970-01-' || {_DAY} || 'T01:00:00.000Z'", None, None), ("8", "'B'", "'number'", None, f"{K} / 4.0", None), ("9", "'G'", "'string'", "'<binary:10 bytes>'", None, None), ("10", "'E'", "'empty'", None, None, None),
)(lambda d: binary.scan_dbf(d))
look("dbf_meta", "dbf", "version VARCHAR, updated VARCHAR, n_records BIGINT, header_bytes BIGINT, record_bytes BIGINT, transaction BOOLEAN, encrypted BOOLEAN, indexed BOOLEAN, language INTEGER", ("'Visual FoxPro'", "'2024-03-09'", "2", "385", "89", "false", "true", "true", "3"))(lambda d: binary.dbf_meta(d))
look("dbf_columns", "dbf", "col_idx INTEGER, title VARCHAR, type VARCHAR, width_px INTEGER, mask VARCHAR", *((str(i), f"'{n}'", t and f"'{t}'", w, m and f"'{m}'") for i, (n, t, w, m) in enumerate((
    ("C", "text", "200", None), ("N", "numeric", "100", "#,##0.00"), ("F", "numeric", "100", None), ("L", "checkbox", "100", None), ("D", "calendar", "100", "YYYY-MM-DD"), ("I", "numeric", "100", None), ("Y", "numeric", "100", "$#,##0.00"),
    ("T", "calendar", "100", "YYYY-MM-DD HH:mm:ss"), ("B", "numeric", "100", None), ("G", None, "100", None), ("E", "text", "100", None),
))))(lambda d: binary.dbf_columns(d))
look(
    "lotus_cells", "lotus", "sheet_idx INTEGER, row_idx INTEGER, col_idx INTEGER, v_type VARCHAR, v_str VARCHAR, v_num DOUBLE, css VARCHAR",
    ("0", "0", "0", "'number'", None, f"-{K}", "'pointer-events: none'"), ("0", "0", "1", "'string'", N, None, "'text-align: center'"), ("0", "0", "2", "'empty'", None, None, None), ("0", "1", "0", "'number'", None, f"{K} / 4.0", None), ("0", "1", "1", "'string'", "'calc'", None, None), ("1", "0", "0", "'number'", None, f"{K} / 2.0", None),
)(lambda d: binary.scan_lotus(d).withColumn("css", binary.lotus_css(F.col("align"), F.col("protected"))))
look("lotus_columns", "lotus", "col_idx INTEGER, width_px DOUBLE, visible BOOLEAN", ("1", f"{K} * 8.43::DOUBLE", f"{K} <> 0"))(lambda d: binary.lotus_columns(d))
look("lotus_sheets", "lotus", "sheet_idx INTEGER, sheet_name VARCHAR", ("0", N), ("1", "'Two'"))(lambda d: binary.lotus_sheets(d))

# SpreadsheetML 2003

_S1 = f"'font-family: Arial; font-size: ' || ({K} + 8) || 'pt; font-weight: bold; color: #00FF00; background-color: #112233; border-left: 1px dashed #FF0000; border-bottom: 3px double #000000; text-align: right; vertical-align: middle; white-space: pre-wrap'"
look(
    "xml_cells", "xml", f"{CELLS}, style_id VARCHAR, colspan INTEGER, rowspan INTEGER, comment VARCHAR", (*cell(0, 0, 0, "string", f"{N} || ' see a:b=1 <x:y> xmlns=\"q\"'"), "'s1'", "1", "1", "'c:d=2'"), (*cell(0, 0, 2, "number", None, K), "'s2'", "2", f"{K} + 1", None),
    (*cell(0, 0, 4, "boolean", None, None, "true"), None, "1", "1", None), (*cell(0, 3, 0, "formula", "'#N/A'", None, None, "'=B4+$A$1&\"a:b=\"'"), None, "1", "1", None),
)(lambda d: markup.scan_xml2003(d, xml="text"))
look("xml_styles", "xml", "style_id VARCHAR, css VARCHAR, mask VARCHAR", ("'s1'", _S1, f"'#,##0.0' || repeat('0', {K} % 3)"), ("'s2'", "''", "'0.00E+00'"), ("'s3'", "''", "'DD-MMM-YY'"))(lambda d: markup.xml_styles(d, xml="text"))
look("xml_columns", "xml", "sheet_idx INTEGER, col_idx INTEGER, width DOUBLE, visible BOOLEAN", ("0", "0", f"{K} + 10", "true"), ("0", "2", "20.5", "false"), ("0", "3", "20.5", "false"))(lambda d: markup.xml_columns(d, xml="text"))
look("xml_rows", "xml", "sheet_idx INTEGER, row_idx INTEGER, height DOUBLE, visible BOOLEAN", ("0", "0", f"{K} + 20", "true"), ("0", "3", None, "false"))(lambda d: markup.xml_rows(d, xml="text"))
look("xml_worksheets", "xml", "sheet_idx INTEGER, sheet_name VARCHAR, state VARCHAR, freeze_rows INTEGER, freeze_cols INTEGER, gridlines BOOLEAN, default_width DOUBLE, protect_objects BOOLEAN, protect_scenarios BOOLEAN, enable_selection VARCHAR", ("0", "'Main'", "'visible'", f"{K} + 1", "2", "false", "60", "true", "false", "'NoSelection'"), ("1", "'None'", "'hidden'", None, None, "true", None, None, None, None))(lambda d: markup.xml_worksheets(d, xml="text"))
look("xml_names", "xml", "name VARCHAR, refers_to VARCHAR", ("'Area'", "'Main!R1C1'"))(lambda d: markup.xml_names(d, xml="text"))
look("xml_styled_cells", "xml", "row_idx INTEGER, col_idx INTEGER, style_idx INTEGER, mask VARCHAR", ("0", "0", "0", f"'#,##0.0' || repeat('0', {K} % 3)"), ("0", "2", None, "'0.00E+00'"), ("0", "4", None, None), ("3", "0", None, None))(lambda d: markup.xml_styled_cells(d, xml="text")[1])

# SYLK, DIF, HTML

_BOTH = "border-left: 1px solid #000000; border-right: 1px solid #000000"
look("sylk_cells", "sylk", CELLS, cell(0, 0, 0, "number", None, "5"), cell(0, 0, 1, "string", f"{N} || ';°'"), cell(0, 1, 0, "string", "'a'"), cell(0, 1, 1, "number", None, "1"), cell(0, 2, 0, "formula", None, "2", None, "'=A2+1'"))(lambda d: delimited.scan_sylk(d))
look("sylk_cell_styles", "sylk", "row_idx INTEGER, col_idx INTEGER, css VARCHAR, mask VARCHAR", ("0", "0", "'font-weight: bold; color: #FF0000'", None), ("0", "1", f"'font-size: ' || ({K} + 8) || 'pt; font-weight: bold; font-style: italic; color: #FF0000'", None), ("1", "0", f"'color: #0000FF; background-color: #0000FF; {_BOTH}'", None), ("1", "1", "'border-left: 1px solid #000000'", "'0.00'"), ("2", "0", "'text-align: center'", None))(lambda d: delimited.sylk_cell_styles(d))
look("sylk_styled_cells", "sylk", "row_idx INTEGER, col_idx INTEGER, style_idx INTEGER", ("0", "0", "0"), ("0", "1", "1"), ("1", "0", "2"), ("1", "1", None), ("2", "0", "3"))(lambda d: delimited.sylk_styled_cells(d)[1])
look("sylk_columns", "sylk", "col_idx INTEGER, width_px BIGINT", ("1", f"floor(({K} + 1) * 7.15::DOUBLE + 0.5::DOUBLE)"), ("2", f"floor(({K} + 1) * 7.15::DOUBLE + 0.5::DOUBLE)"), ("4", "50"))(lambda d: delimited.sylk_columns(d))
look("sylk_bounds", "sylk", "n_rows INTEGER, n_cols INTEGER", ("9", f"{K} + 5"))(lambda d: delimited.sylk_bounds(d))
look("dif_cells", "dif", CELLS, cell(0, 0, 0, "number", None, f"{K} + 0.5"), cell(0, 0, 1, "string", N), cell(0, 0, 2, "boolean", None, None, "true"), cell(0, 0, 3, "error", "'#N/A'"))(lambda d: delimited.scan_dif(d))
look("dif_meta", "dif", "version VARCHAR, title VARCHAR, n_vectors INTEGER, n_tuples INTEGER, comments VARCHAR", ("'1'", N, "3", "1", f"'note ' || {K}"), show=["workbook_id", "version", "title", "n_vectors", "n_tuples", joined("comments")])(lambda d: delimited.dif_meta(d))
look("dif_titles", "dif", "col_idx INTEGER, title VARCHAR", ("0", "'one'"))(lambda d: delimited.dif_titles(d))
look(
    "html_cells", "html", "sheet_idx INTEGER, row_idx INTEGER, col_idx INTEGER, v_str VARCHAR, formula VARCHAR, colspan INTEGER, rowspan INTEGER, css VARCHAR, comment VARCHAR",
    ("0", "0", "0", "'head'", None, "1", "1", None, None), ("0", "1", "0", N, None, "1", "2", "'color: red'", f"'note ' || {K}"), ("0", "1", "1", "'b&c'", None, "2", "1", None, None), ("0", "2", "1", "'h'", None, "1", "1", None, None),
    ("0", "2", "2", "'9'", f"'=A1+' || {K}", "1", "1", None, None), ("0", "3", "0", "'foot'", None, "1", "1", None, None), ("1", "0", "0", "'second'", None, "1", "1", None, None),
)(lambda d: markup.scan_html(d, html="text", table_index=None, first_row_as_header=False))


# reading of files


def _files(spark, sf_dir) -> DataFrame:
    """Files whose content does not fit their extension, beside one that does."""
    d = showcase(spark, sf_dir, "xlsx").select(F.col("doc_id").alias("k"), "content")
    kinds = F.array(*(F.struct(F.lit(e).alias("ext"), F.lit(whole).alias("whole")) for e, whole in (("xlsx", True), ("xlsx", False), ("xls", False), ("dbf", False), ("wk1", False), ("pdf", False), ("", False))))
    f = d.select("k", "content", F.posexplode(kinds).alias("i", "kind"))
    path = F.concat(F.lit("/in.box/"), "k", F.lit("-"), "i", F.when(F.col("kind.ext") != "", F.concat(F.lit("."), "kind.ext")).otherwise(""))
    return f.select(path.alias("path"), F.when(F.col("kind.whole"), F.col("content")).otherwise(F.lit(b"abc")).alias("content"))


def file_errors(spark, sf_dir):
    return reader.file_errors(_files(spark, sf_dir))


QUERIES["file_errors"] = file_errors
ORACLES["file_errors"] = " UNION ALL ".join(f"SELECT '/in.box/' || {K} || '-{i}{ext}' AS path, '{m}' AS message FROM nation" for i, ext, m in ((1, ".xlsx", "Not a zip archive"), (2, ".xls", "No workbook stream"), (3, ".dbf", "Too short for a table header"), (4, ".wk1", "Not a worksheet of this kind"), (5, ".pdf", "Unsupported file type: pdf"), (6, "", "Unsupported file type: ")))


def fn_encoding(spark, sf_dir):
    """Texts in five encodings, told apart and read."""
    from cellweave.plans.fixtures import table

    names = ("utf-8", "utf-16le", "utf-16be", "latin1")
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat("n_name", F.lit(" größer")).alias("t"))
    coded = {"utf-8": F.encode("t", "UTF-8"), "utf-16le": F.concat(F.lit(b"\xff\xfe"), F.encode("t", "UTF-16LE")), "utf-16be": F.encode("t", "UTF-16BE"), "latin1": F.encode("t", "ISO-8859-1")}
    f = t.select("k", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), coded[n].alias("data")) for n in names))).alias("c")).select("k", "c.*")
    f = f.withColumn("found", encodings.encoding_of("data"))
    dif = encodings.dif_encoding_of(F.concat(F.col("k").cast("string").cast("binary"), F.lit(b"\xf8C")))
    return f.select("k", "name", "found", encodings.decoded_as("data", "found").alias("text"), dif.alias("dif"))


QUERIES["fn_encoding"] = fn_encoding
ORACLES["fn_encoding"] = " UNION ALL ".join(f"SELECT {K} AS k, '{n}' AS name, '{n}' AS found, {N} || ' größer' AS text, 'cp850' AS dif FROM nation" for n in ("utf-8", "utf-16le", "utf-16be", "latin1"))

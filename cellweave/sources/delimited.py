"""Line- and record-oriented text: delimited values in one pass, DIF and SYLK as joins and windows over exploded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.formulas import r1c1_to_a1
from cellweave.functions.palettes import indexed_color
from cellweave.functions.text import with_equals
from cellweave.functions.units import number_prefix, width_px
from cellweave.operators.relational import cursor, default_columns, densify, running_sums, styled
from cellweave.sources.model import by_text, cells, streamed
from cellweave.sources.streams import csv_values


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(workbook_id, pos, line) of each line."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    return docs.select(F.col(key).alias("workbook_id"), F.posexplode(parts).alias("pos", "line"))


def scan_csv(docs: DataFrame, key: str = "doc_id", text: str = "text", delimiter: str = ",") -> DataFrame:
    """Cells of delimited text, one row a stored cell; ragged rows stay ragged (operators.relational.densify pads them).

    A quote opens a quoted part only at a cell's start; inside, two quotes stand for one; what follows it up to the
    delimiter is kept. Carriage returns vanish. A value that still begins and ends with a quote loses that pair,
    unless the text ends there. Null text has no cells, empty text one empty cell. A delimiter of several characters
    parts nothing: cells are compared character by character, so each line is one cell."""
    t = streamed(docs, key, text, "row_idx int, col_idx int, v string", lambda body: csv_values(body.replace("\r", ""), delimiter))
    return cells(t.withColumn("sheet_idx", F.lit(0)), kind=by_text(F.col("v")), text=F.col("v"))


def csv_sheet(docs: DataFrame, key: str = "doc_id", text: str = "text", delimiter: str = ",", max_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, columns): delimited text as a rectangle, short rows padded with '', and its columns by letter, of the usual width."""
    c = scan_csv(docs, key, text, delimiter)
    none = c.select("workbook_id", "sheet_idx", "col_idx", F.lit(0.0).alias("width_px")).limit(0)
    return densify(c, "v_str", "", max_cells=max_cells), default_columns(c, none)


def scan_dif(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cells of DIF: after DATA, pairs of lines; BOT begins a row, EOD ends the table."""
    x = lines(docs, key, text).withColumn("line", F.trim("line"))
    begin = x.where("line = 'DATA'").groupBy("workbook_id").agg(F.min("pos").alias("begin"))
    x = x.join(begin, "workbook_id").where("pos >= begin + 3").withColumn("k", F.col("pos") - F.col("begin") - 3)
    pair = x.groupBy("workbook_id", F.floor(F.col("k") / 2).alias("p")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("line"))).alias("head"), F.max(F.when(F.col("k") % 2 == 1, F.col("line"))).alias("body"))
    pair = pair.withColumn("type", F.substring_index("head", ",", 1).try_cast("int")).withColumn("num", F.substring_index("head", ",", -1))
    marks = {"done": (F.col("type") == -1) & F.coalesce("body", F.lit("")).isin("EOD", ""), "row_idx": (F.col("type") == -1) & (F.col("body") == "BOT")}
    pair = pair.withColumns({c: F.coalesce(m, F.lit(False)).cast("int") for c, m in marks.items()})
    pair = running_sums(pair, ["workbook_id"], "p", "done", "row_idx").where("done = 0").withColumn("row_idx", F.col("row_idx") - 1)
    got = pair.where("type >= 0 and row_idx >= 0").withColumn("sheet_idx", F.lit(0))
    got = got.withColumn("col_idx", F.row_number().over(W.partitionBy("workbook_id", "row_idx").orderBy("p")) - 1)
    kind, code, num = F.col("type"), number_prefix(F.col("num")), number_prefix(F.col("num"))
    error = F.when(code == -1, "#ERROR").when(code == -2, "#N/A")
    string = F.regexp_replace("body", r'^"(.*)"$', "$1")
    v_type = F.when((kind == 0) & num.isNotNull(), "number").when((kind == 1) & (string != ""), "string").when((kind == 2) & code.isin(0.0, 1.0), "boolean").when((kind == 2) & error.isNotNull(), "error").otherwise("empty")
    return cells(got, kind=v_type, text=F.when(kind == 1, string).when(kind == 2, error), num=F.when(kind == 0, num), flag=F.when((kind == 2) & code.isin(0.0, 1.0), code == 1))


def dif_meta(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(workbook_id, version, title, n_vectors, n_tuples, comments) of the header: what stands under each heading before DATA."""
    x = lines(docs, key, text).withColumn("line", F.trim("line"))
    over = W.partitionBy("workbook_id").orderBy("pos")
    x = x.withColumn("data", F.max((F.col("line") == "DATA").cast("int")).over(over)).where("data = 0")
    x = x.withColumn("one", F.lag("line").over(over)).withColumn("two", F.lag("line", 2).over(over)).withColumn("bare", F.regexp_replace("line", '^"|"$', ""))
    count = F.regexp_extract("line", r"^0,(\d+)", 1).try_cast("int")
    return x.groupBy("workbook_id").agg(
        F.min(F.when(F.col("one") == "TABLE", F.substring_index("line", ",", -1))).alias("version"), F.min(F.when(F.col("two") == "TABLE", F.col("bare"))).alias("title"),
        F.min(F.when(F.col("one") == "VECTORS", count)).alias("n_vectors"), F.min(F.when(F.col("one") == "TUPLES", count)).alias("n_tuples"),
        F.array_sort(F.collect_list(F.when(F.col("two") == "COMMENT", F.col("bare")))).alias("comments"),
    )


def dif_titles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(workbook_id, col_idx, title) from the LABEL section: strings before the first BOT."""
    x = lines(docs, key, text).withColumn("line", F.trim("line"))
    edge = x.groupBy("workbook_id").agg(F.min(F.when(F.col("line") == "LABEL", F.col("pos"))).alias("a"), F.min(F.when(F.col("line") == "DATA", F.col("pos"))).alias("z"))
    over = W.partitionBy("workbook_id").orderBy("pos")
    x = x.join(edge, "workbook_id").where("pos > a and pos < z").withColumn("before", F.lag("line").over(over))
    x = x.where(r"before rlike '^1\\s*,' and line rlike '^\"'")
    return x.select("workbook_id", (F.row_number().over(over) - 1).alias("col_idx"), F.regexp_replace("line", '^"|"$', "").alias("title"))


def sylk_text(raw: Column) -> Column:
    """SYLK string: quotes stripped, ;; as one semicolon; ESC N and a byte, or two hexadecimal digits, stand for one character.

    05 is the micro sign and 0C the degree sign; other digits are the character of that number."""
    bare = F.replace(F.regexp_replace(raw, r'^"(.*)"$', "$1"), F.lit(";;"), F.lit(";"))
    bare = F.replace(F.replace(bare, F.lit("\x1bN\x0c"), F.lit("°")), F.lit("\x1bN\x05"), F.lit("µ"))
    pieces, codes = F.split(bare, "\x1bN[0-9A-Fa-f]{2}", -1), F.regexp_extract_all(bare, F.lit("\x1bN([0-9A-Fa-f]{2})"), F.lit(1))

    def char(code: Column) -> Column:
        n = F.conv(code, 16, 10).cast("int")
        return F.when(n == 0x0C, "°").when(n == 0x05, "µ").when(n >= 128, F.decode(F.unhex(code), "ISO-8859-1")).otherwise(F.char(n))

    return F.array_join(F.zip_with(pieces, codes, lambda p, c: F.concat(F.coalesce(p, F.lit("")), F.when(c.isNull(), "").otherwise(char(c)))), "")


def sylk_records(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(workbook_id, pos, type, f): records up to E; f maps each field's letter to its value."""
    every = F.transform(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n"), lambda line: F.trim(line))
    end = F.array_position(every, "E")
    x = docs.select(F.col(key).alias("workbook_id"), F.posexplode(F.when(end > 0, F.slice(every, 1, (end - 1).cast("int"))).otherwise(every)).alias("pos", "line"))
    x = x.where("line <> '' and not startswith(line, ';')")
    # a semicolon ends a field unless it is doubled or inside quotes
    fields = F.regexp_extract_all("line", F.lit(r';([A-Z](?:"[^"]*"|;;|[^;"])*)'), F.lit(1))
    pairs = F.transform(fields, lambda p: F.struct(F.substring(p, 1, 1), F.substring(p, 2, F.length(p))))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["col1"] == p["col1"]))
    return x.select("workbook_id", "pos", F.substring_index("line", ";", 1).alias("type"), F.map_from_entries(first).alias("f"))


def sylk_placed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(workbook_id, pos, type, f, row_idx, col_idx): cell and format records at the cursor.

    X and Y stay until they change; a cell record moves X on by one."""
    x = sylk_records(docs, key, text).where("type in ('C', 'F')")
    x = x.withColumns({"x": F.col("f")["X"].try_cast("int"), "y": F.col("f")["Y"].try_cast("int"), "cell": F.col("type") == "C"})
    return cursor(x, ["workbook_id"], "pos", "x", "y", "cell").select("workbook_id", "pos", "type", "f", "row_idx", "col_idx")


def scan_sylk(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cells of SYLK, from its cell records."""
    x = sylk_placed(docs, key, text).where("type = 'C'").withColumn("sheet_idx", F.lit(0))
    raw, e = F.col("f")["K"], F.col("f")["E"]
    quoted = raw.startswith('"')
    num = F.when(~quoted, number_prefix(raw))
    formula = F.when(e.isNotNull(), with_equals(r1c1_to_a1(e, "row_idx", "col_idx")))
    string = F.when(quoted | num.isNull(), sylk_text(raw))
    kind = F.when(e.isNotNull(), "formula").when(num.isNotNull(), "number").when(F.length(string) > 0, "string").otherwise("empty")
    return cells(x, kind=kind, text=string, num=num, formula=formula)


def sylk_bounds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(workbook_id, n_rows, n_cols): what bounds records state and cells reach."""
    b = sylk_records(docs, key, text).where("type = 'B'").select("workbook_id", F.col("f")["Y"].try_cast("int").alias("r"), F.col("f")["X"].try_cast("int").alias("c"))
    c = sylk_placed(docs, key, text).where("type = 'C'").select("workbook_id", (F.col("row_idx") + 1).alias("r"), (F.col("col_idx") + 1).alias("c"))
    return b.unionByName(c).groupBy("workbook_id").agg(F.max("r").cast("int").alias("n_rows"), F.max("c").cast("int").alias("n_cols"))


def sylk_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(workbook_id, col_idx, width_px): widths of format records, over ranges of columns, and of width records; the last counts."""
    r = sylk_records(docs, key, text)
    x = r.where("type = 'F'").select("workbook_id", "pos", F.transform(F.split(F.col("f")["W"], " "), lambda n: n.try_cast("int")).alias("w")).where("size(w) = 3")
    x = x.select("workbook_id", "pos", F.explode(F.sequence(F.col("w")[0], F.col("w")[1])).alias("c"), F.col("w")[2].alias("w"))
    one = r.where("type = 'W'").select("workbook_id", "pos", F.coalesce(F.col("f")["X"].try_cast("int"), F.lit(1)).alias("c"), F.col("f")["W"].try_cast("int").alias("w")).where("w > 0")
    return x.unionByName(one).groupBy("workbook_id", (F.col("c") - 1).alias("col_idx")).agg(width_px(F.max_by("w", "pos"), F.lit("pt")).alias("width_px"))


_LOOK = ("size", "weight", "slant", "line", "align", "color", "shade", "left", "right", "top", "bottom", "mask")
_AT_END = {"L": "left", "R": "right", "C": "center"}


def _look(f: Column) -> Column:
    """struct of what a record's fields say about looks; null where they say nothing.

    S has borders where it also gives a size (M and digits), else bold, italic and underlined."""
    s = F.coalesce(f["S"], F.lit(""))
    borders = s.rlike("[DLRTB]") & s.rlike(r"M\d")
    letters = F.regexp_replace(s, r"M\d+", "")

    def font(letter: str, value: str) -> Column:
        return F.when(~borders & F.contains(s, F.lit(letter)), F.lit(value))

    def side(letter: str) -> Column:
        return F.when(borders & F.contains(letters, F.lit(letter)), F.lit("1px solid #000000"))

    last = F.element_at(F.create_map(*(F.lit(x) for p in _AT_END.items() for x in p)), F.right(f["F"], F.lit(1)))
    align = F.element_at(F.create_map(*(F.lit(x) for p in {**_AT_END, "J": "justify", "G": "left"}.items() for x in p)), F.upper(f["A"]))
    values = (F.concat(f["H"], F.lit("pt")), font("B", "bold"), font("I", "italic"), font("U", "underline"), F.coalesce(align, last), f["C"], f["G"], side("L"), side("R"), side("T"), side("B"), f["M"])
    return F.struct(*(v.cast("string").alias(n) for v, n in zip(values, _LOOK, strict=True)))


def _look_css(look: Column) -> Column:
    """CSS of a look; a shaded cell's ground has the colour of its text. Null where nothing shows."""
    # the colours are the indexed ones from 8 on
    color = F.concat(F.lit("#"), F.when(look["color"].try_cast("int").between(1, 56), indexed_color(look["color"].try_cast("int") + 7)))
    named = {"font-size": look["size"], "font-weight": look["weight"], "font-style": look["slant"], "text-decoration": look["line"], "text-align": look["align"], "color": color}
    named |= {"background-color": F.when(look["shade"].isNotNull(), color), **{f"border-{s}": look[s] for s in ("left", "right", "top", "bottom")}}
    return F.nullif(F.concat_ws("; ", *(F.when(v.isNotNull(), F.concat(F.lit(k + ": "), v)) for k, v in named.items())), F.lit(""))


def sylk_cell_styles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx, css, mask) of cells with a look.

    A format record with P registers its look under that name and one at a place gives it to the cell there; a cell
    record's own look goes over the one it names, as registered so far. The last record at a place counts."""
    x = sylk_placed(docs, key, text).withColumn("own", _look(F.col("f"))).withColumn("name", F.col("f")["P"])
    over = W.partitionBy("workbook_id", "name").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("known", F.when(F.col("name").isNotNull() & (F.col("type") == "C"), F.last(F.when(F.col("type") == "F", F.col("own")), True).over(over)))
    x = x.withColumn("look", F.struct(*(F.coalesce(f"own.{n}", f"known.{n}").alias(n) for n in _LOOK)))
    x = x.withColumn("css", _look_css(F.col("look"))).withColumn("mask", F.when(F.col("type") == "C", F.col("look.mask"))).where("css is not null or mask is not null")
    last = x.groupBy("workbook_id", "row_idx", "col_idx").agg(F.max_by("css", F.when(F.col("css").isNotNull(), F.col("pos"))).alias("css"), F.max_by("mask", F.when(F.col("mask").isNotNull(), F.col("pos"))).alias("mask"))
    return last.select("workbook_id", F.lit(0).alias("sheet_idx"), "row_idx", "col_idx", "css", "mask")


def sylk_styled_cells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(styles, cells): cells with css, mask and style_idx, borders that meet drawn once, styles numbered by first appearance."""
    at = ["workbook_id", "sheet_idx", "row_idx", "col_idx"]
    both = scan_sylk(docs, key, text).join(sylk_cell_styles(docs, key, text), at, "full")
    return styled(both.withColumn("v_type", F.coalesce("v_type", F.lit("empty"))))

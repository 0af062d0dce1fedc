"""Binary formats: dBase by fixed offsets, Lotus and Excel 97-2003 as tables of records decoded by expressions."""

from __future__ import annotations

import io
import itertools
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cellweave.functions.formulas import ERRORS, f64_le, ptg_decode
from cellweave.functions.text import with_equals
from cellweave.operators.relational import range_join
from cellweave.sources.compound import MARK, Compound
from cellweave.sources.model import cells

# Label marks and what they mean for alignment.
LABEL_ALIGN = {"'": "left", '"': "right", "^": "center", "\\": "fill"}


def unsigned(data: Column, at: int | Column, size: int) -> Column:
    """Little-endian unsigned integer at a 0-based offset."""
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.concat(*(F.substring(data, start + i, F.lit(1)) for i in range(size, 0, -1)))), 16, 10).cast("long")


def signed(data: Column, at: int | Column, size: int) -> Column:
    x = unsigned(data, at, size)
    return F.when(x >= 1 << (8 * size - 1), x - F.lit(1 << (8 * size))).otherwise(x) if size < 8 else x


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


# dBase


def dbf_fields(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, field_idx, name, type, length, decimals, at): descriptors of 32 bytes, up to the header's end."""
    c = F.col(content)
    d = docs.select(F.col(key).alias("workbook_id"), c.alias("c"), unsigned(c, 8, 2).alias("head"))
    d = d.select("workbook_id", "c", F.explode(F.sequence(F.lit(0), F.greatest(((F.col("head") - 33) / 32).cast("int") - 1, F.lit(0)))).alias("field_idx"))
    base = F.lit(32) + F.col("field_idx") * 32
    one = F.substring(F.col("c"), base + 1, F.lit(32))
    f = d.select("workbook_id", "field_idx", one.alias("o")).where("hex(substring(o, 1, 1)) not in ('0D', '00')")
    f = f.select("workbook_id", "field_idx", F.regexp_extract(latin(F.substring("o", 1, 11)), "^([^\x00]*)", 1).alias("name"), latin(F.substring("o", 12, 1)).alias("type"), unsigned(F.col("o"), 16, 1).alias("length"), unsigned(F.col("o"), 17, 1).alias("decimals"))
    over = W.partitionBy("workbook_id").orderBy("field_idx").rowsBetween(W.unboundedPreceding, -1)
    return f.withColumn("at", 1 + F.coalesce(F.sum("length").over(over), F.lit(0)))


def dbf_records(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, record, deleted, data) of every record of fixed length."""
    c = F.col(content)
    d = docs.select(F.col(key).alias("workbook_id"), c.alias("c"), unsigned(c, 4, 4).alias("n"), unsigned(c, 8, 2).alias("head"), unsigned(c, 10, 2).alias("size")).where("n > 0")
    d = d.select("workbook_id", "c", "head", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("record"))
    d = d.select("workbook_id", "record", F.substring(F.col("c"), (F.col("head") + F.col("record") * F.col("size") + 1).cast("int"), F.col("size").cast("int")).alias("data")).where("length(data) > 0")
    return d.select("workbook_id", "record", (F.hex(F.substring("data", 1, 1)) == "2A").alias("deleted"), "data")


def scan_dbf(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Cells of dBase tables, typed by their fields; deleted records are left out and the others move up.

    C and M are text, N and F numbers, L booleans, D and T ISO texts, I and + signed integers, Y currency of four
    decimals, B and O doubles, G and P a note of their size. Blank fields are empty."""
    live = dbf_records(docs, key, content).where("not deleted")
    live = live.withColumn("row_idx", F.row_number().over(W.partitionBy("workbook_id").orderBy("record")) - 1)
    # descriptors: at most 255 to a file
    t = live.join(dbf_fields(docs, key, content), "workbook_id").withColumn("raw", F.substring(F.col("data"), (F.col("at") + 1).cast("int"), F.col("length").cast("int")))
    raw, kind, s = F.col("raw"), F.col("type"), F.trim(latin(F.col("raw")))
    t = t.withColumn("s", F.regexp_replace(s, "\x00", "")).withColumn("sheet_idx", F.lit(0)).withColumnRenamed("field_idx", "col_idx")
    t = t.withColumn("col_idx", F.dense_rank().over(W.partitionBy("workbook_id", "record").orderBy("col_idx")) - 1)
    s = F.col("s")
    number = (
        F.when(kind.isin("N", "F"), s.try_cast("double")).when(kind.isin("I", "+"), signed(raw, 0, 4).cast("double"))
        .when(kind == "Y", signed(raw, 0, 8).cast("double") / 10000).when(kind.isin("B", "O") & (F.col("length") == 8), f64_le(raw))
    )
    flag = F.when(kind == "L", F.when(s.isin("T", "t", "Y", "y"), True).when(s.isin("F", "f", "N", "n"), False))
    day = F.when(kind == "D", F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
    day = F.when(s.rlike(r"^\d{8}$"), day)
    moment = F.when((kind == "T") & (unsigned(raw, 0, 4) > 0), F.date_format(F.timestamp_millis((unsigned(raw, 0, 4) - 2440588) * 86400000 + unsigned(raw, 4, 4)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    blob = F.when(kind.isin("G", "P"), F.format_string("<binary:%d bytes>", F.col("length")))
    string = F.coalesce(day, moment, blob, F.when(kind.isin("C", "M", "V", "@") & (s != ""), s))
    v_type = F.when(number.isNotNull(), "number").when(flag.isNotNull(), "boolean").when(string.isNotNull(), "string").otherwise("empty")
    return cells(t, F.col("name").alias("title"), kind=v_type, text=string, num=number, flag=flag)


# Names of dBase versions by their first byte.
DBF_VERSIONS = {
    0x02: "FoxBASE", 0x03: "dBASE III", 0x04: "dBASE IV", 0x05: "dBASE V", 0x30: "Visual FoxPro", 0x31: "Visual FoxPro with AutoIncrement", 0x43: "dBASE IV SQL table",
    0x63: "dBASE IV SQL system", 0x83: "dBASE III+ with memo", 0x8B: "dBASE IV with memo", 0x8E: "dBASE IV SQL table with memo", 0xF5: "FoxPro 2.x with memo", 0xFB: "FoxPro without memo",
}


def dbf_meta(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, version, updated, n_records, header_bytes, record_bytes, transaction, encrypted, indexed, language): each table's header."""
    c = F.col(content)
    day = F.concat_ws("-", 1900 + unsigned(c, 1, 1), F.lpad(unsigned(c, 2, 1).cast("string"), 2, "0"), F.lpad(unsigned(c, 3, 1).cast("string"), 2, "0"))
    code = unsigned(c, 0, 1)
    names = F.create_map(*(F.lit(x) for p in DBF_VERSIONS.items() for x in p))
    version = F.coalesce(F.element_at(names, code.cast("int")), F.concat(F.lit("Unknown (0x"), F.lower(F.lpad(F.hex(code), 2, "0")), F.lit(")")))
    return docs.where(F.length(c) >= 32).select(
        F.col(key).alias("workbook_id"), version.alias("version"), day.alias("updated"), unsigned(c, 4, 4).alias("n_records"), unsigned(c, 8, 2).alias("header_bytes"), unsigned(c, 10, 2).alias("record_bytes"),
        (unsigned(c, 14, 1) != 0).alias("transaction"), (unsigned(c, 15, 1) != 0).alias("encrypted"), (unsigned(c, 28, 1) != 0).alias("indexed"), unsigned(c, 29, 1).cast("int").alias("language"),
    )


def dbf_columns(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, col_idx, title, type, width_px, mask): a column for each field; numbers and currency have masks, dates and times formats."""
    kind, places = F.col("type"), F.col("decimals").cast("int")
    shown = F.when(kind.isin("C", "M"), "text").when(kind.isin("N", "F", "I", "B", "Y", "O", "+"), "numeric").when(kind.isin("D", "T", "@"), "calendar").when(kind == "L", "checkbox")
    mask = F.when(kind.isin("N", "F") & (places > 0), F.concat(F.lit("#,##0."), F.repeat(F.lit("0"), places))).when(kind == "Y", "$#,##0.00").when(kind == "D", "YYYY-MM-DD").when(kind.isin("T", "@"), "YYYY-MM-DD HH:mm:ss")
    f = dbf_fields(docs, key, content)
    return f.select("workbook_id", F.col("field_idx").alias("col_idx"), F.col("name").alias("title"), shown.alias("type"), F.greatest(F.col("length") * 10, F.lit(100)).cast("int").alias("width_px"), mask.alias("mask"))


# records of a type, a length and a payload


def framed(data: bytes | None) -> Iterator[tuple[int, int, bytes]]:
    """(offset, type, payload) of each record; a cut-off record ends the list."""
    at = 0
    while data is not None and at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        if at + 4 + size > len(data):
            return
        yield at, kind, bytes(data[at + 4 : at + 4 + size])
        at += 4 + size


def records(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(workbook_id, n, offset, type, data): records of u16 type and u16 length; a cut-off record ends the list."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, n, *one) for k, data in zip(b["k"], b["c"], strict=True) for n, one in enumerate(framed(data))]
            yield pd.DataFrame(out, columns=["workbook_id", "n", "offset", "type", "data"])

    return docs.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"workbook_id {kind}, n long, offset long, type int, data binary")


def scan_lotus(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Cells of Lotus 1-2-3 worksheets, with align and protected; a string record gives the formula before it its value.

    A file whose first record is not of type 0 has no cells."""
    r = records(docs, key, content)
    good = r.where("n = 0 and type = 0").select("workbook_id")
    over = W.partitionBy("workbook_id").orderBy("n")
    r = r.join(good, "workbook_id", "left_semi").withColumn("next", F.when(F.lead("type").over(over) == 51, F.lead("data").over(over)))
    d, t = F.col("data"), F.col("type")
    # a sheet's name (141) comes before its cells, with its number
    r = r.withColumn("sheet_idx", F.coalesce(F.last(F.when(t == 141, unsigned(d, 0, 2)), True).over(over.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    # 12 blank, 13 integer, 14 number, 15 label, 16 formula, 51 string
    r = r.where(t.isin(12, 13, 14, 15, 16))
    r = r.withColumn("col_idx", unsigned(d, 1, 2)).withColumn("row_idx", unsigned(d, 3, 2))
    mark = latin(F.substring(d, 6, 1))
    label = F.replace(latin(F.substring(d, 7, 1 << 16)), F.lit("\x00"), F.lit(""))
    patch = F.replace(latin(F.substring(F.col("next"), 6, 1 << 16)), F.lit("\x00"), F.lit(""))
    num = F.when(t == 13, signed(d, 5, 2).cast("double")).when((t == 14) | ((t == 16) & F.col("next").isNull()), f64_le(F.substring(d, 6, 8)))
    string = F.when(t == 15, label).when(t == 16, patch)
    v_type = F.when(num.isNotNull(), "number").when(string.isNotNull(), "string").otherwise("empty")
    align = F.when(t == 15, F.element_at(F.create_map(*(F.lit(x) for p in LABEL_ALIGN.items() for x in p)), mark))
    return cells(r, align.alias("align"), (unsigned(d, 0, 1) >= 128).alias("protected"), kind=v_type, text=string, num=num)


def lotus_css(align: Column, protected: Column) -> Column:
    """CSS of a Lotus cell's label mark and protection; null for none."""
    css = F.concat_ws("; ", F.when(align.isNotNull() & (align != "fill"), F.concat(F.lit("text-align: "), align)), F.when(protected, F.lit("pointer-events: none")))
    return F.nullif(css, F.lit(""))


def lotus_sheets(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, sheet_name) of sheet name records; a file without one has no rows here."""
    r = records(docs, key, content).where("type = 141")
    d = F.col("data")
    return r.select("workbook_id", unsigned(d, 0, 2).cast("int").alias("sheet_idx"), F.replace(latin(F.substring(d, 4, 1 << 10)), F.lit("\x00"), F.lit("")).alias("sheet_name"))


def lotus_columns(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, col_idx, width_px, visible) of column width records; width 0 hides."""
    r = records(docs, key, content).where("type = 8")
    width = unsigned(F.col("data"), 1, 1)
    return r.select("workbook_id", unsigned(F.col("data"), 0, 1).cast("int").alias("col_idx"), (width * 8.43).alias("width_px"), (width != 0).alias("visible"))


# the compound container


def stream(data: bytes, names: tuple[str, ...]) -> bytes | None:
    """The first stream of one of these names, in any case, of a compound file; None if there is none."""
    if data[:8] != MARK:
        return None
    book = Compound(io.BytesIO(data))
    entry = book.find(*names)
    return None if entry is None else book.read(entry)


def sound_stream(data: bytes) -> bytes | None:
    """The workbook stream; None if there is none or the file is damaged."""
    try:
        return stream(data, ("Workbook", "Book"))
    except (ValueError, struct.error, IndexError):
        return None


@F.pandas_udf(BinaryType())
def workbook_stream(content: pd.Series) -> pd.Series:
    """The workbook stream of a compound file."""
    return pd.Series([None if c is None else sound_stream(bytes(c)) for c in content], dtype=object)


# Excel 97-2003


def shared_strings(blocks: list[bytes]) -> list[str]:
    """Shared strings of one workbook, across the borders of continued records."""
    out, block, i = [], 0, 8
    total = struct.unpack_from("<I", blocks[0], 4)[0] if blocks and len(blocks[0]) >= 8 else 0

    def take(n: int) -> bytes:
        nonlocal block, i
        got = b""
        while n > 0 and block < len(blocks):
            part = blocks[block][i : i + n]
            got, n, i = got + part, n - len(part), i + len(part)
            if n > 0:
                block, i = block + 1, 0
        return got

    try:
        for _ in range(total):
            if i >= len(blocks[block]):
                block, i = block + 1, 0
            n, flags = struct.unpack("<HB", take(3))
            runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
            extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
            text, wide = "", flags & 1
            while n > 0:
                if i >= len(blocks[block]):  # a string goes on after a flag byte of its own
                    block, i = block + 1, 1
                    wide = blocks[block][0] & 1
                m = min(n, (len(blocks[block]) - i) // (1 + wide))
                text += take(m * (1 + wide)).decode("utf-16-le" if wide else "latin-1")
                n -= m
            take(runs * 4 + extra)
            out.append(text)
    except (struct.error, IndexError):
        pass  # a truncated table ends here
    return out


_BIFF = "n long, offset long, type int, data binary, bof long, sheet_idx int, next binary, text string"


def biff_records(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, n, offset, type, data, bof, sheet_idx, next, text): records of the workbook stream.

    bof: the substream's offset; sheet_idx: the worksheet that it is, if any; next: the string record after a formula and what it shares;
    text: the shared string that a cell names. A file is read once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["k"], b["c"], strict=True):
                every = list(framed(data))
                places = [struct.unpack_from("<I", d)[0] for _, t, d in every if t == 0x85 and len(d) > 5 and d[5] == 0]
                sheet_of = {at: i for i, at in enumerate(places)}
                begin = next((i for i, (_, t, _) in enumerate(every) if t == 0xFC), len(every))
                more = itertools.takewhile(lambda r: r[1] == 0x3C, every[begin + 1 :])
                strings = shared_strings([d for _, _, d in (*every[begin : begin + 1], *more)])
                out, bof = [], None
                for n, (at, t, d) in enumerate(every):
                    bof = at if t == 0x809 else bof
                    after = next((x for x in every[n + 1 : n + 3] if x[1] != 0x4BC), None) if t == 0x06 else None
                    text = None
                    if t == 0xFD and len(d) >= 10 and (i := struct.unpack_from("<I", d, 6)[0]) < len(strings):
                        text = strings[i]
                    out.append((k, n, at, t, d, bof, sheet_of.get(bof), after[2] if after and after[1] == 0x207 else None, text))
                frame = pd.DataFrame(out, columns=["workbook_id", *(c.split()[0] for c in _BIFF.split(", "))])
                yield frame.astype({"sheet_idx": "Int32", "bof": "Int64"})

    return docs.select(F.col(key).alias("k"), workbook_stream(content).alias("c")).mapInPandas(run, f"workbook_id {kind}, {_BIFF}")


def biff_sheets(r: DataFrame) -> DataFrame:
    """(workbook_id, sheet_idx, sheet_name, state, bof) of worksheets, in stored order."""
    s = r.where("type = 133")  # BOUNDSHEET
    d = F.col("data")
    name = F.when(unsigned(d, 7, 1) % 2 == 1, F.decode(F.substring(d, 9, 1 << 10), "UTF-16LE")).otherwise(latin(F.substring(d, 9, 1 << 10)))
    state = F.element_at(F.array(*map(F.lit, ("visible", "hidden", "veryHidden"))), (unsigned(d, 4, 1) % 4 + 1).cast("int"))
    s = s.select("workbook_id", "n", name.alias("sheet_name"), state.alias("state"), unsigned(d, 0, 4).alias("bof"), unsigned(d, 5, 1).alias("kind")).where("kind = 0")
    return s.select("workbook_id", (F.row_number().over(W.partitionBy("workbook_id").orderBy("n")) - 1).alias("sheet_idx"), "sheet_name", "state", "bof")


def rk_number(x: Column) -> Column:
    """Number of an RK value: bit 1 marks an integer, bit 0 hundredths; else the high bits of a double."""
    whole = F.shiftright(F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x), 2).cast("double")
    high = F.unhex(F.lpad(F.hex(x - x % 4), 8, "0"))
    double = f64_le(F.concat(F.lit(b"\0\0\0\0"), *(F.substring(high, i, 1) for i in (4, 3, 2, 1))))
    value = F.when(F.floor(x / 2) % 2 == 1, whole).otherwise(double)
    return F.when(x % 2 == 1, value / 100).otherwise(value)


def scan_xls(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Cells of Excel 97-2003 sheets with xf (style index); shared formulas are joined by range.

    A formula's stored value stays beside it. A file that is no compound file, or has no workbook, has no cells."""
    r = biff_records(docs, key, content)
    d, t = F.col("data"), F.col("type")
    r = r.where("sheet_idx is not null")
    c = r.where(t.isin(0xFD, 0x27E, 0x203, 0x06, 0x201, 0xBE, 0xBD, 0x205))
    # one row for each column of the records that hold several
    count = F.when(t == 0xBD, ((F.length(d) - 6) / 6).cast("int")).when(t == 0xBE, ((F.length(d) - 6) / 2).cast("int")).otherwise(1)
    c = c.withColumn("j", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)))
    place = F.when(t == 0xBD, 4 + F.col("j") * 6).when(t == 0xBE, 4 + F.col("j") * 2).otherwise(4)
    c = c.withColumn("row_idx", unsigned(d, 0, 2)).withColumn("col_idx", unsigned(d, 2, 2) + F.col("j")).withColumn("xf", unsigned(d, place, 2))
    size = unsigned(d, 20, 2).cast("int")
    c = c.withColumn("tokens", F.when(t == 6, F.substring(d, F.lit(23), size)))
    shared = r.where("type = 1212").select(
        "workbook_id", "sheet_idx", F.col("n").alias("sn"), unsigned(d, 0, 2).alias("r1"), unsigned(d, 2, 2).alias("r2"), unsigned(d, 4, 1).alias("c1"), unsigned(d, 5, 1).alias("c2"),
        F.substring(d, F.lit(11), unsigned(d, 8, 2).cast("int")).alias("st"),
    )
    is_shared = F.hex(F.substring("tokens", 1, 1)) == "01"
    at = ["workbook_id", "sheet_idx", "row_idx", "col_idx"]
    first = range_join(c.where(is_shared).select(*at).distinct(), shared, at[:2], "sn")
    first = first.join(shared.select(*at[:2], "sn", F.struct("st", "r1", "c1").alias("g")), [*at[:2], "sn"]).drop("sn")
    c = c.join(first, at, "left").withColumn("is_shared", is_shared)
    # the explicit token list of a shared formula holds offsets from its cell
    tokens = F.when(F.col("is_shared"), F.col("g.st")).otherwise(F.col("tokens"))
    formula = F.when(tokens.isNotNull(), with_equals(ptg_decode(tokens, "row_idx", "col_idx", F.coalesce("g.r1", "row_idx"), F.coalesce("g.c1", "col_idx"))))
    tagged = (t == 6) & (F.hex(F.substring(d, 13, 2)) == "FFFF")
    tag = F.when(tagged, unsigned(d, 6, 1))
    error_code = F.when((t == 0x205) & (unsigned(d, 7, 1) == 1), unsigned(d, 6, 1)).when(tag == 2, unsigned(d, 8, 1))
    error = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ERRORS.items() for x in p)), error_code.cast("int")), F.when(error_code.isNotNull(), F.concat(F.lit("#ERROR"), error_code)))
    flag = F.when((t == 0x205) & (unsigned(d, 7, 1) == 0), unsigned(d, 6, 1) != 0).when(tag == 1, unsigned(d, 8, 1) != 0)
    rk = F.when(t == 0x27E, unsigned(d, 6, 4)).when(t == 0xBD, unsigned(d, place + 2, 4))
    num = F.when(rk.isNotNull(), rk_number(rk)).when((t == 0x203) | ((t == 6) & ~tagged), f64_le(F.substring(d, 7, 8)))
    nd = F.col("next")
    later = F.when(unsigned(nd, 2, 1) % 2 == 1, F.decode(F.substring(nd, 4, 1 << 16), "UTF-16LE")).otherwise(latin(F.substring(nd, 4, 1 << 16)))
    string = F.coalesce(F.when(t == 0xFD, F.col("text")), F.when(tag == 0, later), error)
    v_type = F.when(formula.isNotNull(), "formula").when(num.isNotNull(), "number").when(flag.isNotNull(), "boolean").when(error.isNotNull(), "error").when(F.coalesce(string, F.lit("")) != "", "string").otherwise("empty")
    return cells(c, F.col("xf").cast("int").alias("xf"), kind=v_type, text=string, num=num, flag=flag, formula=formula)


def xls_merges(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, row_idx, col_idx, colspan, rowspan) of merged ranges."""
    r = biff_records(docs, key, content)
    m = r.where("type = 229 and sheet_idx is not null")
    d = F.col("data")
    m = m.select("workbook_id", "sheet_idx", "data", F.explode(F.sequence(F.lit(0), F.greatest(unsigned(d, 0, 2).cast("int"), F.lit(1)) - 1)).alias("k"))
    a, b, x, y = (unsigned(d, 2 + F.col("k") * 8 + i, 2) for i in (0, 2, 4, 6))
    return m.select("workbook_id", "sheet_idx", a.cast("int").alias("row_idx"), x.cast("int").alias("col_idx"), (y - x + 1).cast("int").alias("colspan"), (b - a + 1).cast("int").alias("rowspan"))


def xls_columns(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, sheet_idx, col_idx, width_px, visible): one row a column of each column range."""
    r = biff_records(docs, key, content)
    m = r.where("type = 125 and sheet_idx is not null")
    d = F.col("data")
    m = m.select("workbook_id", "sheet_idx", "data", F.explode(F.sequence(unsigned(d, 0, 2).cast("int"), unsigned(d, 2, 2).cast("int"))).alias("col_idx"))
    return m.select("workbook_id", "sheet_idx", "col_idx", (unsigned(d, 4, 2) / 256 * 8.43).alias("width_px"), (unsigned(d, 8, 2) % 2 == 0).alias("visible"))

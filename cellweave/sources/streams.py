"""Cells of one file as a stream of tuples (sheet, row, column, type, text, number, flag, formula).

What tasks of the data source, the table functions and the XML scans read a file by. Nothing here holds a sheet: text, records and rows are
gone through once, and a caller may stop early. Formats whose scans are plans of expressions (sources.binary, sources.delimited) have the
same results there; tests compare the two.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Container, Iterator
from datetime import UTC, datetime, timedelta
from typing import BinaryIO
from xml.parsers.expat import ExpatError

from cellweave.functions.formulas import ERRORS, ptg, r1c1
from cellweave.sources.xmlstream import Node, fault, stream_nodes

Cell = tuple[int, int, int, str, str | None, float | None, bool | None, str | None]
_NUMBER = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_PREFIX = re.compile(r"_(xlfn|xll|xlws|xlpm|xleta|xlnm)\.", re.IGNORECASE)


def whole_number(text: str | None) -> float | None:
    """The number that text is, white space around it aside."""
    m = _NUMBER.fullmatch((text or "").rstrip())
    return float(m[1]) if m else None


def first_number(text: str | None) -> float | None:
    """The number that text begins with."""
    m = _NUMBER.match(text or "")
    return float(m[1]) if m else None


def integer(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"\s*[+-]?\d+\s*", text) else None


def with_equals(formula: str | None) -> str | None:
    return None if not formula else formula if formula.startswith("=") else "=" + formula


def plain(sheet: int, row: int, col: int, text: str | None) -> Cell:
    return sheet, row, col, "string" if text else "empty", text, None, None, None


# text


def csv_cell(d: str) -> re.Pattern:
    """A cell of delimited text with what ends it; '' as delimiter parts lines only."""
    stop = re.escape(d) + r"\n"
    return re.compile(rf'"[^"]*+(?:""[^"]*+)*+(?:"[^{stop}]*[{stop}]|\Z)|[^{stop}]*[{stop}]')


_QUOTED = re.compile(r'"((?:[^"]|"")*+)')


def csv_values(body: str, delimiter: str = ",", ends: bool = True) -> Iterator[tuple[int, int, str]]:
    """(row, column, value) of delimited text without carriage returns. A delimiter of several characters parts nothing.

    ends: the text ends here; else it is one of several pieces, cut behind a line's end, and its last cell is no file's last."""
    d = delimiter if len(delimiter) == 1 else ""
    closed, row, col, at = body.endswith("\n"), 0, 0, 0
    whole = body if closed else body + "\n"
    for m in csv_cell(d).finditer(whole):
        raw, at = m[0], m.end()
        v = raw[:-1] if raw[-1:] == "\n" or d and raw[-1:] == d else raw
        if v.startswith('"'):
            inner = _QUOTED.match(v)[1]
            v = inner.replace('""', '"') + v[len(inner) + 2 :]
        if len(v) >= 2 and v[0] == v[-1] == '"' and (closed or at < len(whole) or not ends):
            v = v[1:-1]
        yield row, col, v
        row, col = (row + 1, 0) if raw.endswith("\n") else (row, col + 1)


def csv_cells(text: str, delimiter: str = ",") -> Iterator[Cell]:
    return (plain(0, row, col, v) for row, col, v in csv_values(text.replace("\r", ""), delimiter))


def dif_cells(text: str) -> Iterator[Cell]:
    lines = [x.strip(" ") for x in re.sub("\r\n?", "\n", text).split("\n")]
    if "DATA" not in lines:
        return
    body, row, col = iter(lines[lines.index("DATA") + 3 :]), -1, 0
    for head in body:
        value, kind, given = next(body, None), integer(head.split(",", 1)[0]), head.rsplit(",", 1)[-1]
        if kind == -1 and value in ("EOD", "", None):
            return
        if kind == -1 and value == "BOT":
            row, col = row + 1, 0
        if kind is None or kind < 0 or row < 0:
            continue
        num, flag, string = None, None, None
        if kind == 0:
            num = first_number(given)
        elif kind == 1:
            string = re.sub(r'^"(.*)"$', r"\1", value) if value is not None else None
        elif kind == 2:
            code = first_number(given)
            flag, string = (code == 1 if code in (0.0, 1.0) else None), {-1.0: "#ERROR", -2.0: "#N/A"}.get(code)
        shown = "number" if num is not None else "boolean" if flag is not None else "error" if kind == 2 and string else "string" if kind == 1 and string else "empty"
        yield 0, row, col, shown, string, num, flag, None
        col += 1


def sylk_string(raw: str) -> str:
    bare = re.sub(r'^"(.*)"$', r"\1", raw).replace(";;", ";").replace("\x1bN\x0c", "°").replace("\x1bN\x05", "µ")
    return re.sub(r"\x1bN([0-9A-Fa-f]{2})", lambda m: {0x0C: "°", 0x05: "µ"}.get(int(m[1], 16), bytes.fromhex(m[1]).decode("latin-1")), bare)


_FIELD = re.compile(r';([A-Z])((?:"[^"]*"|;;|[^;"])*)')


def sylk_cells(text: str) -> Iterator[Cell]:
    row, col = 0, 0
    for line in re.sub("\r\n?", "\n", text).split("\n"):
        line = line.strip(" ")
        kind = line.split(";", 1)[0]
        if line == "E":
            return
        if kind not in ("C", "F"):
            continue
        f: dict[str, str] = {}
        for name, value in _FIELD.findall(line):
            f.setdefault(name, value)
        y, x = integer(f.get("Y")), integer(f.get("X"))
        row, col = row if y is None else y - 1, col if x is None else x - 1
        if kind == "F":
            continue
        raw, e = f.get("K"), f.get("E")
        num = None if raw is None or raw.startswith('"') else first_number(raw)
        string = None if raw is None or num is not None else sylk_string(raw)
        formula = with_equals(r1c1(e, row, col))
        yield 0, row, col, "formula" if e is not None else "number" if num is not None else "string" if string else "empty", string, num, None, formula
        col += 1


def html_cells(text: str, table_index: int | None = 0, first_row_as_header: bool = True) -> Iterator[Cell]:
    from cellweave.sources.markup import laid_out

    for table, placed in laid_out(text):
        if table_index is not None and table != table_index:
            continue
        head = int(first_row_as_header)
        for c, row, col in placed:
            if row >= head:
                v, f = c[6].strip(), with_equals(c[7])
                yield table if table_index is None else 0, row - head, col, "formula" if f else "string" if v else "empty", v, None, None, f


def spreadsheetml(source: BinaryIO | str) -> Iterator[tuple[Node, Cell]]:
    """Each cell's element and cell. An Index attribute jumps ahead; a cell takes as many places as it spans columns."""
    sheet, row = -1, 0
    for node in stream_nodes(source, {"Row"}, {"Worksheet"}):
        if node.name == "Worksheet":
            sheet, row = sheet + 1, 0
            continue
        index = node.number("Index")
        row, col = row if index is None else index - 1, 0
        for c in node.all("Cell"):
            index = c.number("Index")
            col = col if index is None else index - 1
            data = c.first("Data")
            raw, kind = (data.text() or None, data.attrib.get("Type")) if data is not None else (None, None)
            num = whole_number(raw) if kind == "Number" else None
            flag = raw.lower() in ("1", "true") if kind == "Boolean" and raw is not None else None
            f = with_equals(r1c1(c.attrib.get("Formula"), row, col))
            shown = "formula" if f else "number" if num is not None else "boolean" if flag is not None else "error" if kind == "Error" else "string" if raw else "empty"
            yield c, (max(sheet, 0), row, col, shown, raw if num is None and flag is None else None, num, flag, f)
            col += (c.number("MergeAcross") or 0) + 1
        row += 1


# binary


def _latin(data: bytes) -> str:
    return data.decode("latin-1")


def dbf_header(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int, int]]]:
    """(records, header bytes, record bytes, fields: name, type, length, decimals, offset) of a table whose header these bytes hold."""
    n, head, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 1
    for i in range(32, min(head, len(data)) - 32, 32):
        one = data[i : i + 32]
        if one[0] in (0x0D, 0):
            continue
        fields.append((_latin(one[:11]).split("\0")[0], chr(one[11]), one[16], one[17], at))
        at += one[16]
    return n, head, size, fields


def dbf_value(kind: str, raw: bytes) -> tuple[str | None, float | None, bool | None]:
    """(text, number, flag) of a stored field."""
    s = _latin(raw).strip(" ").replace("\0", "")
    if kind in "NF":
        return None, whole_number(s), None
    if kind in "I+":
        return None, float(int.from_bytes(raw[:4], "little", signed=True)) if len(raw) >= 4 else None, None
    if kind == "Y":
        return None, int.from_bytes(raw[:8], "little", signed=True) / 10000 if len(raw) >= 8 else None, None
    if kind in "BO" and len(raw) == 8:
        return None, struct.unpack("<d", raw)[0], None
    if kind == "L":
        return None, None, True if s in ("T", "t", "Y", "y") else False if s in ("F", "f", "N", "n") else None
    if kind == "D":
        return (f"{s[:4]}-{s[4:6]}-{s[6:]}" if len(s) == 8 and s.isdigit() else None), None, None
    if kind == "T" and len(raw) >= 8 and (day := int.from_bytes(raw[:4], "little")) > 0:
        t = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(days=day - 2440588, milliseconds=int.from_bytes(raw[4:8], "little"))
        return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z", None, None
    if kind in "GP":
        return f"<binary:{len(raw)} bytes>", None, None
    return (s or None) if kind in "CMV@" else None, None, None


def dbf_cells(f: BinaryIO) -> Iterator[Cell]:
    lead = f.read(32)
    if len(lead) < 32:
        return
    head = lead + f.read(max(0, struct.unpack_from("<H", lead, 8)[0] - 32))
    n, _, size, fields = dbf_header(head)
    row = 0
    for _ in range(n):
        data = f.read(size)
        if not data:
            return
        if data[:1] == b"*":
            continue
        for col, (_, kind, length, _, at) in enumerate(fields):
            string, num, flag = dbf_value(kind, data[at : at + length])
            yield 0, row, col, "number" if num is not None else "boolean" if flag is not None else "string" if string is not None else "empty", string, num, flag, None
        row += 1


def framed(f: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(type, payload) of records of u16 type and u16 length; a cut-off record ends the list."""
    while len(head := f.read(4)) == 4:
        kind, size = struct.unpack("<HH", head)
        data = f.read(size)
        if len(data) < size:
            return
        yield kind, data


def lotus_cells(f: BinaryIO) -> Iterator[Cell]:
    records = framed(f)
    first = next(records, None)
    if first is None or first[0] != 0:
        return
    sheet, held = 0, None

    def one(t: int, d: bytes, text: bytes | None) -> Cell:
        col, row = struct.unpack_from("<HH", d, 1)
        num, string = None, None
        if t == 13:
            num = float(struct.unpack_from("<h", d, 5)[0])
        elif t == 14 or t == 16 and text is None:
            num = struct.unpack_from("<d", d, 5)[0] if len(d) >= 13 else None
        elif t in (15, 16):
            string = _latin((d[6:] if t == 15 else text[5:])).replace("\0", "")
        return sheet, row, col, "number" if num is not None else "string" if string is not None else "empty", string, num, None, None

    for t, d in records:
        if held is not None:
            yield one(*held, d if t == 51 else None)
            held = None
        if t == 141 and len(d) >= 2:
            sheet = struct.unpack_from("<H", d)[0]
        if t in (12, 13, 14, 15, 16) and len(d) >= 5:
            held = (t, d)
    if held is not None:
        yield one(*held, None)


def xls_sheets(book: bytes) -> list[int]:
    """Offset of each worksheet's substream, in stored order."""
    out = []
    for t, d in framed(io.BytesIO(book)):
        if t == 0x85 and len(d) > 5 and d[5] == 0:
            out.append(struct.unpack_from("<I", d)[0])
        elif t == 0x0A:
            break
    return out


def xls_strings(book: bytes) -> list[str]:
    from cellweave.sources.binary import shared_strings

    blocks: list[bytes] = []
    for t, d in framed(io.BytesIO(book)):
        if t == 0xFC or blocks and t == 0x3C:
            blocks.append(d)
        elif blocks or t == 0x0A:
            break
    return shared_strings(blocks)


def _rk(x: int) -> float:
    signed = x - (1 << 32) if x >= 1 << 31 else x
    value = float(signed >> 2) if x & 2 else struct.unpack("<d", bytes(4) + struct.pack("<I", x & 0xFFFFFFFC))[0]
    return value / 100 if x & 1 else value


def xls_cells(book: bytes, sheet: int, at: int, strings: list[str], last: int | None = None) -> Iterator[Cell]:
    """Cells of the worksheet whose substream begins at this offset. Shared formulas follow their first cell, so they are gathered first."""

    def records() -> Iterator[tuple[int, bytes]]:
        f, depth = io.BytesIO(book), 0
        f.seek(at)
        for t, d in framed(f):
            depth += (t == 0x809) - (t == 0x0A)
            if t == 0x0A and depth <= 0:
                return
            if depth == 1:
                yield t, d

    by_row: dict[int, list[tuple]] = {}
    for t, d in records():
        if t == 0x4BC and len(d) >= 10:
            r1, r2, c1, c2 = struct.unpack_from("<HHBB", d)
            for r in range(r1, r2 + 1):
                by_row.setdefault(r, []).append((c1, c2, r1, d[10 : 10 + struct.unpack_from("<H", d, 8)[0]]))
    held = None

    def formula_cell(d: bytes, text: bytes | None) -> Cell:
        row, col = struct.unpack_from("<HH", d)
        tokens = d[22 : 22 + struct.unpack_from("<H", d, 20)[0]]
        base_row, base_col = row, col
        if tokens[:1] == b"\x01":
            for c1, c2, r1, own in by_row.get(row, ()):
                if c1 <= col <= c2:
                    tokens, base_row, base_col = own, r1, c1
                    break
        formula = with_equals(ptg(tokens, row, col, base_row, base_col))
        num, flag, string, error = None, None, None, None
        if d[12:14] != b"\xff\xff":
            num = struct.unpack_from("<d", d, 6)[0]
        elif d[6] == 1:
            flag = d[8] != 0
        elif d[6] == 2:
            string = error = ERRORS.get(d[8], f"#ERROR{d[8]}")
        elif d[6] == 0 and text is not None:
            string = text[3:].decode("utf-16-le", "replace") if text[2] & 1 else _latin(text[3:])
        shown = "formula" if formula else "number" if num is not None else "boolean" if flag is not None else "error" if error else "string" if string else "empty"
        return sheet, row, col, shown, string, num, flag, formula

    for t, d in records():
        if held is not None and t != 0x4BC:
            yield formula_cell(held, d if t == 0x207 and len(d) >= 3 else None)
            held = None
        row, col = struct.unpack_from("<HH", d) if len(d) >= 4 else (0, 0)
        if last is not None and t in (0xFD, 0x27E, 0x203, 0x06, 0x201, 0xBE, 0xBD, 0x205) and row > last:
            continue
        if t == 0x06 and len(d) >= 22:
            held = d
        elif t == 0xFD and len(d) >= 10:
            i = struct.unpack_from("<I", d, 6)[0]
            yield plain(sheet, row, col, strings[i] if i < len(strings) else None)
        elif t == 0x27E and len(d) >= 10:
            yield sheet, row, col, "number", None, _rk(struct.unpack_from("<I", d, 6)[0]), None, None
        elif t == 0xBD:
            for j in range((len(d) - 6) // 6):
                yield sheet, row, col + j, "number", None, _rk(struct.unpack_from("<I", d, 6 + 6 * j)[0]), None, None
        elif t == 0x203 and len(d) >= 14:
            yield sheet, row, col, "number", None, struct.unpack_from("<d", d, 6)[0], None, None
        elif t in (0x201, 0xBE):
            for j in range((len(d) - 6) // 2 if t == 0xBE else 1):
                yield plain(sheet, row, col + j, None)
        elif t == 0x205 and len(d) >= 8:
            if d[7] == 1:
                yield sheet, row, col, "error", ERRORS.get(d[6], f"#ERROR{d[6]}"), None, None, None
            else:
                yield sheet, row, col, "boolean", None, None, d[6] != 0, None
    if held is not None:
        yield formula_cell(held, None)


# archives

#: What reading a damaged file raises.
DAMAGE = (zipfile.BadZipFile, zlib.error, ExpatError, ValueError, struct.error, IndexError, EOFError, NotImplementedError)


def archive_fault(z: zipfile.ZipFile, kind: str, sheets: Container[int] | None = None) -> str | None:
    """What is wrong with the parts that hold cells (those of some sheets), or None: each is parsed once, and nothing of it is kept."""
    names = set(z.namelist())
    if ("xl/workbook.xml" if kind == "xlsx" else "content.xml") not in names:
        return "No workbook in the archive"
    parts = ["content.xml"]
    if kind == "xlsx":
        parts = [n for n in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml") if n in names]
    try:
        for part in parts:
            with z.open(part) as f:
                if wrong := fault(f):
                    return f"A damaged part: {part}: {wrong}"
        for i, part in enumerate(xlsx_parts_of(z) if kind == "xlsx" else ()):
            if sheets is not None and i not in sheets:
                continue
            if part not in names:
                return f"A missing part: {part}"
            with z.open(part) as f:
                if wrong := fault(f, {"row": "r"}):
                    return f"A damaged part: {part}: {wrong}"
    except DAMAGE as e:
        return f"A damaged part: {e}"
    return None


def archive_damage(data: bytes | None, kind: str) -> str | None:
    """archive_fault of an archive's bytes; None: sound."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            return archive_fault(z, kind)
    except DAMAGE:
        return "Not a zip archive"


def xlsx_parts_of(z: zipfile.ZipFile) -> list[str]:
    """Parts of the sheets in stored order, by their relationships or else by their position."""
    names, to = set(z.namelist()), {}
    if "xl/_rels/workbook.xml.rels" in names:
        with z.open("xl/_rels/workbook.xml.rels") as f:
            to = {r.attrib.get("Id"): r.attrib.get("Target", "") for r in stream_nodes(f, set(), {"Relationship"})}
    out = []
    with z.open("xl/workbook.xml") as f:
        for i, s in enumerate(stream_nodes(f, set(), {"sheet"})):
            target = to.get(s.attrib.get("id"), f"worksheets/sheet{i + 1}.xml")
            out.append(target[1:] if target.startswith("/") else "xl/" + target)
    return out


def xlsx_string(item: Node) -> str:
    """Text of a string item: its own or that of its runs; phonetic hints are no part of it."""
    own = item.first("t")
    return own.text() if own is not None else "".join(t.text() for r in item.all("r") for t in r.all("t"))


def xlsx_strings_of(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return [xlsx_string(si) for si in stream_nodes(f, {"si"})]


def column_of(ref: str | None) -> int | None:
    m = re.match("[A-Z]+", ref or "")
    if not m:
        return None
    n = 0
    for a in m[0]:
        n = 26 * n + ord(a) - 64
    return n - 1


def xlsx_stored(z: zipfile.ZipFile, sheet: int, part: str, strings: list[str], last: int | None = None) -> Iterator[tuple]:
    """(sheet, row, column, xf, type, value, formula, text) of a sheet's cells as stored, row by row; rows after the last wanted aren't read."""
    if part not in z.namelist():
        return
    with z.open(part) as f:
        for p, node in enumerate(stream_nodes(f, {"row"})):
            row = int(node.attrib.get("r") or p + 1) - 1
            if last is not None and row > last:
                return
            for q, c in enumerate(node.all("c")):
                col, t = column_of(c.attrib.get("r")), c.attrib.get("t", "n")
                v, formula, inline = c.first("v"), c.first("f"), c.first("is")
                raw = None if v is None else v.text() or None
                text = xlsx_string(inline) if inline is not None else None
                if t == "s":
                    text = strings[int(raw)] if raw and raw.isdigit() and int(raw) < len(strings) else text
                yield sheet, row, q if col is None else col, int(c.attrib.get("s") or 0), t, raw, None if formula is None else formula.text() or None, text


def xlsx_cell(sheet: int, row: int, col: int, _xf: int, t: str, raw: str | None, formula: str | None, text: str | None) -> Cell:
    num = whole_number(raw) if t == "n" else None
    flag = raw == "1" if t == "b" and raw is not None else None
    f = with_equals(_PREFIX.sub("", formula)) if formula else None
    string = text if t in ("s", "inlineStr") else raw if t in ("str", "d", "e") or t == "n" and num is None else None
    return sheet, row, col, "formula" if f else "number" if num is not None else "boolean" if flag is not None else "error" if t == "e" else "string" if string else "empty", string, num, flag, f


def ods_formula(stored: str) -> str | None:
    """Formula without its prefix; references lose brackets and dots, semicolons outside strings become commas."""
    name = r"\$?('[^']*'|[^\[\].:]+)"
    bare = re.sub(r"^(of|oooc|msoxl):", "", stored)
    bare = re.sub(rf"\[{name}\.([^\[\]:.]+):(?:\$?(?:'[^']*'|[^\[\].:]+))?\.([^\[\]]+)\]", r"\1!\2:\3", bare)
    bare = re.sub(rf"\[{name}\.([^\[\]:.]+)\]", r"\1!\2", bare)
    bare = re.sub(r"\[\.([^\[\]]+)\]", r"\1", re.sub(r"\[\.([^\[\]:]+):\.([^\[\]]+)\]", r"\1:\2", bare))
    return with_equals('"'.join(s.replace(";", ",") if i % 2 == 0 else s for i, s in enumerate(bare.split('"'))))


def ods_rows(f: BinaryIO, sheet: int | None = None) -> Iterator[tuple[int, int, int, Node]]:
    """(sheet, first row, repeats, element) of each row of all tables or of one; after that one nothing is read."""
    n, row = -1, 0
    for node in stream_nodes(f, {"table-row"}, {"table"}):
        if node.name == "table":
            n, row = n + 1, 0
            if sheet is not None and n > sheet:
                return
            continue
        times = node.number("number-rows-repeated") or 1
        if sheet is None or n == sheet:
            yield n, row, times, node
        row += times


def ods_cells(f: BinaryIO, sheet: int | None = None, last: int | None = None) -> Iterator[tuple[Node, Cell]]:
    """Each cell's element and cell; what repeats with content is given as often, its formula once."""
    for n, first_row, times, node in ods_rows(f, sheet):
        if last is not None and first_row > last:
            if sheet is not None:
                return
            continue
        laid, col = [], 0
        for c in node.content:
            if not isinstance(c, Node) or c.name not in ("table-cell", "covered-table-cell"):
                continue
            wide, first_col = c.number("number-columns-repeated") or 1, col
            if c.name == "table-cell":
                text, kind, a = "\n".join(p.text() for p in c.all("p")), c.attrib.get("value-type"), c.attrib
                if kind is not None or text or "formula" in a or c.first("annotation") or (c.number("number-columns-spanned") or 0) > 1 or (c.number("number-rows-spanned") or 0) > 1:
                    num = whole_number(a.get("value")) if kind in ("float", "percentage", "currency") else None
                    flag = a.get("boolean-value") == "true" if kind == "boolean" and "boolean-value" in a else None
                    string = a.get("date-value") if kind == "date" else a.get("time-value") if kind == "time" else text if num is None and flag is None else None
                    shown = "number" if num is not None else "boolean" if flag is not None else "string" if string else "empty"
                    laid.append((first_col, wide, shown, string, num, flag, ods_formula(a["formula"]) if "formula" in a else None, c))
                col += wide
        for row in range(first_row, first_row + times):
            for first_col, wide, shown, string, num, flag, formula, c in laid:
                for x in range(first_col, first_col + wide):
                    own = formula if (row, x) == (first_row, first_col) else None
                    yield c, (n, row, x, "formula" if own else shown, string, num, flag, own)

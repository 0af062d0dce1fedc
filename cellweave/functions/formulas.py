"""Formula text: R1C1 to A1, and decompilation of stored formula tokens. Both run in Arrow batches."""

from __future__ import annotations

import re
import struct
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_R1C1 = re.compile(r"(?<![A-Za-z0-9_.$!'\"])R(\[-?\d+\]|\d+)?C(\[-?\d+\]|\d+)?(?![A-Za-z0-9_(.])")

# Operators by opcode, with the text of a missing operand, and error texts by code.
BINARY = {0x03: "+", 0x04: "-", 0x05: "*", 0x06: "/", 0x07: "^", 0x08: "&", 0x09: "<", 0x0A: "<=", 0x0B: "=", 0x0C: ">=", 0x0D: ">", 0x0E: "<>", 0x0F: " ", 0x10: ",", 0x11: ":"}
MISSING = {0x08: '""', 0x0F: "A1", 0x10: "A1", 0x11: "A1"}
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
# Index and name of worksheet functions, and the number of arguments of those that store no count.
_TABLE = """
0 COUNT, 1 IF, 2 ISNA/1, 3 ISERROR/1, 4 SUM, 5 AVERAGE, 6 MIN, 7 MAX, 8 ROW, 9 COLUMN, 10 NA/0, 11 NPV, 12 STDEV, 13 DOLLAR, 14 FIXED, 15 SIN/1,
16 COS/1, 17 TAN/1, 18 ATAN/1, 19 PI/0, 20 SQRT/1, 21 EXP/1, 22 LN/1, 23 LOG10/1, 24 ABS/1, 25 INT/1, 26 SIGN/1, 27 ROUND/2, 28 LOOKUP, 29 INDEX,
30 REPT/2, 31 MID/3, 32 LEN/1, 33 VALUE/1, 34 TRUE/0, 35 FALSE/0, 36 AND, 37 OR, 38 NOT/1, 39 MOD/2, 40 DCOUNT/3, 41 DSUM/3, 42 DAVERAGE/3, 43 DMIN/3,
44 DMAX/3, 45 DSTDEV/3, 46 VAR, 47 DVAR/3, 48 TEXT/2, 56 PV, 57 FV, 58 NPER, 59 PMT, 60 RATE, 61 MIRR/3, 63 RAND/0, 64 MATCH, 65 DATE/3, 66 TIME/3,
67 DAY/1, 68 MONTH/1, 69 YEAR/1, 70 WEEKDAY, 71 HOUR/1, 72 MINUTE/1, 73 SECOND/1, 74 NOW/0, 75 AREAS/1, 76 ROWS/1, 77 COLUMNS/1, 78 OFFSET, 82 SEARCH,
83 TRANSPOSE/1, 86 TYPE/1, 97 ATAN2/2, 98 ASIN/1, 99 ACOS/1, 100 CHOOSE, 101 HLOOKUP, 102 VLOOKUP, 105 ISREF/1, 109 LOG, 111 CHAR/1, 112 LOWER/1,
113 UPPER/1, 114 PROPER/1, 115 LEFT, 116 RIGHT, 117 EXACT/2, 118 TRIM/1, 119 REPLACE/4, 120 SUBSTITUTE, 121 CODE/1, 124 FIND, 126 ISERR/1,
127 ISTEXT/1, 128 ISNUMBER/1, 129 ISBLANK/1, 130 T/1, 131 N/1, 140 DATEVALUE/1, 141 TIMEVALUE/1, 142 SLN/3, 143 SYD/4, 148 INDIRECT, 162 CLEAN/1,
163 MDETERM/1, 164 MINVERSE/1, 165 MMULT/2, 169 COUNTA, 183 PRODUCT, 184 FACT/1, 189 DPRODUCT/3, 190 ISNONTEXT/1, 195 DSTDEVP/3, 196 DVARP/3,
197 TRUNC, 198 ISLOGICAL/1, 199 DCOUNTA/3, 207 REPLACEB/4, 210 MIDB/3, 211 LENB/1, 212 ROUNDUP/2, 213 ROUNDDOWN/2, 214 ASC/1, 215 DBCS/1, 216 RANK,
219 ADDRESS, 221 TODAY/0, 227 MEDIAN, 228 SUMPRODUCT, 229 SINH/1, 230 COSH/1, 231 TANH/1, 232 ASINH/1, 233 ACOSH/1, 234 ATANH/1, 235 DGET/3,
244 INFO/1, 252 FREQUENCY/2, 261 ERROR.TYPE/1, 271 GAMMALN/1, 273 BINOMDIST/4, 274 CHIDIST/2, 275 CHIINV/2, 276 COMBIN/2, 277 CONFIDENCE/3,
278 CRITBINOM/3, 279 EVEN/1, 280 EXPONDIST/3, 281 FDIST/3, 282 FINV/3, 283 FISHER/1, 284 FISHERINV/1, 285 FLOOR/2, 286 GAMMADIST/4, 287 GAMMAINV/3,
288 CEILING/2, 289 HYPGEOMDIST/4, 290 LOGNORMDIST/3, 291 LOGINV/3, 292 NEGBINOMDIST/3, 293 NORMDIST/4, 294 NORMSDIST/1, 295 NORMINV/3, 296 NORMSINV/1,
297 STANDARDIZE/3, 298 ODD/1, 299 PERMUT/2, 300 POISSON/3, 301 TDIST/3, 302 WEIBULL/4, 303 SUMXMY2/2, 304 SUMX2MY2/2, 305 SUMX2PY2/2, 306 CHITEST/2,
307 CORREL/2, 308 COVAR/2, 309 FORECAST/3, 310 FTEST/2, 311 INTERCEPT/2, 312 PEARSON/2, 313 RSQ/2, 314 STEYX/2, 315 SLOPE/2, 316 TTEST/4, 325 LARGE/2,
326 SMALL/2, 327 QUARTILE/2, 328 PERCENTILE/2, 331 TRIMMEAN/2, 332 TINV/2, 337 POWER/2, 342 RADIANS/1, 343 DEGREES/1, 345 SUMIF, 346 COUNTIF/2,
347 COUNTBLANK/1, 350 ISPMT/4, 351 DATEDIF/3
"""
_ROWS = [row.split() for row in _TABLE.replace("\n", " ").split(",")]
FUNCTIONS = {int(i): name.split("/")[0] for i, name in _ROWS}
ARITY = {int(i): int(name.split("/")[1]) for i, name in _ROWS if "/" in name}
# Bytes of tokens, opcode included, that leave no operand, and of those that leave one.
LENGTHS = {0x01: 5, 0x02: 5, 0x26: 7, 0x27: 7, 0x28: 7, 0x29: 3}
OPERANDS = {0x20: 8, 0x23: 5, 0x2A: 5, 0x2B: 9, 0x39: 7, 0x3A: 7, 0x3B: 11, 0x3C: 7, 0x3D: 11}


def letters(n: int) -> str:
    out, n = "", n + 1
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def r1c1(text: str | None, row: int | None, col: int | None) -> str | None:
    """A1 form of one formula for the cell at 0-based row and col; without any of them, null."""
    if text is None or row is None or col is None:
        return None

    def one(part: str | None, base: int, name) -> str:
        if part and part[0] != "[":
            return "$" + name(int(part) - 1)
        return name(max(0, base + (int(part[1:-1]) if part else 0)))

    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'")):
        text = re.sub(entity, char, text, flags=re.I)
    return _R1C1.sub(lambda m: one(m[2], col, letters) + one(m[1], row, lambda r: str(r + 1)), text)


def whole(*values) -> list[int | None]:
    """Integers as pandas holds them, which may be floats or missing."""
    return [None if v is None or v != v else int(v) for v in values]


@F.pandas_udf(StringType())
def r1c1_to_a1(text: pd.Series, row: pd.Series, col: pd.Series) -> pd.Series:
    """A1 form of R1C1 formulas; names that merely hold RC are left alone, null stays null."""
    return pd.Series([r1c1(t, *whole(r, c)) for t, r, c in zip(text, row, col, strict=True)], dtype=object)


def number(x: float) -> str:
    if not isfinite(x):
        return "#NUM!"
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x).replace("e-0", "e-")


def ptg(tokens: bytes | None, row: int = 0, col: int = 0, base_row: int = 0, base_col: int = 0, strict: bool = False, names: dict[int, str] = FUNCTIONS, arity: dict[int, int] = ARITY) -> str:
    """Infix text of reverse-Polish tokens; '' for none. strict: fixed functions without arguments take one operand.

    Names that a workbook defines and sheets that references name are known by number here: NAME1, SHEET1!A1. names and
    arity may be given whole; a fixed function that arity lacks is taken to have one argument."""
    data, i, stack = tokens or b"", 0, []

    def ref(r: int, c: int, dr: int, dc: int) -> str:
        # a set bit marks a relative part
        y, x = (r + dr if c & 0x8000 else r), ((c & 0xFF) + dc if c & 0x4000 else c & 0xFF)
        return ("" if c & 0x4000 else "$") + letters(max(x, 0)) + ("" if c & 0x8000 else "$") + str(max(y, 0) + 1)

    def offset(r: int, c: int) -> str:
        y = (r - 0x10000 if r & 0x8000 else r) + row if c & 0x8000 else r
        x = c & 0xFF
        x = (x - 256 if x & 0x80 else x) + col if c & 0x4000 else x
        return ("" if c & 0x4000 else "$") + letters(x % 256) + ("" if c & 0x8000 else "$") + str(y % 65536 + 1)

    def other(op: int, at: int) -> str:
        if at + OPERANDS[op] > len(data):
            raise IndexError
        n = struct.unpack_from("<H", data, at + 1)[0]
        if op == 0x3A:
            return f"SHEET{n + 1}!{ref(*struct.unpack_from('<HH', data, at + 3), 0, 0)}"
        if op == 0x3B:
            r1, r2, c1, c2 = struct.unpack_from("<HHHH", data, at + 3)
            return f"SHEET{n + 1}!{ref(r1, c1, 0, 0)}:{ref(r2, c2, 0, 0)}"
        return {0x20: "{}", 0x23: f"NAME{n}", 0x39: f"NAME{struct.unpack_from('<H', data, at + 3)[0]}"}.get(op, "#REF!")

    try:
        while i < len(data):
            op = data[i]
            op = (op & 0x1F) | 0x20 if op >= 0x20 else op
            if op in BINARY:
                b = stack.pop() if stack else MISSING.get(op, "0")
                a = stack.pop() if stack else MISSING.get(op, "0")
                blank = MISSING.get(op, "0")
                stack.append((a or blank) + BINARY[op] + (b or blank))
                i += 1
            elif op in (0x12, 0x13, 0x14, 0x15):
                x = stack.pop() if stack else "0"
                stack.append({0x12: f"+{x}", 0x13: f"-{x}", 0x14: f"{x}%", 0x15: f"({x})"}[op])
                i += 1
            elif op == 0x16:
                stack.append("")
                i += 1
            elif op == 0x17:
                n, wide = data[i + 1], data[i + 2] & 1
                stack.append('"' + data[i + 3 : i + 3 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1") + '"')
                i += 3 + n * (1 + wide)
            elif op == 0x19:
                if data[i + 1] & 0x10:
                    stack.append(f"SUM({stack.pop() if stack else ''})")
                i += 4 + (2 * (int.from_bytes(data[i + 2 : i + 4], "little") + 1) if data[i + 1] & 0x04 else 0)
            elif op == 0x1C:
                stack.append(ERRORS.get(data[i + 1], "#ERROR"))
                i += 2
            elif op == 0x1D:
                stack.append("TRUE" if data[i + 1] else "FALSE")
                i += 2
            elif op == 0x1E:
                stack.append(str(struct.unpack_from("<H", data, i + 1)[0]))
                i += 3
            elif op == 0x1F:
                stack.append(number(struct.unpack_from("<d", data, i + 1)[0]))
                i += 9
            elif op in (0x24, 0x2C):
                r, c = struct.unpack_from("<HH", data, i + 1)
                stack.append(ref(r, c, 0, 0) if op == 0x24 else offset(r, c))
                i += 5
            elif op in (0x25, 0x2D):
                r1, r2, c1, c2 = struct.unpack_from("<HHHH", data, i + 1)
                dr, dc = row - base_row, col - base_col
                stack.append(f"{ref(r1, c1, dr, dc)}:{ref(r2, c2, dr, dc)}" if op == 0x25 else f"{offset(r1, c1)}:{offset(r2, c2)}")
                i += 9
            elif op in (0x21, 0x22):
                if op == 0x21:
                    which = struct.unpack_from("<H", data, i + 1)[0]
                    n = arity.get(which, 1) or (1 if strict else 0)
                    i += 3
                else:
                    n, which = data[i + 1] & 0x7F, struct.unpack_from("<H", data, i + 2)[0] & 0x7FFF
                    i += 4
                args = stack[len(stack) - n :] if n else []
                del stack[len(stack) - len(args) :]
                stack.append(f"{names.get(which, f'FUNC{which}')}({','.join(args)})")
            elif op in OPERANDS:
                stack.append(other(op, i))
                i += OPERANDS[op]
            else:
                i += LENGTHS.get(op, 1)
    except (struct.error, IndexError, UnicodeDecodeError):
        pass  # a truncated token ends the formula
    return stack[-1] if stack else ""


@F.pandas_udf(StringType())
def ptg_decode(tokens: pd.Series, row: pd.Series, col: pd.Series, base_row: pd.Series, base_col: pd.Series) -> pd.Series:
    """Formula text of tokens in the cell at row and col; a shared formula's own cell is at base_row and base_col. Null places count as 0."""
    places = ([x or 0 for x in whole(*at)] for at in zip(row, col, base_row, base_col, strict=True))
    return pd.Series([ptg(t, *at) for t, at in zip(tokens, places, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def f64_le(data: pd.Series) -> pd.Series:
    """The double in the first eight bytes, little-endian; null where there are fewer."""
    raw = [x if x is not None and len(x) >= 8 else None for x in data]
    values = np.frombuffer(b"".join(bytes(8) if x is None else x[:8] for x in raw), "<f8")
    return pd.Series(values).mask(pd.Series([x is None for x in raw], dtype=bool))

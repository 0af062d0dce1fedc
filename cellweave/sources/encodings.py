"""Which encoding bytes of text are in, without a library: by mark, by validity, and for DIF by likely signs."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks at the start of text, and the order in which DIF text is tried.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))
DIF_ORDER = ("cp850", "cp437", "latin1", "utf-8", "utf-16le")


def detect(data: bytes | None) -> str:
    """A mark's encoding; else UTF-16 where every other byte is mostly zero; else UTF-8 if all bytes fit; else latin1."""
    data = data or b""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    even, odd = data[0::2].count(0), data[1::2].count(0)
    if len(data) >= 4 and max(even, odd) * 5 > len(data):
        return "utf-16le" if odd > even else "utf-16be"
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return "latin1"
    return "utf-8"


def dif_score(text: str) -> int:
    """How likely text was decoded as it was meant: lost characters and controls speak against it, common signs for it."""
    signs = {"°": 100, "µ": 50, "±": 50}
    controls = sum(1 for c in text if ord(c) < 32 and c not in "\t\n\r")
    return sum(n for c, n in signs.items() if c in text) - 1000 * text.count("\ufffd") - 10 * controls


def detect_dif(data: bytes | None) -> str:
    """The encoding of DIF bytes: the detected one and then DIF_ORDER; the first that loses nothing and scores over 50, else the best, of equals the first.

    latin1 where all score below 0."""
    first = detect(data)
    best = (-1, "latin1")
    for name in ([first] if first in DIF_ORDER else []) + [e for e in DIF_ORDER if e != first]:
        text = (data or b"").decode(name, "replace")
        score = dif_score(text)
        if score > 50 and "\ufffd" not in text:
            return name
        if score > best[0]:
            best = score, name
    return best[1]


@F.pandas_udf(StringType())
def encoding_of(data: pd.Series) -> pd.Series:
    """The encoding of each text's bytes; null bytes count as none."""
    return pd.Series([detect(None if x is None else bytes(x)) for x in data], dtype=object)


@F.pandas_udf(StringType())
def dif_encoding_of(data: pd.Series) -> pd.Series:
    return pd.Series([detect_dif(None if x is None else bytes(x)) for x in data], dtype=object)


@F.pandas_udf(StringType())
def decoded_as(data: pd.Series, name: pd.Series) -> pd.Series:
    """Text of bytes in a named encoding, without a mark at its start; what does not fit becomes U+FFFD. An unknown name is UTF-8."""

    def one(x: bytes | None, encoding: str | None) -> str | None:
        if x is None:
            return None
        try:
            codecs.lookup(encoding or "utf-8")
        except LookupError:
            encoding = "utf-8"
        return bytes(x).decode(encoding or "utf-8", "replace").removeprefix("﻿")

    return pd.Series([one(x, n) for x, n in zip(data, name, strict=True)], dtype=object)

"""Lengths and numbers as the spreadsheet formats give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pixels of a point, of a character, of a centimetre and of an inch; EMU of a pixel.
POINT, CHARACTER, CENTIMETRE, INCH, EMU = 7.15, 8.43, 37.795, 96.0, 9525.0
DEFAULT_WIDTH = 100


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards also below zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def width_px(width: Column, unit: Column | None = None) -> Column:
    """Pixels of a width in pt, char or px, other units as pt; null, NaN and 0 give 100."""
    w = width.cast("double")
    unit = F.lit("pt") if unit is None else F.coalesce(unit, F.lit("pt"))
    times = F.when(unit == "char", F.lit(CHARACTER)).when(unit == "px", F.lit(1.0)).otherwise(F.lit(POINT))
    return F.when(w.isNull() | F.isnan(w) | (w == 0), F.lit(DEFAULT_WIDTH).cast("long")).otherwise(half_up(w * times))


def emu_px(emu: Column) -> Column:
    return half_up(emu.cast("double") / F.lit(EMU))


def length_px(text: Column) -> Column:
    """Pixels of a length with its unit: cm, in, pt or px."""
    number = F.regexp_extract(text, r"^([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(text, r"([a-z]+)$", 1)
    return number * F.when(unit == "cm", CENTIMETRE).when(unit == "in", INCH).when(unit == "pt", POINT).otherwise(1.0)


def number_prefix(text: Column) -> Column:
    """The number that text begins with, after white space; null if none."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def number_text(x: Column) -> Column:
    """Text of a number without a trailing .0 where it is integral and below 1e21."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e18))
    return F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(F.lower(F.regexp_replace(x.cast("string"), r"(\.0)?E(-?)", r"e$2")))


def serial_timestamp(serial: Column) -> Column:
    """Timestamp of a spreadsheet day number of the 1900 system."""
    return F.timestamp_micros(((serial.cast("double") - F.lit(25569.0)) * F.lit(86400e6)).cast("long"))

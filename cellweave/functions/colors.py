"""Colours as Column expressions: hex, RGB, HSL and tints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

THIRD = 1.0 / 3.0


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once, so that nested formulas don't repeat their parts."""
    return F.transform(F.array(value), then)[0]


def hex_rgb(text: Column) -> Column:
    """struct(r, g, b) of RRGGBB with or without #."""
    h = F.regexp_replace(text, "^#", "")
    return F.struct(*(F.conv(F.substring(h, i, 2), 16, 10).cast("int").alias(c) for i, c in ((1, "r"), (3, "g"), (5, "b"))))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """RRGGBB of components, each rounded down and clamped to 0 to 255."""
    return F.upper(F.concat(*(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int"))).cast("long")), 2, "0") for c in (r, g, b))))


def rgb_hsl(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, l), each 0 to 1, of components 0 to 255."""
    parts = F.struct(*((c.cast("double") / 255).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))))

    def ends(c: Column) -> Column:
        return F.struct(*(c[n].alias(n) for n in "rgb"), F.greatest(c["r"], c["g"], c["b"]).alias("top"), F.least(c["r"], c["g"], c["b"]).alias("low"))

    def formed(c: Column) -> Column:
        d, light, grey = c["top"] - c["low"], (c["top"] + c["low"]) / 2, c["top"] == c["low"]
        hue = (
            F.when(grey, 0.0).when(c["top"] == c["r"], (c["g"] - c["b"]) / d + F.when(c["g"] < c["b"], 6.0).otherwise(0.0))
            .when(c["top"] == c["g"], (c["b"] - c["r"]) / d + 2).otherwise((c["r"] - c["g"]) / d + 4) / 6
        )
        s = F.when(grey, 0.0).when(light > 0.5, d / (2 - c["top"] - c["low"])).otherwise(d / (c["top"] + c["low"]))
        return F.struct(hue.alias("h"), s.alias("s"), light.alias("l"))

    return let(let(parts, ends), formed)


def hsl_rgb(hsl: Column) -> Column:
    """struct(r, g, b) 0 to 255, halves rounded up, of struct(h, s, l)."""

    def mixed(c: Column) -> Column:
        h, s, light = c["h"], c["s"], c["l"]
        q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
        turns = F.array(*(F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t) for t in (h + F.lit(THIRD), h, h - F.lit(THIRD))))
        return F.struct(q.alias("q"), (2 * light - q).alias("p"), turns.alias("t"))

    def part(c: Column, t: Column) -> Column:
        p, q = c["p"], c["q"]
        x = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)
        return F.floor(x * 255 + 0.5).cast("int")

    values = let(let(hsl, mixed), lambda c: F.transform(c["t"], lambda t: part(c, t)))
    return let(values, lambda v: F.struct(*(v[i].alias(n) for i, n in enumerate("rgb"))))


def tint(text: Column, amount: Column) -> Column:
    """A colour made darker by a negative and lighter by a positive amount; null and 0 leave it as it is."""
    t = amount.cast("double")

    def shifted(c: Column) -> Column:
        return F.struct(c["h"].alias("h"), c["s"].alias("s"), F.when(t < 0, c["l"] * (1 + t)).otherwise(1 - (1 - c["l"]) * (1 - t)).alias("l"))

    hsl = let(hex_rgb(text), lambda c: rgb_hsl(c["r"], c["g"], c["b"]))
    out = let(hsl_rgb(let(hsl, shifted)), lambda c: rgb_hex(c["r"], c["g"], c["b"]))
    return F.when(t.isNull() | (t == 0), text).otherwise(out)

"""Colour tables of the spreadsheet formats, and the colours that their attributes stand for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.colors import tint

# Colours of the default theme by name, and the order in which theme numbers count them.
THEME = {
    "dk1": "000000", "lt1": "FFFFFF", "dk2": "44546A", "lt2": "E7E6E6", "accent1": "4472C4", "accent2": "ED7D31", "accent3": "A5A5A5", "accent4": "FFC000",
    "accent5": "5B9BD5", "accent6": "70AD47", "hlink": "0563C1", "folHlink": "954F72", "tx1": "000000", "tx2": "44546A", "bg1": "FFFFFF", "bg2": "E7E6E6",
}
THEME_ORDER = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
# The default indexed colours 8 to 63; 0 to 7 repeat the first eight of them.
INDEXED = (
    "000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF 800000 008000 000080 808000 800080 008080 C0C0C0 808080 "
    "9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF 000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF "
    "00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99 3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696 "
    "003366 339966 003300 333300 993300 993366 333399 333333"
).split()


def theme_color(number: Column) -> Column:
    """RRGGBB of a theme number 0 to 11; null for others."""
    colors = F.array(*(F.lit(THEME[n]) for n in THEME_ORDER))
    return F.when(number.between(0, len(THEME_ORDER) - 1), F.get(colors, number.cast("int")))


def scheme_color(name: Column) -> Column:
    """RRGGBB of a theme colour by name; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for p in THEME.items() for x in p)), name)


def indexed_color(number: Column) -> Column:
    """RRGGBB of an indexed colour 0 to 63; null for others."""
    colors = F.array(*map(F.lit, [*INDEXED[:8], *INDEXED]))
    return F.when(number.between(0, len(INDEXED) + 7), F.get(colors, number.cast("int")))


def sheet_color(c: Column) -> Column:
    """`#RRGGBB` of struct(_rgb, _theme, _indexed, _tint): an opaque rgb, else a theme colour, else an indexed one, tinted."""
    rgb = F.when(F.upper(c["_rgb"]).startswith("FF") & (F.length(c["_rgb"]) == 8), F.upper(F.substring(c["_rgb"], 3, 6)))
    base = F.when(c["_rgb"].isNotNull(), rgb).when(c["_theme"].isNotNull(), theme_color(c["_theme"])).otherwise(indexed_color(c["_indexed"]))
    return F.concat(F.lit("#"), tint(base, c["_tint"]))

"""Column builders for sample metadata: names, null words, regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the regions, in lower case, and their names.
REGION_ALIASES = {
    "qinling": "Qinling Mountains",
    "qinling mountain": "Qinling Mountains",
    "qinling mountains": "Qinling Mountains",
    "southern loess": "Southern Loess Plateau",
    "southern loess plateau": "Southern Loess Plateau",
    "lvliang": "Lvliang Mountain",
    "lvliang mountain": "Lvliang Mountain",
    "lvliang mountains": "Lvliang Mountain",
    "taiyue": "Taiyue Mountains",
    "taiyue mountain": "Taiyue Mountains",
    "taiyue mountains": "Taiyue Mountains",
    "taihang": "Taihang Mountains",
    "taihang mountain": "Taihang Mountains",
    "taihang mountains": "Taihang Mountains",
    "zhongtiao": "Zhongtiao Mountain",
    "zhongtiaoshan": "Zhongtiao Mountain",
    "zhongtiao mountain": "Zhongtiao Mountain",
    "zhongtiao mountains": "Zhongtiao Mountain",
}


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def cleaned(x: Column) -> Column:
    """Stripped text; blanks and null words are NA."""
    t = stripped(F.replace(F.coalesce(x, F.lit("")), F.lit("\r"), F.lit("")))
    return F.when(F.lower(t).isin("", "na", "nan", "none"), "NA").otherwise(t)


def canonical_region(x: Column) -> Column:
    """One name for the spellings of a region; blank is NA and unknown names stay as they are."""
    t = stripped(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("_"), F.lit(" ")), r"\s+", " "))
    names = F.create_map(*[F.lit(v) for pair in REGION_ALIASES.items() for v in pair])
    return F.when(t == "", "NA").otherwise(F.coalesce(F.element_at(names, F.lower(t)), t))


def canonical_material(x: Column) -> Column:
    t = F.lower(F.regexp_replace(cleaned(x), r"[- ]", "_"))
    return F.when(t == "wild", "Wild").when(t.isin("ex_situ", "exsitu"), "Ex_situ").otherwise(cleaned(x))


def first_column(columns: Sequence[str], *aliases: str) -> str | None:
    """The column that one of the aliases names, whatever the case; earlier aliases first."""
    known = {c.lower(): c for c in reversed(columns)}
    return next((known[a.lower()] for a in aliases if a.lower() in known), None)


def number(x: Column) -> Column:
    """A number, or null for null words and for what is none."""
    t = stripped(x)
    return F.when(~F.lower(t).isin("", "na", "nan", "none", "."), t.try_cast("double"))


def threshold_label(value: float) -> str:
    return f"PIHAT_ge_{value:.2f}"


def joined_or(values: Column, empty: str = "None") -> Column:
    """Sorted values with semicolons between."""
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), ";")).otherwise(empty)

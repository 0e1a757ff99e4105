"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phases, the bases of sample bands, the least score of a badge.
#: Phases of twenty overs: name, first and last over, counted from 0.
PHASES = (("early", 0, 5), ("middle", 6, 14), ("late", 15, 19))
#: Balls that make a small sample, by role.
SAMPLE_BASE = {"bat": 200, "bowl": 120}
BADGE_FROM = 75.0
DASH = "—"


def first_present(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def norm_pct(value: Column, scale: str = "percent") -> Column:
    """Clamped to 0-100; a fraction is multiplied first.  The scale is told, never guessed from the value."""
    value = value * 100 if scale == "fraction" else value
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def truthy(value: Column) -> Column:
    """true, 1 or the texts "true" and "yes" in any case; the text "1" is not."""
    return F.coalesce(F.lower(value).isin("true", "yes"), F.lit(False))


def truthy_number(value: Column) -> Column:
    return F.coalesce(value == 1, F.lit(False))


def sample_band(balls: Column, base: Column | int, eligible: Column) -> Column:
    """How much a rating rests on: below the threshold, or small, medium (twice the base) or large (four times)."""
    return F.when(~eligible, "below").when(balls >= base * 4, "large").when(balls >= base * 2, "medium").otherwise("small")


def badges(*scored: tuple[str, Column], limit: float = BADGE_FROM) -> Column:
    """The labels whose score is at least the limit, in the order given."""
    return F.array_compact(F.array(*[F.when(score >= limit, F.lit(label)) for label, score in scored]))


def fmt(value: Column, decimals: int) -> Column:
    """Fixed decimals, digits grouped by threes, a dash for null or what is no number; halves go away from zero."""
    text = F.abs(value.cast(f"decimal(30,{decimals})")).cast("string")
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
    sign = F.when(value.cast(f"decimal(30,{decimals})") < 0, "-").otherwise("")
    return F.coalesce(F.concat(sign, whole, F.substring(text, F.length(F.substring_index(text, ".", 1)) + 1, F.lit(decimals + 1))), F.lit(DASH))


def short_label(text: Column, most: int = 24, kept: int = 22) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("…"))).otherwise(text)


def ym_label(date: Column) -> Column:
    return F.date_format(date, "yy.MM")


def split_ball(ball: Column) -> tuple[Column, Column]:
    """over and sequence of a text like 23.5; as a number 0.1 and 0.10 would be the same ball."""
    parts = F.split(ball, r"\.")
    return F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")


def season_year(season: Column) -> Column:
    return F.substring(season, 1, 4).try_cast("int")


def round_up_to(value: Column, step: int = 10) -> Column:
    return F.ceil(value / step) * step


def phase_of(over: Column) -> Column:
    """The phase of an over, null outside the phases."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, first, last in PHASES:
        found = found.when(over.between(first, last), name)
    return found

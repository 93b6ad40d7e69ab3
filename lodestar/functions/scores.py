"""Scores, bands and small rules (FUN-10, FUN-12, FUN-16, FUN-20 to FUN-24, FUN-26, FUN-27, FUN-29, FUN-33 to FUN-35)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.music import clamp


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as SQL engines do: the scaled value to the nearest whole number, halves away from zero. ``F.round``
    takes the shortest decimal instead, so a half that arithmetic made a hair smaller goes the other way."""
    return F.round(c * 10.0**digits) / 10.0**digits


def with_default(c: Column, default: float, zero_is_missing: bool = False) -> Column:
    """A confidence with its default; some callers take 0 for missing as well (section 1.5 of the survey)."""
    missing = c.isNull() | (c == 0) if zero_is_missing else c.isNull()
    return F.when(missing, F.lit(default)).otherwise(c)


def duration_score(seconds: Column, other: Column) -> Column:
    """1, 0.8, 0.45 or 0 by difference in seconds (2, 8, 20); 0.5 if either is missing or 0 (FUN-10)."""
    delta = F.abs(seconds - other)
    unknown = (F.coalesce(seconds, F.lit(0)) == 0) | (F.coalesce(other, F.lit(0)) == 0)
    return F.when(unknown, 0.5).when(delta <= 2, 1.0).when(delta <= 8, 0.8).when(delta <= 20, 0.45).otherwise(0.0)


def gaussian(value: Column, target: float, scale: float, unknown: float = 0.25) -> Column:
    """exp(-((value - target) / scale)^2); ``unknown`` for null (FUN-12)."""
    return F.coalesce(F.exp(-F.pow((value - target) / scale, 2)), F.lit(unknown))


def gaussian_tempo(value: Column, target: float, scale: float = 18.0, unknown: float = 0.25) -> Column:
    """``gaussian`` at the tempo, its half or its double, whichever lies nearest (FUN-12)."""
    delta = F.least(*(F.abs(v - target) for v in (value, value * 2, value / 2)))
    return F.when(value > 0, F.exp(-F.pow(delta / scale, 2))).otherwise(F.lit(unknown))


def weighted_jaccard(a: Column, b: Column, idf: Column | None = None) -> Column:
    """Sum of smaller over sum of larger weights of two maps, by key weights ``idf`` (FUN-16); 0 for empty maps."""
    weight = (lambda k: F.coalesce(F.try_element_at(idf, k), F.lit(1.0))) if idf is not None else (lambda k: F.lit(1.0))

    def total(pick) -> Column:
        merged = F.map_zip_with(a, b, lambda k, x, y: pick(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))) * weight(k))
        return F.aggregate(F.map_values(merged), F.lit(0.0), lambda s, x: s + x)

    return F.coalesce(F.try_divide(total(F.least), total(F.greatest)), F.lit(0.0))


def evidence(weight: Column, confidence: Column, default_weight: float = 0.60, default_confidence: float = 0.75) -> Column:
    """Source weight times confidence, both in 0..1 (FUN-20)."""
    return F.least(F.lit(1.0), F.coalesce(weight, F.lit(default_weight)) * clamp(F.coalesce(confidence, F.lit(default_confidence))))


def field_confidence(base: Column, reported: Column) -> Column:
    """Base confidence blended with a reported one, held within 0.01..1, four digits (FUN-21)."""
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.25), reported))
    blended = F.when(reported.isNull(), base).otherwise(0.55 * base + 0.45 * held)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.01), blended)), 4)


def band(value: Column, bounds: tuple[float, ...] = (0.33, 0.66), names: tuple[str, ...] = ("Low", "Medium", "High")) -> Column:
    """Band of a share, by fixed bounds; values above 1 are percentages; null is the empty band (FUN-22)."""
    share = F.when(value > 1, value / 100).otherwise(value)
    out = F.when(value.isNull(), "")
    for bound, name in zip(bounds, names):
        out = out.when(share < bound, name)
    return out.otherwise(names[-1])


def tempo_band(c: Column) -> Column:
    """(FUN-23)"""
    # The bands.
    return F.when(c < 100, "slow").when(c < 118, "midtempo").when(c < 130, "club tempo").when(c.isNotNull(), "fast")


def trust_rank(source: Column, ranks: dict[str, int], default: int = 9) -> Column:
    """Rank of the longest prefix that ``source`` starts with (FUN-24)."""
    out = F.lit(default)
    for prefix in sorted(ranks, key=len):  # longer prefixes decide last
        out = F.when(F.coalesce(source, F.lit("")).startswith(prefix), ranks[prefix]).otherwise(out)
    return out


def mood_rules(energy: Column, valence: Column, dance: Column, acoustic: Column, instrumental: Column) -> Column:
    """Moods (struct ``tag``, ``confidence``) that five measures imply; none without energy and valence (FUN-26)."""
    e, v, d, a, i = energy, valence, dance, acoustic, instrumental
    # Thresholds and confidences of the rules.
    rules = [
        ("energetic", e >= 0.68, 0.68),
        ("calm", e <= 0.34, 0.64),
        ("joyful", v >= 0.70, 0.62),
        ("uplifting", (v >= 0.62) & (e >= 0.50), 0.66),
        ("euphoric", (v >= 0.72) & (e >= 0.72) & (d >= 0.55), 0.64),
        ("tense", (v <= 0.34) & (e >= 0.62), 0.62),
        ("dark", v <= 0.28, 0.57),
        ("melancholic", (v <= 0.36) & (e <= 0.56), 0.62),
        ("somber", (v <= 0.25) & (e <= 0.44), 0.58),
        ("peaceful", (v >= 0.50) & (e <= 0.32), 0.61),
        ("aggressive", (e >= 0.84) & (v <= 0.34), 0.56),
        ("party", (d >= 0.73) & (e >= 0.65) & (v >= 0.50), 0.61),
        ("contemplative", (i >= 0.55) & (e <= 0.46), 0.55),
        ("dreamy", (i >= 0.55) & (e <= 0.52) & (a >= 0.28), 0.53),
        ("intimate", (a >= 0.58) & (e <= 0.50), 0.52),
    ]
    known = e.isNotNull() & v.isNotNull()
    found = F.array(*(F.when(known & rule, F.struct(F.lit(tag).alias("tag"), F.lit(c).alias("confidence"))) for tag, rule, c in rules))
    return F.filter(found, lambda x: x.isNotNull())


def keyword_kind(tag: Column, kinds: dict[str, list[str]], default: str) -> Column:
    """Kind of a tag by word lists (FUN-27)."""
    out = F.when(F.lit(False), "")
    for kind, words in kinds.items():
        out = out.when(F.lower(tag).isin(words), kind)
    return out.otherwise(default)


def number_in(text: Column) -> Column:
    """First number of a text such as ``-7.2 dB`` (FUN-29)."""
    return F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def share_in(text: Column) -> Column:
    """A number as a share: percentages are divided by 100, the result held within 0..1 (FUN-29)."""
    n = number_in(text)
    return clamp(F.when(n > 1, n / 100).otherwise(n))


def hint(text: Column, word: str) -> Column:
    """The number after ``word`` in a text, over 100, at most 1; null if there is none (FUN-34)."""
    n = F.regexp_extract(text, rf"(?i){word}\s*(\d{{1,3}})", 1).try_cast("double")
    return F.least(n / 100, F.when(n.isNotNull(), F.lit(1.0)))


def keyword_score(text: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the words that ``text`` contains (FUN-33)."""
    return reduce(lambda s, kw: s + F.when(text.contains(kw[0]), kw[1]).otherwise(0.0), weights.items(), F.lit(0.0))


def noisy_or(a: Column, b: Column) -> Column:
    """Chance that at least one of two independent sources is right (AGG-26); null counts as 0."""
    return 1 - (1 - F.coalesce(a, F.lit(0.0))) * (1 - F.coalesce(b, F.lit(0.0)))


def sigmoid(c: Column) -> Column:
    """(FUN-35)"""
    return 1 / (1 + F.exp(-c))


def strict_max(*cols: Column) -> Column:
    """Largest value, null if any is null (section 1.5): the builtin skips nulls."""
    none = reduce(lambda a, b: a | b, (c.isNull() for c in cols))
    return F.when(~none, F.greatest(*cols))


def strict_min(*cols: Column) -> Column:
    none = reduce(lambda a, b: a | b, (c.isNull() for c in cols))
    return F.when(~none, F.least(*cols))

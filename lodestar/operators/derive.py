"""labels that follow from evidence (DOM-04, DOM-11, DOM-12, DOM-13, DOM-17, DOM-18, DOM-25, JON-15 to JON-17, JON-22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scores


def consensus_pairs(tags: DataFrame, id_col: str, tag: str, source: str, first: str, second: str) -> DataFrame:
    """Tags that two sources agree on, their confidences joined by noisy-or (JON-15, AGG-26)."""
    a = tags.where(F.col(source) == first).groupBy(id_col, tag).agg(F.max("confidence").alias("a"))
    b = tags.where(F.col(source) == second).groupBy(id_col, tag).agg(F.max("confidence").alias("b"))
    return a.join(b, [id_col, tag]).select(id_col, tag, scores.noisy_or(F.col("a"), F.col("b")).alias("confidence"))


def consensus_sources(tags: DataFrame, id_col: str, tag: str, source: str, leading: Sequence[str], least: int = 2, floor: float = 0.70) -> DataFrame:
    """Tags of a leading source that others share: how many sources, and the best confidence, at least ``floor``
    (JON-16, AGG-27, DOM-13). One aggregate: a tag counts if it has a leading source and ``least`` sources in all.

    The confidence is null, and so the floor, where no source gives one.
    """
    leads = F.max(F.col(source).isin(*leading).cast("int"))
    out = tags.groupBy(id_col, tag).agg(leads.alias("leads"), F.countDistinct(source).alias("sources"), F.max("confidence").alias("best"))
    out = out.where((F.col("leads") == 1) & (F.col("sources") >= least))
    held = F.least(F.lit(1.0), F.greatest(F.lit(floor), F.coalesce("best", F.lit(0.0))))
    return out.select(id_col, tag, "sources", held.alias("confidence"))


def contained_labels(labels: DataFrame, longer: DataFrame, id_col: str, label: str, other: str, least: int = 5) -> DataFrame:
    """Labels (of ``least`` letters or more) that one of the entity's longer labels contains (JON-17)."""
    pairs = labels.where(F.length(label) >= least).join(longer.select(id_col, other), id_col)
    return pairs.where(F.contains(F.col(other), F.col(label))).select(*labels.columns).distinct()


# Fixed values of the import rules: for each family of labels the least mean and 90th percentile, the kind of a label that
# passes (and, where the catalogue has a say, of one that it does not know), and the confidence: base, share of the mean,
# what agreement adds, share of the coverage.
IMPORT_RULES = {
    "mood": (0.10, 0.18, "mood", "mood", 0.48, 1.5, 0.0, 0.12),
    "mood_weak": (0.04, 0.0, "mood_candidate", "mood_candidate", 0.35, 1.5, 0.0, 0.0),
    "genre": (0.12, 0.22, "genre", "genre_audio_candidate", 0.42, 0.7, 0.15, 0.0),
    "style": (0.32, 0.45, "subgenre", "audio_style_candidate", 0.40, 1.0, 0.0, 0.0),
    "instrument": (0.20, 0.40, "instrument", "instrument", 0.40, 0.65, 0.0, 0.15),
}
# Least probability of a binary mood, and the support it needs from the larger model.
HEAD_LEAST, HEAD_SUPPORT = 0.75, {"happy": 0.08, "sad": 0.08, "relaxed": 0.08, "aggressive": 0.06, "party": 0.04}


def agreeing(items: DataFrame, catalogue: DataFrame, id_col: str, tag: str, other: str, least: int = 5) -> DataFrame:
    """``id_col``, ``tag`` of the items that the entity's catalogue labels equal, or that a label of ``least`` letters or
    more contains (JON-17, DOM-12)."""
    known = catalogue.select(id_col, F.lower(other).alias("__known")).distinct()
    pairs = items.select(id_col, tag).distinct().join(known, id_col)
    same = F.col("__known") == F.lower(tag)
    within = (F.length("__known") >= least) & F.contains(F.col("__known"), F.lower(tag))
    return pairs.where(same | within).select(id_col, tag).distinct()


def import_rules(items: DataFrame, catalogue: DataFrame, id_col: str, other: str) -> DataFrame:
    """Labels that a model's results give, by family (DOM-12): ``id_col``, ``tag``, ``kind``, ``confidence``.

    ``items``: ``family``, ``tag``, ``mean``, ``p90``, ``coverage``. A mood that is too weak for one is a candidate.
    """
    agreed = agreeing(items, catalogue, id_col, "tag", other).withColumn("__agreed", F.lit(True))
    known = items.join(agreed, [id_col, "tag"], "left").withColumn("__agreed", F.coalesce("__agreed", F.lit(False)))
    out = F.lit(None)
    for name, (mean, p90, kind, unknown, base, slope, bonus, covered) in reversed(IMPORT_RULES.items()):
        confidence = base + slope * F.col("mean") + F.when(F.col("__agreed"), bonus).otherwise(0.0) + covered * F.col("coverage")
        passes = (F.col("family") == name.split("_")[0]) & (F.col("mean") >= mean) & (F.col("p90") >= p90)
        out = F.when(passes, F.struct(F.when(F.col("__agreed"), kind).otherwise(unknown).alias("kind"), scores.clamp(confidence).alias("confidence"))).otherwise(out)
    return known.withColumn("__made", out).where("__made is not null").select(id_col, "tag", "__made.kind", "__made.confidence")


def supported_heads(heads: DataFrame, items: DataFrame, id_col: str) -> DataFrame:
    """Binary moods that are probable and that the larger model supports (DOM-12). ``heads``: ``tag``, ``probability``."""
    floors = F.create_map(*(F.lit(x) for pair in HEAD_SUPPORT.items() for x in pair))
    support = items.where("family = 'mood'").select(id_col, "tag", F.col("mean").alias("__mean"))
    joined = heads.where(F.col("probability") >= HEAD_LEAST).join(support, [id_col, "tag"])
    return joined.where(F.col("__mean") >= F.try_element_at(floors, F.col("tag"))).select(id_col, "tag", F.lit("mood").alias("kind"), F.col("probability").alias("confidence"))


def rhythm_pattern(steady: Column, broken: Column, near: float = 0.16, mixed: float = 0.62) -> tuple[Column, Column]:
    """Pattern and confidence from the best evidence for either; near ties are mixed (DOM-11)."""
    tie = (steady > 0) & (broken > 0) & (F.abs(steady - broken) < near)
    pattern = F.when(tie, "mixed_or_variable").when(steady > broken, "steady_four_on_floor").when(broken > 0, "broken_beat").otherwise("unknown")
    confidence = F.when(tie, F.greatest(steady, broken) * mixed).when(steady > broken, steady).when(broken > 0, broken).otherwise(0.0)
    return pattern, confidence


def beat_presence(pattern: Column, pattern_confidence: Column, beatless: Column, dance: Column, energy: Column) -> tuple[Column, Column]:
    """Whether there is a beat, from the pattern, evidence against it, or two measures (DOM-11)."""
    lively = (dance >= 0.48) | (energy >= 0.62)
    still = (dance <= 0.20) & (energy <= 0.30)
    known = dance.isNotNull() & energy.isNotNull()
    presence = (
        F.when(pattern != "unknown", "beat").when(beatless > 0, "beatless").when(known & lively, "beat").when(known & still, "beatless").otherwise("unknown")
    )
    confidence = (
        F.when(pattern != "unknown", F.greatest(pattern_confidence, F.lit(0.55)))
        .when(beatless > 0, beatless * 0.82)
        .when(known & lively, 0.46)
        .when(known & still, 0.44)
        .otherwise(0.0)
    )
    return presence, confidence


def interpreted(tags: DataFrame, id_col: str, tag: str, kind: str, source: str, columns: dict[str, Sequence[str]], ranks: dict[str, int]) -> DataFrame:
    """For each column the best tag of the kinds that feed it: trusted source first, then confidence (DOM-04).

    All kinds of a column are pooled before the choice; tags with letters beyond ASCII are left out.
    """
    from lodestar.functions.text import english_letters

    order = F.struct(scores.trust_rank(F.col(source), ranks), -F.coalesce("confidence", F.lit(0.0)), F.col(tag))
    usable = tags.where(english_letters(F.col(tag)))
    best = lambda kinds: F.min_by(F.when(F.col(kind).isin(*kinds), F.trim(tag)), F.when(F.col(kind).isin(*kinds), order))
    return usable.groupBy(id_col).agg(*(F.coalesce(best(kinds), F.lit("")).alias(name) for name, kinds in columns.items()))


def name_hints(items: DataFrame, id_col: str, name: Column, tags: dict[str, Sequence[str]], hints: Sequence[str]) -> DataFrame:
    """Tags and mean numeric hints that the names of an entity's lists give (DOM-18, JON-22, AGG-28, FUN-34)."""
    lower = F.lower(name)
    found = F.array_compact(F.array(*(F.when(_any_word(lower, words), tag) for tag, words in tags.items())))
    values = items.select(id_col, found.alias("found"), *(scores.hint(name, h).alias(h) for h in hints))
    return values.groupBy(id_col).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("found")))).alias("tags"), *(F.round(F.avg(h), 6).alias(h) for h in hints)
    )


def _any_word(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def keep_set(df: DataFrame, rule: Column, overrides: DataFrame | None, id_col: str) -> DataFrame:
    """``keep`` by a rule, unless an override decides (DOM-17); overrides: ``id_col``, ``keep_override``."""
    out = df.withColumn("keep", F.coalesce(rule, F.lit(False)))
    if overrides is not None:
        out = out.join(overrides, id_col, "left").withColumn("keep", F.coalesce("keep_override", "keep")).drop("keep_override")
    return out


def fill_up(chosen: DataFrame, rest: DataFrame, id_col: str, order: Sequence[Column], size: int) -> DataFrame:
    """The chosen rows, then the best others, up to ``size`` in all (DOM-25)."""
    pool = chosen.withColumn("__first", F.lit(0)).unionByName(rest.join(chosen.select(id_col), id_col, "left_anti").withColumn("__first", F.lit(1)))
    return pool.orderBy("__first", *order).limit(size).drop("__first")

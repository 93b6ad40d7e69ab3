"""One ranking of entities by their distance from a seed over all signals (DOM-05, FUN-11, FUN-14, FUN-16, FLT-11).

Every signal is reduced to one row an entity before the seed's row is set beside it: best value of each field by source,
sums of tag weights, attributes, cosines. Broadcast are the seed's one row and its sums of the tag types, five at most; whether the
seed's tags or the policies are, Spark decides by their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import music, text, vectors
from lodestar.operators.fusion import descending, preferred
from lodestar.operators.similarity import weighted_distance
from lodestar.operators.stats import idf

# Weights of fields, tag types, attributes and vector families.
FIELDS = {"energy": 1.30, "danceability": 1.05, "valence": 0.80, "acousticness": 0.50, "instrumentalness": 0.75, "speechiness": 0.35, "liveness": 0.20, "loudness": 0.45}
TEMPO, KEY = 1.65, 0.55
TAG_TYPES = {"subgenre": 2.80, "genre": 1.80, "mood": 1.20, "instrument": 0.80, "voice": 0.50}
ATTRIBUTES = {"beat_presence": 0.90, "rhythm_pattern": 1.35}
FAMILIES = {"clap": 2.60, "maest": 1.55}
# Quality of a source that no policy knows, confidence of a tag without one, and what a missing genre costs.
DEFAULT_QUALITY, DEFAULT_CONFIDENCE, MISSING_SHARE, MISSING_DISTANCE = 0.40, 0.35, 0.70, 0.75


def best_fields(features: DataFrame, policies: DataFrame, id_col: str) -> DataFrame:
    """One row an entity: ``fields``, a map of its best value of each field (number, text, quality) by the policies' weight.

    ``features``: id, source, field, ``number``, ``text``; ``policies``: source, field, ``similarity_weight``. Of equally good
    sources the first by name."""
    rated = features.join(policies.select("source", "field", "similarity_weight"), ["source", "field"], "left")
    rated = rated.withColumn("quality", F.coalesce("similarity_weight", F.lit(DEFAULT_QUALITY)))
    best = preferred(rated.where("number is not null or text is not null"), [id_col, "field"], [descending("quality"), F.col("source")], ("number", "text", "quality"))
    return best.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("number", "text", "quality")))).alias("fields"))  # as many as fields


def tag_terms(tags: DataFrame, entities: Column | int, id_col: str, seed) -> DataFrame:
    """One row an entity: ``terms``, a map from tag type to how far its tags are from the seed's (1 less the Jaccard of weights
    times their IDF). ``tags``: id, tag_type, tag, confidence. Types that the seed lacks are absent.

    The sum of larger weights is both sums less the sum of smaller ones, so only the seed's tags are joined."""
    known = tags.where(F.col("tag_type").isin(*TAG_TYPES))
    weights = known.groupBy(id_col, "tag_type", "tag").agg(F.max(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))).alias("w"))
    inverse = idf(weights.select(id_col, F.struct("tag_type", "tag").alias("term")), "term", id_col, entities)
    weighed = weights.join(inverse.select("term.*", "idf"), ["tag_type", "tag"])
    mine = weighed.where(F.col(id_col) == seed).select("tag_type", "tag", F.col("w").alias("mine"))
    sums = weighed.join(mine, ["tag_type", "tag"], "left").groupBy(id_col, "tag_type").agg(
        F.sum(F.col("w") * F.col("idf")).alias("own"), F.sum(F.when(F.col("mine").isNull(), 0.0).otherwise(F.least("w", "mine") * F.col("idf"))).alias("shared")
    )
    total = sums.where(F.col(id_col) == seed).select("tag_type", F.col("own").alias("total"))
    apart = 1 - F.coalesce(F.try_divide(F.col("shared"), F.col("own") + F.col("total") - F.col("shared")), F.lit(0.0))
    each = sums.join(F.broadcast(total), "tag_type").select(id_col, "tag_type", apart.alias("apart"))
    return each.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("tag_type", "apart"))).alias("terms"))


def keyed_map(df: DataFrame, id_col: str, key: str, known: dict[str, float], value: Column, name: str) -> DataFrame:
    rows = df.where(F.col(key).isin(*known)).select(id_col, F.col(key).alias("__k"), value.alias("__v"))
    return rows.groupBy(id_col, "__k").agg(F.max("__v").alias("__v")).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("__k", "__v"))).alias(name))


def same_recording(title: Column, artists: Column, code: Column, seed_title: Column, seed_artists: Column, seed_code: Column) -> Column:
    """Whether two entities are one recording (FLT-11): equal codes, or equal titles and an artist in common."""
    names = lambda c: F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    coded = F.coalesce((code == seed_code) & (code != ""), F.lit(False))
    return coded | ((plain(title) == plain(seed_title)) & F.arrays_overlap(names(artists), names(seed_artists)))


def similar_entities(
    entities: DataFrame, features: DataFrame, policies: DataFrame, tags: DataFrame, attributes: DataFrame, embeddings: DataFrame, seed, id_col: str = "id",
    same_artist: bool = True,
) -> DataFrame:
    """``id_col``, ``common``, ``similarity`` (percent) of all entities that share three signals or more with the seed (DOM-05).

    ``entities``: id, title, artist_names, isrc. ``attributes``: id, attribute, value, confidence. ``embeddings``: id, family, ``vector``
    (arrays of doubles). Numbers count by their difference, tempi half- and double-aware, keys by their harmonic distance, tags
    by weighted Jaccard with IDF, attributes by equality (``unknown`` says nothing), vectors by half of 1 less the cosine; each term
    by its weight and, where sources differ, the root of both qualities. An entity without genres is penalised if the seed has some.
    The seed, its own recordings and, without ``same_artist``, its artists' other entities are left out."""
    parts = [
        best_fields(features, policies, id_col),
        tag_terms(tags, entities.count(), id_col, seed),
        keyed_map(attributes.where("value <> 'unknown'"), id_col, "attribute", ATTRIBUTES, F.struct("value", F.coalesce("confidence", F.lit(0.0)).alias("confidence")), "attributes"),
        keyed_map(embeddings, id_col, "family", FAMILIES, vectors.unit(F.col("vector")), "vectors"),
    ]
    whole = reduce(lambda a, b: a.join(b, id_col, "left"), parts, entities.select(id_col, "title", "artist_names", "isrc"))
    own = whole.where(F.col(id_col) == seed).select(*(F.col(c).alias(f"seed_{c}") for c in whole.columns)).limit(1)
    both = whole.where(F.col(id_col) != seed).crossJoin(F.broadcast(own))  # one row
    both = both.where(~same_recording(F.col("title"), F.col("artist_names"), F.col("isrc"), F.col("seed_title"), F.col("seed_artist_names"), F.col("seed_isrc")))
    if not same_artist:
        names = lambda c: F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), ","), lambda x: F.trim(x))
        both = both.where(~F.arrays_overlap(names("artist_names"), names("seed_artist_names")))

    at = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    terms: list[tuple[Column, Column]] = []
    apart = {f: lambda a, b: F.abs(a["number"] - b["number"]) for f in FIELDS}
    apart |= {"bpm": lambda a, b: music.tempo_distance(a["number"], b["number"]), "key": lambda a, b: F.when(a["text"].isNotNull() & b["text"].isNotNull(), music.harmonic_distance(a["text"], b["text"]))}
    for field, weight in (FIELDS | {"bpm": TEMPO, "key": KEY}).items():
        a, b = at("seed_fields", field), at("fields", field)
        terms.append((weight * F.sqrt(a["quality"] * b["quality"]), F.when(a.isNotNull() & b.isNotNull(), apart[field](a, b))))
    terms += [(F.lit(weight), at("terms", kind)) for kind, weight in TAG_TYPES.items()]
    for name, weight in ATTRIBUTES.items():
        a, b = at("seed_attributes", name), at("attributes", name)
        # The distance is 0 or 1, so it is its own square.
        terms.append((weight * F.sqrt(a["confidence"] * b["confidence"]), F.when(a.isNotNull() & b.isNotNull(), (a["value"] != b["value"]).cast("double"))))
    for family, weight in FAMILIES.items():
        a, b = at("seed_vectors", family), at("vectors", family)
        terms.append((F.lit(weight), F.when(a.isNotNull() & b.isNotNull(), (1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), vectors.dot(a, b)))) / 2)))
    missing = F.when(at("seed_terms", "genre").isNotNull() & at("terms", "genre").isNull(), F.lit(MISSING_DISTANCE))
    _, common, percent = weighted_distance(terms, [(F.lit(TAG_TYPES["genre"] * MISSING_SHARE), missing)])
    scored = both.select(F.col(id_col), common.alias("common"), percent.alias("similarity"))
    return scored.where((F.col("common") >= 3) & F.col("similarity").isNotNull())


def identity_score(title: Column, artist: Column, code: Column, other_code: Column) -> Column:
    """Struct of ``confidence`` and ``method`` for two records of a recording (DOM-20): equal codes are sure; different ones are
    a variant where the names agree, else a conflict; without both codes the names decide.

    ``title`` and ``artist`` are how alike the names are."""
    # The confidence of each method, and how alike the names of a variant must be.
    clean = lambda c: F.nullif(F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")), F.lit(""))
    a, b = clean(code), clean(other_code)
    verdict = lambda c, m: F.struct(c.alias("confidence"), F.lit(m).alias("method"))
    coded = a.isNotNull() & b.isNotNull()
    return (
        F.when(coded & (a == b), verdict(F.lit(1.0), "code_exact"))
        .when(coded & (title >= 0.94) & (artist >= 0.70), verdict(F.lit(0.78), "name_exact_code_variant"))
        .when(coded, verdict(F.lit(0.0), "code_conflict"))
        .otherwise(verdict(0.72 * title + 0.28 * artist, "name_artist"))
    )


def code_conflict(code: Column, other_code: Column) -> Column:
    """Whether both records have a recording code and they differ (DOM-19)."""
    a, b = text.clean_code(code), text.clean_code(other_code)
    return F.coalesce(a != b, F.lit(False))

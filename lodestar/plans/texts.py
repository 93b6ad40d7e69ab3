"""Queries on text, arrays, JSON and scalar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import music, scores, text
from lodestar.operators import search
from lodestar.plans.registry import query
from lodestar.plans.similarity import FOLD_SQL
from lodestar.session import table


@query(rf"""
SELECT doc_id, md5({FOLD_SQL.format('text')}) AS folded, md5(replace({FOLD_SQL.format('text')}, ' ', '')) AS compact, length(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))::INT AS spaced,
       trim(regexp_replace({FOLD_SQL.format("split_part(text, chr(10), 1)")}, '( (remaster|remastered|radio|edit|extended|original|version|mix|mixed|mono|stereo|deluxe|19\d\d|20\d\d))+$', '')) AS title FROM documents""")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of whole texts, and of their first lines as titles (FUN-01 to FUN-03)."""
    # Folded once, in a projection of its own: other forms derive from it.
    lowered = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower("text").alias("lower"))
    folded = lowered.select("doc_id", "text", "lower", text.normalize("lower").alias("folded"))
    return folded.select(
        "doc_id",
        F.md5("folded").alias("folded"),
        F.md5(F.translate("folded", " ", "")).alias("compact"),
        F.length(text.normalize("lower", "spaces")).alias("spaced"),
        text.canonical_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
    )


@query(r"""
SELECT page_id, nullif(regexp_extract(url, '(?:^|[/:])([A-Za-z0-9]{22})(?:$|[?#])', 1), '') AS entity, CASE WHEN length(regexp_replace(url, '[^A-Za-z0-9]', '', 'g')) BETWEEN 10 AND 15 THEN upper(regexp_replace(url, '[^A-Za-z0-9]', '', 'g')) END AS code,
       replace('/:' || replace(url, '/', '/:'), '/:', '/') AS path FROM pages""")
def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and codes in addresses, and a path decoded (FUN-06, FUN-07, FUN-32)."""
    coded = F.concat(F.lit("/:"), F.replace("url", F.lit("/"), F.lit("/:")))
    return table(spark, sf_dir, "pages").select("page_id", text.entity_id("url").alias("entity"), text.clean_code("url").alias("code"), text.decode_path(coded).alias("path"))


@query("""
SELECT doc_id, source FROM documents WHERE text ILIKE '%the%' AND (text ILIKE '%ther%' OR source ILIKE '%ther%') AND source IS NOT NULL AND source <> '' AND NOT starts_with(source, 'src1')
ORDER BY n_chars, doc_id LIMIT 200""")
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both words, shortest first (FLT-02 to FLT-04, FLT-13)."""
    docs = table(spark, sf_dir, "documents")
    found = docs.where(search.every_word(["text", "source"], "the ther") & F.col("source").isNotNull() & (F.col("source") != "") & ~F.col("source").startswith("src1"))
    return found.orderBy("n_chars", "doc_id").limit(200).select("doc_id", "source")


@query("""
SELECT d.doc_id, quality IS DISTINCT FROM toxic AS differs, coalesce(quality, toxic, 2)::INT AS bound, quality IS NULL OR quality = 1 AS passes_unknown, coalesce(toxic = 0, false) AS rejects_unknown,
       CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE greatest(quality, toxic) END::INT AS strict FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE coalesce(n_chars / 1000.0, 0) <= 900""")
def null_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What missing labels do under each rule (FLT-07, FLT-10, FLT-11, FLT-14)."""
    q, t = F.col("quality"), F.col("toxic")
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").where(F.coalesce(F.col("n_chars") / 1000, F.lit(0)) <= 900)
    return joined.select(
        "doc_id", (~q.eqNullSafe(t)).alias("differs"), F.coalesce(q, t, F.lit(2)).cast("int").alias("bound"), (q.isNull() | (q == 1)).alias("passes_unknown"),
        F.coalesce(t == 0, F.lit(False)).alias("rejects_unknown"), scores.strict_max(q, t).cast("int").alias("strict"),
    )


@query(r"""
WITH w AS (SELECT DISTINCT doc_id, lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
SELECT lang, term, count(*) AS n FROM w WHERE length(term) >= 4 AND NOT regexp_matches(term, '[^\x00-\x7F]') AND NOT regexp_matches(term, '^(the|and|der|die)') GROUP BY ALL HAVING count(*) >= 20""")
def ascii_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent plain-letter words of each language, without excluded beginnings (FLT-15, FLT-17 to FLT-19)."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    terms = table(spark, sf_dir, "documents").select("lang", F.explode_outer(words).alias("term"))
    plain = terms.where((F.length("term") >= 4) & text.english_letters("term") & ~F.col("term").rlike("^(the|and|der|die)"))
    return plain.groupBy("lang", "term").agg(F.count("*").alias("n")).where("n >= 20")


@query("""
SELECT event_id, key AS attribute, value_num, CASE WHEN value_num IS NULL THEN 'text' ELSE 'num' END AS slot FROM (
  SELECT event_id, unnest(json_keys(props)) AS key, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value_num FROM events)""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload keys as attribute rows with their type's slot (PRJ-04, PRJ-05)."""
    from lodestar.sources.payloads import attribute_rows

    rows = attribute_rows(table(spark, sf_dir, "events"), "event_id", "props")
    return rows.select("event_id", "attribute", "value_num", F.when(F.col("value_num").isNull(), "text").otherwise("num").alias("slot"))


@query("""
WITH s AS (SELECT p_partkey, list_distinct(list_filter(list_transform(string_split_regex(lower(p_type || ',' || p_name), '[,/;| ]'), lambda x: trim(x)), lambda x: x <> '')) AS terms FROM part)
SELECT p_partkey, array_to_string(list_sort(terms), ',') AS terms, len(list_intersect(terms, ['green', 'brass', 'steel']))::INT AS shared, list_contains(terms, 'brass') AS has_brass FROM s""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text to sets, and sets against each other (SET-02, SET-03, SET-07, SET-08, FUN-38, FUN-41)."""
    terms = text.split_terms(F.concat_ws(",", "p_type", "p_name"), "[,/;| ]")
    wanted = F.array(*map(F.lit, ("green", "brass", "steel")))
    parts = table(spark, sf_dir, "part").select("p_partkey", terms.alias("terms"))
    return parts.select("p_partkey", F.array_join(F.array_sort("terms"), ",").alias("terms"), F.size(F.array_intersect("terms", wanted)).alias("shared"), F.array_contains("terms", "brass").alias("has_brass"))


NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
WHEEL_SQL = "CASE WHEN k % 2 = 0 THEN ((7 + 7 * p) % 12 + 1)::INT || 'B' ELSE ((7 + 7 * ((p + 3) % 12)) % 12 + 1)::INT || 'A' END"


@query(f"""
WITH b AS (SELECT p_partkey, p_size % 12 AS p, p_partkey % 2 AS k, p_retailprice FROM part), c AS (SELECT *, ((7 + 7 * CASE WHEN k = 0 THEN p ELSE (p + 3) % 12 END) % 12 + 1)::INT AS n FROM b)
SELECT p_partkey, n || CASE WHEN k = 0 THEN 'B' ELSE 'A' END AS wheel,
  CASE WHEN n = 8 AND k = 1 THEN 1.0 WHEN k = 1 AND least(abs(n - 8), 12 - abs(n - 8)) = 1 THEN 0.6 WHEN n = 8 AND k = 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS score,
  CASE WHEN n = 8 AND k = 1 THEN 0.0 WHEN n = 8 THEN 0.18 WHEN k = 1 AND (n - 8 + 12) % 12 IN (1, 11) THEN 0.25 ELSE 1.0 END::DOUBLE AS distance,
  round(least(1, 0.6 * least(1, p_retailprice / 2000)), 6) AS evidence, round(least(1, greatest(0.01, 0.55 * 0.7 + 0.45 * least(1, greatest(0.25, p_retailprice / 2000)))), 4) AS confidence,
  -round(p_retailprice, 1) AS loudness FROM c""")
def scalar_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made of a part's size, on the wheel and against A minor; evidence and number parsing (FUN-13 to FUN-15,
    FUN-20, FUN-21, FUN-27 to FUN-29)."""
    key = music.key_name(F.col("p_size") % 12, 1 - F.col("p_partkey") % 2)
    price = F.col("p_retailprice") / 2000
    loud = F.concat(F.lit("-"), F.format_string("%.1f", F.round("p_retailprice", 1)), F.lit(" dB"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", music.camelot(key).alias("wheel"), music.key_score(key, F.lit("A Minor")).alias("score"), music.harmonic_distance(key, F.lit("A-Minor")).alias("distance"),
        F.round(scores.evidence(F.lit(None).cast("double"), price), 6).alias("evidence"), scores.field_confidence(F.lit(0.7), price).alias("confidence"), scores.number_in(loud).alias("loudness"),
    )


@query("""
WITH s AS (SELECT event_id, user_id, exp(value / 100) / sum(exp(value / 100)) OVER (PARTITION BY user_id) AS soft, value FROM events)
SELECT event_id, round(soft, 8) AS soft, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS sig, round(least(1, greatest(0, (value - 20) / 60)), 6) AS held,
       round(least(1, greatest(0, least(1, greatest(0, 0.48 * value / 100 + 0.17 * 0.5 + 0.15 * value / 200 + 0.12 * 0.3 + 0.08 * 0.4)) * (0.25 + 0.75 * least(1, greatest(0, (value / 200 - 0.08) / 0.26))))), 9) AS pulse FROM s""")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax within users, sigmoid, clamp and a gated blend (FUN-35, FUN-40)."""
    v = F.col("value")
    events = table(spark, sf_dir, "events")
    totals = events.groupBy("user_id").agg(F.sum(F.exp(v / 100)).alias("total"))
    half = F.lit(0.5)
    return events.join(totals, "user_id").select(
        "event_id", F.round(F.exp(v / 100) / F.col("total"), 8).alias("soft"), F.round(scores.sigmoid((v - 50) / 10), 6).alias("sig"), F.round(music.clamp((v - 20) / 60), 6).alias("held"),
        F.round(music.pulse_presence(v / 100, half, v / 200, F.lit(0.3), F.lit(0.4)), 9).alias("pulse"),
    )


@query("""
WITH s AS (SELECT p_partkey, p_brand, p_retailprice, p_partkey = 7 AS seed, p_retailprice / 1000 AS score, p_size FROM part),
o AS (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM s)
SELECT p_partkey, p_brand, round(score, 4) AS score, row_number() OVER (ORDER BY NOT seed, top DESC, p_brand, score DESC, p_size DESC, p_partkey) AS place FROM o
ORDER BY NOT seed, top DESC, p_brand, o.score DESC, p_size DESC, p_partkey LIMIT 200""")
def ordered_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed first, then brands by their dearest part, then score and size (SRT-04, SRT-06, SRT-08)."""
    parts = table(spark, sf_dir, "part")
    tops = parts.groupBy("p_brand").agg(F.max("p_retailprice").alias("top"))
    order = [F.col("p_partkey") != 7, F.desc("top"), F.col("p_brand"), F.desc("p_retailprice"), F.desc("p_size"), F.col("p_partkey")]
    best = parts.join(tops, "p_brand").orderBy(*order).limit(200)
    return best.select("p_partkey", "p_brand", F.round(F.col("p_retailprice") / 1000, 4).alias("score"), F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("""
WITH r AS (SELECT p_brand, lower(split_part(p_type, ' ', 1)) AS tag, max(p_retailprice) AS best FROM part GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY best DESC, tag) AS k FROM r)
SELECT p_brand, string_agg(tag, ', ' ORDER BY k) AS tags FROM n WHERE k <= 3 GROUP BY p_brand""")
def best_first_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three tags of a brand, best first, unique in lower case (SRT-12)."""
    best = table(spark, sf_dir, "part").groupBy("p_brand", F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("tag")).agg(F.max("p_retailprice").alias("best"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("o"), "tag")))  # as many as a brand has tags
    return best.groupBy("p_brand").agg(F.array_join(F.transform(F.slice(ordered, 1, 3), lambda x: x["tag"]), ", ").alias("tags"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 100")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred documents in an order that a seed decides (SRT-09)."""
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id").limit(100).select("doc_id")

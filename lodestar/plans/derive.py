"""Derivation queries: event types as tags, months and cohorts as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scores
from lodestar.operators import derive
from lodestar.plans.registry import query
from lodestar.session import table

TAGS_SQL = "t AS (SELECT user_id, event_type AS tag, CASE WHEN day(ts) <= 10 THEN 'early' WHEN day(ts) <= 20 THEN 'middle' ELSE 'late' END AS source, value / 100 AS confidence FROM events)"


def tags_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("ts")
    source = F.when(day <= 10, "early").when(day <= 20, "middle").otherwise("late")
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"), source.alias("source"), (F.col("value") / 100).alias("confidence"))


@query(f"""
WITH {TAGS_SQL},
a AS (SELECT user_id, tag, max(confidence) AS c FROM t WHERE source = 'early' GROUP BY ALL), b AS (SELECT user_id, tag, max(confidence) AS c FROM t WHERE source = 'late' GROUP BY ALL),
s AS (SELECT user_id, tag, count(DISTINCT source) AS sources, least(1, greatest(0.7, coalesce(max(confidence), 0))) AS c FROM t GROUP BY ALL HAVING count(DISTINCT source) >= 2 AND bool_or(source IN ('early', 'middle')))
SELECT user_id, tag, 'pair' AS rule, 2::BIGINT AS sources, round(1 - (1 - a.c) * (1 - b.c), 6)::DOUBLE AS confidence FROM a JOIN b USING (user_id, tag)
UNION ALL SELECT user_id, tag, 'sources', sources, round(c, 6) FROM s""")
def consensus_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that several thirds of the month agree on (JON-15, JON-16, AGG-26, AGG-27, DOM-13)."""
    tags = tags_of(spark, sf_dir)
    pairs = derive.consensus_pairs(tags, "user_id", "tag", "source", "early", "late").select("user_id", "tag", F.lit("pair").alias("rule"), F.lit(2).cast("long").alias("sources"), "confidence")
    many = derive.consensus_sources(tags, "user_id", "tag", "source", ["early", "middle"])
    return pairs.union(many.select("user_id", "tag", F.lit("sources"), "sources", "confidence")).withColumn("confidence", F.round("confidence", 6))


@query("""
WITH f AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') / 100 AS e, avg(value) FILTER (WHERE event_type = 'view') / 100 AS v, avg(value) FILTER (WHERE event_type = 'purchase') / 100 AS d FROM events GROUP BY 1),
r AS (SELECT user_id, e, v, d, unnest([CASE WHEN e >= 0.68 THEN 'energetic' END, CASE WHEN e <= 0.34 THEN 'calm' END, CASE WHEN v >= 0.70 THEN 'joyful' END, CASE WHEN v >= 0.62 AND e >= 0.50 THEN 'uplifting' END,
  CASE WHEN v >= 0.72 AND e >= 0.72 AND d >= 0.55 THEN 'euphoric' END, CASE WHEN v <= 0.34 AND e >= 0.62 THEN 'tense' END, CASE WHEN v <= 0.28 THEN 'dark' END, CASE WHEN v <= 0.36 AND e <= 0.56 THEN 'melancholic' END,
  CASE WHEN v <= 0.25 AND e <= 0.44 THEN 'somber' END, CASE WHEN v >= 0.50 AND e <= 0.32 THEN 'peaceful' END, CASE WHEN e >= 0.84 AND v <= 0.34 THEN 'aggressive' END, CASE WHEN d >= 0.73 AND e >= 0.65 AND v >= 0.50 THEN 'party' END]) AS tag FROM f WHERE e IS NOT NULL AND v IS NOT NULL)
SELECT user_id, tag FROM r WHERE tag IS NOT NULL""")
def derive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mood rules on a user's mean values as stand-ins for measures (FUN-26, DOM-11)."""
    mean = lambda kind: (F.avg(F.when(F.col("event_type") == kind, F.col("value"))) / 100).alias(kind)
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(mean("click"), mean("view"), mean("purchase"))
    none = F.lit(None).cast("double")
    moods = scores.mood_rules(F.col("click"), F.col("view"), F.col("purchase"), none, none)
    return means.select("user_id", F.inline(moods)).select("user_id", "tag")


@query("""
WITH t AS (SELECT doc_id, source, n_chars, n_chars / 5000 AS share, CASE WHEN starts_with(source, 'src1') AND length(source) > 4 THEN 1 WHEN starts_with(source, 'src1') THEN 1 WHEN starts_with(source, 'src') THEN 3 ELSE 9 END AS r0 FROM documents),
u AS (SELECT *, CASE WHEN starts_with(source, 'src12') THEN 0 ELSE r0 END AS rank FROM t)
SELECT doc_id, rank::INT AS rank, CASE WHEN (CASE WHEN share > 1 THEN share / 100 ELSE share END) < 0.33 THEN 'Low' WHEN (CASE WHEN share > 1 THEN share / 100 ELSE share END) < 0.66 THEN 'Medium' ELSE 'High' END AS band,
  CASE WHEN n_chars < 100 THEN 'slow' WHEN n_chars < 118 THEN 'midtempo' WHEN n_chars < 130 THEN 'club tempo' ELSE 'fast' END AS tempo FROM u""")
def band_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a length and trust by the longest prefix of a source (FUN-22 to FUN-25, DOM-04)."""
    ranks = {"src": 3, "src1": 1, "src12": 0}
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        scores.trust_rank(F.col("source"), ranks).alias("rank"),
        scores.band(F.col("n_chars") / 5000).alias("band"),
        scores.tempo_band(F.col("n_chars")).alias("tempo"),
    )


@query("""
WITH s AS (SELECT doc_id, CASE WHEN contains(lower(text), 'licensed') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(text), '@') THEN -1.5 ELSE 0 END + CASE WHEN contains(lower(text), 'public') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(text), '&&&') THEN -2.0 ELSE 0 END AS score FROM documents)
SELECT doc_id, score::DOUBLE AS score, rank FROM (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 1 ORDER BY score DESC, doc_id LIMIT 50)""")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of words in a text, the best 50 above a threshold (FUN-33, FLT-16, SRT-07)."""
    from pyspark.sql import Window

    weights = {"licensed": 3.0, "@": -1.5, "public": 1.0, "&&&": -2.0}
    scored = table(spark, sf_dir, "documents").select("doc_id", scores.keyword_score(F.lower("text"), weights).alias("score")).where("score >= 1")
    best = scored.orderBy(F.desc("score"), "doc_id").limit(50)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


@query(r"""
WITH p AS (SELECT page_id % 50 AS topic, url, try_cast(regexp_extract(replace(url, '=', ' '), '(?i)page\s*(\d{1,3})', 1) AS DOUBLE) / 100 AS hint FROM pages)
SELECT topic, round(avg(CASE WHEN hint > 1 THEN 1 ELSE hint END), 6) AS page,
  list_sort(list_distinct(flatten(list(CASE WHEN contains(lower(url), 'news') THEN ['press'] ELSE [] END || CASE WHEN contains(lower(url), 'example') OR contains(lower(url), 'http') THEN ['web'] ELSE [] END)))) AS tags FROM p GROUP BY topic""")
def name_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and a mean numeric hint from the addresses of a topic's pages (JON-22, FUN-34, AGG-28, DOM-18)."""
    pages = table(spark, sf_dir, "pages").withColumn("topic", F.col("page_id") % 50)
    return derive.name_hints(pages, "topic", F.replace("url", F.lit("="), F.lit(" ")), {"press": ["news"], "web": ["example", "http"]}, ["page"])


@query("""
WITH k AS (SELECT doc_id, n_chars, quality, coalesce(quality = 1, false) AS keep0 FROM documents LEFT JOIN labels USING (doc_id)),
o AS (SELECT *, CASE WHEN doc_id % 97 = 0 THEN true WHEN doc_id % 89 = 0 THEN false ELSE keep0 END AS keep FROM k)
SELECT doc_id, keep FROM (SELECT doc_id, n_chars, keep, CASE WHEN keep THEN 0 ELSE 1 END AS f FROM o ORDER BY f, n_chars DESC, doc_id LIMIT 500)""")
def keep_and_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents by label, with overrides, filled up to 500 by length (DOM-17, DOM-25)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    override = F.when(F.col("doc_id") % 97 == 0, True).when(F.col("doc_id") % 89 == 0, False)
    overrides = docs.select("doc_id", override.alias("keep_override")).where("keep_override IS NOT NULL")
    sorted_out = derive.keep_set(docs, F.col("quality") == 1, overrides, "doc_id")
    order = [F.desc("n_chars"), F.col("doc_id")]
    return derive.fill_up(sorted_out.where("keep"), sorted_out, "doc_id", order, 500).select("doc_id", "keep")

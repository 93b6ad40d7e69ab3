"""Sequence queries: events of a user in time are the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import quantiles, queue, stats, timeline
from lodestar.plans.registry import query
from lodestar.session import table


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


NUMBERED_SQL = "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place (from 0) among their user's, and how many those are."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    everything = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").withColumns({"place": F.row_number().over(w) - 1, "total": F.count("*").over(everything)})


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) / 1000000 - lag(epoch_us(ts) / 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, round(median(gap), 4) AS median_gap, count(gap) AS gaps FROM g WHERE gap > 60 GROUP BY user_id""")
def interval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median gap over a minute between a user's events (WIN-10, AGG-19)."""
    found = timeline.gaps(events_of(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("seconds")).where("gap > 60")
    return quantiles.exact_quantiles(found, ["user_id"], "gap", [0.5]).select("user_id", F.round(F.col("quantiles")[0], 4).alias("median_gap"), F.col("n").alias("gaps"))


@query("""
WITH w AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS around,
  coalesce(greatest(0, ln(1 + value) - ln(1 + lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id))), 0) AS onset FROM events)
SELECT user_id, event_id, around, value = around AS is_peak, round(onset, 6) AS onset FROM w""")
def rolling_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks within three events and rises of the logarithm (WIN-11, WIN-12)."""
    order = ["ts", "event_id"]
    peaks = timeline.local_maxima(table(spark, sf_dir, "events"), ["user_id"], order, "value", 3)
    rises = timeline.onset(peaks, ["user_id"], order, F.col("value"))
    return rises.select("user_id", "event_id", "around", "is_peak", F.round("onset", 6).alias("onset"))


@query(f"""
WITH {NUMBERED_SQL},
s AS (SELECT user_id, max(total) AS total FROM n GROUP BY user_id),
t AS (SELECT DISTINCT user_id, total, unnest(list_append(range(0, greatest(total - 20, 0) + 1, 15), greatest(total - 20, 0))) AS start FROM s)
SELECT t.user_id, t.start::INT AS start, count(*) AS events, round(avg(value), 4) AS mean FROM t JOIN n ON n.user_id = t.user_id
  AND n.place >= t.start AND n.place < t.start + 20 GROUP BY t.user_id, t.start""")
def tiled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 events every 15, the last flush with the end (WIN-13)."""
    placed = numbered(spark, sf_dir)
    tiles = placed.withColumn("start", F.explode(timeline.tile_starts(F.col("total"), 20, 15)))
    inside = tiles.where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + 20))
    return inside.groupBy("user_id", "start").agg(F.count("*").alias("events"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"""
WITH {NUMBERED_SQL},
b AS (SELECT unnest([3, 4, 5, 6, 8]) AS budget),
u AS (SELECT DISTINCT user_id, total FROM n),
k AS (SELECT user_id, budget, total, unnest(range(0, budget)) AS i FROM u, b),
p AS (SELECT DISTINCT user_id, budget, CASE WHEN total <= budget THEN i ELSE round_even(i * ((total - 1)::DOUBLE / (budget - 1)), 0) END::INT AS place
      FROM k WHERE total > budget OR i < total)
SELECT p.user_id, p.budget, n.event_id, n.place::INT AS place FROM p JOIN n ON n.user_id = p.user_id AND n.place = p.place""")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced events of each user for five budgets, both ends among them (WIN-14)."""
    placed = numbered(spark, sf_dir).withColumn("budget", F.explode(F.array(*map(F.lit, (3, 4, 5, 6, 8)))))
    chosen = placed.where(F.array_contains(timeline.evenly_spaced(F.col("total"), F.col("budget")), F.col("place")))
    return chosen.select("user_id", "budget", "event_id", "place")


@query(f"""
WITH {NUMBERED_SQL},
b AS (SELECT unnest([3, 4, 5, 6, 8]) AS budget),
u AS (SELECT DISTINCT user_id, total FROM n),
k AS (SELECT user_id, budget, total, unnest(range(0, budget)) AS i FROM u, b),
p AS (SELECT DISTINCT user_id, budget, CASE WHEN total <= budget THEN i ELSE round_even(i * ((total - 1)::DOUBLE / (budget - 1)), 0) END::INT AS place
      FROM k WHERE total > budget OR i < total),
c AS (SELECT p.user_id, p.budget, event_type, count(*) AS c FROM p JOIN n ON n.user_id = p.user_id AND n.place = p.place GROUP BY ALL),
m AS (SELECT *, sum(c) OVER (PARTITION BY user_id, budget) AS t, row_number() OVER (PARTITION BY user_id, budget ORDER BY c DESC, event_type) AS k FROM c),
v AS (SELECT user_id, budget, CASE WHEN c / t < 0.6 THEN 'mixed_or_variable' ELSE event_type END AS verdict, t FROM m WHERE k = 1),
fc AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL),
fm AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM fc),
f AS (SELECT user_id, CASE WHEN c / t < 0.6 THEN 'mixed_or_variable' ELSE event_type END AS verdict, t FROM fm WHERE k = 1)
SELECT budget, count(*) AS users, count(*) FILTER (WHERE v.verdict = f.verdict) AS same, round(1 - sum(v.t) / sum(f.t), 6) AS saved
FROM v JOIN f USING (user_id) GROUP BY budget""")
def window_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a few evenly spaced events give the verdict of all, and what they save (DOM-21)."""
    events = table(spark, sf_dir, "events")
    full = stats.mode_share(events, ["user_id"], "event_type").select("user_id", F.col("verdict").alias("full"))
    sizes = events.groupBy("user_id").agg(F.count("*").alias("all"))
    # The places that a budget picks follow from a user's count: few rows a user, joined on user and place.
    budgets = F.array(*(F.struct(F.lit(n).alias("budget"), timeline.evenly_spaced(F.col("all"), n).alias("places")) for n in (3, 4, 5, 6, 8)))
    picks = sizes.select("user_id", F.inline(budgets)).select("user_id", "budget", F.explode("places").alias("place"))
    chosen = numbered(spark, sf_dir).join(picks, ["user_id", "place"])
    few = stats.mode_share(chosen, ["user_id", "budget"], "event_type").select("user_id", "budget", "verdict")
    used = chosen.groupBy("user_id", "budget").agg(F.count("*").alias("used"))
    joined = few.join(used, ["user_id", "budget"]).join(full, "user_id").join(sizes, "user_id")
    return joined.groupBy("budget").agg(
        F.count("*").alias("users"),
        F.count_if(F.col("verdict") == F.col("full")).alias("same"),
        F.round(1 - F.sum("used") / F.sum("all"), 6).alias("saved"),
    )


@query(f"""
WITH {NUMBERED_SQL},
p AS (SELECT user_id, count(DISTINCT event_type) AS kinds, max(value) - min(value) AS spread FROM n WHERE place % 7 = 0 GROUP BY user_id),
z AS (SELECT user_id, event_id, (value - median(value) OVER (PARTITION BY event_type)) / coalesce(nullif(stddev_pop(value) OVER (PARTITION BY event_type), 0), 1) AS z FROM events)
SELECT p.user_id, kinds, round(spread, 4) AS spread, kinds = 1 AND spread <= 1 AS agree, round(max(1 / (1 + exp(-(z - 0.45) * 1.15))), 6) AS top_confidence
FROM p JOIN z USING (user_id) GROUP BY ALL""")
def probe_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every seventh event agrees, and a logistic confidence of the best one within its kind (WIN-15, WIN-17)."""
    probes = (
        numbered(spark, sf_dir)
        .where("place % 7 = 0")
        .groupBy("user_id")
        .agg(F.countDistinct("event_type").alias("kinds"), (F.max("value") - F.min("value")).alias("spread"))
    )
    events = table(spark, sf_dir, "events")
    marks = events.groupBy("event_type").agg(F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    z = (F.col("value") - F.col("m")) / F.col("s")
    best = quantiles.with_quantiles(events, ["event_type"], "value", {"m": 0.5}).join(marks, "event_type").groupBy("user_id").agg(F.max(1 / (1 + F.exp(-(z - 0.45) * 1.15))).alias("c"))
    return probes.join(best, "user_id").select(
        "user_id", "kinds", F.round("spread", 4).alias("spread"), ((F.col("kinds") == 1) & (F.col("spread") <= 1)).alias("agree"),
        F.round("c", 6).alias("top_confidence"),
    )


@query("""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS turn,
                  count(*) OVER (PARTITION BY lang) AS bucket_size FROM documents)
SELECT doc_id, lang, turn FROM r ORDER BY turn, bucket_size, lang LIMIT 60""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic sample of 60 documents, languages in turn (WIN-07, WIN-08, DOM-16)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    order = [F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id")]
    return timeline.round_robin(docs, "lang", order, 60).select("doc_id", "lang", F.col("turn").cast("long").alias("turn"))


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS u FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS s FROM a WHERE u = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS l FROM b WHERE s <= 8)
SELECT doc_id, source, lang, n_chars FROM c WHERE l <= 40 ORDER BY n_chars DESC, doc_id LIMIT 100""")
def greedy_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest documents: one of each text, at most 8 of a source and 40 of a language (WIN-06 in rank form)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.md5("text").alias("body"))
    order = [F.desc("n_chars"), F.col("doc_id")]
    return timeline.capped(docs, ["body"], {"source": 8, "lang": 40}, order, 100).drop("body")


@query("""
WITH RECURSIVE r AS (SELECT p_partkey AS id, p_brand AS prim, p_brand || ' ' || (p_size % 6) AS combo, p_brand || ' ' || (p_size % 6) || chr(0) || p_type AS rec,
  CASE WHEN p_partkey % 3 > 0 THEN 'c' || (p_partkey % 701) END AS code, p_partkey % 97 = 0 AS exempt, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS n FROM part),
t AS (SELECT row_number() OVER (ORDER BY cap, n) AS k, cap, r.* FROM r, (VALUES (3), (5), (8)) c(cap)),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ids, []::VARCHAR[] AS codes, []::VARCHAR[] AS recs, []::VARCHAR[] AS prims, []::VARCHAR[] AS combos
  UNION ALL SELECT k, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(codes, code) ELSE codes END, CASE WHEN ok THEN list_append(recs, rec) ELSE recs END,
    CASE WHEN ok THEN list_append(prims, prim) ELSE prims END, CASE WHEN ok THEN list_append(combos, combo) ELSE combos END
  FROM (SELECT t.k, id, code, rec, prim, combo, ids, codes, recs, prims, combos,
          NOT list_contains(ids, id) AND NOT coalesce(list_contains(codes, code), false) AND NOT list_contains(recs, rec) AND len(list_filter(prims, lambda x: x = prim)) < cap
          AND (exempt OR len(list_filter(combos, lambda x: x = combo)) < 2) AS ok FROM g JOIN t ON t.k = g.k + 1 WHERE len(ids) < 160)),
f AS (SELECT ids FROM g ORDER BY k DESC LIMIT 1)
SELECT unnest(ids) AS p_partkey, generate_subscripts(ids, 1)::INT AS place FROM f""")
def running_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """160 parts in order of size: none of a taken code, type and combination, at most 3, then 5, then 8 of a brand and two of a
    combination (WIN-06)."""
    parts, combo = table(spark, sf_dir, "part"), F.concat_ws(" ", "p_brand", F.col("p_size") % 6)
    code = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("c"), F.col("p_partkey") % 701))
    chosen = timeline.running_greedy(parts, "p_partkey", -F.col("p_size"), F.col("p_brand"), combo, F.col("p_type"), code, F.col("p_partkey") % 97 == 0, 160)
    return chosen.select("p_partkey", "place")


@query("""
SELECT o_orderkey, ceil(n / 100)::BIGINT AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)""")
def chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in parts of 100 by key (SRT-11, SNK-15)."""
    numbered_ = queue.dense_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "place")
    return numbered_.select("o_orderkey", timeline.chunks(F.col("place") + 1, 100).alias("part"))

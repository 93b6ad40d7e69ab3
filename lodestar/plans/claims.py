"""Queries that run the remaining operators on stand-ins: merges, matchers, rhythm, interpreted columns, import rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import music, scores, text
from lodestar.operators import derive, queue, resolve, setjoin, stats
from lodestar.plans.queue import NEW_SQL, OLD_SQL, snapshots
from lodestar.plans.registry import query
from lodestar.plans.resolve import overlap_sql
from lodestar.plans.similarity import FOLD_SQL
from lodestar.session import table
from lodestar.streaming import incremental


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders are added, known ones left (SNK-03)."""
    return queue.insert_absent(*snapshots(spark, sf_dir), ["k"])


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT * FROM old WHERE status IS DISTINCT FROM 'F' UNION ALL SELECT * FROM new WHERE status = 'F'")
def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of one status are replaced (SNK-06)."""
    old, new = snapshots(spark, sf_dir)
    return queue.replace_source(old, new.where("status = 'F'"), "status", "F")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL AND (o.k IS NULL OR o.price IS DISTINCT FROM n.price) THEN 'pending' ELSE o.status END AS status,
       CASE WHEN n.k IS NOT NULL THEN n.price ELSE o.price END AS price FROM old o FULL JOIN new n ON o.k = n.k WHERE o.k IS NOT NULL""")
def reset_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status starts again only where the price differs (SNK-08, FLT-07)."""
    old, new = snapshots(spark, sf_dir)
    return queue.reset_if_changed(old, new.join(old.select("k"), "k", "left_semi"), "k", ["price"], "status", "pending")


@query("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 'verified' WHEN o_custkey % 3 = 0 THEN 'present_unverified' WHEN o_custkey % 5 = 0 THEN 'collection_present'
    WHEN o_custkey % 2 = 0 AND o_totalprice <= 200000 THEN 'claimed_local' ELSE 'missing' END AS "local",
  CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 'complete' WHEN o_custkey % 3 = 0 THEN 'verify_local' WHEN o_custkey % 5 = 0 THEN 'locate_existing'
    WHEN o_custkey % 2 = 0 AND o_totalprice <= 200000 THEN 'locate_existing' ELSE 'needs_source' END AS acquisition,
  CASE WHEN o_custkey % 3 = 0 AND o_orderstatus = 'F' THEN 'verified_local' WHEN o_custkey % 3 = 0 THEN 'local_index' WHEN o_custkey % 5 = 0 THEN 'collection_path'
    WHEN o_custkey % 2 = 0 AND o_totalprice <= 200000 THEN 'not_in_missing_list' WHEN o_totalprice > 200000 THEN 'missing_list' ELSE 'catalogue_only' END AS reason FROM orders""")
def acquisition_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of an order's whereabouts, and what to do next (DOM-14)."""
    k = F.col("o_custkey")
    path = F.when(k % 3 == 0, F.lit("/p"))
    state = queue.acquisition_state(path, F.col("o_orderstatus") == "F", k % 5 == 0, k % 2 == 0, F.col("o_totalprice") > 200000)
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("s")).select("o_orderkey", "s.*")


CASCADE_SQL = f"""
WITH l AS (SELECT p_partkey AS id, p_brand || p_size AS block, p_name || ' (deluxe)' AS title, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS link, CASE WHEN p_partkey % 4 = 1 THEN p_retailprice::VARCHAR || p_brand END AS code FROM part),
r AS (SELECT p_partkey AS found, p_brand || p_size AS block, p_name AS name, p_retailprice::VARCHAR || p_brand AS code FROM part),
u AS (SELECT code, min(found) AS found FROM r GROUP BY 1 HAVING count(DISTINCT found) = 1),
f AS (SELECT l.id, r.found, {overlap_sql(FOLD_SQL.format('title'), FOLD_SQL.format('name'))} AS score FROM l JOIN r USING (block)),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, found) AS n, coalesce(lead(score) OVER (PARTITION BY id ORDER BY score DESC, found), 0) AS second FROM f),
a AS (SELECT id, found, score FROM k WHERE n = 1 AND score >= 0.82 AND (score - second >= 0.08 OR score >= 0.95))
SELECT l.id, coalesce(link, u.found, a.found) AS found, CASE WHEN link IS NOT NULL THEN 'id_in_name' WHEN u.found IS NOT NULL THEN 'unique_code' WHEN a.found IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS method,
  round(CASE WHEN link IS NOT NULL THEN 1.0 WHEN u.found IS NOT NULL THEN 0.99 WHEN a.found IS NOT NULL THEN a.score ELSE 0 END, 6)::DOUBLE AS confidence
FROM l LEFT JOIN u USING (code) LEFT JOIN a ON a.id = l.id"""


@query(CASCADE_SQL)
def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts matched by an id in their name, else a unique code, else their words in a block of brand and size (JON-10,
    JON-11, JON-12, FUN-09, WIN-18)."""
    part = table(spark, sf_dir, "part")
    block, k = F.concat("p_brand", "p_size"), F.col("p_partkey")
    code = F.concat(F.col("p_retailprice").cast("string"), "p_brand")
    left = part.select(k.alias("id"), block.alias("block"), F.concat("p_name", F.lit(" (deluxe)")).alias("title"), F.when(k % 4 == 0, k).alias("link"), F.when(k % 4 == 1, code).alias("code"))
    right = part.select(k.alias("found"), block.alias("block"), F.col("p_name").alias("name"), code.alias("code"))
    linked = left.where("link is not null").select("id", F.col("link").alias("found"))
    coded = left.join(resolve.unique_keys(right, "code", "found"), "code").select("id", "found")
    words, both = (text.tokens("title"), text.tokens("name")), (F.col("block"), F.col("block"))
    fuzzy = setjoin.matched_sets(left, right, "id", "found", both, words).withColumnRenamed("score", "confidence")
    stages = [("id_in_name", linked, 1.0), ("unique_code", coded, 0.99), ("fuzzy", fuzzy, None)]
    out = resolve.cascade(left.select("id"), stages, "id", "found")
    return out.withColumn("confidence", F.round("confidence", 6))


@query()
def exact_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching ratios and exact foldings of neighbouring parts' names, blocked by brand (FUN-01, FUN-08, JON-12); no SQL."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("name"), (F.col("p_partkey") % 10).alias("other"))
    few = part.groupBy("p_brand").agg(F.min_by("name", "p_partkey").alias("first"))
    pairs = resolve.fuzzy_candidates(part, few, "p_brand", "name", "first", text.matching_ratio)
    return pairs.select("p_partkey", text.nfkd_fold("name").alias("folded"), F.round("score", 6).alias("score"), F.round(resolve.title_score(F.col("score"), F.lit(1.0)), 6).alias("title"))


@query("""
WITH t AS (SELECT user_id, event_type AS tag, event_type || '-core' AS longer, value FROM events)
SELECT DISTINCT a.user_id, a.tag FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.user_id = a.user_id AND b.value > 60 AND contains(b.longer, a.tag)) AND length(a.tag) >= 5""")
def contained_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that a longer label of the same user contains (JON-17)."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"), "value")
    longer = events.where("value > 60").select("user_id", F.concat("tag", F.lit("-core")).alias("longer")).distinct()
    return derive.contained_labels(events.select("user_id", "tag").distinct(), longer, "user_id", "tag", "longer")


RHYTHM_SQL = """
WITH u AS (SELECT user_id, coalesce(avg(value) FILTER (event_type = 'click'), 0) / 100 AS steady, coalesce(avg(value) FILTER (event_type = 'view'), 0) / 100 AS broken,
  coalesce(max(value) FILTER (event_type = 'error'), 0) / 300 AS beatless, avg(value) FILTER (event_type = 'purchase') / 100 AS dance, avg(value) FILTER (event_type = 'signup') / 100 AS energy, count(*) AS beats FROM events GROUP BY 1),
p AS (SELECT *, CASE WHEN steady > 0 AND broken > 0 AND abs(steady - broken) < 0.16 THEN 'mixed_or_variable' WHEN steady > broken THEN 'steady_four_on_floor' WHEN broken > 0 THEN 'broken_beat' ELSE 'unknown' END AS pattern,
  CASE WHEN steady > 0 AND broken > 0 AND abs(steady - broken) < 0.16 THEN greatest(steady, broken) * 0.62 WHEN steady > broken THEN steady WHEN broken > 0 THEN broken ELSE 0 END AS pc FROM u),
b AS (SELECT *, CASE WHEN pattern <> 'unknown' THEN 'beat' WHEN beatless > 0 THEN 'beatless' WHEN dance >= 0.48 OR energy >= 0.62 THEN CASE WHEN dance IS NOT NULL AND energy IS NOT NULL THEN 'beat' ELSE 'unknown' END
    WHEN dance <= 0.2 AND energy <= 0.3 THEN 'beatless' ELSE 'unknown' END AS beat,
  CASE WHEN pattern <> 'unknown' THEN greatest(pc, 0.55) WHEN beatless > 0 THEN beatless * 0.82 WHEN dance IS NOT NULL AND energy IS NOT NULL AND (dance >= 0.48 OR energy >= 0.62) THEN 0.46
    WHEN dance IS NOT NULL AND energy IS NOT NULL AND dance <= 0.2 AND energy <= 0.3 THEN 0.44 ELSE 0 END AS bc,
  least(1, greatest(0, 0.58 * broken + 0.42 * (1 - steady))) AS sync FROM p),
r AS (SELECT *, least(1, greatest(0, 0.8 * (0.62 * steady + 0.28 * 0.5 + 0.10 * 0.6) * (1 - 0.25 * broken))) AS four, least(1, greatest(0, 0.8 * (0.72 * sync + 0.18 * (1 - steady) + 0.10 * 0.5))) AS brk FROM b)
SELECT user_id, pattern, round(pc, 6)::DOUBLE AS pattern_confidence, beat, round(bc, 6)::DOUBLE AS beat_confidence, round(sync, 6)::DOUBLE AS syncopation, round(four, 6)::DOUBLE AS four_on_floor, round(brk, 6)::DOUBLE AS broken_beat,
  CASE WHEN beats < 5 THEN 'beatless' WHEN steady >= 0.42 AND steady - broken >= 0.07 AND four >= 0.45 AND four - brk >= 0.04 THEN 'steady_four_on_floor'
    WHEN steady < 0.40 AND sync >= 0.35 AND brk >= 0.38 AND brk - four >= 0.04 THEN 'broken_beat' ELSE 'mixed_or_variable' END AS class,
  CASE WHEN user_id % 2 = 0 THEN CASE pattern WHEN 'steady_four_on_floor' THEN 'Four on the floor' WHEN 'mixed_or_variable' THEN 'Mixed / variable' WHEN 'broken_beat' THEN 'Broken beat'
      ELSE CASE WHEN greatest(four, brk) < 0.25 THEN 'Beatless' WHEN four >= brk THEN 'Four on the floor' ELSE 'Broken beat' END END
    ELSE CASE WHEN greatest(four, brk) < 0.25 THEN 'Beatless' WHEN four >= brk THEN 'Four on the floor' ELSE 'Broken beat' END END AS words FROM r"""


@query(RHYTHM_SQL)
def rhythm_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rhythm pattern, beat presence, rhythm scores and classes on a user's mean values (DOM-11, FUN-25, FUN-40)."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        (F.coalesce(F.avg(of("click")), F.lit(0.0)) / 100).alias("steady"), (F.coalesce(F.avg(of("view")), F.lit(0.0)) / 100).alias("broken"),
        (F.coalesce(F.max(of("error")), F.lit(0.0)) / 300).alias("beatless"), (F.avg(of("purchase")) / 100).alias("dance"), (F.avg(of("signup")) / 100).alias("energy"), F.count("*").alias("beats"),
    )
    steady, broken = F.col("steady"), F.col("broken")
    pattern, sure = derive.rhythm_pattern(steady, broken)
    users = users.withColumn("pattern", pattern).withColumn("pattern_confidence", sure)
    beat, beat_sure = derive.beat_presence(F.col("pattern"), F.col("pattern_confidence"), F.col("beatless"), F.col("dance"), F.col("energy"))
    made = music.rhythm_scores(F.lit(0.8), steady, broken, F.lit(0.5), F.lit(0.6))
    users = users.withColumns({"beat": beat, "beat_confidence": beat_sure, **made})
    four, breaks = F.col("four_on_floor"), F.col("broken_beat")
    kind = music.rhythm_class(F.lit(0.8), F.col("beats"), steady, broken, F.col("syncopation"), four, breaks)
    words = music.beat_type(F.when(F.col("user_id") % 2 == 0, F.col("pattern")), four, breaks)
    rounded = [F.round(c, 6).alias(c) for c in ("pattern_confidence", "beat_confidence", *made)]
    return users.select("user_id", "pattern", "beat", *rounded, kind.alias("class"), words.alias("words"))


@query("""
WITH t AS (SELECT user_id, CASE WHEN event_id % 9 = 0 THEN event_type || ' é' ELSE event_type || ' ' || (event_id % 5) END AS tag, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'src12x' WHEN event_id % 3 = 1 THEN 'src1' ELSE 'web' END AS source, value / 100 AS confidence FROM events),
r AS (SELECT *, CASE WHEN source = 'src12x' THEN 0 WHEN source = 'src1' THEN 1 ELSE 9 END AS rank FROM t WHERE tag NOT LIKE '%é%'),
a AS (SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY rank, confidence DESC, tag) AS n FROM r WHERE kind IN ('click', 'view')),
b AS (SELECT user_id, tag, row_number() OVER (PARTITION BY user_id ORDER BY rank, confidence DESC, tag) AS n FROM r WHERE kind IN ('purchase'))
SELECT u.user_id, coalesce(a.tag, '') AS genre, coalesce(b.tag, '') AS mood FROM (SELECT DISTINCT user_id FROM r) u LEFT JOIN a ON a.user_id = u.user_id AND a.n = 1 LEFT JOIN b ON b.user_id = u.user_id AND b.n = 1""")
def interpreted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each column the best tag of the kinds that feed it, trusted sources first, English tags alone (DOM-04, FUN-24, FLT-15)."""
    i, kind = F.col("event_id"), F.col("event_type")
    tags = table(spark, sf_dir, "events").select(
        "user_id", F.when(i % 9 == 0, F.concat(kind, F.lit(" é"))).otherwise(F.concat(kind, F.lit(" "), (i % 5).cast("string"))).alias("tag"), kind.alias("kind"),
        F.when(i % 3 == 0, "src12x").when(i % 3 == 1, "src1").otherwise("web").alias("source"), (F.col("value") / 100).alias("confidence"),
    )
    return derive.interpreted(tags, "user_id", "tag", "kind", "source", {"genre": ["click", "view"], "mood": ["purchase"]}, {"src1": 1, "src12": 0})


IMPORT_SQL = """
WITH i AS (SELECT user_id, event_type AS tag, CASE event_type WHEN 'click' THEN 'mood' WHEN 'view' THEN 'genre' WHEN 'error' THEN 'style' WHEN 'signup' THEN 'instrument' ELSE 'other' END AS family,
  avg(value) / 200 AS mean, max(value) / 200 AS p90, count(*) / (count(*) + 2.0) AS coverage FROM events GROUP BY 1, 2),
c AS (SELECT DISTINCT user_id, lower(event_type || CASE WHEN event_id % 2 = 0 THEN ' house' ELSE '' END) AS known FROM events WHERE value > 40),
g AS (SELECT i.*, EXISTS (SELECT 1 FROM c WHERE c.user_id = i.user_id AND (known = tag OR (length(known) >= 5 AND contains(known, tag)))) AS agreed FROM i),
m AS (SELECT user_id, tag, CASE family
    WHEN 'mood' THEN CASE WHEN mean >= 0.10 AND p90 >= 0.18 THEN 'mood' WHEN mean >= 0.04 THEN 'mood_candidate' END
    WHEN 'genre' THEN CASE WHEN mean >= 0.12 AND p90 >= 0.22 THEN CASE WHEN agreed THEN 'genre' ELSE 'genre_audio_candidate' END END
    WHEN 'style' THEN CASE WHEN mean >= 0.32 AND p90 >= 0.45 THEN CASE WHEN agreed THEN 'subgenre' ELSE 'audio_style_candidate' END END
    WHEN 'instrument' THEN CASE WHEN mean >= 0.20 AND p90 >= 0.40 THEN 'instrument' END END AS kind,
  CASE family WHEN 'mood' THEN CASE WHEN mean >= 0.10 AND p90 >= 0.18 THEN 0.48 + 1.5 * mean + 0.12 * coverage ELSE 0.35 + 1.5 * mean END
    WHEN 'genre' THEN 0.42 + 0.7 * mean + CASE WHEN agreed THEN 0.15 ELSE 0 END WHEN 'style' THEN 0.40 + mean WHEN 'instrument' THEN 0.40 + 0.65 * mean + 0.15 * coverage END AS confidence FROM g),
h AS (SELECT user_id, 'happy' AS tag, 'mood' AS kind, max(value) / 200 AS confidence FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING max(value) / 200 >= 0.75)
SELECT user_id, tag, kind, round(least(1, greatest(0, confidence)), 6)::DOUBLE AS confidence FROM m WHERE kind IS NOT NULL
UNION ALL SELECT h.user_id, h.tag, h.kind, round(h.confidence, 6) FROM h JOIN i ON i.user_id = h.user_id AND i.tag = 'click' AND i.mean >= 0.08"""


@query(IMPORT_SQL)
def import_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a model's results by family, with the catalogue's agreement (DOM-12, JON-17)."""
    events, kind = table(spark, sf_dir, "events"), F.col("event_type")
    family = F.when(kind == "click", "mood").when(kind == "view", "genre").when(kind == "error", "style").when(kind == "signup", "instrument").otherwise("other")
    items = events.groupBy("user_id", kind.alias("tag"), family.alias("family")).agg(
        (F.avg("value") / 200).alias("mean"), (F.max("value") / 200).alias("p90"), (F.count("*") / (F.count("*") + 2.0)).alias("coverage")
    )
    known = events.where("value > 40").select("user_id", F.concat(kind, F.when(F.col("event_id") % 2 == 0, " house").otherwise("")).alias("known"))
    heads = events.where("event_type = 'purchase'").groupBy("user_id").agg((F.max("value") / 200).alias("probability")).withColumn("tag", F.lit("happy"))
    support = items.withColumn("tag", F.when(F.col("tag") == "click", "happy").otherwise(F.col("tag")))
    made = derive.import_rules(items, known, "user_id", "known").unionByName(derive.supported_heads(heads, support, "user_id"))
    return made.withColumn("confidence", scores.rounded(F.col("confidence"), 6))


@query("""
WITH t AS (SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS n FROM events GROUP BY 1)
SELECT user_id, event_type AS tag, round(count(DISTINCT date_trunc('day', ts)) / any_value(n), 6)::DOUBLE AS share FROM events JOIN t USING (user_id) GROUP BY ALL""")
def window_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a user's days on which an event type occurs (AGG-24)."""
    windows = table(spark, sf_dir, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("tag"))
    return stats.tag_shares(windows, "user_id", "day", "tag").withColumn("share", F.round("share", 6))


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'USAB1' || lpad(p_partkey::VARCHAR, 7, '0') ELSE {FOLD_SQL.format('p_name')} || '|' || {FOLD_SQL.format('p_brand')} END AS recording,
  round({overlap_sql(FOLD_SQL.format('p_name'), FOLD_SQL.format("p_type || ' ' || p_name"))}, 6)::DOUBLE AS overlap,
  round(least(1, least(abs(p_size * 4 - 120), abs(p_size * 8 - 120), abs(p_size * 4 - 240)) / 25), 6)::DOUBLE AS tempo,
  round((least(p_size, p_partkey % 40) * 2.0 + CASE WHEN p_partkey % 3 = 0 THEN least(4, p_size % 9) * 1.5 ELSE 0 END) /
        nullif(greatest(p_size, p_partkey % 40) * 2.0 + CASE WHEN p_partkey % 3 = 0 THEN greatest(4, p_size % 9) * 1.5 ELSE 4 * 1.5 + p_size % 9 END, 0), 6)::DOUBLE AS jaccard,
  CASE WHEN lower(p_type) IN ('promo', 'economy') THEN 'price' WHEN lower(p_type) = 'standard' THEN 'plain' ELSE 'other' END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN 'minor' WHEN p_partkey % 3 = 1 THEN 'major' ELSE '2' END AS mode,
  round(least(1, CASE WHEN p_size > 1 THEN p_size / 100 ELSE p_size END), 6)::DOUBLE AS share FROM part""")
def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording keys, word overlaps, tempo distances, weighted map overlaps and parsed values (FUN-05, FUN-09, FUN-11,
    FUN-16, FUN-27 to FUN-29)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    code = F.when(k % 2 == 0, F.concat(F.lit("us-ab1-"), F.lpad(k.cast("string"), 7, "0")))
    # Maps that differ from part to part: a shared key, one that a third share, and else one that each alone has.
    a = F.create_map(F.lit("x"), size.cast("double"), F.lit("y"), F.lit(4.0))
    b = F.create_map(F.lit("x"), (k % 40).cast("double"), F.when(k % 3 == 0, "y").otherwise("z"), (size % 9).cast("double"))
    idf = F.create_map(F.lit("x"), F.lit(2.0), F.lit("y"), F.lit(1.5))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.recording_key(code, "p_name", "p_brand").alias("recording"),
        F.round(text.token_overlap("p_name", F.concat("p_type", F.lit(" "), "p_name")), 6).alias("overlap"),
        F.round(music.tempo_distance(size * 4, F.lit(120)), 6).alias("tempo"), F.round(scores.weighted_jaccard(a, b, idf), 6).alias("jaccard"),
        scores.keyword_kind(F.col("p_type"), {"price": ["promo", "economy"], "plain": ["standard"]}, "other").alias("kind"),
        music.mode_name((k % 3).cast("string")).alias("mode"), F.round(scores.share_in(F.concat(size, F.lit(" %"))), 6).alias("share"),
    )


@query("""
WITH m AS (SELECT o_orderkey AS k, o_totalprice > 300000 AS wrong FROM orders)
SELECT 'match' AS what, k, NULL::BIGINT AS line FROM m WHERE NOT wrong
UNION ALL SELECT 'derived', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM m WHERE wrong)""")
def retracted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a later fact disproves go, and the lines that were derived from them (STR-10)."""
    matches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") > 300000).alias("wrong"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line"))
    kept, derived = incremental.retracted(matches, lines, "k", F.col("wrong"))
    return kept.select(F.lit("match").alias("what"), "k", F.lit(None).cast("long").alias("line")).union(derived.select(F.lit("derived"), "k", "line"))

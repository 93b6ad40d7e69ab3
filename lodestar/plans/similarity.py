"""Similarity queries: vectors with their labels, users with their event types, customers, parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import music, scores, text, vectors
from lodestar.operators import ranking, search, similarity
from lodestar.plans.registry import query
from lodestar.session import table

FOLD_SQL = f"trim(regexp_replace(replace(translate(lower({{}}), '{text.ACCENTED}', '{text.PLAIN}'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
COSINE_SQL = """list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) /
  (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) *
   sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"""


@query(f"""
SELECT a.vec_id, round({COSINE_SQL}, 6) AS cosine FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id <> 0
ORDER BY {COSINE_SQL} DESC, a.vec_id LIMIT 20""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to vector 0 (JON-19, FUN-18, SRT-03)."""
    near = similarity.cosine_to(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0)
    best = similarity.top(near.where("vec_id <> 0"), "cosine", "vec_id", 20)
    return best.select("vec_id", F.round("cosine", 6).alias("cosine"))


FUSED_SQL = f"""
WITH s AS (SELECT a.vec_id, a.label, {COSINE_SQL} AS c, CAST(a.label = b.label AS DOUBLE) AS t FROM embeddings a, embeddings b WHERE b.vec_id = 0),
z AS (SELECT *, (c - avg(c) OVER ()) / coalesce(nullif(stddev_pop(c) OVER (), 0), 1) AS zc,
             (t - avg(t) OVER ()) / coalesce(nullif(stddev_pop(t) OVER (), 0), 1) AS zt FROM s),
f AS (SELECT *, 1.0 * zc + 0.5 * zt AS score FROM z WHERE vec_id <> 0)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    seed = vectors.where("vec_id = 0").select(F.col("label").alias("seed_label"))
    near = similarity.with_seed(similarity.cosine_to(vectors, "vec_id", "embedding", 0), seed)
    near = near.select("vec_id", "label", "cosine", (F.col("label") == F.col("seed_label")).cast("double").alias("same_label"))
    return similarity.fuse(near, {"audio": ["cosine"], "tags": ["same_label"]}, {"audio": 1.0, "tags": 0.5}).where("vec_id <> 0")


@query(FUSED_SQL + "SELECT vec_id, label, round(score, 6) AS score FROM f ORDER BY f.score DESC, vec_id LIMIT 20")
def zscore_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best by standardised cosine and label signals (DOM-06, AGG-16, SRT-03)."""
    return similarity.top(fused(spark, sf_dir), "score", "vec_id", 20).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(FUSED_SQL + """
SELECT vec_id, round(score, 6) AS score, CASE WHEN zc > 0.5 AND zt > 0.5 THEN CASE WHEN zc >= zt THEN ['cosine', 'label'] ELSE ['label', 'cosine'] END
  WHEN zc > 0.5 THEN ['cosine'] WHEN zt > 0.5 THEN ['label'] ELSE [] END AS reasons
FROM f ORDER BY f.score DESC, vec_id LIMIT 20""")
def topk_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each result's strongest signals (SRT-05)."""
    reasons = similarity.strongest({"cosine": F.col("z_cosine"), "label": F.col("z_same_label")})
    best = similarity.top(fused(spark, sf_dir), "score", "vec_id", 20)
    return best.select("vec_id", F.round("score", 6).alias("score"), reasons.alias("reasons"))


@query("""
WITH o AS (SELECT o_custkey, avg(o_totalprice) AS spend, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT c_custkey AS id, c_acctbal / 10000 AS bal, c_nationkey AS nation, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS seg,
             spend / 300000 AS spend, n / 30.0 AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey),
p AS (SELECT f.id, [1.0, 1.65, 0.55, 0.9] AS w, [abs(f.bal - s.bal), least(1, least(abs(f.spend - s.spend), abs(2 * f.spend - s.spend), abs(f.spend - 2 * s.spend))),
        CASE WHEN f.nation = s.nation THEN 0.0 ELSE 1.0 END, CASE WHEN f.seg IS NULL OR s.seg IS NULL THEN NULL WHEN f.seg = s.seg THEN 0.0 ELSE 1.0 END] AS d,
        s.seg IS NOT NULL AND f.seg IS NULL AS missing FROM f, f s WHERE s.id = 1 AND f.id <> 1),
q AS (SELECT id, (SELECT count(*) FROM (SELECT unnest(d) AS x) WHERE x IS NOT NULL) AS common,
      sqrt((list_sum(list_transform(range(1, 5), lambda i: CASE WHEN d[i] IS NULL THEN 0 ELSE w[i] * d[i] * d[i] END)) + CASE WHEN missing THEN 0.63 * 0.5625 ELSE 0 END) /
           (list_sum(list_transform(range(1, 5), lambda i: CASE WHEN d[i] IS NULL THEN 0 ELSE w[i] END)) + CASE WHEN missing THEN 0.63 ELSE 0 END)) AS dist FROM p)
SELECT id, common::INT AS common, round(100 * (1 - least(1, dist)), 4) AS similarity FROM q WHERE common >= 3 ORDER BY 100 * (1 - least(1, dist)) DESC, id LIMIT 50""")
def policy_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers near customer 1: weighted distance over balance, spend (half- and double-aware), nation and segment;
    a missing segment is penalised (DOM-05). The whole ranking is ``similar_parts``."""
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.avg("o_totalprice") / 300000).alias("spend"))
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    people = table(spark, sf_dir, "customer").join(spend, F.col("c_custkey") == F.col("o_custkey"), "left")
    people = people.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("bal"), F.col("c_nationkey").alias("nation"), segment.alias("seg"), "spend")
    seed = people.where("id = 1").select(*(F.col(c).alias(f"s_{c}") for c in people.columns))
    both = similarity.with_seed(people.where("id <> 1"), seed)
    same = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), None).when(F.col(a) == F.col(b), 0.0).otherwise(1.0)
    a, b = F.col("spend"), F.col("s_spend")
    terms = [
        (F.lit(1.0), F.abs(F.col("bal") - F.col("s_bal"))),
        (F.lit(1.65), F.when(a.isNotNull() & b.isNotNull(), F.least(F.lit(1.0), F.abs(a - b), F.abs(2 * a - b), F.abs(a - 2 * b)))),
        (F.lit(0.55), same("nation", "s_nation")),
        (F.lit(0.9), same("seg", "s_seg")),
    ]
    missing = F.when(F.col("s_seg").isNotNull() & F.col("seg").isNull(), F.lit(0.75))
    _, common, percent = similarity.weighted_distance(terms, [(F.lit(0.63), missing)])
    scored = both.select("id", common.alias("common"), percent.alias("p")).where("common >= 3")
    return similarity.top(scored, "p", "id", 50).select("id", "common", F.round("p", 4).alias("similarity"))


@query("""
SELECT p_partkey, round(2.2 * exp(-power(least(abs(p_retailprice - 1200), abs(p_retailprice * 2 - 1200), abs(p_retailprice / 2 - 1200)) / 180, 2))
  + 2.0 * exp(-power((p_size - 25) / 8, 2)) + CASE WHEN contains(p_name, 'green') THEN 1.5 ELSE 0 END - CASE WHEN p_retailprice > 1500 THEN (p_retailprice - 1500) * 0.01 ELSE 0 END, 6) AS score
FROM part ORDER BY score DESC, p_partkey LIMIT 100""")
def gaussian_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts around a target price (half- and double-aware) and size, with a bonus and a penalty (DOM-10, FUN-12)."""
    price = F.col("p_retailprice")
    score = (
        2.2 * scores.gaussian_tempo(price, 1200, 180)
        + 2.0 * scores.gaussian(F.col("p_size"), 25, 8)
        + F.when(F.contains("p_name", F.lit("green")), 1.5).otherwise(0.0)
        - F.when(price > 1500, (price - 1500) * 0.01).otherwise(0.0)
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(100)


@query("""
WITH w AS (SELECT user_id, event_type, max(value) AS w FROM events GROUP BY ALL),
p AS (SELECT a.user_id AS ref, b.user_id, sum(least(a.w, b.w)) AS shared FROM w a JOIN w b ON a.event_type = b.event_type
      WHERE a.user_id % 20 = 0 AND a.user_id <> b.user_id GROUP BY ALL),
t AS (SELECT user_id, sum(w) AS t FROM w GROUP BY 1)
SELECT ref, p.user_id, round(shared / (x.t + y.t - shared), 6) AS jaccard FROM p JOIN t x ON x.user_id = p.user_id JOIN t y ON y.user_id = ref""")
def weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth user against all, over their best value of each event type (FUN-16, AGG-13)."""
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("w"))
    refs = best.where("user_id % 20 = 0").select("user_id").distinct()
    return similarity.pair_jaccard(best, "user_id", "event_type", "w", refs, digits=6)


@query("""
WITH w AS (SELECT user_id, event_type || ' ' || hour(ts) AS event_type, sum(value) AS w FROM events GROUP BY ALL),
m AS (SELECT event_type FROM w WHERE user_id = 1), t AS (SELECT sum(w) AS r FROM w WHERE user_id = 1),
s AS (SELECT user_id, sum(w) AS own, coalesce(sum(w) FILTER (WHERE event_type IN (SELECT event_type FROM m)), 0) AS shared FROM w GROUP BY 1)
SELECT user_id, round(coalesce(shared / nullif(r + own - shared, 0), 0), 6) AS overlap FROM s, t""")
def inverted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each user's weights with those of user 1, by the candidate's weights (FUN-17, AGG-15)."""
    kind = F.concat_ws(" ", "event_type", F.hour("ts")).alias("event_type")
    weights = table(spark, sf_dir, "events").groupBy("user_id", kind).agg(F.sum("value").alias("w"))
    return similarity.tag_overlap(weights, "user_id", "event_type", "w", 1).withColumn("overlap", F.round("overlap", 6))


@query(f"""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT b.vec_id AS query, a.vec_id, a.label = b.label AS sib, {COSINE_SQL} AS c, -abs(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE) AS d
      FROM embeddings a, q b WHERE a.vec_id <> b.vec_id),
l AS (SELECT query, vec_id, sib, 'cosine' AS signal, round(c, 9) AS score FROM s UNION ALL SELECT query, vec_id, sib, 'first', round(d, 9) FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query, signal ORDER BY score DESC, vec_id) AS k FROM l),
f AS (SELECT query, signal, coalesce(min(k) FILTER (WHERE sib AND k <= 2000), 1000000) AS k FROM r GROUP BY ALL)
SELECT signal, count(*) AS queries, round(avg(CAST(k <= 3 AS INT)), 6) AS recall, round(avg(1.0 / k), 6) AS mrr FROM f GROUP BY signal""")
def sibling_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well two signals find vectors of the same label, for every twentieth vector against all (DOM-09, AGG-29,
    WIN-05). The queries are a stated set; they meet all vectors in blocks."""
    every = table(spark, sf_dir, "embeddings")
    signals = {"cosine": vectors.cosine_matrix, "first": vectors.first_closeness}
    ranks = similarity.sibling_ranks(every.where("vec_id % 20 = 0"), every, "vec_id", "label", "embedding", signals)
    return similarity.rank_summary(ranks, 3, "signal")


# Keys of the catalogue below: names that the wheel knows, and two that it doesn't.
KEYS = ["C major", "A minor", "G", "E-minor", "F# minor", "Bb", "D major", "H dur", "B minor", "Ab", "C#m", "F", "none"]
KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"
#: Weight of a source for a field.
WEIGHTS = [("first", "bpm", 0.98), ("first", "key", 0.96), ("first", "energy", 0.95), ("second", "bpm", 1.0), ("second", "danceability", 0.28), ("second", "energy", 0.38)]
WEIGHTS_SQL = ", ".join(f"('{s}', '{f}', {w})" for s, f, w in WEIGHTS)


@query(f"""
WITH p AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type, p_size, p_retailprice AS price FROM part),
c AS (SELECT id, wheel FROM (SELECT id, {KEYS_SQL}[id % 13 + 1] AS k FROM p) JOIN (VALUES ('C major', '8B'), ('A minor', '8A'), ('G', '9B'), ('E-minor', '9A'), ('F# minor', '11A'), ('Bb', '6B'), ('D major', '10B'),
  ('B minor', '10A'), ('Ab', '4B'), ('C#m', '12A'), ('F', '7B')) w(name, wheel) ON name = k),
f AS (SELECT id, 'first' AS source, 'bpm' AS field, (60 + 2 * p_size)::DOUBLE AS x FROM p WHERE id % 4 > 0 UNION ALL SELECT id, 'second', 'bpm', (61 + p_size)::DOUBLE FROM p WHERE id % 5 > 0
  UNION ALL SELECT id, 'first', 'energy', price / 2000 FROM p WHERE id % 3 > 0 UNION ALL SELECT id, 'second', 'energy', price / 1900 FROM p
  UNION ALL SELECT id, 'second', 'danceability', p_size / 50.0 FROM p WHERE id % 7 > 0 UNION ALL SELECT id, 'other', 'liveness', (id % 10) / 10.0 FROM p WHERE id % 6 = 1),
q AS (SELECT f.*, coalesce(w, 0.4) AS quality FROM f LEFT JOIN (VALUES {WEIGHTS_SQL}) w(source, field, w) ON w.source = f.source AND w.field = f.field),
b AS (SELECT id, field, x, quality FROM q QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY quality DESC, source) = 1),
t AS (SELECT id, 'genre' AS kind, lower(p_type) AS tag, 0.9 AS w FROM p WHERE id % 8 <> 2 UNION ALL SELECT id, 'genre', 'g' || (p_size % 5), 0.35 FROM p WHERE id % 8 <> 2
  UNION ALL SELECT id, 'mood', split_part(title, ' ', 1), 0.5 + (id % 5) / 10.0 FROM p UNION ALL SELECT id, 'mood', split_part(title, ' ', 2), 0.8 FROM p),
i AS (SELECT kind, tag, 1 + ln(((SELECT count(*) FROM p) + 1.0) / (count(DISTINCT id) + 1.0)) AS idf FROM t GROUP BY ALL),
m AS (SELECT t.id, t.kind, sum(t.w * idf) AS own, coalesce(sum(least(t.w, s.w) * idf) FILTER (s.w IS NOT NULL), 0) AS shared FROM t JOIN i USING (kind, tag) LEFT JOIN (SELECT * FROM t WHERE id = 1) s ON s.kind = t.kind AND s.tag = t.tag GROUP BY ALL),
j AS (SELECT m.id, m.kind, 1 - m.shared / (m.own + s.own - m.shared) AS d FROM m JOIN (SELECT * FROM m WHERE id = 1) s USING (kind)),
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT b.id, CASE b.field WHEN 'bpm' THEN 1.65 WHEN 'energy' THEN 1.3 WHEN 'danceability' THEN 1.05 ELSE 0.2 END * sqrt(b.quality * s.quality) AS w,
    CASE WHEN b.field = 'bpm' THEN least(1, least(abs(b.x - s.x), abs(2 * b.x - s.x), abs(b.x - 2 * s.x)) / 25) ELSE abs(b.x - s.x) END AS d FROM b JOIN b s ON s.id = 1 AND s.field = b.field
  UNION ALL SELECT p.id, 0.55 * 0.96, CASE WHEN a.wheel IS NULL THEN 1 WHEN a.wheel = s.wheel THEN 0 WHEN left(a.wheel, -1) = left(s.wheel, -1) THEN 0.18
    WHEN right(a.wheel, 1) = right(s.wheel, 1) AND abs(left(a.wheel, -1)::INT - left(s.wheel, -1)::INT) IN (1, 11) THEN 0.25 ELSE 1 END FROM p LEFT JOIN c a USING (id) JOIN c s ON s.id = 1
  UNION ALL SELECT id, CASE kind WHEN 'genre' THEN 1.8 ELSE 1.2 END, d FROM j
  UNION ALL SELECT p.id, 1.35 * sqrt((0.5 + (p.id % 4) / 10.0) * 0.6), CASE WHEN p.p_size % 3 = s.p_size % 3 THEN 0 ELSE 1 END FROM p JOIN p s ON s.id = 1 WHERE p.id % 9 > 0
  UNION ALL SELECT v.id, 2.6, (1 - greatest(-1, least(1, list_dot_product(v.e, s.e) / sqrt(list_dot_product(v.e, v.e) * list_dot_product(s.e, s.e))))) / 2 FROM v JOIN v s ON s.id = 1 WHERE v.id IN (SELECT id FROM p)),
a AS (SELECT id, count(*) AS common, sum(w * d * d) AS num, sum(w) AS den FROM d GROUP BY 1),
g AS (SELECT a.id, common, CASE WHEN a.id % 8 = 2 THEN num + 1.26 * 0.5625 ELSE num END AS num, CASE WHEN a.id % 8 = 2 THEN den + 1.26 ELSE den END AS den FROM a)
SELECT g.id, common::INT AS common, round(100 * (1 - least(1, sqrt(num / den))), 6) AS similarity FROM g JOIN p USING (id) JOIN p s ON s.id = 1
WHERE g.id <> 1 AND common >= 3 AND NOT (p.title = s.title AND p.artist = s.artist)""")
def similar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts by their distance from part 1 over fields of several sources, tempo, key, tags, an attribute and vectors, in one ranking
    (DOM-05, FUN-11, FUN-14, FUN-16, AGG-13, AGG-14, FLT-11)."""
    k, parts = F.col("p_partkey"), table(spark, sf_dir, "part")
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    feature = lambda source, field, number, words=no_text: F.struct(F.lit(source).alias("source"), F.lit(field).alias("field"), number.cast("double").alias("number"), words.alias("text"))
    names = F.array(*map(F.lit, KEYS))
    fields = F.array(
        feature("first", "bpm", F.when(k % 4 > 0, 60 + 2 * F.col("p_size"))), feature("second", "bpm", F.when(k % 5 > 0, 61 + F.col("p_size"))),
        feature("first", "energy", F.when(k % 3 > 0, F.col("p_retailprice") / 2000)), feature("second", "energy", F.col("p_retailprice") / 1900),
        feature("second", "danceability", F.when(k % 7 > 0, F.col("p_size") / 50)), feature("other", "liveness", F.when(k % 6 == 1, (k % 10) / 10)),
        feature("first", "key", nothing, names[(k % 13).cast("int")]),
    )
    tag = lambda kind, name, confidence: F.struct(F.lit(kind).alias("tag_type"), name.alias("tag"), confidence.cast("double").alias("confidence"))
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    genres = F.array(tag("genre", F.lower("p_type"), F.lit(0.9)), tag("genre", F.concat(F.lit("g"), F.col("p_size") % 5), F.lit(None)))
    moods = F.array(tag("mood", word(1), 0.5 + (k % 5) / 10), tag("mood", word(2), F.lit(0.8)))
    tags = parts.select(k.alias("id"), F.inline(F.concat(F.when(k % 8 != 2, genres).otherwise(F.slice(genres, 1, 0)), moods)))
    rhythm = parts.select(k.alias("id"), F.lit("rhythm_pattern").alias("attribute"), F.when(k % 9 > 0, (F.col("p_size") % 3).cast("string")).otherwise("unknown").alias("value"), (0.5 + (k % 4) / 10).alias("confidence"))
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("clap").alias("family"), vectors.as_doubles(F.col("embedding")).alias("vector"))
    named = parts.select(k.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist_names"), no_text.alias("isrc"))
    policies = spark.createDataFrame(WEIGHTS, "source string, field string, similarity_weight double")
    found = ranking.similar_entities(named, parts.select(k.alias("id"), F.inline(fields)), policies, tags, rhythm, embedded, 1)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("""
WITH k AS (SELECT doc_id, source, n_chars, concat_ws('|', trim(string_split_regex(lower(text), ' - | \\(| \\[|\\.')[1]), source) AS song FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY n_chars DESC, doc_id) AS n FROM k)
SELECT doc_id, md5(song) AS song FROM r WHERE n = 1""")
def song_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest document of each first clause and source (FUN-04, WIN-09). The key also ends at a full stop, as the
    texts have few dashes."""
    docs = table(spark, sf_dir, "documents")
    song = text.song_key(F.split("text", r"\.")[0], "source")
    keyed = docs.select("doc_id", "n_chars", F.md5(song).alias("song"))
    return similarity.first_of_key(keyed, ["song"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "song")


@query(f"""
WITH k AS (SELECT doc_id, {FOLD_SQL.format('text')} AS body FROM documents)
SELECT sha256(body) AS recording, count(*) AS copies, min(doc_id) AS first_id FROM k GROUP BY body HAVING count(*) > 1""")
def recording_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal in normal form (FUN-05, FUN-31)."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.groupBy(F.sha2(text.normalize("text"), 256).alias("recording"))
    return keyed.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""
WITH s AS (SELECT c_custkey, s.c_acctbal AS seed, c.c_acctbal AS own, c.c_nationkey, c.c_custkey AS id FROM customer c, (SELECT c_acctbal FROM customer WHERE c_custkey = 1) s),
o AS (SELECT o_custkey, min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, min(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT id, round(-abs(own - seed), 4) AS closeness, coalesce(f, o) AS first_price, CASE WHEN f IS NOT NULL THEN 'F' WHEN o IS NOT NULL THEN 'O' END AS price_source
FROM s LEFT JOIN o ON o_custkey = id""")
def cross_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness to customer 1, and a price from the first source that has one (JON-18, FUN-19, AGG-11, AGG-12)."""
    from lodestar.operators.fusion import preferred, rank_of

    people = table(spark, sf_dir, "customer")
    near = similarity.with_seed(people, people.where("c_custkey = 1").select(F.col("c_acctbal").alias("seed")))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')")
    priced = orders.groupBy("o_custkey", F.col("o_orderstatus").alias("source")).agg(F.min("o_totalprice").alias("value"))
    first = preferred(priced, ["o_custkey"], [rank_of("source", {"F": 0, "O": 1}, 9)])
    return near.join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"), F.round(-F.abs(F.col("c_acctbal") - F.col("seed")), 4).alias("closeness"),
        F.col("value").alias("first_price"), F.col("source").alias("price_source"),
    )


@query("""
WITH s AS (SELECT user_id, event_type AS signal, value FROM events UNION ALL SELECT user_id, 'weekday', dayofweek(ts) FROM events WHERE event_type = 'view'
           UNION ALL SELECT user_id, 'url_clicks', 1 FROM events),
c AS (SELECT signal, count(DISTINCT user_id) AS coverage FROM s WHERE value IS NOT NULL GROUP BY 1)
SELECT signal, coverage, signal IN ('click', 'view') AS is_default, CASE signal WHEN 'click' THEN 0.8 WHEN 'purchase' THEN 1.2 END AS weight
FROM c WHERE coverage >= 100 AND NOT regexp_matches(signal, '^url') AND signal IN ('click', 'purchase')""")
def signal_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that 100 users or more have, and a preset's weights for them (DOM-07, DOM-08, FLT-18)."""
    events = table(spark, sf_dir, "events")
    long = (
        events.select("user_id", F.col("event_type").alias("signal"), "value")
        .union(events.where("event_type = 'view'").select("user_id", F.lit("weekday"), F.dayofweek("ts").cast("double")))
        .union(events.select("user_id", F.lit("url_clicks"), F.lit(1.0)))
    )
    catalogue = similarity.signal_catalogue(long, "user_id", ["click", "view"], 100, "^url")
    return similarity.resolve_preset(catalogue, {"click": 0.8, "purchase": 1.2, "bpm": 2.0})


@query(r"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' +')) AS t FROM documents),
l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), a AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
f AS (SELECT doc_id, t, count(*) AS tf FROM w WHERE t IN ('licensed', 'public', 'version') GROUP BY ALL),
d AS (SELECT t, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM f JOIN d USING (t) JOIN l USING (doc_id), a GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked for three words (FLT-06, JON-26)."""
    ranked = search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["licensed", "public", "version"])
    return ranked.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)

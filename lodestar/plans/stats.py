"""Statistics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scores
from lodestar.operators import quantiles, stats
from lodestar.plans.registry import query
from lodestar.session import table


@query("""
SELECT user_id, count(*) AS plays, count(*) FILTER (WHERE value >= 30 AND coalesce(event_type <> 'error', true)) AS qualified,
       round(sum(coalesce(value, 0)), 4) AS total, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id""")
def play_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user, and those that count: at least 30 and no error (AGG-01)."""
    qualified = (F.col("value") >= 30) & F.coalesce(F.col("event_type") != "error", F.lit(True))
    return stats.play_stats(table(spark, sf_dir, "events"), "user_id", "value", "ts", qualified)


@query("SELECT user_id, count(DISTINCT event_type) AS stages FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def all_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with all five event types (AGG-05, FLT-05)."""
    return stats.has_all(table(spark, sf_dir, "events"), "user_id", "event_type", 5)


@query("""
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE text IS NOT NULL AND text <> '') AS has_text,
  count(*) FILTER (WHERE quality IS NOT NULL) AS labelled, count(*) FILTER (WHERE quality = 1) AS good,
  count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) FILTER (WHERE NOT starts_with(source, 'src1')) AS catalogued FROM d)
SELECT metric, n, coalesce(round(100.0 * n / n_all, 2), 0.0)::DOUBLE AS percent FROM (
  SELECT n_all, unnest(['has_text','labelled','good','toxic','catalogued']) AS metric,
         unnest([has_text, labelled, good, toxic, catalogued]) AS n FROM c)""")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have what, in one pass (AGG-03, AGG-04, DOM-22, FLT-03, FLT-04)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.coverage(
        docs,
        {
            "has_text": F.col("text").isNotNull() & (F.col("text") != ""),
            "labelled": F.col("quality").isNotNull(),
            "good": F.col("quality") == 1,
            "toxic": F.col("toxic") == 1,
            "catalogued": ~F.col("source").startswith("src1"),
        },
    )


@query("""
SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n,
       grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")
def group_counts_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and priority, by status, and in all, in one pass (AGG-02, AGG-31; grouping sets go beyond the
    parity)."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    return spark.sql("""
        SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n,
               cast(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS bigint) AS level
        FROM __orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")


@query(r"""
WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' +')) AS term FROM documents),
d AS (SELECT term, count(*) AS df FROM w WHERE term <> '' GROUP BY term)
SELECT term, df, round(1 + ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS idf FROM d""")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and rarity of every term (AGG-14)."""
    docs = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " +"))
    # distinct within a document already: counting suffices
    terms = docs.select(F.explode_outer(words).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    return terms.crossJoin(F.broadcast(total)).select(  # one row
        "term", "df", F.round(1 + F.log((F.col("total") + 1) / (F.col("df") + 1)), 6).alias("idf")
    )


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
SELECT user_id, event_type AS mode, round(n / total, 6) AS share,
       CASE WHEN n / total < 0.6 THEN 'mixed_or_variable' ELSE event_type END AS verdict FROM r WHERE k = 1""")
def mode_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant event type of each user (AGG-17, AGG-18)."""
    return stats.mode_share(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""
WITH p AS (SELECT event_type, quantile_cont(value, 0.2) AS p20, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.97) AS p97,
                  avg(value) AS m, avg(CAST(value >= 50 AS INT)) AS covered FROM events GROUP BY event_type)
SELECT event_type, round(p20, 6) AS p20, round(p90, 6) AS p90, round(p97, 6) AS p97, round(m, 6) AS mean, round(covered, 6) AS coverage,
       round(avg(coalesce(least(1, greatest(0, (value - p20) / nullif(p97 - p20, 0))), 0)), 6) AS mean_scaled
FROM events JOIN p USING (event_type) GROUP BY ALL""")
def percentile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each event type, share above 50, and values scaled between two of them (AGG-20, AGG-21)."""
    events = table(spark, sf_dir, "events")
    marks = quantiles.with_quantiles(events, ["event_type"], "value", {"p20": 0.2, "p90": 0.9, "p97": 0.97})
    scaled = marks.withColumn("scaled", stats.robust_unit(F.col("value"), F.col("p20"), F.col("p97")))
    rounded = lambda c, name: F.round(c, 6).alias(name)
    return scaled.groupBy("event_type").agg(
        *(rounded(F.first(n), n) for n in ("p20", "p90", "p97")), rounded(F.avg("value"), "mean"),
        rounded(F.avg((F.col("value") >= 50).cast("int")), "coverage"), rounded(F.avg("scaled"), "mean_scaled"),
    )


@query("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT *, list_sum(list_transform(e, lambda x: abs(x))) AS energy FROM v),
p AS (SELECT label, quantile_cont(energy, 0.2) AS p20 FROM n GROUP BY label),
f AS (SELECT n.*, greatest(energy, 0.35 * p20) AS fl FROM n JOIN p USING (label)),
w AS (SELECT *, fl / sum(fl) OVER (PARTITION BY label) AS weight FROM f),
s AS (SELECT label, dim, sum(weight * e[dim + 1]) AS s FROM w, range(64) r(dim) GROUP BY label, dim),
l AS (SELECT label, sqrt(sum(s * s)) AS norm FROM s GROUP BY label)
SELECT label, dim::INT AS dim, round(s / norm, 6) AS value FROM s JOIN l USING (label)""")
def vector_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy-weighted mean vector of each label, of length 1 (AGG-22, AGG-23)."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "energy", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    )
    weighted = stats.energy_weights(vectors, ["label"], "energy")
    return stats.weighted_mean_vector(weighted, ["label"], "embedding", "weight").withColumn("value", F.round("value", 6))


@query("""
SELECT user_id, count(*) AS failures, arg_max(props, (ts, event_id)) AS last_error FROM events
WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with three errors or more, and the last (AGG-33)."""
    events = table(spark, sf_dir, "events")
    return stats.quarantine(events, ["user_id"], F.col("event_type") == "error", F.col("props"), F.struct("ts", "event_id"))


@query("""
WITH s AS (SELECT p_brand AS brand, split_part(p_type, ' ', 1) AS class, sum(p_retailprice) AS score FROM part GROUP BY 1, 2),
r AS (SELECT *, score / max(score) OVER (PARTITION BY brand) AS share, row_number() OVER (PARTITION BY brand ORDER BY score DESC, class) AS n FROM s)
SELECT brand, class, round(score, 2) AS score, round(share, 6) AS share FROM r WHERE share >= 0.8 AND n <= 3""")
def broad_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices summed by the first word of the type; up to three classes of a brand near its largest (AGG-35, WIN-16)."""
    from lodestar.operators.timeline import top_per_key

    sums = stats.broad_classes(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "brand"), ["brand"], "p_type", "p_retailprice", " ")
    top = top_per_key(sums, ["brand"], [F.desc("score"), F.col("class")], 3).where("share >= 0.8")
    return top.select("brand", "class", F.round("score", 2).alias("score"), F.round("share", 6).alias("share"))


@query("""
SELECT (SELECT count(*) FROM customer)::BIGINT AS customers, (SELECT count(*) FROM orders)::BIGINT AS orders,
       (SELECT count(DISTINCT o_custkey) FROM orders)::BIGINT AS buyers, (SELECT round(avg(o_totalprice), 2) FROM orders) AS mean_order,
       (SELECT string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) FROM
          (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3)) AS top_kinds""")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for a dashboard (AGG-36, DOM-24, SRT-10)."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers"))
    totals = orders.agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("buyers"), F.round(F.avg("o_totalprice"), 2).alias("mean_order"))
    kinds = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "event_type", "n")))
    top = kinds.agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["event_type"], x["n"])), ",").alias("top_kinds"))
    return customers.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(top))  # one row each


@query("""
SELECT strftime(ts, '%Y-%m') AS month, event_type, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS over_fifty,
       round(sum(CASE WHEN value IS NULL OR nullif(user_id % 3, 0) IS NULL THEN NULL ELSE greatest(value, user_id % 3) END), 4) AS guarded
FROM events GROUP BY 1, 2""")
def quota_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sums by month; ``guarded`` adds the larger of two numbers unless either is null (AGG-09, AGG-34,
    FUN-37)."""
    third = F.nullif(F.col("user_id") % 3, F.lit(0)).cast("double")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type")
        .agg(
            F.round(F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)), 4).alias("over_fifty"),
            F.round(F.sum(scores.strict_max(F.col("value"), third)), 4).alias("guarded"),
        )
    )


@query("""
SELECT n_name AS nation, s.s_suppkey AS supplier, round(s.s_acctbal, 2) AS balance,
       round(coalesce(s.s_acctbal / nullif(max(s.s_acctbal) OVER (PARTITION BY n_name), 0), 0), 6) AS share
FROM nation JOIN supplier s ON s.s_nationkey = n_nationkey""")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's name on each of its suppliers, and their share of its largest balance (JON-23, JON-24, AGG-32)."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = joined.select(F.col("n_name").alias("nation"), F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("b"))
    shared = stats.share_of_top(rows, ["nation"], "b")
    return shared.select("nation", "supplier", F.round("b", 2).alias("balance"), F.round("share", 6).alias("share"))

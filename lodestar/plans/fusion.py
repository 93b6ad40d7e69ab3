"""Queries of family F1 on the driver's tables: users are entities, event types are sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import music
from lodestar.operators import fusion
from lodestar.plans.registry import query
from lodestar.session import table

POLICY = {"purchase": 1, "signup": 2, "click": 3, "view": 4}
KINDS = ("click", "error", "purchase", "signup", "view")
RANK_SQL = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 9 END"


@query(f"""
SELECT user_id, value, event_type AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {RANK_SQL}, value DESC NULLS LAST, event_id) AS n FROM events
) WHERE n = 1""")
def preferred_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value of each user by source rank, then value, then id (WIN-03, PRJ-07, DOM-01, AGG-10)."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "source")
    order = [fusion.rank_of("source", POLICY, 9), fusion.descending("value"), F.col("event_id")]
    return fusion.preferred(events, ["user_id"], order)


@query("""
SELECT user_id, """ + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in KINDS) + """
FROM events GROUP BY user_id""")
def preferred_value_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value of each source, a column each (PRJ-02, AGG-10)."""
    return fusion.pivot_values(table(spark, sf_dir, "events"), ["user_id"], "event_type", KINDS, "value")


@query("""
WITH o AS (
  SELECT l_partkey AS part, l_suppkey % 2 AS source, avg(l_extendedprice / l_quantity) AS price, avg(l_discount) AS energy,
         CASE WHEN sum(l_quantity) % 2 = 0 THEN 'even' ELSE 'odd' END AS quality
  FROM lineitem GROUP BY l_partkey, l_suppkey % 2),
d AS (
  SELECT a.part, round(a.price, 4) AS price_a, round(b.price, 4) AS price_b,
         least(abs(a.price - b.price), abs(2 * a.price - b.price), abs(a.price - 2 * b.price)) AS delta,
         a.quality AS qa, b.quality AS qb, a.energy AS ea, b.energy AS eb
  FROM o a JOIN o b ON a.part = b.part WHERE a.source = 0 AND b.source = 1)
SELECT part, price_a, price_b, round(delta, 4) AS delta, CAST(qa = qb AS INT) AS key_agrees,
       CAST(delta > 5 OR qa <> qb OR abs(ea - eb) > 0.25 AS INT) AS needs_review FROM d""")
def source_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a part from two groups of suppliers, half- and double-aware, with a review flag (JON-01, FUN-39,
    DOM-03). The tempo rule is applied to prices here: it tests the operator, not the domain."""
    seen = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("part"), (F.col("l_suppkey") % 2).alias("source"))
        .agg(
            F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.avg("l_discount").alias("energy"),
            F.when(F.sum("l_quantity") % 2 == 0, "even").otherwise("odd").alias("quality"),
        )
    )
    both = fusion.compare_sources(seen, "part", "source", 0, 1)
    delta = music.nearest_tempo_delta(F.col("price_a"), F.col("price_b"))
    return both.select(
        "part",
        F.round("price_a", 4).alias("price_a"),
        F.round("price_b", 4).alias("price_b"),
        F.round(delta, 4).alias("delta"),
        (F.col("quality_a") == F.col("quality_b")).cast("int").alias("key_agrees"),
        music.needs_review(delta, F.col("quality_a"), F.col("quality_b"), F.col("energy_a"), F.col("energy_b")).alias("needs_review"),
    )


@query("SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def tag_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user in order, distinct, joined (AGG-06, PRJ-03)."""
    return fusion.joined_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", " | ", "kinds")


@query("""
SELECT l_orderkey, l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber,
         l_quantity) AS n FROM lineitem) WHERE n = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dearest line of each order; ties go by all selected columns (WIN-01, WIN-02)."""
    columns = ["l_orderkey", "l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    order = [F.desc("l_extendedprice"), *map(F.col, columns[2:])]
    return fusion.best_row(table(spark, sf_dir, "lineitem").select(*columns), ["l_orderkey"], order)


@query("""
WITH p AS (SELECT user_id, count(*) AS events, max(value) AS top FROM events GROUP BY user_id),
b AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events)
SELECT p.user_id, p.events, p.top, round(k.value, 4) AS best_click, round(e.value, 4) AS best_error
FROM p LEFT JOIN b k ON k.user_id = p.user_id AND k.event_type = 'click' AND k.n = 1
       LEFT JOIN b e ON e.user_id = p.user_id AND e.event_type = 'error' AND e.n = 1""")
def attr_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of a user with the best value of two attributes (WIN-04, DOM-02): one aggregate, no join."""
    best = lambda kind: F.max_by(F.when(F.col("event_type") == kind, F.col("value")), F.when(F.col("event_type") == kind, F.struct("value", -F.col("event_id"))))
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("events"),
            F.max("value").alias("top"),
            F.round(best("click"), 4).alias("best_click"),
            F.round(best("error"), 4).alias("best_error"),
        )
    )

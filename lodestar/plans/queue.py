"""Queue and merge queries: two overlapping spans of the orders are snapshots, their status is the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import queue, search
from lodestar.plans.registry import query
from lodestar.session import table

OLD_SQL = "old AS (SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')"
NEW_SQL = "new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'P' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice + o_orderkey % 4 END AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders up to 1998, and orders from 1997 on with some states and prices changed."""
    orders, k, at = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    old = orders.where(at < F.lit("1999-01-01").cast("timestamp_ntz"))
    old = old.select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"))
    new = orders.where(at >= F.lit("1997-01-01").cast("timestamp_ntz")).select(
        k.alias("k"), F.when(k % 7 == 0, "P").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 11 != 0, F.col("o_totalprice") + k % 4).alias("price")
    )
    return old, new


@query(f"WITH {OLD_SQL}, {NEW_SQL} SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows replace old ones (SNK-01, SNK-02, SNK-06)."""
    old, new = snapshots(spark, sf_dir)
    return queue.upsert(old, new, ["k"])


@query(f"""WITH {OLD_SQL}, {NEW_SQL} SELECT k, old.status, coalesce(old.price, new.price) AS filled, coalesce(new.price, old.price) AS renewed FROM old LEFT JOIN new USING (k)""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing prices from the new rows; and new prices where there are any (SNK-03 to SNK-05)."""
    old, new = snapshots(spark, sf_dir)
    filled = queue.fill_missing(old, new, ["k"], ["price"]).withColumnRenamed("price", "filled")
    renewed = queue.fill_missing(old, new, ["k"], ["price"], prefer_new=True).select("k", F.col("price").alias("renewed"))
    return filled.join(renewed, "k").select("k", "status", "filled", "renewed")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, j AS (SELECT k, o.status AS os, n.status AS ns, o.price AS op, n.price AS np FROM old o JOIN new n USING (k))
SELECT k, 'status' AS field, os AS before, ns AS after FROM j WHERE os IS DISTINCT FROM ns
UNION ALL SELECT k, 'price', CASE WHEN op IS NULL THEN 'none' ELSE 'some' END, CASE WHEN np IS NULL THEN 'none' ELSE 'some' END FROM j WHERE op IS DISTINCT FROM np""")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two snapshots, field by field (SET-10, SNK-08, SNK-16, FLT-07)."""
    old, new = snapshots(spark, sf_dir)
    changed = queue.change_set(old, new, "k", ["status", "price"])
    told = lambda c: F.when(F.col("field") == "status", F.col(c)).when(F.col(c).isNull(), "none").otherwise("some").alias(c)
    return changed.select("k", "field", told("before"), told("after"))


@query(f"""WITH {OLD_SQL}, {NEW_SQL}
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN o.status WHEN o.status IN ('P') AND n.status = 'O' THEN o.status ELSE n.status END AS status,
       CASE WHEN n.k IS NULL THEN o.price ELSE coalesce(n.price, o.price) END AS price FROM old o FULL JOIN new n ON o.k = n.k""")
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New states, but those in flight are not set back (DOM-14, AGG-25, SNK-07)."""
    old, new = snapshots(spark, sf_dir)
    return queue.merge_states(old, new, "k", "status", ["P"], "O")


@query("""
WITH q AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderkey % 7 AS attempts, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + INTERVAL 30 DAY END AS next_at, o_orderdate AS updated FROM orders)
SELECT k, attempts, CASE WHEN status = 'P' AND updated < TIMESTAMP '1999-06-01' - INTERVAL 2 HOUR THEN 'O' ELSE status END AS state FROM q
WHERE status <> 'F' AND attempts < 4 AND (next_at IS NULL OR next_at <= TIMESTAMP '1999-06-01')""")
def retry_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders whose next try is due; stale ones in flight are released (FLT-08, FLT-09, FLT-12, STR-06)."""
    k, now = F.col("o_orderkey"), F.expr("TIMESTAMP_NTZ '1999-06-01 00:00:00'")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.col("o_orderstatus").alias("status"), (k % 7).alias("attempts"),
        F.when(k % 4 > 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("next_at"), F.col("o_orderdate").alias("updated"),
    )
    due = queue.due(rows, "status", ["F"], "attempts", 4, "next_at", now)
    return due.select("k", "attempts", queue.release_stale(F.col("status"), "P", "O", F.col("updated"), now, 2).alias("state"))


@query("""
SELECT c_custkey AS id, c_name AS title, round(c_acctbal, 2) AS balance, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_name ILIKE '%00%' OR c_mktsegment ILIKE '%00%' ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 50 OFFSET 100""")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of customers that match a search, by balance (SRT-02, FLT-01, PRJ-01)."""
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    found = people.where(search.any_contains(["c_name", "c_mktsegment"], "00"))
    catalogue = {"id": F.col("c_custkey"), "title": F.col("c_name"), "balance": F.round("c_acctbal", 2), "nation": F.col("n_name")}
    return search.page(found, catalogue | {}, "balance", "title", "c_custkey", 100, 50)


@query("""
SELECT p_partkey, p_type AS p_brand, p_brand AS p_type, replace(p_name, 'green', 'GREEN') AS p_name, contains(p_name, 'green') AS changed,
       CASE WHEN p_partkey IN (1, 5, 9) THEN 0 ELSE p_size END AS p_size FROM part""")
def cell_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells set, text replaced, two columns swapped (SNK-21)."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    edited = queue.edit_cells(parts, "p_partkey", [1, 5, 9], "p_size", F.lit(0), ["p_size"])
    return queue.swap_columns(queue.find_replace(edited, "p_name", "green", "GREEN", ["p_name"]), "p_brand", "p_type")


@query(f"""WITH {OLD_SQL}, {NEW_SQL}, j AS (SELECT o.k AS ok, n.k AS nk, o.status AS os, n.status AS ns, o.price AS op, n.price AS np FROM old o FULL JOIN new n ON o.k = n.k)
SELECT count(*) FILTER (WHERE ok IS NOT NULL AND nk IS NOT NULL) AS both_sides, count(*) FILTER (WHERE abs(op - np) < 2) AS near_price, count(*) FILTER (WHERE os = ns) AS same_status,
       count(*) FILTER (WHERE list_sort([os, 'x']) = list_sort(['x', ns])) AS same_set, count(*) FILTER (WHERE CASE WHEN os = 'F' THEN os ELSE coalesce(ns, os) END = 'F') AS finished FROM j""")
def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two snapshots, and how many orders are finished in either (JON-21, AGG-30, SET-06, SET-09)."""
    old, new = snapshots(spark, sf_dir)
    both = old.alias("o").join(new.alias("n"), "k")
    pair = lambda a, b: F.array_sort(F.array(a, b))
    agreed = both.agg(
        F.count("*").alias("both_sides"),
        F.count_if(F.abs(F.col("o.price") - F.col("n.price")) < 2).alias("near_price"),
        F.count_if(F.col("o.status") == F.col("n.status")).alias("same_status"),
        F.count_if(pair(F.col("o.status"), F.lit("x")) == pair(F.lit("x"), F.col("n.status"))).alias("same_set"),
    )
    finished = queue.keep_success(old, new, "k", "status", "F").agg(F.count_if(F.col("status") == "F").alias("finished"))
    return agreed.crossJoin(F.broadcast(finished))  # one row each

"""Resolution queries: documents against the benchmark, orders against customers, lines against orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scores, text
from lodestar.operators import ranking, resolve
from lodestar.plans.registry import query
from lodestar.plans.similarity import FOLD_SQL
from lodestar.session import table

WORDS_SQL = "list_distinct(string_split({}, ' '))"


def overlap_sql(a: str, b: str) -> str:
    return f"len(list_intersect({WORDS_SQL.format(a)}, {WORDS_SQL.format(b)})) / least(len({WORDS_SQL.format(a)}), len({WORDS_SQL.format(b)}))"


@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a dear finished order and without an urgent one (JON-05, JON-06, SET-04)."""
    orders = table(spark, sf_dir, "orders")
    dear = orders.where("o_orderstatus = 'F' AND o_totalprice > 250000")
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return resolve.absent(customers, (dear, "o_custkey"), (urgent, "o_custkey"), key="c_custkey")


@query("""
WITH k AS (SELECT md5(text) AS body, min(doc_id) AS owner FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) = 1)
SELECT doc_id, source FROM documents JOIN k ON md5(text) = body""")
def unique_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text no other has (JON-10, JON-27)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("body"))
    single = resolve.unique_keys(docs, "body", "doc_id").select("body")
    return docs.join(single, "body").select("doc_id", "source")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey AS paid, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT o.o_orderkey, p.paid, p.price, abs(o.o_totalprice - p.price) AS apart,
             row_number() OVER (PARTITION BY o.o_orderkey ORDER BY abs(o.o_totalprice - p.price), p.paid) AS n
      FROM orders o JOIN p ON p.o_custkey = o.o_custkey WHERE o.o_orderstatus = 'O')
SELECT o_orderkey, paid, price, round(apart, 4) AS apart FROM j WHERE n = 1""")
def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each open order the finished one of its customer with the nearest price (JON-20)."""
    orders = table(spark, sf_dir, "orders")
    open_ = orders.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", "o_totalprice")
    paid = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("paid"), F.col("o_totalprice").alias("price"))
    found = resolve.nearest(open_, paid, ["o_custkey"], "o_orderkey", "o_totalprice", "price", ["paid"])
    return found.withColumn("apart", F.round("apart", 4))


@query("""
SELECT o_orderstatus AS status, count(*) AS conflicts, max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)))::INT AS widest
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) > 100 GROUP BY 1""")
def range_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were shipped more than 100 days from their order's date (JON-14)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    apart = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return joined.where(F.abs(apart) > 100).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("conflicts"), F.max(apart).alias("widest"))


@query("""
WITH l AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS label FROM part WHERE length(split_part(p_name, ' ', 2)) >= 5)
SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM l WHERE contains(p_name, label) AND NOT starts_with(p_name, label))""")
def substring_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name holds, but doesn't begin with, a second word of some name (JON-17).

    The labels are matched where they can begin, length by length, so that the join is on equal keys."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    labels = parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("label")).where(F.length("label") >= 5).distinct()
    sizes = labels.select(F.length("label").alias("n")).distinct()
    starts = parts.crossJoin(F.broadcast(sizes))  # one row for each length of a label
    pieces = starts.select("p_partkey", "p_name", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("p_name") - F.col("n") + 1, F.lit(1))), lambda i: F.substring(F.col("p_name"), i, F.col("n")))).alias("label"))
    held = pieces.join(labels, "label", "left_semi").where(~F.startswith("p_name", F.col("label")))
    return held.select("p_partkey", "p_name").distinct()


MARGIN_SQL = f"""
WITH b AS (SELECT item_id, {FOLD_SQL.format('text')} AS body FROM benchmark), t AS (SELECT item_id, body, unnest({WORDS_SQL.format('body')}) AS w FROM b),
d AS (SELECT doc_id, {FOLD_SQL.format('text')} AS body FROM documents),
e AS (SELECT doc_id, unnest({WORDS_SQL.format('body')}) AS w FROM d), r AS (SELECT w FROM t WHERE w <> '' GROUP BY w HAVING count(DISTINCT item_id) = 1),
p AS (SELECT DISTINCT e.doc_id, t.item_id FROM e JOIN t USING (w) JOIN r USING (w)),
c AS (SELECT doc_id, item_id, d.body AS x, b.body AS y FROM p JOIN d USING (doc_id) JOIN b USING (item_id)),
s AS (SELECT doc_id, item_id, {overlap_sql('x', 'y')} AS score FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS n, coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, item_id), 0) AS second FROM s),"""


#: Texts whose words are compared in one task.
TEXTS_A_TASK = 4096


def benchmark_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share a word which one item alone has, with their word overlap.

    The words that one item alone has find the pairs; only for those the sets of words are compared. So no task counts for
    each document and each item."""
    # Words as 64-bit hashes: sets of numbers are compared much faster than sets of texts.
    words_of = lambda c: F.array_distinct(F.transform(F.split(text.normalize(c), " "), lambda w: F.xxhash64(w)))
    items = table(spark, sf_dir, "benchmark").select("item_id", words_of("text").alias("y"))
    words = items.select("item_id", F.explode_outer("y").alias("w"))
    rare = resolve.unique_keys(words.where(F.col("w") != F.xxhash64(F.lit(""))), "w", "item_id")
    # Exchanged once, by id: the words of each text are made once, and its pairs are where its words are. More texts are
    # more tasks, not larger ones.
    texts = table(spark, sf_dir, "documents")
    docs = texts.select("doc_id", words_of("text").alias("x")).repartition(max(16, -(-texts.count() // TEXTS_A_TASK)), "doc_id")
    met = docs.select("doc_id", F.explode_outer("x").alias("w")).join(rare, "w").select("doc_id", "item_id").distinct()
    pairs = met.join(docs, "doc_id").join(items, "item_id")
    return pairs.select("doc_id", "item_id", (F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))).alias("score"))


@query(MARGIN_SQL + """
z AS (SELECT * FROM k WHERE n = 1)
SELECT doc_id, item_id, round(score, 6) AS score, score >= 0.48 AND (score - second >= 0.08 OR score >= 0.95) AS accepted FROM z""")
def fuzzy_match_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best benchmark item of each document by words, accepted if it clearly beats the second (JON-11, JON-12, FUN-09,
    FUN-10, WIN-18)."""
    matched = resolve.match_with_margin(benchmark_candidates(spark, sf_dir), "doc_id", "item_id", F.col("score"), 0.48, 0.08, 0.95)
    return matched.select("doc_id", "item_id", F.round("score", 6).alias("score"), "accepted")


@query(MARGIN_SQL + """
z AS (SELECT DISTINCT doc_id FROM k WHERE score >= 0.72)
SELECT CASE WHEN d.doc_id IN (SELECT doc_id FROM z) THEN 'in_benchmark' WHEN coalesce(l.quality, 1) = 0 THEN 'poor' ELSE 'chosen' END AS reason,
       count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def fuzzy_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item resembles, and why the others are left out (JON-13, DOM-15)."""
    near = benchmark_candidates(spark, sf_dir).where("score >= 0.72").select("doc_id", F.lit(True).alias("near")).distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id").join(near, "doc_id", "left")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    reason = F.when(F.col("near"), "in_benchmark").when(F.coalesce("quality", F.lit(1)) == 0, "poor").otherwise("chosen")
    return labelled.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
WITH k AS (SELECT l_orderkey, l_linenumber, sha256(concat_ws(chr(0), l_orderkey::VARCHAR, l_linenumber::VARCHAR)) AS event_hash, {FOLD_SQL.format('l_returnflag')} AS flag FROM lineitem),
o AS (SELECT DISTINCT o_orderkey, lower(o_orderstatus) AS flag FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT event_hash, count(*) AS n FROM k WHERE l_orderkey IN (SELECT o_orderkey FROM o) AND flag IN ('r', 'a') GROUP BY event_hash""")
def semi_computed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed ids of returned lines whose order is known (JON-08, JON-09, FUN-31)."""
    lines = table(spark, sf_dir, "lineitem").withColumn("flag", text.normalize("l_returnflag")).where("flag IN ('r', 'a')")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = lines.join(orders, "l_orderkey", "left_semi")
    return kept.groupBy(text.stable_id("l_orderkey", "l_linenumber").alias("event_hash")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT p_partkey, p_name, p_brand, p_retailprice FROM part), b AS (SELECT p_partkey - 1 AS p_partkey, p_name, p_brand, p_retailprice FROM part),
r AS (SELECT a.p_partkey, 1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)) AS t,
             1 - levenshtein(lower(a.p_brand), lower(b.p_brand)) / greatest(length(a.p_brand), length(b.p_brand)) AS br,
             lower(a.p_name) = lower(b.p_name) AND a.p_brand = b.p_brand AS eq, abs(a.p_retailprice - b.p_retailprice) AS delta FROM a JOIN b USING (p_partkey))
SELECT p_partkey, CASE WHEN eq THEN 'accept' WHEN t < 0.55 AND br < 0.55 THEN 'reject' ELSE 'keep' END AS verdict,
       round(0.5 * t + 0.3 * br + 0.2 * CASE WHEN delta <= 2 THEN 1.0 WHEN delta <= 8 THEN 0.8 WHEN delta <= 20 THEN 0.45 ELSE 0 END, 6) AS confidence FROM r""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part against the one after it: accept, reject or keep, with a confidence (DOM-17, DOM-19, DOM-20,
    FUN-10). Edit ratios stand in for the matching ratio, which SQL lacks."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"), F.lower("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    following = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), *(F.col(c).alias(f"{c}_b") for c in ("name", "brand", "price")))
    both = parts.join(following, "p_partkey")
    title, brand = text.edit_ratio("name", "name_b"), text.edit_ratio("brand", "brand_b")
    equal = (F.col("name") == F.col("name_b")) & (F.col("brand") == F.col("brand_b"))
    verdict = resolve.review_verdict(title, brand, equal, F.lit(False))
    confidence = resolve.identity_confidence(title, brand, F.col("price"), F.col("price_b"))
    return both.select("p_partkey", verdict.alias("verdict"), F.round(confidence, 6).alias("confidence"))


@query("""
WITH a AS (SELECT p_partkey, lower(p_name) AS name, lower(p_brand) AS brand, CASE WHEN p_partkey % 4 > 0 THEN 'US-' || lpad((p_partkey // 3)::VARCHAR, 9, '0') END AS code FROM part),
b AS (SELECT p_partkey - 64 AS p_partkey, name, brand, CASE WHEN p_partkey % 5 > 0 THEN 'us' || lpad(((p_partkey - 64) // 3 + CASE WHEN p_partkey % 7 > 3 THEN 1 ELSE 0 END)::VARCHAR, 9, '0') END AS code FROM a),
r AS (SELECT a.p_partkey, upper(regexp_replace(a.code, '[^A-Za-z0-9]', '', 'g')) AS x, upper(b.code) AS y, a.name = b.name AND a.brand = b.brand AS eq,
  1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS t, 1 - levenshtein(a.brand, b.brand) / greatest(length(a.brand), length(b.brand)) AS s FROM a JOIN b USING (p_partkey))
SELECT p_partkey, CASE WHEN x = y THEN 'code_exact' WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN t >= 0.94 AND s >= 0.7 THEN 'name_exact_code_variant' ELSE 'code_conflict' END ELSE 'name_artist' END AS method,
  round(CASE WHEN x = y THEN 1.0 WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN t >= 0.94 AND s >= 0.7 THEN 0.78 ELSE 0 END ELSE 0.72 * t + 0.28 * s END, 6)::DOUBLE AS confidence,
  CASE WHEN eq AND NOT coalesce(x <> y, false) THEN 'accept' WHEN t < 0.55 AND s < 0.55 THEN 'reject' ELSE 'keep' END AS verdict FROM r""")
def identity_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part against the one 64 places on, with codes that agree, differ or are missing: how sure they are one and by what, and the
    verdict that heeds conflicts of codes (DOM-19, DOM-20, FUN-07). Edit ratios stand in for the matching ratio."""
    key, nine = F.col("p_partkey"), lambda c: F.lpad(c.cast("long").cast("string"), 9, "0")
    parts = table(spark, sf_dir, "part").select(key, F.lower("p_name").alias("name"), F.lower("p_brand").alias("brand"))
    one = parts.withColumn("code", F.when(key % 4 > 0, F.concat(F.lit("US-"), nine(F.floor(key / 3)))))
    later = F.floor((key - 64) / 3) + F.when(key % 7 > 3, 1).otherwise(0)
    other = parts.select((key - 64).alias("p_partkey"), F.col("name").alias("name_b"), F.col("brand").alias("brand_b"), F.when(key % 5 > 0, F.concat(F.lit("us"), nine(later))).alias("code_b"))
    both = one.join(other, "p_partkey")
    title, brand = text.edit_ratio("name", "name_b"), text.edit_ratio("brand", "brand_b")
    score = ranking.identity_score(title, brand, F.col("code"), F.col("code_b"))
    equal = (F.col("name") == F.col("name_b")) & (F.col("brand") == F.col("brand_b"))
    verdict = resolve.review_verdict(title, brand, equal, ranking.code_conflict(F.col("code"), F.col("code_b")))
    return both.select("p_partkey", score["method"].alias("method"), F.round(score["confidence"], 6).alias("confidence"), verdict.alias("verdict"))


@query("""
WITH e AS (SELECT o_orderkey, o_orderstatus = 'F' AS there, CASE WHEN o_totalprice > 200000 THEN o_custkey END AS other FROM orders)
SELECT count(*) FILTER (WHERE there) AS keep, count(*) FILTER (WHERE NOT there AND other IS NOT NULL) AS repair, count(*) FILTER (WHERE NOT there AND other IS NULL) AS "delete",
       count(*) AS entries, count(*) FILTER (WHERE NOT there AND other IS NULL) <= 0.25 * count(*) AS safe FROM e""")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to keep, repair or delete, and whether that is few enough (DOM-23)."""
    entries = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("there"), F.when(F.col("o_totalprice") > 200000, F.col("o_custkey")).alias("other")
    )
    return resolve.repair_plan(entries, "o_orderkey", "there", "other")


@query("""
WITH o AS (SELECT o_custkey, min(o_totalprice) AS low, min(o_orderdate) AS first_at, min(o_orderpriority) AS priority FROM orders GROUP BY 1)
SELECT c_custkey, low, first_at, priority, round(coalesce(low, (SELECT avg(o_totalprice) FROM orders), 284400), 2) AS expected FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def left_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with independent minima of their orders, and a default for those without (JON-02, AGG-07, AGG-08)."""
    orders = table(spark, sf_dir, "orders")
    least = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_totalprice").alias("low"), F.min("o_orderdate").alias("first_at"), F.min("o_orderpriority").alias("priority"))
    mean = orders.agg(F.coalesce(F.avg("o_totalprice"), F.lit(284400.0)).alias("mean"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(least, "c_custkey", "left").crossJoin(F.broadcast(mean))  # one row
    return joined.select("c_custkey", "low", "first_at", "priority", F.round(F.coalesce("low", "mean"), 2).alias("expected"))


@query("""
SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS returned, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS priority
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey
ORDER BY priority, o_orderkey""")
def left_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their returned lines, by status (JON-03, JON-04, JON-07, SRT-01)."""
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    priority = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    joined = orders.join(returned, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("returned"), priority.alias("priority"))
    return joined.orderBy("priority", "o_orderkey")


@query("""
WITH u AS (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer),
x AS (SELECT k FROM u WHERE k NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) AND k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
SELECT k, row_number() OVER (ORDER BY k) - 1 AS place FROM x""")
def double_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two tables less those done and those claimed, numbered from 0 (JON-25, SET-01, SET-05).

    The dense number comes from per-range counts, not from one window over all rows."""
    from lodestar.operators.queue import dense_index

    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    keys = orders.select(F.col("o_custkey").alias("k")).union(customers.select("c_custkey")).distinct()
    done = orders.where("o_orderstatus = 'F' AND o_totalprice > 200000")
    claimed = customers.where("c_acctbal < 0")
    return dense_index(resolve.absent(keys, (done, "o_custkey"), (claimed, "c_custkey"), key="k"), "k", "place")

"""Queries on files: tables of the catalogue are written in a foreign format to a new folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.plans.registry import query
from lodestar.plans.streams import scratch
from lodestar.session import table
from lodestar.sources import archives, payloads, readers, schema, storage

#: Rows of one JSON array or XML document of the written files.
EACH = 2000


def parts_of(rows: DataFrame, *keys: str) -> Column:
    """Deals rows into so many parts that each has about ``EACH``, by a hash of their keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows.count() // EACH)))).cast("int")


def json_array(value: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.collect_list(value), ","), F.lit("]"))


def written(lines: DataFrame, folder: str, by: str | None = None) -> str:
    """A folder with a column of lines as text files: one for each value of ``by``, named by it."""
    if by is None:
        lines.write.text(folder)
    else:
        lines.repartition(by).write.partitionBy(by).text(folder)
    return folder


@query("""
SELECT p_partkey::VARCHAR AS id, p_name AS title, p_brand || ', ' || p_type AS artist_names, p_partkey::VARCHAR || ',' || p_size AS artist_ids, 'album ' || p_size AS album,
       NULL::VARCHAR AS isrc, (p_retailprice * 100)::BIGINT AS duration_ms, 'a, b' AS genres, 'x | y' AS library_sources FROM part""")
def read_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays of parts, read as entities (SRC-03, SET-07)."""
    artist = lambda name, key: F.struct(F.col(key).cast("string").alias("id"), F.col(name).alias("name"))
    sources = F.array(F.lit("x"), F.lit("y"), F.lit("x"))
    entity = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.array(artist("p_brand", "p_partkey"), artist("p_type", "p_size")).alias("artists"),
        F.concat(F.lit("album "), "p_size").alias("album"), F.round(F.col("p_retailprice") * 100).cast("long").alias("duration_ms"),
        F.array(F.lit("a"), F.lit("b")).alias("genres"), sources.alias("sources"),
    )
    parts = table(spark, sf_dir, "part")
    arrays = parts.groupBy(parts_of(parts, "p_partkey").alias("array")).agg(json_array(F.to_json(entity)).alias("value"))
    return readers.catalogue_json(spark, written(arrays, scratch(spark), "array"))


HISTORY_SQL = """
SELECT sha256(concat_ws(chr(0), t, event_type, 'user ' || user_id, (value * 1000)::BIGINT::VARCHAR, 'spotify:track:' || lpad(event_id::VARCHAR, 22, '0'))) AS event_hash,
       t AS played_at, lpad(event_id::VARCHAR, 22, '0') AS id, event_type AS title, 'user ' || user_id AS artist_names, (value * 1000)::BIGINT AS ms_played
FROM (SELECT *, strftime(ts, '%Y-%m-%d %H:%M') AS t FROM events)"""
HISTORY_COLUMNS = ["event_hash", "played_at", "id", "title", "artist_names", "ms_played"]


def history_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and texts of an export: JSON arrays of both dialects, and files that are no history."""
    events = table(spark, sf_dir, "events")
    at, long = F.date_format("ts", "yyyy-MM-dd HH:mm"), F.round(F.col("value") * 1000).cast("long")
    link, who = F.concat(F.lit("spotify:track:"), F.lpad(F.col("event_id").cast("string"), 22, "0")), F.concat(F.lit("user "), "user_id")
    one = F.to_json(F.struct(at.alias("ts"), F.col("event_type").alias("master_metadata_track_name"), who.alias("master_metadata_album_artist_name"), long.alias("ms_played"), link.alias("spotify_track_uri")))
    other = F.to_json(F.struct(at.alias("endTime"), F.col("event_type").alias("trackName"), who.alias("artistName"), long.alias("msPlayed"), link.alias("trackUri")))
    array, long_form = parts_of(events, "event_id"), F.col("event_id") % 2 == 0
    name = F.concat(F.when(long_form, "Endsong_").otherwise("StreamingHistory"), array, F.lit(".json"))
    histories = events.groupBy(name.alias("name")).agg(json_array(F.when(long_form, one).otherwise(other)).alias("text"))
    others = events.groupBy(F.concat(F.lit("Userdata"), array, F.lit(".json")).alias("name")).agg(json_array(one).alias("text"))
    return histories.unionByName(others)


@query(HISTORY_SQL)
def read_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dialects of a history in a tree of JSON files, found by the beginnings of their names (SRC-04, STR-02)."""
    shared = scratch(spark)
    archives.write_archives(history_texts(spark, sf_dir), shared, packed=False)
    trees = [readers.json_tree(spark, shared, readers.HISTORY, prefix) for prefix in ("endsong", "streaminghistory")]
    return readers.play_history(trees[0].unionByName(trees[1])).select(*HISTORY_COLUMNS)


@query(HISTORY_SQL)
def zipped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from ZIP archives, a partition for each member that is a history (SRC-04)."""
    shared = scratch(spark)
    archives.write_archives(history_texts(spark, sf_dir), shared)
    records = archives.archived_records(spark, shared, ("endsong", "streaminghistory"))
    raw = records.select(F.from_json("record", readers.HISTORY).alias("r")).select("r.*")
    return readers.play_history(raw).select(*HISTORY_COLUMNS)


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders)
SELECT sha1('list ' || o_custkey || chr(0) || '2024-01-01') AS playlist_id, 'list ' || o_custkey AS name, position::INT AS position, lpad(o_orderkey::VARCHAR, 22, 'k') AS id, o_orderpriority AS title FROM o""")
def read_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of accounts with their members in place (SRC-05)."""
    orders = table(spark, sf_dir, "orders")
    track = F.struct(F.concat(F.lit("spotify:track:"), F.lpad(F.col("o_orderkey").cast("string"), 22, "k")).alias("trackUri"), F.col("o_orderpriority").alias("trackName"))
    item = F.struct("o_orderkey", F.struct(F.lit("2024-01-01").alias("addedDate"), track.alias("track")).alias("item"))
    lists = orders.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("items"))
    named = F.struct(F.concat(F.lit("list "), "o_custkey").alias("name"), F.lit("2024-01-01").alias("lastModifiedDate"), "items")
    accounts = lists.groupBy(parts_of(orders, "o_custkey").alias("account")).agg(F.to_json(F.struct(F.collect_list(named).alias("playlists"))).alias("value"))
    return readers.account_playlists(spark, written(accounts, scratch(spark), "account")).select("playlist_id", "name", "position", "id", "title")


@query("""
SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 7 > 0 THEN p_retailprice END AS price, p_size::DOUBLE AS size, [lower(p_type)] AS genres FROM part WHERE p_partkey % 3 = 0""")
def read_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with a header: numbers where they are ones, entities of the library alone (SRC-06)."""
    parts, path = table(spark, sf_dir, "part"), scratch(spark)
    price = F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice").cast("string")).otherwise("n/a")
    parts.select(F.col("p_partkey").cast("string").alias("id"), price.alias("price"), F.col("p_size").alias("size"), F.concat(F.lit(" "), "p_type").alias("genre")).write.csv(path, header=True)
    library = parts.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("id"))
    return readers.features_csv(spark, path, library, "id", ["price", "size"], "genre")


@query("""
SELECT o_custkey::VARCHAR AS key, max(o_orderkey)::VARCHAR AS place, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV manifest as a list, and its last row of each key (SRC-07, SRC-08, SNK-13)."""
    path, shared = F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), scratch(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), path.alias("place"))
    none = F.lit(None).cast("string")
    storage.playlist_csv(rows.select(F.col("key").alias("title"), F.col("place").alias("artist_names"), none.alias("album"), none.alias("isrc")), shared)
    listed = readers.manifest(spark, shared, "title")
    last = readers.manifest(spark, shared, "title", "artist").select(F.col("title").alias("key"), F.ltrim(F.col("artist"), F.lit("0")).alias("place"))
    last = last.withColumn("place", F.when(F.col("place") == "", "0").otherwise(F.col("place")))
    return last.join(listed.groupBy(F.col("title").alias("key")).agg(F.count("*").alias("n")), "key")


@query("""
WITH s AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE value > 30 GROUP BY ALL) SELECT user_id, event_type AS stage, event_id, 'success' AS status FROM s""")
def read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, gzipped and plain, broken lines among them: the last success of each stage (SRC-09, SRC-10, SNK-09)."""
    events, shared = table(spark, sf_dir, "events"), scratch(spark)
    status = F.when(F.col("value") > 30, "success").otherwise("failed").alias("status")
    rows = events.select("user_id", F.col("event_type").alias("stage"), "event_id", status)
    storage.append_json_lines(rows.where("event_id % 2 = 0"), shared)
    rows.where("event_id % 2 = 1").write.mode("append").option("compression", "gzip").json(shared)
    events.limit(3).select(F.lit('{"user_id": 1, "stage": ').alias("value")).write.mode("append").text(shared)
    lines = readers.json_lines(spark, f"{shared}/*", "user_id long, stage string, event_id long, status string")
    return payloads.last_successes(lines.drop("line_file"), ["user_id", "stage"], F.col("event_id"))


@query("""
SELECT s_name AS title, 'nation ' || s_nationkey AS artist, '/Volume/' || s_nationkey || '/' || s_suppkey || '.mp3' AS path, round(s_acctbal, 1) AS seconds FROM supplier""")
def read_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an XML collection (SRC-11, FUN-32)."""
    entry = F.format_string(
        '<ENTRY TITLE="%s" ARTIST="nation %d"><LOCATION DIR="/:Volume/:%d/:" FILE="%d.mp3"></LOCATION><INFO PLAYTIME="%.1f"></INFO></ENTRY>',
        "s_name", "s_nationkey", "s_nationkey", "s_suppkey", F.round("s_acctbal", 1),
    )
    suppliers = table(spark, sf_dir, "supplier")
    document = F.concat(F.lit("<NML><COLLECTION>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</COLLECTION></NML>"))
    lines = suppliers.groupBy(parts_of(suppliers, "s_suppkey").alias("collection")).agg(document.alias("value"))
    return readers.collection_xml(spark, written(lines, scratch(spark), "collection")).select("title", "artist", "path", "seconds")


@query("""SELECT DISTINCT '/music/' || l_orderkey || '.flac' AS path FROM lineitem WHERE l_returnflag = 'R'""")
def read_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of an M3U list without its comments, blanks and repeats (SRC-12)."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("  /music/"), "l_orderkey", F.lit(".flac"))).when(F.col("l_linenumber") == 1, "#EXTINF").otherwise(" ").alias("value")
    )
    return readers.playlist_paths(spark, written(lines, scratch(spark)))


@query("""
WITH c AS (SELECT c_nationkey::VARCHAR AS path, c_mktsegment AS comment, count(*) AS n FROM customer GROUP BY ALL),
r AS (SELECT path, comment, row_number() OVER (PARTITION BY path ORDER BY n DESC, comment) AS k FROM c) SELECT path, comment FROM r WHERE k = 1""")
def read_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and comment of each match in the texts, the most frequent comment of each path (SRC-13, AGG-18)."""
    lines = table(spark, sf_dir, "customer").select("c_nationkey", F.format_string('<E DIR="%d" COMMENT="%s">', "c_nationkey", "c_mktsegment").alias("value"))
    path = written(lines.withColumn("part", F.col("c_nationkey") % 5).select("part", "value"), scratch(spark), "part")
    return readers.attribute_pairs(spark, path, r'DIR="([^"]*)" COMMENT="([^"]*)"', ("path", "comment"))


@query("""
SELECT n_regionkey::BIGINT AS region, 1::BIGINT AS files FROM nation WHERE n_regionkey <> 3 GROUP BY 1""")
def walk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder, by suffix, without a pruned folder (SRC-14)."""
    lines = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value"))
    found = readers.files_below(spark, written(lines, scratch(spark), "n_regionkey"), ["txt", ".nml"], ["n_regionkey=3"])
    region = F.regexp_extract("path", r"n_regionkey=(\d+)/", 1).cast("long")
    return found.where("length > 0").groupBy(region.alias("region")).agg(F.count("*").alias("files"))


@query("""
WITH f AS (SELECT '/m/' || (p_partkey % 3) || '/' || p_brand || ' - ' || p_name || '.mp3' AS path, p_brand, p_name, p_partkey FROM part)
SELECT replace(replace(lower(p_brand || p_name), '#', ''), ' ', '') AS name, count(DISTINCT path)::INT AS paths, any_value(p_brand) AS artist, any_value(p_name) AS title, min(CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'none' END) AS tag FROM f GROUP BY 1""")
def name_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by the normal form of their names, names taken apart, and the first present tag (SRC-15, SRC-16)."""
    path = F.concat(F.lit("/m/"), F.col("p_partkey") % 3, F.lit("/"), "p_brand", F.lit(" - "), "p_name", F.lit(".mp3"))
    parts = table(spark, sf_dir, "part").withColumn("path", path)
    tags = F.create_map(F.lit("TIT2"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")), F.lit("title"), F.lit(" "), F.lit("name"), F.lit("none"))
    artist, title = readers.named_file(F.col("path"))
    named = parts.select("path", artist.alias("artist"), title.alias("title"), readers.first_tag(tags, "TIT2", "title", "name").alias("tag"))
    grouped = readers.by_basename(parts.select("path"))
    each = grouped.select("name", F.size("paths").alias("paths"), F.explode("paths").alias("path")).join(named, "path")
    return each.groupBy("name", "paths").agg(F.min("artist").alias("artist"), F.min("title").alias("title"), F.min("tag").alias("tag"))


@query("""SELECT o_custkey AS id, max(o_orderkey) AS best, max(o_orderkey % 4) AS batch FROM orders WHERE o_orderkey % 4 = (SELECT max(p.o_orderkey % 4) FROM orders p WHERE p.o_custkey = orders.o_custkey) GROUP BY 1""")
def read_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON batches, of which a later one overrides the earlier ones (SRC-18)."""
    orders = table(spark, sf_dir, "orders")
    batch = orders.groupBy(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 4).alias("batch")).agg(F.max("o_orderkey").alias("best"))
    rows = batch.select(F.concat(F.lit("b"), "batch", F.lit("-"), parts_of(orders, "id")).alias("file"), F.to_json(F.struct("id", "best", "batch")).alias("value"))
    arrays = rows.groupBy("file").agg(json_array(F.col("value")).alias("value"))
    return readers.merged_batches(spark, written(arrays, scratch(spark), "file"), "id long, best long, batch long", "id").select("id", "best", "batch")


@query("""
SELECT c_custkey AS id, n_name AS value, 'cache' AS source FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey < 10
UNION ALL SELECT c_custkey, NULL, 'fetch' FROM customer WHERE c_nationkey >= 10""")
def cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation a cache knows, and those to fetch; the cache is a table as it is now (SRC-01, SRC-02, SRC-26)."""
    cache = readers.snapshot(spark, f"{sf_dir}/nation.parquet", "nations_now").where("n_nationkey < 10")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    hits, misses = readers.through_cache(rows, cache.select("n_nationkey", F.col("n_name").alias("value")), "n_nationkey")
    return hits.select("id", "value", F.lit("cache").alias("source")).union(misses.select("id", F.lit(None).cast("string"), F.lit("fetch")))


@query("""
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 3 = 2 AND p_size > 25 THEN p_brand END AS album_id,
       CASE WHEN p_partkey % 3 = 2 AND p_size % 2 = 0 THEN p_type WHEN p_partkey % 3 < 2 THEN 'none' END AS label, CASE WHEN p_partkey % 3 = 2 THEN p_size ELSE 0 END AS paused FROM part""")
def migrated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written under three versions of a schema, read as one table: columns that a version added have their default in older
    rows and their own nulls in newer ones (SRC-01)."""
    shared, parts = scratch(spark), table(spark, sf_dir, "part")
    one = parts.select("*", F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    newest = one.withColumn("album_id", F.when(F.col("p_size") > 25, F.col("p_brand"))).withColumn("label", F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    schema.write_version(one.where("p_partkey % 3 = 0").select("id", "title"), shared, 1)
    schema.write_version(one.where("p_partkey % 3 = 1").select("id", "title", F.lit(None).cast("string").alias("album_id")), shared, 2)
    schema.write_version(newest.where("p_partkey % 3 = 2").select("id", "title", "album_id", "label", F.col("p_size").alias("paused")), shared, 3)
    steps = [schema.Step(2, "album_id", "string"), schema.Step(3, "label", "string", "none"), schema.Step(3, "paused", "int", 0)]
    return schema.migrated(spark, shared, "id long, title string", steps)


POLICY_SQL = ", ".join(f"('{s}', '{f}', {r}::DOUBLE, {w}::DOUBLE, '{u}')" for s, f, r, w, u in schema.POLICIES)


@query(f"""
WITH b AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'freqblog' ELSE lower(n_name) END AS source, CASE WHEN n_nationkey % 5 = 0 THEN ['bpm', 'key', 'energy', 'valence', 'mood'][n_nationkey // 5 + 1] ELSE 'bpm' END AS field,
  n_nationkey / 50.0 AS reliability, n_regionkey / 10.0 AS similarity_weight, 'own' AS usage FROM nation),
p(source, field, reliability, similarity_weight, usage) AS (VALUES {POLICY_SQL})
SELECT * FROM b UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.source = p.source AND b.field = p.field)""")
def seeded_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy table that has rows of its own, with the seed rows that it lacks (SRC-01, SNK-03)."""
    key, shared = F.col("n_nationkey"), scratch(spark)
    fields = F.array(*map(F.lit, ["bpm", "key", "energy", "valence", "mood"]))
    own = table(spark, sf_dir, "nation").select(
        F.when(key % 5 == 0, "freqblog").otherwise(F.lower("n_name")).alias("source"), F.when(key % 5 == 0, fields[(key / 5).cast("int")]).otherwise("bpm").alias("field"),
        (key / 50).alias("reliability"), (F.col("n_regionkey") / 10).alias("similarity_weight"),
    )
    schema.write_version(own, shared, 1)
    base = schema.migrated(spark, shared, "source string, field string, reliability double, similarity_weight double", [schema.Step(2, "usage", "string", "own")])
    return schema.seeded(spark, base, schema.POLICIES, schema.POLICY_KEYS)


@query("""
WITH m AS (SELECT o_orderkey AS id, o_custkey % 7 AS artist, o_orderpriority AS playlist FROM orders WHERE NOT regexp_matches(o_orderpriority, '^(4|5)-'))
SELECT id, list_sort([playlist]) AS sources, list_sort(list_distinct(['g' || artist, 'h' || (artist % 2)])) AS genres FROM m""")
def export_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order once, with its lists and its artists' genres; some lists are left out by name (SRC-28)."""
    artist = F.col("o_custkey") % 7
    members = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("t").alias("title"), F.array(artist).alias("artist_ids"), F.col("o_orderpriority").alias("playlist"))
    genres = spark.range(7).select(F.col("id").alias("artist_id"), F.array(F.concat(F.lit("g"), "id"), F.concat(F.lit("h"), F.col("id") % 2)).alias("genres"))
    return readers.library_export(members, genres, "^(4|5)-").select("id", "sources", "genres")


@query("""SELECT vec_id, len(embedding)::INT AS size, true AS close, vec_id % 2 = 0 AS held, 'k' || vec_id AS key FROM embeddings""")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed as half floats and unpacked; a wrong size is refused; keys coded or plain (FUN-30, FUN-36, SRC-27)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.pack_vector("embedding").alias("packed"))
    rows = rows.select("vec_id", "embedding", vectors.unpack_vector("packed").alias("a"), vectors.unpack_text(F.base64("packed")).alias("b"))
    apart = F.transform(F.arrays_zip("embedding", "a", "b"), lambda x: F.greatest(F.abs(x["embedding"] - x["a"]), F.abs(x["embedding"] - x["b"])) <= 0.001 * F.abs(x["embedding"]) + 0.0001)
    size = F.size("embedding")
    held = vectors.of_dimension(F.col("a"), size + F.col("vec_id") % 2).isNotNull()
    plain = F.concat(F.lit("k"), "vec_id")
    coded = F.when(F.col("vec_id") % 3 == 0, F.base64(F.to_json(F.struct(plain.alias("key"))).cast("binary"))).otherwise(plain)
    return rows.select("vec_id", F.size("a").alias("size"), F.forall(apart, lambda x: x).alias("close"), held.alias("held"), vectors.encoded_key(coded).alias("key"))


@query("""
SELECT doc_id, '{"id": ' || doc_id || ', "v": null, "parts": [null, {"n": ' || n_chars || ', "w": null}], "source": "' || source || '"' ||
  CASE WHEN doc_id % 2 = 0 THEN ', "kept": {"encoding": "utf-8", "data": "' || lang || '"}' ELSE '' END || '}' AS payload FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def strip_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of each document without its packed arrays, wherever they stand; other objects stay (PRJ-06)."""
    packed = F.concat(F.lit('{"encoding": "float16+zlib+base64", "data": "'), F.base64(F.encode("source", "UTF-8")), F.lit('", "shape": ['), F.col("n_chars"), F.lit("]}"))
    kept = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(', "kept": {"encoding": "utf-8", "data": "'), "lang", F.lit('"}'))).otherwise("")
    payload = F.concat(F.lit('{"id": '), "doc_id", F.lit(', "v": '), packed, F.lit(', "parts": ['), packed, F.lit(', {"n": '), "n_chars", F.lit(', "w": '), packed, F.lit('}], "source": "'), "source", F.lit('"'), kept, F.lit("}"))
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return docs.select("doc_id", payloads.without_packed(payload).alias("payload"))


@query("""
SELECT 'orders' AS source, count(*)::BIGINT AS rows, 'ok' AS status, 'from ' || min(o_orderkey) || ' to ' || max(o_orderkey) AS detail FROM orders
UNION ALL SELECT 'part', count(*), 'ok', 'from ' || min(p_partkey) || ' to ' || max(p_partkey) FROM part
UNION ALL SELECT 'errors', count(*), CASE WHEN count(*) > 0 THEN 'failed' ELSE 'ok' END, 'of ' || count(DISTINCT user_id) || ' users' FROM events WHERE event_type = 'error'""")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run over a table: what it counted, and how it went (SNK-20)."""
    path = f"{scratch(spark)}/runs"
    for name, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
        seen = table(spark, sf_dir, name).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).first()
        storage.record_run(spark, path, name, seen["n"], "ok", f"from {seen['a']} to {seen['b']}")
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).first()
    storage.record_run(spark, path, "errors", failed["n"], "failed" if failed["n"] else "ok", f"of {failed['users']} users")
    return spark.read.parquet(path).select("source", "rows", "status", "detail")


@query("""SELECT o_custkey AS id, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def archived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows archived twice as gzipped JSON lines; the last complete archive is read (SNK-10, SNK-11)."""
    orders, path = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus"), scratch(spark)
    storage.archive(orders, path)
    storage.archive(orders.where("o_orderstatus = 'F'"), path)
    return storage.latest_archive(spark, path, "id long, o_orderstatus string").groupBy("id").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT c_mktsegment AS segment, count(*) AS people, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1)
SELECT segment, people, balance, unnest(['csv', 'json', 'markdown']) AS form FROM s""")
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report in three forms, read back (SNK-12)."""
    path = scratch(spark)
    measures = {"people": F.count("*"), "balance": F.round(F.sum("c_acctbal"), 2)}
    storage.report(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "segment"), ["segment"], measures, path)
    shape = "segment string, people long, balance double"
    csv = spark.read.schema(shape).csv(f"{path}/csv", header=True).withColumn("form", F.lit("csv"))
    json = spark.read.schema(shape).json(f"{path}/json").withColumn("form", F.lit("json"))
    cells = F.split("value", r" \| |^\| | \|$")
    lines = spark.read.text(f"{path}/markdown").select(cells[1].alias("segment"), cells[2].cast("long").alias("people"), cells[3].cast("double").alias("balance"), F.lit("markdown").alias("form"))
    return csv.unionByName(json).unionByName(lines)

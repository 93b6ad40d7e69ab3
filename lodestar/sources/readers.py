"""Readers (SRC-01 to SRC-16, SRC-18, SRC-26, SRC-28). Every path goes through Spark's own readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import entity_id, normalize, stable_id

CATALOGUE = "id string, title string, artists array<struct<id: string, name: string>>, album string, isrc string, duration_ms long, genres array<string>, sources array<string>"
HISTORY = (
    "ts string, endTime string, ms_played long, msPlayed long, spotify_track_uri string, trackUri string, master_metadata_track_name string, trackName string, "
    "master_metadata_album_artist_name string, artistName string, skipped boolean, offline boolean, shuffle boolean, platform string"
)
ACCOUNT = "playlists array<struct<name: string, lastModifiedDate: string, items array<struct<addedDate: string, track: struct<trackUri: string, trackName: string, artistName: string, albumName: string>>>>>"


def snapshot(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """A table as it is now (SRC-01, SRC-02); files are never changed in place, so readers need no lock."""
    df = spark.read.parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def catalogue_json(spark: SparkSession, path: str) -> DataFrame:
    """Entities from a JSON array: artists joined by commas, sources distinct and in order (SRC-03, SET-07)."""
    raw = spark.read.schema(CATALOGUE).json(path, multiLine=True)
    return raw.select(
        "id", "title",
        F.array_join(F.transform("artists", lambda a: a["name"]), ", ").alias("artist_names"),
        F.array_join(F.transform("artists", lambda a: a["id"]), ",").alias("artist_ids"),
        "album", "isrc", "duration_ms",
        F.array_join("genres", ", ").alias("genres"),
        F.array_join(F.array_distinct("sources"), " | ").alias("library_sources"),
    )


def json_tree(spark: SparkSession, path: str, schema: str, prefix: str = "") -> DataFrame:
    """JSON files below a folder whose names begin so, in whatever case (SRC-04); archives are ``archives.archived_records``."""
    reader = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in prefix)
    return reader.option("pathGlobFilter", f"{either}*.json").json(path)


def play_history(raw: DataFrame) -> DataFrame:
    """Both dialects of an exported history as events with a hash for a name (SRC-04, STR-02, FUN-31)."""
    at, title = F.coalesce("ts", "endTime"), F.coalesce("master_metadata_track_name", "trackName")
    artist, played = F.coalesce("master_metadata_album_artist_name", "artistName"), F.coalesce("ms_played", "msPlayed")
    link = F.coalesce("spotify_track_uri", "trackUri")
    return raw.where(at.isNotNull()).select(
        stable_id(at, title, artist, played, link).alias("event_hash"),
        at.alias("played_at"), entity_id(link).alias("id"), title.alias("title"), artist.alias("artist_names"), played.alias("ms_played"),
        "skipped", "offline", "shuffle", "platform",
    )


def account_playlists(spark: SparkSession, path: str) -> DataFrame:
    """Lists of an account with their members in place; a list without an id gets one from its name and date (SRC-05)."""
    raw = spark.read.schema(ACCOUNT).json(path, multiLine=True)
    lists = raw.select(F.inline("playlists"))
    named = lists.withColumn("playlist_id", F.sha1(F.concat_ws("\0", "name", "lastModifiedDate")))
    members = named.select("playlist_id", "name", F.posexplode_outer("items").alias("position", "item"))
    return members.select(
        "playlist_id", "name", "position", F.col("item.addedDate").alias("added_at"), entity_id("item.track.trackUri").alias("id"),
        F.col("item.track.trackName").alias("title"), F.col("item.track.artistName").alias("artist_names"),
    )


def features_csv(spark: SparkSession, path: str, library: DataFrame, id_col: str, numbers: Sequence[str], genre: str | None = None) -> DataFrame:
    """First row of each entity of the library, numbers cast where they are ones, genres gathered (SRC-06, JON-08).

    First: the one with the smallest row text, as files have no order across readers."""
    rows = spark.read.csv(path, header=True).join(library.select(id_col), id_col, "left_semi")
    row_text = F.concat_ws("\0", *(F.coalesce(F.col(c), F.lit("")) for c in rows.columns))
    first = [F.min_by(F.col(n).try_cast("double"), row_text).alias(n) for n in numbers]
    genres = [F.array_sort(F.collect_set(F.lower(F.trim(genre)))).alias("genres")] if genre else []
    return rows.groupBy(id_col).agg(*first, *genres)


def manifest(spark: SparkSession, path: str, key: str, order: str | None = None) -> DataFrame:
    """A CSV manifest (SRC-08), one row for each key if asked: the one that is last by ``order`` (SRC-07)."""
    rows = spark.read.csv(path, header=True)
    if order is None:
        return rows
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(key, "r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzipped by their name; broken lines are dropped (SRC-09, SRC-10). ``line_file`` names the
    file, for an order between files."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("line_file", F.input_file_name())


def collection_xml(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an XML collection (SRC-11): title, artist, path, seconds, bit rate."""
    place = "struct<_DIR: string, _FILE: string, _VOLUME: string>"
    schema = f"_TITLE string, _ARTIST string, LOCATION {place}, ALBUM struct<_TITLE: string>, INFO struct<_PLAYTIME: double, _BITRATE: long>"
    raw = spark.read.format("xml").option("rowTag", "ENTRY").schema(schema).load(path)
    folder = F.regexp_replace("LOCATION._DIR", "/:", "/")
    return raw.select(
        F.col("_TITLE").alias("title"), F.col("_ARTIST").alias("artist"), F.col("ALBUM._TITLE").alias("album"),
        F.concat(folder, F.col("LOCATION._FILE")).alias("path"), F.col("INFO._PLAYTIME").alias("seconds"), F.col("INFO._BITRATE").alias("bitrate"),
    )


def playlist_paths(spark: SparkSession, path: str) -> DataFrame:
    """Distinct paths of an M3U file (SRC-12)."""
    lines = spark.read.text(path).select(F.trim("value").alias("path"))
    return lines.where((F.col("path") != "") & ~F.col("path").startswith("#")).distinct()


def attribute_pairs(spark: SparkSession, path: str, pattern: str, names: tuple[str, str]) -> DataFrame:
    """Two captured groups of each match in a text, the most frequent second for each first (SRC-13, AGG-18).

    Ties go to the smaller text; of a text and its own beginning the longer one."""
    text = spark.read.text(path, wholetext=True)
    a, b = names
    found = [F.regexp_extract_all("value", F.lit(pattern), k) for k in (1, 2)]
    pairs = text.select(F.inline(F.zip_with(*found, lambda x, y: F.struct(x.alias(a), y.alias(b)))))
    counts = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    # A terminator that sorts after every character puts a text behind the longer ones that begin with it.
    order = F.struct(-F.col("n"), F.concat(F.col(b), F.lit("\U0010ffff")))
    return counts.groupBy(a).agg(F.min_by(b, order).alias(b))


def files_below(spark: SparkSession, path: str, suffixes: Sequence[str], pruned: Sequence[str] = ()) -> DataFrame:
    """Path, size and time of files with these suffixes (SRC-14); contents are not read. Folders named in ``pruned``
    are left out."""
    glob = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    out = files.select("path", "length", "modificationTime")
    for name in pruned:
        out = out.where(~F.contains("path", F.lit(f"/{name}/")))
    return out


def by_basename(files: DataFrame, path: str = "path") -> DataFrame:
    """Normal form of a file's name, and the paths that have it (SRC-15)."""
    name = normalize(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), "compact")
    return files.groupBy(name.alias("name")).agg(F.array_sort(F.collect_set(path)).alias("paths"))


def first_tag(tags: Column, *keys: str) -> Column:
    """The first present value among several keys of a tag map (SRC-16)."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(tags, F.lit(k))), F.lit("")) for k in keys))


def named_file(path: Column) -> tuple[Column, Column]:
    """Artist and title from a file named ``artist - title`` (SRC-16); the title alone otherwise."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    parts = F.split(name, " - ", 2)
    return F.when(F.size(parts) == 2, F.trim(parts[0])), F.trim(F.element_at(parts, -1))


def merged_batches(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON batches of which later files override earlier ones (SRC-18)."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("__file", F.input_file_name())
    rest = [c for c in rows.columns if c not in (key, "__file")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "__file").alias("r")).select(key, "r.*")


def through_cache(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows that the cache knows, with what it knows; and the others (SRC-26)."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def library_export(members: DataFrame, artist_genres: DataFrame, excluded: str) -> DataFrame:
    """Each entity once with its lists and its artists' genres; lists whose names match are left out (SRC-28).

    ``members``: id, title, ``artist_ids`` (array), ``playlist``; ``artist_genres``: artist_id, ``genres`` (array)."""
    kept = members.where(~F.col("playlist").rlike(excluded))
    lists = kept.groupBy("id").agg(F.min("title").alias("title"), F.array_sort(F.collect_set("playlist")).alias("sources"))
    artists = kept.select("id", F.explode("artist_ids").alias("artist_id")).distinct().join(artist_genres, "artist_id")
    genres = artists.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("genres")))).alias("genres"))
    none = F.array().cast(T.ArrayType(T.StringType()))
    return lists.join(genres, "id", "left").withColumn("genres", F.coalesce("genres", none))

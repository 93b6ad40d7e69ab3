"""Readers and writers on small local files."""

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.sources import archives, payloads, readers, storage
from lodestar.streaming import incremental


def test_catalogue_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "title": "T", "artists": [{"id": "a", "name": "A"}, {"id": "b", "name": "B"}], "genres": ["x"], "sources": ["l", "m", "l"]}]))
    got = readers.catalogue_json(spark, str(tmp_path / "c.json")).first()
    assert (got.artist_names, got.artist_ids, got.library_sources) == ("A, B", "a,b", "l | m")


def test_histories_in_archives_and_folders(spark, tmp_path):
    new = {"ts": "2024-01-01", "ms_played": 5, "master_metadata_track_name": "T", "skipped": False}
    old = [{"endTime": "2024-01-02 10:00", "msPlayed": i, "trackName": "ü"} for i in range(2500)]
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep/h.ZIP", "w") as z:
        z.writestr("x/Streaming_1.json", "\ufeff" + json.dumps([new]))
        z.writestr("x/Other.json", json.dumps([new]))
        z.writestr("streaming_2.json", json.dumps(old, indent=1))
        z.writestr("streaming_3.txt", "no JSON")
    (tmp_path / "STREAMING_4.json").write_text(json.dumps([new, new]))
    records = archives.archived_records(spark, str(tmp_path), ("streaming", "endsong"))
    assert records.rdd.getNumPartitions() == 3
    assert {(r.member, r.n, r.last) for r in records.groupBy("member").agg(F.count("*").alias("n"), F.max("position").alias("last")).collect()} == {
        ("x/Streaming_1.json", 1, 0), ("streaming_2.json", 2500, 2499), ("STREAMING_4.json", 2, 1)
    }
    raw = records.select(F.from_json("record", readers.HISTORY).alias("r")).select("r.*")
    events = readers.play_history(raw).collect()
    assert len(events) == 2503 and all(len(e.event_hash) == 64 for e in events) and sorted(e.ms_played for e in events if e.title == "ü") == list(range(2500))
    assert readers.json_tree(spark, str(tmp_path), readers.HISTORY, "streaming").count() == 2
    assert archives.archived_records(spark, f"{tmp_path}/nowhere").collect() == []


def test_written_archives_are_read_again(spark, tmp_path):
    texts = spark.createDataFrame([(f"a{i}.json", json.dumps([{"i": i}, {"i": -i}])) for i in range(6)], "name string, text string").repartition(3)
    for packed in (True, False):
        path = f"{tmp_path}/{packed}"
        archives.write_archives(texts, path, packed)
        found = archives.archived_records(spark, path, ("a",)).select(F.from_json("record", "i long")["i"].alias("i")).collect()
        assert sorted(r.i for r in found) == sorted([i for i in range(6)] + [-i for i in range(6)])
    assert {p.suffix for p in (tmp_path / "True").iterdir()} == {".zip"}


@pytest.mark.parametrize("part", (1, 2, 3, 7, 64, 4096))
def test_elements_of_an_array_in_small_parts(part):
    values = [1, 12345, -0.5e-7, "a,]b\\", "\"", [], {}, [1, [2, {"x": "]"}]], {"k": {"l": [None, True]}}, "漢字" * 40, None, False]
    for text in (json.dumps(values), json.dumps(values, indent=2, ensure_ascii=False), " [ " + " , ".join(map(json.dumps, values)) + " ] \n"):
        assert [json.loads(e) for e in archives.elements(io.StringIO(text), part)] == values
    for text, want in (("[]", []), ("", []), (" [ ] ", []), ('{"a": 1}', [{"a": 1}]), ("17", [17])):
        assert [json.loads(e) for e in archives.elements(io.StringIO(text), part)] == want
    for broken in ("[1, 2", '[{"a": 1', "[1 2]", '["abc', "[1, "):
        with pytest.raises(ValueError):
            list(archives.elements(io.StringIO(broken), part))


def test_account_playlists(spark, tmp_path):
    track = {"trackUri": "x:track:" + "a" * 22, "trackName": "T", "artistName": "A", "albumName": "B"}
    (tmp_path / "p.json").write_text(json.dumps({"playlists": [{"name": "N", "lastModifiedDate": "d", "items": [{"addedDate": "e", "track": track}, {"addedDate": "f", "track": track}]}]}))
    rows = readers.account_playlists(spark, str(tmp_path / "p.json")).orderBy("position").collect()
    assert [r.position for r in rows] == [0, 1] and rows[0].id == "a" * 22


def test_csv_features_and_manifest(spark, tmp_path):
    (tmp_path / "f.csv").write_text("id,tempo,genre\n1,120,Rock\n1,oops,Pop\n2,90,x\n")
    library = spark.createDataFrame([("1",)], "id string")
    got = readers.features_csv(spark, str(tmp_path / "f.csv"), library, "id", ["tempo"], "genre").collect()
    assert len(got) == 1 and got[0].tempo == 120 and got[0].genres == ["pop", "rock"]
    assert {r.id: r.tempo for r in readers.manifest(spark, str(tmp_path / "f.csv"), "id", "genre").collect()} == {"1": "120", "2": "90"}


def test_json_lines_plain_gzipped_and_broken(spark, tmp_path):
    good = {"id": "1", "stage": "s", "status": "success", "n": 1}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n{broken\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps(good | {"n": 2}) + "\n" + json.dumps(good | {"status": "failed", "n": 3}) + "\n")
    rows = readers.json_lines(spark, str(tmp_path / "*.jsonl*"), "id string, stage string, status string, n long")
    last = payloads.last_successes(rows, ["id", "stage"], F.struct("line_file", "n")).collect()
    assert [r.n for r in last] == [2]


def test_xml_collection_and_playlist(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<NML><ENTRY TITLE="T" ARTIST="A"><LOCATION DIR="/:m/:n/:" FILE="f.mp3" VOLUME="v"/><INFO PLAYTIME="200" BITRATE="320"/></ENTRY></NML>')
    got = readers.collection_xml(spark, str(tmp_path / "c.xml")).first()
    assert (got.title, got.path, got.seconds) == ("T", "/m/n/f.mp3", 200)
    (tmp_path / "m.m3u").write_text("#EXTM3U\n a.mp3 \n\na.mp3\nb.mp3\n")
    assert sorted(r.path for r in readers.playlist_paths(spark, str(tmp_path / "m.m3u")).collect()) == ["a.mp3", "b.mp3"]


def test_majority_pairs(spark, tmp_path):
    (tmp_path / "t.nml").write_text('p="x" c="one"\np="x" c="one"\np="x" c="two"\np="y" c="ab"\np="y" c="abc"\n')
    got = {r.path: r.comment for r in readers.attribute_pairs(spark, str(tmp_path / "t.nml"), 'p="([^"]*)" c="([^"]*)"', ("path", "comment")).collect()}
    assert got == {"x": "one", "y": "abc"}


def test_files_and_names(spark, tmp_path):
    (tmp_path / "skip").mkdir()
    for name in ("A - B.mp3", "c.flac", "skip/d.mp3", "e.txt"):
        (tmp_path / name).write_text("x")
    files = readers.files_below(spark, str(tmp_path), [".mp3", ".flac"], ["skip"])
    artist, title = readers.named_file(F.col("path"))
    assert sorted((r.a, r.t) for r in files.select(F.coalesce(artist, F.lit("")).alias("a"), title.alias("t")).collect()) == [("", "c"), ("A", "B")]
    assert {r.name for r in readers.by_basename(files).collect()} == {"ab", "c"}


def test_later_batches_override(spark, tmp_path):
    (tmp_path / "b1.json").write_text(json.dumps([{"k": "1", "v": "old"}, {"k": "2", "v": "two"}]))
    (tmp_path / "b2.json").write_text(json.dumps([{"k": "1", "v": "new"}]))
    assert {r.k: r.v for r in readers.merged_batches(spark, str(tmp_path / "b*.json"), "k string, v string", "k").collect()} == {"1": "new", "2": "two"}


def test_cache_and_export(spark):
    known, rest = readers.through_cache(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int"), "k")
    assert known.collect()[0].v == 1 and [r.k for r in rest.collect()] == ["b"]
    members = spark.createDataFrame([("1", "T", ["x"], "Liked"), ("1", "T", ["x"], "Tmp 1"), ("2", "U", ["z"], "Mix")], "id string, title string, artist_ids array<string>, playlist string")
    genres = spark.createDataFrame([("x", ["g", "f"])], "artist_id string, genres array<string>")
    got = {r.id: (r.sources, r.genres) for r in readers.library_export(members, genres, "^Tmp").collect()}
    assert got == {"1": (["Liked"], ["f", "g"]), "2": (["Mix"], [])}


def test_payload_attributes(spark):
    df = spark.createDataFrame([(1, '{"a": 1.5, "b": true, "c": "x", "d": {"e": 1}, "f": null}'), (2, "oops"), (3, None)], "id int, p string")
    got = {r.attribute: (r.value_text, r.value_num, r.value_json) for r in payloads.attribute_rows(df, "id", "p").collect()}
    assert got == {"a": (None, 1.5, None), "b": (None, 1.0, None), "c": ("x", None, None), "d": (None, None, '{"e":1}')}
    packed = '{"x": {"encoding": "float16+zlib+base64", "data": "abc"}, "y": 2}'
    assert spark.range(1).select(payloads.without_packed(F.lit(packed)).alias("p")).first().p == '{"x": null, "y": 2}'


def test_exports_and_lineage(spark, tmp_path):
    df = spark.createDataFrame([("T", "A", "B", "I", 3)], "title string, artist_names string, album string, isrc string, n int")
    storage.playlist_csv(df, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["title", "artist", "album", "isrc"]
    storage.archive(df, f"file://{tmp_path}/gz")
    storage.append_json_lines(df, storage.archive(df, f"file://{tmp_path}/gz"))
    (tmp_path / "gz" / "9").mkdir()  # one that never was completed
    assert storage.latest_archive(spark, f"file://{tmp_path}/gz", "title string").count() == 2
    storage.record_run(spark, f"{tmp_path}/runs", "s", 3, "ok")
    storage.record_run(spark, f"{tmp_path}/runs", "s", 4, "ok")
    assert spark.read.parquet(f"{tmp_path}/runs").agg(F.sum("rows")).first()[0] == 7
    storage.report(df, ["title"], {"total": F.sum("n")}, f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report/markdown").first().value == "| T | 3 |"


def test_retraction(spark):
    matches = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "id int, apart double")
    derived = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string")
    kept, rest = incremental.retracted(matches, derived, "id", F.col("apart") > 10)
    assert sorted(r.id for r in kept.collect()) == [1, 3] and [r.id for r in rest.collect()] == [1]

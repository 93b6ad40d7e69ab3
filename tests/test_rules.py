"""Domain rules on small literal frames, with expectations worked out by hand."""

import base64
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import music, scores, text, vectors
from lodestar.operators import derive, fusion, queue, resolve, similarity, stats, timeline


def values(spark, rows, schema, **columns):
    """One list for each named expression."""
    got = spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()
    return {n: [r[n] for r in got] for n in columns}


def test_tempo_distance(spark):
    got = values(spark, [(120.0, 125.0), (174.0, 87.0), (120.0, 60.0), (100.0, 180.0)], "a double, b double", d=music.tempo_distance(F.col("a"), F.col("b")))
    assert got["d"] == pytest.approx([0.2, 0, 0, 0.8])


def test_harmonic_distance_and_key_score(spark):
    rows = [("A-Minor", "A-Minor"), ("A-Minor", "C-Major"), ("A-Minor", "E-Minor"), ("A-Minor", "F#-Major"), ("zzz", "zzz"), ("zzz", None)]
    got = values(spark, rows, "a string, b string", d=music.harmonic_distance("a", "b"), s=music.key_score("a", "b"))
    assert got["d"] == [0, 0.18, 0.25, 1, 0, 1]
    assert got["s"] == [1, 0.6, 0.6, 0, None, None]


def test_wheel_neighbours_wrap(spark):
    assert values(spark, [("Db minor", "Ab minor")], "a string, b string", s=music.key_score("a", "b"), c=music.camelot("a")) == {"s": [0.6], "c": ["12A"]}


def test_duration_score(spark):
    got = values(spark, [(200.0, 201.5), (200.0, 207.0), (200.0, 215.0), (200.0, 230.0), (None, 3.0), (0.0, 3.0)], "a double, b double", s=scores.duration_score(F.col("a"), F.col("b")))
    assert got["s"] == [1, 0.8, 0.45, 0, 0.5, 0.5]


def test_weighted_jaccard_of_maps(spark):
    rows = [({"x": 1.0, "y": 0.5}, {"x": 0.5, "z": 1.0}), ({}, {})]
    got = values(spark, rows, "a map<string,double>, b map<string,double>", j=scores.weighted_jaccard(F.col("a"), F.col("b")))
    assert got["j"] == pytest.approx([0.2, 0])


def test_z_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 3.0, None)], "id int, v double, c double")
    z = {r["id"]: (r["z_v"], r["z_c"]) for r in stats.with_z_scores(df, ["v", "c"]).collect()}
    assert [z[i][0] for i in (1, 2, 3)] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert (z[1][1], z[3][1]) == (0, None)


def test_noisy_or_band_and_idf(spark):
    got = values(spark, [(0.5, 0.6)], "a double, b double", n=scores.noisy_or(F.col("a"), F.col("b")))
    assert got["n"] == pytest.approx([0.8])
    assert values(spark, [(0.2,), (0.33,), (66.0,), (None,)], "v double", b=scores.band(F.col("v")))["b"] == ["Low", "Medium", "High", ""]


def test_trust_rank_takes_the_longest_prefix(spark):
    ranks = {"audio-full:consensus": 0, "audio-full:": 2, "freqblog:tag:": 6}
    rows = [("audio-full:consensus-v2",), ("audio-full:maest-v2",), ("freqblog:tag:x",), ("other",), (None,)]
    assert values(spark, rows, "s string", r=scores.trust_rank(F.col("s"), ranks))["r"] == [0, 2, 6, 9, 9]


def test_song_keys_and_titles(spark):
    got = values(spark, [("Samsara - Extended Mix", "Tube, X")], "t string, a string", k=text.song_key("t", "a"))
    assert got["k"] == ["samsara|tube"]
    assert values(spark, [("Song (Radio Edit) 2019",)], "t string", c=text.canonical_title("t"))["c"] == ["song"]


def test_english_letters(spark):
    assert values(spark, [("tanečná",), ("electronic",), ("½ time",)], "t string", e=text.english_letters("t"))["e"] == [False, True, True]


def test_exact_fold_and_ratio(spark):
    got = values(spark, [("Ｆｕｌｌ Ｗidth & Ñandú", "abcd", "bcde")], "t string, a string, b string", f=text.nfkd_fold("t"), r=text.matching_ratio("a", "b"))
    assert got["f"] == ["full width and nandu"] and got["r"] == pytest.approx([0.75])


def test_split_terms(spark):
    got = values(spark, [('["A","b ","a"]',), ("X / y; x|z",), (None,)], "t string", s=text.split_terms("t"))
    assert got["s"] == [["a", "b"], ["x", "y", "z"], None]


def test_packed_vectors(spark):
    blob = zlib.compress(np.array([1, 0.5, -2], "<f2").tobytes())
    rows = [(blob, base64.b64encode(blob).decode()), (None, None)]
    df = spark.createDataFrame(rows, "b binary, t string").select(vectors.unpack_vector("b").alias("v"), vectors.unpack_text("t").alias("w"))
    assert [(r.v, r.w) for r in df.collect()] == [([1, 0.5, -2], [1, 0.5, -2]), (None, None)]


def test_encoded_key(spark):
    coded = base64.b64encode(json.dumps({"key": "8A"}).encode()).decode()
    assert values(spark, [(coded,), ("8A",), ("not base64!",)], "t string", k=vectors.encoded_key(F.col("t")))["k"] == ["8A", "8A", "not base64!"]


def test_evenly_spaced_and_tiles(spark):
    got = values(spark, [(10, 4), (10, 3), (2, 4), (5, 1)], "n int, k int", e=timeline.evenly_spaced(F.col("n"), F.col("k")))
    assert got["e"] == [[0, 3, 6, 9], [0, 4, 9], [0, 1], [0]]
    assert values(spark, [(100,), (30,)], "n int", t=timeline.tile_starts(F.col("n"), 45, 40))["t"] == [[0, 40, 55], [0]]


def test_mode_share_and_ties(spark):
    rows = [("p", x) for x in "aaabc"] + [("q", x) for x in "aabc"] + [("r", x) for x in "bbaa"]
    got = {r.k: (r.mode, r.share, r.verdict) for r in stats.mode_share(spark.createDataFrame(rows, "k string, v string").withColumnRenamed("v", "mode_of"), ["k"], "mode_of").collect()}
    assert got["p"] == ("a", 0.6, "a") and got["q"][2] == "mixed_or_variable" and got["r"][0] == "a"


def test_mood_rules(spark):
    rows = [(0.8, 0.75, 0.8, None, None), (None, 0.9, None, None, None)]
    columns = [F.col(c) for c in "evdai"]
    got = values(spark, rows, "e double, v double, d double, a double, i double", m=scores.mood_rules(*columns))
    assert [m.tag for m in got["m"][0]] == ["energetic", "joyful", "uplifting", "euphoric", "party"] and got["m"][1] == []


def test_rhythm_conflict(spark):
    pattern, confidence = derive.rhythm_pattern(F.col("a"), F.col("b"))
    got = values(spark, [(0.70, 0.60), (0.9, 0.2), (0.0, 0.4), (0.0, 0.0)], "a double, b double", p=pattern, c=confidence)
    assert got["p"] == ["mixed_or_variable", "steady_four_on_floor", "broken_beat", "unknown"]
    assert got["c"] == pytest.approx([0.434, 0.9, 0.4, 0])


def test_review_flag(spark):
    columns = [F.col(c) for c in ("delta", "ka", "kb", "ea", "eb")]
    got = values(spark, [(0.0, "a", "A", 0.5, 0.75), (0.0, "a", "a", 0.5, 0.76), (None, None, "a", None, 0.1)], "delta double, ka string, kb string, ea double, eb double", r=music.needs_review(*columns))
    assert got["r"] == [0, 1, 0]


def test_least_and_greatest_with_nulls(spark):
    got = values(spark, [(1.0, None), (1.0, 2.0)], "a double, b double", x=scores.strict_max(F.col("a"), F.col("b")), y=scores.strict_min(F.col("a"), F.col("b")))
    assert got == {"x": [None, 2], "y": [None, 1]}


def test_preferred_value_with_ties_nulls_and_unlisted_sources(spark):
    rows = [("a", "s1", 5.0, None), ("a", "s2", 6.0, 0.0), ("a", "s9", 9.0, 1.0), ("b", "s9", 1.0, 0.5), ("b", "s8", 2.0, 0.5)]
    df = spark.createDataFrame(rows, "id string, source string, value double, confidence double")
    order = [fusion.rank_of("source", {"s1": 1, "s2": 1}, 9), fusion.descending(F.coalesce("confidence", F.lit(0.0))), F.col("source")]
    assert {r.id: r.source for r in fusion.preferred(df, ["id"], order).collect()} == {"a": "s1", "b": "s8"}


def test_consensus_keeps_the_floor_without_confidences(spark):
    rows = [("e", "x", "m", None), ("e", "x", "o", None), ("e", "y", "m", 0.9), ("e", "z", "o", 0.9), ("e", "z", "q", 0.2)]
    df = spark.createDataFrame(rows, "id string, tag string, source string, confidence double")
    got = {r.tag: (r.sources, r.confidence) for r in derive.consensus_sources(df, "id", "tag", "source", ["m"]).collect()}
    assert got == {"x": (2, 0.7)}


def test_interpreted_pools_kinds_before_choosing(spark):
    rows = [("e", "weak", "mood", "provider", 0.9), ("e", "strong", "mood_candidate", "own:x", 0.4), ("e", "tanečná", "mood", "own:x", 1.0)]
    df = spark.createDataFrame(rows, "id string, tag string, kind string, source string, confidence double")
    got = derive.interpreted(df, "id", "tag", "kind", "source", {"Mood": ["mood", "mood_candidate"], "Genre": ["genre"]}, {"own:": 1}).first()
    assert (got.Mood, got.Genre) == ("strong", "")


def test_margin_rule(spark):
    rows = [(1, "a", 0.90), (1, "b", 0.85), (2, "a", 0.96), (2, "b", 0.95), (3, "a", 0.83), (4, "a", 0.5)]
    df = spark.createDataFrame(rows, "id int, other string, s double")
    got = {r.id: r.accepted for r in resolve.match_with_margin(df, "id", "other", F.col("s")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_matching_cascade(spark):
    files = spark.createDataFrame([(1,), (2,), (3,)], "f int")
    by_id = spark.createDataFrame([(1, "x")], "f int, id string")
    fuzzy = spark.createDataFrame([(1, "y", 0.9), (2, "z", 0.85)], "f int, id string, confidence double")
    got = {r.f: (r.id, r.method, r.confidence) for r in resolve.cascade(files, [("name", by_id, 1.0), ("fuzzy", fuzzy, None)], "f", "id").collect()}
    assert got == {1: ("x", "name", 1.0), 2: ("z", "fuzzy", 0.85), 3: (None, "unmatched", 0.0)}


def test_protected_states(spark):
    base = spark.createDataFrame([(1, "downloading", "p"), (2, "waiting", None), (3, "done", "q")], "id int, state string, path string")
    new = spark.createDataFrame([(1, "needs", None), (2, "needs", "r"), (4, "needs", None)], "id int, state string, path string")
    got = {r.id: (r.state, r.path) for r in queue.merge_states(base, new, "id", "state", ["downloading"], "needs").collect()}
    assert got == {1: ("downloading", "p"), 2: ("needs", "r"), 3: ("done", "q"), 4: ("needs", None)}


def test_signature_change_resets_status(spark):
    base = spark.createDataFrame([(1, 10, "done"), (2, 10, "done"), (3, None, "done")], "id int, size int, status string")
    new = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 5)], "id int, size int")
    got = {r.id: (r["size"], r.status) for r in queue.reset_if_changed(base, new, "id", ["size"], "status", "pending").collect()}
    assert got == {1: (10, "done"), 2: (11, "pending"), 3: (None, "done"), 4: (5, "pending")}


# age, minutes since results, since the status, whether its name is known and its runner there
LIVENESS = [
    (300, 1, 1, True, True, "kill"), (30, 30, 99, True, False, "kill"), (10, 10, 99, True, False, "working"), (60, 60, 5, True, True, "working"),
    (40, 2000, 99, True, True, "working"), (60, 10, 99, True, True, "working"), (60, 50, 99, True, True, "kill"), (5, 5, 5, False, True, "kill"),
]


def test_liveness(spark):
    verdict = queue.liveness(*(F.col(c) for c in ("known", "owned", "age", "idle", "status_idle")))
    got = values(spark, [r[:5] for r in LIVENESS], "age int, idle int, status_idle int, known boolean, owned boolean", v=verdict)
    assert got["v"] == [r[5] for r in LIVENESS]


def test_acquisition_states(spark):
    rows = [("p", True, False, False, False), ("p", False, False, False, False), (None, False, True, True, True), (None, False, False, True, False), (None, False, False, True, True), (None, False, False, False, False)]
    got = values(spark, rows, "path string, ok boolean, there boolean, any boolean, missing boolean", s=queue.acquisition_state(*(F.col(c) for c in ("path", "ok", "there", "any", "missing"))))
    assert [s.acquisition for s in got["s"]] == ["complete", "verify_local", "locate_existing", "locate_existing", "needs_source", "needs_source"]


def test_edits_are_limited_to_listed_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    with pytest.raises(ValueError):
        queue.edit_cells(df, "id", [1], "id", F.lit(2), ["t"])


def test_fused_group_weight_is_shared(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0, None), (2, 2.0, 1.0, None), (3, 3.0, 2.0, None)], "id int, a double, b double, c double")
    one = {r.id: r.score for r in similarity.fuse(df, {"g": ["a", "b", "c"]}, {"g": 2.0}).collect()}
    z = stats.with_z_scores(df, ["a", "b"]).collect()
    assert one == pytest.approx({r.id: r.z_a + r.z_b for r in z})  # 2 shared by two signals that speak


def test_dense_index_and_repair_guard(spark):
    df = spark.createDataFrame([(k,) for k in (5, -3, 1000, 7, 12)], "k long")
    assert sorted((r.k, r.n) for r in queue.dense_index(df, "k", "n").collect()) == [(-3, 0), (5, 1), (7, 2), (12, 3), (1000, 4)]
    rows = [("a", True, None), ("b", False, "x"), ("c", False, None)]
    got = resolve.repair_plan(spark.createDataFrame(rows, "p string, there boolean, other string"), "p", "there", "other").first()
    assert (got["keep"], got["repair"], got["delete"], got["safe"]) == (1, 1, 1, False)

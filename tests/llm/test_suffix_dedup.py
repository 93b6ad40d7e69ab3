"""Removal of repeated passages against a table of all windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import suffix_dedup
from lodestar.llm.suffix_dedup import MATCH, LevelFamily, as_text, dedup_substrings, rolling, sliding


def brute(rows):
    """Rows of id and bytes: kept bytes and removed spans of each."""
    owner = {}
    for i, b in rows:
        for k in range(len(b) - MATCH + 1):
            w = b[k : k + MATCH]
            owner[w] = min(owner.get(w, i), i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - MATCH + 1):
            if owner[b[k : k + MATCH]] < i:
                gone[k : k + MATCH] = b"\1" * MATCH
        edges = [k for k in range(len(b) + 1) if (k < len(b) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g), edges))
    return out


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé漢") for _ in range(draw.randint(1, 9)))
    passages = [" ".join(word() for _ in range(draw.randint(5, 40))) for _ in range(12)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 300, "ab" * 100, "x" + "a" * 60]
    for _ in range(60):
        parts = [draw.choice(passages)[draw.randint(0, 9) :] if draw.random() < 0.4 else " ".join(word() for _ in range(draw.randint(0, 30))) for _ in range(draw.randint(1, 4))]
        texts.append(draw.choice((" ", "")).join(parts))
    texts += texts[10:14]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,hot", ((0, 2000), (1, 2), (2, 2000)))
def test_equals_a_table_of_windows(make_docs, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", hot)
    rows = list(enumerate(corpus(seed)))
    rows += [(7, rows[8][1]), (7, rows[9][1]), (3, rows[3][1])]  # ids that come twice
    rows += [(None, rows[20][1]), (None, rows[20][1]), (None, "w" * 200_000)]
    got = dedup_substrings(make_docs(rows, extra=True)).select("doc_id", "n_bytes", "kept", "removed").collect()
    want = brute([(-1 if i is None else i, (t or "").encode()) for i, t in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, bytes(r.kept), list(r.removed)) for r in got) == sorted(want)


def test_family_of_levels():
    draw = np.random.default_rng(1)
    family, truth = LevelFamily(), {}
    for _ in range(40):
        batch = np.unique(draw.integers(0, 3000, draw.integers(1, 200)).astype("S16"))
        family.append(batch, np.ones(len(batch), np.uint32))
        for x in batch:
            truth[x] = truth.get(x, 0) + 1
        sizes = [len(level).bit_length() for level, _ in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)  # geometric
    keys = np.array(sorted(truth))
    assert family.totals(keys).tolist() == [truth[k] for k in keys]


def test_rolling_hashes_and_sliding_minima():
    data = np.frombuffer(b"the same string, the same string", np.uint8)
    for size in (1, 7, 16, 15):
        hashed = rolling(data, size, suffix_dedup.MULTIPLIERS[0])
        strings = [data[k : k + size].tobytes() for k in range(len(data) - size + 1)]
        assert len(set(hashed.tolist())) == len(set(strings)) and len(hashed) == len(strings)
    x = np.array([5, 3, 9, 1, 7, 7, 2])
    assert sliding(np.minimum, x, 3).tolist() == [3, 1, 1, 1, 2]


def test_text_drops_cut_characters_and_empty_table(spark, make_docs):
    df = spark.createDataFrame([(bytearray("é漢".encode()[1:]),)], "kept binary").select(as_text("kept").alias("t"))
    assert df.first().t == "漢"
    assert dedup_substrings(make_docs([])).count() == 0
    carried = dedup_substrings(make_docs(["x" * 60, "x" * 60]), carry=("lang", "n_chars")).where(F.size("removed") > 0).collect()
    assert [(r.doc_id, r.lang, r.n_chars, bytes(r.kept)) for r in carried] == [(1, "en", 60, b"")]


def test_ids_are_integers(make_docs):
    with pytest.raises(TypeError, match="integer"):
        dedup_substrings(make_docs(["x"]).withColumn("doc_id", F.col("doc_id").cast("string")))

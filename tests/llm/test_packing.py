"""Packing: conflicts, whole texts, and the tightest compatible bin."""

import random

from lodestar.llm.packing import best_fit, pack


def slow_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(left, k) for k, (left, ss, cc) in enumerate(bins) if left >= size and (s < 0 or s not in ss) and (c < 0 or c not in cc)]
        if fits:
            left, k = min(fits)
        else:
            k, left = len(bins), capacity
            bins.append((capacity, set(), set()))
        out.append((k, capacity - left))
        bins[k] = (left - size, bins[k][1] | {s}, bins[k][2] | {c})
    return out


def test_best_fit_equals_a_full_search():
    draw = random.Random(3)
    for _ in range(40):
        n = draw.randint(0, 80)
        pieces = [(draw.randint(0, 100), draw.randint(-1, 5), draw.randint(-1, 30)) for _ in range(n)]
        columns = [list(c) for c in zip(*pieces)] or [[], [], []]
        assert best_fit(*columns, 100) == slow_fit(*columns, 100)


def test_every_byte_once_and_no_conflict(make_docs, odd_texts):
    draw = random.Random(1)
    texts = [*odd_texts, *("y" * draw.randint(0, 700) for _ in range(300)), *["same text"] * 40]
    docs = make_docs(texts, extra=True)
    rows = pack(docs, 256).collect()
    for i, text in enumerate(texts):
        own = sorted((r.piece, r.start, r.n_bytes) for r in rows if r.doc_id == i)
        size = len((text or "").encode())
        assert own == [(k, 256 * k, min(256, size - 256 * k)) for k in range(max(1, -(-size // 256)))]
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: (r.bin_offset, r.n_bytes))
        ends = [r.bin_offset + r.n_bytes for r in members]
        assert ends[-1] <= 256 and all(r.bin_offset == e for r, e in zip(members[1:], ends))
        sources = [r.doc_id % 3 for r in members]
        full = [(texts[r.doc_id] or "").lower() for r in members]
        assert len(set(sources)) == len(sources) and len({t for t in full if t}) == len([t for t in full if t])


def test_null_sources_conflict_with_nothing_and_empty_table(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([f"t{k}" for k in range(30)]).withColumn("source", F.lit(None).cast("string"))
    assert pack(docs, 8192).select("bin").distinct().count() == 1
    assert pack(make_docs([])).count() == 0


def test_bins_do_not_hang_on_the_session(spark, make_docs, monkeypatch):
    """Equal bins at any number of partitions, and as a plain version packs each group; repeated rows among them."""
    monkeypatch.setattr("lodestar.llm.packing.GROUP_ROWS", 50)
    draw = random.Random(5)
    rows = [(i, "z" * draw.randint(0, 900)) for i in range(180)] + [(3, "repeated")] * 40
    docs, found = make_docs(rows).cache(), []
    for n in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, pack(docs, 1000).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(found[0]) == 220
    used = sum(r[3] for r in found[0])
    assert used / (1000 * len({r[4] for r in found[0]})) > 0.4  # three sources: at most three pieces a bin

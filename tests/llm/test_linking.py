"""Components, and links in buckets, against union-find."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import linking
from lodestar.llm.lines import LineRules, repeated_lines, runs_of, word_edits
from lodestar.llm.minhash import NAMES, NearRules, Shingler, near_duplicates


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i + 1, i) for i in range(70)] + [(500, k) for k in range(400, 440)] + [(900, 901), (7, 300)]
    got = linking.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == union_find(edges) and len(got) == len({x for e in edges for x in e})


@pytest.mark.parametrize("seed", range(3))
def test_more_links_join_components(spark, seed):
    draw = random.Random(seed)
    first = [(draw.randint(0, 200), draw.randint(0, 200)) for _ in range(60)]
    more = [(draw.randint(0, 260), draw.randint(0, 260)) for _ in range(40)]
    first, more = ([(a, b) for a, b in edges if a != b] for edges in (first, more))
    labels = linking.components(spark.createDataFrame(first, "a long, b long"))
    got = linking.more_components(labels, spark.createDataFrame(more, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == union_find(first + more) and len(got) == len({x for e in first + more for x in e})


@pytest.mark.parametrize(
    "chain",
    [
        [1, 2, 3, 4, 0],  # after one round id 2 has two targets, neither with an edge of its own
        [1, 4, 3, 2, 0],
        [1, 4, 5, 3, 2, 0],
        [1, 2, 3, 6, 0, 5, 4],
        [0, 3, 6, 4, 7, 5, 1, 2],
    ],
)
def test_components_of_one_chain(spark, chain):
    got = linking.components(spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")).collect()
    assert sorted((r.id, r.component) for r in got) == [(x, 0) for x in range(len(chain))]


def brute_links(sets, percent, linked):
    pairs = ((a, b) for a in sets for b in sets if a < b)
    good = lambda a, b: 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    return [p for p in pairs if good(*p) and linked(*p)]


@pytest.mark.parametrize("seed,small", ((0, 12), (1, 2), (2, 2), (3, 0)))
def test_bucket_links_lose_nothing(spark, monkeypatch, seed, small):
    """Variants of some sets of unequal sizes in one bucket each; not all near pairs are linked."""
    monkeypatch.setattr(linking, "SMALL_BUCKET", small)
    draw, rules, sets, members = random.Random(seed), NearRules(percent=75), {}, []
    for key in range(5):
        base = [draw.getrandbits(60) for _ in range(30)]
        spare = [draw.getrandbits(60) for _ in range(8)]
        for _ in range(20):
            own = set(draw.sample(base, draw.randint(18, 30))) | set(draw.sample(spare, draw.randint(0, 5)))
            sets[len(sets)] = own
            members.append((key, len(sets) - 1, len(own)))
    apart = lambda a, b: (a * 31 + b * 17) % 5 > 0
    frame = spark.createDataFrame(members, "key long, id long, n int")

    def compare(pairs, whole):
        def run(batches):
            for batch in batches:
                a, b = (np.array(c.to_pylist(), np.int64) for c in batch.columns)
                values = np.array([x for s in sets.values() for x in s], np.uint64)
                accept = lambda at: np.array([apart(int(min(a[i], b[i])), int(max(a[i], b[i]))) for i in at], bool)
                linked, more = linking.differences(values, np.cumsum([0, *map(len, sets.values())]), a, b, rules, accept, whole)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(linked), *more], ["a", "b", "linked", *NAMES[: len(more)]])

        return pairs.select("a", "b").mapInArrow(run, "a long, b long, linked boolean" + (", " + linking.DIFFERENCES if whole else ""))

    real = brute_links(sets, 75, apart)
    real = [(a, b) for a, b in real if a // 20 == b // 20]
    got = linking.link_buckets(frame, compare, rules)
    assert {r.id: r.component for r in got.collect()} == union_find(real) and len(real) > 30


def families(seed, n, words, changed, parents):
    draw = random.Random(seed)
    out = []
    for p in range(parents):
        base = [f"b{p}_{i}" for i in range(words)]
        for k in range(n):
            copy = list(base)
            for i in draw.sample(range(words), changed):
                copy[i] = f"c{p}_{k}_{i}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("parents", (1, 2))
def test_a_family_below_the_threshold_costs_few_pairs(make_docs, monkeypatch, parents):
    """Texts that differ from a parent that isn't there: all are about 80 % alike, where 85 % are asked for."""
    texts, compared = families(3, 300 // parents, 500, 9, parents), []
    original = linking.rest_pairs
    monkeypatch.setattr(linking, "rest_pairs", lambda *a: (compared.append(original(*a)), compared[-1])[1])
    got = near_duplicates(make_docs(texts), NearRules(3, 85))
    shingler = Shingler(3)
    sets = [set(shingler.set_of(t).tolist()) for t in texts]
    linked = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = union_find(linked)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: roots.get(i, i) for i in range(len(texts))}
    assert compared[0].count() < 5 * len(texts)


def test_lines_of_the_same_words_in_another_order_cost_few_pairs(make_docs, monkeypatch):
    draw, words, compared = random.Random(4), [f"word{i}" for i in range(12)], []
    lines = [" ".join(draw.sample(words, 12)) for _ in range(400)]
    near = lines[17].split()
    near[3], near[4] = near[4], near[3]
    lines.append(" ".join(near))
    original = linking.rest_pairs
    monkeypatch.setattr(linking, "rest_pairs", lambda *a: (compared.append(original(*a)), compared[-1])[1])
    got = {r.doc_id for r in repeated_lines(make_docs(lines)).collect()}
    roots = union_find([(a, b) for b in range(401) for a in range(b) if word_edits(lines[a].split(), lines[b].split()) <= 2])
    assert got == {x for x, root in roots.items() if x != root} and 400 in got
    assert compared[0].count() < 5 * len(lines)


@pytest.mark.parametrize("seed", range(6))
def test_linked_sequences_share_a_run_that_both_look_up(seed):
    """Of any two lines within the allowed edits, some run is among the first of both, whatever the order of runs."""
    draw, rules = random.Random(seed), LineRules()
    for _ in range(400):
        n = draw.randint(5, 40)
        x = [draw.choice("abcdefghijkl") if draw.random() < 0.3 else f"w{draw.randint(0, 60)}" for _ in range(n)]
        y = list(x)
        for _ in range(rules.edits(n)):
            i, kind = draw.randrange(len(y)), draw.choice("rid")
            y[i : i + (kind != "i")] = [] if kind == "d" else [f"w{draw.randint(0, 60)}"]
        if word_edits(x, y) > rules.edits(max(len(x), len(y))):
            continue
        order = lambda r: hash((seed, r[0], r[1]))
        looked = []
        for line in (x, y):
            runs = sorted(runs_of([w.encode() for w in line], rules), key=lambda r: (r[0], order(r)))
            of = {q: [r for r in runs if r[0] == q] for q in {r[0] for r in runs}}
            assert all(len(rs) == rs[0][4] for rs in of.values())
            looked.append({(q, r[1]): r for q, rs in of.items() for r in rs[: rs[0][5]]})
        both = looked[0].keys() & looked[1].keys()
        beside = [k for k in both if looked[0][k][2] <= looked[1][k][3] + max(looked[0][k][6], looked[1][k][6]) and looked[1][k][2] <= looked[0][k][3] + max(looked[0][k][6], looked[1][k][6])]
        assert beside, (x, y)


def test_no_members(spark):
    empty = spark.createDataFrame([], "key long, id long, n int")
    shape = "a long, b long, linked boolean, " + linking.DIFFERENCES
    assert linking.link_buckets(empty, lambda pairs, whole: spark.createDataFrame([], shape), NearRules()).count() == 0

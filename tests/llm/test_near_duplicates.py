"""Min-max hashing against comparing all pairs."""

import random
import re

import numpy as np
import pytest

from lodestar.llm import linking
from lodestar.llm.minhash import NearRules, Shingler, band_keys, near_duplicates


def shingles(text, size):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(texts, rules):
    sets = [shingles(t, rules.words) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= rules.percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i), root(i) == i) for i, s in enumerate(sets)]


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.choice((2, 4, 60, 150)))]
        for _ in range(draw.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(draw.choice((0, 0, 1, 2, 5, 20))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(" ".join(w.upper() if draw.random() < 0.02 else w for w in copy))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("rules", (NearRules(3, 85), NearRules(5, 80, 75)))
def test_equals_all_pairs(make_docs, rules):
    texts = [None, "", " \n", "one", "ONE", "İ ß é", *corpus(rules.words)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(texts, extra=True), rules).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, rules)


def test_signatures_estimate_similarity():
    rules, shingler, draw = NearRules(3, 85, rows=1), Shingler(3), random.Random(2)
    words = [str(draw.random()) for _ in range(400)]
    a, b = shingler.set_of(" ".join(words)), shingler.set_of(" ".join(words[:360]))
    keys = band_keys(np.concatenate([a, b]), np.array([0, len(a)]), rules.permutations, rules.rows)
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert keys.shape == (2, 120) and abs((keys[0] == keys[1]).mean() - real) < 0.1


def test_empty_table(make_docs):
    assert near_duplicates(make_docs([])).count() == 0


def test_repeated_and_null_ids(make_docs):
    draw = random.Random(6)
    a, b = (" ".join(str(draw.random()) for _ in range(40)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (None, a), (5, a), (5, a), (None, None), (6, "x " * 200_000)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(make_docs(rows), NearRules(3, 85)).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (5, 1, False), (6, 6, True)]


def test_a_group_of_near_copies_costs_few_pairs(spark, make_docs, monkeypatch):
    """Most members of the group are too far from each other, and no comparison of all of them with all may follow."""
    draw = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [draw.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(150):
        copy = list(base)
        for _ in range(draw.randint(1, 10)):
            copy[draw.randrange(150)] = draw.choice(vocabulary)
        texts.append(" ".join(copy))
    rules, compared = NearRules(3, 85), []
    original = linking.rest_pairs
    monkeypatch.setattr(linking, "rest_pairs", lambda *a: (compared.append(original(*a)), compared[-1])[1])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(texts), rules).collect()}
    want = brute(texts, rules)
    assert [got[i] for i in range(len(texts))] == want and 20 < len({c for _, c, _ in want}) < 120
    assert compared[0].count() < 151 * 150 / 2 / 10

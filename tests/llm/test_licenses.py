"""Licence scans against plain searches."""

import random
import re

import pytest

from lodestar.llm.licenses import BASE_PHRASES, TEMPLATES, LicenseRules, TemplateAutomaton, scan_licenses, words_of


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(words, phrases):
    places = []
    for phrase, label in phrases:
        sought = phrase.split()
        places += [(i, label) for i in range(len(words) - len(sought) + 1) if words[i : i + len(sought)] == sought]
    starts = [i for i, _ in places]
    return len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def plain_statistics(words, runs):
    """The longest run ending at each word that one of ``runs`` holds."""
    held = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
    out = []
    for i in range(len(words)):
        out.append(max((k for k in range(1, i + 2) if tuple(words[i + 1 - k : i + 1]) in held), default=0))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_automaton_knows_every_longest_run(seed):
    draw = random.Random(seed)
    runs = [[draw.choice("abc") for _ in range(draw.randint(1, 12))] for _ in range(5)]
    automaton = TemplateAutomaton([("t", " ".join(r)) for r in runs], [])
    words = [draw.choice("abcd") for _ in range(300)]
    state, run, got = 0, 0, []
    for w in (x.encode() for x in words):
        while state and w not in automaton.after[state]:
            state = automaton.link[state]
            run = automaton.length[state]
        if w in automaton.after[state]:
            state, run = automaton.after[state][w], run + 1
        got.append(run)
        ends = {(k, j) for k, r in enumerate(runs) for j in range(run - 1, len(r)) if run and r[j + 1 - run : j + 1] == words[len(got) - run : len(got)]}
        assert not run or set(automaton.ends[state]) == ends
    assert got == plain_statistics(words, runs)


def plain_chain(words, template, rules):
    """The largest share of a template covered by matches in order, over all chains, from all maximal runs."""
    least, n, runs = min(rules.least_match, len(template)), len(template), []
    for i in range(len(words)):
        for j in range(n):
            if words[i] == template[j] and not (i and j and words[i - 1] == template[j - 1]):
                k = 0
                while i + k < len(words) and j + k < n and words[i + k] == template[j + k]:
                    k += 1
                if k >= least:
                    runs.append((i + k - 1, i, j + k - 1, k))
    best, worth = 0, []
    for e, s, p, k in sorted(runs):
        here = k
        for (e2, _, p2, _), w2 in zip(sorted(runs), worth, strict=False):
            gain = min(k, e - e2, p - p2)
            if gain > 0 and s - 1 - e2 <= rules.most_gap:
                here = max(here, w2 + gain)
        worth.append(here)
        best = max(best, here)
    return best / n


@pytest.mark.parametrize("seed", range(4))
def test_chains_equal_a_search_of_all_runs(seed):
    """With distinct words in the template each longest run is one of its maximal runs."""
    draw, rules = random.Random(seed), LicenseRules(least_match=2, most_gap=4, least_cover=0.5)
    template = [f"w{i}" for i in range(20)]
    automaton = TemplateAutomaton([("t", " ".join(template))], [], rules)
    for _ in range(60):
        words = []
        while len(words) < 60:
            i = draw.randrange(20)
            words += template[i : i + draw.randint(1, 6)] + ["x"] * draw.randint(0, 6)
        found = automaton.scan(" ".join(words).encode())
        assert found.score == pytest.approx(plain_chain(words, template, rules))
        assert bool(found.spans) == (found.score >= rules.least_cover)


@pytest.mark.parametrize("seed", range(4))
def test_base_equals_a_plain_search(spark, make_docs, seed):
    draw = random.Random(seed)
    pool = "cc BY by Cc general public license License all rights reserved Reserved x é 漢 K 7".split()
    texts = ["".join(draw.choice(pool) + draw.choice([" ", ", ", "-", "\n", "", "\x00", "_"]) for _ in range(draw.randint(0, 80))) for _ in range(80)]
    docs = make_docs(texts, extra=True)
    for r in scan_licenses(docs).collect():
        words = plain_words(texts[r.doc_id])
        assert (r.n_words, (r.n_base, r.first_word, r.last_word, r.base_labels)) == (len(words), plain_base(words, BASE_PHRASES))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_notices_are_labelled_and_other_texts_are_not(spark, make_docs):
    draw = random.Random(1)
    pool = sorted({w for _, t in TEMPLATES for w in t.split()}) + [f"word{i}" for i in range(200)]
    around = lambda: " ".join(draw.choice(pool) for _ in range(150))
    texts = [f"{around()}\n{t.title()}.\n{around()}" for _, t in TEMPLATES] + [around() for _ in range(30)]
    found = {r.doc_id: r for r in scan_licenses(make_docs(texts)).collect()}
    for i, (label, t) in enumerate(TEMPLATES):
        n = len(t.split())
        assert label in found[i].labels.split(",") and found[i].score == 1.0
        assert any((s.label, s.first_word, s.last_word, s.share) == (label, 150, 149 + n, 1.0) for s in found[i].spans)
    assert all(found[i].labels == "" for i in range(len(TEMPLATES), len(texts)))


def test_a_notice_with_changed_words_is_chained():
    label, text = max(TEMPLATES, key=lambda t: len(t[1]))
    words = text.split()
    changed = " ".join("acme" if i % 23 == 11 else w for i, w in enumerate(words))
    found = TemplateAutomaton().scan(changed.encode())
    assert [s[0] for s in found.spans] == [label] and 0.9 < found.score < 1
    apart = " ".join(words[:40]) + " filler" * 500 + " " + " ".join(words[40:70])
    assert TemplateAutomaton().scan(apart.encode()).spans == []


def test_odd_texts_and_an_empty_table(spark, make_docs, odd_texts):
    got = scan_licenses(make_docs(odd_texts, extra=True)).collect()
    assert sorted(r.n_words for r in got) == sorted(len(plain_words(t)) for t in odd_texts)
    assert all(r.first_word is None and r.last_word is None and r.labels == "" and r.score == 0 for r in got if r.n_base == 0)
    assert scan_licenses(make_docs([])).collect() == []


def test_long_texts_stream_in_parts():
    text = ("all rights reserved " * 7 + "é" * 50 + " x" * 20).encode() * 40
    whole = [w for part in words_of(text, 1 << 30) for w in part]
    for at_once in (3, 10, 64, 1001):
        assert [w for part in words_of(text, at_once) for w in part] == whole
    assert TemplateAutomaton().scan(b"z" * 3_000_000 + b" cc by").n_words == 3
    many = TemplateAutomaton().scan(b"released under the mit license. " * 50_000)
    assert len(many.spans) == 50_000 and many.score == 1.0

"""Repetition measures against direct counting."""

import random
import re
from collections import Counter

import pytest

from lodestar.llm.repetition import RepetitionRules, measures, repetition_quality

RULES = RepetitionRules(min_words=4)


def brute(text, least):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    five = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = {k for i in range(n - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= least:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(covered), longest


@pytest.mark.parametrize("seed", range(4))
def test_equals_direct_counting(seed):
    draw = random.Random(seed)
    texts = [None, "", "a", "x\ny\nx \nx\n\n"] + [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 50))) for _ in range(60)]
    texts += ["\n".join(" ".join(draw.choice(["a#", "b|", "dé", "\x1c"]) for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(0, 9))) for _ in range(40)]
    got = measures(texts, RULES)
    for i, text in enumerate(texts):
        found = tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"))
        assert found == brute(text, RULES.min_words), text


def test_verdicts(make_docs, odd_texts):
    clean = " ".join(f"w{i}" for i in range(200))
    twice = clean + " and " + clean
    rows = {r.doc_id: r for r in repetition_quality(make_docs([clean, twice, None, "few words", *odd_texts], extra=True)).collect()}
    assert rows[0].kept and not rows[0].base_failed
    assert rows[1].base_failed and not rows[1].kept and rows[1].longest_repeat == 200
    assert rows[2].base_failed and rows[3].base_failed and len(rows) == 4 + len(odd_texts)
    assert repetition_quality(make_docs([])).count() == 0


def test_longest_repeat_alone_can_fail(make_docs):
    passage = " ".join(f"p{i}" for i in range(60))
    text = passage + " " + " ".join(f"u{i}" for i in range(900)) + " " + passage
    row = repetition_quality(make_docs([text])).first()
    assert not row.base_failed and not row.kept and row.longest_repeat == 60

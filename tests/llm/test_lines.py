"""Fuzzy lines against comparing all pairs of lines."""

import random
import string

import numpy as np

from lodestar.llm.lines import LineRules, all_lines, bags, normal_lines, orders_of, repeated_lines, with_removed, without_lines, word_edits
from lodestar.llm.minhash import band_keys
from lodestar.llm.queries import QUERIES

RULES = LineRules()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_word_edits():
    draw = random.Random(0)
    for _ in range(2000):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 14))] for _ in range(2))
        assert word_edits(a, b) == edits(a, b)


def brute(texts):
    """By edit similarity alone; every pair of lines is compared."""
    found = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(normal_lines(t)) if x]
    lines = list(dict.fromkeys(x for _, _, x in found))
    words = [x.split(b" ") for x in lines]
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if abs(len(words[i]) - len(words[j])) > 20 or group[i] == group[j]:
                continue
            if 100 * word_edits(words[i], words[j]) <= max(len(words[i]), len(words[j])) * (100 - RULES.percent):
                group = [group[j] if g == group[i] else g for g in group]
    place = {x: k for k, x in enumerate(lines)}
    seen, gone = set(), {}
    for i, k, x in found:
        g = group[place[x]]
        if g in seen:
            gone.setdefault(i, []).append(k)
        seen.add(g)
    return gone


def corpus():
    draw = random.Random(5)
    vocabulary = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice((3, 12, 60, 90)))] for _ in range(25)]
    texts = []
    for _ in range(50):
        lines = []
        for _ in range(draw.randint(0, 5)):
            line = list(draw.choice(bases))
            if draw.random() < 0.4:
                line[draw.randrange(len(line))] = draw.choice(vocabulary)
            lines.append(draw.choice((" ", "  ")).join(line) + draw.choice(("", ".", " 17", " 99")))
        texts.append("\n".join(lines))
    return texts


def test_equals_all_pairs(make_docs):
    texts = [None, "", "\n \n--\n", "Hello, world 1", "hello world! 2\nhello world 3", *corpus()]
    docs = make_docs(texts, extra=True)
    want = brute(texts)
    removed = repeated_lines(docs)
    assert {r.doc_id: r.removed for r in removed.collect()} == want and want
    kept = {r.doc_id: (r.text, r.lines_removed) for r in without_lines(docs, removed).collect()}
    for i, text in enumerate(texts):
        gone = set(want.get(i, ()))
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text
        assert kept[i] == (left, len(gone))


def test_empty_table_and_long_line(make_docs):
    assert repeated_lines(make_docs([])).count() == 0
    long = " ".join(f"w{k}" for k in range(20_000))
    assert {r.doc_id: r.removed for r in repeated_lines(make_docs([long, long + " end", "x"])).collect()} == {1: [0]}


def test_bags_number_equal_words():
    lines = [b"a b a a", b"b a", b"c", b"a b a"]
    values, sizes = bags(lines)
    rows = np.split(values, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [4, 2, 1, 3] and all(len(set(r.tolist())) == len(r) for r in rows)
    assert [len(set(rows[0].tolist()) & set(r.tolist())) for r in rows[1:]] == [2, 0, 3]


def test_recall_of_the_keys():
    """Lines with as many edits as similarity allows: share a band in nine of ten cases or more, at each length."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=4)).encode()
    for n in (5, 10, 20, 50, 200):
        pairs = []
        while len(pairs) < 300:
            a = [word() for _ in range(n)]
            b = list(a)
            for at in draw.sample(range(n), n // 5):
                b[at] = word()
            pairs += [b" ".join(a), b" ".join(b)]
        values, sizes = bags(pairs)
        keys = band_keys(values, np.cumsum(np.r_[0, sizes[:-1]]), RULES.permutations, RULES.rows)
        assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.93, n


def test_recall_of_the_operator(make_docs):
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghij", k=4))
    lines, changed = [], []
    for n in (5, 10, 20, 50) * 25:
        a = [word() for _ in range(n)]
        b = list(a)
        for _ in range(draw.randint(1, n // 5)):
            at, how = draw.randrange(len(b)), draw.random()
            b[at : at + 1] = [b[at], word()] if how < 0.2 else [] if how > 0.8 else [word()]
        lines.append(" ".join(a))
        changed.append(" ".join(b))
    want = sum(len(x) for x in brute(["\n".join(lines), "\n".join(changed)]).values())
    got = repeated_lines(make_docs(["\n".join(lines), "\n".join(changed)])).collect()
    assert want > 90 and sum(len(r.removed) for r in got) >= 0.97 * want


def test_groups_of_copies_and_hot_keys(make_docs, monkeypatch):
    monkeypatch.setattr("lodestar.llm.lines.HOT_IN_PIECE", 3)
    draw = random.Random(2)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(draw.randint(0, 14)):
            copy[draw.randrange(40)] = f"x{draw.randrange(60)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: r.removed for r in repeated_lines(make_docs(texts)).collect()}
    want = brute(texts)
    assert got.items() <= want.items() and 10 < len(want) < 55 and len(got) >= 0.93 * len(want), (len(got), len(want))


def test_null_and_repeated_ids(make_docs):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "other words that stand here once"
    rows = [(4, a), (None, a + "\n" + b), (7, b), (7, c), (9, c), (9, c)]
    got = with_removed(make_docs(rows), repeated_lines(make_docs(rows))).collect()
    assert len(got) == 6 and {(r.doc_id, r.text, tuple(r["__removed"] or ())) for r in got} == {(4, a, (0,)), (None, a + "\n" + b, ()), (7, b, (0,)), (7, c, ()), (9, c, (0,))}


def test_one_word_in_ten_replaced(make_docs):
    draw = random.Random(4)
    lines = [["".join(draw.choices("abcdefgh", k=6)) for _ in range(n)] for n in (5, 10, 20, 30) for _ in range(10)]
    changed = [["other", *x[1:]] for x in lines]
    docs = make_docs(["\n".join(map(" ".join, x)) for x in (lines, changed)])
    assert [(r.doc_id, r.removed) for r in repeated_lines(docs).collect()] == [(1, list(range(40)))]


def test_lines_that_differ_in_digits_stay(make_docs):
    docs = make_docs(["Q1 2019: 431 units\nQ3 2021: 977 units", "Q1 2020: 12 units\nq1 2019, 431 units"])
    assert [(r.doc_id, r.removed) for r in repeated_lines(docs).collect()] == [(1, [1])]


def test_removal_splits_a_text_once(make_docs):
    """Not again for each of its lines, as an expression inside of a function of elements would."""
    docs = make_docs(["a b\na b\nc", "c", None])
    left = without_lines(docs, repeated_lines(docs))
    assert left._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert {r.doc_id: (r.text, r.lines_removed) for r in left.collect()} == {0: ("a b\nc", 1), 1: ("", 1), 2: (None, 0)}


def test_lines_of_several_texts_at_once():
    odd = [None, "", " a \n  b--c \t d\n\n . \n\x0b\x0cx\r\ny \x1c z\x85  q", "\n \n", "\u03a3 \u0391\u03a3\n\u0391\u03a3,", "  ", "a\n"]
    want = [[b" ".join(x.split()) for x in (t or "").lower().encode().translate(bytes(32 if chr(b) in string.punctuation else b for b in range(256))).split(b"\n")] for t in odd]
    lines, counts = all_lines(odd)
    assert lines == sum(want, []) and counts == [len(x) for x in want] and [normal_lines(t) for t in odd] == want


def test_query_exchanges_no_texts_with_the_removed_lines(spark, make_docs, tmp_path):
    make_docs(["one two three\nfour", "one two three\nfive\nsix", None, ""]).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_fuzzy_lines"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(0, 2, 0, []), (1, 3, 1, [0]), (2, 1, 0, []), (3, 1, 0, [])]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
    assert "AS n_lines" not in plan[0] and "AS n_lines" in plan[1]


def test_runs_are_made_of_hubs_with_other_orders_only(make_docs, monkeypatch):
    asked = []

    def counting(texts, rules):
        given = orders_of(texts, rules)
        return lambda ids: (asked.append(ids.count()), given(ids))[1]

    monkeypatch.setattr("lodestar.llm.lines.orders_of", counting)
    draw, words = random.Random(4), [f"word{k}" for k in range(20)]
    copies = [" ".join(w if draw.random() > 0.1 else f"x{draw.randrange(10**6)}" for w in words) for _ in range(12)]
    repeated_lines(make_docs(copies)).count()
    turned = [" ".join(draw.sample(words, 20)) for _ in range(12)]
    docs = make_docs([*turned, *(" ".join([*x.split()[:19], "last"]) for x in turned)])
    assert {r.doc_id: r.removed for r in repeated_lines(docs).collect()} == {k: [0] for k in range(12, 24)}
    assert sum(asked[:-1]) == 0 and asked[-1] > 12

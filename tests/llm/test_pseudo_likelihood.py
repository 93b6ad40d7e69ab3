"""Pseudo-likelihood: windows, gradients, scores against a plain sum."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm.pseudo_likelihood import count_windows, counted_batches, NetShape, RADIUS, score, score_corpus, train_on, window_bytes, window_codes, WindowNet

SMALL = NetShape(rounds=1, draws=20)


def windows(data):
    padded = b"\0" * RADIUS + data + b"\0" * RADIUS
    return [tuple(padded[k : k + 2 * RADIUS + 1]) for k in range(len(data))]


def test_windows_of_texts():
    texts = [b"", b"a", b"hello", bytes(range(256))]
    codes, sizes = window_codes(texts)
    assert sizes.tolist() == [0, 1, 5, 256]
    assert list(map(tuple, window_bytes(codes).tolist())) == [w for t in texts for w in windows(t)]


def test_counts_cover_all_texts(make_docs):
    texts = ["abcabc", None, "", "abc é", "abcabc"]
    want = {}
    for t in texts:
        for w in windows((t or "").encode()):
            want[w] = want.get(w, 0) + 1
    got = count_windows(make_docs(texts)).collect()
    assert {tuple(window_bytes(np.array([r.window]).view(np.uint64))[0].tolist()): r.n for r in got} == want


def test_gradients_equal_differences():
    net = WindowNet(NetShape(embed=3, hidden=5))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    draw = np.random.default_rng(0)
    window = draw.integers(0, 256, (6, 2 * RADIUS + 1))
    sides = [k for k in range(2 * RADIUS + 1) if k != RADIUS]
    loss = lambda: -net._forward(window[:, sides])[2][np.arange(6), window[:, RADIUS]].mean()
    grads = net.gradients(window)
    for name, w in net.weights.items():
        for at in [tuple(draw.integers(0, s) for s in w.shape) for _ in range(10)] + ([(int(window[0, 0]), 0)] if name == "embed" else []):
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert (up - down) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)


def test_scores_are_sums_over_every_byte(make_docs, odd_texts):
    docs = make_docs(odd_texts, extra=True)
    net = train_on(count_windows(docs), SMALL)
    got = {r.doc_id: r for r in score(docs, net).collect()}
    for i, text in enumerate(odd_texts):
        data = (text or "").encode()
        assert got[i].n_tokens == len(data)
        if not data:
            assert (got[i].log_likelihood, got[i].mean_log_likelihood) == (0, None)
            continue
        seen = np.array(windows(data))
        sides = [k for k in range(2 * RADIUS + 1) if k != RADIUS]
        plain = net._forward(seen[:, sides])[2][np.arange(len(seen)), seen[:, RADIUS]].sum(dtype=np.float64)
        assert got[i].log_likelihood == pytest.approx(plain, rel=1e-4)


def test_likely_texts_score_higher(make_docs):
    draw = random.Random(0)
    words = "the cat sat on a mat and then it ran to the house of the man".split()
    usual = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(60)]
    odd = ["".join(draw.choice("zqxjkv#*&%0123") for _ in range(200)) for _ in range(3)]
    rows = score_corpus(make_docs(usual + odd), NetShape(rounds=2, draws=60)).collect()
    means = {r.doc_id: r.mean_log_likelihood for r in rows}
    assert min(means[i] for i in range(60)) > max(means[i] for i in range(60, 63))


def test_empty_table(make_docs):
    assert score_corpus(make_docs([]), SMALL).count() == 0


def test_training_takes_as_many_windows_at_a_time_whatever_the_batches():
    rows = [pa.record_batch([pa.array(np.arange(k, k + n)), pa.array(np.ones(n, np.int64))], ["window", "n"]) for k, n in ((0, 7), (7, 1), (8, 25), (33, 0), (33, 4))]
    parts = [codes.tolist() for codes, _ in counted_batches(iter(rows), 10)]
    assert [len(p) for p in parts] == [10, 10, 10, 7] and sum(parts, []) == list(range(37))
    assert list(counted_batches(iter(rows[3:4]), 10)) == []


def test_scores_hang_on_the_documents_alone(make_docs):
    """The same documents in other partitions and another order give the same network."""
    docs = make_docs([f"text {i % 7} of some kind, number {i}" for i in range(80)])
    weights = [train_on(count_windows(d)).flat() for d in (docs.repartition(5), docs.repartition(12, "text"), docs.coalesce(1))]
    assert np.array_equal(weights[0], weights[1]) and np.array_equal(weights[0], weights[2])

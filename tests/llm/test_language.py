"""Language identification: gradients, held-out accuracy, odd texts."""

import random

import numpy as np

from lodestar.llm.langid import ByteNet, NetShape, held_out, identify, train_on, windows_of

WORDS = {
    "aa": "kala puro talo vesi metsä joki lintu kivi ranta saari".split(),
    "bb": "stein wald fluss vogel haus wasser berg strasse zwölf brücke".split(),
}


def texts(n, seed=0):
    draw = random.Random(seed)
    return [(k, " ".join(draw.choice(WORDS[lang]) for _ in range(draw.randint(2, 90)))) for k, lang in zip(range(n), ["aa", "bb"] * n)]


def test_windows_cover_the_text():
    for n in (1, 255, 256, 257, 512, 1000):
        text = bytes(i % 251 for i in range(n))
        rows = windows_of(text, 256)
        assert rows.shape[1] == 256 and set(text) <= set(rows.ravel().tolist())
        assert n <= 256 or rows[-1].tobytes() == text[-256:]


def test_gradients_equal_differences():
    net = ByteNet(NetShape(window=12, embed=2, widths=(2, 3), filters=2), ["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    draw = np.random.default_rng(0)
    windows, labels = draw.integers(0, 256, (5, 12)), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net._forward(windows)[3][np.arange(5), labels]).mean()
    for name, g in net._gradients(windows, labels).items():
        w = net.weights[name]
        for at in [tuple(draw.integers(0, s) for s in w.shape) for _ in range(12)]:
            if name == "filters" and not net.mask[at]:
                continue
            old, step = w[at], 1e-5
            w[at] = old + step
            up = loss()
            w[at] = old - step
            down = loss()
            w[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-5, (name, at)


def test_held_out_accuracy(make_docs):
    rows = texts(400)
    docs = make_docs(rows, langs=["aa", "bb"] * 200)
    net = train_on(docs, shape=NetShape(steps=150))
    got = identify(docs, net, carry=("doc_id", "lang")).withColumn("held", held_out("doc_id")).collect()
    held = [r for r in got if r.held]
    assert len(held) > 50 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_and_tables(make_docs, odd_texts):
    docs = make_docs(odd_texts + ["1234 !!"], extra=True)
    net = train_on(docs, shape=NetShape(steps=3))
    got = {r.doc_id: r for r in identify(docs, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, len(odd_texts)))
    assert got[5].lang_pred == "en" and (got[5].score, got[5].lang_pred) == (got[6].score, got[6].lang_pred)
    empty = make_docs([])
    assert identify(empty, train_on(empty)).count() == 0
    unlabelled = make_docs(["text", "more"], langs=[None, None])
    assert {r.lang_pred for r in identify(unlabelled, train_on(unlabelled)).collect()} == {"und"}


def test_every_language_is_learned(make_docs):
    rows = [(k, f"text of {k}") for k in range(1600)]
    docs = make_docs(rows, langs=[f"l{k % 220:03}" for k in range(1600)])
    assert len(train_on(docs, shape=NetShape(steps=1)).languages) == 220


def test_letters_windows_and_mean_scores(make_docs):
    """Numbers that look like letters are none; a text's score is the plain mean over its windows."""
    shape = NetShape(window=16)
    net = ByteNet(shape, ["a", "b", "c"])
    assert net.predict(["½ ² Ⅷ ① 12", "٣", "ª", "漢"])[0][:2] == ["und", "und"] and "und" not in net.predict(["ª", "漢"])[0]
    for text in ("short", "x" * 16, "some text of more than one window, " * 3):
        raw = text.encode()
        cut = [raw.ljust(16, b"\0")] if len(raw) <= 16 else [raw[i : i + 16] for i in range(0, len(raw) - 15, 16)] + ([raw[-16:]] if len(raw) % 16 else [])
        assert [w.tobytes() for w in windows_of(raw, 16)] == cut
        mean = np.mean([net.probabilities(np.frombuffer(w, np.uint8)[None])[0] for w in cut], axis=0)
        names, scores = net.predict([text])
        assert names == ["abc"[mean.argmax()]] and abs(scores[0] - mean.max()) < 1e-5

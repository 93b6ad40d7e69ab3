"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from lodestar.llm import queries
from lodestar.llm.lines import LineRules, normal_lines, word_edits
from lodestar.llm.minhash import PIPELINE_RULES, Shingler


def planted():
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    clean = [text(80) for _ in range(20)]
    passage = text(60)
    near = clean[3].split()
    near[40] = "changed"
    near[19::20] = [w + "\n" for w in near[19::20]]  # in lines of its own
    rows = list(enumerate(clean))
    rows += [(20, clean[0]), (21, " ".join(near)), (22, text(30) + "\n" + clean[1]), (23, text(20) + " " + passage), (24, text(25) + " " + passage + " end"), (25, None), (26, "12 34"), (27, "")]
    return rows, clean, passage


def test_stages(spark, make_docs, tmp_path):
    rows, clean, passage = planted()
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), before.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == set(range(25))
    assert 20 not in kept["line_dedup"] and clean[1] not in kept["line_dedup"][22] and kept["line_dedup"][21]
    assert 21 not in kept["near_dedup"] and set(range(20)) <= set(kept["near_dedup"])
    assert passage in kept["passage_dedup"][23] and passage[1:-1] not in kept["passage_dedup"][24]
    assert all(kept["passage_dedup"][i] == clean[i] for i in range(20))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.n_bytes for r in packed) == sum(len(t.encode()) for t in kept["passage_dedup"].values())


def plain_pipeline(spark, rows, sf_dir):
    """Lines, near duplicates, passages and packing by comparing all with all; which documents have a certain language is the
    first stage's own verdict (its accuracy has tests of its own)."""
    first = corpus_pipeline.language_id(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    texts = {r.doc_id: r.text for r in first.collect()}
    words = lambda line: normal_lines(line)[0].split()
    # Line dedup: links between all lines, and the first occurrence of each connected group stays.
    lines = [(i, k, line, words(line)) for i in sorted(texts) for k, line in enumerate(texts[i].split("\n")) if words(line)]
    group = list(range(len(lines)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            n = max(len(lines[a][3]), len(lines[b][3]))
            if word_edits(lines[a][3], lines[b][3]) <= LineRules().edits(n):
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    gone = {(i, k) for at, (i, k, *_) in enumerate(lines) if root(at) != at}
    for i in list(texts):
        left = [line for k, line in enumerate(texts[i].split("\n")) if (i, k) not in gone]
        if len(left) < len(texts[i].split("\n")):
            texts[i] = "\n".join(left)
            if not texts[i].strip(" \t\n\r\v\f"):
                del texts[i]
    # Near duplicates: one of each component of documents with enough common shingles.
    shingler, rules = Shingler(5), PIPELINE_RULES
    sets = {i: set(shingler.set_of(t).tolist()) for i, t in texts.items()}
    least = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= rules.percent * len(sets[i] | sets[j]):
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    texts = {i: t for i, t in texts.items() if least[i] == i}
    # Passages: bytes covered by 50 bytes that an earlier document holds.
    seen, kept = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        covered = set()
        for p in range(len(data) - 49):
            if data[p : p + 50] in seen:
                covered |= set(range(p, p + 50))
        seen |= {data[p : p + 50] for p in range(len(data) - 49)}
        left = bytes(c for p, c in enumerate(data) if p not in covered).decode()
        if not covered or left.strip(" \t\n\r\v\f"):
            kept[i] = left
    return kept


def test_run_equals_plain_stages(spark, make_docs, tmp_path):
    """The packed pieces of every document are, in order, the text that comparing all with all leaves of it."""
    rows = planted()[0]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline(spark, rows, str(tmp_path))
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_bytes
    assert got == {i: len(t.encode()) for i, t in want.items()} and len(got) >= 20


def test_one_id_with_several_texts_is_told_by_its_text(spark, make_docs):
    draw = random.Random(9)
    a, b = (" ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(50)) for _ in range(2))
    docs = make_docs([(0, b), (1, a), (1, b), (1, a)])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted([(0, b), (1, a)])


def test_texts_without_any_label_stay(spark, make_docs):
    docs = make_docs(["some text", "12 34", None, "漢字"], langs=[None] * 4)
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {0, 3}


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_odd_rows_and_an_empty_table(spark, make_docs, tmp_path):
    """Repeated and null ids, clashing columns, and no rows at all."""
    draw = random.Random(4)
    text = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    a, b, c = text(), text(), text()
    docs = make_docs([(1, a), (1, a), (1, b), (None, c), (2, a + " more")], extra=True)
    docs = docs.withColumns({"lang_pred": F.lit(1), "score": F.lit(1), "component_id": F.lit(1), "lines_removed": F.lit(1)})
    near = corpus_pipeline.near_dedup(spark, docs, "")
    assert near.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in near.collect()) == sorted([(1, a), (1, b), (0, c)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, docs, "").count() >= 2, name
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_passages_need_one_worker_a_task(spark, make_docs):
    """What is left of a text is decoded where it is cut, not by a further pass through Python."""
    passage = "\u00e9" * 40
    docs = make_docs([passage + "x", "y" + passage, "z " + passage[:30], None])
    left = corpus_pipeline.passage_dedup(spark, docs, "")
    assert "ArrowEvalPython" not in left._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == {0: (passage + "x", 41), 1: ("y", 1), 2: ("z ", 2), 3: ("", 0)}

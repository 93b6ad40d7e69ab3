"""BPE encoding against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from lodestar.llm.bpe import PrefixEncoder, encode_texts, text_encoder

P = pytest.importorskip("public_tokenizers")
PATH = str(P.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_equal_the_library(library, seed):
    draw = random.Random(seed)
    letters = "aabcdeeeiou ''sttnnrr ABCÉßİΣσς\x1c\x85​　\t\n0129½ⅷ中文한글éếñ.,!?-<|>endoftext😀👨‍👩‍👧ǅﬁͅ᠎\x00"
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.choice((3, 10, 60))))
        if draw.random() < 0.1:
            text += draw.choice(("<|endoftext|>", "<|startoftext|>x", "<|EndOfText|>"))
        assert text_encoder(PATH).encode(text) == expected(library, text)


def test_encodings_without_replaying_merges_equal_merging():
    """A small vocabulary with overlapping merges, against merging by rank."""
    merges = [("a", "b"), ("b", "c</w>"), ("ab", "a"), ("b", "a"), ("a", "a"), ("aa", "aa"), ("ab", "ab"), ("aba", "c</w>"), ("c", "a")]
    vocab = {}
    for t in ["a", "b", "c", "a</w>", "b</w>", "c</w>", *(x + y for x, y in merges)]:
        vocab.setdefault(t, len(vocab))
    encoder, rank = PrefixEncoder(vocab, merges, "</w>"), {m: i for i, m in reversed(list(enumerate(merges)))}
    draw, names = random.Random(1), [chr(b) for b in range(256)]
    for _ in range(4000):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(1, 14)))
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        assert encoder.encode(word, names) == [vocab[p] for p in parts], word


def test_whole_texts_nulls_and_clashing_columns(make_docs, odd_texts, library):
    texts = [*odd_texts, "z" * 5000, "<|endoftext|>" * 3]
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in encode_texts(make_docs(texts, extra=True), PATH).collect()}
    assert got == {i: expected(library, t or "") for i, t in enumerate(texts)}
    assert encode_texts(make_docs([]), PATH).count() == 0

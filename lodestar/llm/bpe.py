"""BPE encoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can end its encoding. The tokens that match a suffix of the prefix come
from an automaton over the vocabulary; the one whose neighbour in the shorter prefix is compatible with it (the pair,
merged alone, stays that pair) is stored. Back-pointers from the whole word give the exact ids, in time linear in the
word, without replaying merges.

The normalizer and the splitting rule are read from the vocabulary file: NFC, white space to blanks, lower case, one
pattern whose matches are the words, bytes in their printable form, an end-of-word suffix, and added tokens that are
cut out of the raw text first.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.common import pieces, texts_of

#: Words (and as many blank-separated chunks) whose encodings a worker keeps; the store starts anew beyond that.
KEPT_WORDS = 250_000
#: Longer ones are encoded anew each time.
KEPT_LENGTH = 40

#: Number of ids, the ids in decimal joined by blanks, the tokens joined by blanks.
Encoded = tuple[int, str, str]
UNKNOWN: Encoded = (-1, "", "")


def printable_bytes() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class PrefixEncoder:
    """Encodes single words for one vocabulary of merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_suffix: str):
        self.end_suffix = end_suffix
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair], self.made[pair] = rank, whole
            self.parts.setdefault(whole, (*pair, rank))
        self.symbol = {token: i for token, i in vocab.items() if i not in self.parts}
        self.names = {i: token for token, i in vocab.items()}
        self.matcher = ahocorasick.Automaton()
        for i in vocab.values():
            leaves = self._leaves(i)
            if self._encodes_itself(i):
                self.matcher.add_word("".join(map(chr, leaves)), (len(leaves), i))
        self.matcher.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}

    def _leaves(self, i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            i = todo.pop()
            if i in self.parts:
                a, b, _ = self.parts[i]
                todo += (b, a)
            else:
                out.append(i)
        return out

    def _encodes_itself(self, i: int) -> bool:
        return i not in self.parts or self._compatible(*self.parts[i][:2], self.parts[i][2])

    def _compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether ``left`` then ``right`` would stay apart when their letters are merged by rank.

        The two tokens are taken apart from the inner ends, latest merge first: at each point, a merge across the border
        that comes before the merge undone there would have happened. ``limit``: only merges before this rank count.
        """
        bound = len(self.rank) if limit is None else limit
        while True:
            if self.rank.get((left, right), bound) < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # Equal ranks: merges run from the left, so the left token's inner merge is the earlier one.
            if b is None or (a is not None and a[2] > b[2]):
                bound, left = min(bound, a[2]), a[1]
            else:
                bound, right = min(bound, b[2] + 1), b[0]

    def fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        if (known := self._fits.get(pair)) is None:
            known = self._fits[pair] = self._compatible(left, right)
        return known

    def encode(self, word: str, names: list[str]) -> list[int]:
        """Ids of one word (not empty); ``names``: printable bytes."""
        letters = [names[b] for b in word.encode()]
        letters[-1] += self.end_suffix
        ids = [self.symbol[x] for x in letters]
        last = [0] * len(ids)  # of each prefix: its last token, and the length of that
        length = [0] * len(ids)
        for end, (size, token) in self.matcher.iter("".join(map(chr, ids))):
            if length[end]:
                continue  # found by a longer match
            start = end - size
            if start < 0 or self.fits(last[start], token):
                last[end], length[end] = token, size
        out, at = [], len(ids) - 1
        while at >= 0:
            out.append(last[at])
            at -= length[at]
        return out[::-1]


class TextEncoder:
    """Whole texts to ids, by the rules of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, split = rules["model"], rules["pre_tokenizer"]["pretokenizers"][0]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.words = PrefixEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.added = {x["content"]: x["id"] for x in rules["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.bytes = printable_bytes()
        self.kept: dict[str, Encoded] = {}
        self.chunks: dict[str, Encoded | None] = {}

    def _word(self, word: str) -> Encoded:
        ids = self.words.encode(word, self.bytes)
        found = len(ids), " ".join(map(str, ids)), " ".join(self.words.names[i] for i in ids)
        return keep(self.kept, word, found)

    def _chunk(self, chunk: str) -> Encoded | None:
        """Of a text without blanks and line feeds; None if it has no word."""
        kept = self.kept
        found = joined([kept.get(w) or self._word(w) for w in self.pattern.findall(self.normalized(chunk))])
        return keep(self.chunks, chunk, found)

    def normalized(self, text: str) -> str:
        """White space stays as it is: no word holds any, whatever it is replaced by."""
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # each letter on its own: no final form
            text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, text: str) -> Encoded:
        """Number of ids, the ids joined by blanks, and the decoded text (tokens joined by blanks)."""
        parts: list[Encoded] = []
        for piece in self.cut.split(text) if self.cut and "<" in text else [text]:
            if piece in self.added:
                parts.append((1, str(self.added[piece]), piece))
                continue
            chunks = self.chunks
            for chunk in piece.replace("\n", " ").split(" "):
                if chunk:
                    found = chunks.get(chunk, UNKNOWN)
                    if found is UNKNOWN:
                        found = self._chunk(chunk)
                    if found:
                        parts.append(found)
        return joined(parts) or (0, "", "")


def joined(parts: list[Encoded]) -> Encoded | None:
    if len(parts) < 2:
        return parts[0] if parts else None
    counts, ids, tokens = zip(*parts)
    return sum(counts), " ".join(ids), " ".join(tokens)


def keep(store: dict, key: str, value):
    if len(key) <= KEPT_LENGTH:
        if len(store) >= KEPT_WORDS:
            store.clear()
        store[key] = value
    return value


@lru_cache(maxsize=4)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns id, ``n_tokens``, ``ids`` (decimal, joined by one blank), ``decoded``. Null texts count as empty and give
    no ids and an empty decoded text; repeated rows give repeated results; an empty table gives no rows; other columns
    are not carried. ``vocabulary`` is a path that exists on every executor (the file is part of the installation,
    not of the data).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(vocabulary)
        for batch in pieces(batches, limit=4 << 20):
            found = [encoder.encode(x or "") for x in texts_of(batch)]
            counts, ids, decoded = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, n_tokens long, ids string, decoded string")
    return rows.withColumnRenamed("id", id_col)

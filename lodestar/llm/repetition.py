"""Quality rules from suffix arrays: how much of a text repeats itself.

The words of many texts are one integer array; its suffix array is built by prefix doubling, and only suffixes that
are still equal to another are sorted again. Ranks are kept per depth, so the longest common prefix of neighbours
comes from comparing ranks at falling depths. Runs of neighbours that share at least ``min_words`` words are the
longest-common-prefix intervals; their members' longest shared prefixes are the maximal repeated substrings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import pieces, texts_of

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    min_words: int = 8  #: shorter repeats don't count as repeats
    max_covered: float = 0.20  #: share of the words that repeats may cover
    max_longest: int = 50  #: words of the longest repeat


def spread(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any span [start, end)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:n]) > 0


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place in a sorted array, where its run of equal keys begins."""
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return np.repeat(first, np.diff(np.r_[first, len(sorted_keys)]))


def suffix_ranks(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; suffixes end with their text.

    ``text`` rises: suffixes of one text are neighbours, and those of different texts never rank equal. In the last
    array all ranks differ.
    """
    n = len(words)
    order = np.lexsort((words, text))
    rank = np.empty(n, np.int64)
    rank[order] = group_starts((text * (words.max(initial=0) + 1) + words)[order])
    ends = np.searchsorted(text, text, side="right")  # of each word's text
    levels, depth = [rank], 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(open_):
        after = open_ + depth
        follow = np.where(after < ends[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.lexsort((follow, rank[open_]))
        at, base, follow = open_[order], rank[open_][order], follow[order]
        key = base * (n + 1) + follow
        # A rank is the place of its group's first suffix: the group's own start, plus how far into it the key begins.
        starts = group_starts(key)
        rank = rank.copy()
        rank[at] = base + starts - group_starts(base)
        levels.append(rank)
        depth *= 2
        open_ = at[np.bincount(starts, minlength=len(at))[starts] > 1]
    return levels


def repeat_lengths(levels: list[np.ndarray], min_words: int) -> np.ndarray:
    """For each suffix the longest prefix it shares with another of its text, 0 if under ``min_words``."""
    n = len(levels[0])
    longest = np.zeros(n, np.int64)
    order = np.argsort(levels[-1])
    base = 1 << (min(len(levels), min_words.bit_length()) - 1)
    same = levels[base.bit_length() - 1]
    pair = np.flatnonzero(same[order[1:]] == same[order[:-1]])  # neighbours that share ``base`` words
    a, b = order[pair], order[pair + 1]
    i, j, shared = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        step = (inside & (levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)])) * (1 << level)
        i, j, shared = i + step, j + step, shared + step
    shared[shared < min_words] = 0
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    return longest


def repeated_windows(levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """Which words lie in a window of five words that its text holds twice or more."""
    n = len(text)
    if len(levels) < 3:  # no four words are found twice
        return np.zeros(n, bool)
    four = levels[2]
    start = np.flatnonzero(np.bincount(four, minlength=n)[four] > 1)
    start = start[start + 4 < n]
    start = start[text[start] == text[start + 4]]
    _, inverse, counts = np.unique(four[start] * (n + 1) + levels[0][start + 4], return_inverse=True, return_counts=True)
    start = start[counts[inverse] > 1]
    return spread(n, start, start + 5)


def measures(texts: list[str | None], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """One array per measure, one value per text."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    sizes, words = [], []
    chars, symbols, lines = [], [], []
    for x in texts:
        x = x or ""
        found = x.encode().split()  # splits at the six blanks only
        words += map(ids.__getitem__, found)
        sizes.append(len(found))
        chars.append(len(x) - sum(map(x.count, BLANKS)))
        symbols.append(sum(map(x.count, SYMBOLS)))
        held = [y for y in x.split("\n") if y.strip(BLANKS)]
        lines.append(len(held) - len(set(held)))
    n, sizes = len(texts), np.array(sizes, np.int64)
    word, text = np.array(words, np.int64), np.repeat(np.arange(n), sizes)
    if len(word):
        levels = suffix_ranks(word, text)
        length = repeat_lengths(levels, rules.min_words)
        start = np.flatnonzero(length)
        covered = np.bincount(text[spread(len(word), start, start + length[start])], minlength=n)
        repeated = np.bincount(text[repeated_windows(levels, text)], minlength=n)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, text, length)
    else:
        covered = repeated = longest = np.zeros(n, np.int64)
    failed = (sizes < 10) | (100 * repeated > 20 * sizes)
    kept = ~failed & (covered <= rules.max_covered * sizes) & (longest <= rules.max_longest)
    return {
        "n_words": sizes, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": repeated, "base_failed": failed, "kept": kept,
        "n_covered_words": covered, "longest_repeat": longest,
    }


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures and verdict of every whole text.

    Returns id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``,
    ``kept``, ``n_covered_words`` and ``longest_repeat``. Null and empty texts have no words and fail; repeated rows
    get equal results; an empty table gives no rows; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=4 << 20):
            found = measures(texts_of(batch), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["id", *found])

    kind = docs.schema[id_col].dataType.simpleString()
    shape = (
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
    )
    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, shape).withColumnRenamed("id", id_col)

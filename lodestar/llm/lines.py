"""Fuzzy line deduplication: min-max hashing of words, edit similarity, one occurrence for each connected group.

Two lines are linked if their normalised forms are equal, or if their words' edit similarity is high enough. Lines that
are similar share two thirds of their words or more, and so most likely a band of smallest and largest word hashes; lines
that share a band are candidates, and the edit similarity of their words decides. Words of very many lines don't count
in the bands: lines that share only those would be candidates. Lines that may differ by one edit share what is left
without one word.

SimHashes, by whose blocks such lines are usually found, lie as far apart for lines of 80 % edit similarity as 13 of 64
bits: blocks that find those also find most other pairs. README gives figures.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bucket_count, pieces, small_batches, staged, texts_of, tidy, tidy_group, unstage
from lodestar.llm.linking import DIFFERENCES, ORDERS, Compare, differences, link_buckets
from lodestar.llm.minhash import FACTORS, NAMES, band_keys, mixed
from lodestar.llm.suffix_dedup import cut, packed, squeezed, unpacked, unsqueezed

#: Bytes of normalised text: punctuation and blanks part words, line feeds stay.
NORMAL = bytes(32 if chr(b) in f"{string.punctuation}\t\r\x0b\x0c" else b for b in range(256))
#: Bytes of lines that are hashed together.
CHUNK_BYTES = 256 << 10
#: Text whose keys meet in one bucket.
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 12
#: A key that so many lines of one piece hold is exchanged by Spark's own rows, where hot keys are split.
HOT_IN_PIECE = 16
#: Distinct words that a task counts before it drops the rare ones.
MOST_WORDS = 50_000
WORD_BASE = 0x9E3779B97F4A7C15
#: Fields of ``linking.ORDERS``, and the columns of a comparison.
RUN = {"q": pa.int32(), "run": pa.int64(), "low": pa.int32(), "high": pa.int32(), "many": pa.int32(), "take": pa.int32(), "reach": pa.int32()}
RUNS = pa.list_(pa.struct(list(RUN.items())))


@dataclass(frozen=True)
class LineRules:
    """Lines are linked if 100 * edits <= (100 - ``percent``) * words of the longer line."""

    percent: int = 80
    permutations: int = 32
    rows: int = 4  #: values in a band
    common: float = 0.01  #: keys come from words that no larger share of the lines holds,
    few: float = 0.1  #: but from all words of lines with fewer of those (copies of a line that very many copy),
    some: float = 0.35  #: and from both where lines have fewer than this share
    least: int = 4  #: or this number

    #: Lines with the same words in another order are near, and not linked.
    ordered = True

    def edits(self, n):
        return n * (100 - self.percent) // 100

    def need(self, n, m):
        longer = np.maximum(n, m)
        return longer - self.edits(longer)

    def need_of(self, n: Column, m: Column) -> Column:
        longer = F.greatest(n, m)
        return longer - F.floor(longer * (100 - self.percent) / 100).cast("int")

    def run_of(self, longer: Column) -> Column:
        longest = F.floor(longer / (F.floor(longer * (100 - self.percent) / 100) + 1)).cast("int")
        return F.when(longest > 2, longest - 1).otherwise(longest)

    def least_of(self, n: Column) -> Column:
        return self.need_of(n, n)

    def possible(self, n: Column, m: Column) -> Column:
        return F.least(n, m) >= self.need_of(n, m)

    @property
    def shortest(self) -> int:
        """Words of the shortest line that may be linked to another one."""
        return next((n for n in range(1, 101) if self.edits(n + 1)), 101)


def run_length(longer: int, edits: int) -> int:
    """Words of the runs that two linked lines have in common: some of these are untouched by so many edits, and most often
    several, so that a run which very many lines have isn't looked up."""
    longest = longer // (edits + 1)
    return longest - 1 if longest > 2 else longest


def runs_of(words: list[bytes], rules: LineRules) -> list[tuple[int, int, int, int, int, int, int]]:
    """The fields of ``linking.ORDERS`` of a line: its runs of as many words as those of lines to which it may be linked need.

    Each edit touches ``q`` runs at most, so two lines of which the longer has n words share n - q + 1 - q * edits runs or
    more, each at most ``edits`` places apart. That many the line looks for less one may be left out."""
    n, out = len(words), []
    least: dict[int, int] = {}
    longer = n
    while longer - rules.edits(longer) <= n:
        edits = rules.edits(longer)
        q = run_length(longer, edits)
        shared = max(1, longer - q + 1 - q * edits)
        least[q] = min(least.get(q, shared), shared)
        longer += 1
    for q, shared in least.items():
        places: dict[int, list[int]] = {}
        for i in range(n - q + 1):
            places.setdefault(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + q])) - (1 << 63), []).append(i)
        out += [(q, run, at[0], at[-1], len(places), n - q + 2 - shared, rules.edits(longer - 1)) for run, at in places.items()]
    return out


def all_lines(texts: list[str | None]) -> tuple[list[bytes], list[int]]:
    """The lines of some texts, one text's after another's, and how many each text has: a line's words, in lower case, with one
    blank between."""
    bodies = [(text or "").lower().encode() for text in texts]
    data = np.frombuffer(b"\n".join(bodies).translate(NORMAL), np.uint8)
    blank = data == 32
    data = data[~(blank & np.r_[False, blank[:-1]][: len(data)])]  # one of neighbouring blanks stays
    return [line.strip(b" ") for line in data.tobytes().split(b"\n")], [body.count(b"\n") + 1 for body in bodies]


def normal_lines(text: str | None) -> list[bytes]:
    return all_lines([text])[0]


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``WORD_BASE`` and of its inverse (mod 2 ** 64)."""
    up, down = np.full(n, WORD_BASE, np.uint64), np.full(n, pow(WORD_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def bags(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each normalised line's words as distinct 64-bit elements (equal words are numbered), and how many there are."""
    values, sizes, first = [], [], 0
    while first < len(lines):
        last, held = first, 0
        while last < len(lines) and (last == first or held + len(lines[last]) < CHUNK_BYTES) and last - first < 1 << 16:
            held += len(lines[last]) + 1
            last += 1
        data = np.frombuffer(b" ".join(lines[first:last]) + b" ", np.uint8)
        up, down = powers(max(CHUNK_BYTES, 1 << len(data).bit_length()))
        ends = np.flatnonzero(data == 32)
        starts = np.r_[0, ends[:-1] + 1]
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
        upto = np.r_[np.uint64(0), sums]
        word = mixed((upto[ends] - upto[starts]) * down[starts])
        edges = np.cumsum([len(x) + 1 for x in lines[first:last]])
        count = np.diff(np.r_[0, np.searchsorted(ends, edges)])
        # One sort by line and word: 16 bits of line, 48 of word.
        both = np.sort(np.repeat(np.arange(last - first, dtype=np.uint64) << np.uint64(48), count) | word >> np.uint64(16))
        new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        place = np.arange(len(both)) - np.repeat(new, np.diff(np.r_[new, len(both)]))
        values.append(mixed((both & np.uint64((1 << 48) - 1)) + place.astype(np.uint64) * FACTORS[0]))
        sizes.append(count)
        first = last
    return np.concatenate([*values, np.zeros(0, np.uint64)]), np.concatenate([*sizes, np.zeros(0, np.int64)])


def word_edits(a: list, b: list) -> int:
    """Least insertions, deletions and replacements of words, all of a row of the table at once in one integer's bits."""
    first, last, least = 0, 0, min(len(a), len(b))
    while first < least and a[first] == b[first]:
        first += 1
    while last < least - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]  # what begins and ends both costs nothing
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = every, 0, len(a)
    for w in b:
        match = places.get(w, 0)
        straight = match | down
        level = (((match & up) + up) ^ up) | match
        more, less = down | (every & ~(level | up)), up & level
        edits += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (every & ~(straight | more)), more & straight
    return edits


def similar(a: list, b: list, most: int) -> bool:
    """Whether so many edits of words are enough; most often replacements at the same places are."""
    return len(a) == len(b) and sum(map(ne, a, b)) <= most or word_edits(a, b) <= most


def names_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the lines' 128-bit hashes."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def distinct_lines(batch: pa.RecordBatch, least: int) -> list[bytes]:
    """The distinct normalised lines of at least so many words."""
    return [x for x in dict.fromkeys(all_lines(texts_of(batch))[0]) if x.count(b" ") + 1 >= least and x]


class WordCounts:
    """In how many lines each word was seen, by lossy counting: a word that is dropped, as it was seen in less than the share
    ``slack`` of the lines, comes back as one that may have been seen that often. So no count is too low by more."""

    def __init__(self, slack: float):
        self.slack, self.lines = slack, 0
        self.words, self.counts, self.missed = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, values: np.ndarray, lines: int) -> None:
        own, n = np.unique(values, return_counts=True)
        at = np.minimum(np.searchsorted(self.words, own), max(0, len(self.words) - 1))
        known = self.words[at] == own if len(self.words) else np.zeros(len(own), bool)
        self.counts[at[known]] += n[known]
        words, counts = np.concatenate([self.words, own[~known]]), np.concatenate([self.counts, n[~known]])
        missed = np.concatenate([self.missed, np.full(len(words) - len(self.words), self.slack * self.lines)])
        self.lines += lines
        keep = counts + missed > self.slack * self.lines if len(words) > MOST_WORDS else np.ones(len(words), bool)
        words, counts, missed = words[keep], counts[keep], missed[keep]
        order = np.argsort(words)
        self.words, self.counts, self.missed = words[order], counts[order], missed[order]


def line_rows(docs: DataFrame, rules: LineRules, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``print`` (64-bit hash of the text), ``line`` (from 0), ``low``, ``high`` (the line's hash): lines with words.

    In the same pass all lines' words are counted: rows without ``print`` have an element of bags as ``low`` (null: all
    lines), and in ``high`` how many lines of a task hold it, if that is a tenth of the ``common`` share or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kind = WordCounts(rules.common / 10), None
        for batch in pieces(batches):
            every, counts = all_lines(texts_of(batch))
            held = np.flatnonzero(np.fromiter(map(len, every), np.int64, len(every)))
            if len(held):
                found = [every[k] for k in held.tolist()]
                at = np.repeat(np.arange(len(counts)), counts)[held]
                number = held - (np.cumsum(counts) - counts)[at]
                ids, prints = (batch.column(k).take(pa.array(at)) for k in range(2))
                low, high = names_of(found)
                yield pa.RecordBatch.from_arrays([ids, prints, pa.array(number, pa.int32()), pa.array(low), pa.array(high)], names)
                some, kind = [x for x in dict.fromkeys(found) if x.count(b" ") + 1 >= rules.shortest], ids.type
                seen.add(bags(some)[0], len(some))
        if seen.lines:
            many = seen.counts > seen.slack * seen.lines
            n = np.r_[seen.lines, seen.counts[many]]
            none = [pa.nulls(len(n), k) for k in (kind, pa.int64(), pa.int32())]
            told = pa.array(np.r_[0, seen.words[many].view(np.int64)], mask=np.arange(len(n)) == 0)
            yield pa.RecordBatch.from_arrays([*none, told, pa.array(n)], names)

    names = ["id", "print", "line", "low", "high"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, print long, line int, low long, high long")


def common_words(counts: DataFrame, rules: LineRules) -> np.ndarray:
    """The elements of bags (in order) that more than the ``common`` share of the lines holds.

    What a task left out makes a count too low by a fifth of the share at most. There are no more such words than lines
    have on average, divided by the share.
    """
    total = counts.where("low is null").agg(F.sum("high")).first()[0] or 0
    sums = counts.where("low is not null").groupBy("low").agg(F.sum("high").alias("n"))
    got = sums.where(F.col("n") > rules.common * total).select("low").collect()
    return np.sort(np.array([r["low"] for r in got], np.int64).view(np.uint64))


PACKED = {"bucket": pa.int64(), "keys": pa.binary(), "ids": pa.binary(), "sizes": pa.binary()}


def told_by(values: np.ndarray, sizes: np.ndarray, common: np.ndarray, rules: LineRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags from which keys are made: elements, how many of each bag, and the line of each bag (one or two of a line).

    Two similar lines have one kind of bag in common: their shares of rare words differ by less than ``some - few``.
    """
    line = np.repeat(np.arange(len(sizes)), sizes)
    rare = np.ones(len(values), bool)
    if len(common):
        # Few words have the first 16 bits of a common one; those alone are looked up.
        first = np.zeros(1 << 16, bool)
        first[common >> np.uint64(48)] = True
        maybe = np.flatnonzero(first[values >> np.uint64(48)])
        some = values[maybe]
        rare[maybe] = common[np.minimum(np.searchsorted(common, some), len(common) - 1)] != some
    left = np.bincount(line[rare], minlength=len(sizes))
    by_rare = (left > 0) & (left >= rules.few * sizes)
    by_all = ~by_rare | (left < sizes) & ((left < rules.some * sizes) | (left < rules.least))
    first, second = rare & by_rare[line], by_all[line]
    lines = np.concatenate([np.flatnonzero(by_rare), np.flatnonzero(by_all)])
    return np.concatenate([values[first], values[second]]), np.concatenate([left[by_rare], sizes[by_all]]), lines


def line_keys(values: np.ndarray, sizes: np.ndarray, rules: LineRules) -> np.ndarray:
    """One row of band keys for each bag, from 32 bits of each element; some bags at a time, as caches are small."""
    edges, short = np.r_[0, np.cumsum(sizes)], (values >> np.uint64(32)).astype(np.uint32)
    out, first = [np.zeros((0, 2 * rules.permutations // rules.rows), np.uint64)], 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + 50_000, side="right")) - 1)
        out.append(band_keys(short[edges[first] : edges[last]], edges[first:last] - edges[first], rules.permutations, rules.rows))
        first = last
    return np.concatenate(out)


def short_keys(lines: list[bytes], rules: LineRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines that may differ by one edit, which lines they are of, and which lines need other keys besides.

    Such a line's keys are itself and itself without each of its words: no two lines with one edit are without a common
    one, and hardly any others have one.
    """
    keys, owner, also = [], [], np.ones(len(lines), bool)
    for i, line in enumerate(lines):
        n = line.count(b" ") + 1
        if rules.edits(n) > 1 or rules.edits(n + 1) != 1:
            continue
        words = line.split(b" ")
        also[i] = any(rules.edits(m) > 1 and n >= m - rules.edits(m) for m in range(n + 1, 2 * n + 2))
        for k in range(n + 1):
            keys.append(xxhash.xxh3_64_intdigest(b" ".join(words[:k] + words[k + 1 :])))
            owner.append(i)
    return np.array(keys, np.uint64), np.array(owner, np.int64), also


def send_keys(lines: list[bytes], rules: LineRules, common: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of ``PACKED``: the keys of some lines by bucket, with the lines' ids (half of their hash) and words.

    A key that many of these lines hold is sent to a bucket below zero, where nobody waits for others of it, and leaves
    a mark (0 words) in its own.
    """
    values, sizes = bags(lines)
    less, short, also = short_keys(lines, rules)
    told, counts, line = told_by(values[np.repeat(also, sizes)], sizes[also], common, rules)
    keys = line_keys(told, counts, rules)
    key, owner = np.concatenate([keys.ravel(), less]), np.concatenate([np.repeat(np.flatnonzero(also)[line], keys.shape[1]), short])
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    ids = names_of(lines)[0]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.repeat(np.diff(np.r_[first, len(key)]) >= HOT_IN_PIECE, np.diff(np.r_[first, len(key)]))
    row = lambda bucket, k, i, n: (bucket, squeezed(packed(k)), packed(i), squeezed(packed(n.astype(np.uint32))))
    if many.any():
        yield row(-1 - int(ids[0]) % buckets, key[many], ids[owner[many]], sizes[owner[many]])
    marks = np.zeros(len(key), bool)
    marks[first] = many[first]
    stay = ~many | marks
    key, owner, words = key[stay], owner[stay], np.where(marks, 0, sizes[owner])[stay]
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    for k, part in cut(bucket):
        yield row(k, key[part], ids[owner[part]], words[part])


def find_shared(table: pa.Table, percent: int) -> pa.Table:
    """Lines of one bucket that share a key with a line of similar length: ``key``, ``id``, ``n`` (words).

    Lines of one key, by length, are parted where the next is too long for all before. Equal groups get equal keys.
    """
    kinds = (("keys", "u8"), ("ids", "i8"), ("sizes", "u4"))
    columns = [np.concatenate([unpacked(unsqueezed(x) if c != "ids" else x, k) for x in table.column(c).to_pylist()]) for c, k in kinds]
    key, ids, n = columns[0], columns[1], columns[2].astype(np.int64)
    if table.column("bucket")[0].as_py() >= 0:
        order = np.argsort(key)
        key, ids, n = key[order], ids[order], n[order]
        same = key[1:] == key[:-1]
        shared = np.r_[same, False] | np.r_[False, same] | (n == 0)
        key, ids, n = key[shared], ids[shared], n[shared]
        order = np.lexsort((ids, n, key))
        key, ids, n = key[order], ids[order], n[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]) | (n[1:] != n[:-1])][: len(key)]
        key, ids, n = key[fresh], ids[fresh], n[fresh]
        runs = np.r_[True, key[1:] != key[:-1]][: len(key)]
        hot = np.maximum.accumulate(np.where(runs, np.arange(len(key)), 0))
        hot = n[hot] == 0  # the mark comes first
        new = runs | np.r_[True, ~hot[1:] & (percent * n[1:] > 100 * n[:-1])][: len(key)]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        group = np.add.reduceat(mixed(ids.view(np.uint64)), first) if len(first) else key
        keep = (np.repeat(size > 1, size) | hot) & (n > 0)
        key = np.where(hot, key, np.repeat(group, size))[keep]
        ids, n = ids[keep], n[keep]
    return pa.table({"key": pa.array(key.view(np.int64)), "id": pa.array(ids), "n": pa.array(n.astype(np.int32))})


def bucket_members(docs: DataFrame, rules: LineRules, common: np.ndarray, text_col: str) -> DataFrame:
    """``key``, ``id``, ``n`` of lines that share a key with others."""
    buckets = bucket_count(docs, text_col, BUCKET_BYTES, LEAST_BUCKETS)
    told = docs.sparkSession.sparkContext.broadcast(common)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lines = distinct_lines(batch, rules.shortest)
            if lines:
                rows = zip(*send_keys(lines, rules, told.value, buckets))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, PACKED.values())], list(PACKED))

    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "bucket long, keys binary, ids binary, sizes binary")
    met = sent.repartition(buckets, "bucket").groupBy("bucket")
    return met.applyInArrow(tidy_group(lambda table: find_shared(table, rules.percent)), "key long, id long, n int").distinct()


def line_texts(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """``id`` (half of the line's hash), ``high`` (the other half), ``text``: normalised lines, distinct within each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lines = distinct_lines(batch, least)
            if lines:
                low, high = names_of(lines)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array([x.decode() for x in lines], pa.string())], ["id", "high", "text"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "id long, high long, text string")


def comparer(texts: DataFrame, rules: LineRules) -> Compare:
    """Compares pairs of lines of ``texts``: their words as bags, and if those are near, by edit similarity."""

    def run(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in pieces(pieces([batch], "x"), "y"):
                x, y = pair.column(2).to_pylist(), pair.column(3).to_pylist()
                at = {line: i for i, line in enumerate(dict.fromkeys([*x, *y]))}
                values, sizes = bags([line.encode() for line in at])

                def accept(near: np.ndarray) -> np.ndarray:
                    words = ((x[i].split(" "), y[i].split(" ")) for i in near.tolist())
                    return np.array([similar(a, b, rules.edits(max(len(a), len(b)))) for a, b in words], bool)

                hub, own = (np.array([at[line] for line in side], np.int64) for side in (x, y))
                linked, more = differences(values, np.r_[0, np.cumsum(sizes)], hub, own, rules, accept, whole)
                made = pa.RecordBatch.from_arrays([*pair.columns[:2], pa.array(linked), *more], ["a", "b", "linked", *NAMES[: len(more)]])
                yield made if whole else made.filter(made.column(2))

    def compare(pairs: DataFrame, whole: bool) -> DataFrame:
        first = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
        second = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
        shape = f"a long, b long, linked boolean{', ' + DIFFERENCES if whole else ''}"
        return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(tidy(lambda batches: run(batches, whole)), shape)

    return compare


def orders_of(texts: DataFrame, rules: LineRules) -> Callable[[DataFrame], DataFrame]:
    """Given ``b``, distinct ids of ``texts``, returns them with ``linking.ORDERS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces([batch]):
                runs = [[dict(zip(RUN, r)) for r in runs_of(line.encode().split(b" "), rules)] for line in texts_of(some)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(runs, RUNS)], ["b", "orders"])

    named = texts.select(F.col("id").alias("b"), "text")
    return lambda ids: named.join(ids, "b", "left_semi").select("b", "text").mapInArrow(tidy(run), f"b long, {ORDERS}")


def repeated_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``print`` (64-bit hash of the text) and ``removed``: the numbers of the lines that go, for each document
    that loses any.

    Of each connected group of lines the first occurrence (smallest id, then text hash, then line) stays. Lines without
    words stay and link with nothing. Rows with equal ids and texts are one document; null ids come first. An empty
    table, or one without repeated lines, gives no rows; other columns are not carried. Lines are told apart by 128-bit
    hashes; one that shares half of its hash with another line is only compared for equality.
    """
    small_batches(docs.sparkSession)  # pairs of very long lines come to Python with their texts
    found = staged(line_rows(docs, rules, id_col, text_col))
    common = common_words(found.where("print is null").select("low", "high"), rules)
    rows = found.where("print is not null")
    candidates = staged(bucket_members(docs, rules, common, text_col))
    ids = candidates.select("id").distinct()
    texts = line_texts(docs, text_col, rules.shortest).join(ids.hint("shuffle_hash"), "id", "left_semi").groupBy("id")
    texts = texts.agg(F.min("high").alias("high"), F.max("high").alias("other"), F.min("text").alias("text")).where("high = other")
    texts = staged(texts.drop("other"))
    labels = link_buckets(candidates, comparer(texts, rules), rules, orders_of(texts, rules))
    labels = labels.join(texts.select("id", "high"), "id").withColumnRenamed("id", "low")

    # Lines that come twice or have a component; of these alone the occurrences are put in order.
    name = ["low", "high"]
    twice = rows.groupBy(*name).agg(F.count("*").alias("times")).where("times > 1").select(*name)
    named = twice.join(labels, name, "full").select(*name, F.coalesce("component", "low").alias("group"), F.when(F.col("component").isNull(), F.col("high")).alias("alone"))
    place = F.struct("id", "print", "line")
    seen = staged(rows.join(named.hint("shuffle_hash"), name).select("id", "print", "line", "group", "alone"))
    stays = seen.groupBy("group", "alone").agg(F.min(place).alias("stays"))
    same = F.col("group") == F.col("g")
    stays = stays.select(F.col("group").alias("g"), F.col("alone").alias("a"), "stays")
    gone = seen.join(stays, same & F.col("alone").eqNullSafe(F.col("a"))).where(~place.eqNullSafe(F.col("stays")))
    out = gone.groupBy("id", "print").agg(F.sort_array(F.collect_set("line")).alias("removed")).withColumnRenamed("id", id_col)
    for table in (found, candidates, texts):
        unstage(table)
    return out


def with_removed(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text", print_col: str | None = None) -> DataFrame:
    """``docs`` and ``__removed``, the numbers of their repeated lines (null: none).

    Where ``docs`` has the texts' 64-bit hashes as ``print_col`` it needs no texts, which would be exchanged."""
    found = removed.select(F.col(id_col).alias("__id"), F.col("print").alias("__print"), F.col("removed").alias("__removed"))
    own = F.col(id_col).eqNullSafe(F.col("__id")) & ((F.col(print_col) if print_col else F.xxhash64(text_col)) == F.col("__print"))
    return docs.join(found, own, "left").drop("__id", "__print")


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the removed lines, in the same columns, plus ``lines_removed`` (how many)."""
    joined = with_removed(docs, removed, id_col, text_col)
    # The text is split outside of the function: what stands inside is computed again for each line.
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.array_size(lines) - 1), F.col("__removed"))
    stay = F.transform(F.array(F.split(text_col, "\n")), lambda lines: F.concat_ws("\n", F.transform(left(lines), lambda k: F.get(lines, k))))
    text = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.get(stay, F.lit(0)))
    counted = F.coalesce(F.array_size("__removed"), F.lit(0)).alias("lines_removed")
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), counted)

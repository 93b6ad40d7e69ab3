"""Removal of passages that an earlier document holds, by sparse suffix arrays in a logarithmic family of levels.

A window is a string of 50 bytes; a byte goes if a window that covers it also starts in a document with a smaller id.
Sorting every suffix of a corpus moves many times its size, so suffixes are sampled by content: of the 35 strings of
16 bytes in a window the one with the smallest hash is its anchor. Equal windows have equal anchors, wherever they
stand, and runs of neighbouring windows share one. Three passes over blocks of documents follow; one exchange of the
texts by block serves all of them.

1. Each block sends the sorted suffixes (to a depth of 16 bytes) at its anchors, each once, dealt out by hash. Where
   they meet, the blocks' suffix arrays enter a logarithmic family as batches: a batch is merge-scanned against the
   levels there are, what they lack becomes a new level, and levels of equal size merge. The family knows which
   anchors more than one document holds; blocks get that back, a byte for each anchor.
2. Blocks send the windows of such anchors, runs as one string, each string once from its first document. Where they
   meet, windows are compared by fingerprints of 128 bits, and those that a smaller document holds are sent back as
   spans. Anchors of very many documents (a licence line) send single windows, dealt out by their own fingerprints
   and each once a block, so that no key gathers more than one row from each block.
3. Blocks remove the spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import bucket_count, tidy_group

MATCH = 50  #: bytes of a window
DEPTH = 16  #: bytes of a sampled suffix
SPAN = MATCH - DEPTH + 1  #: suffixes in a window
BLOCK_BYTES = 6 << 20
#: Blocks whose suffixes meet in one bucket: rows sent are blocks times buckets, but never more than anchors.
BLOCKS_OF_BUCKET = 4
#: Blocks of small inputs, for the sake of parallel tasks.
LEAST_BLOCKS = 16
#: Texts that are hashed together.
CHUNK_BYTES = 48 << 10
#: Anchors that more documents hold are compared window by window, dealt out by window.
HOT_DOCUMENTS = 2000
MULTIPLIERS = (0xD6E8FEB86659FD93, 0x9E6C63D0876A9A47)
REPEATED, HOT = 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling(data: np.ndarray, size: int, multiplier: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on: strings are put together from pieces of doubling length."""
    piece, n = data.astype(np.uint64) + np.uint64(1), 1
    whole, held = None, 0
    while True:
        if size & n:
            if whole is None:
                whole, held = piece, n
            else:
                places = len(piece) - held
                whole = whole[:places] * np.uint64(pow(multiplier, n, 1 << 64)) + piece[held:]
                held += n
        if 2 * n > size:
            return mixed(whole[: len(data) - size + 1])
        piece = piece[: len(piece) - n] * np.uint64(pow(multiplier, n, 1 << 64)) + piece[n:]
        n *= 2


def sliding(pick: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """Smallest or largest of each ``size`` neighbours."""
    n = 1
    while 2 * n <= size:
        x = pick(x[:-n], x[n:])
        n *= 2
    rest = size - n
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def suffix_hashes(suffixes: np.ndarray) -> np.ndarray:
    """The hashes that ``rolling`` gives to these strings of 16 bytes."""
    data = np.frombuffer(suffixes.tobytes(), np.uint8).reshape(-1, DEPTH)
    total = np.zeros(len(data), np.uint64)
    for k in range(DEPTH):
        total = total * np.uint64(MULTIPLIERS[0]) + data[:, k] + np.uint64(1)
    return mixed(total)


class Block:
    """The documents of one block, in order of id and text, as one array of bytes."""

    def __init__(self, table: pa.Table):
        rows = pa.table({"id": table.column("id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min), "text": table.column("text").fill_null("")})
        order = pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("text", "ascending")])
        self.order = order.to_numpy().astype(np.int64)
        self.ids = rows.column("id").take(order).to_numpy()
        texts = rows.column("text").cast(pa.large_string()).take(order).combine_chunks()
        _, edges, body = texts.buffers()
        edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.body = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
        self.edges = edges - edges[0]

    def chunks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Some texts at a time: where they begin, suffix hashes, each window's smallest hash, whether it is a window.

        Windows that cross from one text to the next are none; their hashes are computed all the same.
        """
        first = 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.edges, self.edges[first] + CHUNK_BYTES, side="right")) - 1)
            begin, end = int(self.edges[first]), int(self.edges[last])
            if end - begin >= MATCH:
                hashes = rolling(self.body[begin:end], DEPTH, MULTIPLIERS[0])
                least = sliding(np.minimum, hashes, SPAN)
                steps = np.zeros(len(least) + 1, np.int8)
                for edge in (self.edges[first + 1 : last] - begin).tolist():
                    steps[min(len(least), max(0, edge - MATCH + 1))] += 1
                    steps[min(len(least), edge)] -= 1
                yield begin, hashes, least, np.cumsum(steps[:-1]) == 0
            first = last

    def suffix_arrays(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct suffixes at anchors by bucket and then in order: bucket, suffix, documents that hold it."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for begin, hashes, least, real in self.chunks():
            # A place is an anchor if some window's smallest hash is its own.
            most = np.full(len(hashes) + SPAN - 1, 0, np.uint64)
            most[SPAN - 1 : SPAN - 1 + len(least)] = np.where(real, least, 0)
            place = np.flatnonzero(sliding(np.maximum, most, SPAN)[: len(hashes)] == hashes)
            found.append((hashes[place], begin + place))
        value, place = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(value, kind="stable")
        value, place = value[order], place[order]
        # a suffix counts once for each id
        owner = self.ids[np.searchsorted(self.edges, place, side="right") - 1]
        first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]][: len(value)])
        fresh = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])][: len(value)]
        documents = np.add.reduceat(fresh, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32)
        value, place = value[first], place[first]
        bucket = (value % np.uint64(buckets)).astype(np.int64)
        words = np.ascontiguousarray(self.body[place[:, None] + np.arange(DEPTH)]).view(">u8").astype(np.uint64)
        order = np.lexsort((words[:, 1], words[:, 0], bucket)) if len(words) else place
        return bucket[order], words[order].astype(">u8").view(f"S{DEPTH}").ravel(), documents[order]

    def runs(self, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows with one of these (sorted) anchors: its hash, row, first window (in the body), windows, and a
        fingerprint of the run's string (0 for long runs)."""
        found: list[tuple[np.ndarray, ...]] = []
        for begin, _, least, real in self.chunks():
            first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (real[1:] != real[:-1])])
            windows = np.diff(np.r_[first, len(least)])
            at = np.minimum(np.searchsorted(repeated, least[first]), len(repeated) - 1)
            good = real[first] & (repeated[at] == least[first])
            if not good.any():
                continue
            first, windows = first[good], windows[good]
            prints = rolling(self.body[begin : begin + len(least) + MATCH - 1], MATCH, MULTIPLIERS[0])
            # the first and the last window cover the string of a run of up to 51 windows
            whole = mixed(mixed(prints[first]) * np.uint64(3) + prints[first + windows - 1] + windows.astype(np.uint64))
            found.append((least[first], begin + first, windows, np.where(windows <= MATCH, whole, np.uint64(0))))
        value, first, windows, whole = (
            (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, k) for k in (np.uint64, np.int64, np.int64, np.uint64))
        )
        row = np.searchsorted(self.edges, first, side="right") - 1
        # Equal edges (empty texts) and runs never meet: a run lies in a text of 50 bytes or more. A run that goes on from
        # one text to the next is cut by the windows between, which are none.
        return value, row, first, windows, whole

    def strings(self, first: np.ndarray, sizes: np.ndarray) -> bytes:
        start = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return self.body[start + np.arange(len(start))].tobytes()


class LevelFamily:
    """Sorted arrays of geometrically growing sizes that together hold every suffix once, with its documents."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def append(self, suffixes: np.ndarray, documents: np.ndarray) -> None:
        """A new batch (sorted, distinct): scanned against every level; what none holds becomes a level."""
        new = np.ones(len(suffixes), bool)
        for level, totals in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            match = level[at] == suffixes
            totals[at[match]] += documents[match]
            new &= ~match
        if not new.any():
            return
        self.levels.append((suffixes[new], documents[new].astype(np.int64)))
        while len(self.levels) > 1 and len(self.levels[-1][0]).bit_length() >= len(self.levels[-2][0]).bit_length():
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, totals = np.concatenate([a, b]), np.concatenate([x, y])
            order = np.argsort(both, kind="stable")
            self.levels.append((both[order], totals[order]))

    def totals(self, suffixes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(suffixes), np.int64)
        for level, totals in self.levels:
            at = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            match = level[at] == suffixes
            out[match] = totals[at[match]]
        return out


def packed(x: np.ndarray) -> bytes:
    """Numbers as bytes: all first bytes, then all second bytes, and so on, which compresses well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def squeezed(x: bytes) -> bytes:
    """Text compresses better this way than by the shuffle's own codec."""
    return zstandard.ZstdCompressor(level=1).compress(x)


def unsqueezed(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).view(kind).ravel()


def cut(sorted_keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal keys."""
    edges = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1], True]) if len(sorted_keys) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(sorted_keys[a]), slice(int(a), int(b))


def send_suffixes(table: pa.Table, buckets: int) -> pa.Table:
    block = table.column("block")[0].as_py()
    bucket, suffix, documents = Block(table).suffix_arrays(buckets)
    rows = [(k, block, squeezed(suffix[part].tobytes()), packed(documents[part])) for k, part in cut(bucket)]
    return as_table(rows, ("bucket", "block", "suffixes", "documents"), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))


def as_table(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def find_repeated(table: pa.Table) -> pa.Table:
    """For each block of a bucket: the hashes of its suffixes that more than one document holds, and codes for them."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "suffixes", "documents"))))
    rows = [(block, np.frombuffer(unsqueezed(suffixes), f"S{DEPTH}"), documents) for block, suffixes, documents in rows]
    family = LevelFamily()
    for _, suffixes, documents in rows:
        family.append(suffixes, unpacked(documents, "u4"))
    out = []
    for block, suffixes, _ in rows:
        totals = family.totals(suffixes)
        many = totals > 1
        if many.any():
            codes = np.where(totals[many] > HOT_DOCUMENTS, HOT, REPEATED).astype(np.uint8)
            out.append((block, packed(suffix_hashes(suffixes[many])), packed(codes)))
    return as_table(out, ("block", "hashes", "codes"), (pa.int64(), pa.binary(), pa.binary()))


WINDOWS = "bucket long, block long, kind int, documents binary, rows binary, firsts binary, sizes binary, strings binary"
RUNS, SINGLE, DECIDED = 0, 1, 2


def fingerprints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rolling(data, MATCH, MULTIPLIERS[0]), rolling(data, MATCH, MULTIPLIERS[1])


def send_windows(table: pa.Table, replies: pa.Table, finer: int) -> pa.Table:
    """Windows with repeated anchors; spans that the block can decide by itself go along (kind DECIDED)."""
    names = [part.split()[0] for part in WINDOWS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
    if not table.num_rows or not replies.num_rows:
        return as_table([], names, kinds)
    block, held = table.column("block")[0].as_py(), Block(table)
    repeated, codes = (np.concatenate([unpacked(x, k) for x in replies.column(c).to_pylist()]) for c, k in (("hashes", "u8"), ("codes", "u1")))
    order = np.argsort(repeated)
    repeated, codes = repeated[order], codes[order]
    value, row, first, windows, whole = held.runs(repeated)
    hot = codes[np.searchsorted(repeated, value)] == HOT
    sizes = windows + MATCH - 1
    rows: list[tuple] = []
    decided: list[np.ndarray] = []  # row, first byte, end

    # Of equal strings the one in the smallest document goes; larger documents lose theirs at once.
    cold = np.flatnonzero(~hot)
    order = cold[np.argsort(whole[cold], kind="stable")]
    new = np.r_[True, (whole[order][1:] != whole[order][:-1]) | (whole[order][1:] == 0)][: len(order)]
    begin = np.flatnonzero(new)
    owner = np.repeat(held.ids[row[order[begin]]], np.diff(np.r_[begin, len(order)]))
    later = held.ids[row[order]] > owner
    gone = order[later]
    decided.append(np.stack([row[gone], first[gone], first[gone] + sizes[gone]]))
    sent = np.sort(order[~later])
    to = (value[sent] % np.uint64(finer)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for k, part in cut(to[order]):
        x = sent[order[part]]
        strings = squeezed(held.strings(first[x], sizes[x]))
        rows.append((k, block, RUNS, packed(held.ids[row[x]]), packed(row[x]), packed(first[x]), packed(sizes[x]), strings))

    hot = np.flatnonzero(hot)
    if len(hot):
        start = np.cumsum(windows[hot]) - windows[hot]
        step = np.arange(windows[hot].sum()) - np.repeat(start, windows[hot])
        body = np.frombuffer(held.strings(first[hot], sizes[hot]), np.uint8)
        inside = np.repeat(np.cumsum(sizes[hot]) - sizes[hot], windows[hot]) + step
        high, low = (x[inside] for x in fingerprints(body))
        row, first = np.repeat(row[hot], windows[hot]), np.repeat(first[hot], windows[hot]) + step
        order = np.lexsort((first, row, low, high))
        high, low, row, first = high[order], low[order], row[order], first[order]
        begin = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        owner = np.repeat(held.ids[row[begin]], np.diff(np.r_[begin, len(high)]))
        later = held.ids[row] > owner
        decided.append(np.stack([row[later], first[later], first[later] + MATCH]))
        high, low, row, first = high[~later], low[~later], row[~later], first[~later]
        to = (low % np.uint64(finer)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for k, part in cut(to[order]):
            x = order[part]
            rows.append((k, block, SINGLE, packed(held.ids[row[x]]), packed(row[x]), packed(first[x]), packed(high[x]), packed(low[x])))
    row, first, end = np.concatenate(decided, axis=1)
    if len(row):
        rows.append((block % finer, block, DECIDED, b"", packed(row), packed(first), packed(end), b""))
    return as_table(rows, names, kinds)


def find_spans(table: pa.Table) -> pa.Table:
    """Spans of windows that a smaller document holds, by block. Places count from the beginning of the block."""
    out: list[tuple] = []
    block, document, first, high, low = [], [], [], [], []
    names = ("block", "kind", "documents", "rows", "firsts", "sizes", "strings")
    for at, kind, documents, rows, firsts, sizes, strings in sorted(zip(*(table.column(c).to_pylist() for c in names))):
        if kind == DECIDED:
            out.append((at, firsts, sizes))
            continue
        documents, firsts = unpacked(documents, "i8"), unpacked(firsts, "i8")
        if kind == SINGLE:
            a, b = unpacked(sizes, "u8"), unpacked(strings, "u8")
        else:
            sizes = unpacked(sizes, "i8")
            windows = sizes - MATCH + 1
            begins = np.cumsum(sizes) - sizes
            step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            start = np.repeat(begins, windows) + step
            a, b = (x[start] for x in fingerprints(np.frombuffer(unsqueezed(strings), np.uint8)))
            documents, firsts = np.repeat(documents, windows), np.repeat(firsts, windows) + step
        for column, x in zip((block, document, first, high, low), (np.full(len(a), at), documents, firsts, a, b)):
            column.append(x)
    if block:
        block, document, first, high, low = map(np.concatenate, (block, document, first, high, low))
        order = np.argsort(high)
        same = high[order][1:] == high[order][:-1]
        if (same & (low[order][1:] != low[order][:-1])).any():  # two strings share one half of their fingerprints
            order = np.lexsort((low, high))
            same = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
        starts = np.flatnonzero(np.r_[True, ~same])
        owner = np.empty_like(document)
        owner[order] = np.repeat(np.minimum.reduceat(document[order], starts), np.diff(np.r_[starts, len(order)]))
        later = np.flatnonzero(document > owner)
        block, document, first = block[later], document[later], first[later]
        # neighbouring windows of one document, as they came, make one span
        fresh = np.r_[True, (block[1:] != block[:-1]) | (document[1:] != document[:-1]) | (first[1:] != first[:-1] + 1)][: len(block)]
        begin = np.flatnonzero(fresh)
        ends = first[np.r_[begin[1:], len(first)] - 1] + MATCH if len(begin) else first
        block, first = block[begin], first[begin]
        out += [(k, packed(first[part]), packed(ends[part])) for k, part in cut(block)]
    return as_table(out, ("block", "firsts", "ends"), (pa.int64(), pa.binary(), pa.binary()))


def remove_spans(table: pa.Table, spans: pa.Table, decoded: bool = False) -> pa.Table:
    """The block's rows, with kept bytes (``decoded``: as strings) and removed spans."""
    held = Block(table)
    first, end = (np.concatenate([np.zeros(0, np.int64), *(unpacked(x, "i8") for x in spans.column(c).to_pylist())]) for c in ("firsts", "ends"))
    # Spans of one text that touch or overlap become one; none crosses from one text to the next.
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    owner = np.searchsorted(held.edges, first, side="right") - 1
    fresh = np.r_[True, (first[1:] > reach[:-1]) | (owner[1:] != owner[:-1])][: len(first)]
    begin = np.flatnonzero(fresh)
    first, owner = first[begin], owner[begin]
    end = reach[np.r_[begin[1:], len(reach)] - 1] if len(begin) else reach
    pairs = np.stack([first, end], axis=1) - held.edges[owner][:, None]
    cuts = np.searchsorted(owner, np.arange(len(held.ids) + 1))
    kept: list[bytes] = [b""] * len(held.ids)
    removed: list[np.ndarray] = [pairs[:0].ravel()] * len(held.ids)
    body, edges = memoryview(held.body), held.edges.tolist()
    for k, i in enumerate(held.order.tolist()):
        gone = pairs[cuts[k] : cuts[k + 1]].ravel()
        stay = np.r_[0, gone, edges[k + 1] - edges[k]].reshape(-1, 2) + edges[k]
        kept[i] = b"".join(body[a:b] for a, b in stay.tolist())
        removed[i] = gone
    sizes = np.empty(len(held.ids), np.int64)
    sizes[held.order] = np.diff(held.edges)
    table = table.drop_columns(["block", "text"])
    table = table.append_column("n_bytes", pa.array(sizes))
    table = table.append_column("kept", pa.array([as_string(b) for b in kept], pa.string()) if decoded else pa.array(kept, pa.binary()))
    return table.append_column("removed", pa.array(removed, pa.list_(pa.int64())))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), decoded: bool = False) -> DataFrame:
    """Remove from every text the bytes of 50-byte strings that start in a document with a smaller id.

    Returns the id, the ``carry`` columns, ``n_bytes`` (of the whole text), ``kept`` (the remaining bytes) and
    ``removed`` (maximal removed spans: begin and end in turn); ``decoded`` gives ``kept`` as ``as_text`` does, without
    another pass through Python workers. Null texts count as empty. Rows with equal ids don't
    remove from each other; null ids count as smaller than all others. An empty table gives no rows. Ids are integers:
    their order decides.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is no integer column")
    blocks = bucket_count(docs, text_col, BLOCK_BYTES, LEAST_BLOCKS)
    finer = 4 * blocks
    buckets = -(-blocks // BLOCKS_OF_BUCKET)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).alias("block"),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)),
    ).repartition(blocks, "block")
    by_block = texts.groupBy("block")

    def deal_suffixes(table: pa.Table) -> pa.Table:
        return send_suffixes(table, buckets)

    def deal_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        return send_windows(table, replies, finer)

    def remaining(table: pa.Table, spans: pa.Table) -> pa.Table:
        return remove_spans(table, spans, decoded)

    suffixes = by_block.applyInArrow(tidy_group(deal_suffixes), "bucket long, block long, suffixes binary, documents binary")
    replies = suffixes.groupBy("bucket").applyInArrow(tidy_group(find_repeated), "block long, hashes binary, codes binary")
    windows = by_block.cogroup(replies.groupBy("block")).applyInArrow(tidy_group(deal_windows), WINDOWS)
    spans = windows.groupBy("bucket").applyInArrow(tidy_group(find_spans), "block long, firsts binary, ends binary")
    shape = "".join(f", carry_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    shape = f"id {id_type}{shape}, n_bytes long, kept {'string' if decoded else 'binary'}, removed array<bigint>"
    out = by_block.cogroup(spans.groupBy("block")).applyInArrow(tidy_group(remaining), shape)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"carry_{i}", c)
    return out.withColumnRenamed("id", id_col)


def as_string(kept: bytes) -> str:
    return bytes(kept).decode("utf-8", "ignore")


def as_text(kept: str) -> Column:
    """Kept bytes as a string; bytes of characters that were cut in two are left out."""

    @F.pandas_udf("string")
    def decoded(x: pd.Series) -> pd.Series:
        return x.map(as_string, na_action="ignore")

    return decoded(F.col(kept))

"""similarity and ranking (JON-18, JON-19, FUN-16 to FUN-19, DOM-05 to DOM-10, SRT-03 to SRT-05, WIN-09, AGG-12 to AGG-16).

A reference entity is one row; joining it to all others is a broadcast of that row, never a product of two tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors
from lodestar.operators.stats import with_z_scores


def with_seed(df: DataFrame, seed: DataFrame) -> DataFrame:
    """Every row beside the seed's columns; ``seed`` has one row (JON-18)."""
    return df.crossJoin(F.broadcast(seed.limit(1)))


def cosine_to(df: DataFrame, id_col: str, vector: str, ref) -> DataFrame:
    """``cosine`` of every row's vector to the reference's (JON-19, FUN-18)."""
    seed = df.where(F.col(id_col) == ref).select(F.col(vector).alias("__seed"))
    return with_seed(df, seed).withColumn("cosine", vectors.cosine(F.col(vector), F.col("__seed"))).drop("__seed")


def top(df: DataFrame, score: str, id_col: str, k: int) -> DataFrame:
    """The k best rows, ties by id (SRT-03)."""
    return df.orderBy(F.desc(score), id_col).limit(k)


def fuse(df: DataFrame, groups: dict[str, Sequence[str]], weights: dict[str, float], score: str = "score") -> DataFrame:
    """Weighted sum of standardised signals (DOM-06).

    A group's weight is shared by those of its signals that have any value; a row's missing signal counts 0.
    """
    signals = [s for members in groups.values() for s in members]
    z = with_z_scores(df, signals)
    present = {s: F.when(F.col(f"z_{s}").isNotNull(), 1).otherwise(0) for s in signals}
    spoke = df.agg(*(F.max(F.when(F.col(s).isNotNull(), 1).otherwise(0)).alias(f"__any_{s}") for s in signals))
    z = z.crossJoin(F.broadcast(spoke))  # one row
    parts = []
    for group, members in groups.items():
        speaking = reduce(lambda a, b: a + b, (F.col(f"__any_{s}") for s in members))
        total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"z_{s}"), F.lit(0.0)) * present[s] for s in members))
        parts.append(F.coalesce(F.try_divide(F.lit(weights.get(group, 0.5)), speaking) * total, F.lit(0.0)))
    return z.withColumn(score, reduce(lambda a, b: a + b, parts)).drop(*(f"__any_{s}" for s in signals))


def strongest(signals: dict[str, Column], least: float = 0.5, k: int = 4) -> Column:
    """Names of up to k signals above ``least``, strongest first (SRT-05)."""
    pairs = F.array(*(F.struct((-c).alias("order"), F.lit(n).alias("name")) for n, c in signals.items()))
    kept = F.filter(pairs, lambda x: x["order"] < -least)
    return F.transform(F.slice(F.array_sort(kept), 1, k), lambda x: x["name"])


def weighted_distance(terms: Sequence[tuple[Column, Column]], penalties: Sequence[tuple[Column, Column]] = ()) -> tuple[Column, Column, Column]:
    """Root of the weighted mean of squared distances, the number of signals, and the similarity in percent (DOM-05).

    ``terms``: weight and distance; a null distance is a signal that has no opinion. ``penalties`` weigh in without
    counting as signals.
    """
    zero = F.lit(0.0)
    squared = lambda pairs: [F.when(d.isNotNull(), w * d * d).otherwise(zero) for w, d in pairs]
    weighed = lambda pairs: [F.when(d.isNotNull(), w).otherwise(zero) for w, d in pairs]
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    mean = F.try_divide(add(squared(terms) + squared(penalties)), add(weighed(terms) + weighed(penalties)))
    common = add([F.when(d.isNotNull(), 1).otherwise(0) for _, d in terms])
    return F.sqrt(mean), common, 100 * (1 - F.least(F.lit(1.0), F.sqrt(mean)))


def first_of_key(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The best row of each song or recording key (WIN-09, SRT-04)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def tag_overlap(tags: DataFrame, id_col: str, tag: str, weight: str, ref) -> DataFrame:
    """shared / (reference's sum + own sum - shared) over tags; shared counts the candidate's weights (FUN-17, AGG-15).

    Only tags of the reference are joined: an inverted index by way of a join on the tag.
    """
    sums = tags.groupBy(id_col).agg(F.sum(weight).alias("own"))
    mine = tags.where(F.col(id_col) == ref).select(tag, F.lit(1).alias("__mine"))
    reference = tags.where(F.col(id_col) == ref).agg(F.sum(weight).alias("ref_sum"))
    shared = tags.join(mine, tag).groupBy(id_col).agg(F.sum(weight).alias("shared"))
    joined = sums.join(shared, id_col, "left").crossJoin(F.broadcast(reference))  # one row
    both = F.coalesce("shared", F.lit(0.0))
    return joined.select(id_col, F.coalesce(F.try_divide(both, F.col("ref_sum") + F.col("own") - both), F.lit(0.0)).alias("overlap"))


def pair_jaccard(weights: DataFrame, id_col: str, key: str, weight: str, refs: DataFrame, salts: int = 16, digits: int | None = None) -> DataFrame:
    """Weighted Jaccard of each reference (``refs``: its ids) and every other entity with a common key (FUN-16,
    AGG-13): sum of minima over the sum of both less the minima, to ``digits`` as ``scores.rounded`` has it. ``weights`` has
    a key of an entity once.

    Entities are one row each, dealt over ``salts`` blocks or more; references and entities meet in blocks, a task each, so
    what is exchanged are entities and not pairs, and a key that all have is many tasks. The rows of the result are
    references times entities by nature. Those of a task stand by their score: equal scores in a row take next to nothing
    in a column file, and ids take the bits that tell the members of one block apart."""
    known, kind = F.col(id_col).isNotNull(), weights.schema[id_col].dataType.simpleString()
    item = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.col(weight).cast("double").alias("w")))
    entities = weights.where(known).groupBy(F.col(id_col).alias("id")).agg(F.sum(weight).cast("double").alias("total"), F.collect_list(item).alias("items"))
    asked = entities.join(refs.select(F.col(id_col).alias("id")), "id", "left_semi")
    n, size = weights.where(known).agg(F.countDistinct(id_col), F.count("*")).first()
    each = max(1, min(PAIR_BLOCK, BLOCK_WEIGHTS * n // max(1, size)))
    nq, nv = max(1, -(-refs.count() // each)), max(salts, -(-n // each))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("*", F.lit(True).alias("asked"), dealt(nq).alias("qb"), to_all(nv).alias("vb"))
    every = entities.select("*", F.lit(False).alias("asked"), dealt(nv).alias("vb"), to_all(nq).alias("qb"))
    met = asked.unionByName(every).withColumn("block", F.col("qb") * nv + F.col("vb")).drop("qb", "vb")
    met = met.repartitionById(nq * nv, "block").groupBy("block")
    return met.applyInArrow(_block_jaccard(digits), f"ref {kind}, id {kind}, jaccard double").withColumnRenamed("id", id_col)


#: Members of a block, which hashes deal: few enough that it stays below 4,096, whose places take 12 bits; about the most
#: weights of a block; references whose sums with it are made at once, and rows that leave a task at once (in cache).
PAIR_BLOCK, BLOCK_WEIGHTS, REFS_AT_ONCE, PAIRS_AT_ONCE = 3900, 1 << 19, 16, 1 << 16


def _block_jaccard(digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of one block of references and one of entities, by score: 17 bytes a pair are held."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        sides = [rows.filter(pc.equal(rows.column("asked"), asked)) for asked in (True, False)]
        ids = [side.column("id").combine_chunks() for side in sides]
        n, width = len(ids[0]), len(ids[1])
        held, order, size = np.empty((n, width)), np.empty(n * width, np.uint64), 0
        unknown = np.zeros((n, width), bool)
        itself = pc.index_in(ids[0], value_set=ids[1])
        for low, score, none, common in _scores(*sides):
            own = itself.slice(low, len(score))
            common[own.is_valid().to_numpy(zero_copy_only=False), own.drop_null().to_numpy(zero_copy_only=False)] = False
            held[low : low + len(score)] = score if digits is None else _rounded(score, digits)
            unknown[low : low + len(score)] = none
            found = np.flatnonzero(common)
            # the score's leading bits, whose equals stand together in any order, then the pair's place
            leading = held[low : low + len(score)].ravel()[found].astype(np.float32).view(np.uint32).astype(np.uint64)
            order[size : size + len(found)] = leading << np.uint64(32) | (found + low * width).astype(np.uint64)
            size += len(found)
        order, some = order[:size], unknown.any()
        order.sort()
        for low in range(0, size, PAIRS_AT_ONCE):
            at = (order[low : low + PAIRS_AT_ONCE] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            one = at // width
            score = pa.array(held.ravel()[at], mask=unknown.ravel()[at] if some else None)
            yield pa.RecordBatch.from_arrays([ids[0].take(pa.array(one)), ids[1].take(pa.array(at - one * width)), score], ["ref", "id", "jaccard"])

    return pairs


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """``scores.rounded`` of an array: halves away from zero, by the scaled value alone."""
    x = x * 10.0**digits
    whole = np.trunc(x)
    x -= whole
    whole += np.trunc(x + x)
    return whole / 10.0**digits + 0.0  # no negative zero


def _scores(asked: pa.Table, every: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Some references at a time: the first one's place, their scores with all entities, which of those are null, and which
    pairs have a common key."""
    totals, summed, owners, keys, weighs, told = [], [], [], [], [], []
    for side in (asked, every):
        items = side.column("items").combine_chunks()
        flat = items.flatten()
        totals.append(side.column("total").to_numpy())
        summed.append(side.column("total").is_valid().to_numpy())
        owners.append(np.repeat(np.arange(len(items)), items.value_lengths().to_numpy(zero_copy_only=False)))
        keys.append(flat.field("key"))
        weighs.append(flat.field("w").to_numpy(zero_copy_only=False))
        told.append(flat.field("w").is_valid().to_numpy(zero_copy_only=False))
    codes = pa.concat_arrays(keys).dictionary_encode().indices.to_numpy()
    key, other = codes[: len(owners[0])], codes[len(owners[0]) :]
    order = np.argsort(other, kind="stable")
    edges = np.searchsorted(other[order], np.arange(codes.max(initial=-1) + 2))
    n, width, whole = len(totals[0]), len(totals[1]), all(t.all() for t in told)
    for low in range(0, n, REFS_AT_ONCE):
        size = min(REFS_AT_ONCE, n - low)
        both, common = np.zeros((size, width)), np.zeros((size, width), bool)
        some = common if whole else np.zeros((size, width), bool)
        here = np.arange(*np.searchsorted(owners[0], (low, low + size)))
        here = here[np.argsort(key[here], kind="stable")]
        for mine in np.split(here, np.flatnonzero(np.diff(key[here])) + 1) if len(here) else ():
            theirs = order[edges[key[mine[0]]] : edges[key[mine[0]] + 1]]
            # owners stand in order: a key that all have meets without looking places up
            at = np.s_[:, :] if (len(mine), len(theirs)) == (size, width) else np.ix_(owners[0][mine] - low, owners[1][theirs])
            least = np.fmin(weighs[0][mine][:, None], weighs[1][theirs])
            if not whole:  # a missing weight is no minimum
                given = told[0][mine][:, None] | told[1][theirs]
                least = np.where(given, least, 0.0)
                some[at] |= given
            both[at] += least
            common[at] = True
        most = totals[1] + totals[0][low : low + size, None] - both
        none = ~(some & summed[1] & summed[0][low : low + size, None]) | (most == 0)
        yield low, both / np.where(none, 1.0, most), none, common


def rank_summary(firsts: DataFrame, depth: int, signal: str) -> DataFrame:
    """Recall at ``depth`` and mean reciprocal rank of the first sibling of each query (DOM-09, AGG-29, WIN-05): rows of
    ``signal`` and ``rank``, where null is not found (rank a million)."""
    rank = F.coalesce("rank", F.lit(1_000_000))
    return firsts.groupBy(signal).agg(
        F.count("*").alias("queries"),
        F.round(F.avg((rank <= depth).cast("double")), 6).alias("recall"),
        F.round(F.avg(1 / rank), 6).alias("mrr"),
    )


#: Queries and rows of one block product, and the last place that counts as found.
QUERY_BLOCK, ROW_BLOCK, LAST_PLACE = 1024, 4096, 2000

Signal = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sibling_ranks(queries: DataFrame, rows: DataFrame, id_col: str, label_col: str, vector_col: str, signals: dict[str, Signal], digits: int = 9) -> DataFrame:
    """Rank of the first other row of its label for each query and signal (DOM-09, WIN-05): ``query``, ``signal``, ``rank``.

    Higher scores come first, equal ones (to ``digits``) by smaller id; a place beyond 2,000 is null. A signal scores a matrix
    of queries with one of rows. Queries and rows meet in blocks: a row is copied once for each block of queries and a
    query once for each block of rows. The first pass leaves the best sibling of each block, the second counts the rows
    before the best of all: no scores leave the tasks. Rows without vector or label take no part."""
    usable = F.col(vector_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    vector = F.transform(vector_col, lambda x: x.cast("double"))
    packed = lambda df: df.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("x"))
    asked, every, names = packed(queries), packed(rows), list(signals)
    blocks = lambda df, size: max(1, -(-df.count() // size))
    nq, nv = blocks(asked, QUERY_BLOCK), blocks(every, ROW_BLOCK)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("*", dealt(nq).alias("qb"), to_all(nv).alias("vb"))
    every = every.select("*", dealt(nv).alias("rvb"), to_all(nq).alias("rqb"))
    matrix = lambda column: np.array(column.combine_chunks().flatten()).reshape(len(column), -1)

    def scored(one: pa.Table, other: pa.Table):
        other = other.sort_by("id")
        q, x, ids = matrix(one.column("x")), matrix(other.column("x")), other.column("id").to_numpy()
        own = one.column("id").to_numpy()[:, None] == ids
        same = (one.column("label").to_numpy()[:, None] == other.column("label").to_numpy()) & ~own
        for i, name in enumerate(names):
            scores = np.round(signals[name](q, x), digits)
            yield i, np.where(np.isnan(scores), np.finfo(float).min, scores), ids, own, same  # no score comes last

    def best(one: pa.Table, other: pa.Table) -> pa.Table:
        out = {"query": [], "signal": [], "score": [], "id": []}
        for i, scores, ids, _, same in scored(one, other) if one.num_rows and other.num_rows else ():
            held = np.where(same, scores, -np.inf)
            at = held.argmax(axis=1)  # the first of equal ones: the smallest id
            found = np.flatnonzero(same.any(axis=1))
            out["query"] += one.column("id").to_numpy()[found].tolist()
            out["signal"] += [i] * len(found)
            out["score"] += held[found, at[found]].tolist()
            out["id"] += ids[at[found]].tolist()
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("signal", pa.int32()), ("score", pa.float64()), ("id", pa.int64())]))

    def before(one: pa.Table, other: pa.Table) -> pa.Table:
        out = {"query": [], "signal": [], "n": []}
        for i, scores, ids, own, _ in scored(one, other) if one.num_rows and other.num_rows else ():
            known = [b.get(i) if b else None for b in map(dict, one.column("best").to_pylist())]
            found = np.array([k is not None for k in known], bool)
            top = np.array([k["score"] for k in known if k is not None])[:, None]
            first = np.array([k["id"] for k in known if k is not None])[:, None]
            ahead = ((scores[found] > top) | ((scores[found] == top) & (ids < first))) & ~own[found]
            out["query"] += one.column("id").to_numpy()[found].tolist()
            out["signal"] += [i] * int(found.sum())
            out["n"] += ahead.sum(axis=1).tolist()
        return pa.table(out, schema=pa.schema([("query", pa.int64()), ("signal", pa.int32()), ("n", pa.int64())]))

    ours, theirs = ("qb", "vb"), ("rqb", "rvb")
    each = asked.groupBy(*ours).cogroup(every.groupBy(*theirs)).applyInArrow(best, "query long, signal int, score double, id long")
    order = F.struct(-F.col("score"), F.col("id"))
    tops = each.groupBy("query", "signal").agg(F.min_by(F.struct("score", "id"), order).alias("best"))
    known = tops.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("signal", "best"))).alias("best"))
    told = asked.join(known.withColumnRenamed("query", "id"), "id", "left").select("id", "label", "x", "qb", "vb", F.coalesce("best", F.create_map().cast("map<int, struct<score: double, id: long>>")).alias("best"))
    counted = told.groupBy(*ours).cogroup(every.groupBy(*theirs)).applyInArrow(before, "query long, signal int, n long")
    places = counted.groupBy("query", "signal").agg((F.sum("n") + 1).alias("rank"))
    labels = F.array(*map(F.lit, names))
    whole = asked.where("vb = 0").select(F.col("id").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("signal"))
    ranked = whole.join(places, ["query", "signal"], "left")
    return ranked.select("query", labels[F.col("signal")].alias("signal"), F.when(F.col("rank") <= LAST_PLACE, F.col("rank")).alias("rank"))


def signal_catalogue(signals: DataFrame, id_col: str, defaults: Sequence[str], floor: int = 400, excluded: str | None = None) -> DataFrame:
    """Signals with coverage and whether they are on by default (DOM-07, FLT-18): too rare or excluded ones are off
    the list. ``signals``: id, ``signal``, ``value``."""
    counted = signals.where(F.col("value").isNotNull()).groupBy("signal").agg(F.countDistinct(id_col).alias("coverage"))
    counted = counted.where(F.col("coverage") >= floor)
    if excluded:
        counted = counted.where(~F.col("signal").rlike(excluded))
    return counted.withColumn("is_default", F.col("signal").isin(*defaults))


def resolve_preset(catalogue: DataFrame, preset: dict[str, float]) -> DataFrame:
    """A preset's weights for those of its signals that the catalogue has (DOM-08)."""
    weights = F.create_map(*(F.lit(x) for item in preset.items() for x in item))
    return catalogue.withColumn("weight", F.try_element_at(weights, F.col("signal"))).where(F.col("weight").isNotNull())

"""Hard negatives by k-means inverted lists whose radii bound every score.

Centroids are fitted on a bounded sample; every row goes to the list of its nearest centroid, and each list keeps its
radius, the largest distance of a row from the centroid. By Cauchy-Schwarz no row of a list scores more with an anchor than the
centroid's score plus the anchor's norm times the radius, and none less than the same difference. Anchors visit lists by that upper
bound, leave out lists that lie outside a window of scores, and stop where the bound falls strictly below the k-th score
found. On a cluster that takes two waves: the first few lists of each anchor, then all others that the k-th scores of
the first wave don't rule out. So the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import staged, tidy, tidy_group, unstage
from lodestar.llm.vectors import dimensions, matrix, padded

NO_LOWER, NO_UPPER = -(1 << 62), 1 << 62
#: Anchors whose scores stand in memory at once.
AT_ONCE = 256


@dataclass(frozen=True)
class MiningRules:
    positives: int = 5
    negatives: int = 10
    #: A negative scores at least and at most so many hundredths of the positive's score.
    least_percent: int = 30
    most_percent: int = 90
    #: Lists are the square root of the rows, and never more than this; rows of the sample for each list.
    most_lists: int = 1024
    sample_each: int = 32
    #: Lists that an anchor visits in the first wave.
    first_lists: int = 8
    #: Rows of a list, and anchors, that meet in one task at a time.
    list_rows: int = 4096
    anchor_rows: int = 2048


@dataclass
class Lists:
    """Centroids (one a row), radii, and the numbers of blocks into which the rows of the lists are dealt."""

    centroids: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lowest and highest possible score of each row of ``x`` with each list, and its score with the centroid.

        Widened by more than the rounding of the sums; an empty list has no score."""
        x = x.astype(np.float64)
        middle = x @ self.centroids.T
        norms = np.sqrt((x * x).sum(axis=1))[:, None]
        reach = norms * (self.radii + 1e-9 * (1 + np.sqrt((self.centroids**2).sum(axis=1)))) + 1e-6
        none = self.blocks == 0
        return np.where(none, np.inf, middle - reach), np.where(none, -np.inf, middle + reach), middle


def fitted_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from the first ``k`` distinct rows; a centroid without rows stays where it is."""
    distinct = np.unique(sample, axis=0, return_index=True)[1]
    centroids = sample[np.sort(distinct)[:k]].astype(np.float64)
    for _ in range(rounds if len(centroids) else 0):
        nearest, _ = nearest_centroid(sample, centroids)
        order = np.argsort(nearest, kind="stable")
        found, first, counts = np.unique(nearest[order], return_index=True, return_counts=True)
        centroids[found] = np.add.reduceat(sample[order].astype(np.float64), first, axis=0) / counts[:, None]
    return centroids


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and distance from the nearest centroid of each row."""
    squares, nearest = (centroids**2).sum(axis=1), np.zeros(len(x), np.int32)
    for i in range(0, len(x), 4096):
        nearest[i : i + 4096] = (squares - 2 * (x[i : i + 4096] @ centroids.T)).argmin(axis=1)
    return nearest, np.sqrt(((x - centroids[nearest]) ** 2).sum(axis=1))


def visits(lists: Lists, x: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray | None, first: int) -> np.ndarray:
    """Which lists each window of each anchor visits: anchors x windows x lists.

    Lists that lie outside the window are left out. Without ``kth`` these are the first few by upper bound (held at the
    window's own; among equal ones those whose centroid scores nearest to it), with it all others whose bound isn't below."""
    lowest, highest, middle = lists.bounds(x)
    inside = (highest[:, None] >= low[:, :, None]) & (lowest[:, None] <= high[:, :, None])
    top = np.minimum(highest[:, None], high[:, :, None])
    order = np.lexsort((np.abs(middle[:, None] - np.maximum(np.minimum(high, 1 << 53), -1)[:, :, None]), -np.where(inside, top, -np.inf)), axis=2)
    among = np.zeros(inside.shape, bool)
    np.put_along_axis(among, order[:, :, :first], True, axis=2)
    return inside & among if kth is None else inside & ~among & (top >= kth[:, :, None])


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all sums stay below 2 ** 53, else in whole numbers."""
    most = int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, anchors.shape[1])
    if most < 1 << 53:
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return anchors @ rows.T


def best_in_windows(scores: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The first ``k`` columns of each row by falling score, then rising id, whose score lies in each of its windows.

    ``ids`` rise. Returns row, window, column, a number for each found."""
    order = np.argsort(-scores, axis=1, kind="stable")
    ranked = np.take_along_axis(scores, order, axis=1)
    n = ranked.shape[1]
    above = np.stack([(ranked > h[:, None]).sum(axis=1) for h in high.T], axis=1)
    places = above[:, :, None] + np.arange(k)
    held = np.minimum(places, n - 1)
    flat = held.reshape(len(scores), -1)
    good = (places < n) & (np.take_along_axis(ranked, flat, axis=1).reshape(held.shape) >= low[:, :, None])
    row, window, _ = np.nonzero(good)
    return row, window, np.take_along_axis(order, flat, axis=1).reshape(held.shape)[good]


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, np.int64)], pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dims)


def lists_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of equally long lists."""
    return np.array(column.to_pylist(), np.int64).reshape(len(column), -1)


def assigned_rows(rows: DataFrame, dims: int, rules: MiningRules) -> tuple[DataFrame, Lists, DataFrame]:
    """Rows with their list and a number to deal them by, the lists, and what the lists count (one row a list)."""
    spark = rows.sparkSession
    lists = max(1, min(rules.most_lists, isqrt(rows.count())))
    sample = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(lists * rules.sample_each).toArrow()
    centroids = fitted_centroids(matrix(sample.column(0).combine_chunks(), dims), lists)
    model = spark.sparkContext.broadcast(centroids)  # rules.most_lists rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(4), dims)
            nearest, distance = nearest_centroid(x, model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], packed(x), pa.array(nearest), pa.array(distance)], ["id", "label", "anchor", "deal", "x", "cluster", "distance"])

    dealt = rows.select("id", "label", "anchor", F.xxhash64("id", "label", "x").alias("deal"), "x")
    found = staged(dealt.mapInArrow(tidy(assign), "id long, label long, anchor boolean, deal long, x binary, cluster int, distance double"))
    counts = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.count_if("anchor").alias("anchors")).collect()}
    k = len(centroids)
    of = lambda name: np.array([counts[c][name] if c in counts else 0 for c in range(k)], float)
    blocks = -(-of("n") // rules.list_rows)
    # Anchors of neighbouring lists share a block, so that the blocks' anchors visit the same lists.
    spread = centroids - centroids.mean(axis=0) if k else centroids
    along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] if k > 1 else np.zeros(k)
    first, parts, at, held = np.zeros(k, int), np.ones(k, int), 0, 0
    for c in np.argsort(along, kind="stable"):
        n = int(of("anchors")[c])
        if held and held + n > rules.anchor_rows:
            at, held = at + 1, 0
        first[c], parts[c] = at, max(1, -(-n // rules.anchor_rows))
        at, held = at + parts[c] - 1, held + n
        if parts[c] > 1:
            at, held = at + 1, 0
    table = spark.createDataFrame([(c, int(blocks[c]), int(first[c]), int(parts[c])) for c in range(k)], "cluster int, blocks int, first int, parts int")
    return found, Lists(centroids, of("radius"), blocks), table


def searched(anchors: DataFrame, rows: DataFrame, lists: Lists, dims: int, k: int, same: bool, first: int) -> DataFrame:
    """One wave: the first ``k`` rows of the visited lists in each window of each anchor.

    ``anchors``: part, place, id, label, x, ``low`` and ``high`` (a number for each window), ``kth`` (null in the first wave).
    ``rows``: cluster, block, id, label, x. Rows of the anchor's label are searched, or those of others. Returns part,
    place, anchor_id, window, id, score."""
    model = anchors.sparkSession.sparkContext.broadcast(lists)
    names = ["cluster", "block", "part", "place", "anchor_id", "anchor_label", "anchor_x", "low", "high"]

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                low, high = lists_of(batch.column("low")), lists_of(batch.column("high"))
                kth = None if batch.column("kth").null_count else lists_of(batch.column("kth"))
                there = visits(model.value, unpacked(batch.column("x"), dims), low, high, kth, first)
                anchor, cluster = np.nonzero(there.any(axis=1))
                seen = there[anchor, :, cluster]
                least = low if kth is None else np.maximum(low, kth)
                low, high = np.where(seen, least[anchor], NO_UPPER), np.where(seen, high[anchor], NO_LOWER)
                times = model.value.blocks[cluster].astype(int)
                each = np.repeat(np.arange(len(anchor)), times)
                block = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(anchor[each])
                columns = [pa.array(cluster[each].astype(np.int32)), pa.array(block.astype(np.int32))]
                columns += [batch.column(n).take(take) for n in ("part", "place", "id", "label", "x")]
                columns += [pa.FixedSizeListArray.from_arrays(pa.array(v[each].ravel()), v.shape[1]).cast(pa.list_(pa.int64())) for v in (low, high)]
                yield pa.RecordBatch.from_arrays(columns, names)

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        other = other.sort_by([("id", "ascending"), ("label", "ascending")])
        ids, labels, x = other.column("id").to_numpy(), other.column("label").to_numpy(), unpacked(other.column("x"), dims)
        out = []
        one = one.sort_by([("anchor_label", "ascending"), ("place", "ascending")])
        borders = np.flatnonzero(np.diff(one.column("anchor_label").to_numpy())) + 1
        borders = [0, *borders.tolist(), one.num_rows]
        for begin, end in zip(borders, borders[1:], strict=False):
            for start in range(begin, end, AT_ONCE):
                some = one.slice(start, min(AT_ONCE, end - start))
                columns = np.flatnonzero((labels == some.column("anchor_label")[0].as_py()) == same)
                if not len(columns):
                    continue
                anchor_x, anchor_ids = unpacked(some.column("anchor_x"), dims), some.column("anchor_id").to_numpy()
                scores = scores_of(anchor_x, x[columns])
                if same:  # rows are distinct, so only one is the anchor itself
                    a, c = np.nonzero(anchor_ids[:, None] == ids[columns][None])
                    own = (anchor_x[a] == x[columns[c]]).all(axis=1)
                    scores[a[own], c[own]] = NO_LOWER - 1
                row, window, column = best_in_windows(scores, ids[columns], lists_of(some.column("low")), lists_of(some.column("high")), k)
                take = pa.array(row)
                out.append(pa.Table.from_arrays(
                    [*(some.column(n).take(take) for n in ("part", "place", "anchor_id")), pa.array(window.astype(np.int32)), pa.array(ids[columns[column]]), pa.array(scores[row, column])],
                    ["part", "place", "anchor_id", "window", "id", "score"],
                ))
        return pa.concat_tables(out) if out else pa.table({"part": pa.array([], pa.int32()), "place": pa.array([], pa.int32()), "anchor_id": pa.array([], pa.int64()), "window": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    sent = anchors.select("part", "place", "id", "label", "x", "low", "high", "kth").mapInArrow(
        tidy(visiting), "cluster int, block int, part int, place int, anchor_id long, anchor_label long, anchor_x binary, low array<long>, high array<long>"
    )
    # Each block of a list goes once to each block of anchors that visits it.
    pairs = sent.select("cluster", "block", "part").distinct()
    keys, theirs = ["cluster", "block", "part"], ["list_cluster", "list_block", "list_part"]
    copies = rows.join(pairs, ["cluster", "block"]).select(*keys, "id", "label", "x").toDF(*theirs, "id", "label", "x")
    met = sent.groupBy(*keys).cogroup(copies.groupBy(*theirs)).applyInArrow(tidy_group(meet), "part int, place int, anchor_id long, window int, id long, score long")
    return first_in_windows(met, k)


def first_in_windows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("part", "place", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def kth_scores(found: DataFrame, k: int, windows: Column) -> Callable[[DataFrame], DataFrame]:
    """Adds ``kth`` to anchors: the k-th score found in each window, or what bounds nothing where fewer are found."""
    last = found.where(F.col("rank") == k).groupBy("part", "place").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("__last"))
    kth = F.transform(F.sequence(F.lit(0), windows - 1), lambda w: F.coalesce(F.try_element_at("__last", w.cast("int")), F.lit(NO_LOWER)))
    return lambda anchors: anchors.join(last, ["part", "place"], "left").withColumn("kth", kth).drop("__last")


def in_two_waves(anchors: DataFrame, rows: DataFrame, lists: Lists, dims: int, k: int, same: bool, windows: int, rules: MiningRules) -> DataFrame:
    none = F.lit(None).cast("array<long>")
    some = staged(searched(anchors.withColumn("kth", none), rows, lists, dims, k, same, rules.first_lists))
    more = searched(kth_scores(some, k, F.lit(windows))(anchors), rows, lists, dims, k, same, rules.first_lists)
    best = staged(first_in_windows(some.drop("rank").unionByName(more.drop("rank")), k))
    unstage(some)
    return best


def mine_negatives(vectors: DataFrame, is_anchor: Column, rules: MiningRules = MiningRules(), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "x") -> DataFrame:
    """For each anchor and each of its positives the hardest rows of other labels within the window of the positive's score.

    ``vector_col`` is an ``array<bigint>`` without nulls (a shorter one counts as filled up with zeros). A score is an inner
    product; higher ones come first, ties by smaller id. An anchor's positives are its first rows of its own label, itself
    left out. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Rows without id
    or label take no part. Rows equal in id, label and vector count once; of rows that are equal in id alone each is a row.
    A positive of a negative score has an empty window. An empty table gives no rows; other columns are not carried.
    """
    taken = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    dims = dimensions(taken, vector_col)
    rows = taken.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        padded(F.col(vector_col), dims).alias("x"),
    ).distinct()
    every, lists, table = assigned_rows(rows, dims, rules)
    dealt = every.join(F.broadcast(table), "cluster")  # rules.most_lists rows at most
    listed = dealt.select("cluster", F.pmod("deal", F.col("blocks")).cast("int").alias("block"), "id", "label", "x")
    place = F.row_number().over(Window.partitionBy("part").orderBy("id", "label", "x"))
    anchors = dealt.where("anchor").withColumn("part", (F.col("first") + F.pmod("deal", F.col("parts"))).cast("int"))
    anchors = staged(anchors.select("part", place.cast("int").alias("place"), "id", "label", "x"))

    whole = anchors.withColumn("low", F.array(F.lit(NO_LOWER))).withColumn("high", F.array(F.lit(NO_UPPER)))
    positives = in_two_waves(whole, listed, lists, dims, rules.positives, True, 1, rules)

    least, most = F.lit(rules.least_percent).cast("long"), F.lit(rules.most_percent).cast("long")
    ceiling = F.expr("score div 100") * least + F.ceil(F.expr("score % 100") * least / 100)
    floor = F.expr("score div 100") * most + F.floor(F.expr("score % 100") * most / 100)
    limits = positives.select("part", "place", "rank", ceiling.alias("low"), F.when(F.col("score") < 0, NO_LOWER).otherwise(floor).alias("high"))
    held = limits.groupBy("part", "place").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("low", "high")))).alias("__limits"))
    numbers = F.sequence(F.lit(1), F.lit(rules.positives))  # missing ones get an empty window
    limit = lambda name, missing: F.transform(numbers, lambda r: F.coalesce(F.try_element_at("__limits", r)[name], F.lit(missing)))
    windows = anchors.join(held, ["part", "place"]).select(*anchors.columns, limit("low", NO_UPPER).alias("low"), limit("high", NO_LOWER).alias("high"))
    negatives = in_two_waves(windows, listed, lists, dims, rules.negatives, False, rules.positives, rules)

    of = positives.select("part", "place", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(of, ["part", "place", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

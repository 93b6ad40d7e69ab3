"""Connected components, and links inside buckets of candidates without emitting all pairs of a bucket.

Things are sets (shingles of a document, words of a line with their occurrence numbers), and a relation says how many
elements two sets of given sizes must share before they may be linked. Small buckets are compared in full; a large one has
a hub that all its members are compared with. What is not near the hub is then found by what it does not share with the hub:

* What x lacks of the hub h and what it has besides are its differences. x and y share |h| less what x lacks, less what y
  lacks, plus the differences that both have. So if they must share s, they have s - |h| + |x lacks| + |y lacks| differences in
  common; call that t. It is 1 at least wherever one of them is not near h, as sharing t - 1 or fewer leaves x no more like y
  than it is like h.
* All but the last t - k differences of each, rarest first, are looked up: two that have t in common meet there k times or
  more. What all members of a bucket have and the hub lacks, or the other way round, is frequent and comes last; near copies
  that differ at random meet once or twice, and go.
* Short sequences of frequent elements (lines) lack what many others lack, so looking those up costs more than it leaves out:
  of these the elements that the hub lacks are looked up alone (``pairs_by_extras``).
* Of members that are near the hub but not linked with it (lines with the same words in another order) that says nothing. A
  relation on sequences gives runs of q elements, of which two linked sequences have some in common; those are looked up in
  the same way.

No pair of a bucket that may be linked is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged, unstage

#: Buckets of at most this many members are compared in full: at most half as many pairs as members times this number.
SMALL_BUCKET = 6
#: Differences in which two members of a bucket must meet, at most, and for how many that they must have in common they must meet
#: in one more. A changed word is a difference of each shingle that holds it, so in long texts one change that two members
#: share is not enough; short ones have few differences, and looking up more of them would find the frequent ones.
MEETINGS, FOR_EACH = 6, 10


class Relation(Protocol):
    def need(self, n, m):
        """Least number of shared elements of sets with ``n`` and ``m`` elements; grows with both, and by no more than they do."""

    #: Whether sequences have runs (``orders``): then near pairs are looked up by these.
    ordered: bool

    def run_of(self, longer: Column) -> Column:
        """Elements of the runs that two linked sequences have in common, by the longer one's size; of ordered relations."""

    def need_of(self, n: Column, m: Column) -> Column:
        """The same of columns."""

    def least_of(self, n: Column) -> Column:
        """Size of the smallest set that may be linked to one of ``n`` elements."""

    def possible(self, n: Column, m: Column) -> Column:
        """Whether sets of these sizes may be linked at all."""


#: Given pairs (``a``, ``b``) and whether their differences are asked for, returns ``a``, ``b``, ``linked`` and, if so, the
#: columns of ``DIFFERENCES`` of each; if not, linked pairs will do.
Compare = Callable[[DataFrame, bool], DataFrame]
DIFFERENCES = "near boolean, hub_size int, size int, shared int, apart array<bigint>"
#: And this one of ordered relations: runs of ``q`` elements, where each first and last begins, how many differ from each other, how
#: many of them are looked up, and how far two that belong together lie apart.
ORDERS = "orders array<struct<q int, run bigint, low int, high int, many int, take int, reach int>>"
#: Given distinct ids ``b``, returns them with ``ORDERS``.
Orders = Callable[[DataFrame], DataFrame]
#: Tells what the hub has and a member lacks from what the member has besides.
LACKED = np.uint64(0xD1B54A32D192ED03)


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a ragged array in another order: values, and the row that each belongs to."""
    sizes = (offsets[1:] - offsets[:-1])[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    return values[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1][rows], sizes)], owner


def differences(
    values: np.ndarray, offsets: np.ndarray, hub: np.ndarray, own: np.ndarray, relation: Relation, accept: Callable[[np.ndarray], np.ndarray], whole: bool
) -> tuple[np.ndarray, list[pa.Array]]:
    """Compares sets (rows of a ragged array of distinct 64-bit elements) pair by pair.

    ``accept`` says which of some near pairs are linked. Returns the links, and the arrays of ``DIFFERENCES`` if ``whole``.
    """
    sizes = offsets[1:] - offsets[:-1]
    n, m = sizes[hub], sizes[own]
    (a, row_a), (b, row_b) = ragged(values, offsets, hub), ragged(values, offsets, own)
    # The pair's number goes into the element, so that one sort finds what all pairs share.
    salt = lambda x, row: (x ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    both, first = np.concatenate([salt(a, row_a), salt(b, row_b)]), len(a)
    order = np.argsort(both, kind="stable")
    twice = np.zeros(len(both), bool)
    same = both[order][1:] == both[order][:-1]
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    in_b, in_a = twice[:first], twice[first:]
    shared = np.bincount(row_b[in_a], minlength=len(own))
    near = (shared >= relation.need(n, m)) & (shared > 0)
    linked = np.zeros(len(own), bool)
    at = np.flatnonzero(near)
    linked[at] = accept(at)
    if not whole:
        return linked, []
    element = np.concatenate([b[~in_a], a[~in_b] ^ LACKED])
    row = np.concatenate([row_b[~in_a], row_a[~in_b]])
    order = np.argsort(row, kind="stable")
    edges = np.r_[0, np.cumsum(np.bincount(row, minlength=len(own)))]
    apart = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(element[order].view(np.int64)))
    return linked, [pa.array(near), *(pa.array(c.astype(np.int32)) for c in (n, m, shared)), apart]


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``edges`` (``a``, ``b``).

    Large-star and small-star steps in turn until every edge points at its component's smallest id: the number of
    rounds grows with the logarithm of the largest component. Each round is written to the shared folder. An id with
    very many edges is only ever a join key, which adaptive execution splits.
    """
    edge = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Large star: neighbours above an id move to the smallest id in its neighbourhood (itself included).
        both = edge.select("a", "b").union(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: neighbours below an id, and the id itself, move to the smallest of them.
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))
        small = large.join(below, "a").select(F.inline(moved).alias("a", "b"))
        after = staged(small.where("a <> b").distinct())
        # Done when each id has one edge, and no target has an edge of its own.
        parted = after.groupBy("a").count().where("count > 1").limit(1).count()
        open_still = parted or after.select(F.col("b").alias("a")).distinct().join(after, "a", "left_semi").limit(1).count()
        unstage(edge)
        edge = after
        if not open_still:
            break
    named = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), "b"))
    found = staged(edge.select(F.inline(named).alias("id", "component")).distinct())
    unstage(edge)
    return found


def more_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``id``, ``component``) once more links (``a``, ``b``) join some components: only the links between those go
    through the rounds."""
    of = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(named.select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b")))
    fresh = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().join(labels, "id", "left_anti")
    every = labels.select("id", "component").union(fresh.select("id", F.col("id").alias("component")))
    least = over.select(F.col("id").alias("component"), F.col("component").alias("least"))
    found = staged(every.join(least, "component", "left").select("id", F.coalesce("least", "component").alias("component")))
    unstage(over)
    return found


def pairs_of(members: DataFrame, relation: Relation) -> tuple[DataFrame, DataFrame]:
    """Pairs (``a``, ``b``) of small buckets, and pairs of a large bucket's hub with its other members; each pair once.

    The hub is the member that shares most buckets with others.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("members"))
    sized = members.join(sizes.where("members > 1"), "key")
    small, large = sized.where(F.col("members") <= SMALL_BUCKET), sized.where(F.col("members") > SMALL_BUCKET)
    other = small.select("key", F.col("id").alias("b"), F.col("n").alias("m"))
    small = small.select("key", F.col("id").alias("a"), "n").join(other, "key").where(F.col("a") < F.col("b"))
    small = small.where(relation.possible(F.col("n"), F.col("m"))).select("a", "b").distinct()
    central = large.groupBy("id").agg(F.sum("members").alias("central"))
    hub = large.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("central", -F.col("n"), "id")).alias("hub"))
    return small, large.join(hub, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def looked_up(own: DataFrame, facts: list[str], element: list[str], payload: tuple[str, ...] = ()) -> DataFrame:
    """One row a member (``facts``): ``some``, its elements that other members of the hub have too, rarest first, as far as its
    ``take`` says. Elements that it has alone come before all others: ``lone`` of its ``many`` elements."""
    known = own.groupBy("a", *element).agg(F.count("*").alias("holders"), F.max(~F.col("linked")).alias("parted"))
    kept = own.join(known.where("holders > 1 and parted").select("a", *element, "holders"), ["a", *element])
    inner = [c for c in (*element, *payload) if c not in facts]
    some = kept.groupBy(*facts).agg(F.sort_array(F.collect_list(F.struct("holders", *inner))).alias("some"))  # of one member
    lone = F.col("many") - F.size("some")
    first = F.slice("some", F.lit(1), F.greatest(F.lit(0), F.col("take") - lone).cast("int"))
    return staged(some.select(*facts, lone.alias("lone"), first.alias("some")).where("size(some) > 0"))


def pairs_by_differences(rest: DataFrame, relation: Relation, joined: Callable[..., DataFrame]) -> DataFrame:
    """Pairs of which one is not near the hub, by the differences that they must have in common."""
    facts = ["component", "size", "lacked", "hub_size", "near", "smallest", "fewest_far"]
    common = lambda need, lacked: F.greatest(F.lit(1), need - F.col("hub_size") + F.col("lacked") + lacked)
    smallest = F.greatest(F.col("smallest"), relation.least_of(F.col("size")))
    times = lambda t: F.least(F.lit(MEETINGS), 1 + F.floor(t / FOR_EACH).cast("int"))
    # By what its partners lack at least: of far ones (not near the hub) that is more.
    taken = lambda many, fewest: many - common(relation.need_of(F.col("size"), smallest), fewest) + times(common(relation.need_of(F.col("size"), smallest), fewest))
    many = F.size("apart")
    take = taken(many, F.col("fewest"))
    own = rest.select("a", "b", *facts, "linked", many.alias("many"), take.alias("take"), F.explode("apart").alias("e"))
    held = looked_up(own, ["a", "b", *facts, "linked", "many", "take"], ["e"]).withColumn("some", F.col("some.e"))
    for_far = F.slice("some", F.lit(1), F.greatest(F.lit(0), taken(F.col("many"), F.col("fewest_far")) - F.col("lone")).cast("int"))
    each = lambda some, elements: some.select("*", F.posexplode(elements).alias("place", "e"))
    far, to_far = held.where("not near"), each(held, for_far)
    both = common(relation.need_of(F.col("size"), F.col("size_c")), F.col("lacked_c"))
    # The elements that the pair's own numbers leave of each; the pair stays at the first that both have, if there are enough.
    length = lambda x: (F.col(f"many{x}") - both + times(both) - F.col(f"lone{x}")).cast("int")
    inside = [F.col(f"place{x}") < length(x) for x in ("", "_c")]
    shared = F.array_intersect(*(F.slice(f"some{x}", F.lit(1), F.greatest(F.lit(0), length(x))) for x in ("", "_c")))
    enough = (F.size(shared) >= times(both)) & (F.get(shared, F.lit(0)) == F.col("e"))
    # No far member is linked. Two of them meet in both directions: one is enough.
    once = F.col("b") < F.col("c")
    found = joined(to_far.where("not near"), to_far.where("not near"), ["a", "e"], once, *inside, enough)
    found = found.union(joined(each(far, F.col("some")), to_far.where("near"), ["a", "e"], *inside, enough))
    return found


def pairs_by_extras(rest: DataFrame, relation: Relation, joined: Callable[..., DataFrame]) -> DataFrame:
    """The same for short sequences, of which each lacks what many others lack: by what they have besides the hub.

    Two that share only elements of the hub, of which one isn't near it and the other is no smaller than the hub, share less than they
    must; so they share an element that the hub lacks, and if one shares r with the hub, all but r of those that they must share. If one is
    smaller than the hub, the hub has elements that both lack: all but a few of those that the smaller one lacks."""
    facts = ["component", "size", "shared", "extras"]
    lacks = F.array_sort(F.slice("apart", F.col("extras") + 1, F.greatest(F.col("lacked"), F.lit(0))))
    gap = relation.need_of(F.col("hub_size"), F.col("hub_size")) - relation.need_of(F.col("size"), F.col("size"))
    rest = rest.withColumn("extras", F.col("size") - F.col("shared"))
    rest = rest.withColumns({"extra": F.slice("apart", F.lit(1), F.col("extras")), "lacks": lacks, "gap": F.when(F.col("size") < F.col("hub_size"), gap).otherwise(0)})
    smallest = F.greatest(F.col("smallest"), relation.least_of(F.col("size")))
    least = F.greatest(F.lit(1), relation.need_of(F.col("size"), smallest) - F.col("shared"))
    own = rest.select("a", "b", *facts, "linked", F.col("extras").alias("many"), F.when(F.col("linked"), F.col("extras")).otherwise(F.col("extras") + 1 - least).alias("take"), F.explode("extra").alias("e"))
    held = looked_up(own, ["a", "b", *facts, "linked", "many", "take"], ["e"])
    held = held.select("a", "b", *facts, "linked", "lone", F.posexplode("some.e").alias("place", "e")).withColumn("rank", F.when(F.col("linked"), 0).otherwise(F.col("place") + 1 + F.col("lone")))
    must = F.greatest(F.lit(1), relation.need_of(F.col("size"), F.col("size_c")) - F.least("shared", "shared_c"))
    found = joined(held.where("not linked"), held, ["a", "e"], *(F.col(f"rank{x}") <= F.col(f"extras{x}") + 1 - must for x in ("", "_c")))
    fits = lambda n: relation.need_of(F.col("size"), n) <= F.col("shared")
    told = rest.where((F.col("gap") > 0) & fits(relation.least_of(F.col("size")))).select("a", "b", *facts, F.posexplode(F.slice("lacks", F.lit(1), F.col("gap").cast("int"))).alias("place", "e"))
    lacking = rest.where(~F.col("linked") & fits(smallest)).select("a", "b", *facts, F.lit(0).alias("place"), F.explode("lacks").alias("e"))
    lacking = lacking.join(told.select("a").distinct(), "a", "left_semi")
    need = relation.need_of(F.col("size"), F.col("size_c"))
    return found.union(joined(lacking, told, ["a", "e"], need <= F.col("shared_c"), F.col("place_c") <= F.col("shared") - need))


def rest_pairs(compared: DataFrame, labels: DataFrame, relation: Relation, orders: Orders | None = None) -> DataFrame:
    """Pairs of members of one hub, not yet connected, that may be linked by their differences to the hub."""
    named = compared.join(labels.withColumnRenamed("id", "b"), "b", "left").withColumn("lacked", F.col("hub_size") - F.col("shared"))
    named = named.withColumn("component", F.coalesce("component", "b"))
    state = named.groupBy("a").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.max(~F.col("linked")).alias("parted"),
        F.max(F.col("near") & ~F.col("linked")).alias("unsure"), F.min("size").alias("smallest"), F.min("lacked").alias("fewest"), F.min(F.when(~F.col("near"), F.col("lacked"))).alias("fewest_far"),
    )
    rest = staged(named.join(state.where("parted and least < most").select("a", "unsure", "smallest", "fewest", "fewest_far"), "a"))

    def joined(some: DataFrame, others: DataFrame, on: list[str], *also: Column) -> DataFrame:
        others = others.select(*on, F.col("b").alias("c"), *(F.col(x).alias(f"{x}_c") for x in others.columns if x not in (*on, "b")))
        may = (F.col("component") != F.col("component_c")) & relation.possible(F.col("size"), F.col("size_c"))
        both = some.join(others, on).where(reduce(lambda x, y: x & y, also, may))
        return both.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"))

    found = (pairs_by_extras if relation.ordered else pairs_by_differences)(rest, relation, joined)
    close, once = rest.where("near"), F.col("linked_c") | (F.col("b") < F.col("c"))
    if relation.ordered:
        member = ["a", "b", "component", "size", "linked"]
        # Pairs have a member that is near and not linked: most hubs have none.
        close = close.where("unsure")
        close = close.join(orders(close.select("b").distinct()), "b")
        runs = looked_up(close.select(*member, F.inline("orders")), [*member, "q", "many", "take", "reach"], ["q", "run"], ("low", "high"))
        runs = runs.select(*member, "q", "reach", F.inline("some")).drop("holders")
        reach = F.greatest("reach", "reach_c")
        beside = (F.col("low") <= F.col("high_c") + reach) & (F.col("low_c") <= F.col("high") + reach)
        fits = F.col("q") == relation.run_of(F.greatest("size", "size_c"))
        found = found.union(joined(runs.where("not linked"), runs, ["a", "q", "run"], once, fits, beside))
    else:
        found = found.union(joined(close.where("not linked").select("a", "b", "component", "size"), close.select("a", "b", "component", "size", "linked"), ["a"], once))
    return found.distinct()


def link_buckets(members: DataFrame, compare: Compare, relation: Relation, orders: Orders | None = None) -> DataFrame:
    """Links enough to connect all that are connected: ``id``, ``component`` of every id that has a link.

    ``members`` holds ``key``, ``id`` and ``n`` (elements of the id's set), distinct; two ids may be linked only if they
    share a key; of ordered relations ``orders`` gives the runs. Two turns: large buckets' members are compared with a hub, then pairs from the differences to a hub.
    Keys, hubs and elements that very many hold are only ever keys of joins and of partial aggregates.
    """
    small, large = pairs_of(members, relation)
    close = staged(compare(small, False).where("linked").select("a", "b"))
    compared = staged(compare(large, True))
    links = compared.where("linked").select("a", "b").union(close)
    labels = components(links)
    more = staged(compare(rest_pairs(compared, labels, relation, orders), False).where("linked").select("a", "b"))
    found = more_components(labels, more) if more.limit(1).count() else labels
    for table in (close, compared, more, *((labels,) if found is not labels else ())):
        unstage(table)
    return found

"""Best-fit packing of documents into sequences of fixed capacity, under conflicts.

Documents are dealt at random into groups of bounded size, and each group is packed by itself: pieces from large to
small, bins ordered by what room they have left. A bin carries one bitmap of the sources it holds and one of the
duplicate clusters. From the tightest bin that has room, the search goes on to the next larger until the bitmaps show
no conflict; if none is left, a new bin opens.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import text_bytes

#: Rows of a group, on average.
GROUP_ROWS = 2048
CAPACITY = 8192


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece. ``sources`` and ``clusters`` are small numbers; -1 never conflicts."""
    room: list[tuple[int, int]] = []  # what is left, and the bin; in order
    held: list[tuple[int, int]] = []  # of each bin: its sources and its clusters, a bit each
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        mine = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (held[room[at][1]][0] & mine[0] or held[room[at][1]][1] & mine[1]):
            at += 1
        if at < len(room):
            left, number = room.pop(at)
        else:
            left, number = capacity, len(held)
            held.append((0, 0))
        held[number] = held[number][0] | mine[0], held[number][1] | mine[1]
        insort(room, (left - size, number))
        out.append((number, capacity - left))
    return out


def numbered(values: pd.Series) -> list[int]:
    """Equal values by equal small numbers, missing ones by -1."""
    return pd.factorize(values)[0].tolist()


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
) -> DataFrame:
    """Every byte of every text in one bin: ``id_col``, ``piece``, ``start`` and ``n_bytes`` (of the piece in the
    text), ``bin``, ``bin_offset``.

    No bin holds more than ``capacity`` bytes, two pieces from one source or two from one duplicate cluster (``cluster``;
    by default texts that are equal but for case). Longer texts are cut at multiples of the capacity; whole pieces have
    bins to themselves, the rest is packed. Null and empty texts are one piece of no bytes; null sources and clusters
    conflict with nothing. Repeated rows are packed as often as they come. An empty table gives no rows; other columns
    are not carried. Groups follow from the number of rows alone, and bins from the rows, whatever the session's settings.
    """
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    if cluster is None:
        cluster = F.when(F.octet_length(text_col) > 0, F.xxhash64(F.lower(text_col)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"),
        text_bytes(F.col(text_col)).alias("size"),
        F.xxhash64(source_col).alias("source_key"),
        F.col(source_col).isNull().alias("no_source"),
        cluster.alias("cluster"),
        F.xxhash64(text_col).alias("print"),
    )
    # Equal rows are numbered, so that many of them don't meet in one group.
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("times")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("id", "print", "copy"), F.lit(groups))).drop("times")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id", "print", "copy"], kind="stable", ignore_index=True)
        number = int(group["group"].iloc[0])
        whole = group["size"] // capacity
        rest = group["size"] % capacity
        packed = group.assign(rest=rest, whole=whole)[(rest > 0) | (whole == 0)]
        packed = packed.sort_values("rest", ascending=False, kind="stable")
        placed = best_fit(
            packed["rest"].tolist(), numbered(packed["source_key"].where(~packed["no_source"])), numbered(packed["cluster"]), capacity
        )
        out = pd.DataFrame(
            {
                "id": packed["id"].to_numpy(), "piece": packed["whole"].to_numpy(), "n_bytes": packed["rest"].to_numpy(),
                "bin": [b for b, _ in placed], "bin_offset": [o for _, o in placed],
            }
        )
        long = group.index.repeat(whole)
        full = pd.DataFrame({"id": group["id"].loc[long].to_numpy(), "piece": group.loc[long].groupby(level=0).cumcount().to_numpy()})
        full = full.assign(n_bytes=capacity, bin=range(len(out), len(out) + len(full)), bin_offset=0)
        out = pd.concat([out, full], ignore_index=True)
        return out.assign(start=out["piece"] * capacity, bin=[f"{number}-{b}" for b in out["bin"]])[
            ["id", "piece", "start", "n_bytes", "bin", "bin_offset"]
        ]

    shape = f"id {kind}, piece long, start long, n_bytes long, bin string, bin_offset long"
    return rows.groupBy("group").applyInPandas(run, shape).withColumnRenamed("id", id_col)

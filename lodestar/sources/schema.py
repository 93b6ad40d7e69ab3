"""Schema steps on read, and seed rows (SRC-01).

Files stay as they were written. A table is a folder with a folder of files for each version of its schema; a reader gives all
the last version's columns, and rows written before a column was added have its default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.queue import insert_absent

VERSION = "schema"


@dataclass(frozen=True)
class Step:
    """A column that version ``version`` added, with its type and the value that earlier rows have."""

    version: int
    column: str
    kind: str
    default: object = None


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Rows added under the columns of one version."""
    df.write.mode("append").parquet(f"{path.rstrip('/')}/{VERSION}={version}")


def migrated(spark: SparkSession, path: str, first: str, steps: Sequence[Step]) -> DataFrame:
    """All rows of a table under the columns of its last version.

    ``first``: the columns of version 1. A null that a later version wrote stays null; only what a file could not have
    is filled. The schema is given, so no file is opened to find it."""
    added = ", ".join(f"`{s.column}` {s.kind}" for s in steps)
    rows = spark.read.schema(", ".join(filter(None, [first, added, f"`{VERSION}` int"]))).parquet(path)
    older = {s.column: F.when(F.col(VERSION) < s.version, F.lit(s.default).cast(s.kind)).otherwise(F.col(s.column)) for s in steps}
    return rows.withColumns(older).drop(VERSION)


def seeded(spark: SparkSession, base: DataFrame, seeds: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    """``base`` with the seed rows whose keys it lacks; what it has is never overwritten."""
    return insert_absent(base, spark.createDataFrame(list(seeds), base.schema), keys)


POLICY = "source string, field string, reliability double, similarity_weight double, usage string"
POLICY_KEYS = ["source", "field"]

# How reliable each source is for a field, its weight in similarity, and how it is used.
POLICIES = [
    ("freqblog", "bpm", 0.90, 1.00, "primary"),
    ("freqblog", "key", 0.88, 0.85, "primary"),
    ("freqblog", "loudness", 0.62, 0.45, "relative"),
    ("freqblog", "energy", 0.45, 0.38, "relative"),
    ("freqblog", "danceability", 0.35, 0.28, "relative"),
    ("freqblog", "valence", 0.12, 0.08, "weak"),
    ("freqblog", "acousticness", 0.08, 0.03, "avoid"),
    ("freqblog", "instrumentalness", 0.08, 0.04, "avoid"),
    ("freqblog", "speechiness", 0.12, 0.05, "weak"),
    ("freqblog", "liveness", 0.04, 0.01, "avoid"),
    ("onetagger", "bpm", 0.82, 0.85, "primary"),
    ("onetagger", "key", 0.78, 0.72, "primary"),
    ("onetagger", "energy", 0.55, 0.48, "relative"),
    ("acousticbrainz", "bpm", 0.78, 0.75, "primary"),
    ("acousticbrainz", "key", 0.72, 0.65, "primary"),
    ("acousticbrainz", "energy", 0.65, 0.58, "relative"),
    ("acousticbrainz", "danceability", 0.58, 0.50, "relative"),
    ("spotify_legacy_dataset", "bpm", 0.97, 1.00, "primary"),
    ("spotify_legacy_dataset", "key", 0.95, 0.96, "primary"),
    ("spotify_legacy_dataset", "loudness", 0.97, 0.95, "primary"),
    ("spotify_legacy_dataset", "energy", 0.97, 0.95, "primary"),
    ("spotify_legacy_dataset", "danceability", 0.97, 0.95, "primary"),
    ("spotify_legacy_dataset", "valence", 0.97, 0.95, "primary"),
    ("spotify_legacy_dataset", "acousticness", 0.97, 0.95, "primary"),
    ("spotify_legacy_dataset", "instrumentalness", 0.97, 0.95, "primary"),
    ("spotify_legacy_dataset", "speechiness", 0.97, 0.95, "primary"),
    ("spotify_legacy_dataset", "liveness", 0.97, 0.95, "primary"),
    ("reccobeats", "bpm", 0.98, 1.00, "primary"),
    ("reccobeats", "key", 0.98, 0.98, "primary"),
    ("reccobeats", "loudness", 0.98, 0.98, "primary"),
    ("reccobeats", "energy", 0.98, 0.98, "primary"),
    ("reccobeats", "danceability", 0.98, 0.98, "primary"),
    ("reccobeats", "valence", 0.98, 0.98, "primary"),
    ("reccobeats", "acousticness", 0.98, 0.98, "primary"),
    ("reccobeats", "instrumentalness", 0.98, 0.98, "primary"),
    ("reccobeats", "speechiness", 0.98, 0.98, "primary"),
    ("reccobeats", "liveness", 0.98, 0.98, "primary"),
    ("spotify:playlist-inference", "energy", 0.20, 0.15, "fallback"),
    ("spotify:playlist-inference", "danceability", 0.20, 0.15, "fallback"),
]

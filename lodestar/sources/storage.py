"""Writers: lineage, manifests, archives, exports (SNK-01 to SNK-15, SNK-20).

Nothing is changed in place: each write adds files or a folder, and Spark's own connectors reach every file system.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_run(spark: SparkSession, path: str, source: str, rows: int, status: str, detail: str = "") -> None:
    """One row of lineage for a run (SNK-20). Appending files needs no lock."""
    now = spark.range(1).select(F.lit(source).alias("source"), F.lit(rows).cast("long").alias("rows"), F.lit(status).alias("status"), F.lit(detail).alias("detail"), F.current_timestamp().alias("at"))
    now.write.mode("append").parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Rows added as JSON lines (SNK-09)."""
    df.write.mode("append").json(path)


def archive(df: DataFrame, path: str) -> str:
    """Rows as gzipped JSON lines in a new folder below ``path``, which is returned (SNK-10, SNK-11).

    Nothing is overwritten: earlier ones stay, and a folder without its ``_SUCCESS`` mark is none."""
    version = f"{path.rstrip('/')}/{time.time_ns():020d}"
    df.write.option("compression", "gzip").json(version)
    return version


def latest_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the last complete archive below ``path`` (SNK-10)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(where) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema(schema).json(max(p.toString() for p in done))


def playlist_csv(df: DataFrame, path: str) -> None:
    """Title, artist, album and code of each entity, with a header (SNK-13)."""
    df.select(F.col("title"), F.col("artist_names").alias("artist"), "album", "isrc").write.mode("overwrite").csv(path, header=True)


def report(df: DataFrame, groups: list[str], measures: dict[str, Column], path: str) -> DataFrame:
    """Measures of each group as JSON and CSV, and one Markdown line a group (SNK-12)."""
    summary = df.groupBy(*groups).agg(*(c.alias(n) for n, c in measures.items()))
    summary.write.mode("overwrite").json(f"{path}/json")
    summary.write.mode("overwrite").csv(f"{path}/csv", header=True)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in summary.columns]
    summary.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value")).write.mode("overwrite").text(f"{path}/markdown")
    return summary

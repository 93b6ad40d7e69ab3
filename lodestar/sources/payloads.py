"""Nested payloads: attributes, packed blobs, stage results (PRJ-04 to PRJ-06, SRC-10, SRC-27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_rows(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """One row for each top-level key of a JSON payload, its value in the slot of its type (PRJ-05): ``id_col``,
    ``attribute``, ``value_text``, ``value_num``, ``value_json``. Booleans are numbers; a payload that is no object
    gives no rows."""
    entries = F.map_entries(F.from_json(payload, "map<string,string>"))
    long = df.select(id_col, F.inline(entries).alias("attribute", "raw")).where(F.col("raw").isNotNull())
    number = F.when(F.col("raw") == "true", 1.0).when(F.col("raw") == "false", 0.0).otherwise(F.col("raw").try_cast("double"))
    nested = F.col("raw").startswith("{") | F.col("raw").startswith("[")
    return long.select(
        id_col, "attribute", F.when(number.isNull() & ~nested, F.col("raw")).alias("value_text"), number.alias("value_num"), F.when(nested, F.col("raw")).alias("value_json")
    )


def scalar_fields(payload: Column, fields: dict[str, str], digits: int = 3) -> list[Column]:
    """Named numbers by path, rounded (PRJ-04)."""
    return [F.round(F.get_json_object(payload, path).try_cast("double"), digits).alias(name) for name, path in fields.items()]


def without_packed(payload: Column) -> Column:
    """JSON without its packed arrays (PRJ-06): objects that name an encoding become null."""
    return F.regexp_replace(payload, r'\{[^{}]*"encoding"\s*:\s*"float16\+zlib\+base64"[^{}]*\}', "null")


def last_successes(results: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last successful row of each key (SRC-10, SRC-07)."""
    columns = [c for c in results.columns if c not in keys]
    best = results.where(F.col("status") == "success").groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in columns))

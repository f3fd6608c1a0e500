"""JSON in and out: bulk rows for upserts, and results with bytes, identities and times in their JSON forms."""

from __future__ import annotations

import base64
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.catalog import Catalog, Table, TidelogError
from tidelog.plans.analyze import coerce, json_params


def bulk_rows(spark: SparkSession, catalog: Catalog, text: str) -> dict[str, DataFrame]:
    """Rows by table from {"tables": {name: [row, ...]}}; missing columns get their kind's zero. The order of rows is in column _order."""
    try:
        tables = json.loads(text)["tables"]
    except (ValueError, KeyError, TypeError):
        raise TidelogError("bad_json", "expected {\"tables\": {...}}") from None
    out = {}
    for name, rows in tables.items():
        t = catalog.get(name)
        made = []
        for i, row in enumerate(rows):
            if extra := set(row) - set(t.names):
                raise TidelogError("unknown_column", f"{name} has no column {sorted(extra)[0]}")
            values = json_params(row)
            made.append(tuple(coerce(c, values.get(c.name)) for c in t.columns) + (i,))
        out[name] = spark.createDataFrame(made, T.StructType([*t.spark_schema().fields, T.StructField("_order", T.LongType())]), verifySchema=False)
    return out


def json_columns(df: DataFrame, table: Table | None = None) -> DataFrame:
    """Columns as JSON has them: bytes base64, identities hex, times in microseconds."""
    kinds = {c.name: c.kind for c in table.columns} if table else {}

    def of(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.BinaryType):
            return (F.lower(F.hex(c)) if kinds.get(f.name) == "identity" else F.base64(c)).alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType | T.TimestampType):
            return F.unix_micros(c.cast("timestamp")).alias(f.name)
        return c

    return df.select(*map(of, df.schema))


def result_json(df: DataFrame, table: Table | None = None) -> str:
    """{"columns": [...], "rows": [[...], ...]} of a result that was checked for its size."""
    shown = json_columns(df, table)

    def cell(v: Any) -> Any:
        return base64.b64encode(v).decode() if isinstance(v, bytes | bytearray) else float(v) if hasattr(v, "as_tuple") and v % 1 else int(v) if hasattr(v, "as_tuple") else v

    return json.dumps({"columns": shown.columns, "rows": [[cell(v) for v in r] for r in shown.collect()]})


def write_json(df: DataFrame, path: str, table: Table | None = None) -> None:
    """The result as JSON lines, written by the executors; of any size."""
    json_columns(df, table).write.mode("overwrite").json(path)

"""Registered queries: a name, a plan over the domain views, and SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import VIEW_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def needed_views(sql: str) -> list[str]:
    """Views that a text names, with those that they are made of, in the order of their definition."""
    found = {v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)}
    while more := {v for f in found for v in VIEW_SQL if v not in found and re.search(rf"\b{v}\b", VIEW_SQL[f])}:
        found |= more
    return [v for v in VIEW_SQL if v in found]


def whole_numbers(df: DataFrame) -> DataFrame:
    """Amounts as long, as DuckDB's side gives them; the operators themselves keep ``decimal(38,0)``."""
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() == "decimal(38,0)"]
    return df.withColumns({n: F.col(n).cast("long") for n in wide}) if wide else df


#: Queries that read transfers several times: a five-table join that is then written once.
STORED = {"flow_rollup", "flow_stats", "flow_by_entity", "flow_totals", "flow_hours", "flow_entities", "gate", "filter_stats", "selective_capture", "block_aggregate", "window_totals", "det_anomaly", "det_whale", "whale_entries", "smart_money"}


def register(name: str, plan: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: whole_numbers(plan(Views(spark, sf_dir).stored() if name in STORED else Views(spark, sf_dir)))
    if sql is not None:
        used = needed_views(sql)
        body = sql.strip()
        ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in used)
        if used and (head := re.match(r"WITH( RECURSIVE)?\b", body, re.I)):
            body = f"{head[0]} {ctes},\n{body[head.end():].lstrip()}"
        elif used:
            body = f"WITH {ctes}\n{body}"
        ORACLE_SQL[name] = body

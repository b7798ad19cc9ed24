"""Registries of user functions.  All of them work on DataFrames and Columns, so Spark plans and runs what they say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import canonical, total
from ..registry import register


class Analyzers:
    """Named transforms of one DataFrame of subjects into findings."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str) -> Callable:
        def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self.known:
                raise ValueError(f"{name} is registered")
            self.known[name] = f
            return f

        return keep

    def run(self, name: str, subjects: DataFrame, **options) -> DataFrame:
        return subjects.transform(self.known[name], **options).withColumn("analyzer", F.lit(name))

    def run_all(self, subjects: DataFrame) -> DataFrame:
        """The findings of all analyzers, one below another, missing columns as null."""
        first, *rest = [self.run(n, subjects) for n in sorted(self.known)]
        for df in rest:
            first = first.unionByName(df, allowMissingColumns=True)
        return first


class Skills:
    """Named transforms of several inputs; what a skill requires is checked before it runs."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}

    def add(self, name: str, requires: tuple[str, ...]) -> Callable:
        def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.known[name] = (requires, f)
            return f

        return keep

    def run(self, name: str, inputs: dict[str, DataFrame], **options) -> DataFrame:
        requires, f = self.known[name]
        if lacking := [r for r in requires if r not in inputs]:
            raise ValueError(f"{name} needs {', '.join(lacking)}")
        return f(*[inputs[r] for r in requires], **options)


class Models:
    """A prediction per metric: a function of columns, built-in or a pandas UDF; without one, ``otherwise``."""

    def __init__(self, otherwise: Callable[[Column], Column]) -> None:
        self.known: dict[str, Callable[[Column], Column]] = {}
        self.otherwise = otherwise

    def add(self, metric: str, f: Callable[[Column], Column]) -> None:
        self.known[metric] = f

    def predict(self, rows: DataFrame, metric: str, value: str) -> DataFrame:
        """``rows`` with ``prediction`` by the metric that each row names."""
        out = self.otherwise(F.col(value))
        for name, f in self.known.items():
            out = F.when(F.col(metric) == name, f(F.col(value))).otherwise(out)
        return rows.withColumn("prediction", out)


def rescored(rows: DataFrame, score: str, *boosts: Column | Callable[[DataFrame], Column], keep: Column | None = None) -> DataFrame:
    """``rows`` whose ``score`` has the boosts added, best first within the plan's own order; ``keep`` filters."""
    if keep is not None:
        rows = rows.where(keep)
    for b in boosts:
        rows = rows.withColumn(score, F.col(score) + (b(rows) if callable(b) and not isinstance(b, Column) else b))
    return rows


analyzers, skills, models = Analyzers(), Skills(), Models(lambda x: x)


@analyzers.add("large")
def large(transfers: DataFrame) -> DataFrame:
    return transfers.where("value >= 9000000").groupBy("from_address").agg(F.count(F.lit(1)).alias("hits"))


@analyzers.add("creations")
def creations(transfers: DataFrame) -> DataFrame:
    return transfers.where("to_address is null").groupBy("from_address").agg(F.count(F.lit(1)).alias("hits"))


@skills.add("canonical_volume", ("transfers", "blocks"))
def canonical_volume(transfers: DataFrame, blocks: DataFrame, least: int = 0) -> DataFrame:
    return canonical(transfers, blocks).groupBy("chain").agg(total("value", F.col("value") >= least).alias("volume"))


models.add("click", lambda x: x * 2)
models.add("view", lambda x: -x)
register("udf_detector", lambda v: analyzers.run_all(v.txn), "SELECT from_address, count(*) AS hits, 'large' AS analyzer FROM txn WHERE value >= 9000000 GROUP BY 1 UNION ALL SELECT from_address, count(*), 'creations' FROM txn WHERE to_address IS NULL GROUP BY 1")
register("udf_skill", lambda v: skills.run("canonical_volume", {"transfers": v.txn, "blocks": v.blk}, least=5_000_000), "SELECT chain, coalesce(sum(value) FILTER (WHERE value >= 5000000), 0)::BIGINT AS volume FROM txn t WHERE EXISTS (SELECT 1 FROM blk b WHERE b.canonical AND b.chain = t.chain AND b.number = t.block_number) GROUP BY chain")
register("udf_model", lambda v: models.predict(v.events, "event_type", "value").select("event_id", F.round("prediction", 6).alias("prediction")), "SELECT event_id, round(CASE event_type WHEN 'click' THEN value * 2 WHEN 'view' THEN -value ELSE value END, 6) AS prediction FROM events")
register("udf_score", lambda v: rescored(v.events.select("event_id", "event_type", "user_id", "value"), "value", F.when(F.col("event_type") == "purchase", 10.0).otherwise(0.0), lambda df: df["user_id"] % 3, keep=F.col("event_type") != "error").select("event_id", F.round("value", 6).alias("value")), "SELECT event_id, round(value + CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END + user_id % 3, 6) AS value FROM events WHERE event_type <> 'error'")

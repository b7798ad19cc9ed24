"""Reorganisations of a chain as streaming state, withdrawal of what they orphan, and budgets of alerts."""

from __future__ import annotations

import heapq
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_folder
from ..registry import register
from .streams import events_stream, run_once

WINDOW = 512
VERDICT = "chain string, arrival long, number long, hash string, verdict string, depth int, ancestor long, lower_bound boolean, crossed_finality boolean, orphaned array<string>"
#: Blocks as they arrive, how many a task judges before it hands on their verdicts, and how many it sorts in memory.
ARRIVING = pa.schema([("arrival", pa.int64()), ("number", pa.int64()), ("hash", pa.large_string()), ("parent", pa.large_string())])
STEP, RUN = 5000, 100_000


class Recent:
    """The recent blocks of a chain by height, at most ``window``, and the highest final height."""

    def __init__(self, heights: list[int], hashes: list[str], final: int | None, window: int) -> None:
        self.at, self.final, self.window = dict(sorted(zip(heights, hashes))), final, window

    def base(self, number: int, parent: str) -> int | None:
        """Walk down from a block: the highest stored height that it leaves standing, None if all that is stored falls.

        Its parent's place is the first step.  If another block is stored there,
        that one falls too, and what is stored beneath is as far as one can tell.
        """
        if self.at.get(number - 1) == parent:
            return number - 1
        return max((h for h in self.at if h < number - 1), default=None)

    def observe(self, number: int, block: str, parent: str) -> tuple:
        """Verdict, depth, ancestor, whether the depth is a lower bound, whether it crossed finality, and the orphaned hashes.

        The verdict follows from what falls above the ancestor: nothing for a
        block on the tip, and blocks outside of what is stored are not judged.
        """
        low, tip = next(iter(self.at), number), next(reversed(self.at), number)  # heights are in order
        if number == tip + 1 and self.at.get(tip) == parent:  # the usual case, without a look at the others
            self.at[number] = block
            if len(self.at) > self.window:
                del self.at[low]
            return "extended", None, None, False, False, []
        ancestor = self.base(number, parent)
        falls = sorted(h for h in self.at if ancestor is None or h > ancestor)
        rules = {"initial": not self.at, "duplicate": self.at.get(number) == block, "gap": number > tip + 1, "below_window": number < low, "extended": not falls}
        verdict = next((name for name, holds in rules.items() if holds), "reorg")
        if verdict != "reorg":
            if verdict in ("initial", "extended"):
                self.store(number, block, [])
            return verdict, None, None, False, False, []
        # What crosses finality is reported and needs a decision: nothing is rewritten.
        crossed = self.final is not None and falls[0] <= self.final
        orphaned = [] if crossed else [self.at[h] for h in falls]
        if not crossed:
            self.store(number, block, falls)
        return "reorg", len(falls), ancestor, ancestor is None, crossed, orphaned

    def store(self, number: int, block: str, falls: list[int]) -> None:
        """Put a block in place of those that fall; the window keeps the highest."""
        kept = {h: x for h, x in self.at.items() if h not in falls} | {number: block}
        self.at = {h: kept[h] for h in sorted(kept)[-self.window :]}


def in_order(tables: Iterable[pa.Table], step: int, run: int) -> Iterator[tuple]:
    """Rows of ``ARRIVING`` in order, nulls last.

    ``run`` rows or so are sorted in memory and written to a folder of the task's
    own; where such runs are merged, a step of each is in memory.
    """
    by = [(c, "ascending") for c in ARRIVING.names]

    def rows(part: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
        for a, n, h, p in zip(*[c.to_pylist() for c in part.columns]):
            yield (a is None, a or 0, n is None, n or 0, h is None, h or "", p is None, p or ""), (a, n, h, p)

    def steps(held: list[pa.Table]) -> Iterator[pa.Table]:
        whole = pa.concat_tables(held)
        order = pc.sort_indices(whole, by)
        for at in range(0, len(order), step):
            yield whole.take(order[at : at + step])

    def stored(path: str) -> Iterator[pa.RecordBatch]:
        with pa.OSFile(path) as file:
            reader = pa.ipc.open_file(file)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k)

    def out(parts: Iterable) -> Iterator[tuple]:
        for part in parts:
            yield from rows(part)

    with tempfile.TemporaryDirectory() as folder:
        held, size, paths = [], 0, []
        for table in tables:
            held.append(table)
            size += len(table)
            if size >= run:
                paths.append(os.path.join(folder, str(len(paths))))
                with pa.OSFile(paths[-1], "wb") as file, pa.ipc.new_file(file, ARRIVING) as writer:
                    for part in steps(held):
                        writer.write_table(part)
                held, size = [], 0
        runs = [out(stored(p)) for p in paths] + [out(steps(held))] * bool(held)
        for _, row in heapq.merge(*runs):
            yield row


def reorgs(blocks: DataFrame, final_depth: int | None = None, window: int = WINDOW) -> DataFrame:
    """A verdict on each arriving block (``chain, arrival, number, hash, parent``), by the recent blocks of its chain.

    Arrivals of a batch are taken in order of ``arrival``.  With ``final_depth``,
    blocks that deep under the tip are final.
    """

    names = [c.strip().split(" ")[0] for c in VERDICT.split(", ")]

    def track(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        heights, hashes, final = state.get if state.exists else ([], [], None)
        recent = Recent(list(heights), list(hashes), final, window)
        # A batch of a chain is read as Arrow columns, ordered in runs, and handed on a step at a time.
        tables = (pa.Table.from_pandas(f[["arrival", "number", "hash", "parent"]], ARRIVING, preserve_index=False) for f in frames)
        rows, last = in_order(tables, STEP, RUN), None
        while step := list(itertools.islice(rows, STEP)):
            if last is not None:
                yield last
            out = []
            for a, n, h, p in step:
                out.append((key[0], a, n, h, *recent.observe(n, h, p)))
                if final_depth is not None and recent.at:
                    recent.final = max(recent.final if recent.final is not None else -1, next(reversed(recent.at)) - final_depth)
            last = pd.DataFrame(out, columns=names).astype({"depth": "Int32", "ancestor": "Int64"})
        state.update((list(recent.at), list(recent.at.values()), recent.final))  # before the last step is handed on
        if last is not None:
            yield last

    return blocks.groupBy("chain").applyInPandasWithState(track, VERDICT, "heights array<long>, hashes array<string>, final long", "append", GroupStateTimeout.NoTimeout)


CHANGES = "chain string, hash string, number long, arrival long, added boolean"


def stored_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished tables ``at=N`` of a folder, as the storage lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(n[3:]) for n in names if n.startswith("at="))


def canonical_blocks(spark: SparkSession, base: str) -> DataFrame:
    """``chain, number, hash`` of a table of ``withdrawn``: its last compaction and the changes after it; the last change of a block holds."""
    whole, steps = stored_batches(spark, f"{base}/whole"), stored_batches(spark, f"{base}/changes")
    last = whole[-1] if whole else -1
    paths = [f"{base}/whole/at={last}"] * bool(whole) + [f"{base}/changes/at={k}" for k in steps if k > last]
    if not paths:
        return spark.createDataFrame([], "chain string, number long, hash string")
    rows = spark.read.schema(CHANGES).parquet(*paths)
    final = rows.groupBy("chain", "hash").agg(F.max_by(F.struct("number", "added"), F.struct("arrival", "added")).alias("x"))
    return final.where("x.added").select("chain", "x.number", "hash")


def withdrawn(verdicts: DataFrame, base: str | None = None, compact_every: int = 20) -> DataFrame:
    """Run a stream of verdicts into a table of canonical blocks in ``base``.

    A batch writes its changes only: blocks that it adds, and keys of those that
    a reorganisation withdraws, each with its arrival, so a block may come back.
    Every ``compact_every`` batches the table as it stands is written whole, and
    readers start from there.  What exists is read from the storage, so a run
    that starts again in the same folder goes on where the last one ended, and a
    batch that runs twice replaces its own changes.
    """
    spark = verdicts.sparkSession
    base = base or f"{shared_folder(spark)}/canonical-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, batch_id: int) -> None:
        # Both kinds of changes come from one look at a verdict: the batch is run once.
        change = lambda h, n, added: F.struct(h.alias("hash"), n.cast("long").alias("number"), F.lit(added).alias("added"))
        fresh = F.expr("verdict in ('initial', 'extended') or (verdict = 'reorg' and not crossed_finality)")
        gone = F.coalesce(F.transform("orphaned", lambda h: change(h, F.lit(None), False)), F.array().cast("array<struct<hash:string,number:bigint,added:boolean>>"))
        each = F.concat(gone, F.when(fresh, F.array(change(F.col("hash"), F.col("number"), True))).otherwise(F.array().cast("array<struct<hash:string,number:bigint,added:boolean>>")))
        batch.select("chain", "arrival", F.explode(each).alias("x")).select("chain", "x.hash", "x.number", "arrival", "x.added").write.mode("overwrite").parquet(f"{base}/changes/at={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            whole = canonical_blocks(spark, base).select("chain", "hash", "number", F.lit(-1).cast("long").alias("arrival"), F.lit(True).alias("added"))
            whole.write.mode("overwrite").parquet(f"{base}/whole/at={batch_id}")

    verdicts.writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return canonical_blocks(spark, base)


def within_budget(alerts: DataFrame, key: str, order: str, budget: int) -> DataFrame:
    """The first ``budget`` alerts of each ``key``, by ``order`` within a batch: ``key, order, nth``."""
    schema = f"{key} string, {order} long, nth long"

    def spend(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        left = sorted(x for f in frames for x in f[order].nlargest(len(f)))[: max(budget - spent, 0)]
        state.update((spent + len(left),))
        yield pd.DataFrame({key: [k[0]] * len(left), order: left, "nth": range(spent + 1, spent + len(left) + 1)}).astype({key: "object", order: "int64", "nth": "int64"})

    return alerts.select(key, order).groupBy(key).applyInPandasWithState(spend, schema, "spent long", "append", GroupStateTimeout.NoTimeout)


def arriving_blocks(v) -> DataFrame:
    """Blocks made of events: five chains that extend, repeat a block, skip ahead, and fork three blocks back every twenty arrivals."""
    i = "(event_id div 5)"
    name = lambda k: f"md5(concat(event_id % 5, '|', {k}))"
    own = f"CASE WHEN {i} % 20 = 7 THEN {i} - 1 ELSE {i} END"
    above = f"CASE WHEN {i} % 20 = 0 THEN {i} - 4 WHEN {i} % 20 IN (7, 8, 16) THEN {i} - 2 ELSE {i} - 1 END"
    number = f"{i} - 5 * ({i} div 20) - CASE WHEN {i} % 20 >= 7 THEN 1 ELSE 0 END - CASE WHEN {i} % 20 > 15 THEN 1 ELSE 0 END + CASE WHEN {i} % 20 = 15 THEN 4 ELSE 0 END"
    return events_stream(v).selectExpr("concat('c', event_id % 5) AS chain", "event_id AS arrival", f"CAST({number} AS BIGINT) AS number", f"{name(own)} AS hash", f"{name(above)} AS parent")


ARRIVE = "a AS (SELECT event_id, concat('c', event_id % 5) AS chain, event_id // 5 AS i, max(event_id // 5) OVER (PARTITION BY event_id % 5) AS last, row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) AS r FROM events), b AS (SELECT *, i - 5 * (i // 20) - CASE WHEN i % 20 >= 7 THEN 1 ELSE 0 END - CASE WHEN i % 20 > 15 THEN 1 ELSE 0 END + CASE WHEN i % 20 = 15 THEN 4 ELSE 0 END AS number, CASE WHEN r = 1 THEN 'initial' WHEN i % 20 = 0 THEN 'reorg' WHEN i % 20 = 7 THEN 'duplicate' WHEN i % 20 = 15 THEN 'gap' ELSE 'extended' END AS verdict FROM a)"
register("st_reorg", lambda v: run_once(reorgs(arriving_blocks(v))).select("arrival", "number", "verdict", "depth", "ancestor", F.size("orphaned").alias("n_orphaned")), f"WITH {ARRIVE} SELECT event_id AS arrival, number, verdict, CASE WHEN verdict = 'reorg' THEN 3 END AS depth, CASE WHEN verdict = 'reorg' THEN number - 1 END AS ancestor, CASE WHEN verdict = 'reorg' THEN 3 ELSE 0 END AS n_orphaned FROM b")
register("st_withdraw", lambda v: withdrawn(reorgs(arriving_blocks(v))), f"WITH {ARRIVE} SELECT chain, number, md5(concat(event_id % 5, '|', i)) AS hash FROM b WHERE verdict IN ('initial', 'extended', 'reorg') AND NOT (i % 20 >= 17 AND (i // 20 + 1) * 20 <= last)")
register("st_alert_budget", lambda v: run_once(within_budget(events_stream(v).where("event_type = 'error'").selectExpr("concat(user_id % 10, ':', date_format(ts, 'yyyy-MM-dd')) AS budget_key", "event_id"), "budget_key", "event_id", 3)), "SELECT budget_key, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY budget_key ORDER BY event_id) AS nth FROM (SELECT concat(user_id % 10, ':', strftime(ts, '%Y-%m-%d')) AS budget_key, event_id FROM events WHERE event_type = 'error')) WHERE nth <= 3")

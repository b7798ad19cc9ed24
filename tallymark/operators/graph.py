"""Transfer graphs: edges, pruning, hops, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import register
from .evidence import all_links
from .ledger import CANON, canonical, total


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop with a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edges(transfers: DataFrame) -> DataFrame:
    """Parallel transfers as one weighted edge; null ends are skipped."""
    return transfers.where("from_address is not null and to_address is not null").groupBy(F.col("from_address").alias("src"), F.col("to_address").alias("dst")).agg(total("value").alias("weight"), F.count(F.lit(1)).alias("n"))


def prune(graph: DataFrame, least) -> DataFrame:
    """Heavy edges, with the adjacency of each node left."""
    return graph.where(F.col("weight") >= least).groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("adjacent"), F.count(F.lit(1)).alias("degree"))


def reachable(graph: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """Least number of hops to each node within ``hops``: frontier joins, each cut."""
    undirected = written(graph.select("src", "dst").union(graph.select("dst", "src")).distinct())
    seen = written(starts.select(F.col("node"), F.lit(0).alias("depth")))
    frontier = seen
    for depth in range(1, hops + 1):
        frontier = written(frontier.join(undirected, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = written(seen.unionByName(frontier))
    return seen


def shortest_path(graph: DataFrame, source: str, target: str, hops: int = 4) -> DataFrame:
    """The least path (by name) of fewest hops between two nodes: one path per frontier node."""
    undirected = written(graph.select("src", "dst").union(graph.select("dst", "src")).distinct())
    frontier = seen = written(graph.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>"))
    for _ in range(hops):
        step = frontier.join(undirected, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = written(step.join(seen.select("node"), "node", "left_anti"))
        seen = written(seen.unionByName(frontier))
    return seen.where(F.col("node") == target).select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


def rooted(label: DataFrame) -> DataFrame:
    """``node, comp`` with each node at the root of its tree, by pointer jumps; ``comp`` is a node too, and no greater."""
    while True:
        far = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        label = written(label.join(far, "comp").select("node", F.col("far").alias("comp"), (F.col("far") != F.col("comp")).alias("moved")))
        if label.where("moved").isEmpty():
            return label.select("node", "comp")


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of undirected pairs: the least node's name, by contraction.

    Each node goes to its least neighbour, trees become their roots, and only
    edges between roots are left: of two rounds, one halves the nodes at least,
    so what is shuffled shrinks with each and does not come again as a whole.
    """
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    edges, labels = written(pairs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))), []
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
        label = rooted(written(ends.groupBy("node").agg(F.least("node", F.min("near")).alias("comp"))))
        labels.append(label)
        at = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))  # noqa: B023, E731
        left = edges.join(at("a"), "a").select("a_comp", "b").distinct().join(at("b"), "b").where("a_comp <> b_comp")
        edges = written(left.select(F.least("a_comp", "b_comp").alias("a"), F.greatest("a_comp", "b_comp").alias("b")).distinct())
    comp = nodes.withColumn("comp", F.col("node"))
    for label in labels:
        further = label.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        comp = comp.join(further, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp"))
    return written(comp)


def clusters(links: DataFrame) -> DataFrame:
    """Components of links ``a, b, confidence, relation`` (and ``evidence``): size, weakest link, number of links, kinds of relation, and how many pieces of evidence, with the least."""
    comp = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    size = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    proof = [F.countDistinct("evidence").alias("proofs"), F.min("evidence").alias("evidence")] if "evidence" in links.columns else []
    inside = links.join(comp, F.col("a") == F.col("node")).groupBy("comp").agg(F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("links"), F.array_join(F.array_sort(F.collect_set("relation")), ",").alias("relations"), *proof)
    return size.join(inside, "comp")


EDGE = f"{CANON}, ed AS (SELECT from_address AS src, to_address AS dst, sum(value)::BIGINT AS weight, count(*) AS n FROM c WHERE to_address IS NOT NULL GROUP BY ALL)"
graph = lambda v: edges(canonical(v.txn, v.blk))
register("edges", lambda v: graph(v).select("src", "dst"), f"WITH {EDGE} SELECT src, dst FROM ed")
register("aggregate_edges", graph, f"WITH {EDGE} SELECT * FROM ed")
register("prune", lambda v: prune(graph(v), 9_000_000), f"WITH {EDGE} SELECT src, string_agg(dst, ',' ORDER BY dst) AS adjacent, count(*) AS degree FROM ed WHERE weight >= 9000000 GROUP BY src")
register(
    "reachable",
    lambda v: reachable(graph(v), v.spark.createDataFrame([("s1",)], "node string"), 3),
    f"WITH {EDGE}, u AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed), h0 AS (SELECT 's1' AS node, 0 AS depth), h1 AS (SELECT DISTINCT b AS node, 1 AS depth FROM u JOIN h0 ON a = node), h2 AS (SELECT DISTINCT b AS node, 2 AS depth FROM u JOIN h1 ON a = node), h3 AS (SELECT DISTINCT b AS node, 3 AS depth FROM u JOIN h2 ON a = node) SELECT node, min(depth) AS depth FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) GROUP BY node",
)
register("shortest_path", lambda v: shortest_path(graph(v), "c1", "c2"))
register("clusters", lambda v: clusters(written(all_links(v))))
register("top_token_graph", lambda v: v.ttx.orderBy(F.desc("value"), "log_index").limit(60).groupBy("from_address", "to_address").agg(F.min("log_index").alias("first_edge")), "SELECT from_address, to_address, min(log_index) AS first_edge FROM (SELECT * FROM ttx ORDER BY value DESC, log_index LIMIT 60) GROUP BY ALL")

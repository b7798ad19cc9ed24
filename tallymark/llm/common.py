"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, level: int = 3) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    For loops over joins: a checkpoint keeps the size estimate of its plan, which
    such loops multiply up without end; a table's size is that of its files.
    ``level``: of zstd.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table = path
    return out


def renamed(table: DataFrame, **names: str) -> DataFrame:
    """Some columns of a table of ``written`` under other names."""
    out = table.select(*[F.col(c).alias(names.get(c, c)) for c in table.columns])
    out.table = table.table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table)
        path.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def strip_ascii(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def words(c: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def sha256_text(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def one_each(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row of each ``key``: the least by all ``columns``, so that reruns agree."""
    return rows.groupBy(key).agg(F.min(F.struct(*columns)).alias("least")).select("least.*")


def parallel(df: DataFrame, least: int = 1) -> int:
    """Partitions for one shuffle: what the session sets for shuffles."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def row_key() -> Column:
    """Tells rows apart by id and text."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")


def numbered(rows: DataFrame, row: str = "row", copy: str = "copy", salts: int = 64) -> DataFrame:
    """``rows`` with a number 0, 1, ... among those of equal ``row``.

    Few rows repeat as a rule, and only these are counted: in ``salts`` parts
    each, so that no task orders a large group of them.
    """
    often = cut(rows.groupBy(F.col(row).alias("__often")).count().where("count > 1").select("__often"))
    if often.isEmpty():
        return rows.withColumn(copy, F.lit(0).cast("long"))
    match = F.col(row) == F.col("__often")
    some = cut(rows.join(often, match, "left_semi").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))))
    held = some.groupBy(F.col(row).alias("__of"), F.col("__salt").alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__of").orderBy("__part")) - F.col("__n")
    held = held.select("__of", "__part", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy(row, "__salt").orderBy(F.lit(0)))
    counted = some.withColumn("__nth", nth).join(held, (F.col(row) == F.col("__of")) & (F.col("__salt") == F.col("__part")))
    counted = counted.select(*rows.columns, (F.col("__before") + F.col("__nth") - 1).alias(copy))
    return rows.join(often, match, "left_anti").withColumn(copy, F.lit(0).cast("long")).unionByName(counted)

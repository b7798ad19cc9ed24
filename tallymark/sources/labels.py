"""Address-label files: CSV and TSV with or without a header, JSON objects or lists, plain text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import parse_address
from ..operators.graph import shared_folder
from ..registry import register

# Header names of each field, in the order in which fields claim a column.
FIELDS = {
    "address": ["address", "addr", "wallet", "account"],
    "entity": ["entity", "cexname", "exchange", "owner", "operator", "organisation", "organization", "org", "name"],
    "label": ["label", "distinctname", "tag", "nametag", "note", "description"],
    "category": ["category", "type", "kind"],
    "chain": ["chain", "network", "blockchain"],
}
PARTIAL = 4  # the shortest name that may match inside a longer header
FIELD_NAMES = list(FIELDS)


def map_header(names: list[str]) -> dict[str, int]:
    """Field -> column.  All matches of a name with a column are ranked, and the best that is still free on both sides is taken.

    A whole match ranks before a name inside a longer header, then the order of fields, of their names and of columns.
    """
    plain = ["".join(c for c in n.strip().lower() if c not in "_- ") for n in names]
    known = [(f, r, k) for f, field in enumerate(FIELD_NAMES) for r, k in enumerate(FIELDS[field])]
    ranked = sorted((k != n, f, r, i) for f, r, k in known for i, n in enumerate(plain) if k == n or len(k) >= PARTIAL and k in n)
    found: dict[str, int] = {}
    for _, f, _, i in ranked:
        if FIELD_NAMES[f] not in found and i not in found.values():
            found[FIELD_NAMES[f]] = i
    return found


def read_table(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Fields of the rows of a delimited file.  The first row is a header unless one of its cells is an address."""
    first = next((r[0] for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect()), "")
    head = [c.strip().strip('"') for c in first.split(separator)]
    is_row = spark.range(1).select(*[parse_address(F.lit(c)).isNotNull().alias(f"c{i}") for i, c in enumerate(head)]).first()
    at = {"address": 0, "entity": 1} if any(is_row) else map_header(head)
    if "address" not in at:
        raise ValueError(f"no address column among {', '.join(head)}")
    rows = spark.read.option("header", not any(is_row)).option("sep", separator).csv(path)
    names = rows.columns
    return rows.select(*[(F.trim(F.col(f"`{names[at[f]]}`")) if f in at and at[f] < len(names) else F.lit(None).cast("string")).alias(f) for f in FIELD_NAMES])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a text file: an address per line, a name may follow; # begins a comment."""
    line = F.regexp_replace(F.trim("value"), r"[\t,]", " ")
    rows = spark.read.text(path).select(line.alias("x")).where("x <> '' and not startswith(x, '#')")
    blank = [F.lit(None).cast("string").alias(f) for f in FIELD_NAMES[2:]]
    return rows.select(F.regexp_extract("x", r"^(\S+)", 1).alias("address"), F.nullif(F.regexp_extract("x", r"^\S+\s+(.*)$", 1), F.lit("")).alias("entity"), *blank)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a JSON file: an object of address -> name, a list of addresses, or a list of objects."""
    whole = spark.read.text(path, wholetext=True)
    start = whole.select(F.substring(F.ltrim("value"), 1, 1)).first()[0]
    blank = [F.lit(None).cast("string").alias(f) for f in FIELD_NAMES[2:]]
    if start == "{":
        pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("address", "entity"))
        return pairs.select("address", "entity", *blank)
    each = whole.select(F.explode(F.from_json("value", "array<string>")).alias("x"))
    as_map = F.from_json("x", "map<string,string>")
    keys = sorted(k for (k,) in each.where("startswith(x, '{')").select(F.explode(F.map_keys(as_map))).distinct().collect() if k)  # names of fields only
    at = map_header(keys)
    named = each.select("x", as_map.alias("m"))
    value = lambda f: F.element_at("m", F.lit(keys[at[f]])) if f in at else F.lit(None).cast("string")
    return named.select(F.when(F.col("x").startswith("{"), value("address")).otherwise(F.col("x")).alias("address"), *[F.when(F.col("x").startswith("{"), value(f)).alias(f) for f in FIELD_NAMES[1:]])


def label_rows(raw: DataFrame, source: str, chain: str = "evm", category: str = "exchange", categories: tuple[str, ...] = ("exchange", "bridge", "mining_pool", "contract"), confidence: float = 0.5) -> DataFrame:
    """Raw fields as labels with a ``reject`` reason: null for those to load; of an address that repeats, one stays."""
    own_chain, text = F.coalesce(F.nullif("chain", F.lit("")), F.lit(chain)), F.trim(F.coalesce("entity", F.lit("")))
    address, kind = parse_address(F.col("address")), F.lower(F.trim(F.coalesce(F.nullif("category", F.lit("")), F.lit(category))))
    name = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.nullif(text, F.lit("")))
    reject = F.when(F.col("clean").isNull(), "not an address").when((F.col("own_chain") == "evm") & ~F.col("clean").startswith("0x"), "not an address of this chain").when(~F.col("kind").isin(*categories), "unknown category")
    rows = raw.select(F.col("address").alias("raw_address"), address.alias("clean"), own_chain.alias("own_chain"), kind.alias("kind"), name.alias("name"), F.nullif(text, F.lit("")).alias("owner"))
    rows = rows.withColumn("reject", reject)
    good = rows.where("reject is null").groupBy("own_chain", "clean").agg(F.min(F.struct("name", "owner", "kind")).alias("x"))
    short = F.concat(F.substring("address", 1, 6), F.lit("..."), F.substring("address", -4, 4))
    kept = good.select(F.col("own_chain").alias("chain"), F.col("clean").alias("address"), "x.*").select("chain", "address", F.coalesce("name", short).alias("label"), F.coalesce("owner", "name").alias("entity"), F.col("kind").alias("category"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("reject"))
    bad = rows.where("reject is not null").select(F.col("own_chain").alias("chain"), F.col("raw_address").alias("address"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("entity"), "kind", F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), "reject").withColumnRenamed("kind", "category")
    return kept.unionByName(bad)


def _written_files(v) -> dict[str, str]:
    """Label files in three formats over the supplier table."""
    base = f"{shared_folder(v.spark)}/labels-{uuid.uuid4().hex}"
    hexed = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 40, "0"))
    rows = v.supplier.select(F.when(F.col("s_suppkey") % 10 == 9, F.lit("broken")).otherwise(hexed(F.col("s_suppkey"))).alias("Wallet Address"), F.concat(F.lit("Owner "), F.col("s_nationkey").cast("string")).alias("distinct_entity"), F.when(F.col("s_suppkey") % 4 == 0, "Bridge").when(F.col("s_suppkey") % 4 == 1, "casino").otherwise("exchange").alias("type"), F.col("s_suppkey").alias("k"))
    rows.where("k % 3 = 0").drop("k").write.option("header", True).csv(f"{base}/a.csv")
    rows.where("k % 3 = 1").select(F.concat_ws(" ", "Wallet Address", "distinct_entity")).write.text(f"{base}/b.txt")
    rows.where("k % 3 = 2").select("Wallet Address", "distinct_entity", "type").agg(F.to_json(F.collect_list(F.struct("*"))).alias("x")).write.text(f"{base}/c.json")  # a file is read whole: label files are small
    return {"csv": f"{base}/a.csv", "txt": f"{base}/b.txt", "json": f"{base}/c.json"}


def _all_files(v) -> DataFrame:
    files = _written_files(v)
    one, two, three = label_rows(read_table(v.spark, files["csv"]), "csv"), label_rows(read_lines(v.spark, files["txt"]), "txt"), label_rows(read_json(v.spark, files["json"]), "json")
    return one.unionByName(two).unionByName(three)


register("label_files", lambda v: _all_files(v), """WITH r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN 'broken' ELSE concat('0x', lpad(lower(to_hex(s_suppkey)), 40, '0')) END AS address, concat('Owner ', s_nationkey) AS entity, CASE WHEN s_suppkey % 3 = 1 THEN 'exchange' WHEN s_suppkey % 4 = 0 THEN 'bridge' WHEN s_suppkey % 4 = 1 THEN 'casino' ELSE 'exchange' END AS category, CASE s_suppkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'txt' ELSE 'json' END AS source FROM supplier),
x AS (SELECT *, CASE WHEN address = 'broken' THEN 'not an address' WHEN category = 'casino' THEN 'unknown category' END AS reject FROM r)
SELECT 'evm' AS chain, address, CASE WHEN reject IS NULL THEN entity END AS label, CASE WHEN reject IS NULL THEN entity END AS entity, category, source, 0.5::DOUBLE AS confidence, reject FROM x""")

"""Column functions: addresses, quantities, amounts, keys; and the projections built on them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .chainlog import bound, uint_digits


def parse_address(c: Column) -> Column:
    """0x addresses in lower case with 40 hex digits; others 16 to 128 letters and digits, case kept; else null."""
    low = F.lower(F.trim(c))
    return F.when(low.startswith("0x"), F.when(low.rlike("^0x[0-9a-f]{40}$"), low)).when(F.trim(c).rlike("^[A-Za-z0-9]{16,128}$"), F.trim(c))


def address_kind(c: Column) -> Column:
    """Which address format a text has."""
    return F.when(c.rlike("^0x[0-9a-fA-F]{40}$"), "evm").when(c.rlike("^bc1[0-9a-z]{11,71}$"), "bech32").when(c.rlike("^inj1[0-9a-z]{38}$"), "inj").when(c.rlike("^[13][1-9A-HJ-NP-Za-km-z]{25,34}$"), "base58").otherwise("unknown")


def quantity_digits(c: Column) -> Column:
    """A hex quantity of up to 256 bits, or one of up to 78 decimal digits, as 78 digits with leading zeros; null for anything else.

    By Arrow batches, as 256 bits are more than Spark's numbers hold; within a
    higher-order function, ``nested_digits`` gives the same.
    """
    hexed, plain = re.compile("0x0*([0-9a-f]{1,64})"), re.compile("0*([0-9]{1,78})")

    def read(text: str | None) -> str | None:
        low = (text or "").lower().strip(" \t\r\n")
        if m := hexed.fullmatch(low):
            return str(int(m[1], 16)).zfill(78)
        return m[1].zfill(78) if (m := plain.fullmatch(low)) else None

    @F.pandas_udf("string")
    def digits(texts: pd.Series) -> pd.Series:
        return pd.Series([read(x) for x in texts], dtype=object)

    return digits(c)


def nested_digits(c: Column) -> Column:
    """As ``quantity_digits``, of built-in functions."""
    wide = lambda x: F.substring(F.concat(F.lit("0" * 78), x), -78, 78)

    def read(digits: Column) -> Column:  # 64 bits fit: the usual case, and far cheaper than limbs
        return F.when(F.length(digits) <= 16, wide(F.conv(digits, 16, 10))).otherwise(uint_digits(digits))

    def either(text: Column) -> Column:
        plain = bound(F.regexp_extract(text, r"^0*([0-9]{1,78})\z", 1), lambda x: F.when(x != "", wide(x)))
        return F.when(text.startswith("0x"), bound(F.regexp_extract(text, r"^0x0*([0-9a-f]{1,64})\z", 1), lambda x: F.when(x != "", read(x)))).otherwise(plain)

    return bound(F.btrim(F.lower(c), F.lit(" \t\r\n")), either)


def hex_quantity(c: Column) -> Column:
    """A hex or decimal quantity below 10^38 as decimal(38,0); null for anything else (wider ones: ``quantity_digits``)."""
    return bound(quantity_digits(c), lambda d: F.when(d.startswith("0" * 40), F.substring(d, 41, 38).cast("decimal(38,0)")))


def padded_key(c: Column) -> Column:
    """78 digits with leading zeros: text order is number order."""
    return F.lpad(c.cast("string"), 78, "0")


def tx_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("purchase"), "swap").when(low.contains("sign"), "mint").when(low.contains("err"), "burn").otherwise("transfer")


def content_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


register("parse_address", lambda v: v.txn.select("tx_key", parse_address(F.upper(F.substring("tx_key", 1, 42))).alias("short"), parse_address(F.concat(F.col("tx_key"), F.lit("00000000"))).alias("good"), parse_address(F.concat(F.lit("Zz"), "tx_key")).alias("base")), "SELECT tx_key, CAST(NULL AS VARCHAR) AS short, lower(concat(tx_key, '00000000')) AS good, concat('Zz', tx_key) AS base FROM txn")
register("validate_address", lambda v: v.txn.select("tx_key", address_kind(F.concat(F.col("tx_key"), F.lit("ABCDEF12"))).alias("a"), address_kind(F.concat(F.lit("bc1"), F.substring("tx_key", 3, 32))).alias("b"), address_kind(F.col("from_address")).alias("c")), "SELECT tx_key, 'evm' AS a, 'bech32' AS b, 'unknown' AS c FROM txn")
register(
    "hex_quantity",
    lambda v: v.txn.withColumn("h", F.lower(F.hex(F.col("value").cast("long")))).select(
        "tx_key", hex_quantity(F.concat(F.lit("0x"), "h")).alias("value"), quantity_digits(F.concat(F.lit("0x000"), "h", F.lit("0" * 16))).alias("shifted"), quantity_digits(F.concat(F.lit("0X"), F.lpad("h", 64, "f"))).alias("high"), hex_quantity(F.col("value").cast("string")).alias("plain"),
        quantity_digits(F.when(F.col("tx_index") % 4 == 0, F.concat(F.lit("-"), "h")).when(F.col("tx_index") % 4 == 1, "true").when(F.col("tx_index") % 4 == 2, F.concat(F.lit("0x1"), F.lpad("h", 64, "0"))).otherwise(F.concat(F.lit("0xg"), "h"))).alias("bad"),
    ),
    f"SELECT tx_key, value::BIGINT AS value, lpad((value::HUGEINT * 18446744073709551616)::VARCHAR, 78, '0') AS shifted, concat('{(2**256 - 2**64) // 10**39}', lpad(({(2**256 - 2**64) % 10**39 // 10**20}::HUGEINT + (({(2**256 - 2**64) % 10**20}::HUGEINT + ((1::HUGEINT << 64) - (1::HUGEINT << (4 * length(to_hex(value::BIGINT)))) + value::HUGEINT)) // {10**20}::HUGEINT))::VARCHAR, 19, '0'), lpad((({(2**256 - 2**64) % 10**20}::HUGEINT + ((1::HUGEINT << 64) - (1::HUGEINT << (4 * length(to_hex(value::BIGINT)))) + value::HUGEINT)) % {10**20}::HUGEINT)::VARCHAR, 20, '0')) AS high, value::BIGINT AS plain, CAST(NULL AS VARCHAR) AS bad FROM txn",
)
register("amount_units", lambda v: v.txn.select("tx_key", (F.col("value") / F.lit(100).cast("decimal(3,0)")).cast("decimal(30,2)").cast("double").alias("units")), "SELECT tx_key, CAST(value / 100 AS DECIMAL(30,2))::DOUBLE AS units FROM txn")
register("padded_key", lambda v: v.txn.groupBy("chain").agg(F.max(padded_key(F.col("value"))).alias("largest_key")), "SELECT chain, max(lpad(value::VARCHAR, 78, '0')) AS largest_key FROM txn GROUP BY chain")
register("tx_kind", lambda v: v.events.select("event_id", tx_kind(F.col("event_type")).alias("kind")), "SELECT event_id, CASE WHEN contains(lower(event_type), 'purchase') THEN 'swap' WHEN contains(lower(event_type), 'sign') THEN 'mint' WHEN contains(lower(event_type), 'err') THEN 'burn' ELSE 'transfer' END AS kind FROM events")
register("content_id", lambda v: v.events.select("event_id", content_id(F.lit("sim"), F.col("event_type"), F.col("props")).alias("id")), "SELECT event_id, substring(sha256(concat_ws('|', 'sim', event_type, props)), 1, 32) AS id FROM events")
label_reason = lambda: F.when(~F.col("address").rlike("^s[0-9]+$"), "bad address").when(F.col("category") == "contract", "unknown category")
register(
    "label_reject",
    lambda v: v.lbl.withColumn("reason", label_reason()).withColumn("r", F.row_number().over(Window.partitionBy("address", F.col("reason").isNull()).orderBy("source"))).select("address", "source", F.when(F.col("reason").isNull() & (F.col("r") > 1), "duplicate").otherwise(F.col("reason")).alias("reason")),
    "SELECT address, source, CASE WHEN reason IS NULL AND r > 1 THEN 'duplicate' ELSE reason END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY address, reason IS NULL ORDER BY source) AS r FROM (SELECT *, CASE WHEN category = 'contract' THEN 'unknown category' END AS reason FROM lbl))",
)
register("candles_source", lambda v: v.candle.unionByName(v.candle.where("symbol = 'view'").withColumn("close", F.col("close") + 1)).groupBy("symbol", "open_time").agg(F.round(F.max("close"), 6).alias("close")).where("open_time >= timestamp'2024-01-10' and open_time < timestamp'2024-01-12'"), "SELECT symbol, open_time, round(CASE WHEN symbol = 'view' THEN close + 1 ELSE close END, 6) AS close FROM candle WHERE open_time >= TIMESTAMP '2024-01-10' AND open_time < TIMESTAMP '2024-01-12'")
register("recent_items", lambda v: v.news.orderBy(F.desc("published_at"), F.desc("doc_id")).limit(50).select("doc_id", "source", "published_at", "title"), "SELECT doc_id, source, published_at, title FROM news ORDER BY published_at DESC, doc_id DESC LIMIT 50")

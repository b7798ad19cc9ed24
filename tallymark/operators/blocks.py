"""Recorded blocks judged: header rules, projected transactions with what is wrong in each, and findings on quality.

A block with a bad header is refused as a whole; a bad transaction is refused
alone and shows as a shortfall against the block's own count.  Everything about a
block is worked out in its own row, so nothing is shuffled.

Defined results: a payload that is null, no JSON or no object is refused with
``block: expected an object``; an entry that is only a hash counts but is no
transaction; heights and times beyond 18 decimal digits are unreadable; an absent value
is 0, one that is null is unreadable; other fields that cannot be read are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register
from .chainlog import block_hash
from .columns import nested_digits, parse_address

#: Fields a header must have, the finding that states its own limit, the earliest time.
REQUIRED = ("number", "hash", "parentHash", "timestamp")
BOUNDED = "selective_capture"
EARLIEST, DRIFT_SECONDS = "2015-01-01", 15 * 60
HEADER = "number string, hash string, parentHash string, timestamp string, gasUsed string, gasLimit string, miner string, transactions array<string>"
ENTRY = "hash string, `from` string, `to` string, value string, transactionIndex string, gas string, gasPrice string, nonce string, input string"


def long_quantity(c: Column) -> Column:
    """A quantity of up to 15 hex or 18 decimal digits as long, else null."""
    text = F.btrim(F.lower(c), F.lit(" \t\r\n"))
    hexed = F.regexp_extract(text, "^0x0*([0-9a-f]{1,15})$", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10).cast("long")).otherwise(F.regexp_extract(text, "^0*([0-9]{1,18})$", 1).try_cast("long"))


def hash_of(c: Column) -> Column:
    text = F.btrim(c, F.lit(" \t\r\n"))
    return F.when(text.startswith("0x") & (F.length(text) >= 4), F.lower(text))


def projected(bodies: Column) -> Column:
    """Entries (``e`` text, ``i`` place) as structs with their ``issues``, in three steps so that each text is parsed once, each field read once."""

    def fields(x: Column) -> Column:
        t = x["t"]
        absent = ~F.coalesce(F.array_contains(x["keys"], "value"), F.lit(False))
        size = F.when(t["input"].startswith("0x"), F.shiftright(F.length(t["input"]) - 2, 1)).otherwise(0)
        return F.struct(
            x["i"].cast("long").alias("place"), hash_of(t["hash"]).alias("tx_hash"), parse_address(t["from"]).alias("sender"), parse_address(t["to"]).alias("recipient"), F.when(absent, F.lit("0" * 78)).otherwise(nested_digits(t["value"])).alias("value_digits"),
            F.coalesce(long_quantity(t["transactionIndex"]), x["i"].cast("long")).alias("tx_index"), long_quantity(t["gas"]).alias("gas_limit"), nested_digits(t["gasPrice"]).alias("gas_price_digits"), long_quantity(t["nonce"]).alias("nonce"),
            size.cast("long").alias("input_size"), x["keys"].isNotNull().alias("is_object"), t["to"].isNotNull().alias("has_to"),
        )

    def judged(x: Column) -> Column:
        wrong = F.array_compact(F.array(
            F.when(x["tx_hash"].isNull(), F.lit("hash: missing or malformed")), F.when(x["sender"].isNull(), F.lit("from: unreadable address")),
            F.when(x["has_to"] & x["recipient"].isNull(), F.lit("to: unreadable address")), F.when(x["value_digits"].isNull(), F.lit("value: unreadable quantity")),
        ))
        names = ("place", "tx_hash", "sender", "recipient", "value_digits", "tx_index", "gas_limit", "gas_price_digits", "nonce", "input_size")
        return F.struct(*[x[n].alias(n) for n in names], F.when(x["is_object"], wrong).otherwise(F.array(F.lit("transaction: expected an object"))).alias("issues"))

    parsed = F.transform(bodies, lambda x: F.struct(x["i"].alias("i"), F.from_json(x["e"], ENTRY).alias("t"), F.json_object_keys(x["e"]).alias("keys")))
    return F.transform(F.transform(parsed, fields), judged)


def judged_blocks(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Each payload with its header, ``issues``, ``accepted``, ``stated`` (entries counted) and ``entries`` (projected transactions); other columns are kept."""
    keep = [c for c in payloads.columns if c != payload]
    b = payloads.select(*keep, F.json_object_keys(payload).isNotNull().alias("is_object"), F.from_json(payload, HEADER).alias("b"))
    h = b.select(
        *keep, "is_object", "b", long_quantity(F.col("b.number")).alias("number"), hash_of(F.col("b.hash")).alias("block_hash"), hash_of(F.col("b.parentHash")).alias("parent_hash"), long_quantity(F.col("b.timestamp")).alias("seconds"),
        nested_digits(F.col("b.gasUsed")).alias("gas_used"), nested_digits(F.col("b.gasLimit")).alias("gas_limit"), parse_address(F.col("b.miner")).alias("miner"),
    )
    missing = [F.when(F.col(f"b.{n}").isNull(), F.lit(f"{n}: required field absent")) for n in REQUIRED]
    read = {"number": ("number", "unreadable quantity"), "timestamp": ("seconds", "unreadable quantity"), "hash": ("block_hash", "not a hex hash"), "parentHash": ("parent_hash", "not a hex hash")}
    unread = [F.when(F.col(f"b.{n}").isNotNull() & F.col(c).isNull(), F.lit(f"{n}: {why}")) for n, (c, why) in read.items()]
    shape = F.array_compact(F.array(*missing, *unread))
    impossible = F.when(F.col("gas_used") > F.col("gas_limit"), F.array(F.lit("gasUsed: exceeds gasLimit"))).otherwise(F.expr("cast(array() as array<string>)"))
    h = h.withColumn("issues", F.when(~F.coalesce("is_object", F.lit(False)), F.array(F.lit("block: expected an object"))).when(F.size(shape) > 0, shape).otherwise(impossible))
    listed = F.coalesce("b.transactions", F.expr("cast(array() as array<string>)"))
    # A text that begins like an object, or a null, is a body; any other text is a hash alone.
    bodies = F.filter(F.transform(listed, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: x["e"].isNull() | F.ltrim(x["e"]).startswith("{"))
    entries = F.when(F.size("issues") == 0, projected(bodies))
    return h.select(*keep, "number", "block_hash", "parent_hash", "seconds", "gas_used", "gas_limit", "miner", "issues", (F.size("issues") == 0).alias("accepted"), F.size(listed).cast("long").alias("stated"), entries.alias("entries"))


def transactions(judged: DataFrame) -> DataFrame:
    """A row per projected entry of accepted blocks: its fields, ``issues`` and ``accepted``.  A block's own issues, limit and verdict stay behind."""
    drop = {"parent_hash", "gas_used", "gas_limit", "miner", "issues", "accepted", "stated", "entries"}
    keep = [c for c in judged.columns if c not in drop]
    # Refused blocks have no entries.  A filter on ``accepted`` would be pushed below the parsing and repeat it.
    each = judged.select(*keep, F.explode_outer("entries").alias("t")).where("t is not null").select(*keep, "t.*")
    return each.withColumn("accepted", F.size("issues") == 0)


def assessed(judged: DataFrame, now: str, logs_missing: Column | None = None, floor: Column | None = None, record: Column | None = None) -> DataFrame:
    """Accepted blocks with ``kept`` transactions, ``findings`` and what they allow.

    ``logs_missing``: the logs were asked for and not had; ``floor``: transfers
    below it were left out on purpose; ``record``: the id of the capture.  A finding is
    incomplete (nothing may be said to be absent) or implausible; a block is bounded if
    each way in which it is incomplete states its own limit.
    """
    none = F.lit(None).cast("string")
    floor, record = none if floor is None else floor, none if record is None else record
    kept = F.size(F.filter("entries", lambda t: F.size(t["issues"]) == 0)).cast("long")
    at, edge = F.timestamp_seconds("seconds"), F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) + DRIFT_SECONDS)
    finding = lambda cond, check, severity: F.when(cond, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity")))
    short = (
        finding(floor.isNotNull(), BOUNDED, "incomplete").when((F.col("stated") > 0) & (F.col("kept") == 0), F.struct(F.lit("transactions_expanded").alias("check"), F.lit("incomplete").alias("severity")))
        .when(F.col("kept") < F.col("stated"), F.struct(F.lit("transactions_complete").alias("check"), F.lit("incomplete").alias("severity")))
    )
    found = F.array_compact(F.array(
        finding(F.lit(False) if logs_missing is None else F.coalesce(logs_missing, F.lit(False)), "logs_captured", "incomplete"), short, finding(at > edge, "timestamp_future", "implausible"),
        finding(at < F.lit(EARLIEST).cast("timestamp"), "timestamp_ancient", "implausible"), finding((F.col("stated") == 0) & (F.col("gas_used") > "0" * 78), "gas_without_transactions", "implausible"),
        finding(F.coalesce(record, F.lit("")) == "", "provenance", "incomplete"),
    ))
    whole = judged.withColumn("kept", kept).withColumn("found", found)
    # As above: an outer explode of the findings of accepted blocks in the place of a filter.
    out = whole.select("*", F.explode_outer(F.when(F.col("accepted"), F.array("found"))).alias("findings")).where("findings is not null").drop("found")
    of = lambda severity: F.filter("findings", lambda f: f["severity"] == severity)
    reasons = F.transform(of("incomplete"), lambda f: f["check"])
    return out.withColumns({
        "complete": F.size(reasons) == 0, "plausible": F.size(of("implausible")) == 0, "incomplete_reason": F.array_join(reasons, ","),
        "bounded": (F.size(reasons) > 0) & F.forall(reasons, lambda c: c == BOUNDED), "findings": F.array_join(F.transform("findings", lambda f: f["check"]), ","),
    })


#: Recorded payloads over transfers: the block's number says what is wrong with it (w), ids what is wrong with a transfer (k).
KIND = "(okey * 7 + pkey) % 16"
TX = f"""SELECT chain, block_number, tx_key, named_struct('hash', CASE WHEN {KIND} <> 1 THEN upper_hash END, 'from', CASE WHEN {KIND} IN (2, 11) THEN '0x12' ELSE concat(' 0xF', lpad(substring(from_address, 2), 39, '0')) END,
 'to', CASE WHEN {KIND} = 3 THEN 'bad!' ELSE concat('0x', lpad(substring(to_address, 2), 40, '0')) END, 'value', CASE WHEN {KIND} IN (4, 11) THEN '0xzz' WHEN {KIND} = 10 THEN concat('0x', repeat('f', 64)) WHEN {KIND} = 12 THEN CAST(value AS STRING) WHEN {KIND} <> 5 THEN concat('0x0', lower(hex(CAST(value AS BIGINT)))) END,
 'transactionIndex', CASE WHEN {KIND} <> 13 THEN concat('0x', hex(tx_index)) END, 'gas', concat('0x', hex(21000 + tx_index)), 'gasPrice', CASE WHEN {KIND} = 6 THEN 'dear' ELSE concat('0x', hex(okey)) END, 'nonce', CASE WHEN {KIND} = 7 THEN 'x' ELSE CAST(okey AS STRING) END,
 'input', CASE {KIND} WHEN 8 THEN '0xa9059cbb00f' WHEN 9 THEN 'data' ELSE '0x' END) AS t FROM (SELECT *, concat('0x', upper(substring(tx_key, 3))) AS upper_hash FROM {{txn}})"""
HEAD = """SELECT *, block_number % 40 AS w, CASE WHEN block_number % 40 IN (7, 8) THEN '[]' WHEN block_number % 40 = 6 THEN to_json(transform(txs, x -> x.tx_key)) ELSE to_json(transform(txs, x -> x.t)) END AS body,
 to_json(named_struct('number', CASE block_number % 40 WHEN 1 THEN NULL WHEN 14 THEN 'true' WHEN 18 THEN CAST(block_number AS STRING) ELSE concat('0x', hex(block_number)) END, 'hash', CASE block_number % 40 WHEN 2 THEN 'nothex' WHEN 15 THEN NULL ELSE hash END,
 'parentHash', CASE block_number % 40 WHEN 4 THEN NULL WHEN 20 THEN '0x' ELSE parent END, 'timestamp', CASE WHEN block_number % 40 IN (3, 15) THEN 'soon' ELSE concat('0x', hex(CASE WHEN block_number % 40 = 11 THEN block_number ELSE 1420070400 + block_number * 86400 END)) END,
 'gasUsed', concat('0x', hex(CASE block_number % 40 WHEN 5 THEN size(txs) * 30000 + 30001 WHEN 7 THEN 5 WHEN 8 THEN 0 ELSE size(txs) * 21000 END)), 'gasLimit', concat('0x', hex(size(txs) * 30000 + 30000)), 'miner', CASE WHEN block_number % 40 = 9 THEN '0xnobody' ELSE '0x00000000000000000000000000000000000000AA' END)) AS head FROM {g}"""


def recorded(v) -> DataFrame:
    """``chain, day, w, payload``: a recorded block per chain and day, of its native transfers."""
    each = v.spark.sql(TX, txn=v.txn).groupBy("chain", "block_number").agg(F.sort_array(F.collect_list(F.struct("tx_key", "t"))).alias("txs"))
    g = each.withColumns({"hash": block_hash(F.col("block_number")), "parent": block_hash(F.col("block_number") - 1)})
    made = v.spark.sql(HEAD, g=g)
    whole = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.when(F.col("w") == 19, "}").otherwise(F.concat(F.lit(',"transactions":'), "body", F.lit("}"))))
    return made.select("chain", F.col("block_number").alias("day"), "w", F.when(F.col("w") == 16, "[]").otherwise(whole).alias("payload"))


def quality(v, now: str = "2021-01-01") -> DataFrame:
    w = F.col("w")
    return assessed(judged_blocks(recorded(v)), now, w.isin(12, 17), F.when(w.isin(0, 13), F.lit("100000")), F.when(~w.isin(10, 17), F.concat_ws(":", "chain", F.col("day").cast("string"))))


BODY = f"""bt AS (SELECT *, block_number % 40 AS w, {KIND} AS k, row_number() OVER (PARTITION BY chain, block_number ORDER BY tx_key) - 1 AS place FROM txn),
pt AS (SELECT *, concat_ws('; ', CASE WHEN k = 1 THEN 'hash: missing or malformed' END, CASE WHEN k IN (2, 11) THEN 'from: unreadable address' END, CASE WHEN k = 3 THEN 'to: unreadable address' END, CASE WHEN k IN (4, 11) THEN 'value: unreadable quantity' END) AS issues FROM bt
WHERE w NOT IN (1, 2, 3, 4, 5, 14, 15, 16, 20, 6, 7, 8, 19))"""
JB = """jb AS (SELECT *, CASE WHEN w IN (7, 8, 16, 19) THEN 0 ELSE n END AS stated,
CASE w WHEN 16 THEN 'block: expected an object' WHEN 1 THEN 'number: required field absent' WHEN 2 THEN 'hash: not a hex hash' WHEN 3 THEN 'timestamp: unreadable quantity' WHEN 4 THEN 'parentHash: required field absent' WHEN 14 THEN 'number: unreadable quantity' WHEN 15 THEN 'hash: required field absent; timestamp: unreadable quantity' WHEN 20 THEN 'parentHash: not a hex hash' WHEN 5 THEN 'gasUsed: exceeds gasLimit' ELSE '' END AS issues FROM (SELECT chain, block_number AS day, block_number % 40 AS w, count(*) AS n FROM txn GROUP BY ALL))"""
FIELDS = "CASE WHEN k <> 1 THEN tx_key END AS tx_hash, CASE WHEN k NOT IN (2, 11) THEN concat('0xf', lpad(substring(from_address, 2), 39, '0')) END AS sender, CASE WHEN k <> 3 THEN '0x' || lpad(substring(to_address, 2), 40, '0') END AS recipient, CASE k WHEN 4 THEN NULL WHEN 11 THEN NULL WHEN 10 THEN '115792089237316195423570985008687907853269984665640564039457584007913129639935' WHEN 5 THEN repeat('0', 78) ELSE lpad(value::VARCHAR, 78, '0') END AS value_digits, CASE WHEN k = 13 THEN place ELSE tx_index::BIGINT END AS tx_index"
MORE = "21000::BIGINT + tx_index AS gas_limit, CASE WHEN k <> 6 THEN lpad(okey::VARCHAR, 78, '0') END AS gas_price_digits, CASE WHEN k <> 7 THEN okey END AS nonce, CASE k WHEN 8 THEN 5 ELSE 0 END::BIGINT AS input_size"
register("raw_blocks", lambda v: transactions(judged_blocks(recorded(v))).where("accepted").select("chain", "number", "block_hash", "seconds", "tx_hash", "sender", "recipient", "value_digits", "tx_index"), f"WITH {BODY} SELECT chain, block_number::BIGINT AS number, concat('0x', md5(block_number::VARCHAR), md5('h' || block_number)) AS block_hash, CASE WHEN w = 11 THEN block_number ELSE 1420070400 + block_number * 86400 END::BIGINT AS seconds, {FIELDS} FROM pt WHERE issues = ''")
register("tx_project", lambda v: transactions(judged_blocks(recorded(v))).select("chain", F.col("day").cast("long").alias("day"), "place", "tx_hash", "sender", "recipient", "value_digits", "tx_index", "gas_limit", "gas_price_digits", "nonce", "input_size", F.array_join("issues", "; ").alias("issues"), "accepted"), f"WITH {BODY} SELECT chain, block_number::BIGINT AS day, place, {FIELDS}, {MORE}, issues, issues = '' AS accepted FROM pt")
register("block_rules", lambda v: judged_blocks(recorded(v)).select("chain", F.col("day").cast("long").alias("day"), "number", "stated", F.col("gas_used").cast("decimal(38,0)").cast("long").alias("gas_used"), "miner", F.array_join("issues", "; ").alias("issues"), "accepted"), f"""WITH {JB} SELECT chain, day::BIGINT AS day, CASE WHEN w NOT IN (1, 14, 16) THEN day END::BIGINT AS number, stated, CASE w WHEN 16 THEN NULL WHEN 5 THEN n * 30000 + 30001 WHEN 7 THEN 5 WHEN 8 THEN 0 ELSE n * 21000 END::BIGINT AS gas_used, CASE WHEN w NOT IN (9, 16) THEN '0x00000000000000000000000000000000000000aa' END AS miner, issues, issues = '' AS accepted FROM jb""")
register("quality", lambda v: quality(v).select("chain", F.col("day").cast("long").alias("day"), "stated", "kept", "findings", "complete", "plausible", "bounded", "incomplete_reason"), f"""WITH {BODY}, {JB}, c AS (SELECT chain, block_number AS day, count(*) FILTER (WHERE issues = '') AS kept FROM pt GROUP BY ALL),
f AS (SELECT jb.*, coalesce(kept, 0) AS kept, CASE WHEN w IN (12, 17) THEN 'logs_captured' END AS lg, CASE WHEN w IN (0, 13) THEN 'selective_capture' WHEN stated > 0 AND coalesce(kept, 0) = 0 THEN 'transactions_expanded' WHEN coalesce(kept, 0) < stated THEN 'transactions_complete' END AS sh, CASE WHEN w IN (10, 17) THEN 'provenance' END AS pr,
CASE WHEN w <> 11 AND to_timestamp(1420070400 + day * 86400) > TIMESTAMPTZ '2021-01-01 00:15:00+00' THEN 'timestamp_future' END AS fu, CASE WHEN w = 11 THEN 'timestamp_ancient' END AS an, CASE WHEN stated = 0 AND w <> 8 THEN 'gas_without_transactions' END AS ga FROM jb LEFT JOIN c USING (chain, day) WHERE issues = '')
SELECT chain, day::BIGINT AS day, stated, kept, concat_ws(',', lg, sh, fu, an, ga, pr) AS findings, concat_ws(',', lg, sh, pr) = '' AS complete, concat_ws('', fu, an, ga) = '' AS plausible, coalesce(concat_ws(',', lg, sh, pr) = 'selective_capture', false) AS bounded, concat_ws(',', lg, sh, pr) AS incomplete_reason FROM f""")

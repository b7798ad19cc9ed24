"""Recorded node payloads: blocks with nested transactions, event logs, their linkage and decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register

# The signature hashes of the standard token events.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
APPROVAL = "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925"
APPROVAL_FOR_ALL = "0x17307eab39ab6107e8899845ad3d59bd9653f200f220920489ca2b5937696c31"
ZERO = "0x" + "0" * 40

LOGS = "result array<struct<address string, topics array<string>, data string, blockNumber string, blockHash string, logIndex string>>"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: 2^(28 i) in limbs of nine decimal digits, for the ten chunks of 28 bits that 256 bits have.
CHUNKS, LIMBS, LIMB = 10, 9, 10**9
WEIGHTS = [[(1 << 28 * i) // LIMB**j % LIMB for i in range(CHUNKS)] for j in range(LIMBS)]


def uint_digits(digits: Column) -> Column:
    """Up to 64 hex digits (no 0x) as a decimal number of 78 digits with leading zeros; null for anything else.

    256 bits are more than any number type holds: nine limbs of nine decimal
    digits, each a sum of chunks of 28 bits by fixed weights, which fits 63 bits; carries last.
    """

    def chunks(padded: Column) -> Column:
        wide = [F.conv(F.substring(padded, 57 - 14 * i, 14), 16, 10).cast("long") for i in range(CHUNKS // 2)]
        return F.array(*wide)

    def sums(w: Column) -> Column:
        of = lambda i: F.shiftright(F.get(w, F.lit(i // 2)), 28) if i % 2 else F.get(w, F.lit(i // 2)).bitwiseAND(F.lit((1 << 28) - 1))
        chunk = F.array(*[of(i) for i in range(CHUNKS)])
        return bound(chunk, lambda c: F.array(*[sum((F.get(c, F.lit(i)) * F.lit(x).cast("long") for i, x in enumerate(row) if x), F.lit(0).cast("long")) for row in WEIGHTS]))

    def text(limbs: Column) -> Column:
        whole, out = F.lit(0).cast("long"), []
        for j in range(LIMBS):
            whole = F.get(limbs, F.lit(j)) + (F.call_function("div", whole, F.lit(LIMB).cast("long")) if j else F.lit(0).cast("long"))
            out.append(F.lpad((whole % F.lit(LIMB).cast("long")).cast("string"), 9, "0"))
        return F.substring(F.concat(*reversed(out)), 4, 78)

    low = F.lower(digits)
    return F.when(low.rlike("^[0-9a-f]{1,64}$"), bound(bound(bound(F.lpad(low, 70, "0"), chunks), sums), text))


def word_digits(word: Column) -> Column:
    """A 0x quantity or data word as 78 digits."""
    return F.when(word.startswith("0x"), uint_digits(F.substring(word, 3, 64)))


def topic_address(topic: Column) -> Column:
    """The address in the last 40 digits of a topic; null if it is no full word."""
    return F.when(F.lower(topic).rlike("^0x[0-9a-f]{64}$"), F.concat(F.lit("0x"), F.substring(F.lower(topic), 27, 40)))


def small_quantity(c: Column) -> Column:
    """A height or index as long; null beyond 15 hex digits."""
    return F.when(F.lower(c).rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(c, 3, 15), 16, 10).cast("long"))


def raw_logs(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """A row per log of each recorded batch, with its place in the batch; other columns are kept."""
    keep = [c for c in payloads.columns if c != payload]
    each = payloads.select(*keep, F.posexplode(F.from_json(payload, LOGS)["result"]).alias("place", "log"))
    size = F.greatest(F.length(F.coalesce("data", F.lit("0x"))) - 2, F.lit(0))
    return each.select(*keep, "place", "log.*").select(
        *keep, "place", F.lower("address").alias("contract"), "topics", F.coalesce("data", F.lit("0x")).alias("data"), F.call_function("div", size, F.lit(2)).alias("data_bytes"),
        small_quantity(F.col("blockNumber")).alias("block_number"), F.lower("blockHash").alias("block_hash"), small_quantity(F.col("logIndex")).alias("log_index"),
    )


def decode_transfers(logs: DataFrame) -> DataFrame:
    """Logs as token transfers.  Signature and layout come first: a log of neither standard shape is refused with a reason."""
    topic, n, size = F.lower(F.get("topics", F.lit(0))), F.coalesce(F.size("topics"), F.lit(0)), F.col("data_bytes")
    kind = F.when((topic == TRANSFER) & (n == 3) & (size == 32), "erc20_transfer").when((topic == TRANSFER) & (n == 4) & (size == 0), "erc721_transfer")
    sender, recipient = topic_address(F.get("topics", F.lit(1))), topic_address(F.get("topics", F.lit(2)))
    refusal = (
        F.when(n == 0, "no topics").when(topic.isin(APPROVAL, APPROVAL_FOR_ALL), "approval").when(topic != TRANSFER, "unknown signature").when(F.col("kind").isNull(), "unknown layout")
        .when(F.col("sender").isNull() | F.col("recipient").isNull(), "address unreadable").when(F.coalesce("amount", "token_id").isNull(), "quantity unreadable")
    )
    amount, token = F.when(kind == "erc20_transfer", word_digits(F.col("data"))), F.when(kind == "erc721_transfer", word_digits(F.get("topics", F.lit(3))))
    step = logs.withColumns({"kind": kind, "sender": sender, "recipient": recipient, "amount": amount, "token_id": token})
    step = step.withColumn("refusal", refusal)
    good = F.col("refusal").isNull()
    return step.select(*logs.columns, *[F.when(good, F.col(c)).alias(c) for c in ("kind", "sender", "recipient", "amount", "token_id")], (good & (F.col("sender") == ZERO)).alias("is_mint"), (good & (F.col("recipient") == ZERO)).alias("is_burn"), "refusal")


def decode_approvals(logs: DataFrame) -> DataFrame:
    """Logs as approvals of three kinds, with the key of the grant and whether it is a revocation."""
    topic, n, size = F.lower(F.get("topics", F.lit(0))), F.coalesce(F.size("topics"), F.lit(0)), F.col("data_bytes")
    kind = F.when(topic == APPROVAL_FOR_ALL, "erc721_approval_for_all").when((topic == APPROVAL) & (n == 4), "erc721_approval").when(topic == APPROVAL, "erc20_approval")
    fits = F.when(kind == "erc721_approval", (n == 4) & (size == 0)).otherwise((n == 3) & (size == 32))
    word = word_digits(F.col("data"))
    step = logs.select(
        "*", kind.alias("kind"), fits.alias("fits"), topic_address(F.get("topics", F.lit(1))).alias("owner"), topic_address(F.get("topics", F.lit(2))).alias("spender"),
        F.when(kind == "erc20_approval", word).alias("allowance"), F.when(kind == "erc721_approval", word_digits(F.get("topics", F.lit(3)))).alias("token_id"), F.when(kind == "erc721_approval_for_all", word != "0" * 78).alias("approved"),
    )
    readable = F.col("owner").isNotNull() & F.col("spender").isNotNull() & F.coalesce(F.col("allowance"), F.col("token_id"), F.col("approved").cast("string")).isNotNull()
    refusal = F.when(F.col("kind").isNull(), "not an approval").when(~F.col("fits"), "unknown layout").when(~readable, "field unreadable")
    good = refusal.isNull()
    revokes = F.when(F.col("kind") == "erc20_approval", F.col("allowance") == "0" * 78).when(F.col("kind") == "erc721_approval", F.col("spender") == ZERO).otherwise(~F.col("approved"))
    grant = F.concat_ws("|", "kind", "contract", "owner", F.when(F.col("kind") == "erc721_approval", F.col("token_id")).otherwise(F.col("spender")))
    return step.select(*logs.columns, *[F.when(good, F.col(c)).alias(c) for c in ("kind", "owner", "spender", "allowance", "token_id", "approved")], F.when(good, grant).alias("grant_key"), (good & revokes).alias("is_revocation"), refusal.alias("refusal"))


def linkage(logs: DataFrame, expected: DataFrame) -> DataFrame:
    """Logs filed to their block: ``verdict`` filed, no_hash (the log names no block) or mismatch (another block than expected).

    ``expected``: ``block, expected_hash``.
    """
    both = logs.join(expected, "block")
    verdict = F.when(F.col("block_hash").isNull(), "no_hash").when(F.col("block_hash") != F.lower("expected_hash"), "mismatch").otherwise("filed")
    return both.withColumn("verdict", verdict).drop("expected_hash")


# Recorded payloads over the events table: what a node would have returned for these events.
def word(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n.cast("long"))), 64, "0"))


def block_hash(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.md5(n.cast("string")), F.md5(F.concat(F.lit("h"), n.cast("string"))))


def recorded_logs(v) -> DataFrame:
    """``block, payload``: a batch of logs per block of an hour."""
    e = v.events.selectExpr("*", "datediff(hour, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS block", "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k", "(event_id * 7) % 150 AS other", "CAST(round(value * 100) AS BIGINT) AS amount")
    kind, max_word = F.col("event_type"), "0x" + "f" * 64
    topics = (
        F.when(kind == "click", F.array(F.lit(TRANSFER), word(F.col("user_id")), word(F.col("other")))).when(kind == "view", F.array(F.lit(TRANSFER), word(F.col("user_id")), word(F.col("other")), word(F.col("k"))))
        .when(kind == "purchase", F.array(F.lit(APPROVAL), word(F.col("user_id")), word(F.col("other")))).when(kind == "signup", F.array(F.lit(APPROVAL_FOR_ALL), word(F.col("user_id")), word(F.col("other")))).otherwise(F.array(F.lit(TRANSFER), word(F.col("user_id"))))
    )
    data = F.when(kind.isin("click", "purchase"), F.when(F.col("event_id") % 10 == 3, F.lit(max_word)).otherwise(word(F.when(F.col("event_id") % 10 == 4, 0).otherwise(F.col("amount"))))).when(kind == "signup", word(F.col("event_id") % 3)).otherwise("0x")
    own = F.when(F.col("event_id") % 50 == 7, F.lit(None).cast("string")).when(F.col("event_id") % 50 == 9, block_hash(F.col("block") + 1)).otherwise(block_hash(F.col("block")))
    hexed = lambda n: F.concat(F.lit("0x"), F.lower(F.hex(n.cast("long"))))
    log = F.struct(F.concat(F.lit("0x"), F.lpad(F.hex(F.col("k") % 20), 40, "0")).alias("address"), topics.alias("topics"), data.alias("data"), hexed(F.col("block")).alias("blockNumber"), own.alias("blockHash"), hexed(F.col("event_id")).alias("logIndex"))
    return e.groupBy("block").agg(F.to_json(F.struct(F.collect_list(log).alias("result"))).alias("payload"))


LOG_SQL = """l AS (
  SELECT event_id AS log_index, datediff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS block, event_type, event_id,
         concat('0x', lpad(lower(to_hex(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20)), 40, '0')) AS contract, concat('0x', lpad(lower(to_hex(user_id)), 40, '0')) AS a, concat('0x', lpad(lower(to_hex((event_id * 7) % 150)), 40, '0')) AS b,
         lpad(CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR), 78, '0') AS token,
         CASE event_id % 10 WHEN 3 THEN '115792089237316195423570985008687907853269984665640564039457584007913129639935' WHEN 4 THEN lpad('0', 78, '0') ELSE lpad(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 78, '0') END AS amount
  FROM events
)"""
register("raw_logs", lambda v: raw_logs(recorded_logs(v)).select("block", "block_number", "contract", F.size("topics").cast("long").alias("topics"), F.col("data_bytes").cast("long").alias("data_bytes"), "log_index"), f"WITH {LOG_SQL} SELECT block, block AS block_number, contract, CASE event_type WHEN 'view' THEN 4 WHEN 'error' THEN 2 ELSE 3 END::BIGINT AS topics, CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE 32 END::BIGINT AS data_bytes, log_index FROM l")
register("decode_transfer", lambda v: decode_transfers(raw_logs(recorded_logs(v))).select("log_index", "contract", "kind", "sender", "recipient", "amount", "token_id", "is_mint", "is_burn", "refusal"), f"""WITH {LOG_SQL}, k AS (SELECT *, CASE event_type WHEN 'click' THEN 'erc20_transfer' WHEN 'view' THEN 'erc721_transfer' END AS kind FROM l)
SELECT log_index, contract, kind, CASE WHEN kind IS NOT NULL THEN a END AS sender, CASE WHEN kind IS NOT NULL THEN b END AS recipient, CASE kind WHEN 'erc20_transfer' THEN amount END AS amount, CASE kind WHEN 'erc721_transfer' THEN token END AS token_id,
       coalesce(kind IS NOT NULL AND a = '{ZERO}', false) AS is_mint, coalesce(kind IS NOT NULL AND b = '{ZERO}', false) AS is_burn, CASE WHEN event_type IN ('purchase', 'signup') THEN 'approval' WHEN event_type = 'error' THEN 'unknown layout' END AS refusal FROM k""")
register("decode_approval", lambda v: decode_approvals(raw_logs(recorded_logs(v))).select("log_index", "kind", "owner", "spender", "allowance", "approved", "grant_key", "is_revocation", "refusal"), f"""WITH {LOG_SQL}, k AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'erc20_approval' WHEN 'signup' THEN 'erc721_approval_for_all' END AS kind FROM l)
SELECT log_index, kind, CASE WHEN kind IS NOT NULL THEN a END AS owner, CASE WHEN kind IS NOT NULL THEN b END AS spender, CASE kind WHEN 'erc20_approval' THEN amount END AS allowance, CASE kind WHEN 'erc721_approval_for_all' THEN event_id % 3 <> 0 END AS approved,
       CASE WHEN kind IS NOT NULL THEN concat(kind, '|', contract, '|', a, '|', b) END AS grant_key, coalesce(CASE kind WHEN 'erc20_approval' THEN amount = lpad('0', 78, '0') ELSE kind IS NOT NULL AND event_id % 3 = 0 END, false) AS is_revocation, CASE WHEN kind IS NULL THEN 'not an approval' END AS refusal FROM k""")
register("log_linkage", lambda v: linkage(decode_transfers(raw_logs(recorded_logs(v))), recorded_logs(v).select("block", block_hash(F.col("block")).alias("expected_hash"))).groupBy("block").agg(*[F.sum((F.col("verdict") == k).cast("long")).alias(k) for k in ("filed", "no_hash", "mismatch")], F.sum(((F.col("verdict") == "filed") & F.col("refusal").isNotNull()).cast("long")).alias("unsupported")), f"WITH {LOG_SQL}, k AS (SELECT *, event_id % 50 = 7 AS no_hash, event_id % 50 = 9 AS mismatch FROM l) SELECT block, count(*) FILTER (WHERE NOT no_hash AND NOT mismatch) AS filed, count(*) FILTER (WHERE no_hash) AS no_hash, count(*) FILTER (WHERE mismatch) AS mismatch, count(*) FILTER (WHERE NOT no_hash AND NOT mismatch AND event_type NOT IN ('click', 'view')) AS unsupported FROM k GROUP BY block")

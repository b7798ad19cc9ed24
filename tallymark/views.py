"""Domain views over the base tables: transfers, blocks, labels, approvals, candles, news.

``VIEW_SQL`` is DuckDB's spelling; ``Views`` builds the same rows on Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEW_SQL = {
    "txn": """SELECT t.*, concat('0x', md5(concat(t.chain, '|', t.okey, '|', t.from_address, '|', t.skey, '|', t.tx_index, '|', t.pkey, '|', t.value, '|', t.dup))) AS tx_key
FROM (
  SELECT r_name AS chain, l_orderkey AS okey, l_suppkey AS skey, l_partkey AS pkey, concat('c', o_custkey) AS from_address,
         CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN NULL ELSE concat('s', l_suppkey) END AS to_address,
         CAST(round(l_extendedprice * 100) AS DECIMAL(38,0)) AS value,
         datediff('day', TIMESTAMP '1995-01-01 00:00:00', l_shipdate) AS block_number, l_linenumber AS tx_index,
         l_shipdate + INTERVAL 1 HOUR * CAST(l_orderkey % 24 AS INT) AS happened_at,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey, l_partkey ORDER BY l_extendedprice, l_shipdate, l_discount, l_tax) AS dup
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t""",
    "blk": """SELECT chain, block_number AS number, concat(chain, ':', block_number) AS block_key, min(date_trunc('day', happened_at)) AS block_time, count(*) AS tx_count,
       block_number % 50 <> 49 AS canonical, block_number % 10 <> 0 AS complete,
       CASE WHEN block_number % 20 = 0 THEN 'selective_capture' WHEN block_number % 10 = 0 THEN 'logs_captured' ELSE '' END AS incomplete_reason,
       CASE WHEN block_number % 20 = 0 THEN CAST(100000 AS DECIMAL(38,0)) END AS capture_floor
FROM txn GROUP BY chain, block_number""",
    "lbl": """SELECT 'evm' AS chain, concat('s', s_suppkey) AS address, n_name AS entity,
       CASE s_suppkey % 4 WHEN 0 THEN 'exchange' WHEN 1 THEN 'bridge' WHEN 2 THEN 'mining_pool' ELSE 'contract' END AS category,
       concat('src', s_suppkey % 3) AS source, CASE s_suppkey % 3 WHEN 0 THEN 0.5e0 WHEN 1 THEN 0.75e0 ELSE 0.95e0 END AS confidence,
       CASE s_suppkey % 3 WHEN 0 THEN 'unverified' WHEN 1 THEN 'corroborated' ELSE 'verified' END AS status
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT 'evm', concat('s', s_suppkey), n_name, 'exchange', 'src9', 0.5e0, 'unverified' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 = 0""",
    "ttx": """SELECT 'sim' AS chain, event_id AS log_index, ts AS happened_at, datediff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS block_number,
       concat('t', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20) AS token, concat('u', user_id) AS from_address, concat('u', (event_id * 7) % 150) AS to_address,
       CAST(round(value * 100) AS DECIMAL(38,0)) AS value, event_type = 'signup' AS is_mint, event_type = 'error' AS is_burn
FROM events""",
    "appr": """SELECT 'sim' AS chain, event_id AS log_index, datediff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS block_number, ts AS block_timestamp,
       CASE event_type WHEN 'view' THEN 'erc721_approval' WHEN 'purchase' THEN 'erc721_approval_for_all' ELSE 'erc20_approval' END AS kind,
       concat('t', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5) AS token, concat('u', user_id) AS owner, concat('p', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10) AS spender,
       CASE WHEN event_type IN ('click','signup') THEN CAST(round(value * 100) AS DECIMAL(38,0)) WHEN event_type = 'error' THEN CAST(0 AS DECIMAL(38,0)) END AS allowance,
       CASE WHEN event_type = 'view' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 7 END AS token_id,
       CASE WHEN event_type = 'purchase' THEN event_id % 3 <> 0 END AS approved,
       event_type = 'error' OR (event_type = 'purchase' AND event_id % 3 = 0) AS is_revocation
FROM events""",
    "candle": """SELECT event_type AS symbol, date_trunc('hour', ts) AS open_time, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type, date_trunc('hour', ts)""",
    "flow": """SELECT 'sim' AS chain, token AS address, block_number AS height,
       sum(CASE WHEN NOT is_mint AND NOT is_burn THEN value ELSE 0 END) AS outflow, sum(CASE WHEN is_mint THEN value ELSE 0 END) AS inflow, block_number % 10 <> 0 AS complete
FROM ttx GROUP BY token, block_number""",
    "news": """SELECT doc_id, source, lang, substring(text, 1, 80) AS title, text AS content, concat('a', doc_id % 7) AS author,
       CASE doc_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'reddit' ELSE 'x' END AS platform, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(doc_id AS INT) AS published_at
FROM documents""",
    "impact": """SELECT event_id, event_type AS asset, ts AS first_seen, round(value, 2) - 50 AS measured_return, CASE event_id % 4 WHEN 0 THEN 'general' WHEN 1 THEN 'hack' WHEN 2 THEN 'listing' ELSE 'regulation' END AS category,
       CASE event_id % 5 WHEN 0 THEN 'confirmed_true' WHEN 1 THEN 'likely_true' WHEN 2 THEN 'unverified' WHEN 3 THEN 'likely_false' ELSE 'confirmed_false' END AS status, event_id % 101 AS fomo_score
FROM events""",
    "evalcase": """SELECT doc_id AS case_id, source AS detector, l.toxic = 1 AS predicted, l.quality = 1 AS label, CAST(doc_id % 101 AS DOUBLE) / 100 AS confidence
FROM labels l JOIN documents USING (doc_id)""",
}

#: The same join for Spark: what an order's customer says comes first, as narrow rows, so lines are shuffled once, by order, and copies are numbered where they meet.
ORDER_FIRST = (
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey\n  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "FROM lineitem JOIN (SELECT o_orderkey, o_custkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) ON l_orderkey = o_orderkey",
)
SPARK_SPELLING = [
    (r"datediff\('(\w+)', ", r"datediff(\1, "),
    (r"INTERVAL 1 HOUR \* CAST\(([^()]*) AS INT\)", r"make_interval(0, 0, 0, 0, CAST(\1 AS INT))"),
    (r"INTERVAL 1 MINUTE \* CAST\(([^()]*) AS INT\)", r"make_interval(0, 0, 0, 0, 0, CAST(\1 AS INT))"),
]


class Views:
    """Tables and views of one data directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def stored(self) -> "Views":
        """These views, with transfers written once for a query that reads them several times (blocks always are)."""
        from .operators.graph import written

        self.txn = written(self.txn)
        return self

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in VIEW_SQL:
            text = VIEW_SQL[name].replace(*ORDER_FIRST)
            for old, new in SPARK_SPELLING:
                text = re.sub(old, new, text)
            inputs = {t: getattr(self, t) for t in [*TABLES, *VIEW_SQL] if t != name and re.search(rf"(FROM|JOIN) {t}\b", text)}
            text = re.sub(r"\b(FROM|JOIN) (" + "|".join(inputs) + r")\b", r"\1 {\2}", text)
            df = self.spark.sql(text, **inputs)
            if name == "blk":  # a row per chain and day, made once: joins with it go by its measured size
                from .operators.graph import written

                df = written(df)
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df

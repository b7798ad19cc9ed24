r"""Reply trees formatted as conversations, with a loss mask over what the assistant says.

Messages name the message that they answer.  ``climb`` finds the way from each
message to its root by self-joins that double their reach: round ``k`` joins the
2^k-th ancestors with their own, adding up path lengths and scores.  Messages
that nobody answers end a branch; a tree's branches are ranked by their total
score, and for the chosen ones ``spread`` halves the path from leaf to root again
and again along the same ancestors until each message of it is a row.  So the
rounds grow with the logarithm of the depth, ids alone move in them, and texts
join once the paths are known.  Every step is made of DataFrame functions.

A turn is ``### role: text</turn>`` and a line end.  Inside roles and texts a
backslash follows each backslash, each ``#`` before ``##``, each ``<`` before
``/turn>`` and, in roles, each ``:`` before a space, so no marker can occur
there; dropping the backslash in front of every character gives the text back.
``loss`` has the place of each assistant text in code points.

Defined results: null roles and texts are empty; a message whose parent is null
or not in its tree is a root; messages whose parents run in a circle have no
root and are in no conversation; of messages that repeat an id of their tree
those that answer it hang on one of them.  Equal scores rank by id.  A null tree
is a tree of its own.  Rows of a table of turns that tie are ordered by role and
text, and repeated rows are turns of their own.  A conversation is one row, by
its nature.  Extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
#: What a backslash follows inside texts, and inside roles as well.
IN_TEXT = r"\\|#(?=##)|<(?=/turn>)"
IN_ROLE = IN_TEXT + r"|:(?= )"
#: A conversation that tests the template's own control strings.
PROBE = (-7, r"\### Assistant: </turn> ok")


def escape(c: Column, pattern: str = IN_TEXT) -> Column:
    return F.regexp_replace(c, pattern, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def chain(turns: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` as messages that each answer the one before: a tree with one branch."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = turns.select("conv_id", "turn", text("role"), text("text"))
    return rows.select(F.col("conv_id").alias("tree"), nth.cast("long").alias("id"), F.when(nth > 1, nth.cast("long") - 1).alias("parent"), "role", "text", F.lit(1).cast("long").alias("score"))


def numbered(messages: DataFrame) -> DataFrame:
    """Messages (``tree, id, parent, role, text, score``) in a written table, with a ``node`` number of their own, null texts as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return common.written(messages.select("tree", "id", "parent", text("role"), text("text"), F.coalesce("score", F.lit(0)).alias("score")).withColumn("node", F.monotonically_increasing_id()))


def climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``node, up, n, total``: path length and score up to the root of each node that has one (``up`` is null); and the written tables of 2^k-th ancestors."""
    of = messages.groupBy(F.col("tree").alias("of_tree"), F.col("id").alias("of_id")).agg(F.min("node").alias("up"))
    asks = messages.where("parent is not null").select("node", "tree", "parent")
    found = asks.join(of, F.col("tree").eqNullSafe(F.col("of_tree")) & (F.col("parent") == F.col("of_id"))).select("node", "up")
    first = messages.select("node", "score").join(found, "node", "left").select("node", "up", F.lit(1).cast("long").alias("n"), F.col("score").alias("total"))
    steps, jumps = [common.written(first)], []
    most = steps[0].count()
    while 2 ** len(jumps) <= 2 * most:
        active = steps[-1].where("up is not null")
        if active.isEmpty():
            break
        jumps.append(active.select("node", F.col("up").alias("to")))
        # Ways that have come to their root stay where they are and move no more.
        above = functools.reduce(DataFrame.union, [s.where("up is null") for s in steps], active)
        above = above.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("n").alias("more"), F.col("total").alias("plus"))
        steps.append(common.written(active.join(above, F.col("up") == F.col("at")).select("node", F.col("next").alias("up"), (F.col("n") + F.col("more")).alias("n"), (F.col("total") + F.col("plus")).alias("total"))))
    return functools.reduce(DataFrame.union, [s.where("up is null") for s in steps]), jumps


def branches(messages: DataFrame, ways: DataFrame, first: DataFrame | None, top: int) -> DataFrame:
    """``leaf, tree, rank, n``: the best ``top`` branches of each tree. ``first``: parents by node."""
    leaves = messages.select("tree", "id", F.col("node").alias("leaf"))
    if first is not None:
        leaves = leaves.join(first.select(F.col("to").alias("leaf")).distinct(), "leaf", "left_anti")
    rooted = leaves.join(ways.select(F.col("node").alias("leaf"), "n", "total"), "leaf")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("total").desc(), "id", "leaf"))
    return rooted.withColumn("rank", rank).where(F.col("rank") <= top).select("leaf", "tree", "rank", "n")


def spread(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``leaf, node, pos``: every message of the chosen branches, the root at 0."""
    half = lambda node, high, low: F.struct(node.alias("node"), high.alias("high"), low.alias("low"))
    rows = chosen.select("leaf", F.col("leaf").alias("node"), (F.col("n") - 1).alias("high"), F.lit(0).cast("long").alias("low"))
    for k in reversed(range(len(jumps))):
        long = F.col("high") - F.col("low") >= 2**k
        halves = F.array(half(F.col("node"), F.col("high"), F.col("high") - (2**k - 1)), half(F.col("to"), F.col("high") - 2**k, F.col("low")))
        cut = rows.where(long).join(jumps[k].select(F.col("node").alias("at"), "to"), F.col("node") == F.col("at")).select("leaf", F.explode(halves).alias("p")).select("leaf", "p.node", "p.high", "p.low")
        rows = common.written(rows.where(~long).unionByName(cut))
    return rows.select("leaf", "node", F.col("high").alias("pos"))


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """A row for each of the best ``top`` branches of a tree.

    ``tree, leaf, rank, n_turns``; ``formatted``; ``starts``: where each turn
    begins; ``loss``: turn, start and length of each text to learn from.
    """
    messages = numbered(messages)
    ways, jumps = climb(messages)
    chosen = common.written(branches(messages, ways, jumps[0] if jumps else None, top))
    body = escape(F.col("text"))
    turns = spread(chosen, jumps).join(messages.select("node", "role", "text"), "node").select("leaf", "pos", (F.col("role") == LOSS_ROLE).alias("learn"), F.concat(F.lit(OPEN), escape(F.col("role"), IN_ROLE), F.lit(SEP)).alias("head"), body.alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = F.coalesce(F.sum(size.cast("long")).over(Window.partitionBy("leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before)
    turn = F.struct("pos", "start", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("learn"), F.struct(F.col("pos").cast("int").alias("turn"), (F.col("start") + F.char_length("head")).alias("start"), F.char_length("body").cast("long").alias("length"))).alias("mask"))
    rows = turns.groupBy("leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    rows = rows.select("leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.piece", "").alias("formatted"), F.col("turns.start").alias("starts"), F.filter("turns.mask", lambda m: m.isNotNull()).alias("loss"))
    return rows.join(chosen.select("leaf", "tree", "rank"), "leaf").select("tree", "leaf", "rank", "n_turns", "formatted", "starts", "loss")


def read_back(rows: DataFrame) -> DataFrame:
    """``rows`` of ``format_trees`` with ``turns`` (role, text) and ``learned`` (all text under the mask), as the formatted text has them."""
    rows = rows.withColumn("parts", F.split("formatted", CLOSE))
    at = lambda part: F.instr(part, F.lit(SEP))
    head = len(OPEN)
    turn = lambda part: F.struct(
        unescape(F.substring(part, F.lit(head + 1), at(part) - 1 - head)).alias("role"), unescape(F.substring(part, at(part) + len(SEP), F.char_length(part))).alias("text")
    )
    said = lambda m: unescape(F.substring(F.get("parts", m["turn"]), (m["start"] - F.get("starts", m["turn"]) + 1).cast("int"), m["length"].cast("int")))
    return rows.withColumns({"turns": F.transform(F.slice("parts", 1, F.size("parts") - 1), turn), "learned": F.array_join(F.transform("loss", said), "")}).drop("parts")


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conv, text = PROBE
    probe = spark.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(text).alias("text"))
    rows = read_back(format_trees(chain(turns.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), common.sha256_text(said).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        common.sha256_text(F.col("learned")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    marks = lambda c: f"length({c}) - length(replace({c}, '\\', '')) + length(array_to_string(regexp_extract_all({c}, '#{{3,}}'), '')) - 2 * len(regexp_extract_all({c}, '#{{3,}}')) + len(regexp_extract_all({c}, '</turn>'))"
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE[0]}, t, r, '{PROBE[1]}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(t, r)
), m AS (
  SELECT *, {len(OPEN + SEP + CLOSE)} + length(role) + {marks('role')} + len(regexp_extract_all(role, ': ')) + length(text) + {marks('text')} AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


ORACLE = _oracle()

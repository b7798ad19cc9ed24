"""News, pages and conversations: cleaning, duplicates, credibility, narratives, moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import register
from .ledger import count_if

#: Stand-ins: tiers of the sources of the table.
TIERS = {"src0": 1, "src1": 2, "src2": 3}


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def fingerprint(c: Column) -> Column:
    return F.sha2(normal(c), 256)


def clean_text(c: Column) -> Column:
    """Tags and control characters out, white space single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"\s+", " "))


def tier(c: Column) -> Column:
    out = F
    for source, n in TIERS.items():
        out = out.when(c == source, n)
    return out.otherwise(6)


def news_dedup(items: DataFrame) -> DataFrame:
    """Items that share no key (title or content fingerprint) with an earlier one."""
    keyed = items.select("doc_id", fingerprint(F.col("title")).alias("t"), fingerprint(F.col("content")).alias("c"))
    first = lambda k: keyed.groupBy(k).agg(F.min("doc_id").alias(f"first_{k}"))
    return keyed.join(first("t"), "t").join(first("c"), "c").where("doc_id = first_t and doc_id = first_c").select("doc_id")


def underlying(items: DataFrame) -> DataFrame:
    """Copies collapsed by content: how many sources carry it, the best tier, the representative."""
    return items.groupBy(fingerprint(F.col("content")).alias("fp")).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("source").alias("sources"), F.min(tier(F.col("source"))).alias("best_tier"), F.min_by("doc_id", F.struct(tier(F.col("source")), "doc_id")).alias("representative"))


def coordination(items: DataFrame) -> DataFrame:
    """Per platform: share of copies, largest half-hour, concentration of authors."""
    w = items.groupBy("platform", F.window("published_at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("k")).groupBy("platform").agg(F.max("k").alias("burst"), F.sum("k").alias("n"))
    a = items.groupBy("platform", "author").agg(F.count(F.lit(1)).alias("k")).groupBy("platform").agg(F.max("k").alias("top_author"))
    t = items.groupBy("platform", fingerprint(F.col("content")).alias("f")).agg(F.count(F.lit(1)).alias("k")).groupBy("platform").agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("copied"))
    share = F.round(F.col("copied") / F.col("n"), 9)
    return w.join(a, "platform").join(t, "platform").select("platform", "n", "burst", share.alias("copied_share"), F.round(F.col("top_author") / F.col("n"), 9).alias("author_share"))


NORM = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
FP = f"sha256({NORM})"
register("fingerprints", lambda v: v.news.select("doc_id", fingerprint(F.col("title")).alias("title_fp"), fingerprint(F.substring("content", 1, 800)).alias("content_fp")), f"SELECT doc_id, {FP.format('title')} AS title_fp, {FP.format('substring(content, 1, 800)')} AS content_fp FROM news")
register("news_dedup", lambda v: news_dedup(v.news), f"WITH k AS (SELECT doc_id, {FP.format('title')} AS t, {FP.format('content')} AS c FROM news) SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS a, min(doc_id) OVER (PARTITION BY c) AS b FROM k) WHERE doc_id = a AND doc_id = b")
register("clean_text", lambda v: v.pages.select("page_id", F.md5(clean_text(F.col("html"))).alias("digest"), F.length(clean_text(F.col("html"))).alias("n")), r"SELECT page_id, md5(x) AS digest, CAST(length(x) AS INT) AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS x FROM pages)")
TIER = "CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 WHEN 'src2' THEN 3 ELSE 6 END"
register("underlying_sources", lambda v: underlying(v.news), f"SELECT {FP.format('content')} AS fp, count(*) AS copies, count(DISTINCT source) AS sources, min({TIER}) AS best_tier, arg_min(doc_id, ({TIER})::BIGINT * 1000000000 + doc_id) AS representative FROM news GROUP BY 1")
register("coordination", lambda v: coordination(v.news), f"WITH w AS (SELECT platform, max(k) AS burst, sum(k)::BIGINT AS n FROM (SELECT platform, epoch_us(published_at) // 1800000000 AS b, count(*) AS k FROM news GROUP BY ALL) GROUP BY platform), a AS (SELECT platform, max(k) AS top_author FROM (SELECT platform, author, count(*) AS k FROM news GROUP BY ALL) GROUP BY platform), t AS (SELECT platform, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS copied FROM (SELECT platform, {FP.format('content')} AS f, count(*) AS k FROM news GROUP BY ALL) GROUP BY platform) SELECT platform, n, burst, round(copied / n, 9) AS copied_share, round(top_author / n, 9) AS author_share FROM w JOIN a USING (platform) JOIN t USING (platform)")
register(
    "narrative_metrics",
    lambda v: v.news.groupBy("source").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("author").alias("authors"), F.countDistinct("platform").alias("platforms"), F.min("published_at").alias("first_at"), F.max("published_at").alias("last_at")).withColumn("velocity", F.round(F.col("mentions") / F.greatest(F.lit(1.0), (F.unix_micros(F.col("last_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 3.6e9), 7)),
    "SELECT *, round(mentions / greatest(1.0, (epoch_us(last_at) - epoch_us(first_at)) / 3.6e9), 7) AS velocity FROM (SELECT source, count(*) AS mentions, count(DISTINCT author) AS authors, count(DISTINCT platform) AS platforms, min(published_at) AS first_at, max(published_at) AS last_at FROM news GROUP BY source)",
)


tokens = lambda: F.when(F.length("text") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).cast("long")
TOK = "(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT"
register("conv_stats", lambda v: v.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(tokens()).alias("tokens"), count_if(F.col("role") == "user").alias("user"), count_if(F.col("role") == "assistant").alias("assistant"), F.max("turn").alias("last_turn")), f"SELECT conv_id, count(*) AS messages, sum({TOK})::BIGINT AS tokens, count(*) FILTER (WHERE role = 'user') AS user, count(*) FILTER (WHERE role = 'assistant') AS assistant, max(turn) AS last_turn FROM conversations GROUP BY conv_id")


def conv_window(messages: DataFrame, budget: int) -> DataFrame:
    """The latest messages within a token budget; one that does not fit is skipped, the last is always kept."""
    listed = messages.groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("turn", tokens().alias("tokens"))))).alias("m"))
    fold = F.aggregate("m", F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<bigint>)").alias("kept")), lambda a, x: F.when((a["used"] + x["tokens"] <= budget) | (F.size(a["kept"]) == 0), F.struct((a["used"] + x["tokens"]).alias("used"), F.array_append(a["kept"], x["turn"]).alias("kept"))).otherwise(a))
    return listed.select("conv_id", fold.alias("f")).select("conv_id", F.col("f.used").alias("used"), F.size("f.kept").alias("kept"), F.array_join(F.array_sort("f.kept"), ",").alias("turns"))


register("conv_window", lambda v: conv_window(v.conversations, 100))


def chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Overlapping character chunks of each text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    return docs.select("doc_id", "text", F.posexplode(starts).alias("chunk", "start")).select("doc_id", "chunk", "start", F.md5(F.substring(F.col("text"), F.col("start") + 1, F.lit(size))).alias("digest"))


register("chunking", lambda v: chunks(v.documents), "SELECT doc_id, CAST(i // 448 AS INT) AS chunk, CAST(i AS INT) AS start, md5(substring(text, i + 1, 512)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1 - 64, 0) + 1, 448)) AS i FROM documents)")
register("importance", lambda v: v.conversations.select("conv_id", "turn", F.round(F.when(F.col("role") == "system", 1.0).when(F.col("role") == "user", 0.6).otherwise(0.4) * 0.5 + F.when(F.col("text").rlike(r"\b(error|please|must)\b"), 0.3).otherwise(0.0) + F.least(F.lit(0.2), F.length("text") / 1000), 9).alias("importance")), r"SELECT conv_id, turn, round((CASE role WHEN 'system' THEN 1.0 WHEN 'user' THEN 0.6 ELSE 0.4 END * 0.5)::DOUBLE + CASE WHEN regexp_matches(text, '\b(error|please|must)\b') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + least(0.2::DOUBLE, length(text) / 1000), 9) AS importance FROM conversations")

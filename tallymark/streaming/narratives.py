"""Narratives kept up to date as news arrives: batches assign items, join narratives that meet, and count anew.

Two items tell one story if their titles overlap by half, they share an entity
and are at most a day apart; narratives are the connected components of that,
so the order in which items arrive does not matter.

Items with equal title words and entities fold into episodes: stretches of time
in which the next copy is never more than a day away.  An episode is its first
and last moment, and two episodes hold items a day apart exactly if these
stretches are, so copies cost nothing beyond their count.

A batch reads the episodes near its own time, joins its new ones to them by the
first words of their titles (longest first, an order that needs no counting)
and the days that they last, and writes tables of its own: items, new episodes, and which narratives have
become part of another one.  Nothing is rewritten; every ``compact_every``
batches these are gathered into one table.  What exists is read from the storage, so a run that
starts again in the same folder goes on where the last one ended, and a batch
that runs twice replaces its own tables.

Defined results: null titles have no words and are narratives of their own, as
are items without entities; null times fall out of every window but their own
moment (1970).  Items that repeat an id count each time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, shared_folder, written
from ..operators.setjoin import ITEMS_SQL, alike, by_length, title_words
from ..registry import register
from .reorg import stored_batches

DAY = 86_400_000_000
LEAST = (1, 2)
#: Words of urgency; caps and weights of the attention score; limits of the stages of a narrative.
URGENT = "breaking|urgent|alert|just in|now|flash|exclusive|leak|insider|shock|crash|surge|imminent|emergency|soaring|plunge"
RATE_CAP, PEAK_RATE, SPREADING, RESOLVED_HOURS = 10.0, 5.0, 3, 48
WEIGHTS = {"rate": 0.35, "sources": 0.25, "platforms": 0.2, "urgency": 0.2}
#: Tables of a folder and their columns.
TABLES = {
    "items": "id long, episode string, source string, platform string, urgent boolean, at long",
    "episodes": "episode string, words array<string>, entities array<string>, first long, last long, narrative long",
    "merged": "narrative long, into long",
}


def prepared(items: DataFrame) -> DataFrame:
    """Items (``id, title, entities, published_at, source, platform``) with their words, entities and time."""
    known = items.select(
        "id", by_length(title_words(F.col("title"))).alias("words"), F.array_sort(F.array_distinct(F.coalesce("entities", F.expr("cast(array() as array<string>)")))).alias("entities"),
        F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0)).alias("at"), "source", "platform", F.coalesce(F.col("title").rlike(rf"(?i)\b({URGENT})\b"), F.lit(False)).alias("urgent"),
    )
    # Items without words or entities are no copies of each other.
    lone = (F.size("words") == 0) | (F.size("entities") == 0)
    return known.withColumn("own", F.when(lone, F.coalesce(F.col("id").cast("string"), F.lit("?"))).otherwise(F.lit("")))


def episodes(items: DataFrame) -> DataFrame:
    """``episode, own, words, entities, first, last, narrative``: stretches of equal items; ``narrative`` is the least id of one.

    Sessions of Spark: they merge in part before they are shuffled, so a story told a million times is a row a task.
    """
    rows = items.select("id", "own", "words", "entities", F.timestamp_micros("at").alias("t"), "at")
    # A session ends before its gap is over, so one microsecond more makes a day itself count.
    stretch = rows.groupBy("own", "words", "entities", F.session_window("t", f"{DAY + 1} microseconds").alias("w")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("id").alias("narrative"))
    name = F.sha2(F.concat_ws("\x1f", "own", F.to_json(F.struct("words", "entities")), F.col("first").cast("string"), F.col("narrative").cast("string")), 256)
    return stretch.select(name.alias("episode"), "own", "words", "entities", "first", "last", "narrative")


def meets(a: str, b: str) -> Column:
    """Whether two stretches are at most a day apart."""
    return (F.col(f"{b}.first") - F.col(f"{a}.last") <= DAY) & (F.col(f"{a}.first") - F.col(f"{b}.last") <= DAY)


def same_story(new: DataFrame, near: DataFrame) -> DataFrame:
    """``src, dst``: narratives of new episodes and of those nearby (the new ones among them) that tell one story."""
    day = lambda c, more=0: F.floor(F.col(c) / DAY) + more
    side = lambda e, more: e.where((F.size("words") > 0) & (F.size("entities") > 0)).withColumn("day", F.explode(F.sequence(day("first", -more), day("last", more))))
    # Episodes that meet share a day, if those of one side begin a day earlier and end a day later; the first such day counts.
    first = F.col("x.day") == F.greatest(day("x.row.first"), day("y.row.first", -1))
    fits = first & (F.col("x.row.episode") != F.col("y.row.episode")) & meets("x.row", "y.row") & F.arrays_overlap("x.row.entities", "y.row.entities")
    both = alike(side(new, 0), side(near, 1), *LEAST, fits, ("day",)).select("x.narrative", F.col("y.narrative").alias("other"))
    return both.where("narrative <> other").select(F.col("narrative").alias("src"), F.col("other").alias("dst")).distinct()


class Store:
    """The tables of a folder, by batch; a compaction stands for all batches up to its own."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one, so that a batch that runs again does not meet itself."""
        kept = lambda steps: [k for k in steps if before is None or k < before]
        # The last table that a compaction writes: if it is there, all are.
        whole = kept(stored_batches(self.spark, f"{self.base}/whole/episodes"))
        last = whole[-1] if whole else -1
        paths = [f"{self.base}/whole/{table}/at={last}"] * bool(whole) + [f"{self.base}/{table}/at={k}" for k in kept(stored_batches(self.spark, f"{self.base}/{table}")) if k > last]
        return self.spark.read.schema(TABLES[table]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def write(self, table: str, batch: int, rows: DataFrame, whole: bool = False) -> None:
        names = [c.split()[0] for c in TABLES[table].split(", ")]
        rows.select(*names).write.mode("overwrite").parquet(f"{self.base}/{'whole/' if whole else ''}{table}/at={batch}")

    def narrative_of(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """``rows`` with ``narrative`` as it stands now."""
        merged = self.read("merged", before).groupBy("narrative").agg(F.min("into").alias("into"))
        return rows.join(merged, "narrative", "left").withColumn("narrative", F.coalesce("into", "narrative")).drop("into")

    def add(self, items: DataFrame, batch: int) -> None:
        """Assign one batch."""
        items = written(prepared(items))
        new = written(episodes(items))
        span = new.agg(F.min("first"), F.max("last")).first()
        old = self.read("episodes", batch)
        near = old.where((F.col("last") >= span[0] - DAY) & (F.col("first") <= span[1] + DAY)) if span[0] is not None else old.limit(0)
        near = written(self.narrative_of(near, batch))
        links = same_story(new, near.unionByName(new.select(*near.columns)))
        merged = self.read("merged", batch)
        links = written(links)
        if not links.isEmpty():
            joined = components(links).where("node <> comp").select(F.col("node").alias("narrative"), F.col("comp").alias("into"))
            # Narratives that were part of one that joins another now are part of the other.
            moved = merged.join(joined.select(F.col("narrative").alias("into"), F.col("into").alias("to")), "into").select("narrative", F.col("to").alias("into"))
            self.write("merged", batch, joined.unionByName(moved))
        else:
            self.write("merged", batch, merged.limit(0))
        same = [F.col(f"i.{c}") == F.col(f"e.{c}") for c in ("own", "words", "entities")]
        at = items.alias("i").join(new.alias("e"), same).where(F.col("i.at").between(F.col("e.first"), F.col("e.last")))
        self.write("items", batch, at.select("i.id", "e.episode", "i.source", "i.platform", "i.urgent", "i.at"))
        self.write("episodes", batch, new)

    def compact(self, batch: int) -> None:
        """Gather what all batches up to one have written: narratives settled, one row for each that has become part of another."""
        self.write("items", batch, self.read("items"), whole=True)
        self.write("merged", batch, self.read("merged").groupBy("narrative").agg(F.min("into").alias("into")), whole=True)
        self.write("episodes", batch, self.read("episodes"), whole=True)


def narrate(news: DataFrame, base: str | None = None, compact_every: int = 20) -> DataFrame:
    """Run a stream of items into the narratives of ``base``, and return these."""
    spark = news.sparkSession
    base = base or f"{shared_folder(spark)}/narratives-{uuid.uuid4().hex}"
    store = Store(spark, base)

    def assign(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, batch_id)
        if (batch_id + 1) % compact_every == 0:
            store.compact(batch_id)

    news.writeStream.foreachBatch(assign).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return narratives(store)


def narratives(store: Store) -> DataFrame:
    """``narrative`` (least id), ``mentions, sources, platforms, first_at, last_at`` and, as of the last item of all, ``rate`` an hour, attention ``score`` (0 to 100) and ``status``."""
    known = store.narrative_of(store.read("episodes").select("episode", "narrative").distinct())  # repeated rows may begin the same episode in two batches
    items = store.read("items").join(known, "episode")
    now = items.agg(F.max("at").alias("now"))
    recent = F.col("at") >= F.col("now") - DAY
    told = items.join(F.broadcast(now), F.lit(True)).groupBy("narrative").agg(  # one row
        F.count(F.lit(1)).alias("mentions"), F.countDistinct("source").alias("sources"), F.countDistinct("platform").alias("platforms"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.count_if("urgent").alias("urgent"), F.count_if(recent).alias("recent"), F.max("now").alias("now"),
    )
    rate = F.least(F.lit(RATE_CAP), F.col("recent") / F.greatest(F.lit(1.0), (F.col("last_at") - F.col("first_at")) / 3.6e9))
    told = told.withColumn("rate", rate)
    score = WEIGHTS["rate"] * F.col("rate") / RATE_CAP + WEIGHTS["sources"] * F.least(F.lit(1.0), F.col("sources") / 3) + WEIGHTS["platforms"] * F.least(F.lit(1.0), F.col("platforms") / 2) + WEIGHTS["urgency"] * F.col("urgent") / F.col("mentions")
    status = F.when(F.col("now") - F.col("last_at") > RESOLVED_HOURS * 3_600_000_000, "resolved").when(F.col("rate") >= PEAK_RATE, "peak_hype").when(F.col("mentions") >= SPREADING, "spreading").otherwise("emerging")
    return told.select("narrative", "mentions", "sources", "platforms", F.timestamp_micros("first_at").cast("timestamp_ntz").alias("first_at"), F.timestamp_micros("last_at").cast("timestamp_ntz").alias("last_at"), F.round("rate", 7).alias("rate"), F.round(100 * score, 6).alias("score"), status.alias("status"))


def arriving_news(v) -> DataFrame:
    """News as a stream of the documents, with the stand-ins of the view."""
    docs = v.spark.readStream.schema(v.documents.schema).parquet(f"{v.sf_dir}/document[s].parquet")
    return docs.selectExpr(
        "doc_id AS id", "substring(text, 1, 80) AS title", "array(concat('by a', doc_id % 7), concat('in ', coalesce(lang, ''))) AS entities", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(doc_id AS INT)) AS published_at", "source",
        "CASE doc_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'reddit' ELSE 'x' END AS platform",
    )


register("narrative_update", lambda v: narrate(arriving_news(v)), f"""WITH RECURSIVE {ITEMS_SQL}, n AS (SELECT x.id AS a, y.id AS b FROM i x JOIN i y ON x.id <> y.id AND list_has_any(x.w, y.w) AND list_has_any(x.e, y.e) AND abs(epoch_us(x.t0) - epoch_us(y.t0)) <= {DAY} WHERE 2 * len(list_intersect(x.w, y.w)) >= len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))),
r AS (SELECT id, id AS far FROM i UNION SELECT r.id, n.b FROM r JOIN n ON n.a = r.far), c AS (SELECT id, min(far) AS narrative FROM r GROUP BY id), z AS (SELECT max(t0) AS now FROM i),
t AS (SELECT narrative, count(*) AS mentions, count(DISTINCT source) AS sources, count(DISTINCT platform) AS platforms, min(t0) AS first_at, max(t0) AS last_at, count(*) FILTER (WHERE regexp_matches(title, '(?i)\\b({URGENT})\\b')) AS urgent, count(*) FILTER (WHERE epoch_us(t0) >= epoch_us(now) - {DAY}) AS recent, any_value(now) AS now FROM i JOIN c USING (id), z GROUP BY narrative),
s AS (SELECT *, least(10.0::DOUBLE, recent / greatest(1.0::DOUBLE, (epoch_us(last_at) - epoch_us(first_at)) / 3.6e9::DOUBLE)) AS q FROM t)
SELECT narrative, mentions, sources, platforms, first_at, last_at, round(q, 7) AS rate, round(100 * (0.35::DOUBLE * q / 10 + 0.25::DOUBLE * least(1.0::DOUBLE, sources / 3) + 0.2::DOUBLE * least(1.0::DOUBLE, platforms / 2) + 0.2::DOUBLE * urgent / mentions), 6) AS score,
       CASE WHEN epoch_us(now) - epoch_us(last_at) > {48 * 3_600_000_000} THEN 'resolved' WHEN q >= 5 THEN 'peak_hype' WHEN mentions >= 3 THEN 'spreading' ELSE 'emerging' END AS status FROM s""")

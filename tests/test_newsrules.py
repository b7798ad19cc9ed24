"""Rules on news on small rows, each branch once."""

from pyspark.sql import functions as F

from tallymark.operators import newsrules as rules


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_languages(spark):
    texts = [None, "", " \n ", "Hello", "заявление о рынке сегодня", "हिन्दी समाचार पत्रिका", "中国人民大学出版社新闻报道内容", "هذا خبر عاجل عن", "привет"]
    assert column(spark, texts, rules.script_language) == ["unknown", "unknown", "unknown", "en", "other", "hi", "zh", "ar", "en"]
    assert column(spark, ["a" * 400 + "заявление о рынке"], lambda c: rules.script_language(c, 400)) == ["en"]
    df = spark.createDataFrame([(0, None), (1, "!?"), (2, "the and of"), (3, "The cat"), (4, "zzz"), (5, "der die und ist nicht"), (6, "я и он"), (7, "de que en la")], "doc_id int, content string")
    got = {r.doc_id: (r.lang, r.confidence) for r in rules.marker_language(df).collect()}
    assert got == {0: ("unknown", 0.0), 1: ("unknown", 0.0), 2: ("en", 0.225), 3: ("en", 0.05), 4: ("en", 0.0), 5: ("de", 0.25), 6: ("ru", 0.15), 7: ("fr", round(4 / 18, 9))}


def test_every_marker_and_category(spark):
    for name, words in rules.STANCES.items():
        assert set(column(spark, [f"It {w.upper()} so" for w in words.split("|")], rules.stance)) <= ({name} if name == "deny" else {name, "deny", "support"})
    assert column(spark, [None, "", "plain", "denied but confirmed", "confirmed, maybe", "unconfirmed"], rules.stance) == ["neutral", "neutral", "neutral", "deny", "support", "support"]
    texts = ["Spot ETF hacked", "the hack", "hackers", "Remove it from the LIST", "v1.20", "CEO resigns", "rates cut", "rate cuts", "sector", "sued", None, "q2 report", "phase 4"]
    assert column(spark, texts, rules.category) == ["etf", "hack", "general", "delisting", "product_launch", "executive_change", "macro", "general", "general", "regulatory", "general", "earnings", "general"]


def test_credibility_and_contradictions(spark):
    df = spark.createDataFrame([("x", "https://www.SEC.gov/a"), ("x", "https://wsj.com/"), ("rss_cnbc", None), ("?", "http://t.me"), ("newsapi", "no address"), (None, None), ("reddit", "https://reuters.com:80/")], "s string, u string")
    assert [r[0] for r in df.select(rules.credibility(F.col("s"), F.col("u"))).collect()] == [1, 5, 2, 5, 4, 6, 5]
    items = [("n", i, 1 + i % 3, s) for i, s in enumerate(["deny", "deny", "support", "support", "support", "question", "deny"])] + [("m", 9, 1, "deny"), ("o", 10, None, "deny"), ("o", 11, 2, "support")]
    got = rules.contradictions(spark.createDataFrame(items, "narrative string, item int, tier int, stance string")).collect()
    want = {}
    for n, i, t, s in items:
        for n2, i2, t2, s2 in items:
            if n == n2 and s == "deny" and s2 == "support":
                k = (n, t or 6, t2 or 6)
                c = want.get(k, (0, 99, 99))
                want[k] = (c[0] + 1, min(c[1], i), min(c[2], i2))
    assert {(r.narrative, r.deny_tier, r.support_tier): (r.pairs, r.deny_item, r.support_item) for r in got} == want
    assert all(r.net_weight == r.support_weight - r.deny_weight and r.deny_weight == 7 - r.deny_tier for r in got)

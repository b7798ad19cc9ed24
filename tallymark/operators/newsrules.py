"""Rules on news: language by script and by marker words, stance, category, credibility of a source, contradictions.

Defined results: a null text has no language (``unknown``), a neutral stance and
the category ``general``; a source that is not known is anonymous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register

# Scripts in order of their test with the language each stands for, and how many characters decide.
SCRIPTS = [("hi", "\\u0900-\\u097f"), ("zh", "\\u4e00-\\u9fff"), ("ar", "\\u0600-\\u06ff"), ("other", "\\u0400-\\u04ff")]
SCRIPT_LEAST = 10
# Marker words of languages; the first of equals wins.
MARKERS = {
    "en": "the and of to in a is for on with as by at an be this that from or are",
    "es": "el la de que y en un es se no te lo le da su por son con para una",
    "fr": "le la de et à un il être en avoir que pour dans ce qui ne sur se",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "zh": "的 一 是 在 不 了 有 和 人 这 中 大 为 上 个 国 我 以 要 他",
    "ja": "の に は を た が で て と し れ さ ある いる も な う る ん か よ",
    "ru": "и в не на я что то он но да ты к у же вы за так с по это",
    "pt": "o a de que e do da em um para é com não uma os no se na por mais",
}
# Markers of stances, in order of their test.
STANCES = {
    "deny": "not true|no truth|denies|denied|refutes|refuted|debunked|debunks|untrue|fabricated|fake news|disproven|no evidence|rejects|rejected|dismisses|dismissed|baseless|misleading|false rumor",
    "support": "confirms|confirmed|announces|announced|officially|approved|approves|authorized|authorizes|signs off|finalized",
    "question": "reportedly|allegedly|unconfirmed|speculation|rumor|rumour|rumors|rumours|sources say|claims to|whether|might|maybe|possible|possibly|expected to|set to|may be|leaked|insider says|investigating|looking into|under review|reviewing|examining|predicts|forecast|will never|expects",
}
# Patterns of categories between word borders, in order of their test.
CATEGORIES = [
    ("etf", r"etf|exchange[- ]traded fund"),
    ("hack", r"hack|hacked|exploit|exploited|drain|stolen|breach|vulnerability|stole"),
    ("delisting", r"delist|delisting|removal|remove.*list|suspended|suspension"),
    ("fraud", r"fraud|scam|ponzi|pump and dump|manipulation|insider trading|misrepresent"),
    ("product_launch", r"launch|mainnet|release|v\d+\.\d+|upgrade|fork|hard fork|soft fork|testnet"),
    ("executive_change", r"(ceo|cfo|cto|president|chairman|founder|executive|director) (steps? down|resigns?|appointed|hired|leaves?|departs?)"),
    ("merger_acquisition", r"merger|acquisition|acquires|buyout|takeover|merges with|purchased by"),
    ("guidance_change", r"(guidance|outlook|forecast|projection) (raised|lowered|increased|decreased|revised|updated)"),
    ("dividend", r"(dividend|distribution|payout|yield) (increased|raised|declared|announced|cut|suspended)"),
    ("stock_split", r"stock split|reverse split|split ratio"),
    ("bankruptcy", r"bankruptcy|chapter 11|chapter 7|insolvent|liquidation|receivership"),
    ("clinical_trial", r"clinical trial|phase [123]|fda approval|drug approval|trial results"),
    ("patent", r"patent|patented|patent granted|intellectual property|ip filing"),
    ("contract_win", r"contract awarded|government contract|enterprise deal|major deal|partnership agreement"),
    ("investigation", r"investigation|probe|inquiry|investigated|subpoena|doj|sec investigation"),
    ("sanctions", r"sanctions|sanctioned|ofac|sdn list|treasury sanctions|embargo"),
    ("earnings", r"earnings|revenue|q[1-4] (results|report)|profit"),
    ("partnership", r"partnership|partners with|invests in"),
    ("macro", r"inflation|interest rate|fed|federal reserve|gdp|unemployment|tariff|rates? (hike|cut)|recession"),
    ("regulatory", r"sec|fcc|regulator|regulation|ban|banned|lawsuit|indictment|charge|sued|unregistered|class action"),
]
# Tiers of hosts and of sources, 1 the most credible.
HOSTS = {
    1: "sec.gov fda.gov ftc.gov treasury.gov federalreserve.gov ecb.europa.eu bankofengland.co.uk nseindia.com sebi.gov.in binance.com coinbase.com binance.us cftc.gov justice.gov whitehouse.gov ec.europa.eu",
    2: "cnbc.com marketwatch.com reuters.com bloomberg.com wsj.com ft.com nytimes.com apnews.com economist.com barron.com financialtimes.com theguardian.com washingtonpost.com",
    3: "coindesk.com cointelegraph.com theblock.co decrypt.co blockworks.co bitcoinmagazine.com cryptoslate.com coingecko.com coinmarketcap.com",
    5: "reddit.com x.com twitter.com t.me telegram.me discord.com discord.gg",
}
SOURCES = {2: "rss_cnbc rss_marketwatch", 3: "rss_coindesk rss_cointelegraph", 4: "rss_yahoo_finance tiingo newsapi", 5: "reddit x_stream telegram x"}
ANONYMOUS = 6


def script_language(text: Column, head: int | None = None) -> Column:
    """The language of the first script with more than 10 characters in the text (or its ``head``), else en; ``unknown`` for blanks."""
    seen = F.regexp_replace(text, r"^\s+|\s+$", "")
    seen = seen if head is None else F.substring(seen, 1, head)
    out = F.when(F.coalesce(F.length(seen), F.lit(0)) == 0, "unknown")
    for lang, span in SCRIPTS:
        out = out.when(F.regexp_count(seen, F.lit(f"[{span}]")) > SCRIPT_LEAST, lang)
    return out.otherwise("en")


def marker_language(items: DataFrame, text: str = "content", key: str = "doc_id") -> DataFrame:
    """``key, lang, confidence``: the language with the largest share of its marker words among the words of the text, first of equals; more than a tenth of English counts half as much again."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+")), "")
    shares = [F.struct((F.size(F.array_intersect("w", F.array(*map(F.lit, m.split())))) / F.lit(float(len(m.split())))).alias("share"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, m) in enumerate(MARKERS.items())]
    best = items.select(key, words.alias("w")).select(key, F.coalesce(F.size("w"), F.lit(0)).alias("n"), F.array_max(F.array(*shares)).alias("b"))
    share = F.when((F.col("b.lang") == "en") & (F.col("b.share") > 0.1), F.least(F.lit(1.0), F.col("b.share") * 1.5)).otherwise(F.col("b.share"))
    has = F.col("n") > 0
    return best.select(key, F.when(has, F.col("b.lang")).otherwise("unknown").alias("lang"), F.round(F.when(has, share).otherwise(0.0), 9).alias("confidence"))


def stance(text: Column) -> Column:
    out = F
    for name, words in STANCES.items():
        out = out.when(F.lower(text).rlike(words), name)
    return out.otherwise("neutral")


def category(text: Column) -> Column:
    out = F
    for name, pattern in CATEGORIES:
        out = out.when(F.lower(text).rlike(rf"\b({pattern})\b"), name)
    return out.otherwise("general")


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without the letters w and dots that it begins with (so hosts that begin with w are known by what follows only)."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "https?://([^/]+)", 1)), r"^[w.]+", "")


def credibility(source: Column, url: Column) -> Column:
    """Tier 1 to 6 by host, else by source; hosts come first."""
    host, out = host_of(url), F
    for n, names in HOSTS.items():
        out = out.when(host.isin(names.split()), n)
    for n, names in SOURCES.items():
        out = out.when(source.isin(names.split()), n)
    return out.otherwise(ANONYMOUS)


def contradictions(items: DataFrame) -> DataFrame:
    """Denying against supporting sources (``narrative, item, tier, stance``) of each narrative, by tier: how many pairs, the weights (7 less the tier), the least item of each.

    Sources of a tier weigh the same, so a narrative has 25 rows at most instead of all its pairs.
    """
    g = items.where("stance in ('deny', 'support')").groupBy("narrative", "stance", F.coalesce("tier", F.lit(ANONYMOUS)).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item"))
    side = lambda s: g.where(F.col("stance") == s).select("narrative", F.col("tier").alias(f"{s}_tier"), F.col("n").alias(f"{s}_n"), F.col("item").alias(f"{s}_item"))
    both = side("deny").join(side("support"), "narrative")
    weights = {"deny_weight": 7 - F.col("deny_tier"), "support_weight": 7 - F.col("support_tier"), "net_weight": F.col("deny_tier") - F.col("support_tier")}
    return both.withColumns({"pairs": F.col("deny_n") * F.col("support_n"), **weights}).drop("deny_n", "support_n")


#: Stand-ins: texts that end with a marker or a phrase by number, so that every rule decides somewhere; addresses by number.
PHRASES = [m for s in STANCES.values() for m in s.split("|")] + ["An ETF", "exchange-traded fund", "was hacked", "remove it from the list", "a Ponzi", "v2.10 is out", "hard fork", "CEO steps down", "director resigns", "merges with", "outlook lowered", "payout cut", "stock split", "Chapter 11", "phase 3", "IP filing", "major deal", "subpoena", "OFAC", "q3 results", "invests in", "rate hike", "class action", "", "hackers etfs sector"]
PHRASES += ["новости о том что это не так и он на что", "これ は の に を た が で です", "我 是 人 的 中国人民大学出版社新闻报道内容", "el la que con para una", "der die das und ist nicht", "समाचार में यह सच है कि वह", "هذا خبر عاجل عن السوق اليوم", "é não uma os mais do com"]
URLS = ["https://www.<h>/a/<n>", "http://<h>", "https://<h>:8080/x", "ftp://<h>/", "see https://M.<h>/", "https://<h>/?u=https://x.com/"]
ALL_HOSTS = [h for names in HOSTS.values() for h in names.split()] + ["example.org", "sj.com", "ww.x.com"]
ALL_SOURCES = [s for names in SOURCES.values() for s in names.split()] + ["src0"]


def _told(listed: str, div: str) -> str:
    quoted = lambda xs: listed.format(", ".join(f"'{x}'" for x in xs))
    pick = lambda xs, n: (f"element_at({quoted(xs)}, CAST(1 + {n} % {len(xs)} AS INT))" if div == "DIV" else f"({quoted(xs)})[1 + {n} % {len(xs)}]")
    url = f"replace(replace({pick(URLS, f'(doc_id {div} 7)')}, '<h>', {pick(ALL_HOSTS, 'doc_id')}), '<n>', CAST(doc_id AS STRING))"
    return f"SELECT doc_id, doc_id {div} 5 AS narrative, CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 89 = 0 THEN ' ' WHEN doc_id % 4 = 0 THEN concat(text, ' ', {pick(PHRASES, f'(doc_id {div} 4)')}) ELSE {pick(PHRASES, 'doc_id')} END AS content, {pick(ALL_SOURCES, f'(doc_id {div} 3)')} AS source, CASE WHEN doc_id % 10 < 7 THEN {url} END AS url FROM "


def told(v) -> DataFrame:
    return v.spark.sql(_told("array({0})", "DIV") + "{d}", d=v.documents)


def _sql() -> dict[str, str]:
    t = f"t AS ({_told('[{0}]', '//')}documents)"
    words = "list_filter(list_distinct(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+')), lambda x: x <> '')"
    hit = ", ".join(f"len(list_intersect(w, {m.split()})) / {float(len(m.split()))}::DOUBLE" for m in MARKERS.values())
    script = " ".join(f"WHEN len(regexp_extract_all(x, '[{s.replace(chr(92) + 'u', chr(92) + 'x{').replace('-', '}-')}}}]')) > {SCRIPT_LEAST} THEN '{lang}'" for lang, s in SCRIPTS)
    said = " ".join(f"WHEN len(list_filter({m.split('|')}, lambda m: contains(lower(content), m))) > 0 THEN '{s}'" for s, m in STANCES.items())
    kinds = " ".join(f"WHEN regexp_matches(content, '\\b({p})\\b', 'i') THEN '{n}'" for n, p in CATEGORIES)
    host = "ltrim(lower(regexp_extract(url, 'https?://([^/]+)', 1)), 'w.')"
    tier = " ".join([f"WHEN list_contains({h.split()}, {host}) THEN {n}" for n, h in HOSTS.items()] + [f"WHEN list_contains({s.split()}, source) THEN {n}" for n, s in SOURCES.items()])
    return {
        "language": f"WITH {t}, g AS (SELECT doc_id, trim(content) AS x, {words} AS w FROM t), n AS (SELECT doc_id, len(w) > 0 AS has, [{hit}] AS n, CASE WHEN coalesce(x, '') = '' THEN 'unknown' {script} ELSE 'en' END AS script FROM g) SELECT doc_id, script, CASE WHEN has THEN {list(MARKERS)}[list_position(n, list_max(n))] ELSE 'unknown' END AS lang, round(CASE WHEN NOT coalesce(has, false) THEN 0 WHEN list_position(n, list_max(n)) = 1 AND n[1] > 0.1 THEN least(1.0::DOUBLE, n[1] * 1.5::DOUBLE) ELSE list_max(n) END, 9) AS confidence FROM n",
        "stance": f"WITH {t} SELECT doc_id, CASE {said} ELSE 'neutral' END AS stance FROM t",
        "category": f"WITH {t} SELECT doc_id, CASE {kinds} ELSE 'general' END AS category FROM t",
        "credibility": f"WITH {t} SELECT doc_id, CASE {tier} ELSE {ANONYMOUS} END AS tier FROM t",
        "contradictions": f"WITH {t}, s AS (SELECT narrative, doc_id, CASE {said} ELSE 'neutral' END AS stance, CASE {tier} ELSE {ANONYMOUS} END AS tier FROM t) SELECT d.narrative, d.tier AS deny_tier, u.tier AS support_tier, count(*) AS pairs, min(d.doc_id) AS deny_item, min(u.doc_id) AS support_item, 7 - d.tier AS deny_weight, 7 - u.tier AS support_weight, d.tier - u.tier AS net_weight FROM s d JOIN s u ON d.narrative = u.narrative AND d.stance = 'deny' AND u.stance = 'support' GROUP BY d.narrative, d.tier, u.tier",
    }


ORACLE = _sql()
register("language", lambda v: marker_language(told(v)).join(told(v).select("doc_id", script_language(F.col("content")).alias("script")), "doc_id"), ORACLE["language"])
register("stance", lambda v: told(v).select("doc_id", stance(F.col("content")).alias("stance")), ORACLE["stance"])
register("category", lambda v: told(v).select("doc_id", category(F.col("content")).alias("category")), ORACLE["category"])
register("credibility", lambda v: told(v).select("doc_id", credibility(F.col("source"), F.col("url")).alias("tier")), ORACLE["credibility"])
register("contradictions", lambda v: contradictions(told(v).select("narrative", F.col("doc_id").alias("item"), credibility(F.col("source"), F.col("url")).alias("tier"), stance(F.col("content")).alias("stance"))), ORACLE["contradictions"])

"""Moderation of texts by words and patterns: flags with scores, and redaction of personal data.

Defined results: a null or blank text has no flags; its redaction is the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import register

# Words in lower case that raise a flag, each flag's score.
WORDS = {
    "toxic": ("stupid|idiot|hate you|shut up|loser|scumbag|trash", 0.8),
    "hate": ("kill all|exterminate|die you|hate group", 0.9),
    "sexual": ("nsfw|explicit sex|porn", 0.9),
    "violence": ("kill yourself|bomb recipe|make a bomb|knife attack|shooting plan", 0.9),
    "malware": ("ransomware|keylogger|cryptojacker|steal credentials|spyware|exploit kit", 0.95),
}
# Patterns on the text in lower case.
PATTERNS = {
    "jailbreak": ([
        r"\bignore (all |your |previous )?(instructions|prompts)\b", r"\byou are now (a |an )?[\w\s]{1,20}without (rules|limitations|restrictions)\b", r"\b(dan mode|developer mode|do anything now|free from jail)\b",
        r"\bbypass (the |its )?(safety|guardrails|content policy)\b", r"\bpretend to be (another )?(ai|model|assistant|chatbot)\b",
    ], 0.9),
    "prompt_injection": ([
        r"\b(ignore|disregard) (the )?(above|previous|prior) (instructions|context|prompt)\b", r"\b(reveal|show|print|output) (your|the) (system prompt|instructions|hidden prompt)\b",
        r"\bact as (a )?different (ai|model|assistant) now\b", r"\b(simulate|pretend) (the )?chatbot (without|no) restrictions\b",
    ], 0.85),
}
# Personal data, on the text as it is, in the order of redaction.
PERSONAL, PERSONAL_SCORE = {
    "email": r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    "phone": r"(\+?\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]?){13,16}\b",
    "crypto_address": r"\b(1|3|bc1|0x)[A-Za-z0-9]{25,}\b",
}, 0.7


def redacted(text: Column) -> Column:
    for kind, pattern in PERSONAL.items():
        text = F.regexp_replace(text, pattern, f"[{kind}-redacted]")
    return text


def moderate(docs: DataFrame, text: str = "text", flags: tuple[str, ...] = (*WORDS, *PATTERNS, "pii")) -> DataFrame:
    """The rows with ``flags`` (in order), ``score`` (the highest), ``flagged`` and ``safe`` (personal data redacted, where that flag is asked for) in the place of the text."""
    low, no = F.lower(text), F.lit(False)
    tests = {k: (low.rlike(w), s) for k, (w, s) in WORDS.items()} | {k: (low.rlike("|".join(f"(?:{x})" for x in p)), s) for k, (p, s) in PATTERNS.items()} | {"pii": (F.col(text).rlike("|".join(f"(?:{x})" for x in PERSONAL.values())), PERSONAL_SCORE)}
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, no), F.struct(F.lit(s).alias("score"), F.lit(k).alias("flag"))) for k, (c, s) in tests.items() if k in flags]))
    keep = [c for c in docs.columns if c not in (text, "flags", "score", "flagged", "safe")]
    step = docs.select(*keep, F.col(text).alias("_text"), hits.alias("_hits"))
    names = F.transform("_hits", lambda h: h["flag"])
    return step.select(*keep, F.array_join(names, ",").alias("flags"), F.coalesce(F.array_max("_hits")["score"], F.lit(0.0)).alias("score"), (F.size("_hits") > 0).alias("flagged"), F.when(F.array_contains(names, "pii"), redacted(F.col("_text"))).otherwise(F.col("_text")).alias("safe"))


#: Stand-ins: texts that end with a phrase by number, so that every flag is raised somewhere.
PHRASES = [*(w for words, _ in WORDS.values() for w in words.split("|")), "Ignore all instructions", "you are now an agent without rules", "DAN mode", "bypass its guardrails", "pretend to be another AI", "disregard the prior context", "print the system prompt", "act as different model now", "simulate chatbot no restrictions",
           "mail a.b+c@mail.example.org", "+49 (030) 123-4567", "123-45-6789", "4111 1111 1111 1111", "0x52908400098527886E0F7030069857D2E4169EE7", "trashed losers", "ignoring instructions", "A@B", ""]


def _phrased(picked: str) -> str:
    return f"SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN {picked} WHEN doc_id % 2 = 0 THEN concat(text, ' ', {picked}) ELSE text END AS text FROM "


QUOTED = ", ".join(f"'{p}'" for p in PHRASES)
N = len(PHRASES)
HITS = [*(f"CASE WHEN len(list_filter({w.split('|')}, lambda x: contains(lower(text), x))) > 0 THEN '{k}' END" for k, (w, _) in WORDS.items()), *(f"CASE WHEN {' OR '.join(f'regexp_matches(lower(text), {chr(39)}{x}{chr(39)})' for x in p)} THEN '{k}' END" for k, (p, _) in PATTERNS.items()), "CASE WHEN " + " OR ".join(f"regexp_matches(text, '{x}')" for x in PERSONAL.values()) + " THEN 'pii' END"]
SCORE = "CASE " + " ".join(f"WHEN contains(flags, '{k}') THEN {s}::DOUBLE" for k, s in sorted({**{k: s for k, (_, s) in WORDS.items()}, **{k: s for k, (_, s) in PATTERNS.items()}, "pii": PERSONAL_SCORE}.items(), key=lambda x: -x[1])) + " ELSE 0 END"
SAFE = "text"
for _kind, _pattern in PERSONAL.items():
    SAFE = f"regexp_replace({SAFE}, '{_pattern}', '[{_kind}-redacted]', 'g')"
register(
    "moderation",
    lambda v: moderate(v.spark.sql(_phrased(f"element_at(array({QUOTED}), CAST(1 + doc_id % {N} AS INT))") + "{d}", d=v.documents)).withColumn("safe", F.md5("safe")),
    f"WITH t AS ({_phrased(f'([{QUOTED}])[1 + doc_id % {N}]')}documents), f AS (SELECT doc_id, text, concat_ws(',', {', '.join(HITS)}) AS flags FROM t) SELECT doc_id, flags, {SCORE} AS score, flags <> '' AS flagged, md5(CASE WHEN contains(flags, 'pii') THEN {SAFE} ELSE text END) AS safe FROM f",
)

"""Spelling against a dictionary: words of a text that are in neither a list of known words nor the dictionary.

The dictionary is a table of words of any size; what is missing from it is found by an anti join of the texts' distinct
words, never by sending it to the driver. Without a dictionary nothing is misspelt. Where the texts are their own dictionary,
the rare words tell in whose texts they are, in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions import entities as en
from docsift.functions import wordlists as wl
from docsift.functions.dialect import WHITE, Spark
from docsift.functions.skills import TECH_TERMS

# Fixed values
COMMON_WORDS = (
    "technology", "system", "application", "management", "development", "vehicle", "booking", "registration", "image", "processing", "data", "analysis", "project", "mobile", "software", "engineering", "network", "security", "database",
    "platform", "cloud", "learning", "automation", "storage", "design", "service", "model", "assistant", "voice", "number", "plate", "detection", "recognition", "text", "codeunnati", "unnati", "code unnati",
)
MAX_CHARS, MAX_WORDS = 100_000, 2000
_LISTS = (TECH_TERMS, wl.RESUME_TERMS, wl.ACADEMIC_TERMS, wl.MAIL_DOMAINS, en.PLACES, wl.INSTITUTES, wl.RESUME_ENTITIES, wl.SECURITY_TERMS, wl.OCR_TERMS, wl.INDIAN_TERMS, wl.NAMES, COMMON_WORDS, wl.SPELLED_FRAMEWORKS)
#: Entries of all lists that a word can equal.
KNOWN = tuple(sorted({w for words in _LISTS for w in words if w.isascii() and w.isalpha()}))


def is_merged(d: Spark, w: str, common=COMMON_WORDS) -> str:
    """Twelve letters or more that two common words make up."""
    return f"(length({w}) >= 12 AND {d.two_of(w, common)})"


def _plain(d: Spark, text: str) -> str:
    return d.sub(d.sub(f"substr({text}, 1, {MAX_CHARS})", rf"[^{WHITE}]+@[^{WHITE}]+", " "), rf"https?://[^{WHITE}]+", " ")


def _worth_a_look(d: Spark, w: str, known) -> str:
    return f"length({w}) BETWEEN 5 AND 20 AND NOT {d.among(w, known)} AND NOT {is_merged(d, w)} AND NOT {d.match(w, '(?:university|institute)$')}"


def checked_words(d: Spark, text: str, known=KNOWN) -> list[dict[str, str]]:
    """Layers that end in ``checked``: the first MAX_WORDS lower-case words of 5 to 20 letters that are worth a look."""
    t, own = _plain(d, text), _worth_a_look(d, "w", known)
    whole = d.where(d.found("plain_text", r"[\p{L}\p{N}_]+"), "x", d.match("x", "^[A-Za-z]{3,}$"))
    return [{"plain_text": t}, {"all_words": d.each(whole, "x", "lower(x)")}, {"checked": d.take(d.where("all_words", "w", own), MAX_WORDS)}]


def ratio(typos: str, words: str) -> str:
    return f"CASE WHEN {words} > 0 THEN round({typos} / CAST({words} AS DOUBLE), 4) ELSE 0.0D END"


def typo_score(typos: str, words: str) -> str:
    return f"CASE WHEN {words} = 0 THEN 100.0D ELSE greatest(50.0D, 100 - ({ratio(typos, words)}) * 200) END"


def checked_array(text: str, known=KNOWN) -> list[dict[str, str]]:
    """The same layers for Spark alone: addresses are looked for at the starts of words only, and of all words just those of 5
    to 20 ASCII letters are taken out of a text, in one look."""
    d = Spark()
    whole = f"substr({text}, 1, {MAX_CHARS})"
    t = f"CASE WHEN contains({whole}, '@') THEN {d.sub(whole, rf'(?<![^{WHITE}])[^{WHITE}]+@[^{WHITE}]+', ' ')} ELSE {whole} END"
    words = d.found("plain_text", r"(?<![\p{L}\p{N}_])[A-Za-z]{5,20}+(?![\p{L}\p{N}_])")
    return [
        {"plain_text": d.sub(t, rf"https?://[^{WHITE}]+", " ")},
        {"all_words": f"split(lower(array_join({words}, ' ')), ' ')"},
        {"checked": d.take(d.where("all_words", "w", _worth_a_look(d, "w", known)), MAX_WORDS)},
    ]


def count_rare(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, typo_count, total_words, typo_ratio, typo_score of (doc_id, text), doc_id a key; a word in three texts or more is no
    typo. Others have two texts at most, the least and the greatest doc_id: so words are only counted, nothing is joined, and
    a word in every text is a row a task. A null word brings along a document's total."""
    made = docs
    for layer in checked_array("coalesce(text, '')", known):
        made = made.selectExpr("doc_id", *[f"{v} AS {k}" for k, v in layer.items()])
    each = made.selectExpr("doc_id", "size(checked) AS n", "explode(concat(array_distinct(checked), array(CAST(NULL AS STRING)))) AS word")
    found = each.groupBy("word", F.expr("CASE WHEN word IS NULL THEN doc_id END").alias("own")).agg(F.count(F.lit(1)).alias("in_texts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("n").alias("n"))
    rare = found.filter("word IS NULL OR in_texts < 3").selectExpr("word", "CASE WHEN word IS NULL THEN n END AS n", "explode(array_distinct(array(low, high))) AS doc_id")
    return _scored(rare.groupBy("doc_id").agg(F.count("word").cast("int").alias("typo_count"), F.max("n").alias("total_words")))


def _scored(counted: DataFrame) -> DataFrame:
    return counted.selectExpr("*", f"{ratio('typo_count', 'total_words')} AS typo_ratio", f"{typo_score('typo_count', 'total_words')} AS typo_score")


def count_typos(checked: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """doc_id, typo_count, total_words, typo_ratio, typo_score of (doc_id, checked); ``dictionary`` has a column word."""
    totals = checked.select("doc_id", F.size("checked").alias("total_words"))
    if dictionary is None:
        counted = totals.select("doc_id", F.lit(0).alias("typo_count"), F.lit(0).alias("total_words"))
    else:
        words = checked.select("doc_id", F.explode(F.array_distinct("checked")).alias("word"))
        bad = words.join(dictionary.select("word").distinct(), "word", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("typo_count"))
        counted = totals.join(bad, "doc_id", "left").select("doc_id", F.coalesce("typo_count", F.lit(0)).alias("typo_count"), "total_words")
    return _scored(counted)

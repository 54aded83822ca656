"""Whether words are in a list, by the form that suits its size.

A short list is a literal in the plan; a longer one is a join, whose side is broadcast while a count proves it small, and
shuffled beyond. The result is the same, and a list of any length will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries of a literal, and of a list that is broadcast.
LITERAL, BROADCAST = 500, 1_000_000


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    """word: distinct lower-case entries of a word list; blank lines and # comments go."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> '' AND NOT startswith(word, '#')").distinct()


def form_of(words: DataFrame, literal: int = LITERAL, broadcast: int = BROADCAST) -> str:
    """literal, broadcast or shuffle, from a count that goes no further than it must."""
    n = words.select("word").distinct().limit(broadcast + 1).count()
    return "literal" if n <= literal else "broadcast" if n <= broadcast else "shuffle"


def with_known(frame: DataFrame, column: str, words: DataFrame, out: str, literal: int = LITERAL, broadcast: int = BROADCAST) -> DataFrame:
    """Adds ``out``: whether the column's value is one of ``words`` (word); null stays unknown, so false."""
    words = words.select("word").filter("word IS NOT NULL").distinct()
    form = form_of(words, literal, broadcast)
    if form == "literal":
        held = [r.word for r in words.collect()]
        return frame.withColumn(out, F.coalesce(F.col(column).isin(held), F.lit(False)) if held else F.lit(False))
    known = words.select(F.col("word").alias("word_"), F.lit(True).alias(out))
    joined = frame.join(F.broadcast(known) if form == "broadcast" else known, F.col(column) == F.col("word_"), "left").drop("word_")
    return joined.withColumn(out, F.coalesce(out, F.lit(False)))


def unknown(tokens: DataFrame, column: str, words: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of tokens whose word is in none of ``words``, by an anti join; null words stay out."""
    words = words.select(F.col("word").alias(column)).filter(F.col(column).isNotNull()).distinct()
    small = form_of(words.withColumnRenamed(column, "word"), 0, broadcast) == "broadcast"
    return tokens.filter(F.col(column).isNotNull()).join(F.broadcast(words) if small else words, column, "left_anti")

"""The known name most like each token, as a join: every distinct token is looked up once, however often it occurs.

The ratio of two strings is twice the characters in their matching blocks over all their characters (Ratcliff and
Obershelp's). With a ratio of ``cutoff`` or more, M >= cutoff * T / 2 of T characters match. Between two blocks one of the
strings has a character that doesn't, so there are at most T - 2M + 1 blocks, and as each but its last character begins
a common bigram, two such strings share (1.5 * cutoff - 1) * T - 1 bigrams at least, repeats counted. So candidates come from
an equality join on numbered bigrams, are bounded by length and by their common bigrams, and only those left are
compared exactly. No candidate that could match is lost.

Names are a short fixed list, which is why their bigrams may be broadcast; tokens, candidates and matches are shuffled.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Names whose bigrams may be broadcast.
MAX_NAMES = 5_000


@pandas_udf(DoubleType())
def ratio(token: pd.Series, name: pd.Series) -> pd.Series:
    """As difflib has it, which isn't symmetric: the name is the first sequence."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for t, n in zip(token, name, strict=True):
        if t != last:
            matcher.set_seq2(t)  # prepared once for a token's candidates
            last = t
        matcher.set_seq1(n)
        out.append(matcher.ratio())
    return pd.Series(out)


def bigrams(text: str) -> list[str]:
    pairs = [text[k : k + 2] for k in range(len(text) - 1)]
    return [f"{p}{pairs[:k].count(p)}" for k, p in enumerate(pairs)]


def _numbered(x: Column) -> Column:
    """Bigrams of a string of two characters or more, each with how often it came before."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda k: F.substr(x, k, F.lit(2)))
    return F.transform(pairs, lambda p, k: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), k), lambda q: q == p)).cast("string")))


def longest(names: tuple[str, ...], cutoff: float) -> int:
    """Of a token that can match a name. Others, such as whole paragraphs, are left out before their bigrams are numbered, which
    takes the square of their length."""
    return int(max(map(len, names), default=0) * (2 - cutoff) / cutoff + 1e-9)


def closest(tokens: DataFrame, names: tuple[str, ...], cutoff: float, least_length: int) -> DataFrame:
    """token, name, ratio: of each distinct ``token`` of ``least_length`` characters or more the name with the greatest
    ratio of at least ``cutoff``, of equals the last by alphabet; tokens without one are left out."""
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names are not broadcast")
    # the shortest pair within the bound on lengths
    shortest = least_length + -(-cutoff * least_length // (2 - cutoff))
    if (1.5 * cutoff - 1) * shortest - 1 <= 0:
        raise ValueError("with this cutoff and length, strings that match needn't share a bigram")
    spark = tokens.sparkSession
    known = spark.createDataFrame([(n, len(n), g) for n in names for g in bigrams(n)] or [("", 0, "")], "name string, n_name int, gram string")
    each = tokens.filter(F.length("token").between(least_length, longest(names, cutoff))).select("token").distinct().withColumn("n_token", F.length("token"))
    grams = each.select("token", "n_token", F.explode(_numbered(F.col("token"))).alias("gram"))
    total = F.col("n_token") + F.col("n_name")
    near = grams.join(F.broadcast(known), "gram").filter(2 * F.least("n_token", "n_name") >= cutoff * total)
    near = near.groupBy("token", "name").agg(F.count(F.lit(1)).alias("common"), F.max(total).alias("total"))
    near = near.filter(F.col("common") >= (1.5 * cutoff - 1) * F.col("total") - 1 - 1e-9)
    # a token's candidates lie together, so that each is prepared once; not deterministic, lest the optimizer moves the comparison
    # below the bound on bigrams and makes it twice
    rated = near.repartition("token").sortWithinPartitions("token").select("token", "name", ratio.asNondeterministic()("token", "name").alias("ratio"))
    rated = rated.filter(F.col("ratio") >= cutoff)
    best = rated.groupBy("token").agg(F.max(F.struct("ratio", "name")).alias("best"))
    return best.select("token", "best.name", "best.ratio")


def with_closest(frame: DataFrame, tokens: str, out: str, names: tuple[str, ...], cutoff: float, least_length: int, key: str = "doc_id") -> DataFrame:
    """Adds ``out``: of the array ``tokens`` each that is a name, else the closest one, else null. ``key`` tells rows apart."""
    exact = F.array(*[F.lit(n) for n in names])
    other = F.transform(F.col(tokens), lambda t: F.when(~F.array_contains(exact, t) & F.length(t).between(least_length, longest(names, cutoff)), t))
    asked = frame.select(key, F.posexplode(other).alias("pos", "token")).filter("token IS NOT NULL")
    found = asked.join(closest(asked, names, cutoff, least_length).select("token", "name"), "token")
    found = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "name"))).alias("closest_"))
    joined = frame.join(found, key, "left")
    value = lambda t, k: F.when(F.array_contains(exact, t), t).otherwise(F.try_element_at("closest_", k))
    return joined.withColumn(out, F.transform(F.col(tokens), value)).drop("closest_")

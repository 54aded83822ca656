"""Many keywords in one pass over a text: an Aho-Corasick automaton of all words, whose hits serve every flag and count.

A hit list is an array of longs, 63 keywords a long, so that a flag is a bitwise and, and a count a bit count; both stay in
generated code. Keywords are substrings, as with ``contains``; one within another and overlapping ones all count.
A worker builds the automaton once. Null texts have no hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docsift.functions.dialect import Only, Spark

BITS = 63


@lru_cache(8)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for k, word in enumerate(words):
        made.add_word(word, k)
    made.make_automaton()
    return made


def masks(text: str | None, words: tuple[str, ...]) -> list[int] | None:
    if text is None:
        return None
    out = [0] * -(-len(words) // BITS)
    for k in {k for _, k in automaton(words).iter(text)}:
        out[k // BITS] |= 1 << k % BITS
    return out


def hits_udf(words: tuple[str, ...]) -> Callable[..., Column]:
    @arrow_udf("array<long>")
    def found(texts: pa.Array) -> pa.Array:
        # a batch stays in Arrow: one text at a time is a string
        return pa.array((masks(t.as_py(), words) for t in texts), pa.list_(pa.int64()), size=len(texts))

    return found.asNondeterministic()  # never copied into a condition


class Collecting(Spark):
    """Notes which keywords are looked for in which of some texts."""

    def __init__(self, texts: Iterable[str]):
        self.asked: dict[str, set[str]] = {t: set() for t in texts}

    def _ask(self, t: str, words) -> None:
        if t in self.asked:
            self.asked[t].update(words)

    def any(self, t: str, words) -> str:
        self._ask(t, words)
        return super().any(t, words)

    def count(self, t: str, words) -> str:
        self._ask(t, words)
        return super().count(t, words)

    @property
    def keywords(self) -> tuple[str, ...]:
        return tuple(sorted(set().union(*self.asked.values())))


class Matching(Spark):
    """Flags and counts of keywords from the hit lists {text}_hits of some texts; elsewhere as ever."""

    def __init__(self, texts: Iterable[str], words: tuple[str, ...]):
        self.texts, self.index = frozenset(texts), {w: k for k, w in enumerate(words)}

    def _masks(self, words) -> dict[int, int]:
        out: dict[int, int] = {}
        for w in words:
            k = self.index[w]
            out[k // BITS] = out.get(k // BITS, 0) | 1 << k % BITS
        return out

    def any(self, t: str, words) -> str:
        if t not in self.texts:
            return super().any(t, words)
        parts = [f"(get({t}_hits, {k}) & {m}L)" for k, m in sorted(self._masks(words).items())]
        return f"coalesce(({' | '.join(parts)}) <> 0, false)"

    def count(self, t: str, words) -> str:
        if t not in self.texts:
            return super().count(t, words)
        parts = [f"bit_count(get({t}_hits, {k}) & {m}L)" for k, m in sorted(self._masks(words).items())]
        return f"coalesce({' + '.join(parts)}, 0)"


def with_hits(frame: DataFrame, texts: Iterable[str], words: tuple[str, ...]) -> DataFrame:
    """Adds {text}_hits of each of the text columns."""
    found = hits_udf(words)
    # named twice, so that the optimizer leaves the text a column of its own
    own = {f"{t}_hits": found(F.expr(f"if(length({t}) < 0, NULL, {t})")) for t in texts}
    return frame.withColumns(own)


def with_layers_by_hits(frame: DataFrame, layers: Callable[[Spark], list[dict[str, str]]], texts: Iterable[str]) -> DataFrame:
    """The frame with all layers; the keywords of each text, a column of the frame or of a layer, are found in one pass."""
    collected = Collecting(texts)
    made = layers(collected)
    used = {t: next((k + 1 for k, layer in enumerate(made) if t in layer), 0) for t, words in collected.asked.items() if words}
    for k, layer in enumerate([{}, *layers(Matching(used, collected.keywords))]):
        if layer:
            frame = frame.selectExpr(*Only.columns(layer))
        if now := [t for t, at in used.items() if at == k]:
            frame = with_hits(frame, now, collected.keywords)
    return frame.drop(*[f"{t}_hits" for t in used])

"""Sections and blocks before the layers of a query: windows over lines in Spark, arrays within the row in the SQL that
checks them, so that the two share only the header rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions import cleaning as cl
from docsift.functions import entities as en
from docsift.functions import headers as hd
from docsift.functions.dialect import Spark
from docsift.operators import section_windows as sw
from docsift.plans.rough import First, with_layers


def _run_titles(d: Spark) -> list[dict[str, str]]:
    return [*hd.sections(d), {"run_titles": d.each("opened", "i", d.at("merged", "i"))}]


def _after(cleaned: bool, windows, layers) -> First:
    before = (lambda d: [*cl.layers(d, cl.CHAIN), *en.lines_layer(d, "clean")]) if cleaned else en.lines_layer

    def frame(rows: DataFrame) -> DataFrame:
        # texts are dealt out as they come and cut where they then are; lines are cut again by those that ask for them, not sorted
        # with the row
        made = windows(with_layers(rows.repartition("doc_id"), before(Spark())), dealt=True)
        return made.withColumns({k: F.expr(v) for k, v in en.lines_layer(Spark(), "raw")[1].items()})

    return First(frame, lambda d: [*before(d), *layers(d)])


MERGED = _after(False, sw.with_merged, hd.merged_lines)
SECTIONS = _after(False, sw.with_sections, _run_titles)
BLOCKS = _after(False, sw.with_blocks, hd.blocks)
CLEAN_SECTIONS = _after(True, sw.with_sections, _run_titles)

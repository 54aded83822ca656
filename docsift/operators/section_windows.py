"""Sections and blocks of texts in long form: a row for each line, and windows over the lines of a document.

A header is carried forward to the lines under it by the last value that isn't null, runs are numbered by running counts,
and pairs of lines that are a header together are islands of neighbouring pairs. So the work grows with the lines, whatever
their number in one document. All windows of a document have one order, so there is one sort; texts are
dealt out by the key before they are cut into lines, so the lines are never shuffled.

Frames have the key, by which rows are dealt out, and ``doc_lines``, an array of lines; rows of one key are told apart by a number
(``row_``) that no shuffle parts from them; every other column goes along with the first
line, each on its own, so that the optimizer leaves out those that nobody asks for. A null or empty array has no sections.
``dealt`` says that rows lie where the key puts them already.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions import headers as hd
from docsift.functions.dialect import Spark

D = Spark()


def _order(key: str):
    return Window.partitionBy(key, "row_").orderBy("pos_")


def _so_far(key: str):
    return _order(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _names(columns: list[str]) -> dict[str, str]:
    """The columns of a frame by the names under which they go along."""
    return {f"row_{k}_": c for k, c in enumerate(columns)}


def _along(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if re.fullmatch(r"row_\d+_", c)]


def _firsts(rows: DataFrame) -> list[Column]:
    return [F.first(c, True).alias(c) for c in _along(rows)]


def long_lines(frame: DataFrame, key: str = "doc_id", dealt: bool = False) -> DataFrame:
    """key, row_, pos_, line_ (stripped) and, with the first line, the whole row as row_0_, row_1_ and so on; one row at least
    for each row."""
    own = _names(frame.columns)
    each = (frame if dealt else frame.repartition(key)).select(F.col(f"`{key}`"), *[F.col(f"`{c}`").alias(k) for k, c in own.items()], "doc_lines", F.monotonically_increasing_id().alias("row_"))
    each = each.select(key, "row_", *own, F.posexplode_outer("doc_lines").alias("pos_", "cut_"))
    pos = F.coalesce("pos_", F.lit(0))
    return each.select(key, "row_", pos.alias("pos_"), F.expr(D.strip("cut_")).alias("line_"), *[F.when(pos == 0, F.col(k)).alias(k) for k in own])


def merge_headers(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The lines with two short ones that are a header only together as one, in the place of the first; of a chain of such
    pairs every other one counts. plain_ is null where a line is too long for a header."""
    w, along = _order(key), _along(lines)
    word = f"length(line_) <= 30 AND {D.match('line_', r'^\p{L}+(?: +\p{L}+)?$')}"
    lines = lines.selectExpr("*", f"CASE WHEN length(line_) <= {hd.MAX_CHARS} THEN {hd.plain(D, 'line_')} END AS plain_", f"({word}) AS short_").selectExpr("*", f"{hd.lookup(D, 'plain_', hd.ALIASES)} AS known_")
    lines = lines.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("line_", "plain_", "short_")})
    pair = F.expr(f"short_ AND next_short_ AND known_ IS NULL AND {hd.lookup(D, 'both_', hd.ALIASES)} IS NOT NULL")
    lines = lines.withColumn("both_", F.expr("CASE WHEN short_ AND next_short_ THEN trim(plain_ || ' ' || next_plain_) END")).withColumn("pair_", F.coalesce(pair, F.lit(False)))
    # where the chain of pairs began
    lines = lines.withColumn("apart_", F.coalesce(F.max(F.when(~F.col("pair_"), F.col("pos_"))).over(_so_far(key)), F.lit(-1)))
    lines = lines.withColumn("taken_", F.col("pair_") & ((F.col("pos_") - F.col("apart_")) % 2 == 1))
    lines = lines.withColumn("gone_", F.coalesce(F.lag("taken_").over(w), F.lit(False))).filter(~F.col("gone_"))
    joined = {"line_": "CASE WHEN taken_ THEN line_ || ' ' || next_line_ ELSE line_ END", "plain_": "CASE WHEN taken_ THEN both_ ELSE plain_ END"}
    return lines.select(key, "row_", "pos_", *[F.expr(v).alias(k) for k, v in joined.items()], *along)


def _sorted(kept: Column, *columns: str) -> Column:
    return F.sort_array(F.collect_list(F.when(kept, F.struct("pos_", *columns))))


def section_rows(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The merged lines with run_ (0 before the first header), name_, is_head_, opens_ (a run) and kept_ (a line of the
    run's body). A header of the section that is open changes nothing; a run has at most 500 lines of under 2000 characters,
    blank ones counted, then left out."""
    so_far = _so_far(key)
    # what no list has is no header, whatever the other rules say
    lines = lines.selectExpr("*", f"CASE WHEN {hd.lookup(D, 'plain_', hd.ALIASES)} IS NOT NULL THEN {hd.header(D, 'line_', 'plain_')} END AS head_")
    lines = lines.withColumn("name_", F.last("head_", True).over(so_far)).withColumn("before_", F.lag("name_").over(_order(key)))
    lines = lines.withColumn("opens_", F.expr("head_ IS NOT NULL AND NOT head_ <=> before_"))
    counts = F.expr(f"head_ IS NULL AND name_ IS NOT NULL AND length(line_) < {hd.MAX_LINE}").cast("int")
    lines = lines.withColumns({"run_": F.sum(F.col("opens_").cast("int")).over(so_far), "count_": F.sum(counts).over(so_far), "counts_": counts})
    lines = lines.withColumn("nth_", F.col("count_") - F.last(F.when(F.col("opens_"), F.col("count_")), True).over(so_far))
    return lines.withColumn("kept_", F.expr(f"counts_ = 1 AND nth_ <= {hd.MAX_LINES} AND line_ <> ''"))


def _put_together(runs: DataFrame, key: str, out: str, columns: list[str], joined: bool = False) -> DataFrame:
    """Whole rows again, with {out}_names and {out}_lines: runs of one name together, in the order of their first lines.

    ``runs`` are a row each, with name_, lines_ (of a position and a line) and the row's columns; there are few names, so that
    to look for each among the runs is linear."""
    body = "transform(lines_, x -> x.line_)"
    body = f"CASE WHEN {D.among('name_', hd.BLOCK_JOINED)} AND size(lines_) > 0 THEN array(array_join({body}, ' ')) ELSE {body} END" if joined else body
    runs = runs.withColumn("body_", F.expr(body))
    whole = runs.groupBy(key, "row_").agg(*_firsts(runs), F.sort_array(F.collect_list(F.when(F.col("name_").isNotNull(), F.struct("run_", "name_", "title_", "body_")))).alias("runs_"))
    whole = whole.select(*_back(columns), "runs_", F.expr("filter(runs_, r -> size(r.body_) > 0)").alias("full_"))
    whole = whole.selectExpr("*", f"array_distinct(full_.name_) AS {out}_names")
    return whole.withColumn(f"{out}_lines", F.expr(f"transform({out}_names, s -> flatten(transform(filter(full_, r -> r.name_ = s), r -> r.body_)))"))


def _back(columns: list[str]) -> list[Column]:
    return [F.col(k).alias(c) for k, c in _names(columns).items()]


def _asked(lines: DataFrame, kept: Column) -> DataFrame:
    """Lines that open or fill a section, and the first, with which the row goes."""
    return lines.filter(kept | (F.col("pos_") == 0))


def with_merged(frame: DataFrame, key: str = "doc_id", dealt: bool = False) -> DataFrame:
    """Adds ``merged``, the stripped lines after two-line headers are merged."""
    lines = merge_headers(long_lines(frame, key, dealt), key)
    whole = lines.groupBy(key, "row_").agg(*_firsts(lines), _sorted(F.col("line_").isNotNull(), "line_").alias("found_"))
    return whole.select(*_back(frame.columns), F.expr("transform(found_, x -> x.line_)").alias("merged"))


def with_sections(frame: DataFrame, key: str = "doc_id", dealt: bool = False) -> DataFrame:
    """Adds section_names and section_lines, and of each run run_names, run_titles (its header as it stands), run_lines."""
    lines = _asked(section_rows(merge_headers(long_lines(frame, key, dealt), key), key), F.col("kept_") | F.col("opens_"))
    runs = lines.groupBy(key, "row_", "run_").agg(*_firsts(lines), F.max(F.when(F.col("opens_"), F.col("name_"))).alias("name_"), F.max(F.when(F.col("opens_"), F.col("line_"))).alias("title_"), _sorted(F.col("kept_"), "line_").alias("lines_"))
    out = _put_together(runs, key, "section", frame.columns)
    return out.selectExpr("*", "runs_.name_ AS run_names", "runs_.title_ AS run_titles", "runs_.body_ AS run_lines").drop("runs_", "full_")


def with_blocks(frame: DataFrame, key: str = "doc_id", dealt: bool = False) -> DataFrame:
    """Adds block_names and block_lines: runs of lines under a header, ended by a blank line; in four sections a run is one
    line. A blank line goes on with the section that is open."""
    so_far = _so_far(key)
    lines = long_lines(frame, key, dealt).selectExpr("*", f"{hd.plain(D, 'line_')} AS plain_").selectExpr("*", f"{hd.lookup(D, 'plain_', hd.BLOCK_HEADERS)} AS head_")
    lines = lines.withColumn("mark_", F.expr("coalesce(head_ IS NOT NULL OR line_ = '', false)"))
    lines = lines.withColumns({"name_": F.last("head_", True).over(so_far), "run_": F.sum(F.col("mark_").cast("int")).over(so_far)})
    body = ~F.col("mark_") & F.col("name_").isNotNull() & F.col("line_").isNotNull()
    lines = _asked(lines, F.col("name_").isNotNull())
    runs = lines.groupBy(key, "row_", "run_").agg(*_firsts(lines), F.max(F.when(F.col("mark_"), F.col("name_"))).alias("name_"), F.lit("").alias("title_"), _sorted(body, "line_").alias("lines_"))
    return _put_together(runs, key, "block", frame.columns, joined=True).drop("runs_", "full_")

"""Sections of line-structured texts: header match and forward fill over exploded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header phrase to section.
ALIASES = {
    "summary": "summary", "profile": "summary", "objective": "summary", "career objective": "summary",
    "education": "education", "skills": "skills", "technical skills": "skills",
    "experience": "experience", "professional experience": "experience", "work experience": "experience",
    "projects": "projects", "achievements": "achievements", "certifications": "achievements",
    "languages": "languages", "interests": "interests", "declaration": "declaration",
}
MAX_LINE = 2000
MAX_RUN = 500


def header(line: Column) -> Column:
    """Section that a line opens, else null: at most 60 characters and five words, no end comma or semicolon."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[^a-z0-9\s]", " "), r"\s+", " "))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    fits = (F.length(F.trim(line)) <= 60) & ~F.trim(line).rlike("[,;]$") & (F.regexp_count(plain, F.lit(r"\S+")) <= 5)
    return F.when(fits, F.try_element_at(names, plain))


def section_lines(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section, pos, line of every line under a header; lines before the first header, blank or overlong go."""
    each = texts.select(key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("opens", header(F.col("line")))
    ordered = Window.partitionBy(key).orderBy("pos")
    filled = each.withColumns({"section": F.last("opens", True).over(ordered), "run": F.count("opens").over(ordered)})
    body = filled.filter(F.col("opens").isNull() & F.col("section").isNotNull() & (F.trim("line") != "") & (F.length("line") < MAX_LINE))
    nth = F.row_number().over(Window.partitionBy(key, "run").orderBy("pos"))
    return body.withColumn("nth", nth).filter(F.col("nth") <= MAX_RUN).select(key, "section", "pos", "line")

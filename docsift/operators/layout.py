"""Columns of a page put in line, blocks of lines, and projects recovered from raw lines.

Splitting columns is SQL over an array of lines (see dialect.py). Blocks and recovered projects depend on the lines before
them, so they are Arrow UDFs over a document's array of lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.functions import pandas_udf

from docsift.functions.dialect import WHITE, Spark

# Fixed values
GAP = rf"[{WHITE}]{{6,}}"
LONG_LINE, FIRST_LINES = 60, 100
BULLETS = "•●▪◦►▸■□◆◇-*"
HEADINGS = (
    "skills", "skill", "technical skills", "technical expertise", "education", "educational background", "academic background", "experience", "work experience", "professional experience", "employment",
    "projects", "project", "academic projects", "personal projects", "achievements", "awards", "certifications", "certificates", "languages", "language proficiency", "interests", "hobbies", "activities",
    "summary", "objective", "career objective", "profile", "contact", "contact information", "personal information",
)
CONFIDENCE = {"heading": 0.95, "bullet_group": 0.9, "contact": 0.85, "paragraph": 0.8}
CONTACT = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|\+?\d[\d\s\-]{8,13}\d|https?://\S+|www\.\S+|(?i:linkedin\.com|github\.com)"
NO_PROJECT = ("skills", "education", "experience", "languages", "interests", "hobbies", "certifications", "objective", "summary", "profile", "contact", "phone", "email")
PROJECT_HEADS = ("projects", "project details", "other projects", "academic projects", "personal projects")
RECOVERY_VERBS = ("developed", "built", "created", "made", "implemented", "designed", "engineered")
RECOVERY_WORDS = ("project", "portfolio", "application", "system", "platform", "website", "app")
BLOCK_SCHEMA = "array<struct<type: string, content: array<string>, start_line: int, confidence: double>>"


def _halves(d: Spark, x: str) -> tuple[str, str]:
    """What stands before and after a line's first gap."""
    return d.strip(d.part(x, rf"(?s)^(.*?){GAP}", 1)), d.strip(d.sub(x, rf"(?s)^.*?{GAP}"))


def _filled(d: Spark, a: str) -> str:
    return d.where(a, "z", "z <> ''")


def split_at_gaps(d: Spark, lines: str, two_columns: str) -> list[dict[str, str]]:
    """Layers that end in ``linear``: pages of two columns have the left one first; others, those with gaps in under a
    fifth of their lines, and those that would lose a fifth of their characters stay."""
    left, right = _halves(d, "x")
    gap = d.match("x", GAP)
    whole = d.join_lines(lines)
    return [
        {"full_lines": d.where(lines, "x", f"{d.strip('x')} <> ''")},
        {"left_lines": _filled(d, d.each("full_lines", "x", f"CASE WHEN {gap} THEN {left} ELSE {d.strip('x')} END")), "right_lines": _filled(d, d.each(d.where("full_lines", "x", gap), "x", right)), "n_gaps": d.size(d.where("full_lines", "x", gap))},
        {"one_column": f"{d.join_lines('left_lines')} || CASE WHEN {d.size('left_lines')} > 0 AND {d.size('right_lines')} > 0 THEN chr(10) || chr(10) ELSE '' END || {d.join_lines('right_lines')}"},
        {"kept": f"one_column <> '' AND n_gaps * 5 >= {d.size('full_lines')} AND ({d.size('left_lines')} = 0 OR {d.size('right_lines')} = 0 OR length(one_column) * 5 >= length({whole}) * 4)"},
        {"linear": f"CASE WHEN {two_columns} = 1 AND kept THEN one_column ELSE {whole} END"},
    ]


def split_at_mode(d: Spark, lines: str, layout_type: str) -> list[dict[str, str]]:
    """Layers that end in ``single``: pages of two columns are split near the place where most gaps begin, of equally
    frequent ones the first, else at a line's own gap. The result stays only if it has four fifths as many lines as the
    page has words, else the lines that aren't blank."""
    before = d.part("x", rf"(?s)^(.*?){GAP}", 1)
    third = "CAST(floor(length(x) / 3) AS INT)"
    ok = f"{d.match('x', GAP)} AND length({before}) BETWEEN {third} AND 2 * {third} AND length({_halves(d, 'x')[0]}) > 10 AND length({_halves(d, 'x')[1]}) > 10"
    near = "substr(x, mode_at - 2, 13)"
    near_start = f"(mode_at - 3 + length({d.part(near, rf'(?s)^(.*?){GAP}', 1)}))"
    near_end = f"({near_start} + length({d.part(near, GAP, 0)}))"
    use_near = f"mode_at IS NOT NULL AND length(x) > mode_at AND {d.match(near, GAP)}"
    use_own = f"{d.match('x', GAP)} AND length(x) >= {LONG_LINE}"
    left = f"CASE WHEN {use_near} THEN {d.strip(f'substr(x, 1, {near_start})')} WHEN {use_own} THEN {_halves(d, 'x')[0]} ELSE {d.strip('x')} END"
    right = f"CASE WHEN {use_near} THEN {d.strip(f'substr(x, {near_end} + 1)')} WHEN {use_own} THEN {_halves(d, 'x')[1]} ELSE '' END"
    often = f"{d.size(d.where('gap_starts', 'q', 'q = p'))}"
    return [
        {"gap_starts": d.each(d.where(d.take(lines, FIRST_LINES), "x", f"length(x) >= {LONG_LINE} AND {ok}"), "x", f"length({before})"), "full_lines": d.where(lines, "x", f"{d.strip('x')} <> ''")},
        {"how_often": d.each("gap_starts", "p", often)},
        {"mode_at": d.least_of(d.each(d.where(d.count_to(d.size("gap_starts")), "i", f"{d.at('how_often', 'i')} = {d.most('how_often')}"), "i", d.at("gap_starts", "i")))},
        {"left_lines": _filled(d, d.each("full_lines", "x", left)), "right_lines": _filled(d, d.each("full_lines", "x", right)), "n_words": d.size(d.flat(d.each(lines, "x", d.words("x"))))},
        {"single": f"CASE WHEN {layout_type} <> 'two-column' THEN {d.join_lines(lines)} WHEN ({d.size('left_lines')} + {d.size('right_lines')}) * 5 < n_words * 4 THEN {d.join_lines('full_lines')} ELSE {d.join_lines('left_lines')} || CASE WHEN {d.size('right_lines')} > 0 THEN chr(10) || chr(10) ELSE '' END || {d.join_lines('right_lines')} END"},
    ]


# The rest works on one document's lines.

_CONTACT = re.compile(CONTACT)


def is_heading(line: str) -> bool:
    """Of a stripped line: a known heading, capitals of four words at most, or a title of three without end mark."""
    words = len(line.split())
    title = line.istitle() and words <= 3 and not line.endswith((".", ",", ";", ":"))
    return 0 < len(line) <= 60 and (line.lower() in HEADINGS or (line.isupper() and words <= 4) or title)


def blocks(lines: list[str]) -> Iterator[dict]:
    """Blocks in order. The next one is looked for as many lines on as the block has, so that a group with blank lines
    inside is followed by some of its own lines again."""
    lines = [x.strip() for x in lines]
    kinds = ["" if not x else "heading" if is_heading(x) else "bullet_group" if x[0] in BULLETS else "contact" if _CONTACT.search(x) else "paragraph" for x in lines]
    i = 0
    while i < len(lines):
        kind, content = kinds[i], [lines[i]]
        rest = range(i + 1, len(lines))
        if not kind:
            i += 1
            continue
        if kind == "heading":
            content += [lines[k] for k in rest[:1] if kinds[k] not in ("", "heading") and lines[k][0] not in BULLETS and len(lines[k].split()) <= 8]
        elif kind == "paragraph":
            for k in rest:
                if kinds[k] in ("", "heading", "bullet_group"):
                    break
                content.append(lines[k])
        else:
            same = (lambda x: x[0] in BULLETS) if kind == "bullet_group" else (lambda x: bool(_CONTACT.search(x)))
            for k in rest:
                if lines[k] and not same(lines[k]):
                    break
                content += [lines[k]] if lines[k] else []
        yield {"type": kind, "content": content, "start_line": i, "confidence": CONFIDENCE[kind]}
        i += len(content)


_COLON = re.compile(r"([^:]+):\s*(.+)")
_BULLET = re.compile(r"[-•●▪◦►▸■□◆◇*]\s*(.+)")


def _any(text: str, words) -> bool:
    return any(w in text for w in words)


def recovered(lines: list[str]) -> Iterator[str]:
    """``name: what it does`` of lines that look like projects: with a colon, bulleted, with a verb and a project word,
    or short before a line with a verb. A name counts once."""
    seen: set[str] = set()
    skip = False
    for i, whole in enumerate(lines):
        line, low = whole.strip(), whole.strip().lower()
        if skip or len(line) < 5 or _any(low, NO_PROJECT):
            skip = False
            continue
        following = lines[i + 1].strip() if i + 1 < len(lines) else ""
        found = next((x for x in _readings(line, low, following) if x[0].lower() not in seen), None)
        if not found:
            continue
        name, told, skip = found
        name = re.sub(r"[:\s]+$", "", re.sub(r"^[-•●▪◦►▸■□◆◇*\s]+", "", name).strip()).strip()
        if name.lower() not in PROJECT_HEADS:
            seen.add(name.lower())
            yield f"{name}: {told}" if told else name


def _readings(line: str, low: str, following: str) -> Iterator[tuple[str, str, bool]]:
    """Name, description and whether the next line belongs to it, of every way to read a line, best first."""
    words = line.split()
    if m := _COLON.match(line):
        name, told = m[1].strip(), m[2].strip()
        if 2 <= len(name.split()) <= 5 and len(told.split()) >= 3:
            yield name, told, False
    if (m := _BULLET.match(line)) and (_any(m[1].lower(), RECOVERY_VERBS) or _any(m[1].lower(), RECOVERY_WORDS)):
        inner = m[1].strip()
        if c := _COLON.match(inner):
            if len(c[1].strip().split()) <= 5:
                yield c[1].strip(), c[2].strip(), False
        elif len(inner.split()) >= 6:
            yield " ".join(inner.split()[:4]), " ".join(inner.split()[4:]), False
    if _any(low, RECOVERY_VERBS) and _any(low, RECOVERY_WORDS) and len(words) >= 5:
        yield " ".join(words[:4]), " ".join(words[4:]), False
    if _any(following.lower(), RECOVERY_VERBS) and len(words) <= 5 and len(following.split()) >= 4:
        yield line, following, True


def register_layout(spark) -> tuple[str, str]:
    """Registers the UDFs of the session and gives their names: an array of lines to blocks, and to recovered projects."""

    @pandas_udf(BLOCK_SCHEMA)
    def of_blocks(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [] if x is None else list(blocks(list(x))))

    @pandas_udf("array<string>")
    def of_recovered(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [] if x is None else list(recovered(list(x))))

    spark.udf.register("docsift_blocks", of_blocks.asNondeterministic())  # never moved into a lambda
    spark.udf.register("docsift_recovered", of_recovered.asNondeterministic())
    return "docsift_blocks", "docsift_recovered"

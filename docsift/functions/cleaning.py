"""Steps of text cleaning as SQL fragments of an engine (see dialect.py); ``CHAIN`` is their order.

A step takes a text as it stands and gives another; null stays null. Lines end at LF unless a step says otherwise.
"""

from __future__ import annotations

from docsift.functions.dialect import WHITE, Spark

# Fixed values
BULLETS = "•●▪◦►▸■□◆◇"
ICONS = r"[\x{f000}-\x{f8ff}]"
LONE_HEADERS = ("EDUCATION", "PROJECTS", "SKILLS", "EXPERIENCE", "PROFILE", "SUMMARY", "LANGUAGES", "ACHIEVEMENTS", "OBJECTIVE", "CERTIFICATIONS", "DECLARATION")
SPACED = r"^(?:[A-Z][\x09-\x0d\x1c-\x20]){3,}[A-Z]$"
LETTERS = r"\b[A-Za-z][\x09-\x0d\x1c-\x20][A-Za-z][\x09-\x0d\x1c-\x20][A-Za-z]"
GLUED = {"My SQL": "MySQL", "Node JS": "NodeJS", "Power BI": "PowerBI"}
WATERMARK = r"(?i)(?:powered by|enhancv\.com)"
DROPPED_ICONS = "\uf0e0\uf095\uf080\uf19d"
DASHES = "–—"
BULLET_GLYPHS = BULLETS + "-*\uf0b7"
URL = r"https?://[^\x09-\x0d\x1c-\x20]+|www\.[^\x09-\x0d\x1c-\x20]+"


def newlines(d: Spark, t: str) -> str:
    """Every CR is a line end of its own, so CRLF gives two."""
    return f"replace({t}, chr(13), chr(10))"


def join_hyphens(d: Spark, t: str) -> str:
    return d.sub(t, r"([A-Za-z])-\n([A-Za-z])", r"\1\2")


def drop_artifacts(d: Spark, t: str) -> str:
    return d.sub(d.sub(t, r"\(cid:[0-9]+\)"), ICONS)


def dash_bullets(d: Spark, t: str) -> str:
    return f"translate({t}, '{BULLETS}', '{'-' * len(BULLETS)}')"


def fold_ascii(d: Spark, t: str) -> str:
    return d.ascii(t)


def close_spaced_headers(d: Spark, t: str) -> str:
    """Strips every line; single capitals that fill it lose their blanks."""
    s = d.strip("x")
    return d.join_lines(d.each(d.lines(t), "x", f"CASE WHEN {d.match(s, SPACED)} THEN replace({s}, ' ', '') ELSE {s} END"))


def glue_addresses(d: Spark, t: str) -> str:
    return d.sub(d.sub(t, f"[{WHITE}]*@[{WHITE}]*", "@"), r"(\.(?:com|in|org|net))([A-Za-z])", r"\1 \2")


def join_headers(d: Spark, t: str) -> str:
    return d.sub(t, rf"(?i)\b(professional|work)[{WHITE}]*\n[{WHITE}]*(experience)\b", r"\1 \2")


def close_letters(d: Spark, t: str) -> str:
    """Only in texts that hold three single letters in a row."""
    closed = d.unspaced(t)
    for spaced, glued in GLUED.items():
        closed = d.sub(closed, r"(?i)\b" + spaced.replace(" ", rf"[{WHITE}]+") + r"\b", glued)
    return f"CASE WHEN {d.match(t, LETTERS)} THEN {closed} ELSE {t} END"


def split_camel(d: Spark, t: str) -> str:
    return d.sub(d.sub(t, r"([a-z])([A-Z])", r"\1 \2"), r"([A-Z]{2,})([A-Z][a-z])", r"\1 \2")


def isolate_headers(d: Spark, t: str) -> str:
    return d.sub(t, rf"(?im)^[ \t]*({'|'.join(LONE_HEADERS)})[ \t]*$", "\n\\1\n")


def split_merged(d: Spark, t: str) -> str:
    return d.sub(t, r"\b([a-z]{3,})([A-Z][a-z]+)\b", r"\1 \2")


def collapse(d: Spark, t: str) -> str:
    return d.sub(d.sub(t, r"[ \t]+", " "), rf"\n[{WHITE}]*\n", "\n")


def pad_sites(d: Spark, t: str) -> str:
    """Without watermarks; site names stand between blanks; stripped."""
    t = d.sub(d.sub(d.sub(t, WATERMARK), r"(github\.com)", r" \1 "), r"(linkedin\.com)", r" \1 ")
    return d.strip(d.sub(t, "(?i)powered by .*"))


#: id to the steps that belong to it.
STEPS = {
    "tx1a": (newlines, join_hyphens), "tx1b": (drop_artifacts,), "tx1c": (dash_bullets,), "tx1d": (fold_ascii,), "tx1e": (close_spaced_headers,), "tx1f": (glue_addresses,),
    "tx1g": (join_headers,), "tx1h": (close_letters,), "tx1i": (split_camel, split_merged), "tx1j": (isolate_headers,), "tx1k": (collapse, pad_sites),
}
CHAIN = (newlines, join_hyphens, drop_artifacts, dash_bullets, fold_ascii, close_spaced_headers, glue_addresses, join_headers, close_letters, split_camel, isolate_headers, split_merged, collapse, pad_sites)


def layers(d: Spark, steps, text: str = "text", out: str = "clean") -> list[dict[str, str]]:
    """One layer a step, which ends in ``out``; an empty or null text is empty."""
    made = [{f"{out}_0": f"coalesce({text}, '')"}]
    made += [{f"{out}_{k + 1}": step(d, f"{out}_{k}")} for k, step in enumerate(steps)]
    return [*made, {out: f"{out}_{len(steps)}"}]


def plain_lines(d: Spark, t: str) -> str:
    """Stripped lines, blanks squeezed, without empty ones."""
    return d.where(d.each(d.split_lines(t), "x", clean_line(d, "x")), "y", "y <> ''")


def clean_line(d: Spark, line: str) -> str:
    return d.sub(d.strip(line), " {2,}", " ")


def alternate(d: Spark, t: str) -> list[dict[str, str]]:
    """TX2 as layers that end in ``clean``: icons go, dashes are hyphens, every bullet and hyphen is one glyph."""
    swapped = f"translate({t}, '{DASHES}\u00a0{DROPPED_ICONS}', '-- ')"
    return [
        {"t1": f"coalesce({swapped}, '')"},
        {"t2": "replace(replace(t1, chr(13) || chr(10), chr(10)), chr(13), chr(10))"},
        {"t3": f"translate(t2, '{BULLET_GLYPHS}', '{'•' * len(BULLET_GLYPHS)}')"},
        {"clean": d.join_lines(plain_lines(d, "t3"))},
    ]


def without_noise(d: Spark, t: str) -> str:
    return d.sub(d.sub(t, URL), r"\n{3,}", "\n\n")


def stripped_lines(d: Spark, t: str) -> str:
    return d.where(d.each(d.split_lines(t), "x", d.strip("x")), "y", "y <> ''")


def is_bullet(d: Spark, line: str) -> str:
    return d.match(d.strip(line), rf"^[{BULLETS}\-*\x{{f0b7}}]")


def is_heading(d: Spark, line: str) -> str:
    """Capitals of at most four words or a title of at most three, up to 60 characters, no full stop, comma or colon."""
    s = d.strip(line)
    return f"({s} <> '' AND length({s}) <= 60 AND NOT {d.match(s, '[.,;:]$')} AND (({d.upper_case(s)} AND {d.n_words(s)} <= 4) OR ({d.title_case(s)} AND {d.n_words(s)} <= 3)))"


def normal_spacing(d: Spark, t: str) -> list[dict[str, str]]:
    """Layers that end in ``spaced``: stripped lines, one empty line for several."""
    keep = f"{d.at('all_lines', 'i')} <> '' OR (i = 1 OR {d.at('all_lines', 'i - 1')} <> '')"
    return [
        {"all_lines": d.each(d.split_lines(f"coalesce({t}, '')"), "x", d.strip("x"))},
        {"spaced": d.join_lines(d.each(d.where(d.count_to(d.size("all_lines")), "i", keep), "k", d.at("all_lines", "k")))},
    ]

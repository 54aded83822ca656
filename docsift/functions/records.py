"""Rules over lines, contacts, education, experience and layout, as SQL fragments of an engine (see dialect.py).

Functions take the engine ``d`` and the SQL of their inputs and give an expression, or layers of named columns where
one value serves several others. Texts are judged as given; a null input gives null unless a rule says otherwise.
"""

from __future__ import annotations

from docsift.functions import wordlists as wl
from docsift.functions.dialect import DuckDB, Spark, flag
from docsift.functions.skills import TECH_TERMS

# Fixed values
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
DOMAIN_TYPOS = {"gamil.com": "gmail.com", "gmial.com": "gmail.com", "gmal.com": "gmail.com", "gmai.com": "gmail.com", "hotmal.com": "hotmail.com", "yaho.com": "yahoo.com", "outlok.com": "outlook.com", "protonmal.com": "protonmail.com", "gamil.co.in": "gmail.co.in"}
MASTER_WORDS = ("master", "m.tech", "mca", "msc", "m.sc")
BACHELOR_WORDS = ("bachelor", "b.tech", "btech", "b.e", "be ", "engineering")
IT_WORDS = ("information technology", "computer engineering", "computer science", "information science", "it", "cs", "cse")
GRADE = r"(?i)(?:cgpa|gpa|cpi)\s*[:\-]?\s*([+-]?\d+(?:[.,]\d+)?)\s*(?:/\s*(10|100)|%)?"
EXPERIENCE_NOISE = r"\b(hackathon|club|committee|volunteer|event|competition|co[- ]?curricular|extra[- ]?curricular|activity|activities)\b"
EXPERIENCE_WORDS = ("intern", "developer", "engineer")
ORGANISATION = r"\b(software|technologies|technology|solutions|systems|services|infotech|company|pvt|private|ltd|llp|inc|corp|labs|studio)\b"
SCREEN_LOCATION_NOISE = r"(?i)\(|\)|software|technologies|solutions|systems|pvt|ltd|inc"
DATE_RANGE = r"(?:\d{1,2}/)?(?:19|20)\d{2}\s*[-–—]\s*(?:\d{1,2}/)?(?:19|20)\d{2}|present"
ROUTES = {
    "languages": wl.COMMON_LANGUAGES,
    "education": ("b.tech", "bachelor", "master", "diploma", "cgpa", "gpa", "percentage", "university", "institute", "school"),
    "projects": ("project", "system", "application", "developed", "implemented", "created", "designed"),
    "experience": ("intern", "experience", "role", "worked", "company", "employment"),
    "achievements": ("achievement", "award", "certificate", "certification", "hackathon"),
}
KNOWN_SECTIONS = ("skills", "education", "experience", "projects", "achievements", "languages", "interests", "summary")

TECH_TOKENS = tuple(sorted({*wl.PROGRAMMING_LANGUAGES, *wl.FRAMEWORKS, *wl.DATABASES, *wl.TOOLS, *TECH_TERMS}))


def strip(d: Spark, t: str) -> str:
    return d.sub(t, r"^\s+|\s+$")


def n_words(d: Spark, t: str) -> str:
    return d.hits(t, r"\S+")


def urls(d: Spark, t: str) -> str:
    return d.found(t, r"(?i)(?:https?://|www\.)\S+")


def years(d: Spark, t: str) -> str:
    return d.found(t, r"\b(?:19|20)\d{2}\b")


def tokens(d: Spark, t: str, stopwords: tuple[str, ...] = (), min_length: int = 2) -> str:
    """Lower-case runs of letters and digits that hold a letter and are no stop words."""
    stop = f" AND NOT ({d.among('w', stopwords)})" if stopwords else ""
    return d.where(d.found(f"lower({t})", "[a-z0-9]+"), "w", f"length(w) >= {min_length} AND {d.match('w', '[a-z]')}{stop}")


def is_noise_line(d: Spark, line: str, stripped: bool = False) -> str:
    s = line if stripped else strip(d, line)
    short_caps = f"({d.match(s, '^[^a-z]*$')} AND {d.match(s, '[A-Z]')} AND {n_words(d, s)} = 1 AND length({s}) <= 5)"
    return f"(length({s}) < 3 OR length({s}) > 200 OR {short_caps} OR {d.match(s, '^[^a-zA-Z0-9]+$')})"


def is_contact_line(d: Spark, line: str) -> str:
    return d.match(line, r"(?i)@|https?://|www\.|\d{7,}")


def is_header_line(d: Spark, line: str, known: tuple[str, ...] = (), stripped: bool = False) -> str:
    """A known header, capitals of at most four words, or a title of at most three without end punctuation."""
    s = line if stripped else strip(d, line)
    capitals = f"({d.match(s, '[A-Z]')} AND NOT {d.match(s, '[a-z]')} AND {n_words(d, s)} <= 4)"
    title = f"({d.match(s, '^[^A-Za-z]*([A-Z][a-z]*[^A-Za-z]+)*[A-Z][a-z]*[^A-Za-z]*$')} AND {n_words(d, s)} <= 3 AND NOT {d.match(s, '[.,;:]$')})"
    is_known = f"{d.among(f'lower({s})', known)} OR " if known else ""
    return f"({s} <> '' AND length({s}) <= 60 AND ({is_known}{capitals} OR {title}))"


def valid_email(d: Spark, t: str) -> str:
    return d.match(t, f"^{EMAIL}$")


def valid_phone(d: Spark, t: str) -> str:
    """10 to 15 digits; exactly 13 after +91."""
    n = f"length({d.sub(t, '[^0-9]')})"
    return f"(CASE WHEN {t} LIKE '+91%' THEN {n} = 13 ELSE {n} BETWEEN 10 AND 15 END)"


def valid_name(d: Spark, t: str, least: int = 2, most: int = 4) -> str:
    return f"({n_words(d, t)} BETWEEN {least} AND {most} AND {d.match(t, r'^[A-Za-z .\x27\-`]+$')})"


def valid_location(d: Spark, t: str, most: int = 7) -> str:
    return f"(length({t}) BETWEEN 1 AND 80 AND {n_words(d, t)} <= {most} AND {d.match(t, '[A-Za-z]')})"


def location_or_null(d: Spark, t: str, stopwords: tuple[str, ...] = ()) -> str:
    """The stripped location; null for brackets, addresses, organisations, over six words and stop words."""
    s = strip(d, t)
    stop = f" OR {d.among(f'lower({s})', stopwords)}" if stopwords else ""
    bad = f"{s} = '' OR {d.match(s, '[()]')} OR {d.match(s, EMAIL)} OR {d.match(s, r'(?i)(?:https?://|www\.|github\.com|linkedin)')} OR {d.match(s, '(?i)' + ORGANISATION)} OR {n_words(d, s)} > 6{stop}"
    return f"CASE WHEN NOT ({bad}) THEN {s} END"


def location_or_unknown(d: Spark, t: str) -> str:
    return f"coalesce(nullif({strip(d, t)}, ''), 'Unknown')"


def screen_location(d: Spark, t: str) -> str:
    s = strip(d, t)
    return f"CASE WHEN {s} <> '' AND NOT {d.match(s, SCREEN_LOCATION_NOISE)} THEN {s} END"


def email_typo(d: Spark, t: str) -> str:
    """What is wrong with the domain, else null."""
    domain = f"lower({d.part(t, '@([^@]*)$', 1)})"
    cases = " ".join(f"WHEN '{k}' THEN 'Email domain typo: ''{k}'' instead of ''{v}'''" for k, v in DOMAIN_TYPOS.items())
    return f"CASE {domain} {cases} END".replace("''", "\\'") if not isinstance(d, DuckDB) else f"CASE {domain} {cases} END"


def phone_typo(d: Spark, t: str) -> str:
    n = f"length({d.sub(t, '[^0-9]')})"
    return f"CASE WHEN {n} BETWEEN 1 AND 9 THEN 'Incomplete phone number: ' || {t} WHEN {n} > 13 THEN 'Excessive digits in phone: ' || {t} END"


def education(d: Spark, text: str) -> list[dict[str, str]]:
    """Layers: degree_type, is_it_candidate, score (0 to 100) of the first grade that fits its scale."""
    value = f"abs(CAST(replace({d.part('m', GRADE, 1)}, ',', '.') AS DOUBLE))"
    scale = d.part("m", GRADE, 2)
    fits = f"{value} > 0 AND CASE {scale} WHEN '10' THEN {value} <= 10 WHEN '100' THEN {value} <= 100 ELSE {value} <= CASE WHEN contains(m, '%') THEN 100 ELSE 10 END END"
    scaled = f"{value} * CASE WHEN {scale} = '10' OR ({scale} = '' AND NOT contains(m, '%')) THEN 10 ELSE 1 END"
    t = f"lower({text})"
    return [
        {"grades": d.where(d.found(text, GRADE), "m", fits)},
        {
            "degree_type": f"CASE WHEN {d.any(t, MASTER_WORDS)} THEN 'master' WHEN {d.any(t, BACHELOR_WORDS)} THEN 'bachelor' WHEN contains({t}, 'diploma') THEN 'diploma' ELSE 'unknown' END",
            "is_it_candidate": flag(d.any(t, IT_WORDS)),
            "score": f"round(coalesce({d.first(d.each('grades', 'm', scaled))}, 0.0D), 2)",
        },
    ]


def clean_experience(d: Spark, lines: str) -> str:
    """Distinct lower-case roles: short lines without sentence marks that name one and no pastime."""
    role = d.sub(d.sub("lower(x)", r"\s+", " "), r"^[ ,.\-]+|[ ,.\-]+$")
    keep = f"{d.any('lower(x)', EXPERIENCE_WORDS)} AND NOT {d.match('lower(x)', EXPERIENCE_NOISE)} AND {n_words(d, 'x')} <= 12 AND NOT {d.match('x', '[.!?]')}"
    return d.distinct(d.each(d.where(lines, "x", keep), "x", role))


def has_internship(d: Spark, lines: str) -> str:
    return flag(f"{d.size(d.where(lines, 'y', "contains(lower(y), 'intern')"))} > 0")


def route(d: Spark, line: str, tech: tuple[str, ...] = TECH_TOKENS, lowered: bool = False) -> str:
    """Section of a line without headers, the first that fits; null for a blank line."""
    t = line if lowered else f"lower({line})"
    cases = "".join(f" WHEN {d.any(t, words)}{f' OR {d.match(t, DATE_RANGE)}' if k == 'projects' else ''} THEN '{k}'" for k, words in ROUTES.items())
    return f"CASE WHEN {strip(d, line)} = '' THEN NULL{cases} WHEN {d.any(t, tech)} THEN 'skills' WHEN {n_words(d, line)} >= 8 THEN 'summary' ELSE 'interests' END"


def section_confidence(d: Spark, lines: str, section: str, out: str) -> list[dict[str, str]]:
    """Layers that end in ``out``: between 0.7 and 1, for length, a known name and even line lengths; null without lines."""
    n = d.size(lines)
    even = f"{d.total(d.each(f'{out}_l', 'x', f'(x - {out}_m) * (x - {out}_m)'))} / {out}_n < 100"
    size = "CASE WHEN {n} >= 10 THEN 15 WHEN {n} >= 5 THEN 10 WHEN {n} >= 2 THEN 5 ELSE 0 END".format(n=n)
    points = f"70 + {size} + {10 if section in KNOWN_SECTIONS else 0} + CASE WHEN {n} >= 3 AND {even} THEN 5 ELSE 0 END"
    return [
        {f"{out}_l": d.each(d.take(lines, 10), "x", "CAST(length(x) AS DOUBLE)")},
        {f"{out}_n": f"nullif({d.size(f'{out}_l')}, 0)"},
        {f"{out}_m": f"{d.total(f'{out}_l')} / {out}_n"},
        {out: f"CASE WHEN {n} > 0 THEN least(1.0D, CAST({points} AS DOUBLE) / 100) END"},
    ]


def columns_by_gap(d: Spark, lines: str) -> list[dict[str, str]]:
    """Layers: layout_type, 'two-column' if half of ten or more long lines among the first 100 have a gap of six
    blanks that begins in their middle third, with over ten characters on both sides."""
    left, right = d.part("x", r"^(.*?)\s{6,}", 1), d.part("x", r"^.*?\s{6,}(.*)$", 1)
    third = "CAST(floor(length(x) / 3) AS INT)"
    gap = f"{d.match('x', r'\s{6,}')} AND length({left}) BETWEEN {third} AND 2 * {third} AND length({strip(d, left)}) > 10 AND length({strip(d, right)}) > 10"
    return [
        {"long_lines": d.where(d.take(lines, 100), "x", "length(x) >= 60")},
        {"gap_lines": d.size(d.where("long_lines", "x", gap)), "valid_lines": d.size("long_lines")},
        {"layout_type": "CASE WHEN valid_lines >= 10 AND gap_lines * 2 >= valid_lines THEN 'two-column' ELSE 'single-column' END"},
    ]


def columns_by_middle(d: Spark, lines: str) -> list[dict[str, str]]:
    """Layers: two_columns, 1 if over 60 % of eight or more lines of 80 characters (a line can count twice) break in
    the middle: a gap of ten blanks there, or two halves of four words, the right one opened by a capital or bullet."""
    half = "CAST(floor(length(x) / 2) AS INT)"
    a, b = "CAST(floor(length(x) / 3) AS INT)", "CAST(floor(2 * length(x) / 3) AS INT)"
    cut = f"({d.match(f'substr(x, {half}, 1)', '[A-Za-z]')} AND {d.match(f'substr(x, {half} + 1, 1)', '[A-Za-z]')})"
    left, right = strip(d, f"substr(x, 1, {half})"), strip(d, f"substr(x, {half} + 1)")
    both = f"length({left}) > 20 AND length({right}) > 20 AND {n_words(d, left)} >= 4 AND {n_words(d, right)} >= 4 AND {d.match(right, '^[A-Z•●▪-]')}"
    gap = d.match(f"substr(x, {a} + 1, {b} - {a})", r"\s{10,}")
    return [
        {"wide_lines": d.where(d.take(lines, 100), "x", "length(x) >= 80"), "all_lines": d.size(lines)},
        {"n_wide": d.size("wide_lines"), "n_cut": d.size(d.where("wide_lines", "x", cut)), "n_gap": d.size(d.where("wide_lines", "x", f"NOT {cut} AND {gap}")), "n_both": d.size(d.where("wide_lines", "x", f"NOT {cut} AND {both}"))},
        {"two_columns": flag("all_lines >= 10 AND n_wide >= 8 AND n_cut * 10 <= n_wide * 3 AND (n_gap + n_both) * 10 > n_wide * 6")},
    ]

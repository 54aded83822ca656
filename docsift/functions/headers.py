"""Headers and sections of a text as SQL fragments of an engine (see dialect.py), without leaving the row.

``sections`` gives the section names in the order of their first content and, in step with them, arrays of lines.
"""

from __future__ import annotations

from docsift.functions.dialect import WHITE, Spark

# Fixed values; a phrase in two sections belongs to the later one
PHRASES = {
    "career_objective": ("career objective", "objective", "professional objective", "career summary", "profile", "professional profile", "summary", "professional summary", "about me", "about", "introduction", "overview", "personal statement"),
    "education": ("education", "educational background", "educational qualifications", "educational details", "academic background", "academic qualifications", "academic details", "academic history", "qualifications", "professional qualifications", "course", "courses", "education and training", "academic record", "scholastic record", "degrees"),
    "skills": ("skills", "technical skills", "technical expertise", "core competencies", "core skills", "key skills", "it skills", "tech skills", "areas of expertise", "competencies", "expertise", "technologies", "technologies known", "tools and technologies", "programming skills", "software skills", "technical proficiencies"),
    "experience": ("experience", "work experience", "professional experience", "employment history", "employment", "professional background", "work history", "career history", "internships", "internship experience", "industrial experience", "industrial training", "training", "job experience", "relevant experience", "practical experience"),
    "projects": ("projects", "academic projects", "academic project", "personal projects", "major projects", "mini projects", "technical projects", "project work", "project experience", "key projects", "notable projects", "software projects", "live projects", "recent projects"),
    "achievements": ("achievements", "achivements", "awards", "awards and achievements", "honors", "honours", "accomplishments", "recognition", "certifications", "certificates", "certification", "certificate", "courses", "online courses", "workshops", "seminars", "extra curricular activities", "extracurricular activities", "co curricular activities", "activities", "competitions", "hackathons"),
    "languages": ("languages", "known languages", "languages known", "language proficiency", "language skills"),
    "interests": ("interests", "hobbies", "hobbies and interests", "personal interests"),
    "declaration": ("declaration", "i hereby declare"),
}
MORE_PHRASES = {
    "my skills": "skills", "skill set": "skills", "skillset": "skills", "work": "experience", "jobs": "experience", "career": "experience", "academic": "education", "schooling": "education",
    "my projects": "projects", "other projects": "projects", "extra curricular": "achievements", "co curricular": "achievements", "courses and certifications": "achievements", "certifications and awards": "achievements",
    "career goal": "career_objective", "career goals": "career_objective", "personal profile": "career_objective", "language": "languages",
}
BLOCK_HEADERS = {
    "skills": "skills", "technical skills": "skills", "education": "education", "academic details": "education", "projects": "projects", "project": "projects", "experience": "experience", "work experience": "experience",
    "languages": "languages", "language": "languages", "summary": "summary", "objective": "summary", "career objective": "summary", "interests": "interests", "hobbies": "interests", "achievements": "achievements", "certifications": "achievements",
}
BLOCK_JOINED = ("projects", "education", "experience", "achievements")
RENAMED = {"career_objective": "summary", "objective": "summary", "profile": "summary", "certifications": "achievements", "certification": "achievements"}
MAX_CHARS, MAX_WORDS, MAX_LINES, MAX_LINE = 60, 5, 500, 2000

ALIASES = {phrase: section for section, phrases in PHRASES.items() for phrase in phrases} | MORE_PHRASES


def plain(d: Spark, x: str) -> str:
    """Lower-case letters and digits, one blank between runs of them."""
    return d.strip(d.sub(f"lower({x})", "[^a-z0-9]+", " "))


def lookup(d: Spark, x: str, names: dict[str, str]) -> str:
    by_name: dict[str, list[str]] = {}
    for phrase, name in names.items():
        by_name.setdefault(name, []).append(phrase)
    return "CASE " + " ".join(f"WHEN {d.among(x, phrases)} THEN '{name}'" for name, phrases in by_name.items()) + " END"


def _numbers(d: Spark, a: str) -> str:
    return d.count_to(d.size(a))


def merged_lines(d: Spark) -> list[dict[str, str]]:
    """Layers from ``doc_lines`` to ``merged``: two short lines of letters that are a header only together are one;
    of a chain of such pairs every other one counts."""
    word = f"length(x) <= 30 AND {d.match('x', r'^\p{L}+(?: +\p{L}+)?$')}"
    pair = f"{d.at('short', 'i')} AND {d.at('short', 'i + 1')} AND {d.at('known', 'i')} IS NULL AND {lookup(d, 'trim(' + d.at('plains', 'i') + " || ' ' || " + d.at('plains', 'i + 1') + ')', ALIASES)} IS NOT NULL"
    merge = f"CASE WHEN {d.item_in('i', 'taken')} THEN {d.at('lines', 'i')} || ' ' || {d.at('lines', 'i + 1')} ELSE {d.at('lines', 'i')} END"
    return [
        {"lines": d.each("doc_lines", "x", d.strip("x"))},
        {"plains": d.each("lines", "x", plain(d, "x")), "short": d.each("lines", "x", f"({word})")},
        {"known": d.each("plains", "x", lookup(d, "x", ALIASES))},
        {"pairs": d.where(_numbers(d, "lines"), "i", pair)},
        {"firsts": d.where("pairs", "i", f"NOT {d.item_in('i - 1', 'pairs')}")},
        {"taken": d.where("pairs", "i", f"(i - {d.most(d.where('firsts', 's', 's <= i'))}) % 2 = 0")},
        {"merged": d.each(d.where(_numbers(d, "lines"), "i", f"NOT {d.item_in('i - 1', 'taken')}"), "i", merge)},
    ]


def header(d: Spark, x: str, plain_x: str | None = None) -> str:
    """Section that a stripped line opens, else null."""
    p = plain_x or plain(d, x)
    return f"CASE WHEN length({x}) <= {MAX_CHARS} AND NOT {d.match(x, '[,;]$')} AND {d.n_words(p)} <= {MAX_WORDS} THEN {lookup(d, p, ALIASES)} END"


def grouped(d: Spark, names: str, bodies: str, out: str) -> list[dict[str, str]]:
    """Layers {out}_names, {out}_lines: runs of one name put together, in the order of their first lines."""
    same = f"{d.at(names, 'k')} = s"
    return [
        {f"{out}_kept": d.where(_numbers(d, names), "k", f"{d.size(d.at(bodies, 'k'))} > 0")},
        {f"{out}_every": d.each(f"{out}_kept", "k", d.at(names, "k"))},
        {f"{out}_firsts": d.where(_numbers(d, f"{out}_every"), "k", f"NOT {d.item_in(d.at(f'{out}_every', 'k'), d.span(f'{out}_every', '1', 'k - 1'))}")},
        {f"{out}_names": d.each(f"{out}_firsts", "k", d.at(f"{out}_every", "k"))},
        {f"{out}_lines": d.each(f"{out}_names", "s", d.flat(d.each(d.where(f"{out}_kept", "k", same), "k", d.at(bodies, "k"))))},
    ]


def sections(d: Spark) -> list[dict[str, str]]:
    """Layers from ``doc_lines`` to section_names, section_lines. A header of the section that is open changes nothing; a
    run has at most 500 lines of under 2000 characters, blank ones counted, then left out."""
    inside = d.span("numbers_", f"{d.at('opened', 'k')} + 1", f"coalesce({d.at('opened', 'k + 1')}, {d.size('merged')} + 1) - {d.at('opened', 'k')} - 1")
    body = d.take(d.where(inside, "i", f"{d.at('keys', 'i')} IS NULL AND length({d.at('merged', 'i')}) < {MAX_LINE}"), MAX_LINES)
    return [
        *merged_lines(d),
        {"merged_plains": d.each("merged", "x", plain(d, "x")), "numbers_": _numbers(d, "merged")},
        {"keys": d.each("numbers_", "i", header(d, d.at("merged", "i"), d.at("merged_plains", "i")))},
        {"headed": d.where("numbers_", "i", f"{d.at('keys', 'i')} IS NOT NULL")},
        {"opened": d.each(d.where(_numbers(d, "headed"), "k", f"k = 1 OR {d.at('keys', d.at('headed', 'k'))} <> {d.at('keys', d.at('headed', 'k - 1'))}"), "k", d.at("headed", "k"))},
        {"run_names": d.each("opened", "i", d.at("keys", "i")), "run_lines": d.each(_numbers(d, "opened"), "k", d.where(d.each(body, "i", d.at("merged", "i")), "y", "y <> ''"))},
        *grouped(d, "run_names", "run_lines", "section"),
    ]


def canonical(d: Spark, out: str = "canon") -> list[dict[str, str]]:
    """Layers {out}_names, {out}_lines: renamed sections; of two with one name the later one's lines stay, in the
    place of the first. Empty lines and sections go."""
    rename = "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items()) + " ELSE s END"
    filled = d.each("section_lines", "l", d.where("l", "y", "y <> ''"))
    last = d.most(d.where(_numbers(d, f"{out}_every"), "k", f"{d.at(f'{out}_every', 'k')} = s AND {d.size(d.at(f'{out}_full', 'k'))} > 0"))
    return [
        {f"{out}_every": d.each("section_names", "s", rename), f"{out}_full": filled},
        {f"{out}_firsts": d.where(_numbers(d, f"{out}_every"), "k", f"{d.size(d.at(f'{out}_full', 'k'))} > 0 AND NOT {d.item_in(d.at(f'{out}_every', 'k'), d.span(f'{out}_every', '1', 'k - 1'))}")},
        {f"{out}_names": d.each(f"{out}_firsts", "k", d.at(f"{out}_every", "k"))},
        {f"{out}_lines": d.each(f"{out}_names", "s", d.at(f"{out}_full", last))},
    ]


def lines_of(d: Spark, name: str, of: str = "canon") -> str:
    """Lines of a section; empty if it isn't there."""
    at = d.least_of(d.where(_numbers(d, f"{of}_names"), "k", f"{d.at(f'{of}_names', 'k')} = '{name}'"))
    return f"coalesce({d.at(f'{of}_lines', at)}, {d.empty()})"


def blocks(d: Spark) -> list[dict[str, str]]:
    """Layers from ``doc_lines`` to block_names, block_lines: runs of lines under a header, ended by a blank line;
    in four sections a run is one line."""
    inside = d.span("lines", f"{d.at('marks', 'k')} + 1", f"coalesce({d.at('marks', 'k + 1')}, {d.size('lines')} + 1) - {d.at('marks', 'k')} - 1")
    joined = f"CASE WHEN {d.among(d.at('mark_names', 'k'), BLOCK_JOINED)} AND {d.size(d.at('mark_lines', 'k'))} > 0 THEN {d.array(d.join(d.at('mark_lines', 'k')))} ELSE {d.at('mark_lines', 'k')} END"
    return [
        {"lines": d.each("doc_lines", "x", d.strip("x"))},
        {"heads": d.each("lines", "x", lookup(d, plain(d, "x"), BLOCK_HEADERS))},
        # a mark is a header, or a blank line, which goes on with the section that is open
        {"marks": d.where(_numbers(d, "lines"), "i", f"{d.at('heads', 'i')} IS NOT NULL OR {d.at('lines', 'i')} = ''")},
        {"mark_heads": d.each("marks", "i", d.at("heads", "i"))},
        {"mark_heads_at": d.where(_numbers(d, "mark_heads"), "k", f"{d.at('mark_heads', 'k')} IS NOT NULL")},
        {"mark_names": d.each(_numbers(d, "marks"), "k", d.at("mark_heads", d.most(d.where("mark_heads_at", "m", "m <= k")))), "mark_lines": d.each(_numbers(d, "marks"), "k", inside)},
        {"mark_bodies": d.each(_numbers(d, "marks"), "k", f"CASE WHEN {d.at('mark_names', 'k')} IS NULL THEN {d.empty()} ELSE {joined} END")},
        *grouped(d, "mark_names", "mark_bodies", "block"),
    ]


def shown(d: Spark, of: str) -> str:
    """name: line / line of every section, one section a line."""
    return d.join_lines(d.each(d.count_to(d.size(f"{of}_names")), "k", f"{d.at(f'{of}_names', 'k')} || ': ' || {d.join(d.at(f'{of}_lines', 'k'), ' / ')}"))

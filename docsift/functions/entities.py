"""Names, numbers, addresses and places of a text as SQL fragments of an engine (see dialect.py).

Functions give layers of named columns over ``text`` (never null) and ``doc_lines``, its lines as they stand. Where
several places or words fit a line, the first in the line counts, of equals the first by alphabet.
"""

from __future__ import annotations

from docsift.functions.dialect import WHITE, Spark

# Fixed values
ROLE_WORDS = (
    "developer", "engineer", "designer", "manager", "analyst", "architect", "consultant", "specialist", "lead", "head", "director", "officer", "executive", "coordinator",
    "bachelor", "b.tech", "btech", "b.e", "be", "bca", "b.c.a", "bsc", "b.sc", "master", "m.tech", "mtech", "mca", "m.c.a", "msc", "m.sc", "mba", "phd", "diploma", "pgdca",
    "institute", "university", "college", "polytechnic", "school", "academy", "resume", "curriculum", "vitae", "cv", "profile", "summary", "objective",
    "fullstack", "full-stack", "frontend", "front-end", "backend", "back-end", "devops", "intern", "student", "fresher", "graduate",
    "technologies", "solutions", "systems", "services", "ltd", "limited", "pvt", "private", "inc", "corp",
)
COMMON_HEADERS = (
    "summary", "profile", "objective", "resume", "curriculum vitae", "career objective", "technical skills", "soft skills", "core competencies", "work experience",
    "employment history", "academic background", "qualifications", "professional objective", "professional", "experience", "education", "projects", "strengths", "skills",
)
PLACES = ("india", "gujarat", "maharashtra", "delhi", "bangalore", "hyderabad", "pune", "mumbai", "ahmedabad", "surat", "vadodara", "anand", "khambhat", "limdi", "rajkot", "gandhinagar", "bharuch")
CITIES = (
    "mumbai", "delhi", "bangalore", "bengaluru", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad", "surat", "jaipur", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal", "visakhapatnam",
    "patna", "vadodara", "ghaziabad", "ludhiana", "agra", "nashik", "faridabad", "meerut", "rajkot", "varanasi", "srinagar", "aurangabad", "dhanbad", "amritsar", "navi mumbai", "allahabad", "ranchi",
    "howrah", "coimbatore", "vijayawada", "jodhpur", "madurai", "raipur", "kota", "guwahati", "chandigarh", "thiruvananthapuram", "solapur", "hubli", "mysore", "tiruchirappalli", "bareilly", "aligarh",
    "tiruppur", "gurgaon", "moradabad", "jalandhar", "bhubaneswar", "salem", "warangal", "guntur", "bhiwandi", "saharanpur", "gorakhpur", "bikaner", "noida", "bhilai", "jamshedpur", "cuttack", "kochi", "dehradun",
)
PROJECT_WORDS = ("project", "developed", "built", "created", "using")
NOT_NAMES = ("participated", "bachelor", "master", "degree", "course", "project", "home", "service", "provider", "team", "coll")
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE_A = rf"\+?[0-9][0-9{WHITE}\-.]{{8,15}}[0-9]"
PHONE_B = rf"\+?[0-9][0-9{WHITE}\-]{{8,13}}[0-9]"
NAME_CHARS = r"[A-Za-z .\x27\-`]+"
CAPS_CHARS = r"[A-Z .\x27\-`]+"
FULL_NAME = rf"([A-Z][a-z]+(?:[{WHITE}]+[A-Z][a-z]+)+)"
ANY_NAME = rf"([A-Za-z][A-Za-z]+(?:[{WHITE}]+[A-Za-z][A-Za-z]+)+)"
URL_WORDS = ("portfolio", "personal", "website", "blog")
ORGANISATION = r"(?i)\b(?:software|technologies|technology|solutions|systems|services|infotech|company|pvt|private|ltd|llp|inc|corp|labs|studio)\b"
SITE = r"(?i)(?:https?://|www\.|github\.com|linkedin)"


def clean_line(d: Spark, x: str) -> str:
    return d.sub(d.strip(x), " {2,}", " ")


def or_null(d: Spark, t: str) -> str:
    return f"nullif({t}, '')"


def found_part(d: Spark, t: str, p: str, group: int = 1) -> str:
    return f"nullif({d.part(t, p, group)}, '')"


def _tokens_of(words) -> str:
    """A pattern of one of the words between white space."""
    return rf"(?:^|[{WHITE}])(?:{'|'.join(w.replace('.', r'\.').replace('-', r'\-') for w in words)})(?:$|[{WHITE}])"


def _contains_any(d: Spark, x: str, words) -> str:
    return d.any(x, words)


def lines_layer(d: Spark, t: str = "text") -> list[dict[str, str]]:
    return [{"raw": f"coalesce({t}, '')"}, {"doc_lines": d.split_lines("raw")}]


def email_first(d: Spark) -> list[dict[str, str]]:
    return [{"email": f"lower({found_part(d, 'raw', EMAIL, 0)})"}]


def phone_first(d: Spark) -> list[dict[str, str]]:
    """The first of 10 to 13 digits, with the + that it began with."""
    digits = d.sub("x", "[^0-9]")
    return [
        {"numbers": d.where(d.found("raw", PHONE_A), "x", f"length({digits}) BETWEEN 10 AND 13")},
        {"number": d.first("numbers")},
        {"phone": f"CASE WHEN number LIKE '+%' THEN '+' ELSE '' END || {d.sub('number', '[^0-9]')}"},
    ]


def name_first(d: Spark) -> list[dict[str, str]]:
    """Layers that end in ``name``: capitals among the first three lines, a plain name among eight, a labelled one,
    'I am', capitals among twenty."""
    short = f"{d.n_words('x')} BETWEEN 2 AND 4"
    no_role = f"NOT {d.match('lower(x)', _tokens_of(ROLE_WORDS))}"
    capitals = f"{d.upper_case('x')} AND {short} AND {d.match('x', f'^{CAPS_CHARS}$')} AND {no_role}"
    plain = (
        f"x <> '' AND length(x) <= 50 AND NOT {d.among('lower(x)', COMMON_HEADERS)} AND NOT {d.match('x', '[@0-9]')} AND NOT {d.any('lower(x)', ('http', '.com', '.in'))}"
        f" AND {no_role} AND NOT {d.any('lower(x)', PROJECT_WORDS)} AND {short} AND {d.match('x', f'^{NAME_CHARS}$')}"
    )
    late = f"{d.upper_case('x')} AND {short} AND {d.match('x', f'^{CAPS_CHARS}$')} AND length(x) >= 5"
    return [
        {"head": d.each(d.take("doc_lines", 20), "x", clean_line(d, "x"))},
        {
            "capital_name": d.squeeze(d.first(d.where(d.take("head", 3), "x", capitals))),
            "plain_name": d.squeeze(d.first(d.where(d.take("head", 8), "x", plain))),
            "label_name": found_part(d, "raw", rf"(?i)(?:name|candidate|applicant)[{WHITE}]*[:\-]?[{WHITE}]*" + ANY_NAME),
            "told_name": found_part(d, "raw", rf"(?:I am|I\x27m)[{WHITE}]+" + FULL_NAME),
            "late_name": d.first(d.where("head", "x", late)),
        },
        {"name": f"coalesce(capital_name, plain_name, label_name, told_name, {d.to_title('late_name')})"},
    ]


def place_line(d: Spark, x: str) -> str:
    """A line without addresses, numbers and end punctuation."""
    s = d.sub(d.strip(x), rf"[^{WHITE}]+@[^{WHITE}]+")
    s = d.sub(s, rf"\+?[0-9][0-9{WHITE}\-]{{7,}}")
    s = d.squeeze(d.sub(s, rf"(?:https?://|www\.)[^{WHITE}]+"))
    return d.sub(s, "[,.;:]+$")


def place_first(d: Spark) -> list[dict[str, str]]:
    """Layers that end in ``location``: of the first fifty lines the first with a known place that is short once
    cleaned, else the first place named in them."""
    fits = f"x <> '' AND length(x) <= 80 AND {d.n_words('x')} <= 7 AND {d.match('x', r'[\p{L}]')}"
    return [
        {"place_lines": d.where(d.take("doc_lines", 50), "x", d.any_word("lower(x)", PLACES))},
        {"clean_places": d.each("place_lines", "x", place_line(d, "x"))},
        {"place": d.first(d.where("clean_places", "x", fits)), "named": d.part(f"lower(coalesce({d.first('place_lines')}, ''))", d.word_pattern(PLACES), 1)},
        {"location": f"coalesce(place, {d.to_title(or_null(d, 'named'))})"},
    ]


def entities_a(d: Spark) -> list[dict[str, str]]:
    """name, email, phone, location, and confidence: 25 for each that is there."""
    there = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 25 ELSE 0 END" for c in ("name", "email", "phone", "location"))
    return [*lines_layer(d), *email_first(d), *phone_first(d), *name_first(d), *place_first(d), {"confidence": there}]


def entities_detailed(d: Spark) -> list[dict[str, str]]:
    """The same over the text in lower case on one line, with its length and number of lines."""
    flat = d.squeeze("lower(coalesce(text, ''))")
    return [{"flat": flat}, *lines_layer(d, "flat"), *entities_a(d)[2:], {"text_length": "CAST(length(flat) AS INT)", "line_count": d.size("doc_lines")}]


def entities_b(d: Spark) -> list[dict[str, str]]:
    """name, email, phone, location, linkedin, github, portfolio by the second set of rules."""
    bare = d.sub("x", r"[ \-]")
    good = f"({bare} LIKE '+91%' AND length({bare}) = 13) OR length({bare}) = 10"
    label = rf"(?i)(?:name|candidate|applicant)[{WHITE}]*[:\-]?[{WHITE}]*" + ANY_NAME
    plain = d.part("x", "^" + FULL_NAME, 1)
    named = f"CASE WHEN {d.n_words(plain)} BETWEEN 2 AND 4 THEN {plain} ELSE {d.part('x', label, 1)} END"
    city = lambda t: found_part(d, f"lower({t})", d.word_pattern(CITIES))
    told = (rf"(?i)(?:I am|I\x27m)[{WHITE}]+" + ANY_NAME, rf"(?i)(?:My name is|This is)[{WHITE}]+" + ANY_NAME, rf"(?i)(?:candidate|applicant)[{WHITE}]*(?:name)?[{WHITE}]*[:\-]?[{WHITE}]*" + ANY_NAME)
    site = f"{d.any('lower(x)', URL_WORDS)} AND NOT {d.any('lower(x)', ('linkedin', 'github'))}"
    return [
        *lines_layer(d),
        {"numbers": d.found("raw", PHONE_B), "top": d.each(d.take("doc_lines", 10), "x", d.strip("x"))},
        {
            "email": found_part(d, "raw", EMAIL, 0),
            "phone": f"coalesce({d.first(d.where('numbers', 'x', good))}, {d.first('numbers')})",
            "linkedin": f"'https://' || {found_part(d, 'raw', r'(?i)linkedin\.com/in/[A-Za-z0-9\-_]+', 0)}",
            "github": f"'https://' || {found_part(d, 'raw', r'(?i)github\.com/[A-Za-z0-9\-_]+', 0)}",
            "site": d.first(d.where(d.found("raw", rf"(?:https?://|www\.)[^{WHITE}]+"), "x", site)),
            "city": f"coalesce({city(d.join(d.take('doc_lines', 10)))}, {city('raw')})",
            "top_names": d.where(d.each(d.where("top", "x", f"x <> '' AND NOT {d.match('x', EMAIL)} AND NOT {d.match('x', PHONE_B)}"), "x", named), "y", "y <> ''"),
        },
        {
            "name": f"coalesce({d.first('top_names')}, {', '.join(found_part(d, 'raw', p) for p in told)})",
            "location": d.to_title("city"),
            "portfolio": "CASE WHEN site LIKE 'http%' THEN site ELSE 'https://' || site END",
        },
    ]


def section_name(d: Spark, lines: str) -> str:
    """The first of some lines that could be a name: two to four words of letters, no bullet, none of NOT_NAMES."""
    fits = (
        f"x <> '' AND length(x) <= 50 AND NOT {d.match('x', r'[@\p{Nd}]')} AND {d.n_words('x')} BETWEEN 2 AND 4"
        f" AND {d.match('x', rf'^[\p{{L}}\x27\-`{WHITE}]+$')} AND NOT {d.match('x', rf'(?:^|[{WHITE}])[\x27\-`]+(?:$|[{WHITE}])')} AND NOT {d.match('x', '^[•-]')} AND NOT {d.any('lower(x)', NOT_NAMES)}"
    )
    return d.first(d.where(d.each(lines, "x", d.strip("x")), "x", fits))


def identity_place(d: Spark, x: str) -> str:
    """Null for brackets, addresses, organisations, over six words and known places, which count as noise here."""
    s = d.strip(x)
    bad = f"{s} = '' OR {d.match(s, '[()]')} OR {d.match(s, EMAIL)} OR {d.match(s, SITE)} OR {d.match(s, ORGANISATION)} OR {d.n_words(s)} > 6 OR {d.among(f'lower({s})', PLACES)}"
    return f"CASE WHEN NOT ({bad}) THEN {s} END"


def window_at(t: str, position: str, size: int) -> tuple[str, str]:
    """Up to ``size`` characters before a position (from 0 on) and from it on."""
    start = f"greatest(0, {position} - {size})"
    return f"substr({t}, {start} + 1, {position} - {start})", f"substr({t}, {position} + 1, {size})"


def contexts(d: Spark, t: str, word: str, size: int) -> list[dict[str, str]]:
    """Layers that end in ``contexts``: before, match and after of every match, the texts around cut to ``size``."""
    chars = lambda a, n: f"CAST({d.total(d.each(d.span(a, '1', n), 'x', 'CAST(length(x) AS DOUBLE)'))} AS INT)"
    before, _ = window_at(t, d.at("starts", "i"), size)
    _, after = window_at(t, f"({d.at('starts', 'i')} + length({d.at('hits', 'i')}))", size)
    return [
        {"parts": d.split(t, f"(?i){word}"), "hits": d.found(t, f"(?i){word}")},
        {"starts": d.each(d.count_to(d.size("hits")), "i", f"{chars('parts', 'i')} + {chars('hits', 'i - 1')}")},
        {"contexts": d.each(d.count_to(d.size("hits")), "i", f"{before} || '|' || {d.at('hits', 'i')} || '|' || {after}")},
    ]

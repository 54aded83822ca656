"""Skills of texts and lines, as SQL fragments of an engine (see dialect.py), and the close match of misspelt ones.

The close match has no SQL form: ``close_skills`` is an Arrow UDF over a document's array of tokens, with a bounded memory
of tokens already looked up. Everything around it is columns.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql.functions import pandas_udf

from docsift.functions import wordlists as wl
from docsift.functions.dialect import WHITE, DuckDB, Spark
from docsift.functions.entities import or_null
from docsift.operators.close_match import bigrams, longest

# Fixed values
TECH_TERMS = (
    "aws", "azure", "gcp", "docker", "kubernetes", "terraform", "ansible", "jenkins", "github actions", "gitlab ci", "circleci", "heroku", "netlify", "vercel", "nginx", "apache", "linux", "ubuntu", "centos", "bash", "shell", "git", "github", "gitlab",
    "ci/cd", "helm", "prometheus", "grafana", "elasticsearch", "kibana", "logstash", "rabbitmq", "celery", "redis", "tensorflow", "pytorch", "keras", "scikit-learn", "sklearn", "pandas", "numpy", "scipy", "matplotlib", "seaborn", "plotly", "jupyter",
    "spark", "hadoop", "kafka", "airflow", "dbt", "tableau", "powerbi", "mlflow", "huggingface", "langchain", "openai", "llm", "penetration testing", "ethical hacking", "burp suite", "metasploit", "wireshark", "nmap", "kali linux", "owasp", "ssl",
    "tls", "jwt", "oauth", "oauth2", "xss", "sql injection", "ssrf", "csrf", "react", "angular", "vue", "svelte", "nextjs", "next.js", "nuxtjs", "nuxt.js", "nodejs", "node.js", "express", "django", "flask", "fastapi", "spring", "spring boot", "laravel",
    "bootstrap", "tailwind", "jquery", "html", "css", "sass", "typescript", "graphql", "rest api", "restful", "flutter", "android", "ios", "react native", "kotlin", "swift", "dart", "android studio", "xcode", "firebase", "mysql", "postgresql", "sqlite",
    "mongodb", "oracle", "sql server", "mariadb", "cassandra", "dynamodb", "supabase", "neo4j", "data structures", "algorithms", "oop", "object oriented", "design patterns", "system design", "microservices", "api", "rest", "json", "xml", "yaml",
    "unit testing", "selenium", "jest", "pytest", "junit", "postman", "swagger", "tdd", "bdd",
)
SCANNED_TOO = ("machine learning", "deep learning", "computer vision", "scnn")
NOISE = ("soft skills", "teamwork", "communication", "problem-solving")
BREAKS = r"[,\n|;&/•●▪◦►▸■□◆◇\-*]"
ENRICHING = ("deep learning", "computer vision", "machine learning")
OTHER_NAMES = ("technical skills", "core competencies", "technical expertise", "skills & abilities", "competencies")
CUTOFF = 0.88
LEAST_LENGTH = 4
SCREEN_ALIASES = {"js": "javascript", "node js": "nodejs", "mongo db": "mongodb"}
SCREEN_HINTS = ("python", "java", "javascript", "nodejs", "mongodb", "mysql", "sql", "html", "css", "react", "angular", "express", "pandas", "matplotlib", "firebase", "php", "deep learning", "computer vision", "scnn")

WHITELIST = tuple(sorted({*wl.PROGRAMMING_LANGUAGES, *wl.FRAMEWORKS, *wl.DATABASES, *wl.TOOLS, *TECH_TERMS}))
SCANNED = tuple(sorted({*WHITELIST, *SCANNED_TOO}))
#: Tokens whose close match a worker remembers.
REMEMBERED = 100_000


@lru_cache(8)
def _by_bigram(names: tuple[str, ...]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in names:
        for gram in bigrams(name):
            out.setdefault(gram, []).append(name)
    return out


def close_candidates(token: str, names: tuple[str, ...], cutoff: float) -> list[str]:
    """Names that can reach the cutoff: twice the shorter length over both lengths bounds the ratio, and such strings share
    bigrams (see close_match.py); where that bound asks for none, the lengths alone decide."""
    n = len(token)
    near = lambda w: 2 * min(n, len(w)) >= cutoff * (n + len(w))
    if (1.5 * cutoff - 1) * n - 1 <= 0:
        return [w for w in names if near(w)]
    common = Counter(chain.from_iterable(_by_bigram(names).get(g, ()) for g in bigrams(token)))
    return [w for w, c in common.items() if near(w) and c >= (1.5 * cutoff - 1) * (n + len(w)) - 1 - 1e-9]


@lru_cache(REMEMBERED)
def close_skill(token: str, cutoff: float = CUTOFF) -> str | None:
    """The skill most like a token, at least by ``cutoff`` of the Ratcliff-Obershelp ratio; of equals the last by name."""
    found = difflib.get_close_matches(token, close_candidates(token, WHITELIST, cutoff), n=1, cutoff=cutoff)
    return found[0] if found else None


def register_close_skills(spark, cutoff: float = CUTOFF) -> str:
    """Registers the UDF of the session and gives its name: an array of tokens to an array of skills or nulls."""
    # longer tokens match nothing and aren't remembered
    known, most = frozenset(WHITELIST), longest(WHITELIST, cutoff)

    @pandas_udf("array<string>")
    def close_skills(tokens: pd.Series) -> pd.Series:
        one = lambda t: t if t in known else close_skill(t, cutoff) if LEAST_LENGTH <= len(t) <= most else None
        return tokens.map(lambda ts: None if ts is None else [one(t) for t in ts])

    spark.udf.register("docsift_close_skills", close_skills.asNondeterministic())  # never moved into a lambda
    return "docsift_close_skills"


def exact_skills(d: Spark):
    """Of an array of tokens, those that are skills as they stand, null for the others."""
    return lambda tokens: d.each(tokens, "x", f"CASE WHEN {d.among('x', WHITELIST)} THEN x END")


def extracted(d: Spark, text: str, out: str, match) -> list[dict[str, str]]:
    """Layers {out} (skills in the order of their first place) and {out}_typos (tokens that only came close), from the
    SQL of a text; ``match`` gives the SQL of an array of skills or nulls from that of an array of tokens.

    A token after or before a colon counts as a typo each time, any other only where its skill is new.
    """
    parts = d.where(d.each(d.split(d.sub(f"coalesce({text}, '')", "[()]", " "), BREAKS), "x", d.strip("x")), "y", "y <> ''")
    marked = d.each(d.split("p", ":"), "s", f"CASE WHEN contains(p, ':') THEN '1' ELSE '0' END || {d.strip('s')}")
    norm = d.strip(d.sub("lower(substr(t, 2))", "[^a-z0-9#+ ]"))
    good = f"length({norm}) > 1 AND NOT {d.match('substr(t, 2)', r'^\p{Nd}+$')} AND NOT {d.match('substr(t, 2)', '[0-9]{4}')} AND NOT {d.any('lower(t)', NOISE)}"
    skill, place = d.at(f"{out}_found", "i"), d.least_of(d.where(d.count_to(d.size(f"{out}_found")), "k", f"{d.at(f'{out}_found', 'k')} = {d.at(f'{out}_found', 'i')}"))
    typo = f"{skill} IS NOT NULL AND {skill} <> {d.at(f'{out}_norms', 'i')} AND ({d.at(f'{out}_tokens', 'i')} LIKE '1%' OR {place} = i)"
    first = f"{skill} IS NOT NULL AND {place} = i"
    last = [{f"{out}_typos": d.size(d.where(d.count_to(d.size(f"{out}_found")), "i", typo)), out: d.each(d.where(d.count_to(d.size(f"{out}_found")), "i", first), "i", skill)}]
    if not isinstance(d, DuckDB):
        # the same with one look at each token: there are few skills, however many tokens
        counts = f"s IS NOT NULL AND s <> get({out}_norms, i) AND (startswith(get({out}_tokens, i), '1') OR array_contains({out}_places, i))"
        last = [
            {out: d.distinct(d.where(f"{out}_found", "s", "s IS NOT NULL"))},
            {f"{out}_places": d.each(out, "s", f"CAST(array_position({out}_found, s) AS INT) - 1")},
            {f"{out}_typos": d.size(f"filter({out}_found, (s, i) -> {counts})")},
        ]
    return [
        {f"{out}_parts": parts},
        {f"{out}_tokens": d.where(d.flat(d.each(f"{out}_parts", "p", marked)), "t", good)},
        {f"{out}_norms": d.each(f"{out}_tokens", "t", norm)},
        {f"{out}_found": match(f"{out}_norms")},
        *last,
    ]


def _bounded(word: str) -> str:
    """A pattern of a word between word boundaries, which after a sign means that a word character follows."""
    inside = r"[\p{L}\p{N}_]"
    before = r"(?:^|[^\p{L}\p{N}_])" if re.match(r"\w", word[0]) else inside
    after = r"(?:$|[^\p{L}\p{N}_])" if re.match(r"\w", word[-1]) else inside
    return before + re.escape(word).replace(r"\ ", " ") + after


def _shown(word: str) -> str:
    return word.title() if len(word) > 3 else word.upper()


def scanned(d: Spark, t: str) -> str:
    """Skills named anywhere in a lower-case text, by alphabet, in title case, short ones in capitals."""
    named = [f"CASE WHEN contains({t}, '{w}') AND {d.match(t, _bounded(w))} THEN '{_shown(w)}' END" for w in SCANNED]
    return d.where(d.array(*named), "x", "x IS NOT NULL")


def enriching(d: Spark, texts: str, words=ENRICHING) -> str:
    """Which of the phrases are in any of the texts, in their order."""
    return d.where(d.array(*[f"CASE WHEN {d.some(texts, 'x', d.any_word('lower(x)', (w,)))} THEN '{w}' END" for w in words]), "y", "y IS NOT NULL")


def joined_with(d: Spark, skills: str, more: str) -> str:
    """The skills, then those of ``more`` that they don't have in any case."""
    return d.concat(skills, d.where(more, "m", f"NOT {d.item_in('lower(m)', d.each(skills, 'x', 'lower(x)'))}"))


def built(d: Spark, match, section_text: str, other_text: str, raw: str, project_skills: str) -> list[dict[str, str]]:
    """Layers that end in ``skills``: of the skills section, else of one under another name, else of the whole text,
    else those named anywhere; then the projects' own."""
    only = lambda t, *before: f"CASE WHEN {' AND '.join(f'{d.size(b)} = 0' for b in before)} THEN {t} ELSE '' END"
    return [
        *extracted(d, section_text, "skills_1", match),
        *extracted(d, only(other_text, "skills_1"), "skills_2", match),
        *extracted(d, only(raw, "skills_1", "skills_2"), "skills_3", match),
        {"lower_raw": only(f"lower({raw})", "skills_1", "skills_2", "skills_3")},
        {"skills_4": scanned(d, "lower_raw")},
        {"listed": d.concat("skills_1", "skills_2", "skills_3", "skills_4")},
        {"skills": joined_with(d, "listed", project_skills)},
    ]


def refined(d: Spark, skills: str, texts: str) -> list[dict[str, str]]:
    """Layers that end in ``refined``: skills among the screening's hints, then hints in the texts, each once."""
    rename = f"CASE {d.strip('lower(x)')} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SCREEN_ALIASES.items()) + f" ELSE {d.strip('lower(x)')} END"
    hints = tuple(sorted(SCREEN_HINTS))
    named = [f"CASE WHEN {d.some(texts, 'x', d.any_word('lower(x)', (w,)))} THEN '{w}' END" for w in hints]
    return [
        {"own_hints": d.where(d.each(d.each(skills, "x", rename), "y", d.squeeze("y")), "z", d.among("z", hints))},
        {"all_hints": d.concat("own_hints", d.where(d.array(*named), "y", "y IS NOT NULL"))},
        {"refined": d.each(d.where(d.count_to(d.size("all_hints")), "i", f"NOT {d.item_in(d.at('all_hints', 'i'), d.span('all_hints', '1', 'i - 1'))}"), "k", d.at("all_hints", "k"))},
    ]


def white_blank(d: Spark, t: str) -> str:
    return or_null(d, d.sub(t, f"[{WHITE}]+", " "))

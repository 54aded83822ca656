"""Projects of a candidate: gathering their lines, cutting them into projects, judging what was cut.

Gathering, names and descriptions are SQL fragments (see dialect.py). Cutting reads lines one after the other and depends
on what came before, so it is an Arrow UDF over a document's array of lines, which holds one document at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql.functions import pandas_udf

from docsift.functions.dialect import WHITE, Spark
from docsift.functions.entities import COMMON_HEADERS
from docsift.operators.deadline import Overdue, limited

# Fixed values
BULLET = "-•●▪◦►▸■□◆◇*"
NOISE = r"\b(?:strengths?|soft skills?|hobbies?|interests?|objective|summary)\b"
MONTH_DATE = r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[\s,/-]*\d{4}\b|\b\d{4}\s*-\s*(?:present|\d{4})\b"
YEAR = r"(?:\d{1,2}/)?(?:19|20)\d{2}"
DATE_ONLY = rf"(?i){YEAR}\s*[-–—]\s*(?:{YEAR}|present)"
GENERIC = ("project", "projects", "other project", "other projects", "project name", "project details")
NO_NAMES = ("profile summary", "career objective", "objective", "summary")
VERBS = ("developed", "built", "created", "implemented", "designed")
TOLD = ("developed", "built", "created")
OTHER_TITLES = (
    "languages:", "backend:", "front-end:", "frontend:", "database:", "authentication:", "tools:", "other:", "version control:", "api testing", "api testing & debugging:", "rest api", "php |", "html", "css", "js", "sql", "mongo db", "node js", "angular js",
)
NO_COLON_TITLES = ("skills", "languages", "tools", "backend", "frontend", "database", "description", "environment", "technologies", "tools used")
DETAILS = ("environment", "description", "technologies", "tools")
ACTIONS = (
    "developed", "created", "implemented", "built", "designed", "building", "made", "developing", "using", "used", "develop", "create", "engineered", "constructed", "architected", "launched", "delivered",
)
TECH = (
    "html", "css", "javascript", "react", "node", "express", "mongo", "sql", "firebase", "git", "python", "java", "api", "rest", "jwt", "auth", "socket", "cors", "mvc", "npm", "postman", "chrome", "dev tools", "fetch", "weather", "temperature", "real-time", "real time",
)
PARTS_OF_NAMES = ("backend", "front-end", "frontend", "version control", "api testing")
SECTION_WORDS = ("PROJECTS", "TECHNICAL", "SKILLS")
SPOKEN = ("english", "hindi", "gujarati", "tamil", "telugu", "kannada", "marathi")
LINE_WORDS = ("project", "system", "application")
LINE_VERBS = ("developed", "implemented", "created", "built", "designed")
STRAY_WORDS = ("portfolio", "project", "web clone", "game", "app", "application", "system", "platform", "website")
STRAY_VERBS = ("developed", "created", "built", "designed", "implemented", "made", "using", "used")
STRAY_TECH = ("html", "css", "javascript", "js", "node", "mongo", "sql", "react", "php", "python", "firebase", "api", "fetch")
STRAYS = 3
SCHEMA = "array<struct<name: string, duration: string, description: string>>"


def project_lines(d: Spark, of: str = "canon") -> list[dict[str, str]]:
    """Layers that end in ``project_lines``: those of the projects section without noise, else project-like lines of
    experience and achievements, then of other sections that have three or more."""
    names, lines = f"{of}_names", f"{of}_lines"
    quiet = f"NOT {d.match('lower(x)', NOISE)}"
    told = f"{quiet} AND ({d.any('lower(x)', LINE_WORDS)} OR {d.any('lower(x)', LINE_VERBS)})"
    tech = lambda x: f"{d.count(f'lower({x})', STRAY_TECH)} >= 2"
    head = d.part("x", "^([^:]*):", 1)
    like = (
        f"({d.any('lower(x)', STRAY_WORDS)} OR {d.any('lower(x)', STRAY_VERBS)} OR {tech('x')}"
        f" OR (contains(x, ':') AND {d.n_words('x')} >= 2 AND {d.n_words(head)} <= 4)"
        f" OR (y IS NOT NULL AND ({d.any('lower(y)', STRAY_VERBS)} OR {tech('y')}) AND {d.n_words('x')} <= 4 AND NOT {d.upper_case('x')}))"
    )
    stray = f"{quiet} AND NOT {d.among('lower(x)', SPOKEN)} AND NOT ({d.upper_case('x')} AND {d.n_words('x')} <= 2) AND {like}"
    # the line and the one after it, as one-item arrays that name them
    for_line = d.some(d.array(d.at("l", "i")), "x", d.some(d.array(d.at("l", "i + 1")), "y", stray))
    strays = d.each(d.where(d.count_to(d.size("l")), "i", for_line), "i", d.at("l", "i"))
    in_names = lambda group: d.among(d.at(names, "k"), group)
    number = d.count_to(d.size(names))
    return [
        {"in_projects": d.item_in("'projects'", names)},
        {
            "own_lines": d.flat(d.each(d.where(number, "k", in_names(("projects",))), "k", d.where(d.at(lines, "k"), "x", quiet))),
            "told_lines": d.flat(d.each(d.where(number, "k", in_names(("experience", "achievements"))), "k", d.where(d.at(lines, "k"), "x", told))),
            "other_lines": d.each(d.where(number, "k", f"NOT {in_names(('projects', 'education', 'experience', 'achievements'))}"), "k", d.at(lines, "k")),
        },
        {"stray_lines": d.flat(d.where(d.each("other_lines", "l", strays), "s", f"{d.size('s')} >= {STRAYS}"))},
        {"project_lines": f"CASE WHEN in_projects THEN own_lines ELSE {d.concat('told_lines', 'stray_lines')} END"},
    ]


def _let(d: Spark, x: str, *steps) -> str:
    """Each step gives SQL from the value before it, named; one-item arrays hold the values."""
    made = d.array(x)
    for k, step in enumerate(steps):
        made = d.each(made, f"v{k}", step(f"v{k}"))
    return d.first(made)


def clean_name(d: Spark, x: str) -> str:
    """A project's name without bullets, labels, a leading verb and what it did; empty if nothing particular is left."""
    prefix = rf"(?i)^[{WHITE}]*(?:project[{WHITE}]*name|name|other[{WHITE}]+projects?|projects?|project|description)[{WHITE}]*[:\-]?[{WHITE}]*"
    verb = "(?i)^(?:" + "|".join(VERBS) + ")"

    def without_verb(v: str) -> str:
        rest = d.sub(d.strip(d.sub(v, verb)), rf"(?i)^[{WHITE}]*(?:an|a)[{WHITE}]+")
        return f"CASE WHEN {d.match(v, verb)} THEN {rest} ELSE {v} END"

    def without_tale(v: str) -> str:
        cases = ""
        for sign in (r"\.", ":"):
            after = d.strip(d.part(v, rf"(?s)^[^{sign}]*{sign}(.*)$", 1))
            cases += f" WHEN length({after}) > 5 AND {d.any(f'lower({after})', TOLD)} THEN {d.strip(d.part(v, rf'^([^{sign}]*){sign}', 1))}"
        return f"CASE{cases} ELSE {v} END"

    return _let(
        d, d.strip(f"coalesce({x}, '')"), lambda v: d.sub(v, rf"^[{WHITE}]*[{BULLET[1:]}\-][{WHITE}]*"), lambda v: d.sub(v, prefix), without_verb, without_tale,
        lambda v: d.sub(d.sub(v, rf"[{WHITE}]{{2,}}", " "), r"^[ \-:|]+|[ \-:|]+$"), lambda v: f"CASE WHEN {d.among(f'lower({v})', GENERIC + NO_NAMES)} THEN '' ELSE {v} END",
    )


def clean_description(d: Spark, x: str) -> str:
    ends = lambda v: d.sub(v, r"^[ ,\-]+|[ ,\-]+$")
    return _let(
        d, d.strip(f"coalesce({x}, '')"), lambda v: d.sub(v, rf"(?i)^[{WHITE}]*description[{WHITE}]*[:\-]?[{WHITE}]*"), lambda v: ends(d.sub(v, rf"[{WHITE}]{{2,}}", " ")),
        lambda v: ends(d.sub(v, rf"(?i)\b(?:like|such as|including)\b[{WHITE}]*$")),
    )


# The rest works on one document's lines.

_BULLETED = re.compile(rf"\s*[{re.escape(BULLET)}]\s*(.+)")
_DATE, _ONLY, _NOISE = re.compile(MONTH_DATE), re.compile(DATE_ONLY), re.compile(NOISE)
_LABEL = re.compile(r"(?i)\s*(?:project\s*name|name|other\s+projects?|projects?|project|description)\s*[:\-]?\s*")
_VERB = re.compile("(?i)" + "|".join(VERBS))


def _any(text: str, words) -> bool:
    return any(w in text for w in words)


def plain_name(name: str) -> str:
    """What clean_name gives."""
    s = re.sub(rf"^\s*[{re.escape(BULLET)}]\s*", "", name.strip())
    if m := _LABEL.match(s):
        s = s[m.end() :]
    if m := _VERB.match(s):
        s = re.sub(r"(?i)^\s*(?:an|a)\s+", "", s[m.end() :].strip())
    for sign in ".:":
        before, found, after = s.partition(sign)
        if found and len(after.strip()) > 5 and _any(after.lower(), TOLD):
            s = before.strip()
            break
    s = re.sub(r"\s{2,}", " ", s).strip(" -:|")
    return "" if s.lower() in GENERIC + NO_NAMES else s


def plain_description(text: str) -> str:
    """What clean_description gives."""
    s = re.sub(r"(?i)^\s*description\s*[:\-]?\s*", "", text.strip())
    s = re.sub(r"\s{2,}", " ", s).strip(" ,-")
    return re.sub(r"(?i)\b(?:like|such as|including)\b\s*$", "", s).strip(" ,-")


def is_title(line: str) -> bool:
    """A dated line, one with brackets of ten words at most, or a short one with a capital that is no list or label."""
    words, low = line.split(), line.lower()
    if not 4 <= len(line) <= 100 or low in COMMON_HEADERS:
        return False
    if line.endswith(":"):
        label = low.rstrip(":").strip()
        return len(label) >= 2 and len(label.split()) <= 4 and label not in NO_COLON_TITLES
    never = (
        low.startswith(OTHER_TITLES) or low.startswith(tuple(v + " " for v in VERBS)) or re.fullmatch(r"(?:19|20)\d{2}", line)
        or ("," in line and len(words) <= 4) or re.fullmatch(rf"{YEAR}\s*-\s*{YEAR}", line)
    )
    if never:
        return False
    if _DATE.search(line) or ("(" in line and ")" in line and len(words) <= 10):
        return True
    short = len(words) <= 6 and not line.endswith(".") and any(c.isupper() for c in line)
    return short and not re.search(r"\b(?:objective|summary|profile|address|email|phone)\b", low)


@dataclass
class _Cutter:
    """Projects so far, the open one, names taken and a duration that waits for the next title."""

    done: list[dict] = field(default_factory=list)
    open: dict | None = None
    taken: set[str] = field(default_factory=set)
    waiting: str = ""

    def close(self) -> None:
        if self.open:
            name, told = self.open["name"].strip(), plain_description(_DATE.sub(" ", " ".join(self.open["told"]).strip()))
            self.done.append({"name": plain_name(name) or name, "duration": self.open["duration"].strip(), "description": told})
        self.open = None

    def begin(self, name: str, duration: str, told: list[str]) -> None:
        self.close()
        self.open = {"name": name, "duration": duration, "told": told}
        self.taken.add(name)

    def tell(self, text: str) -> bool:
        """False if no project is open."""
        if self.open is not None:
            self.open["told"].append(text)
        return self.open is not None

    def title(self, line: str, bulleted: bool) -> None:
        self.close()
        m = _DATE.search(line)
        duration = m[0] if m else ""
        if _ONLY.fullmatch(line):
            self.waiting = duration or line
            return
        name = re.sub(r"\([^)]*\)", " ", line.replace(duration, " ") if duration else line)
        name = plain_name(re.sub(r"\s{2,}", " ", re.sub(r"\s*[|:-]\s*$", "", name)).strip(" |-:"))
        if name and name not in self.taken:
            self.begin(name, duration or self.waiting, [])
            self.waiting = ""
        elif not bulleted:
            self.waiting = duration or self.waiting

    def labelled(self, head: str, tail: str) -> bool:
        """``Name: what it does`` with five words or more begins a project, unless an internship."""
        fits = len(head) > 3 and len(tail.split()) >= 5 and "intern" not in f"{head} {tail}".lower() and head not in self.taken
        if fits:
            self.begin(head, "", [tail])
        return fits

    def bulleted(self, text: str) -> bool:
        """False if the line is still to be read as one without a bullet."""
        if ":" in text and not text.endswith(":"):
            head, tail = (x.strip() for x in text.split(":", 1))
            if head.lower() == "project name":
                name = tail.rstrip(".").strip()
                if len(name) > 2 and "intern" not in name.lower() and name not in self.taken:
                    self.begin(name, "", [])
                    return True
            elif head.lower() in DETAILS:
                if self.tell(tail):
                    return True
            elif self.labelled(head, tail):
                return True
        if self.tell(text):
            return True
        if is_title(text):
            self.title(text, True)
            return True
        return False

    def plain(self, line: str) -> None:
        if is_title(line):
            self.title(line, False)
        elif self.open is None:
            if ":" in line and not line.endswith(":"):
                self.labelled(*(x.strip() for x in line.split(":", 1)))
        elif not _NOISE.search(line.lower()):
            if not self.open["duration"]:
                if _ONLY.fullmatch(line):
                    self.open["duration"] = line
                    return
                if m := _DATE.search(line):
                    self.open["duration"] = m[0]
                    line = line.replace(m[0], " ").strip(" ,-")
            if line:
                self.tell(line)


def is_project(name: str, description: str) -> bool:
    low_name, low = name.lower(), description.lower()
    bad_name = (
        len(name) <= 3 or len(name) > 80 or "intern" in low_name or low_name in NO_NAMES + GENERIC or ("," in name and len(name.split()) <= 4)
        or _any(low_name, PARTS_OF_NAMES) or _any(name.upper(), SECTION_WORDS) or (name.isupper() and len(name.split()) <= 3)
    )
    told = _any(low, ACTIONS) or sum(t in low for t in TECH) >= 2
    return not bad_name and "intern" not in low and len(description.split()) >= 5 and told


def cut_projects(lines: list[str]) -> Iterator[dict]:
    cutter = _Cutter()
    for whole in "\n".join(lines).splitlines():
        line = whole.strip()
        if not 3 <= len(line) <= 1000 or line.lower() in COMMON_HEADERS:
            continue
        m = _BULLETED.fullmatch(line)
        if not (m and cutter.bulleted(m[1].strip())):
            cutter.plain(line)
    cutter.close()
    for found in cutter.done:
        found["name"] = plain_name(found["name"])
        if is_project(found["name"], found["description"]):
            yield found


def register_cut_projects(spark, deadline: float | None = None) -> str:
    """Registers the UDF of the session and gives its name: an array of lines to an array of projects. With a deadline in
    seconds a document that takes longer gives null, which the caller has to tell from a result; without one each is cut to
    its end, which takes time in proportion to its lines."""

    def within(lines) -> list[dict] | None:
        if deadline is None:
            return list(cut_projects(list(lines)))
        try:
            return limited(deadline, lambda: list(cut_projects(list(lines))))
        except Overdue:
            return None

    @pandas_udf(SCHEMA)
    def projects(lines: pd.Series) -> pd.Series:
        return lines.map(lambda ls: [] if ls is None else within(ls))

    spark.udf.register("docsift_cut_projects", projects.asNondeterministic())  # never moved into a lambda
    return "docsift_cut_projects"

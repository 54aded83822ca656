"""Classifiers of sections by name and content, as SQL fragments of an engine (see dialect.py).

``classified`` gives layers over columns ``name`` (a string) and ``content`` (an array of lines) that end in category,
confidence, method and content_length. The two classifiers differ in their lists and in how a keyword counts: as a whole
word or as a substring.
"""

from __future__ import annotations

from dataclasses import dataclass

from docsift.functions.dialect import Spark
from docsift.functions.headers import lookup

# Fixed values, in the order in which they are tried
NAMES_A = {
    "technical skills": "skills", "technical expertise": "skills", "core competencies": "skills", "skill set": "skills", "skills & abilities": "skills", "competencies": "skills", "tech stack": "skills", "technical proficiency": "skills",
    "educational background": "education", "academic background": "education", "education & training": "education", "academic qualifications": "education", "qualifications": "education",
    "work experience": "experience", "professional experience": "experience", "employment history": "experience", "work history": "experience", "professional background": "experience", "career history": "experience",
    "academic projects": "projects", "personal projects": "projects", "project work": "projects", "key projects": "projects", "major projects": "projects", "my projects": "projects",
    "awards": "achievements", "certifications": "achievements", "certificates": "achievements", "honors": "achievements", "recognition": "achievements", "accomplishments": "achievements", "achievements & awards": "achievements",
    "language proficiency": "languages", "languages known": "languages", "linguistic skills": "languages",
    "hobbies": "interests", "activities": "interests", "extracurricular": "interests", "co-curricular": "interests", "personal interests": "interests",
    "objective": "summary", "career objective": "summary", "profile": "summary", "professional summary": "summary", "about me": "summary", "personal profile": "summary", "summary": "summary", "career summary": "summary",
}
NAMES_B = {
    "technical skills": "skills", "technical expertise": "skills", "core competencies": "skills", "skill set": "skills", "skills & abilities": "skills", "competencies": "skills",
    "educational background": "education", "academic background": "education", "education & training": "education", "academic qualifications": "education",
    "work experience": "experience", "professional experience": "experience", "employment history": "experience", "work history": "experience", "professional background": "experience", "career history": "experience",
    "academic projects": "projects", "personal projects": "projects", "project work": "projects", "key projects": "projects", "major projects": "projects",
    "awards": "achievements", "certifications": "achievements", "certificates": "achievements", "honors": "achievements", "recognition": "achievements", "accomplishments": "achievements",
    "language proficiency": "languages", "languages known": "languages",
    "hobbies": "interests", "activities": "interests", "extracurricular": "interests", "co-curricular": "interests",
    "objective": "summary", "career objective": "summary", "profile": "summary", "professional summary": "summary", "about me": "summary", "personal profile": "summary",
}
KEYWORDS_A = {
    "skills": ("programming", "coding", "scripting", "framework", "library", "database", "tool", "technology", "platform", "language", "html", "css", "javascript", "python", "java", "sql", "react", "angular", "node", "django", "flask", "proficient", "familiar", "experienced", "skilled"),
    "education": ("university", "college", "institute", "school", "degree", "bachelor", "master", "phd", "diploma", "btech", "mtech", "cgpa", "gpa", "percentage", "grade", "major", "minor", "graduated", "studied", "pursuing", "enrolled"),
    "experience": ("company", "organization", "firm", "corporation", "startup", "role", "position", "responsibility", "managed", "led", "developed", "implemented", "designed", "created", "intern", "internship", "trainee", "engineer", "developer", "worked", "working", "employed", "hired"),
    "projects": ("project", "system", "application", "platform", "tool", "developed", "built", "created", "designed", "implemented", "using", "technology", "framework", "database", "web", "mobile", "app", "software"),
    "achievements": ("award", "honor", "recognition", "certificate", "certification", "won", "received", "achieved", "ranked", "selected", "first", "second", "third", "winner", "runner"),
    "languages": ("english", "hindi", "spanish", "french", "german", "language", "fluent", "proficient", "native", "intermediate", "speaking", "reading", "writing"),
    "interests": ("hobby", "interest", "activity", "sport", "music", "reading", "travel", "photography", "gaming", "volunteer", "playing", "watching", "collecting"),
    "summary": ("objective", "summary", "profile", "about", "seeking", "motivated", "passionate", "dedicated", "experienced", "professional", "career", "goal", "aspiration"),
}
KEYWORDS_B = {
    "skills": ("programming", "coding", "scripting", "framework", "library", "database", "tool", "technology", "platform", "language", "html", "css", "javascript", "python", "java", "sql", "react", "angular", "node", "django", "flask"),
    "education": ("university", "college", "institute", "school", "degree", "bachelor", "master", "phd", "diploma", "btech", "mtech", "cgpa", "gpa", "percentage", "grade", "major", "minor"),
    "experience": ("company", "organization", "firm", "corporation", "startup", "role", "position", "responsibility", "managed", "led", "developed", "implemented", "designed", "created", "intern", "internship", "trainee", "engineer", "developer"),
    "projects": ("project", "system", "application", "platform", "tool", "developed", "built", "created", "designed", "implemented", "using", "technology", "framework", "database"),
    "achievements": ("award", "honor", "recognition", "certificate", "certification", "won", "received", "achieved", "ranked", "selected"),
    "languages": ("english", "hindi", "spanish", "french", "german", "language", "fluent", "proficient", "native", "intermediate"),
    "interests": ("hobby", "interest", "activity", "sport", "music", "reading", "travel", "photography", "gaming", "volunteer"),
    "summary": ("objective", "summary", "profile", "about", "seeking", "motivated", "passionate", "dedicated", "experienced"),
}
DEGREES = ("btech", "b.tech", "bachelor", "master", "cgpa")
SKILL_SIGNS = ("html", "css", "javascript", "python")
ACTIONS = ("developed", "built", "created", "designed", "implemented")
TECH = ("html", "css", "javascript", "python", "java", "sql")
CONFIDENT = 0.7


@dataclass(frozen=True)
class Rules:
    names: dict
    keywords: dict
    whole_words: bool
    projects: bool


A = Rules(NAMES_A, KEYWORDS_A, True, True)
B = Rules(NAMES_B, KEYWORDS_B, False, False)


def classified(d: Spark, rules: Rules) -> list[dict[str, str]]:
    votes = {k: (d.shared("content_words", words) if rules.whole_words else d.count("content_text", words)) for k, words in rules.keywords.items()}
    part = " ".join(f"WHEN contains(plain_name, '{a}') OR contains('{a}', plain_name) THEN '{c}'" for a, c in rules.names.items())
    most = f"greatest({', '.join(f'votes_{k}' for k in votes)})"
    first = " ".join(f"WHEN votes_{k} = best THEN '{k}'" for k in votes)
    told = " ".join(f"WHEN contains(low_name, '{k}') THEN '{k}'" for k in votes)
    words = d.each(d.where(d.take("content", 5), "x", f"{d.strip('x')} <> ''"), "y", d.n_words("y"))
    short = f"coalesce({d.most(words)}, 0) <= 4 AND {d.any('content_text', SKILL_SIGNS)}"
    built = f" WHEN {d.any('content_text', ACTIONS)} AND {d.any('content_text', TECH)} THEN 'projects'" if rules.projects else ""
    there = f"{d.size('content')} > 0"
    steps = {  # method: category, confidence
        "alias": ("by_alias", "0.95D"), "alias_partial": ("by_part", "0.8D"), "keyword": ("CASE WHEN vote_confidence > 0.7D THEN by_vote END", "vote_confidence"),
        "heuristic_name": ("by_name", "0.75D"), "heuristic_content": ("by_content", "0.7D"),
    }
    chosen = " ".join(f"WHEN ({c}) IS NOT NULL THEN '{m}'" for m, (c, _) in steps.items())
    return [
        {"low_name": d.strip("lower(name)"), "content_text": f"lower({d.join('content')})"},
        {"plain_name": d.strip(f"replace({d.strip("replace(low_name, ':', '')")}, '-', ' ')"), "content_words": d.split("content_text", r"[^\p{L}\p{N}_]+")},
        {f"votes_{k}": v for k, v in votes.items()},
        {"best": most, "every_vote": " + ".join(f"votes_{k}" for k in votes)},
        {"by_alias": lookup(d, "plain_name", rules.names), "by_part": f"CASE {part} END", "by_vote": f"CASE WHEN {there} AND best > 0 THEN CASE {first} END END", "by_name": f"CASE {told} END",
         "vote_confidence": f"CASE WHEN {there} AND best > 0 THEN least(0.9D, 0.5D + CAST(best AS DOUBLE) / every_vote * 0.4D) END",
         "by_content": f"CASE WHEN NOT ({there}) THEN NULL WHEN {d.any('content_text', DEGREES)} THEN 'education' WHEN {short} THEN 'skills'{built} END"},
        {"method": f"CASE {chosen} ELSE 'unknown' END"},
        {"category": "CASE method " + " ".join(f"WHEN '{m}' THEN {c}" for m, (c, _) in steps.items()) + " ELSE 'unknown' END",
         "confidence": "round(CASE method " + " ".join(f"WHEN '{m}' THEN {v}" for m, (_, v) in steps.items()) + " ELSE 0.5D END, 6)",
         "content_length": "CAST(CASE WHEN method = 'keyword' THEN length(content_text) ELSE 0 END AS INT)" if rules.whole_words else "0"},
    ]


#: Of the layers before the method, those of the name; the others are of the content alone.
OF_NAME = ("low_name", "plain_name", "by_alias", "by_part", "by_name")


def classified_once(d: Spark, rules: Rules) -> tuple[list[dict[str, str]], list[dict[str, str]]]:
    """The same in two parts, so that a content that several names share is read once: layers over ``content``, then layers
    over ``name`` and what came of the content. Words of no list go before they are counted list by list."""
    *first, method, last = classified(d, rules)
    contents = [{k: v for k, v in layer.items() if k not in OF_NAME} for layer in first]
    names = [layer for layer in ({k: v for k, v in layer.items() if k in OF_NAME} for layer in first) if layer]
    if rules.whole_words:
        known = ", ".join(f"'{w}'" for w in sorted(set().union(*rules.keywords.values())))
        contents[1]["content_words"] = f"array_intersect({contents[1]['content_words']}, array({known}))"
    contents[1]["content_chars"] = "length(content_text)"
    return [layer for layer in contents if layer], [*names, method, {k: v.replace("length(content_text)", "content_chars") for k, v in last.items()}]


def is_confident(threshold: float = CONFIDENT) -> str:
    return f"CASE WHEN confidence >= {threshold}D THEN 1 ELSE 0 END"

"""Scores, hard rules, screening and labels over the features: layers of SQL expressions for either engine.

``grade_score`` is the grade on a scale of 100, ``degree_code`` 2 master, 1 bachelor, 0 diploma, -1 none. Reasons are
joined by ``;`` in the order of the rules, empty if there are none. ``typos`` are misspelt skills and contacts,
``typo_quality`` the spelling score of the text, 100 without a dictionary.
"""

from __future__ import annotations

from docsift.functions.dialect import Spark, flag

LABELS = {"min_score": 80.0, "min_projects": 2, "min_years": 1.0, "average_score": 65.0, "average_skills": 15, "allow_fresher": True}
TIERS = ((70, "SHORTLISTED"), (45, "MANUAL REVIEW"))


def reasons(rules: dict[str, str]) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules.items()) + ")"


def steps(x: str, below: tuple, other: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} <= {limit} THEN {score}" for limit, score in below) + f" ELSE {other} END)"


RECORD = {
    "grade_score": "cgpa_value", "years_of_experience": "experience_years_estimate", "has_internship": "experience_has_internship", "is_it_candidate": "is_cs_it_candidate", "typo_count": "typos",
    "degree_code": "CASE WHEN has_master_degree = 1 THEN 2 WHEN has_bachelor_degree = 1 THEN 1 WHEN has_diploma = 1 THEN 0 ELSE -1 END", "has_valid_contact": flag("has_email = 1 AND has_phone = 1"),
}

#: The 18 inputs of the models.
MODEL_INPUTS = ("skills_count", "programming_languages_count", "framework_count", "database_count", "years_of_experience", "projects_count", "has_projects", "has_experience", "has_internship", "degree_code", "is_it_candidate", "grade_score", "has_valid_contact", "typo_count", "ats_total_penalty_score", "overall_profile_strength", "quantified_impact_count", "online_presence_count")

_NO_CONTACT = "email IS NULL AND phone IS NULL"
_PENALTIES = "CASE WHEN skills_count = 0 THEN 40 ELSE 0 END + CASE WHEN has_projects = 0 THEN 30 ELSE 0 END + CASE WHEN grade_score < 5 THEN 10 ELSE 0 END + CASE WHEN skills_count >= 10 AND projects_count = 0 THEN 10 ELSE 0 END + CASE WHEN projects_count >= 2 AND skills_count <= 3 THEN 10 ELSE 0 END"
_CONTENT = f"{steps('skills_count', ((0, 0), (3, 30), (8, 60)), '100')} * 0.4D + {steps('projects_count', ((0, 0), (1, 60), (2, 80)), '100')} * 0.3D + least(CASE WHEN grade_score > 10 THEN grade_score ELSE grade_score * 10 END, 100.0D) * 0.2D + (CASE WHEN has_experience = 1 THEN 100 WHEN has_internship = 1 THEN 70 ELSE 0 END) * 0.1D"


def told(*rules: tuple[str, str]) -> str:
    """Texts of the rules that hold, in their order, joined by ``;``; a text is SQL."""
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN {text} END" for text, cond in rules) + ")"


def ats(d: Spark) -> list[dict[str, str]]:
    """QS5: weighted parts less penalties and their reasons; all zero without any contact, at most 90."""
    n_words = d.n_words("raw")
    there = f"NOT ({_NO_CONTACT})"
    reasons = told(
        ("'Missing contact information (email and phone)'", _NO_CONTACT), ("'No skills detected (-40)'", f"{there} AND skills_count = 0"), ("'No projects found (-30)'", f"{there} AND has_projects = 0"),
        ("'Weak education score (<5) (-10)'", f"{there} AND grade_score < 5"), ("'Complete contact information'", "contact_score = 100"), ("'Partial contact information'", "contact_score = 50"),
        ("'Well-structured resume'", f"{there} AND sections_there >= 3"), ("'Poor resume structure'", f"{there} AND sections_there <= 1"),
        ("'Weak skills section (≤3 skills)'", f"{there} AND skills_count BETWEEN 1 AND 3"), ("'Average skills section'", f"{there} AND skills_count BETWEEN 4 AND 8"), ("'Strong skills section (9+ skills)'", f"{there} AND skills_count > 8"),
        ("'Limited project experience (1 project)'", f"{there} AND projects_count = 1"), ("'Good project experience (2 projects)'", f"{there} AND projects_count = 2"),
        ("'Strong project portfolio (' || CAST(projects_count AS STRING) || '+ projects)'", f"{there} AND projects_count > 2"),
        ("'Professional experience found'", f"{there} AND has_experience = 1"), ("'Internship experience found'", f"{there} AND has_experience = 0 AND has_internship = 1"), ("'No work experience'", f"{there} AND has_experience = 0 AND has_internship = 0"),
        ("'Resume too short (<120 words)'", f"{there} AND n_words < 120"), ("'Resume too long (>2000 words)'", f"{there} AND n_words > 2000"),
        ("'Inconsistent: many skills but no projects (-10)'", f"{there} AND skills_count >= 10 AND projects_count = 0"), ("'Inconsistent: projects but few skills (-10)'", f"{there} AND projects_count >= 2 AND skills_count <= 3"),
    )
    parts = {
        "contact": "CASE WHEN email IS NOT NULL AND phone IS NOT NULL THEN 100.0D ELSE 50.0D END", "structure": "sections_there * 25.0D", "content": f"CASE WHEN has_experience = 1 THEN least({_CONTENT} + 10, 100.0D) ELSE {_CONTENT} END",
        "length": "CASE WHEN n_words < 120 THEN 20.0D WHEN n_words < 200 THEN 40.0D WHEN n_words < 350 THEN 75.0D WHEN n_words < 900 THEN 100.0D WHEN n_words < 1400 THEN 85.0D WHEN n_words > 2000 THEN 50.0D ELSE 60.0D END", "typo": "typo_quality",
    }
    weighed = "contact_part / 5 + structure_part / 5 + content_part * 7 / 20 + length_part * 3 / 20 + typo_part / 10 - penalty"
    return [
        RECORD,
        {"penalty": _PENALTIES, "n_words": n_words, "sections_there": "(has_skills_section + has_education_section + has_projects_section + has_experience_section)"},
        {f"{k}_part": f"CASE WHEN {_NO_CONTACT} THEN 0.0D ELSE {v} END" for k, v in parts.items()},
        {f"{k}_score": f"round({k}_part, 2)" for k in parts} | {"ats_score": f"CASE WHEN {_NO_CONTACT} THEN 0.0D ELSE round(greatest(0.0D, least(90.0D, {weighed})), 2) END"},
        {"reasons": reasons},
    ]


CANDIDATE = [
    RECORD,
    {"candidate_score": "round(least(skills_count / 10.0D, 1.0D) * 50 + has_projects * 25 + has_experience * 15 + CASE WHEN grade_score >= 8 THEN 10 WHEN grade_score >= 6 THEN 7 ELSE 4 END, 2)", "reject_reasons": reasons({"no_valid_contact": "has_valid_contact = 0", "no_skills": "skills_count = 0", "no_projects_and_no_experience": "has_projects = 0 AND has_experience = 0"})},
    {"passes_rules": flag("reject_reasons = ''")},
]

_SCREEN = (
    "(least(skills_count / 12.0D, 1.0D) * 0.4D + least(programming_languages_count / 4.0D, 1.0D) * 0.2D + least(framework_count / 3.0D, 1.0D) * 0.2D + least(database_count / 2.0D, 1.0D) * 0.2D) * 50"
    " + (has_projects * 0.5D + least(projects_count / 2.0D, 1.0D) * 0.5D) * 25 + (has_experience * 0.7D + has_internship * 0.3D) * 15"
    " + (CASE WHEN degree_code = 1 THEN 0.5D ELSE 0.0D END + is_it_candidate * 0.3D + least(CASE WHEN grade_score <= 10 THEN grade_score / 10 ELSE grade_score / 100 END, 1.0D) * 0.2D) * 10"
)
#: QS14 over the catalogue's features: hard rejects, then the score and its tier.
SCREEN = [
    RECORD,
    {"reject_reasons": reasons({"no_email": "email IS NULL", "no_phone": "phone IS NULL", "no_skills": "skills_count = 0", "no_projects_and_no_experience": "projects_count = 0 AND has_experience = 0"})},
    {"screen_score": f"CASE WHEN reject_reasons <> '' THEN 0.0D ELSE round({_SCREEN}, 2) END"},
    {"decision": "CASE " + " ".join(f"WHEN screen_score >= {t} THEN '{n}'" for t, n in TIERS) + " ELSE 'REJECTED' END"},
]


def label(p: dict = LABELS) -> str:
    """QS15: 2 strong, 1 average, 0 weak."""
    strong = f"grade_score >= {p['min_score']} AND (projects_count >= {p['min_projects']} OR years_of_experience >= {p['min_years']} OR has_internship = 1) AND typo_count = 0"
    average = f"grade_score >= {p['average_score']} OR has_internship = 1 OR skills_count >= {p['average_skills']}" + (" OR true" if p["allow_fresher"] else "")
    return f"CASE WHEN {strong} THEN 2 WHEN {average} THEN 1 ELSE 0 END"


def hard_rules(min_projects: int = 1, required: tuple[str, ...] = ()) -> str:
    """QS16: reasons against a prediction; required names of has_<name>_skills flags."""
    return reasons({"missing_contact": "has_email = 0 OR has_phone = 0", "few_projects": f"projects_count < {min_projects}", **{f"missing_{r}": f"has_{r}_skills = 0" for r in required}})


def safe(columns: list[str], inputs: tuple[str, ...]) -> dict[str, str]:
    """QS6: the scores, zero or empty where one of the inputs, as strings, can't be read as a number."""
    readable = " AND ".join(f"TRY_CAST({x} AS DOUBLE) IS NOT NULL" for x in inputs)
    return {f"safe_{c}": f"CASE WHEN {readable} THEN {c} ELSE {chr(39) * 2 if c == 'reasons' else '0.0D'} END" for c in columns}


#: Inputs of the models that must be there, those that count, and those that are 0 or 1.
_COUNTS = ("skills_count", "programming_languages_count", "framework_count", "database_count", "projects_count")
_BINARY = ("has_projects", "has_experience", "has_internship", "has_valid_contact", "is_it_candidate")


def validation(d: Spark, skills: str = "skills") -> dict[str, str]:
    """QS9: 1 if every input is there, as many skills are counted as the list has, counts aren't negative, flags are 0 or 1
    and the degree is known; and the rules that a candidate must pass."""
    there = " AND ".join(f"{c} IS NOT NULL" for c in (*_COUNTS, *_BINARY, "degree_code", "grade_score"))
    counts, flags = " AND ".join(f"{c} >= 0" for c in _COUNTS), " AND ".join(f"{c} IN (0, 1)" for c in _BINARY)
    listed = f"skills_count = {d.size(skills)}"
    return {
        "is_valid": flag(f"{there} AND {counts} AND {flags} AND degree_code IN (-1, 0, 1, 2) AND {listed}"),
        "passes_rules": flag("has_valid_contact = 1 AND skills_count > 0 AND (projects_count > 0 OR has_experience = 1)"),
    }


def within_capacity(shortlist: int = 10, review: int = 20) -> str:
    """QS18: which candidates of a decision fit its places, best score first, of equals the smaller doc_id; a condition
    over columns decision and place."""
    return f"(decision = 'Shortlisted' AND place <= {shortlist}) OR (decision = 'Manual Review' AND place <= {review}) OR decision = 'Rejected'"

"""The feature catalogue: groups of named SQL expressions over a profile, in layers that may use earlier ones.

A profile has doc_id, raw, name, email, phone, location, sections (names), section_lines (number of lines) and arrays
of lines: skills, edu, exp, proj, ach, langs, skill_lines. ``CONTEXT`` adds the lower-case texts. Keyword tests are
substring tests. Nulls count as absent; every flag is 0 or 1 and every feature non-null.
"""

from __future__ import annotations

from docsift.functions import lexicons as lx
from docsift.functions import text as tx
from docsift.functions import wordlists as wl
from docsift.functions.dialect import DuckDB, Spark, clamp, flag

YEAR = 2026
RANGE = r"(?i)(?:\d{1,2}/)?(?:20\d{2}|19\d{2})\s*[–\-—]\s*(?:\d{1,2}/)?(?:20\d{2}|19\d{2}|present|current|now)"
CGPA = r"(?i)(?:cgpa|gpa|percentage|aggregate|marks?|score|grade)[:\s]*(\d{1,2}(?:\.\d{1,2})*)"
GAINED = r"(?i)\b(?:improved|increased|reduced|decreased|boosted|grew|cut|saved)\s+(?:by\s+)?\d+"
LED = r"(?i)\b(?:led|managed|handled|oversaw)\s+\d+"
TIMES = r"(?i)\b\d+x\b"
PROFILE_URL = r"(?i)github\.com/[a-zA-Z0-9_\-]+"
COMPANY = r"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Ltd|LLC|Inc|Pvt|Technologies|Solutions|Systems)\b"
SECTIONS = ("skills", "education", "experience", "projects", "achievements", "languages", "interests", "declaration")
ALL_TECH = tuple(dict.fromkeys(wl.PROGRAMMING_LANGUAGES + wl.FRAMEWORKS + wl.DATABASES + wl.TOOLS))
HIGHER = tuple(dict.fromkeys(lx.BACHELOR + lx.MASTER + wl.BTECH + wl.BCA + wl.BSC + wl.MCA + wl.MTECH + wl.MSC))
DEGREE = tuple(dict.fromkeys(HIGHER + lx.DIPLOMA + lx.PHD))


def context(d: Spark) -> dict[str, str]:
    """Lower-case texts of the profile."""
    low = lambda a: f"lower({d.join(a)})"
    return {"t": "lower(raw)", "edu_t": low("edu"), "exp_t": low("exp"), "proj_t": low("proj"), "ach_t": low("ach"), "skill_t": low("skill_lines"), "raw_head": f"lower({d.head('raw', 120)})", "low_skills": d.each("skills", "x", "lower(trim(x))"), **{f"low_{a}": d.each(a, "x", "lower(x)") for a in ("edu", "exp", "proj", "ach", "langs")}}


def edu_context(d: Spark) -> dict[str, str]:
    return {"edu_or_t": f"CASE WHEN {d.hits('edu_t', '[^ ]+')} > 5 THEN edu_t ELSE t END"}


def cgpa(d: Spark, t: str) -> str:
    """Best grade named in a text, on a scale of 100; null if there is none."""
    values = d.where(d.each(d.found(t, CGPA, 1), "m", "TRY_CAST(m AS DOUBLE)"), "v", "v > 0 AND v <= 100")
    return d.most(d.each(values, "v", "CASE WHEN v <= 10 THEN v * 10 ELSE v END"))


def years(d: Spark, t: str) -> str:
    """Sum of the lengths of all date ranges in a text; overlaps count twice."""
    start = f"TRY_CAST({d.part('r', r'(20\d{2}|19\d{2})', 1)} AS DOUBLE)"
    end = f"coalesce(TRY_CAST({d.part('r', r'(20\d{2}|19\d{2})$', 1)} AS DOUBLE), {YEAR})"
    valid = d.where(d.found(t, RANGE), "r", f"{start} BETWEEN 1990 AND {YEAR} AND {start} <= {end}")
    return d.total(d.each(valid, "r", f"{end} - {start}"))


def how_many(d: Spark, a: str, cond: str) -> str:
    return d.size(d.where(a, "x", cond))


def g01(d: Spark) -> list[dict[str, str]]:
    digits = "length(regexp_replace(coalesce(phone, ''), '[^0-9]', " + ("'', 'g'" if isinstance(d, DuckDB) else "''") + "))"
    return [
        {"has_name": flag("length(name) > 1"), "has_email": flag("contains(email, '@')"), "has_phone": flag(f"{digits} >= 10"), "has_location": flag("location <> ''")},
        {"contact_completeness_score": "round((has_name + has_email + has_phone + has_location) / 4.0D, 2)"},
    ]


def g02(d: Spark) -> list[dict[str, str]]:
    keyed = {f"has_{s}_section": flag(d.has("sections", s)) for s in SECTIONS}
    return [
        {"section_count": d.size("sections"), "has_objective_section": flag(d.has("sections", "career_objective")), **keyed},
        {"section_completeness_score": "round((has_skills_section + has_education_section + has_experience_section + has_projects_section) / 4.0D, 2)"},
    ]


def g03(d: Spark) -> list[dict[str, str]]:
    known = lambda words: how_many(d, "low_skills", d.among("x", words))
    weight = d.total(d.each("low_skills", "x", f"CASE WHEN {d.among('x', wl.HIGH_VALUE)} THEN 2.0D WHEN {d.among('x', wl.MID_VALUE)} THEN 1.0D ELSE CAST(0.3 AS DOUBLE) END"))
    words = d.hits("raw", r"[\p{L}\p{N}_]+")
    return [
        {
            "skills_count": d.size("skills"), "programming_languages_count": known(wl.PROGRAMMING_LANGUAGES), "framework_count": known(wl.FRAMEWORKS),
            "database_count": known(wl.DATABASES), "tool_count": known(wl.TOOLS), "skill_weight_score": f"round({weight}, 2)",
            "has_high_value_skills": flag(f"{known(wl.HIGH_VALUE)} > 0"), "project_tech_stack_count": d.count("proj_t", ALL_TECH),
            "skill_density": f"CASE WHEN {words} > 0 THEN round({d.size('skills')} / CAST({words} AS DOUBLE), 4) ELSE 0.0D END",
            **{f"has_{k}_skills": flag(d.any("t", w)) for k, w in lx.CATEGORIES.items()},
        },
        {"skill_category_count": "(" + " + ".join(f"has_{k}_skills" for k in lx.CATEGORIES) + ")"},
        {"skill_versatility": flag("skill_category_count >= 3")},
    ]


def g04(d: Spark) -> list[dict[str, str]]:
    has = lambda words: d.any("edu_or_t", words)
    lines = how_many(d, "low_edu", f"{d.any('x', DEGREE)} AND {d.hits('x', '[^ ]+')} > 2")
    by_line = d.first(d.where(d.each(d.where("low_edu", "x", d.any("x", HIGHER)), "y", cgpa(d, "y")), "g", "g IS NOT NULL"))
    graduated = d.most(d.each(d.found("edu_t", r"\b(20\d{2})\b", 1), "y", "CAST(y AS INTEGER)"))
    return [
        {
            "education_count": f"greatest({lines}, {d.count('t', ('b.tech', 'btech', 'diploma', 'bachelor', 'master'))})",
            "has_bachelor_degree": flag(has(lx.BACHELOR)), "has_master_degree": flag(has(lx.MASTER)), "has_diploma": flag(f"{has(lx.DIPLOMA)} OR contains(t, 'diploma')"), "has_phd": flag(has(lx.PHD)),
            "has_btech_be": flag(f"{has(wl.BTECH)} OR contains(t, 'b.tech')"), "has_bca": flag(has(wl.BCA)), "has_bsc_it": flag(has(wl.BSC)), "has_mca": flag(has(wl.MCA)), "has_mtech_me": flag(has(wl.MTECH)), "has_msc_it": flag(has(wl.MSC)),
            "has_it_major": flag(f"{has(wl.IT_MAJOR)} OR {d.any('raw_head', wl.IT_MAJOR)} OR {d.any('t', ('information technology', 'computer engineering'))}"),
            "has_top_institution": flag(has(wl.TOP_INSTITUTES)), "grade": f"coalesce({by_line}, {cgpa(d, 'edu_t')}, {cgpa(d, 't')})",
            "has_relevant_coursework": flag(d.any("t", wl.COURSEWORK)), "graduation_year": f"coalesce({graduated}, 0)",
        },
        {
            "has_cgpa": flag("grade IS NOT NULL"), "cgpa_value": "round(coalesce(grade, 0.0D), 2)", "has_strong_academics": flag("grade >= 8"), "is_recent_graduate": flag(f"graduation_year > 0 AND {YEAR} - graduation_year <= 2"),
            "is_cs_it_candidate": flag("has_it_major + has_bachelor_degree + has_btech_be + has_bca + has_mca > 0"), "has_dual_qualification": flag("has_diploma = 1 AND has_bachelor_degree + has_master_degree > 0"),
        },
    ]


def g05(d: Spark) -> list[dict[str, str]]:
    has = lambda words: flag(d.any("exp_t", words))
    return [
        {
            "experience_lines": d.size("exp"), "has_experience": flag(f"{d.size('exp')} > 0"), "experience_has_internship": has(lx.INTERNSHIP), "experience_years_estimate": f"round({years(d, 'exp_t')}, 2)",
            "internship_role_count": how_many(d, "low_exp", d.any("x", lx.INTERNSHIP)), "has_freelance_experience": has(wl.FREELANCE), "has_mnc_experience": has(wl.MNC), "has_startup_experience": has(wl.STARTUP),
            "has_remote_experience": has(wl.REMOTE), "has_management_experience": has(wl.MANAGEMENT), "has_quantified_impact_in_exp": flag(f"{d.match('exp_t', GAINED)} OR {d.match('exp_t', LED)}"),
            "has_missing_dates_in_exp": flag(f"{d.size('exp')} > 0 AND NOT {d.match('exp_t', RANGE)}"), "experience_company_count": d.size(d.distinct(d.found("exp_t", COMPANY))),
            "has_full_time_experience": flag(f"{d.any('exp_t', wl.FULL_TIME)} AND NOT {d.any('exp_t', lx.INTERNSHIP)}"),
        },
        {"is_fresher": flag("has_experience = 0 OR experience_years_estimate < 1")},
    ]


def g06(d: Spark) -> list[dict[str, str]]:
    kinds = {"ml": wl.ML_PROJECT, "web": lx.WEB, "mobile": lx.MOBILE, "database": wl.DATABASE_PROJECT, "api": wl.API_PROJECT, "security": lx.SECURITY, "cloud": lx.CLOUD, "data": lx.DATA}
    words = d.total(d.each("proj", "x", f"CAST({d.hits('x', '[^ ]+')} AS DOUBLE)"))
    return [
        {
            "has_projects": flag(d.has("sections", "projects")), "projects_count": d.size("proj"), **{f"has_{k}_project": flag(d.any("proj_t", w)) for k, w in kinds.items()},
            "project_tech_diversity": flag(f"{d.count('proj_t', ALL_TECH)} >= 3"), "has_deployed_project": flag(d.any("proj_t", wl.DEPLOYMENT)), "has_team_project": flag(d.any("proj_t", wl.TEAM_PROJECT)),
            "avg_project_desc_length": f"CASE WHEN {d.size('proj')} > 0 THEN round({words} / {d.size('proj')}, 1) ELSE 0.0D END", "has_github_in_projects": flag("contains(proj_t, 'github.com')"),
        },
        {"project_domain_diversity": "(has_ml_project + has_web_project + has_mobile_project + has_api_project + has_security_project + has_cloud_project)"},
    ]


def g07(d: Spark) -> list[dict[str, str]]:
    has = lambda words: flag(d.any("t", words))
    return [
        {
            "achievement_count": d.size("ach"), "has_achievements": flag(f"{d.size('ach')} > 0"), "has_hackathon": has(lx.HACKATHON), "hackathon_count": d.count("t", lx.HACKATHON), "has_competition": has(lx.COMPETITION),
            "has_competitive_coding": has(wl.COMPETITIVE), "has_open_source": flag(f"{d.any('t', lx.OPEN_SOURCE)} OR {d.match('raw', PROFILE_URL)}"),
            "has_certifications": flag(f"{d.any('t', lx.CERTIFIED + wl.CERT_PLATFORMS)} OR {d.has('sections', 'achievements')}"), "certification_platform_count": d.count("t", wl.CERT_PLATFORMS),
            "has_merit_or_rank": has(wl.MERIT), "has_publication": has(wl.PUBLICATION), "has_volunteer_work": has(wl.VOLUNTEER), "has_leadership_role": has(wl.LEADERSHIP), "has_workshop_seminar": has(wl.WORKSHOP),
        }
    ]


def g08(d: Spark) -> list[dict[str, str]]:
    return [
        {"has_linkedin": flag("contains(t, 'linkedin.com')"), "has_github": flag("contains(t, 'github.com')"), "has_github_profile": flag(d.match("raw", PROFILE_URL)), "has_portfolio": flag(f"{d.any('t', wl.PORTFOLIO)} OR {d.own_site('raw')}")},
        {"online_presence_count": "(has_linkedin + has_github + has_portfolio)"},
        {"online_presence_score": "round(online_presence_count / 3.0D, 2)", "has_multiple_online_links": flag("online_presence_count >= 2")},
    ]


def g09(d: Spark) -> list[dict[str, str]]:
    verbs = " + ".join(how_many(d, a, d.any("x", wl.ACTION_VERBS)) for a in ("low_exp", "low_proj", "low_ach"))
    return [
        {
            "resume_word_count": d.hits("raw", r"[\p{L}\p{N}_]+"), "resume_line_count": d.hits("raw", r"(?m)^.*\S.*$"), "bullet_count": d.hits("raw", r"(?m)^\s*[•\-*▸►◦▪]"), "numbers_count": d.hits("raw", tx.NUMBER), "url_count": d.hits("raw", tx.URL),
            "action_verb_count": f"({verbs})", "quantified_impact_count": f"({d.hits('t', GAINED)} + {d.hits('t', LED)} + {d.hits('t', TIMES)})", "soft_skill_count": d.count("t", lx.SOFT), "languages_count": d.size("langs"),
            "extra_language_count": how_many(d, "low_langs", f"NOT {d.among('x', wl.COMMON_LANGUAGES)}"), "generic_buzzword_count": d.count("t", lx.BUZZWORDS), "avg_section_length": f"round(section_lines / CAST(greatest({d.size('sections')}, 1) AS DOUBLE), 1)",
        },
        {
            "has_bullet_points": flag("bullet_count >= 3"), "is_length_optimal": flag("resume_word_count BETWEEN 300 AND 700"), "is_too_short": flag("resume_word_count < 150"), "is_too_long": flag("resume_word_count > 1200"),
            "has_action_verbs": flag("action_verb_count >= 3"), "has_quantified_impact": flag("quantified_impact_count >= 1"), "has_soft_skills": flag("soft_skill_count >= 1"), "speaks_multiple_langs": flag("languages_count >= 2"),
        },
    ]


def g10(d: Spark) -> list[dict[str, str]]:
    local = "lower(regexp_replace(email, '@.*', ''))"
    odd = f"{d.match(local, '(xox|sexy|cool|swag|dragonball|ninja|gamer)')} OR ({d.match(local, '[0-9]{6,}')} AND NOT {d.match(local, '^[a-z]{0,3}[0-9]{6,}$')})"
    flags = {
        "no_skills": "has_skills_section = 0", "no_education": "has_education_section = 0", "no_experience_or_projects": "has_experience_section + has_projects_section = 0", "no_contact": "has_email = 0 OR has_phone = 0",
        "personal_info": d.any("t", wl.PERSONAL_INFO), "unprofessional_email": odd, "no_quantified_impact": "quantified_impact_count = 0 AND has_experience = 1", "no_action_verbs": "action_verb_count = 0 AND has_experience = 1",
        "missing_dates": "has_missing_dates_in_exp = 1", "too_short": "is_too_short = 1", "too_long": "is_too_long = 1", "buzzword_heavy": "generic_buzzword_count >= 4", "spaced_letters": d.match("raw", r"(?:[A-Z]\s){3,}[A-Z]"),
        "keyword_stuffing": d.stuffed("raw"), "no_online_presence": "online_presence_count = 0", "has_declaration": "has_declaration_section = 1", "skills_has_dates": d.match("skill_t", RANGE), "no_proof_of_work": "has_experience_section + has_projects_section = 0",
    }
    return [{f"ats_penalty_{k}": flag(v) for k, v in flags.items()}, {"ats_total_penalty_score": "(" + " + ".join(f"ats_penalty_{k}" for k in flags) + ")"}]


def g11(d: Spark) -> list[dict[str, str]]:
    by = lambda fresh, other: f"(CASE WHEN is_fresher = 1 THEN {fresh} ELSE {other} END)"
    points = f"contact_completeness_score * 10 + section_completeness_score * 15 + least(skill_weight_score, 30.0D) + has_high_value_skills * 5 + has_projects * {by(16, 10)} + has_experience * {by(2, 12)} + has_achievements * 5 + has_cgpa * {by(19, 15)} + has_linkedin * 4 + has_github * 4"
    return [
        {"points": points, "penalty_deduction": "round(ats_total_penalty_score * 4.0D, 2)"},
        {
            "raw_positive_score": clamp("points"), "candidate_readiness_score": clamp("points - penalty_deduction"), "skills_subscore": clamp("skill_weight_score * 2 + skill_category_count * 3 + has_high_value_skills * 10"),
            "education_subscore": clamp("has_bachelor_degree * 20.0D + has_master_degree * 30 + has_strong_academics * 15 + has_top_institution * 20 + has_cgpa * 10"),
            "experience_subscore": clamp("has_experience * 25 + experience_has_internship * 20 + has_quantified_impact_in_exp * 15 + least(experience_years_estimate, 3.0D) * 10"),
            "projects_subscore": clamp("projects_count * 8.0D + project_tech_stack_count * 3 + has_deployed_project * 15 + project_domain_diversity * 5"),
        },
        {"overall_profile_strength": clamp("education_subscore / 5 + skills_subscore / 4 + experience_subscore * 3 / 10 + projects_subscore * 3 / 20 + achievement_count * 2 + has_linkedin * 2 + has_github * 3")},
    ]


GROUPS = {"g01_contact": g01, "g02_sections": g02, "g03_skills": g03, "g04_education": g04, "g05_experience": g05, "g06_projects": g06, "g07_extras": g07, "g08_online": g08, "g09_format": g09, "g10_penalties": g10, "g11_composite": g11}
HELPERS = ("grade", "points")
#: Texts in which many keywords are looked for.
SCANNED = ("t", "raw_head", "edu_or_t", "exp_t", "proj_t")


def names(group: str) -> list[str]:
    return [n for layer in GROUPS[group](Spark()) for n in layer if n not in HELPERS]


ALL = [n for g in GROUPS for n in names(g)]


def layers(d: Spark, groups=tuple(GROUPS)) -> list[dict[str, str]]:
    """Layers of the groups, side by side where they do not need each other; penalties and composites come after."""
    early = [GROUPS[g](d) for g in groups if g not in ("g10_penalties", "g11_composite")]
    out = [context(d), edu_context(d)]
    out += [{k: v for g in early if i < len(g) for k, v in g[i].items()} for i in range(max((len(g) for g in early), default=0))]
    return out + [layer for g in ("g10_penalties", "g11_composite") if g in groups for layer in GROUPS[g](d)]

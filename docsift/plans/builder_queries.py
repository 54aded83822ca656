"""Queries of skills, projects, identities and assembled records, over documents and rough candidates.

A record is made in the row: cleaned text, sections, entities, projects, skills. What has a SQL form all through is checked
with exact skill names and uncut project lines; the close match and the cutting are Arrow UDFs and tested by brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import entities as en
from docsift.functions import features, rules
from docsift.functions import headers as hd
from docsift.functions import records as rc
from docsift.functions import skills as sk
from docsift.functions.dialect import WHITE, Only, Spark, flag
from docsift.functions.rules import reasons
from docsift.operators import layout as ly
from docsift.operators import projects as pj
from docsift.operators.keyword_hits import with_layers_by_hits
from docsift.operators.section_windows import with_blocks
from docsift.plans import layout_oracles
from docsift.plans.rough import AS_IT_IS, ORACLES, QUERIES, First, python_call, register, texts, with_layers
from docsift.plans.sectioned import CLEAN_SECTIONS, SECTIONS

# Fixed values
FLAGS = {"skills": "has_skills_section", "education": "has_education_section", "experience": "has_experience_section", "projects": "has_projects_section", "achievements": "has_achievements_section", "languages": "has_languages_section", "interests": "has_interests_section", "summary": "has_objective_section"}
ROLES = ("intern", "developer", "engineer", "analyst", "trainee", "frontend")
SCREEN_SETS = {"programming_languages_count": ("python", "java", "javascript", "php", "c", "c++"), "framework_count": ("react", "angular", "express", "nodejs", "django", "flask"), "database_count": ("mysql", "mongodb", "sql", "postgresql", "sqlite", "firebase")}
DATE_RANGE = r"(?:\d{1,2}/)?(?:19|20)\d{2}\s*[-–—]\s*(?:\d{1,2}/)?(?:19|20)\d{2}"
ALLOWED = ("skills", "education", "projects", "experience", "achievements", "languages", "interests", "summary")


def register_python(name: str, columns: list[str], layers: Callable[[Spark, Callable, Callable], list[dict[str, str]]], base: str = "both", first: First = AS_IT_IS) -> None:
    """A query with Arrow UDFs; layers are given how to match tokens and how to cut lines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        match, cut = sk.register_close_skills(spark), pj.register_cut_projects(spark)
        out = with_layers(first.frame(texts(spark, sf_dir, base)), layers(Spark(), python_call(match), python_call(cut)))
        return out.select("doc_id", *columns)

    run.__name__ = name
    QUERIES[name] = run


def cut_parts(d: Spark, cut) -> list[dict[str, str]]:
    """Layers project_names, project_durations, project_texts; without a cutter a line is a project, named up to its colon."""
    if cut:
        return [{"cut": cut("project_lines")}, {"project_names": "cut.name", "project_durations": "cut.duration", "project_texts": "cut.description"}]
    return [{"project_names": d.each("project_lines", "x", d.strip(d.part("x", "^([^:]*)", 1))), "project_durations": d.each("project_lines", "x", "''"), "project_texts": d.each("project_lines", "x", d.strip(d.sub("x", "^[^:]*:")))}]


def identity(d: Spark) -> list[dict[str, str]]:
    """Layers identity_name, identity_email, identity_phone, identity_location: the entity, else from the sections, the
    name else from the first lines."""
    top = f"CASE WHEN {d.size('summary_lines')} > 0 THEN summary_lines ELSE coalesce({d.at('canon_lines', '1')}, {d.empty()}) END"
    return [
        {"summary_lines": hd.lines_of(d, "summary"), "every_line": d.flat("canon_lines")},
        {"top_lines": d.take(top, 3)},
        {
            "identity_name": f"coalesce(name, {en.section_name(d, 'top_lines')}, {en.section_name(d, d.take('doc_lines', 5))})",
            "identity_email": f"coalesce(email, {en.found_part(d, d.join_lines('every_line'), en.EMAIL, 0)})",
            "identity_phone": f"coalesce(phone, {d.first(d.where(d.each('every_line', 'x', d.part('x', en.PHONE_B, 0)), 'y', "y <> ''"))})",
            "identity_location": f"coalesce(location, {d.first(d.where(d.each('every_line', 'x', en.identity_place(d, 'x')), 'y', 'y IS NOT NULL'))})",
        },
    ]


def section_layers(d: Spark, text: str = "text") -> list[dict[str, str]]:
    """Sections under their own names within the row, where no windows over lines can be had."""
    return [*en.lines_layer(d, text), *hd.sections(d), *hd.canonical(d)]


def project_layers(d: Spark, cut) -> list[dict[str, str]]:
    return [*hd.canonical(d), *pj.project_lines(d), *cut_parts(d, cut)]


def skill_layers(d: Spark, match) -> list[dict[str, str]]:
    return sk.built(d, match, d.join_lines(hd.lines_of(d, "skills")), "''", "raw", sk.enriching(d, "project_texts"))


def record(d: Spark, match, cut) -> list[dict[str, str]]:
    """Layers of a whole record from the cleaned text ``raw`` and its sections: identity, projects, skills, education,
    experience and the lines of the other sections."""
    lists = {"education_lines": "education", "achievement_lines": "achievements", "interest_lines": "interests", "language_lines": "languages", "experience_lines": "experience"}
    return [
        *hd.canonical(d),
        *en.email_first(d), *en.phone_first(d), *en.name_first(d), *en.place_first(d), *identity(d),
        *pj.project_lines(d), *cut_parts(d, cut), *skill_layers(d, match),
        {k: hd.lines_of(d, s) for k, s in lists.items()},
        {"experience": rc.clean_experience(d, "experience_lines"), "education_text": d.join("education_lines"), "project_strings": d.each(d.count_to(d.size("project_names")), "i", d.squeeze(f"{d.at('project_names', 'i')} || ' ' || {d.at('project_durations', 'i')} || ' ' || {d.at('project_texts', 'i')}"))},
        *rc.education(d, "education_text"),
    ]


def section_flags(d: Spark) -> list[dict[str, str]]:
    """NB15: flags of what the record has, their number and the share of the four key ones."""
    arrays = {"skills": "skills", "education": "education_lines", "experience": "experience", "projects": "project_strings", "achievements": "achievement_lines", "languages": "language_lines", "interests": "interest_lines", "summary": "summary_lines"}
    made = {name: flag(d.some(arrays[k], "x", f"{d.strip('x')} <> ''")) for k, name in FLAGS.items()}
    return [made, {"section_count": " + ".join(made), "section_completeness_score": "round((has_skills_section + has_education_section + has_experience_section + has_projects_section) / 4.0D, 2)"}]


def screened_name(d: Spark, x: str) -> str:
    n = d.sub(x, rf"(?i)^[{WHITE}]*(?:project name:|project:|other projects?)[{WHITE}]*")
    n = d.sub(d.sub(d.strip(n), rf"[{WHITE}]{{2,}}", " "), r"^[ \-:]+|[ \-:]+$")
    return f"CASE WHEN {d.among(f'upper({n})', ('PROJECTS', 'OTHER PROJECTS', 'PROJECT'))} THEN '' ELSE {n} END"


def screened_text(d: Spark, x: str) -> str:
    t = d.sub(d.strip(d.sub(x, rf"(?i)\bdescription:[{WHITE}]*")), DATE_RANGE)
    t = d.sub(d.sub(t, rf"[{WHITE}]{{2,}}", " "), r"^[ ,.\-]+|[ ,.\-]+$")
    return d.strip(d.sub(t, rf"(?i)\blike\b[{WHITE}]*$"))


def screening(d: Spark) -> list[dict[str, str]]:
    """NB16 and QS14 on a record: refined skills, projects, role and education, then rejects, score and decision."""
    role = f"CASE WHEN contains(lower(line_), 'frontend') AND contains(lower(line_), 'intern') THEN 'frontend intern' ELSE {d.strip('line_')} END"
    kept = d.where(d.count_to(d.size("screen_names")), "i", f"{d.at('screen_names', 'i')} <> '' AND {d.at('screen_texts', 'i')} <> ''")
    return [
        *sk.refined(d, "skills", d.concat("project_texts", "experience")),
        {"screen_names": d.each("project_names", "x", screened_name(d, "x")), "screen_texts": d.each("project_texts", "x", screened_text(d, "x")), "line_": d.first(d.where("experience", "x", d.any("lower(x)", ROLES)))},
        {"kept_projects": kept, "role": f"coalesce({role}, '')"},
        {
            "skills_count": d.size("refined"), "projects_count": d.size("kept_projects"), "has_projects": flag(f"{d.size('kept_projects')} > 0"), "has_experience": flag("role <> ''"), "has_internship": flag("contains(lower(role), 'intern')"),
            "degree_code": "CASE WHEN degree_type = 'bachelor' THEN 1 ELSE 0 END", "grade_score": "score", "screen_location": rc.screen_location(d, "identity_location"),
            **{k: d.size(d.where("refined", "x", d.among("x", names))) for k, names in SCREEN_SETS.items()},
        },
        {"reject_reasons": reasons({"no_email": "identity_email IS NULL", "no_phone": "identity_phone IS NULL", "no_skills": "skills_count = 0", "no_projects_and_no_experience": "projects_count = 0 AND has_experience = 0"})},
        *rules.SCREEN[2:],
    ]


def _shown(d: Spark, *arrays: str) -> dict[str, str]:
    return {f"{a}_": d.join(a, "|") for a in arrays}


_SHORT = "doc_lines"
register("nb1_exact_skills", ["found_", "n_typos"], lambda d: [*en.lines_layer(d), *sk.extracted(d, "raw", "found", sk.exact_skills(d)), {"found_": d.join("found", "|"), "n_typos": "found_typos"}])
register_python("nb1_skills", ["found_", "n_typos"], lambda d, match, cut: [*en.lines_layer(d), *sk.extracted(d, "raw", "found", match), {"found_": d.join("found", "|"), "n_typos": "found_typos"}])
register("nb2_exact_build_skills", ["skills_"], lambda d: [*project_layers(d, None), *skill_layers(d, sk.exact_skills(d)), _shown(d, "skills")], first=SECTIONS)
register_python("nb2_build_skills", ["skills_"], lambda d, match, cut: [*project_layers(d, cut), *skill_layers(d, match), _shown(d, "skills")], first=SECTIONS)
register("nb3_project_skills", ["words_"], lambda d: [*en.lines_layer(d), {"words": sk.enriching(d, "doc_lines")}, _shown(d, "words")])


def _merged(d, match):
    given = d.join_lines(d.concat(d.array("'SQL, excel'", "'Pyhton'"), hd.lines_of(d, "skills")))
    return [
        *hd.canonical(d), *en.email_first(d), *en.phone_first(d), {"given": given}, *sk.extracted(d, "given", "found", match),
        {"merged_": d.join(d.sorted("found"), "|"), "n_typos": f"found_typos + CASE WHEN {rc.email_typo(d, 'email')} IS NULL THEN 0 ELSE 1 END + CASE WHEN {rc.phone_typo(d, 'phone')} IS NULL THEN 0 ELSE 1 END"},
    ]


register("nb4_exact_merged_skills", ["merged_", "n_typos"], lambda d: _merged(d, sk.exact_skills(d)), first=SECTIONS)
register_python("nb4_merged_skills", ["merged_", "n_typos"], lambda d, match, cut: _merged(d, match), first=SECTIONS)
register("nb6_project_lines", ["project_lines_"], lambda d: [*hd.canonical(d), *pj.project_lines(d), _shown(d, "project_lines")], first=SECTIONS)
_CUT = {"projects": "array_join(transform(cut, p -> p.name || '~' || p.duration || '~' || p.description), '|')"}
register_python("nb7_projects", ["projects"], lambda d, match, cut: [*project_layers(d, cut), _CUT], first=SECTIONS)
register(
    "nb8_project_texts", ["names_", "tales_"],
    lambda d: [*en.lines_layer(d), {"names": d.each("doc_lines", "x", pj.clean_name(d, "x")), "tales": d.each("doc_lines", "x", pj.clean_description(d, "x"))}, _shown(d, "names", "tales")],
)
_INTERN = flag("exists(cut, p -> contains(lower(p.name || ' ' || p.description), 'intern'))")
register_python("nb9_project_counts", ["n_projects", "has_internship"], lambda d, match, cut: [*project_layers(d, cut), {"n_projects": "size(cut)", "has_internship": _INTERN}], first=SECTIONS)
register(
    "nb11_education_getters", ["degree", "is_it", "cgpa"],
    lambda d: [*hd.canonical(d), {"education_lines": hd.lines_of(d, "education")}, {"education_text": d.join("education_lines")}, *rc.education(d, "education_text"),
               {"degree": f"CASE WHEN {d.size('education_lines')} > 0 THEN degree_type ELSE 'unknown' END", "is_it": f"CASE WHEN {d.size('education_lines')} > 0 THEN is_it_candidate ELSE 0 END", "cgpa": f"CASE WHEN {d.size('education_lines')} > 0 THEN score ELSE 0.0D END"}],
    first=SECTIONS,
)
_IDENTITY = ["identity_name", "identity_email", "identity_phone", "identity_location"]
register("en8_identity", _IDENTITY, lambda d: [*hd.canonical(d), *en.email_first(d), *en.phone_first(d), *en.name_first(d), *en.place_first(d), *identity(d)], first=SECTIONS)
_EXACT = lambda d: record(d, sk.exact_skills(d), None)
register("nb15_section_flags", [*FLAGS.values(), "section_count", "section_completeness_score"], lambda d: [*_EXACT(d), *section_flags(d)], first=CLEAN_SECTIONS)
_SCREENED = ["refined_", "role", "skills_count", "programming_languages_count", "framework_count", "database_count", "projects_count", "screen_location", "reject_reasons", "screen_score", "decision"]
register("nb16_qs14_exact_screening", _SCREENED, lambda d: [*_EXACT(d), *screening(d), _shown(d, "refined")], first=CLEAN_SECTIONS)
register_python("nb16_qs14_screening", _SCREENED, lambda d, match, cut: [*record(d, match, cut), *screening(d), _shown(d, "refined")], first=CLEAN_SECTIONS)


def feature_inputs(d: Spark) -> dict[str, str]:
    """What the features call the parts of a record."""
    return {
        "name": "identity_name", "email": "identity_email", "phone": "identity_phone", "location": "identity_location", "lines": "doc_lines", "sections": "canon_names", "section_lines": d.size(d.flat("canon_lines")),
        "edu": "education_lines", "exp": "experience", "proj": "project_strings", "ach": "achievement_lines", "lang_lines": "language_lines", "skill_lines": "skills", "skills": "skills", "langs": "language_lines",
    }


def records(spark: SparkSession, frame: DataFrame, keep: tuple[str, ...] = (), deadline: float | None = 30.0) -> DataFrame:
    """Assembled records of (doc_id, text): identity, sections, lists, projects and all features of the catalogue.
    Columns ``keep`` go along; doc_id tells rows apart. ``status`` is ok, the row's own ``error`` if it has such a column, or
    that its projects took longer than the deadline in seconds, if there is one; a row that isn't ok has what could be made of it."""
    match, cut = sk.register_close_skills(spark), pj.register_cut_projects(spark, deadline)
    d = Spark()
    # a stream has no windows over lines: there the same sections are made within the row
    made = with_layers(frame, CLEAN_SECTIONS.layers(d)) if frame.isStreaming else CLEAN_SECTIONS.frame(frame)
    made = with_layers(made, record(d, python_call(match), python_call(cut)))
    late = "'ok'" if deadline is None else f"CASE WHEN cut IS NULL THEN 'projects: over {deadline:g} s' ELSE 'ok' END"
    status = f"coalesce(error, {late})" if "error" in frame.columns else late
    contact = f"CASE WHEN {rc.email_typo(d, 'identity_email')} IS NULL THEN 0 ELSE 1 END + CASE WHEN {rc.phone_typo(d, 'identity_phone')} IS NULL THEN 0 ELSE 1 END"
    kept = [*keep, f"{status} AS status", f"skills_1_typos + skills_2_typos + skills_3_typos + {contact} AS typos", "degree_type","is_it_candidate", "score AS education_score", "summary_lines", "interest_lines", "cut AS projects"]
    made = made.selectExpr("doc_id", "raw", *[f"{v} AS {k}" for k, v in feature_inputs(d).items()], *kept)
    return with_layers_by_hits(made, features.layers, features.SCANNED)


register(
    "g01_g11_record_features", features.ALL, lambda d: [*_EXACT(d), Only({"doc_id": "doc_id", "raw": "raw", **feature_inputs(d)}), *features.layers(d)],
    base="rough", first=CLEAN_SECTIONS, scanned=features.SCANNED,
)


def nb14_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled records of documents and rough candidates, lists as joined strings."""
    # no row says here that it isn't ok, so all are made to their end
    made = records(spark, texts(spark, sf_dir), deadline=None)
    lists = {"sections", "edu", "exp", "proj", "ach", "skills", "langs", "summary_lines", "interest_lines"}
    names = [f for layer in features.layers(Spark(), tuple(features.GROUPS)) for f in layer]
    return made.selectExpr("doc_id", "name", "email", "phone", "location", "degree_type", "education_score", "typos", *[f"array_join({c}, '|') AS {c}_" for c in sorted(lists)], *names)


QUERIES["nb14_records"] = nb14_records


def _strategies(d: Spark) -> list[dict[str, str]]:
    """Three ways to sections as arrays of names and of lines: s1 by headers, s2 by blocks, s3 by routes of lines."""
    routes = ("languages", "education", "projects", "experience", "achievements", "skills", "summary", "interests")
    return [
        {"lines": d.each("doc_lines", "x", d.strip("x"))},
        {"routed_lines": d.where("lines", "x", "x <> ''")},
        {"low_routed": d.each("routed_lines", "x", "lower(x)")},
        {"routed": d.each("low_routed", "x", rc.route(d, "x", lowered=True))},
        {"s3_every": d.array(*[d.each(d.where(d.count_to(d.size("routed")), "i", f"{d.at('routed', 'i')} = '{r}'"), "i", d.at("routed_lines", "i")) for r in routes]), "route_names": d.array(*[f"'{r}'" for r in routes])},
    ]


def qs10_qs12_multi_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QS10, QS11, QS12: of three strategies the quality of each, and the best skills, projects and experience of any."""
    match, cut = sk.register_close_skills(spark), pj.register_cut_projects(spark)
    d = Spark()
    base = with_layers(with_blocks(CLEAN_SECTIONS.frame(texts(spark, sf_dir, "rough"))), _strategies(d))
    each = base.selectExpr(
        "doc_id", "raw", "doc_lines",
        "posexplode(array(struct(section_names AS n, section_lines AS l), struct(block_names AS n, block_lines AS l), struct(route_names AS n, s3_every AS l))) AS (strategy, found)",
    )
    each = each.selectExpr("doc_id", "raw", "doc_lines", "strategy", "found.n AS section_names", "found.l AS section_lines")
    steps = [*hd.canonical(d), *pj.project_lines(d), *cut_parts(d, python_call(cut)), *skill_layers(d, python_call(match)), {"experience": rc.clean_experience(d, hd.lines_of(d, "experience")), "languages": hd.lines_of(d, "languages"), "education_lines": hd.lines_of(d, "education")}]
    made = with_layers(each, [*steps, *quality(d)])
    best = "max_by({0}, struct({1}, -strategy)) AS {0}"
    picked = [best.format("strategy", "parse_quality").replace("AS strategy", "AS base_strategy"), "max(parse_quality) AS parse_quality", *[best.format(c, f"size({c})") for c in ("valid_skills", "valid_projects", "valid_experience")]]
    out = made.groupBy("doc_id").agg(*map(F.expr, picked))
    return out.selectExpr("doc_id", "base_strategy", "parse_quality", *[f"array_join({c}, '|') AS {c}_" for c in ("valid_skills", "valid_projects", "valid_experience")])


def quality(d: Spark) -> list[dict[str, str]]:
    """parse_quality (ten points for each of seven checks, up to ten for projects, education and skills), and the parts
    that are valid: known skills of three words at most, projects with a name and a description, lines of work."""
    date_only = rf"(?i)^{pj.DATE_ONLY.replace('(?i)', '')}$"
    checks = {
        "allowed": f"NOT {d.some('canon_names', 's', f'NOT {d.among('s', ALLOWED)}')}", "no_unknown": f"NOT {d.some('canon_names', 's', "s LIKE 'unknown_%'")}", "dedup": f"{d.size('skills')} = {d.size(d.distinct('skills'))}",
        "no_sentence": f"NOT {d.some('skills', 's', f'{d.n_words('s')} > 3 OR {d.match('s', '[.!?]')}')}", "spoken": f"NOT {d.some('languages', 's', f'NOT {d.among('lower(s)', rc.ROUTES['languages'])}')}",
        "name_not_date": f"NOT {d.some('project_names', 's', d.match(d.strip('s'), date_only))}", "text_no_date": f"NOT {d.some('project_texts', 's', d.match('lower(s)', rc.DATE_RANGE))}",
    }
    score = " + ".join(f"CASE WHEN {c} THEN 10 ELSE 0 END" for c in checks.values())
    score += f" + least(10, {d.size('project_names')} * 2) + CASE WHEN {d.size('education_lines')} > 0 THEN 2 ELSE 0 END + least(10, CAST(floor({d.size('skills')} / 2) AS INT))"
    low = d.each("skills", "s", d.strip("lower(s)"))
    fits = f"{d.at('project_names', 'i')} <> '' AND NOT {d.match(d.at('project_names', 'i'), date_only)} AND {d.at('project_texts', 'i')} <> '' AND ({d.at('project_durations', 'i')} <> '' OR NOT {d.match(f'lower({d.at('project_texts', 'i')})', rc.DATE_RANGE)})"
    shown = d.squeeze(f"{d.at('project_names', 'i')} || ' ' || {d.at('project_durations', 'i')} || ' ' || {d.at('project_texts', 'i')}")
    pastime, work = ("hackathon", "club", "activity", "activities"), ("intern", "developer", "engineer", "analyst", "trainee", "role", "worked", "experience")
    return [
        {
            "parse_quality": score, "valid_skills": d.distinct(d.where(low, "s", f"{d.among('s', rc.TECH_TOKENS)} AND {d.n_words('s')} <= 3")),
            "valid_projects": d.each(d.where(d.count_to(d.size("project_names")), "i", fits), "i", shown), "valid_experience": d.where("experience", "s", f"s <> '' AND NOT {d.any('lower(s)', pastime)} AND {d.any('lower(s)', work)}"),
        }
    ]


QUERIES["qs10_qs11_qs12_multi_pass"] = qs10_qs12_multi_pass


def _exact_quality(d):
    return [*_EXACT(d), {"languages": "language_lines"}, *quality(d), _shown(d, "valid_projects", "valid_experience"), {"valid_skills_": d.join(d.sorted("valid_skills"), "|")}]


register("qs10_qs11_exact_quality", ["parse_quality", "valid_skills_", "valid_projects_", "valid_experience_"], _exact_quality, first=CLEAN_SECTIONS)


# Layouts: half of the texts are pages of two columns, made from the key alone.
_PAGE = "repeat('word ', 4 + (k + i) % 9) || repeat(' ', (k % 4) * 5) || CASE k % 3 WHEN 0 THEN 'r' ELSE 'R' END || 'ight side text of it number ' || CAST(i AS STRING) || repeat(' more', k % 9)"


def _pages(d: Spark) -> list[dict[str, str]]:
    made = d.each(d.count_to("6 + k % 12"), "i", f"CASE WHEN i % 7 = 6 THEN '' ELSE {_PAGE} END")
    return [*en.lines_layer(d), {"k": "CAST(doc_id % 1000 AS INT)"}, {"page_lines": f"CASE WHEN doc_id % 2 = 0 THEN {made} ELSE doc_lines END"}]


register("ly2_single_column", ["single"], lambda d: [*_pages(d), *rc.columns_by_gap(d, "page_lines"), *ly.split_at_mode(d, "page_lines", "layout_type")])
register("ly5_linear_columns", ["linear"], lambda d: [*_pages(d), *rc.columns_by_middle(d, "page_lines"), *ly.split_at_gaps(d, "page_lines", "two_columns")])


def _layout_query(name: str, columns: list[str], made: Callable[[str, str], list[dict[str, str]]]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        of_blocks, of_recovered = ly.register_layout(spark)
        return with_layers(texts(spark, sf_dir), [*en.lines_layer(Spark()), *made(of_blocks, of_recovered)]).select("doc_id", *columns)

    run.__name__ = name
    QUERIES[name] = run


_layout_query("ly6_blocks", ["blocks"], lambda b, r: [{"cut": f"{b}(doc_lines)"}, {"blocks": "array_join(transform(cut, x -> x.type || '@' || x.start_line || ':' || array_join(x.content, ' / ')), chr(10))"}])
_layout_query("ly7_block_filters", ["headings", "bullet_groups"], lambda b, r: [{"cut": f"{b}(doc_lines)"}, {"headings": "array_join(transform(filter(cut, x -> x.type = 'heading'), x -> array_join(x.content, ' / ')), '|')", "bullet_groups": "size(filter(cut, x -> x.type = 'bullet_group'))"}])
_layout_query("ly8_recovered_projects", ["recovered"], lambda b, r: [{"recovered": f"array_join({r}(doc_lines), '|')"}])
ORACLES |= {"ly6_blocks": layout_oracles.LY6, "ly7_block_filters": layout_oracles.LY7, "ly8_recovered_projects": layout_oracles.LY8}

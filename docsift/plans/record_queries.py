"""Queries of the record rules, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from docsift.functions import records as rc
from docsift.functions.dialect import DuckDB, Spark, flag
from docsift.plans.profiles import PARTS, candidates, duckdb_sql, profiles
from docsift.plans.resumes import DUCKDB, resumes, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Documents and candidates, in ASCII with plain newlines.
_TEXTS = "SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), {pattern}) AS text FROM {texts}"
#: Contacts, education lines and layouts of every kind that the rules tell apart.
_CUSTOMERS = """SELECT c_custkey AS doc_id,
  CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Asha Patel' WHEN 2 THEN 'Asha' ELSE 'A. B. C. D. E' END AS name,
  'u' || CAST(c_custkey AS STRING) || CASE c_custkey % 6 WHEN 0 THEN '@gamil.com' WHEN 1 THEN '@Yaho.com' WHEN 2 THEN '@example.com' WHEN 3 THEN '' WHEN 4 THEN '@outlok.com' ELSE '@x' END AS email,
  CASE c_custkey % 4 WHEN 0 THEN '+91' ELSE '' END || repeat('7', CAST(c_custkey % 17 AS INT)) AS phone,
  CASE c_custkey % 7 WHEN 0 THEN ' Pune ' WHEN 1 THEN 'Acme Technologies Ltd' WHEN 2 THEN 'Pune (East)' WHEN 3 THEN '' WHEN 4 THEN 'one two three four five six seven' WHEN 5 THEN 'www.site.in' END AS location,
  CASE c_custkey % 9 WHEN 0 THEN 'B.Tech in Computer Science CGPA: 8.94' WHEN 1 THEN 'Diploma, gpa 85%' WHEN 2 THEN 'M.Tech CPI - 9.5/10' WHEN 3 THEN 'cgpa 3.4.5' WHEN 4 THEN 'BE ECE CGPA 0 gpa: 7,5'
    WHEN 5 THEN 'Master of arts gpa 85/100' WHEN 6 THEN 'High school' WHEN 7 THEN 'cgpa -6.2' ELSE 'gpa 12 Diploma in information technology' END AS education,
  CAST(c_custkey % 1000 AS INT) AS k FROM {customer}"""
_LINE = "repeat('word ', 4 + (k + i) % 9) || repeat(' ', (k % 4) * 5) || CASE k % 3 WHEN 0 THEN 'r' ELSE 'R' END || 'ight side text of it number ' || CAST(i AS STRING) || repeat(' more', k % 9)"


def _register(name: str, base: str, columns: list[str], layers) -> None:
    """layers gives those of an engine; base is 'texts' or 'customers'."""

    def run(spark, sf_dir):
        if base == "texts":
            docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
            both = docs.union(resumes(spark, sf_dir).selectExpr("doc_id + 1000000000", "text"))
            out = spark.sql(_TEXTS.replace("{pattern}", r"r'[^\x00-\x7F]+', ''"), texts=both)
        else:
            out = spark.sql(_CUSTOMERS, customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")))
        for layer in layers(Spark()):
            out = out.selectExpr("*", *[f"{v} AS {k}" for k, v in layer.items()])
        return out.select("doc_id", *columns)

    d = DuckDB()
    both = f"(SELECT doc_id, text FROM documents UNION ALL SELECT 1000000000 + doc_id, text FROM ({DUCKDB}))"
    first = _TEXTS.format(pattern=r"'[^\x00-\x7F]+', '', 'g'", texts=both) if base == "texts" else _CUSTOMERS.format(customer="customer")
    sql, steps = f"WITH t0 AS ({first})", layers(d)
    for k, layer in enumerate(steps):
        sql += f",\nt{k + 1} AS (SELECT *, " + ", ".join(f"{d.render(v)} AS {n}" for n, v in layer.items()) + f" FROM t{k})"
    QUERIES[name], ORACLES[name] = run, f"{sql}\nSELECT doc_id, {', '.join(columns)} FROM t{len(steps)}"


def _facts(d):
    number = lambda f, **k: d.size(d.where("lines", "x", f(d, "x", **k)))
    return [
        {"lines": d.each(d.lines("text"), "x", rc.strip(d, "x"))},
        {"n_urls": d.size(rc.urls(d, "text")), "n_years": d.size(rc.years(d, "text")), "n_tokens": d.size(rc.tokens(d, "text", ("the", "and"))), "n_noise": number(rc.is_noise_line, stripped=True), "n_contact": number(rc.is_contact_line), "n_header": number(rc.is_header_line, stripped=True)},
    ]


def _contacts(d):
    valid = {"name": rc.valid_name, "email": rc.valid_email, "phone": rc.valid_phone, "location": rc.valid_location}
    fixed = {"location_or_null": rc.location_or_null, "location_or_unknown": rc.location_or_unknown, "screen_location": rc.screen_location}
    return [{f"valid_{k}": flag(f(d, k)) for k, f in valid.items()} | {k: f(d, "location") for k, f in fixed.items()} | {"email_typo": rc.email_typo(d, "email"), "phone_typo": rc.phone_typo(d, "phone")}]


def _experience(d):
    return [
        {"lines": d.each(d.lines("text"), "x", rc.strip(d, "x"))},
        {"roles": rc.clean_experience(d, "lines")},
        {"experience": d.join(d.sorted("roles"), "|"), "n_roles": d.size("roles"), "has_internship": rc.has_internship(d, "roles")},
    ]


def _routes(d):
    names = [*rc.ROUTES, "skills", "summary", "interests"]
    return [
        {"low_lines": d.each(d.lines("text"), "x", "lower(x)")},
        {"routed": d.each("low_lines", "x", rc.route(d, "x", lowered=True))},
        {f"n_{s}": d.size(d.where("routed", "x", f"x = '{s}'")) for s in names},
    ]


def _layout(d):
    return [{"lines": d.each(d.upto("6 + k % 12"), "i", _LINE)}, *rc.columns_by_gap(d, "lines"), *rc.columns_by_middle(d, "lines")]


_register("en11_en12_line_facts", "texts", ["n_urls", "n_years", "n_tokens", "n_noise", "n_contact", "n_header"], _facts)
_register("en9_en10_en13_nb5_contacts", "customers", [*_contacts(Spark())[0]], _contacts)
_register("nb10_education", "customers", ["degree_type", "is_it_candidate", "score"], lambda d: rc.education(d, "education"))
_register("nb12_nb13_experience", "texts", ["experience", "n_roles", "has_internship"], _experience)
_register("se9_line_routes", "texts", [*_routes(Spark())[1]], _routes)
_register("ly1_ly3_ly4_layout", "customers", ["layout_type", "gap_lines", "valid_lines", "two_columns", "n_wide", "n_cut"], _layout)


def _confidence(d):
    return [layer for k, s in PARTS.items() for layer in rc.section_confidence(d, k, s, f"confidence_{s}")]


def _section_confidence(spark, sf_dir):
    out = profiles(candidates(spark, sf_dir))
    for layer in _confidence(Spark()):
        out = out.selectExpr("*", *[f"{v} AS {k}" for k, v in layer.items()])
    return out.select("doc_id", *[f"confidence_{s}" for s in PARTS.values()])


QUERIES["se7_section_confidence"] = _section_confidence
ORACLES["se7_section_confidence"] = duckdb_sql([f"confidence_{s}" for s in PARTS.values()], (), _confidence(DuckDB()))

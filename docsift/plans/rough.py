"""Texts that exercise every rule: whole documents and rough candidates, and queries that put rules over them.

A rough candidate has what extraction leaves behind: CR line ends, broken and spaced words, glyph bullets, headers cut in
two, misspelt skills, addresses with blanks, ligatures. The same SQL makes it in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docsift.functions.dialect import DuckDB, Only, Spark
from docsift.operators.keyword_hits import with_layers_by_hits
from docsift.plans.resumes import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _pick(n: int, *lines: str) -> str:
    """One of the lines by key modulo n; ``|`` ends a line, missing ones are empty."""
    cases = "".join(f" WHEN {k} THEN '" + x.replace("|", "' || chr(10) || '") + "' || chr(10)" for k, x in enumerate(lines))
    return f"CASE c_custkey % {n}{cases} ELSE '' END"


_PARTS = (
    _pick(8, "RAVI KUMAR SHAH", "Name: Asha Patel", "Neha  Rathod", "Résumé of a candidate", "PRIYA O`NEIL-SEN", "Software Engineer", "I am Kiran Dave and I like rivers"),
    _pick(6, "asha.patel@gmail.com , +91 98765 43210", "Mail : ravi @ example.com", "neha@outlok.comPhone 9876543210", "079-2658 1234", "Phone: +919876543210"),
    _pick(5, "Ahmedabad, Gujarat, India", "Flat 12, near Surat road, 395001", "navi mumbai", "ravi@example.com Pune.", "Berlin"),
    _pick(4, "linkedin.com/in/asha-patel_1", "github.com/ashap  ", "www.asha-portfolio.in/blog", "https://site.example.org/x?y=1"),
    _pick(3, "", "  "),
    _pick(7, "P R O F I L E", "Career Objective", "PROFESSIONAL|SUMMARY", "About Me:", "Summary", "OBJECTIVE;"),
    _pick(2, "Motivated graduate seeking a role, inter-|active and driven", "Ravi Shah"),
    _pick(6, "Technical Skills", "• My Skills", "CORE|COMPETENCIES", "T E C H S K I L L S", "SKILLS:", "Tech Stack"),
    _pick(3, "• Languages: Python, JavaScript, C++ / pyhton", "My SQL, Power BI, TeamWork, H TM L a b c", "kubernets ; dockr & react / react native; Jan 2020"),
    _pick(4, "● MongoDB; Express JS (basic) & Node JS", "▪ mysql, Mysql, 2019, machine learning", "html", "deep learning -  computer vision"),
    _pick(5, "EDUCATION|B.Tech Computer Science, CGPA: 8.2|Gujarat University", "Academic Background|Diploma in IT 85%", "Education|MCA from Some Institute, gpa 9.1/10", "Schooling|High school"),
    _pick(4, "PROFESSIONAL|EXPERIENCE", "Work Experience", "Internships", "work|experience"),
    _pick(5, "Software Developer Intern at Acme 2020 - 2021|Developed a booking system for clients", "Backend engineer , Beta Labs", "Worked in a company as an intern", "Built web application in react, html and css for a shop"),
    _pick(6, "PROJECTS", "Academic Projects", "", "Key Projects:", "Other Projects"),
    _pick(4, "Smart Farm (Jan 2021)|Developed with Python and react for real-time weather data", "• Chat App: built a rest api using node and socket for team chat|• in two weeks", "- Project Name: Library Portal.|- Description: implemented search in html css javascript", "2019 - 2020|Shop Front|Made with firebase and used by many people"),
    _pick(5, "Internship Tracker|Used by interns of the company in many places", "Portfolio: created a web site with html and css for artists", "Game Of Life|Strengths of the team|developed in java with sql, used in class", "HEALTH APP|implemented rest api in python with jwt auth"),
    _pick(3, "CERTIFICATIONS|AWS certified developer", "Achievements|Won a quiz , first prize"),
    _pick(4, "Languages|English|Hindi", "LANGUAGE|gujarati"),
    _pick(5, "Hobbies|Reading and travel", "Interests|Music"),
    _pick(6, "ofﬁce ½ naïve (cid:12)   x", "Powered by Enhancv rest", "cppJavaPython SQLServer and webApp", "◆ one – two — three four"),
    _pick(4, "DECLARATION|I hereby declare", "vehicleregistration programing databse abcuniversity"),
)
_ROUGH = f"SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN replace({{text}}, chr(10), chr(13) || chr(10)) WHEN c_custkey % 11 = 0 THEN replace({{text}}, chr(10), chr(13)) ELSE {{text}} END AS text FROM (SELECT c_custkey, {' || '.join(_PARTS)} AS t FROM {{customer}})".replace("{text}", "t")
#: Of every base, the SQL of (doc_id, text).
BASES = {
    "rough": _ROUGH,
    "both": "SELECT doc_id, text FROM {documents} UNION ALL SELECT 1000000000 + doc_id, text FROM (" + _ROUGH + ")",
}


def texts(spark: SparkSession, sf_dir: str, base: str = "both") -> DataFrame:
    customer = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    if base == "rough":
        return spark.sql(BASES[base], customer=customer)
    return spark.sql(BASES[base], documents=spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), customer=customer)


def python_call(name: str) -> Callable[[str], str]:
    """SQL that calls an Arrow UDF on a column. The column is named twice, so that the optimizer leaves it a column: a UDF
    over an expression with lambdas isn't recognised as Python."""
    return lambda x: f"{name}(if(size({x}) < 0, NULL, {x}))"


def with_layers(frame: DataFrame, layers: list[dict[str, str]]) -> DataFrame:
    for layer in layers:
        frame = frame.selectExpr(*Only.columns(layer))
    return frame


def duckdb_layers(base: str, layers: list[dict[str, str]], final: str) -> str:
    d = DuckDB()
    sql = f"WITH t0 AS ({BASES[base].format(documents='documents', customer='customer')})"
    for k, layer in enumerate(layers):
        sql += f",\nt{k + 1} AS (SELECT " + ", ".join(map(d.render, Only.columns(layer))) + f" FROM t{k})"
    return f"{sql}\n{final.format(table=f't{len(layers)}')}"


@dataclass(frozen=True)
class First:
    """What comes before the layers of a query: steps over a frame of (doc_id, text) and the layers that do the same in SQL."""

    frame: Callable[[DataFrame], DataFrame]
    layers: Callable[[Spark], list[dict[str, str]]]


AS_IT_IS = First(lambda frame: frame, lambda d: [])


def register(name: str, columns: list[str], layers: Callable[[Spark], list[dict[str, str]]], base: str = "both", first: First = AS_IT_IS, scanned: tuple[str, ...] = ()) -> None:
    """A query of doc_id and the columns that the layers make of (doc_id, text), and its DuckDB form. ``scanned``: texts
    in which many keywords are looked for at once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return with_layers_by_hits(first.frame(texts(spark, sf_dir, base)), layers, scanned).select("doc_id", *columns)

    run.__name__ = name
    QUERIES[name] = run
    d = DuckDB()
    ORACLES[name] = duckdb_layers(base, [*first.layers(d), *layers(d)], f"SELECT doc_id, {', '.join(columns)} FROM {{table}}")

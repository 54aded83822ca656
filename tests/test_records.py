"""Record rules against values worked out by hand."""

import pytest

from docsift.functions import records as rc
from docsift.functions.dialect import Spark

D = Spark()


def values(spark, layers, **columns):
    kinds = {str: "string", int: "int", list: "array<string>"}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))
    for layer in layers:
        df = df.selectExpr("*", *[f"{v} AS {k}" for k, v in layer.items()])
    return df.first().asDict()


def value(spark, rule, x):
    return values(spark, [{"y": rule(D, "x")}], x=x)["y"]


@pytest.mark.parametrize(
    ("rule", "x", "want"),
    [
        (rc.urls, "see HTTP://a.b/c and www.d.e, end", ["HTTP://a.b/c", "www.d.e,"]),
        (rc.years, "1999-2024 18990 2100", ["1999", "2024"]),
        (rc.tokens, "The C++ 2020 ab1 x", ["the", "ab1"]),
        (rc.is_noise_line, " AB ", True), (rc.is_noise_line, "HELLO", True), (rc.is_noise_line, "HELLOS", False), (rc.is_noise_line, "-----", True), (rc.is_noise_line, "x" * 201, True),
        (rc.is_contact_line, "call 1234567", True), (rc.is_contact_line, "call 123456", False),
        (rc.is_header_line, "WORK EXPERIENCE", True), (rc.is_header_line, "Work Experience:", False), (rc.is_header_line, "Work of Art", False), (rc.is_header_line, "MY VERY LONG LONG HEADER", False),
        (rc.valid_name, "Asha O'Patel", True), (rc.valid_name, "Asha", False), (rc.valid_name, "Asha P4tel", False),
        (rc.valid_phone, "+91 9876543210", False), (rc.valid_phone, "9876543210", True), (rc.valid_phone, "987654321", False),
        (rc.valid_email, "a.b@c.io", True), (rc.valid_email, "a@b", False),
        (rc.location_or_null, " Pune ", "Pune"), (rc.location_or_null, "Acme Labs", None), (rc.location_or_unknown, "  ", "Unknown"), (rc.screen_location, "Incheon", None),
        (rc.email_typo, "x@Gamil.com", "Email domain typo: 'gamil.com' instead of 'gmail.com'"), (rc.email_typo, "x@gmail.com", None),
        (rc.phone_typo, "12-34", "Incomplete phone number: 12-34"), (rc.phone_typo, "", None),
        (rc.clean_experience, ["software  Developer,", "Hackathon developer", "an engineer. yes", "SOFTWARE developer"], ["software developer"]),
        (rc.route, "speaks English", "languages"), (rc.route, "2019 - 2021", "projects"), (rc.route, "  ", None),
    ],
)
def test_rule(spark, rule, x, want):
    assert value(spark, rule, x) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("B.Tech IT CGPA: 8.94", ("bachelor", 1, 89.4)), ("Diploma gpa 85%", ("diploma", 0, 85.0)), ("M.Tech cpi - 9.5/10", ("master", 0, 95.0)),
        ("gpa 0 cgpa 7,5", ("unknown", 0, 75.0)), ("cgpa -6.2", ("unknown", 0, 62.0)), ("gpa 12", ("unknown", 0, 0.0)), ("", ("unknown", 0, 0.0)),
    ],
)
def test_education(spark, text, want):
    got = values(spark, rc.education(D, "x"), x=text)
    assert (got["degree_type"], got["is_it_candidate"], got["score"]) == want


@pytest.mark.parametrize(("lines", "section", "want"), [([], "skills", None), (["a"], "skills", 0.8), (["a"] * 10, "skills", 1.0), (["a", "b", "c" * 90], "other", 0.75), (["a"] * 5, "other", 0.85)])
def test_section_confidence(spark, lines, section, want):
    assert values(spark, rc.section_confidence(D, "x", section, "c"), x=lines)["c"] == want


def test_layout(spark):
    both = "left side of the page with text" + " " * 30 + "Right side of the page with text"
    got = lambda rule, x: values(spark, rule(D, "x"), x=x)
    assert got(rc.columns_by_gap, [both] * 10)["layout_type"] == "two-column"
    assert got(rc.columns_by_gap, [both] * 9)["layout_type"] == "single-column"
    assert got(rc.columns_by_gap, [both] * 5 + ["y" * 70] * 6)["layout_type"] == "single-column"
    assert got(rc.columns_by_middle, [both] * 10)["two_columns"] == 1
    assert got(rc.columns_by_middle, ["word" * 25] * 10)["two_columns"] == 0

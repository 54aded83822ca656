"""Sections and blocks by windows against the same within the row, and against a plain loop."""

import random

import pytest

from docsift.functions import entities as en
from docsift.functions import headers as hd
from docsift.functions.dialect import Spark
from docsift.operators import section_windows as sw
from docsift.plans.rough import with_layers

LINES = [
    "Skills", "SKILLS", "my skills:", "Technical", "skills", "Work", "Experience", "work experience", "Career", "Objective", "Projects", "project", "Education;", "education", "Languages,", "courses",
    "", "", "   ", "a line", "another  line ", " wide ", "x" * 59, "y" * 2100, "one two three four five six", "Awards & achievements", "Key Projects - 2021", "known", "languages", "Hobbies", "é", "Skills Skills",
]


def _texts():
    r = random.Random(21)
    out = [None, "", "\n", "Skills", "no header at all\nnone", "Skills\n" + "\n".join(f"s{k}" for k in range(700)) + "\nskills\nlast\nProjects\np"]
    return out + [r.choice(["\n", "\r\n", "\n"]).join(r.choice(LINES) for _ in range(r.randrange(1, 40))) for _ in range(150)]


@pytest.fixture(scope="module")
def frame(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(_texts())], "doc_id long, text string, line_ string")
    return with_layers(docs, en.lines_layer(Spark()))


@pytest.mark.parametrize(
    ("windows", "layers", "columns"),
    [
        (sw.with_merged, hd.merged_lines, ["merged"]),
        (sw.with_sections, lambda d: [*hd.sections(d), {"run_titles": d.each("opened", "i", d.at("merged", "i"))}], ["section_names", "section_lines", "run_names", "run_lines", "run_titles"]),
        (sw.with_blocks, hd.blocks, ["block_names", "block_lines"]),
    ],
)
def test_same_as_within_the_row(frame, windows, layers, columns):
    got, want = (sorted(map(repr, f.select("doc_id", "text", "line_", *columns).collect())) for f in (windows(frame), with_layers(frame, layers(Spark()))))
    assert len(got) == len(_texts()) and got == want


def test_blocks_by_a_loop(frame):
    for row in sw.with_blocks(frame).collect():
        names, bodies, open_, new = [], [], None, True
        for line in (x.strip() for x in row.doc_lines):
            head = hd.BLOCK_HEADERS.get(" ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in line.lower()).split()))
            if head or not line:
                open_, new = head or open_, True
            elif open_:
                if new:
                    names.append(open_)
                    bodies.append([])
                bodies[-1].append(line)
                new = False
        want = {}
        for name, body in zip(names, bodies, strict=True):
            want.setdefault(name, []).extend([" ".join(body)] if name in hd.BLOCK_JOINED else body)
        assert dict(zip(row.block_names, row.block_lines, strict=True)) == want and row.block_names == list(want)


def test_lines_are_not_shuffled(frame):
    plan = sw.with_sections(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

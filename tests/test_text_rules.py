"""Rules over texts against results worked out by hand, and against plain Python on random texts."""

import difflib
import random
import re
import unicodedata

import pytest

from docsift.functions import classify as cf
from docsift.functions import cleaning as cl
from docsift.functions import entities as en
from docsift.functions import headers as hd
from docsift.functions import skills as sk
from docsift.functions.dialect import Spark
from docsift.operators import layout as ly
from docsift.operators import projects as pj
from docsift.operators import spelling as sp
from docsift.plans import builder_queries as bq
from docsift.plans.rough import with_layers

D = Spark()


def run(spark, texts, layers, *columns):
    """Rows in order, each a tuple of the columns, or the one column."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = with_layers(frame, layers).select("doc_id", *columns).orderBy("doc_id").collect()
    return [r[1] if len(columns) == 1 else tuple(r)[1:] for r in rows]


STEPS = [
    (cl.newlines, "a\r\nb\rc", "a\n\nb\nc"),
    (cl.join_hyphens, "Inter-\nactive 1-\n2", "Interactive 1-\n2"),
    (cl.drop_artifacts, "x(cid:12)y", "xy"),
    (cl.dash_bullets, "•●▪◦►▸■□◆◇ – x", "---------- – x"),
    (cl.fold_ascii, "Ünï ﬁne ½ ß 𝐀 ㎏", "Uni fine 12  A kg"),
    (cl.close_spaced_headers, "  S K I L L S \nA B C\nS K I L x", "SKILLS\nA B C\nS K I L x"),
    (cl.glue_addresses, "a @ b.comPhone .orgX .inc", "a@b.com Phone .org X .in c"),
    (cl.join_headers, "PROFESSIONAL \n Experience\nwork\n\nexperience", "PROFESSIONAL Experience\nwork experience"),
    (cl.close_letters, "H T M L and a b, My  SQL node js", "HTML and a b, MySQL NodeJS"),
    (cl.close_letters, "My SQL and a b", "My SQL and a b"),
    (cl.split_camel, "javaPython SQLServer", "java Python SQL Server"),
    (cl.isolate_headers, "x\n Skills \ny skills", "x\n\nSkills\n\ny skills"),
    (cl.split_merged, "abcDef abDef", "abc Def abDef"),
    (cl.collapse, "a \t b\n \n\nc", "a b\nc"),
    (cl.pad_sites, " github.com/x Powered by me enhancv.com ", "github.com /x  me"),
]


def test_cleaning_steps(spark):
    for step, text, want in STEPS:
        assert run(spark, [text], cl.layers(D, (step,)), "clean") == [want], step.__name__
    assert run(spark, [None, ""], cl.layers(D, cl.CHAIN), "clean") == ["", ""]


def test_folding_is_decomposition(spark):
    r = random.Random(2)
    texts = ["".join(chr(c) for c in (r.randrange(32, 0x3000) for _ in range(80)) if not 0xD800 <= c < 0xE000) for _ in range(60)]
    texts += ["it\uff07s \uff3c a \ufe68 path\\\uff07"]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert run(spark, texts, cl.layers(D, (cl.fold_ascii,)), "clean") == want


def test_alternate_clean_and_lines(spark):
    text = "– one\r\n• two * three\r\n\r\n  a   b \x0cx"
    assert run(spark, [text], cl.alternate(D, "text"), "clean") == ["• one\n• two • three\na b\nx"]
    assert run(spark, ["a\n\n \nb\n"], cl.normal_spacing(D, "text"), "spaced") == ["a\n\nb"]
    kinds = [{"x": "text"}, {"b": cl.is_bullet(D, "x"), "h": cl.is_heading(D, "x")}]
    lines = ["  ● a", "-x", "□", "a", "WORK HISTORY", "Work History", "Work history", "ONE TWO THREE FOUR FIVE", "END.", "WHY?", "O'Neil", "It2Go", ""]
    assert run(spark, lines, kinds, "b", "h") == [(True, False), (True, False), (True, False), (False, False), (False, True), (False, True), (False, False), (False, False), (False, False), (False, True), (False, True), (False, True), (False, False)]


def test_split_lines_and_case(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\x0bc\x1cd\x85e f", "\r\r\n"]
    assert run(spark, texts, [{"l": D.split_lines("text")}], "l") == [t.splitlines() for t in texts]
    words = ["ABC", "Abc", "A1B", "1", "ÄÖ", "Äö Üb", "aB", "Ab C'D", "x "]
    got = run(spark, words, [{"u": D.upper_case("text"), "t": D.title_case("text"), "s": D.strip("text")}], "u", "t", "s")
    assert got == [(w.isupper(), w.istitle(), w.strip()) for w in words]


def _sections(spark, text):
    names, lines = run(spark, [text], [*en.lines_layer(D), *hd.sections(D), *hd.canonical(D)], "canon_names", "canon_lines")[0]
    return dict(zip(names, lines))


def test_sections(spark):
    text = "intro\nPROFESSIONAL\nEXPERIENCE\na\n\nWork Experience:\nb\nSkills,\n• Skills\nc\nCourses\nd\nexperience\ne\nCAREER\nObjective\nf"
    # the second experience header changes nothing; 'CAREER' opens experience on its own, so 'Objective' opens the summary
    assert _sections(spark, text) == {"experience": ["a", "b", "Skills,", "e"], "skills": ["c"], "achievements": ["d"], "summary": ["f"]}
    assert _sections(spark, "core\ncompetencies\nx\nAREAS OF\nEXPERTISE\ny") == {"skills": ["x", "y"]}
    long = "Skills\n" + "\n".join(f"l{k}" + ("" if k % 2 else "\n") for k in range(600)) + "\nProjects\n" + "p" * 2000 + "\nq"
    got = _sections(spark, long)
    # 500 lines of a run, blank ones counted: l0, blank, l1, l2, blank, l3, ...
    assert len(got["skills"]) == 333 and got["projects"] == ["q"]
    assert _sections(spark, "a b c\nno header here") == {} and _sections(spark, "") == {}


def test_blocks_of_sections(spark):
    names, lines = run(spark, ["Projects\na\nb\n\nc\nSkills\nd\n\ne"], [*en.lines_layer(D), *hd.blocks(D)], "block_names", "block_lines")[0]
    assert dict(zip(names, lines)) == {"projects": ["a b", "c"], "skills": ["d", "e"]}


@pytest.mark.parametrize(
    ("name", "content", "a", "b"),
    [
        ("Technical Skills:", [], ("skills", 0.95, "alias"), ("skills", 0.95, "alias")),
        ("My work history", [], ("experience", 0.8, "alias_partial"), ("experience", 0.8, "alias_partial")),
        ("Stuff", ["hindi and english", "native"], ("languages", 0.9, "keyword"), ("languages", 0.9, "keyword")),
        ("Stuff", ["toolbox"], ("unknown", 0.5, "unknown"), ("skills", 0.7, "x")),
        ("Education 2", [], ("education", 0.75, "heuristic_name"), ("education", 0.75, "heuristic_name")),
        ("Stuff", ["b.tech, university of x, css and college of flask"], ("education", 0.7, "x"), ("education", 0.7, "x")),
    ],
)
def test_classifiers(spark, name, content, a, b):
    frame = spark.createDataFrame([(name, content)], "name string, content array<string>")
    for rules, want in ((cf.A, a), (cf.B, b)):
        got = with_layers(frame, cf.classified(D, rules)).select("category", "confidence", "method").first()
        if want[2] != "x":
            assert tuple(got) == want


def test_entities_by_hand(spark):
    texts = [
        "RAVI KUMAR\nmail ravi@x.in\n+91 98765-43210\nSurat road, Gujarat",
        "Software Engineer\nAsha  Patel\n12345\nhttp://x.in",
        "CURRICULUM VITAE\nfoo.com\nName: neha shah",
        "nothing 1\n\n\n\n\n\n\n\n\nPRIYA O'NEIL",
        None,
    ]
    got = run(spark, texts, en.entities_a(D), "name", "email", "phone", "location", "confidence")
    assert got == [
        ("RAVI KUMAR", "ravi@x.in", "+919876543210", "Surat road, Gujarat", 100),
        ("Asha Patel", None, None, None, 25),
        ("neha shah", None, None, None, 25),
        ("Priya O'Neil", None, None, None, 25),
        (None, None, None, None, 0),
    ]
    second = run(spark, ["Asha Patel Rao\n+91 12345 and 9876543210\nwww.asha-blog.in linkedin.com/in/a_b GitHub.com/q\nNavi Mumbai"], en.entities_b(D), "name", "phone", "linkedin", "github", "portfolio", "location")
    assert second == [("Asha Patel Rao", "9876543210", "https://linkedin.com/in/a_b", "https://GitHub.com/q", "https://www.asha-blog.in", "Navi Mumbai")]
    flat = run(spark, ["Ab\n CD  e"], en.entities_detailed(D), "text_length", "line_count", "name")
    assert flat == [(7, 1, "ab cd e")]


def test_contexts(spark):
    text = "xxabyyABzz ab"
    got = run(spark, [text], [*en.lines_layer(D), *en.contexts(D, "raw", "ab", 3)], "contexts")[0]
    want = [f"{text[max(0, m.start() - 3) : m.start()]}|{m[0]}|{text[m.end() : m.end() + 3]}" for m in re.finditer("ab", text, re.I)]
    assert got == want


def test_identity(spark):
    text = "x1\ny2\nSummary\nravi shah\nabout me too long for a name it is\nEXPERIENCE\ncall 98765 43210 or a@b.org\nPune East"
    got = run(spark, [text], [*bq.section_layers(D), {"name": "CAST(NULL AS STRING)", "email": "CAST(NULL AS STRING)", "phone": "CAST(NULL AS STRING)", "location": "CAST(NULL AS STRING)"}, *bq.identity(D)], *bq._IDENTITY)
    assert got == [("ravi shah", "a@b.org", "98765 43210", "ravi shah")]


def _skills(text):
    """Skills and typos of a text, one token after the other."""
    found, typos = [], 0
    for part in (p.strip() for p in re.split(sk.BREAKS, re.sub("[()]", " ", text))):
        for token in (t.strip() for t in part.split(":")):
            norm = re.sub("[^a-z0-9#+ ]", "", token.lower()).strip()
            if len(norm) < 2 or token.isdigit() or re.search(r"\d{4}", token) or any(n in token.lower() for n in sk.NOISE):
                continue
            near = [norm] if norm in sk.WHITELIST else difflib.get_close_matches(norm, sk.WHITELIST, n=1, cutoff=sk.CUTOFF) if len(norm) >= 4 else []
            typos += bool(near) and near[0] != norm and (":" in part or near[0] not in found)
            found += [x for x in near if x not in found]
    return found, typos


def test_skills(spark):
    r = random.Random(4)
    words = [*sk.WHITELIST, "pyhton", "kubernets", "javascrpt", "teamwork", "2019", "Jan 2020", "zzz", "Docker", "dockr", "postgre sql"]
    texts = ["".join(r.choice(words) + r.choice([", ", " / ", "\n- ", ": ", " & ", "; ", " (x) ", " "]) for _ in range(30)) for _ in range(40)] + [""]
    match = sk.register_close_skills(spark)
    got = run(spark, texts, [*en.lines_layer(D), *sk.extracted(D, "raw", "found", lambda x: f"{match}({x})")], "found", "found_typos")
    assert got == [_skills(t) for t in texts]


def test_projects_by_hand():
    lines = [
        "PROJECTS", "Smart Farm (Jan 2021)", "Developed with python for real-time weather data", "• Chat App: built a rest api using node and socket", "- in two weeks", "2019 - 2020", "Shop Front",
        "made with firebase and used by many people", "Internship Tracker", "used by interns of the company in many places", "- Project Name: Library Portal.", "- Description: implemented search in html css javascript", "X", "Notes", "too short",
    ]
    assert list(pj.cut_projects(lines)) == [
        {"name": "Smart Farm", "duration": "Jan 2021", "description": "Developed with python for real-time weather data"},
        {"name": "Chat App", "duration": "2019 - 2020", "description": "built a rest api using node and socket in two weeks"},
        {"name": "Shop Front", "duration": "", "description": "made with firebase and used by many people"},
        {"name": "Library Portal", "duration": "", "description": "implemented search in html css javascript"},
    ]
    assert [pj.is_title(x) for x in ("Tools:", "My Tools:", "a, b C", "2020", "lower case only", "Built a thing", "Weather App", "has (brackets) but no capital", "Email address X")] == [False, True, False, False, False, False, True, True, False]


def test_project_texts_agree(spark):
    r = random.Random(6)
    bits = ["project", "Project Name", ":", "-", " ", "built", "an", "a", "Shop", ".", "developed it all", "description", "like", "  ", "objective", "•"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randint(1, 7))) for _ in range(150)] + ["", "  "]
    got = run(spark, texts, [{"n": pj.clean_name(D, "text"), "t": pj.clean_description(D, "text")}], "n", "t")
    assert got == [(pj.plain_name(t), pj.plain_description(t)) for t in texts]


def test_layout_blocks():
    lines = ["EDUCATION", "B.Tech in a college", "• a", "", "- b", "ravi@x.in", "", "www.x.in", "plain text here", "goes on", "", "Heading Two", "• c"]
    got = [(b["type"], b["content"], b["start_line"]) for b in ly.blocks(lines)]
    # a group with a blank line inside is followed by its last line again
    assert got == [
        ("heading", ["EDUCATION", "B.Tech in a college"], 0), ("bullet_group", ["• a", "- b"], 2), ("bullet_group", ["- b"], 4), ("contact", ["ravi@x.in", "www.x.in"], 5), ("contact", ["www.x.in"], 7),
        ("paragraph", ["plain text here", "goes on"], 8), ("heading", ["Heading Two"], 11), ("bullet_group", ["• c"], 12),
    ]
    raw = ["Farm Tool: helps to sow seeds", "Farm Tool: again the same name", "my skills", "• built a web shop for five friends", "Short Title", "developed with care by us", "We made one platform for all people"]
    assert list(ly.recovered(raw)) == ["Farm Tool: helps to sow seeds", "built a web shop: for five friends", "Short Title: developed with care by us", "We made one platform: for all people"]


def test_columns(spark):
    page = [f"left words of line {k}" + " " * 8 + f"right side text {k}" for k in range(12)]
    frame = spark.createDataFrame([(0, page), (1, page[:3])], "doc_id long, l array<string>")
    rows = with_layers(frame, [{"two": "1"}, *ly.split_at_gaps(D, "l", "two")]).orderBy("doc_id").select("linear").collect()
    assert rows[0][0] == "\n".join(f"left words of line {k}" for k in range(12)) + "\n\n" + "\n".join(f"right side text {k}" for k in range(12))


def test_spelling(spark):
    words = run(spark, ["Programing databse vehicleregistration abcuniversity mail@x.in http://x.y tiny programing"], sp.checked_words(D, "text"), "checked")
    assert words == [["programing", "databse", "programing"]]
    checked = spark.createDataFrame([(1, words[0]), (2, [])], "doc_id long, checked array<string>")
    dictionary = spark.createDataFrame([("databse",), ("databse",)], "word string")
    got = {r.doc_id: (r.typo_count, r.total_words, r.typo_ratio, r.typo_score) for r in sp.count_typos(checked, dictionary).collect()}
    assert got == {1: (1, 3, 0.3333, pytest.approx(50.0)), 2: (0, 0, 0.0, 100.0)}
    assert {r.typo_score for r in sp.count_typos(checked, None).collect()} == {100.0}


def test_assembled_record(spark):
    text = "RAVI KUMAR\nravi@gmail.com\n9876543210\nSurat\nSKILLS\nPython, pyhton, Docker\nEDUCATION\nB.Tech computer science CGPA: 8.2\nWORK EXPERIENCE\nSoftware developer intern 2020 - 2021\nPROJECTS\nSmart Farm (Jan 2021)\nDeveloped with react for deep learning data\nLANGUAGES\nEnglish"
    frame = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.asDict(recursive=True) for r in bq.records(spark, frame).collect()}
    one = rows[1]
    assert (one["name"], one["email"], one["phone"], one["location"]) == ("RAVI KUMAR", "ravi@gmail.com", "9876543210", "Surat")
    assert one["skills"] == ["python", "docker", "deep learning"] and one["degree_type"] == "bachelor" and one["education_score"] == 82.0
    assert one["projects"] == [{"name": "Smart Farm", "duration": "Jan 2021", "description": "Developed with react for deep learning data"}]
    from docsift.functions import features

    assert len([k for k in one if k in features.ALL]) >= 150 and 0 <= one["candidate_readiness_score"] <= 100
    assert rows[2]["name"] is None and rows[2]["skills_count"] == 0

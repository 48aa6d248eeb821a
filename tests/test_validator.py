import json

import pytest
from pyspark.sql import functions as F

from sluice.functions import gates as G
from sluice import sources
from sluice.operators.validator import ABLATIONS, accept, validate, validate_directories

CANON = "inherits: /\nwindow_start: 2024-01-01\nwindow_end: 2024-01-31\n\nAbout [[A]].\n"
VOCAB = "- [[A]]: meaning\n"
FILES = ["CANON.md", "VOCAB.md", "README.md", "claims.json"]


def claim(**change):
    return {"text": "x", "terms": ["A"], "evidence_commit": "s1", "evidence_date": "2024-01-15"} | change


CASES = [
    ({}, "tttt"),
    ({"files": ["content.md"], "canon": None, "vocab": None, "claims": None}, "ffff"),
    ({"canon": CANON + "[[Z]]"}, "ftff"),
    ({"claims": [claim(evidence_commit="0" * 40)]}, "fftf"),
    ({"canon": CANON.replace("2024-01-01", "1990-01-01").replace("2024-01-31", "1990-12-31")}, "ffft"),
    ({"claims": [claim(terms=["Q"])]}, "ffff"),
    ({"canon": CANON.replace("inherits: /", "inherits: parent")}, "ffff"),
    ({"claims": "not json"}, "tttt"),
    ({"claims": [], "canon": "inherits: /\n[[A]]"}, "tttt"),
    ({"claims": [claim(evidence_date="2024-01-31")]}, "tttt"),
    ({"files": ["CANON.md", "VOCAB.md"]}, "ffff"),
    ({"claims": [claim(terms=None), claim()]}, "tttt"),
    ({"claims": [claim(evidence_commit=None)]}, "fftf"),
]


def test_mini_fixtures(spark):
    rows = []
    for k, (change, _) in enumerate(CASES):
        one = {"files": FILES, "canon": CANON, "vocab": VOCAB, "claims": [claim()]} | change
        text = one["claims"] if isinstance(one["claims"], str) or one["claims"] is None else json.dumps(one["claims"])
        rows.append((k, one["files"], one["canon"], one["vocab"], text))
    scopes = spark.createDataFrame(rows, "pos long, files array<string>, canon string, vocab string, claims_json string").withColumn("claims", G.parse_claims(F.col("claims_json")))
    ledger = spark.createDataFrame([("s1",), ("s2",)], "sha string")
    out = validate(scopes, ledger).select("pos", *(accept(w).alias(a) for a, w in ABLATIONS.items())).orderBy("pos").collect()
    assert ["".join("t" if x else "f" for x in r[1:]) for r in out] == [want for _, want in CASES]


@pytest.mark.parametrize(
    ("vocab", "names"),
    [("- [[A]]: x\n- B: y\n", ["A", "B"]), ("- A:\n- B: x\n", ["A"]), ("- [[A: B]]: x\n", ["[[A"]), ("* foo\nbar: x\n", ["foo\nbar"]), ("- A : x\n", ["A"]), (None, []), ("", [])],
)
def test_definitions(spark, vocab, names):
    df = spark.createDataFrame([(vocab,)], "v string")
    assert df.select(G.definitions(F.col("v"))).first()[0] == names


def test_front_matter(spark):
    df = spark.createDataFrame([("inherits:\nwindow_start: 2026",), (None,)], "c string")
    assert [r[0] for r in df.select(G.front_matter(F.col("c"), "inherits")).collect()] == ["window_start: 2026", None]


def test_directories_to_verdicts(spark, tmp_path):
    def scope(name, **files):
        (tmp_path / name).mkdir()
        for file, text in files.items():
            (tmp_path / name / file.replace("_", ".")).write_text(text)

    scope("good", CANON_md=CANON, VOCAB_md=VOCAB, README_md="r", claims_json=json.dumps([claim()]))
    scope("bare", content_md="text")
    scope("broken", CANON_md=CANON + "[[Z]] [[Y]]", VOCAB_md=VOCAB, README_md="r", claims_json="not json")
    scope("far", CANON_md=CANON, VOCAB_md=VOCAB, README_md="r", claims_json=json.dumps([claim(evidence_commit="none", evidence_date="2030-01-01", terms=["Q"])]))
    (tmp_path / "log").write_text("s1 2024-01-15\n")
    out = validate_directories(sources.scope_directories(spark, f"{tmp_path}/*/*"), sources.commit_log(spark, str(tmp_path / "log"))).collect()
    found = {r["scope"].rsplit("/", 1)[1]: (r["accept"], r["reasons"]) for r in out}
    assert found == {
        "good": (True, []),
        "bare": (False, ["triad missing: ['CANON.md', 'README.md', 'VOCAB.md']", "inheritance: no parent declared or chain does not reach root"]),
        "broken": (False, ["introspection: undefined terms ['Y', 'Z']", "claims.json unparseable"]),
        "far": (False, ["gate1 vocab: claim uses undefined term", "gate2 evidence: claim cites commit absent from ledger", "gate3 scope: claim evidence outside declared window"]),
    }


def test_terms_are_quoted_as_published(spark):
    from sluice.operators.validator import _listed

    names = ["plain", "it's", 'say "x"', "it's \"x\"", "back\\slash", "it's back\\slash", ""]
    df = spark.createDataFrame([(names,), ([],)], "names array<string>")
    assert [r[0] for r in df.select(_listed(F.col("names"))).collect()] == [repr(names), "[]"]


def test_render_and_judge_several_claims(spark):
    from sluice.operators import rendering as R
    from sluice.operators.validator import validate_directories

    sha, claim = "c" * 40, lambda text, terms, commit, date: (text, terms, commit, date)
    rows = [
        ("good", [claim("One.", ["B", "A"], "c" * 40, "2024-02-01"), claim("Two.", None, "c" * 40, "2024-03-01")], True, None, None),
        ("one bad of two", [claim("One.", ["A"], "c" * 40, "2024-02-01"), claim("Two.", [], "d" * 40, "2024-03-01")], True, None, None),
        ("late", [claim("One.", ["A"], "c" * 40, "2024-02-01"), claim("Two.", [], "c" * 40, "2025-03-01")], True, None, None),
        ("injected", [claim(None, ["A"], "c" * 40, "2024-02-01")], True, "Odd", {"A": "a letter"}),
        ("bare", [claim("One.", ["A"], "c" * 40, "2024-02-01")], False, None, None),
        ("none", None, True, None, None),
    ]
    df = spark.createDataFrame(rows, f"scope string, claims array<{R.CLAIM}>, scaffolded boolean, inject string, definitions map<string,string>")
    out = R.render(df.withColumns({"window_start": F.lit("2024-01-01"), "window_end": F.lit("2024-12-31")}))
    got = {r["scope"]: r for r in out.collect()}
    assert got["good"]["prose"] == "One. Two." and got["good"]["readme"] == "# README\nOne. Two.\n" and got["good"]["vocab"] == "# VOCAB\n- [[A]]: defined locally\n- [[B]]: defined locally\n"
    assert got["good"]["canon"].endswith("\nGoverns [[A]] [[B]].\n") and got["injected"]["canon"].endswith("Governs [[A]] [[Odd]].\n") and got["injected"]["vocab"].endswith("- [[A]]: a letter\n")
    assert got["bare"]["files"] == ["content.md"] and got["bare"]["canon"] is None and got["none"]["claims_json"] == "[]" and got["injected"]["prose"] == ""
    ledger = spark.createDataFrame([(sha, "2024-01-01")], "sha string, committed_date string")
    verdicts = {r["scope"]: (r["accept"], r["reasons"]) for r in validate_directories(out, ledger).collect()}
    assert {k: v[0] for k, v in verdicts.items()} == {"good": True, "one bad of two": False, "late": False, "injected": False, "bare": False, "none": True}
    assert verdicts["one bad of two"][1] == ["gate2 evidence: claim cites commit absent from ledger"] and verdicts["late"][1] == ["gate3 scope: claim evidence outside declared window"]
    assert verdicts["injected"][1] == ["introspection: undefined terms ['Odd']"]

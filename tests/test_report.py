"""Reports: every section with its rows, as the queries give them."""

from sluice.plans import report
from sluice.plans.rates import QUERIES


def test_report_sections(spark, sf_dir, tmp_path):
    report.write_report(spark, sf_dir, "admission", str(tmp_path / "r"))
    (file,) = (tmp_path / "r").glob("part-*")
    text = file.read_text()
    assert [x[3:] for x in text.splitlines() if x.startswith("## ")] == [t for t, _, _ in report.REPORTS["admission"]]
    arms = text.split("## Arms\n")[1].split("## ")[0]
    for r in QUERIES["confusion_by_arm"](spark, sf_dir).collect():
        (line,) = [x for x in arms.splitlines() if x.startswith(f"| {r['arm']} |")]
        cells = [x.strip() for x in line.strip("|").split("|")]
        assert cells[1:10] == [str(r[c]) for c in ("tp", "fp", "fn", "tn", "n", "precision", "recall", "f1", "accuracy")]
    classes = text.split("## Reject rate by class\n")[1].split("## ")[0]
    rates = {(r["arm"], r["klass"]): r["reject_rate"] for r in QUERIES["reject_rate_by_class"](spark, sf_dir).collect()}
    head, _, *lines = [[x.strip() for x in line.strip("|").split("|")] for line in classes.splitlines() if line.startswith("|")]
    assert {(x[0], k): v for x in lines for k, v in zip(head[1:], x[1:], strict=True) if v} == {k: str(v) for k, v in rates.items()}


def test_report_of_the_tournament(spark, sf_dir):
    text = report.render(spark, sf_dir, "tournament")
    assert text.startswith("# Tournament\n") and "| B3e-entailment |" in text


def test_association_report_has_a_row_an_arm(spark, sf_dir):
    first = report.render(spark, sf_dir, "association").split("## ")[1]
    head, _, *lines = [x for x in first.splitlines() if x.startswith("|")]
    assert "item_lo" in head and "topic_hi" in head and len(lines) == QUERIES["phi_by_arm"](spark, sf_dir).count()

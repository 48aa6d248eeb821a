import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import metrics as M
from sluice.plans.rates import kappa

# goldens: k, n, lo, hi
WILSON = [(90, 90, 0.959, 1.0), (166, 175, 0.905, 0.973), (0, 64, 0.0, 0.057), (61, 62, 0.914, 0.997), (44, 62, 0.587, 0.808), (21, 62, 0.233, 0.463), (21, 44, 0.338, 0.621), (23, 62, 0.262, 0.495), (0, 0, 0.0, 0.0)]
# goldens: tp, fp, fn, tn, phi, F1, precision, recall, odds ratio
CELLS = [
    (16, 30, 1, 0, -0.196, 0.508, 0.348, 0.941, 0.18), (7, 5, 10, 25, 0.27, 0.483, 0.583, 0.412, 3.31), (64, 59, 0, 1, 0.093, 0.684, 0.520, 1.0, 3.25),
    (64, 52, 0, 8, 0.271, 0.711, 0.552, 1.0, 20.89), (51, 47, 13, 13, 0.017, 0.630, 0.520, 0.797, 1.08), (64, 43, 0, 17, 0.412, 0.749, 0.598, 1.0, 51.9),
    (252, 2, 35, 191, 0.852, 0.932, 0.992, 0.878, 544.83), (200, 100, 87, 93, 0.181, 0.681, 0.667, 0.697, 2.13), (162, 98, 125, 95, 0.056, 0.592, 0.623, 0.564, 1.26),
    (286, 175, 1, 18, 0.226, 0.765, 0.620, 0.997, 20.13), (287, 193, 0, 0, 0.0, 0.748, 0.598, 1.0, 1.49),
]


def test_wilson(spark):
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([w[:2] for w in WILSON], "k long, n long").select("k", "n", lo, hi).collect()
    assert [tuple(r) for r in rows] == WILSON


def test_confusion_statistics(spark):
    df = spark.createDataFrame([c[:4] for c in CELLS], "tp long, fp long, fn long, tn long")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = df.select(M.phi(tp, fp, fn, tn), M.f1(tp, fp, fn), M.share(tp, tp + fp), M.share(tp, tp + fn), M.odds_ratio(tp, fp, fn, tn)).collect()
    for row, want in zip(rows, CELLS, strict=True):
        assert [round(x, 3) for x in row[:4]] == pytest.approx(want[4:8], abs=6e-4)
        assert row[4] == pytest.approx(want[8], abs=6e-3)


@pytest.mark.parametrize(("votes", "want"), [([(2, 1), (0, 3)], 0.25), ([(3, 0), (3, 0)], 1.0), ([(0, 0)], 0.0), ([], 0.0)])
def test_kappa(spark, votes, want):
    df = spark.createDataFrame(votes, "n_slop long, n_legit long")
    assert kappa(df, ["n_slop", "n_legit"], 3).first()["kappa"] == want


def test_phi_is_odd_and_bounded(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(*[st.integers(0, 10**9)] * 4), min_size=1, max_size=20))
    def check(cells):
        df = spark.createDataFrame(cells, "tp long, fp long, fn long, tn long")
        tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
        for a, b in df.select(M.phi(tp, fp, fn, tn), M.phi(fn, tn, tp, fp)).collect():
            assert -1.0000001 <= a <= 1.0000001
            assert a == pytest.approx(-b, abs=1e-9)

    check()

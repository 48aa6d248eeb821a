"""Confusion, association and rate queries over the decisions of all arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import metrics as M
from sluice.operators import corpus as C
from sluice.plans import oracle as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BASE = (O.ITEMS, O.PROXIES, O.DECISIONS)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _cells(df, *by):
    return df.groupBy(*by).agg(*M.confusion())



def _c():
    return (F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))


@query(O.sql(*BASE, f"c AS (SELECT arm, {O.CELLS} FROM decisions GROUP BY arm)", select=f"""SELECT arm, tp, fp, fn, tn, n,
  round({O.share('tp', 'tp + fp')}, 3) AS precision, round({O.share('tp', 'tp + fn')}, 3) AS recall, round({O.F1}, 3) AS f1, round({O.share('tp + tn', 'n')}, 3) AS accuracy FROM c"""))
def confusion_by_arm(spark, sf):
    tp, fp, fn, tn = _c()
    out = _cells(C.decisions(spark, sf), "arm")
    return out.select("arm", "tp", "fp", "fn", "tn", "n", F.round(M.share(tp, tp + fp), 3).alias("precision"), F.round(M.share(tp, tp + fn), 3).alias("recall"), F.round(M.f1(tp, fp, fn), 3).alias("f1"), F.round(M.share(tp + tn, F.col("n")), 3).alias("accuracy"))


CORE_CELLS = (*BASE, f"c AS (SELECT arm, {O.CELLS} FROM decisions WHERE labelled GROUP BY arm)")


@query(O.sql(*CORE_CELLS, select=f"SELECT arm, n, round({O.PHI}, 3) AS phi FROM c"))
def phi_by_arm(spark, sf):
    return _cells(C.decisions(spark, sf, core=True), "arm").select("arm", "n", F.round(M.phi(*_c()), 3).alias("phi"))


@query(O.sql(*CORE_CELLS, select=f"SELECT arm, n, round({O.ODDS}, 2) AS odds_ratio FROM c"))
def odds_ratio_by_arm(spark, sf):
    return _cells(C.decisions(spark, sf, core=True), "arm").select("arm", "n", F.round(M.odds_ratio(*_c()), 2).alias("odds_ratio"))


@query(O.sql(*BASE, select="SELECT arm, klass, count(*) AS n, round(avg(reject::INT), 3) AS reject_rate FROM decisions GROUP BY arm, klass"))
def reject_rate_by_class(spark, sf):
    return C.decisions(spark, sf).groupBy("arm", "klass").agg(F.count("*").alias("n"), F.round(F.avg(F.col("reject").cast("int")), 3).alias("reject_rate"))


_lo, _hi = O.wilson("k", "n")


@query(O.sql(*BASE, "c AS (SELECT arm, klass, count(*) FILTER (reject) AS k, count(*) AS n FROM decisions GROUP BY arm, klass)", select=f"SELECT arm, klass, k, n, {_lo} AS lo, {_hi} AS hi FROM c"))
def wilson_by_class(spark, sf):
    out = C.decisions(spark, sf).groupBy("arm", "klass").agg(F.count_if("reject").alias("k"), F.count("*").alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return out.select("arm", "klass", "k", "n", lo.alias("lo"), hi.alias("hi"))


@query(O.sql(*BASE, """c AS (SELECT arm, CASE klass WHEN 'C3' THEN 'c3_leakage' ELSE 'c4_tax' END AS measure, count(*) FILTER (CASE klass WHEN 'C3' THEN NOT reject ELSE reject END) AS k, count(*) AS n
  FROM decisions WHERE klass IN ('C3', 'C4') GROUP BY ALL)""", select=f"SELECT arm, measure, k, n, round({O.share('k', 'n')}, 3) AS rate, {_lo} AS lo, {_hi} AS hi FROM c"))
def offdiagonal_rates(spark, sf):
    leak = F.col("klass") == "C3"
    df = C.decisions(spark, sf).where(F.col("klass").isin("C3", "C4")).withColumn("measure", F.when(leak, "c3_leakage").otherwise("c4_tax"))
    out = df.groupBy("arm", "measure").agg(F.count_if(F.col("reject") != leak).alias("k"), F.count("*").alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return out.select("arm", "measure", "k", "n", F.round(M.share(F.col("k"), F.col("n")), 3).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def _rate(klass):
    return F.coalesce(F.round(F.avg(F.when(F.col("klass") == klass, F.col("reject").cast("int"))), 3), F.lit(0.0))


def _sql_rate(klass, arm=""):
    return f"coalesce(round(avg(reject::INT) FILTER (klass = '{klass}'{arm}), 3), 0.0)"


@query(O.sql(*BASE, select=f"SELECT arm, round({_sql_rate('C2')} - {_sql_rate('C3')}, 3) AS gap_c2_minus_c3, {_sql_rate('C4')} AS tax_c4 FROM decisions GROUP BY arm"))
def headline_gap_tax(spark, sf):
    return C.decisions(spark, sf).groupBy("arm").agg(F.round(_rate("C2") - _rate("C3"), 3).alias("gap_c2_minus_c3"), _rate("C4").alias("tax_c4"))


@query(" UNION ALL ".join(O.sql(*BASE, select=f"""SELECT '{g}' AS gate, '{k}' AS klass, {_sql_rate(k, " AND arm = 'T'")} AS t_rejects, {_sql_rate(k, f" AND arm = 'T-{g}'")} AS without_rejects,
  round({_sql_rate(k, " AND arm = 'T'")} - {_sql_rate(k, f" AND arm = 'T-{g}'")}, 3) AS marginal FROM decisions""").join(("SELECT * FROM (", ")")) for g, k in C.GATES.items()))
def ablation_marginal(spark, sf):
    """What each gate alone catches in the class that fails only it."""
    gates = F.array(*(F.struct(F.lit(g).alias("gate"), F.lit(k).alias("klass")) for g, k in C.GATES.items()))
    df = C.decisions(spark, sf).where(F.col("klass").isin(*C.GATES.values()) & F.col("arm").startswith("T")).withColumn("g", F.explode(F.filter(gates, lambda g: g["klass"] == F.col("klass"))))
    mean = lambda arm: F.coalesce(F.round(F.avg(F.when(F.col("arm") == arm, F.col("reject").cast("int"))), 3), F.lit(0.0))
    out = df.groupBy("g.gate", "klass").agg(mean(F.lit("T")).alias("t_rejects"), mean(F.concat(F.lit("T-"), F.col("g.gate"))).alias("without_rejects"))
    return out.withColumn("marginal", F.round(F.col("t_rejects") - F.col("without_rejects"), 3))


@query(O.sql(*CORE_CELLS, select="SELECT arm, round(tp::DOUBLE / greatest(1, tp + fn), 3) AS catch_slop, round(fp::DOUBLE / greatest(1, fp + tn), 3) AS false_reject_legit FROM c"))
def catch_false_reject(spark, sf):
    tp, fp, fn, tn = _c()
    one = F.lit(1)
    return _cells(C.decisions(spark, sf, core=True), "arm").select("arm", F.round(tp / F.greatest(one, tp + fn), 3).alias("catch_slop"), F.round(fp / F.greatest(one, fp + tn), 3).alias("false_reject_legit"))


@query(O.sql(O.ITEMS, select="SELECT count(*) AS n, round(avg(gt_slop::INT), 3) AS base_rate, count(DISTINCT topic) AS topics FROM items"))
def base_rate(spark, sf):
    return C.items(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg(F.col("gt_slop").cast("int")), 3).alias("base_rate"), F.countDistinct("topic").alias("topics"))


@query(O.sql(O.ITEMS, O.PROXIES, O.VOTES, select="SELECT count(*) AS n, round(avg(((panel_gt = 'slop') = gt_slop)::INT), 3) AS agreement FROM voted WHERE labelled"))
def manipulation_check(spark, sf):
    return C.panel(spark, sf).where("labelled").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("panel_gt") == "slop") == F.col("gt_slop")).cast("int")), 3).alias("agreement"))


@query(O.sql(*BASE, f"""r AS (SELECT {', '.join(f'''{_sql_rate(k, f" AND arm = '{a}'")} AS {a}_{k}''' for a in ('T', 'B2') for k in C.CORE)} FROM decisions)""", select="""SELECT T_C2 >= 0.85 AND T_C3 <= 0.20 AS p1, T_C4 >= 0.80 AS p2, B2_C3 > T_C3 AS p3,
  NOT (T_C1 <= B2_C1 AND T_C4 <= B2_C4 AND T_C2 >= B2_C2 AND T_C3 >= B2_C3) AND NOT (B2_C1 <= T_C1 AND B2_C4 <= T_C4 AND B2_C2 >= T_C2 AND B2_C3 >= T_C3) AS p4, T_C3 = T_C2 AS falsified FROM r"""))
def prereg_grading(spark, sf):
    """The predictions, graded: P1 to P4 and the falsifier."""
    rate = lambda arm, k: F.coalesce(F.round(F.avg(F.when((F.col("arm") == arm) & (F.col("klass") == k), F.col("reject").cast("int"))), 3), F.lit(0.0)).alias(f"{arm}_{k}")
    r = C.decisions(spark, sf).agg(*(rate(a, k) for a in ("T", "B2") for k in C.CORE))
    t, b = ({k: F.col(f"{a}_{k}") for k in C.CORE} for a in ("T", "B2"))
    over = lambda x, y: (x["C1"] <= y["C1"]) & (x["C4"] <= y["C4"]) & (x["C2"] >= y["C2"]) & (x["C3"] >= y["C3"])
    return r.select(((t["C2"] >= 0.85) & (t["C3"] <= 0.2)).alias("p1"), (t["C4"] >= 0.8).alias("p2"), (b["C3"] > t["C3"]).alias("p3"), (~over(t, b) & ~over(b, t)).alias("p4"), (t["C3"] == t["C2"]).alias("falsified"))


JOINED = (O.ITEMS, O.PROXIES, O.VOTES, """
regime AS (SELECT v.pos, v.topic, v.lang, v.gt_slop, v.panel_gt = 'slop' AS panel_slop, i.klass NOT IN ('C1', 'C3') AS t, p.b2 FROM voted v JOIN items i USING (pos) JOIN proxies p USING (pos) WHERE v.labelled)""")


def _regime(spark, sf):
    """Core items with the panel's label, T and B2."""
    wide = C.wide_decisions(spark, sf).where("labelled").select("pos", "topic", "lang", "gt_slop", F.col("T").alias("t"), F.col("B2").alias("b2"))
    return wide.join(C.panel(spark, sf).select("pos", (F.col("panel_gt") == "slop").alias("panel_slop")), "pos")


@query(O.sql(*JOINED, select="""SELECT topic, count(*) AS n, count(*) FILTER (b2) AS b2_caught, count(*) FILTER (panel_slop) AS panel_slop, arg_min(gt_slop, pos) AS gt_first,
  round(count(*) FILTER (b2)::DOUBLE / count(*), 3) AS b2_catch_rate, round(count(*) FILTER (panel_slop)::DOUBLE / count(*), 3) AS panel_slop_rate FROM regime GROUP BY topic"""))
def breakdown_by_source(spark, sf):
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 3)
    return _regime(spark, sf).groupBy("topic").agg(F.count("*").alias("n"), F.count_if("b2").alias("b2_caught"), F.count_if("panel_slop").alias("panel_slop"), F.min_by("gt_slop", "pos").alias("gt_first"), share("b2").alias("b2_catch_rate"), share("panel_slop").alias("panel_slop_rate"))


_STRATEGY = """s AS (SELECT lang AS strategy, count(*) AS n, count(*) FILTER (b2) AS b2_caught, count(*) FILTER (panel_slop AND NOT t AND NOT b2) AS leaked FROM regime GROUP BY lang)"""
_STRATEGY_OUT = "SELECT strategy, n, b2_caught, leaked, round(b2_caught::DOUBLE / n, 3) AS b2_catch_rate, round(leaked::DOUBLE / n, 3) AS leak_rate FROM s"


def _by_strategy(spark, sf):
    leaked = F.col("panel_slop") & ~F.col("t") & ~F.col("b2")
    out = _regime(spark, sf).groupBy(F.col("lang").alias("strategy")).agg(F.count("*").alias("n"), F.count_if("b2").alias("b2_caught"), F.count_if(leaked).alias("leaked"))
    return out.withColumns({"b2_catch_rate": F.round(F.col("b2_caught") / F.col("n"), 3), "leak_rate": F.round(F.col("leaked") / F.col("n"), 3)})


@query(O.sql(*JOINED, _STRATEGY, select=_STRATEGY_OUT))
def breakdown_by_strategy(spark, sf):
    return _by_strategy(spark, sf)


@query(O.sql(*JOINED, _STRATEGY, select=_STRATEGY_OUT + " ORDER BY leak_rate DESC, strategy LIMIT 5"))
def top_evasive(spark, sf):
    """The five strategies that leak most: a top-k report."""
    return _by_strategy(spark, sf).orderBy(F.desc("leak_rate"), "strategy").limit(5)


def _measure(name, k, n="TRUE"):
    return f"SELECT '{name}' AS measure, count(*) FILTER (({k}) AND ({n})) AS k, count(*) FILTER ({n}) AS n FROM regime"


@query(O.sql(*JOINED, "m AS (" + " UNION ALL ".join((_measure("structural_admit", "NOT t"), _measure("panel_slop", "panel_slop"), _measure("b2_catch", "b2"), _measure("b2_catch_on_panel_slop", "b2", "panel_slop"), _measure("combined_leak", "panel_slop AND NOT t AND NOT b2"))) + ")",
  select=f"SELECT measure, k, n, CASE WHEN n > 0 THEN round(k::DOUBLE / n, 3) END AS rate, {_lo} AS lo, {_hi} AS hi FROM m"))
def redteam_summary(spark, sf):
    p, t, b = F.col("panel_slop"), F.col("t"), F.col("b2")
    parts = {"structural_admit": (~t, None), "panel_slop": (p, None), "b2_catch": (b, None), "b2_catch_on_panel_slop": (b & p, p), "combined_leak": (p & ~t & ~b, None)}
    row = _regime(spark, sf).agg(F.array(*(F.struct(F.lit(m).alias("measure"), F.count_if(k).alias("k"), (F.count("*") if n is None else F.count_if(n)).alias("n")) for m, (k, n) in parts.items())).alias("m"))
    out = row.select(F.inline("m"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return out.select("measure", "k", "n", F.when(F.col("n") > 0, F.round(M.share(F.col("k"), F.col("n")), 3)).alias("rate"), lo.alias("lo"), hi.alias("hi"))


@query(O.sql(*JOINED, "m AS (SELECT count(*) FILTER (gt_slop AND NOT t AND NOT b2) AS k, count(*) FILTER (gt_slop) AS n FROM regime)", select=f"SELECT k, n, round(k::DOUBLE / greatest(1, n), 3) AS leak_rate, {_lo} AS lo, {_hi} AS hi FROM m"))
def combined_leak(spark, sf):
    out = _regime(spark, sf).where("gt_slop").agg(F.count_if(~F.col("t") & ~F.col("b2")).alias("k"), F.count("*").alias("n"))
    lo, hi = M.wilson(F.col("k"), F.col("n"))
    return out.select("k", "n", F.round(F.col("k") / F.greatest(F.lit(1), "n"), 3).alias("leak_rate"), lo.alias("lo"), hi.alias("hi"))


@query("""WITH u AS (SELECT 'legit' AS label, d.doc_id, d.text FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 UNION ALL SELECT 'slop', d.doc_id, d.text FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0)
SELECT label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM u GROUP BY label""")
def regime_union(spark, sf):
    core = C.items(spark, sf).where("labelled")
    legit, slop = core.where("not gt_slop").withColumn("label", F.lit("legit")), core.where("gt_slop").withColumn("label", F.lit("slop"))
    return legit.unionByName(slop).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("prose")).cast("long").alias("chars"))


@query(O.sql(*BASE, select=f"""SELECT arm, klass, topic, {O.CELLS}, round(avg(reject::INT), 3) AS reject_rate FROM decisions GROUP BY GROUPING SETS ((arm), (arm, klass), (arm, topic))"""))
def grouping_sets_report(spark, sf):
    """Overall, by class and by topic in one pass (an extension)."""
    df = C.decisions(spark, sf)
    return df.groupingSets([["arm"], ["arm", "klass"], ["arm", "topic"]], "arm", "klass", "topic").agg(*M.confusion(), F.round(F.avg(F.col("reject").cast("int")), 3).alias("reject_rate"))


@query(O.sql(O.ITEMS, O.PROXIES, O.VOTES, select="SELECT pos, n_slop, n_legit, panel_gt FROM voted"))
def panel_majority(spark, sf):
    return C.panel(spark, sf).select("pos", "n_slop", "n_legit", "panel_gt")


@query(O.sql(O.ITEMS, O.PROXIES, O.VOTES, """t AS (SELECT count(*) AS n, avg((n_slop * (n_slop - 1) + n_legit * (n_legit - 1)) / 6.0::DOUBLE) AS p_bar, sum(n_slop) / (count(*) * 3.0::DOUBLE) AS ps, sum(n_legit) / (count(*) * 3.0::DOUBLE) AS pl FROM voted)""",
  select="SELECT n, CASE WHEN n = 0 THEN 0.0 WHEN 1 - (ps * ps + pl * pl) = 0 THEN 1.0 ELSE round((p_bar - (ps * ps + pl * pl)) / (1 - (ps * ps + pl * pl)), 3) END AS kappa FROM t"))
def fleiss_kappa(spark, sf):
    return kappa(C.panel(spark, sf), ["n_slop", "n_legit"], 3)


def kappa(counts, categories, raters):
    """Fleiss' kappa of a table of label counts a row; abstentions count as raters without a label."""
    pairs = sum((F.col(c) * (F.col(c) - 1) for c in categories), F.lit(0))
    one = (pairs / float(raters * (raters - 1))) if raters > 1 else F.lit(1.0)
    t = counts.agg(F.count("*").alias("n"), F.avg(one).alias("p_bar"), *(F.sum(c).alias(c) for c in categories))
    chance = sum((F.pow(M.share(F.col(c), F.col("n") * raters), F.lit(2.0)) for c in categories), F.lit(0.0))
    return t.select("n", F.when(F.col("n") == 0, 0.0).when(1 - chance == 0, 1.0).otherwise(F.round((F.col("p_bar") - chance) / F.nullif(1 - chance, F.lit(0.0)), 3)).alias("kappa"))


_dlo, _dhi = O.wilson("b_right", "discordant")


@query(O.sql(*BASE, """p AS (SELECT pos, gt_slop, max(reject) FILTER (arm = 'T') AS a, max(reject) FILTER (arm = 'B2') AS b FROM decisions WHERE labelled GROUP BY pos, gt_slop),
d AS (SELECT count(*) FILTER ((a = gt_slop) AND (b <> gt_slop)) AS a_right, count(*) FILTER ((b = gt_slop) AND (a <> gt_slop)) AS b_right FROM p),
e AS (SELECT *, a_right + b_right AS discordant FROM d)""", select=f"SELECT a_right, b_right, discordant, round({O.share('b_right', 'discordant')}, 3) AS ratio_b, {_dlo} AS lo, {_dhi} AS hi FROM e"))
def paired_discordance(spark, sf):
    """Where T and B2 disagree, which is right; pairs come from one wide row, not a self-join."""
    a, b, g = F.col("T") == F.col("gt_slop"), F.col("B2") == F.col("gt_slop"), "labelled"
    out = C.wide_decisions(spark, sf).where(g).agg(F.count_if(a & ~b).alias("a_right"), F.count_if(b & ~a).alias("b_right")).withColumn("discordant", F.col("a_right") + F.col("b_right"))
    lo, hi = M.wilson(F.col("b_right"), F.col("discordant"))
    return out.select("a_right", "b_right", "discordant", F.round(M.share(F.col("b_right"), F.col("discordant")), 3).alias("ratio_b"), lo.alias("lo"), hi.alias("hi"))


@query(O.sql(*BASE, O.VOTES, select="""SELECT d.arm, v.panel_gt, count(*) AS n, count(*) FILTER (d.reject) AS rejected FROM decisions d JOIN voted v USING (pos) GROUP BY d.arm, v.panel_gt"""))
def join_decisions(spark, sf):
    """Decisions with the panel's labels, joined by item."""
    out = C.decisions(spark, sf).select("pos", "arm", "reject").join(C.panel(spark, sf).select("pos", "panel_gt"), "pos")
    return out.groupBy("arm", "panel_gt").agg(F.count("*").alias("n"), F.count_if("reject").alias("rejected"))

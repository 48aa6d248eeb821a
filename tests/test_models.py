"""Scorers and word models against plain versions, and parent chains."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import cache as K
from sluice.operators import chains, ivf, lm
from sluice.operators import embeddings as E
from sluice.operators import retrieval as V
from sluice.operators import scoring as S


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "pos long, prose string")


def plain(scorer, df):
    return {r["pos"]: r for r in S.decided(S.outcomes(df, scorer), scorer).collect()}


def test_replies_are_read():
    assert S.readable('{"a": 1}') == '{"a": 1}' and S.readable('```json\n{"a": [1, 2, ], }\n```') == '{"a": [1, 2]}'
    assert S.readable('Sure: {"a": {"b": 2}} as you asked') == '{"a": {"b": 2}}'
    for bad in ("", "no", "{", '{"a": NaN}', "{'a': 1}"):
        assert S.readable(bad) is None
    assert S.readable("[1, 2]") == "[1, 2]"


REPLIES = [
    ('{"machine_generated": true}', True), ('{"machine_generated": false, "p_ai": 0.5}', True), ('{"machine_generated": false, "p_ai": 0.49}', False),
    ('{"machine_generated": "false"}', False), ('{"machine_generated": " No "}', False), ('{"machine_generated": "yes"}', True), ('{"machine_generated": ""}', False),
    ('{"machine_generated": 0}', False), ('{"machine_generated": 2}', True), ('{"machine_generated": 0.0}', False), ('{"machine_generated": null}', False),
    ('{"machine_generated": []}', False), ('{"machine_generated": [0]}', True), ('{"machine_generated": {}}', False), ("{}", False),
    ('{"p_ai": "0.7"}', True), ('{"p_ai": "much"}', None), ('{"p_ai": null}', None), ('{"machine_generated": true, "p_ai": "much"}', True), ("[]", None), ("7", None),
]


def test_detector_replies(spark):
    """None: the reply says nothing, and the text is admitted as one that failed."""
    scorer = S.detector("x", lambda prompts, attempt: [p.split("\n\n", 1)[1] for p in prompts], wait=0)
    got = plain(scorer, items_of(spark, [r for r, _ in REPLIES]))
    assert [(got[k]["decision"], got[k]["failed"]) for k in range(len(REPLIES))] == [(bool(want), want is None) for _, want in REPLIES]


def test_judges_and_raters(spark):
    echo = lambda prompts, attempt: [p.split("\n\n", 1)[1] for p in prompts]
    got = plain(S.judge("x", echo, wait=0), items_of(spark, ['{"admit": true}', '{"admit": "false"}', "{}", '{"admit": null}', "oops"]))
    assert [got[k]["decision"] for k in range(5)] == [False, True, False, True, False] and got[4]["outcome"]["attempts"] == 3
    got = plain(S.rater("x", echo, wait=0), items_of(spark, ['{"label": "slop"}', '{"label": "odd"}', "{}", "oops", None]))
    assert [got[k]["decision"] for k in range(5)] == ["slop", "odd", "legit", "abstain", "abstain"]


class Service:
    """Fails as a text tells, a letter a call: e raises, u is unreadable, g is good; the last one goes on."""

    def __call__(self, prompts, attempt):
        out = []
        for p in prompts:
            script = p.split("\n\n", 1)[1]
            step = script[min(attempt, len(script) - 1)]
            out.append({"e": TimeoutError("late"), "u": "{ no", "g": '{"admit": false}'}[step])
        return out


@pytest.mark.parametrize(("script", "calls", "failed"), [("g", 1, False), ("eg", 2, False), ("eeg", 3, False), ("eee", 3, True), ("ug", 2, False), ("uug", 3, False), ("uuu", 3, True), ("ueeg", 4, False), ("eeueeg", 6, False), ("ueee", 4, True), ("eeueeueeu", 9, True)])
def test_calls_until_an_answer(script, calls, failed):
    """Three errors in a row end a row, as do three replies that can't be read; an answer, readable or not, clears the errors."""
    reply, error, attempts = S._ask(S.judge("x", Service(), wait=0), ["asked\n\n" + script])[0]
    assert attempts == calls and (reply is None) == failed == (error is not None)


def test_a_batch_that_fails_whole():
    def broken(prompts, attempt):
        if attempt == 0:
            raise RuntimeError("down")
        return ['{"admit": false}'] * (len(prompts) - (attempt == 1))

    out = S._ask(S.judge("x", broken, wait=0), ["a", "b"])
    assert [x[2] for x in out] == [3, 3] and all(x[0] for x in out)
    assert S.available([S.judge("x", broken), S.judge("y", lambda p, a: ["ok"])])[0].name == "y"


def test_resumed_runs_ask_for_what_failed(spark, tmp_path):
    texts = ["g", "eee", "ug", "uuu", None]
    df, path = items_of(spark, texts), f"file://{tmp_path}/cache"
    first = {r["pos"]: r for r in S.resumed(df, S.judge("s", lambda p, a: Service()([x + "g" * x.endswith("\n\n") for x in p], a), wait=0), path, "1").collect()}
    assert {k: r["outcome"]["reply"] is None for k, r in first.items()} == {0: False, 1: True, 2: False, 3: True, 4: False}
    asked = spark.sparkContext.accumulator(0)

    def steady(prompts, attempt):
        asked.add(len(prompts))
        return ['{"admit": true}'] * len(prompts)

    second = {r["pos"]: r for r in S.resumed(df, S.judge("s", steady, wait=0), path, "1").collect()}
    assert {k: r["cached"] for k, r in second.items()} == {0: True, 1: False, 2: True, 3: False, 4: True} and asked.value == 2
    assert S.resumed(df, S.judge("other", steady, wait=0), path, "1").where("cached").isEmpty()


def test_panel_with_failures(spark):
    say = lambda *labels: lambda prompts, attempt: [json.dumps({"label": labels[int(p[-1])]}) if labels[int(p[-1])] else ConnectionError() for p in prompts]
    raters = [S.rater("a", say("slop", "slop", "", ""), wait=0), S.rater("b", say("slop", "legit", "slop", ""), wait=0), S.rater("c", say("legit", "", "", ""), wait=0)]
    df = items_of(spark, ["0", "1", "2", "3"])
    got = {r["pos"]: (r["votes"], r["n_slop"], r["n_legit"], r["label"]) for r in S.panel(df, raters, lambda r: S.outcomes(df, r)).collect()}
    assert got[0][1:] == (2, 1, "slop") and got[1][1:] == (1, 1, "legit") and got[2][1:] == (1, 0, "slop") and got[3] == ({"a": "abstain", "b": "abstain", "c": "abstain"}, 0, 0, "legit")


def test_perplexities_match_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 3)
    rng = random.Random(3)
    texts = [" ".join(rng.choices("a b c d e f g h".split(), [9, 6, 4, 3, 2, 1, 1, 1], k=rng.randrange(0, 30))) for _ in range(40)] + [None, "", "new words only here"]
    df = items_of(spark, texts)
    got = {r["pos"]: r for r in lm.perplexities(df, F.split(F.coalesce("prose", F.lit("")), " "), F.col("pos") < 30).collect()}
    split = [(t or "").split(" ") for t in texts]
    one, two = Counter(w for t in split[:30] for w in t), Counter(p for t in split[:30] for p in zip(t, t[1:]))
    after, kinds = Counter(), Counter()
    for (u, _), c in two.items():
        after[u] += c
        kinds[u] += 1
    p1 = lambda v: (one[v] + lm.ADDED) / (sum(one.values()) + lm.ADDED * (len(one) + 1))
    p2 = lambda u, v: (max(two[u, v] - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[u] * p1(v)) / after[u] if after[u] else p1(v)
    for k, t in enumerate(split):
        n = len(t) - 1
        assert got[k]["n"] == n and got[k]["train"] == (k < 30)
        if not n:
            assert got[k]["unigram"] is None and got[k]["bigram"] is None
            continue
        for name, cost in (("unigram", [-math.log(p1(v)) for v in t[1:]]), ("bigram", [-math.log(p2(u, v)) for u, v in zip(t, t[1:])])):
            assert got[k][name] == pytest.approx(math.exp(min(sum(cost) / n, 20)), rel=1e-4)
    for u in "abc":  # chances after a word sum to one over the vocabulary and the unseen
        assert sum(p2(u, v) for v in one) + lm.DISCOUNT * kinds[u] / after[u] * lm.ADDED / (sum(one.values()) + lm.ADDED * (len(one) + 1)) == pytest.approx(1)


# ---- parent chains


def follow(spark, pairs, root=0):
    df = spark.createDataFrame(pairs, "node long, parent long")
    return {r["node"]: (r["depth"], r["ends"]) for r in chains.follow(df, F.lit(root)).collect()}


def test_chains(spark):
    got = follow(spark, [(1, 0), (2, 1), (3, 2), (4, 4), (5, 4), (6, 5), (7, 8), (8, 9), (9, 7), (10, 9), (11, None), (12, 11), (13, 99), (14, 13), (2, 1), (15, 3), (15, 99), (None, 1)])
    assert got == {1: (1, "root"), 2: (2, "root"), 3: (3, "root"), 4: (1, "self"), 5: (2, "self"), 6: (3, "self"), 7: (None, "loop"), 8: (None, "loop"), 9: (None, "loop"), 10: (None, "loop"),
                   11: (1, "missing"), 12: (2, "missing"), 13: (1, "missing"), 14: (2, "missing"), 15: (4, "root")}
    assert follow(spark, [(0, None), (1, 0)]) == {0: (0, "root"), 1: (1, "root")}
    assert chains.follow(spark.createDataFrame([], "node long, parent long"), F.lit(0)).count() == 0


def test_a_long_chain(spark):
    n = 700
    assert follow(spark, [(k, k - 1) for k in range(1, n + 1)]) == {k: (k, "root") for k in range(1, n + 1)}


def test_many_scopes(spark):
    """More than Spark's limit of rows in a recursive query."""
    df = spark.range(1, 300_001).select(F.col("id").alias("node"), F.expr("id div 2").alias("parent"))
    out = chains.follow(df, F.lit(0)).agg(F.count("*"), F.sum("depth"), F.count_if(F.col("ends") == "root")).first()
    assert tuple(out) == (300_000, sum(k.bit_length() for k in range(1, 300_001)), 300_000)


def test_signatures_differ_by_scorer():
    assert K.signature({"scorer": "a", "run": "1"}) != K.signature({"scorer": "b", "run": "1"})


# ---- approximate retrieval


def clustered(spark, rows, clusters, width, spread, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    v = centres[rng.integers(0, clusters, rows)] + spread * rng.normal(size=(rows, width))
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    df = spark.createDataFrame([(k, x, str(k % 3)) for k, x in enumerate(v.tolist())], "pos long, vector array<double>, source string")
    return df, df.where("pos % 20 = 0").select(F.col("pos").alias("q"), "vector", F.col("source").alias("q_source"))


@pytest.mark.parametrize(("clusters", "spread"), [(30, 0.3), (1, 5.0)])
def test_inverted_file_finds_most(spark, clusters, spread):
    """Vectors in clusters, and vectors without any: few cells are looked into, or many."""
    df, asked = clustered(spark, 3000, clusters, 16, spread)
    index = ivf.build(df)
    got = ivf.recall(ivf.top_k(asked, index, 5), V.top_k(asked, df, 5)).first()
    assert (got["queries"], got["wanted"]) == (150, 750) and got["recall"] >= 0.9
    assert index.file.count() == 3000 and (index.probes < 15) == (clusters > 1)


def test_inverted_file_is_exact_with_all_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "PASSAGE_BLOCK", 40)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    df, asked = clustered(spark, 400, 3, 4, 0.01)
    df = df.unionByName(df.limit(1).selectExpr("9999L as pos", "cast(null as array<double>) as vector", "source"))
    index = ivf.build(df, cells=5)
    for leave_out in (False, True):
        exact, found = (sorted(map(tuple, x.collect())) for x in (V.top_k(asked, df, 4, leave_out), ivf.top_k(asked, index, 4, probes=5, leave_out=leave_out)))
        assert found == exact
    none = df.limit(0)
    assert ivf.top_k(asked, ivf.build(none), 4).count() == 0 and ivf.top_k(asked.limit(0), index, 4).count() == 0


# ---- embedding cache


def test_embeddings_are_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    made = spark.sparkContext.accumulator(0)

    def model(fails):
        def run(texts):
            made.add(len(texts))
            return [None if t in fails else [len(t), 1.0] for t in texts]

        return run

    df = spark.createDataFrame([(0, "aa"), (1, "bbb"), (2, "aa"), (3, None), (4, "c"), (5, "")], "pos long, text string")
    first = {r["pos"]: r for r in E.embedded(df.where("pos < 4"), path, "m", model({"bbb"})).collect()}
    assert made.value == 2 and {k: (r["vector"] is not None, r["cached"]) for k, r in first.items()} == {0: (True, False), 1: (False, False), 2: (True, False), 3: (False, False)}
    second = {r["pos"]: r for r in E.embedded(df, path, "m", model(())).collect()}
    assert made.value == 5 and {k: (r["vector"] is not None, r["cached"]) for k, r in second.items()} == {0: (True, True), 1: (True, False), 2: (True, True), 3: (False, False), 4: (True, False), 5: (True, False)}
    assert second[1]["vector"] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    E.embedded(df, path, "other", model(()))
    assert made.value == 9 and len(E.runs(spark, path)) == 3
    before = {(r["sig"], r["sha"]): r["vector"] for r in E.entries(spark, path).collect()}
    E.compact(spark, path)
    assert len(E.runs(spark, path)) == 1 and {(r["sig"], r["sha"]): r["vector"] for r in E.entries(spark, path).collect()} == before and len(before) == 8
    assert E.embedded(df, path, "m", model(())).where("vector is not null and not cached").isEmpty() and made.value == 9


def test_failed_embeddings_are_kept_where_they_are_not_retried(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(0, "aa"), (1, "b")], "pos long, text string")

    def broken(texts):
        raise RuntimeError("down")

    assert E.embedded(df, path, "m", broken).where("vector is null and not cached").count() == 2
    assert E.embedded(df, path, "m", lambda t: [[1.0]] * len(t), retry=False).where("vector is null and cached").count() == 2
    assert E.embedded(df, path, "m", lambda t: [[2.0]] * len(t)).where("vector[0] = 1.0 and not cached").count() == 2
    assert E.compact(spark, f"file://{tmp_path}/none") == "" and E.entries(spark, f"file://{tmp_path}/none").count() == 0
    assert [E.normalized(v) for v in (None, [], [0.0], [float("nan"), 1.0], [3.0, 4.0])] == [None, None, None, None, [0.6, 0.8]]

"""Hard negatives, lexical search and substring dedup against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sluice.llm import hard_negatives, lexical_search, substring_dedup
from tests.llm.edge import empty, hard, words


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ---- hard negatives


def brute_negatives(rows, every=50, positives=5, negatives=3):
    fine = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, label, v in fine:
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last(i), i, other) for i, other, w in fine if i != a), key=lambda x: x[:2])
        for p, _, i, _ in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
            out += [(a, i, k + 1, x[2], -p, -x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


def mined(df, **how):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, df["vec_id"] % 50 == 0, **how).collect()), key=str)


VECTORS = "vec_id long, label int, embedding array<float>"


def test_negatives_match_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert mined(df) == brute_negatives([(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()])


def test_negatives_in_small_blocks_with_ties(spark, monkeypatch):
    """Most rows have one vector, so the k-th scores are shared by rows of many blocks."""
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    rng = random.Random(5)
    common = [0.5, -0.25, 0.125]
    rows = [(k, rng.randrange(3), common if k % 3 else [rng.uniform(-1, 1) for _ in range(3)]) for k in range(400)]
    rows += [(k, k % 3, [300.0 * x for x in common]) for k in (400, 401, 402)]  # windows of more than two digits
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)


def test_negatives_hard_cases(spark):
    nan, far = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (50, None, [1.0, 0.0]), (100, 1, None), (150, 1, [1.0, None]), (200, 1, [nan, 1.0]), (250, 1, [far, 1.0]), (300, 1, []), (350, 1, [0.0, 0.0])]
    rows += [(None, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.75]), (3, 2, [0.75, 9.0, 9.0]), (None, 2, [0.75]), (4, 2, [0.96]), (5, 2, [0.5]), (6, 1, [-1.0])]
    got = mined(spark.createDataFrame(rows, VECTORS))
    assert got == brute_negatives(rows) and (0, 1, 1, 2, 65536, 49152) in got and (0, 1, 3, None, 65536, 49152) in got and (0, None, 1, 2, 65536, 49152) in got
    assert mined(spark.createDataFrame([], VECTORS)) == []
    twice = mined(spark.createDataFrame([(0, 1, [1.0]), (0, 1, [1.0]), (7, 1, [1.0]), (7, 1, [1.0]), (8, 2, [0.75])], VECTORS))
    assert twice == [(0, 7, 1, 8, 65536, 49152)] * 4
    clash = spark.createDataFrame([(0, 1, [1.0], 3, "x"), (7, 1, [1.0], 4, "y"), (8, 2, [0.75], 5, "z")], VECTORS + ", rank int, low string")
    assert mined(clash) == [(0, 7, 1, 8, 65536, 49152)]


def test_exact_inner_products():
    big = np.array([[2.0**40, 1.0]])
    assert hard_negatives.inner_products(big, np.array([[2.0**21, 3.0]]))[0, 0] == 2**61 + 3
    assert hard_negatives.inner_products(big, np.array([[2.0**30, 3.0], [-(2.0**30), 0.0]])).tolist() == [[2**63 - 1, -(2**63)]]


# ---- lexical search


def brute_search(docs, items, k=50):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            m = 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if bag[t])
            if s > 0:
                scored.append((-s, (i is None, i or 0), i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def found(docs, items, **how):
    return sorted(map(tuple, lexical_search.search(docs, items, **how).collect()), key=str)


def test_search_matches_brute_force(spark, docs, texts, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert found(docs, items) == brute_search(list(texts.items()), [tuple(r) for r in items.collect()])


def test_search_falls_through_tiers(spark, monkeypatch):
    """Few postings in the first tiers: some items are proven there, some need all; blocks are small, and terms are joined in parts."""
    monkeypatch.setattr(lexical_search, "RARE", 4)
    monkeypatch.setattr(lexical_search, "POSTING_BLOCK", 100)
    monkeypatch.setattr(lexical_search, "ASKED_BLOCK", 3)
    monkeypatch.setattr(lexical_search, "LEXICON", 3)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["the", "of", "Äpfel", "x1", f"own{k % 9}", f"rare{k % 40}"], [9, 5, 2, 2, 2, 1], k=rng.randrange(1, 40)))) for k in range(300)]
    items = [(1, "the of"), (2, "rare7 rare8 ÄPFEL"), (3, "own1, the: X1!"), (4, "nothing here"), (5, "rare3")]
    df, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(df, asked, k=3) == brute_search(rows, items, 3)
    assert found(df, asked, k=50) == brute_search(rows, items, 50)


def test_search_hard_cases(spark):
    rows = [(r["doc_id"], r["text"]) for r in hard(spark).collect()]
    items = [(1, "alpha Beta GAMMA"), (1, "alpha Beta GAMMA"), (None, "passage elsewhere café"), (3, None), (4, ""), (5, "w1x1 one 漢字😀 漢字")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert found(hard(spark), asked) == brute_search(rows, items)
    assert found(empty(spark), asked) == [] and found(hard(spark), asked.limit(0)) == []


# ---- substring dedup


def brute_cut(rows, window=50):
    first = {}
    for i, text in rows:
        i, w = (2**63 - 1 if i is None else i), words(text)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (2**63 - 1 if i is None else i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cut(df):
    return sorted(map(tuple, substring_dedup.remove_repeated_words(df).select("doc_id", "n_words", "n_removed", "kept", "kept_sha256").collect()), key=str)


def test_substring_dedup_matches_brute_force(docs, texts):
    got = cut(docs)
    assert got == brute_cut(list(texts.items())) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("group", [1, 4096])
def test_substring_dedup_shared_passages(spark, monkeypatch, group):
    """Passages of all lengths about the window's, at any place; with a group of one suffix all prefixes are prolonged."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (30, 49, 50, 51, 75, 120, 400)] + [["again"] * 130]
    rows = []
    for k in range(160):
        w = fresh(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, max(1, len(p) - 40))
            w += p[a : a + rng.randrange(40, 200)] + fresh(rng.randrange(0, 60))
        rows.append((rng.randrange(10**6), " ".join(w) if k % 2 else "  " + "\n".join(w)))
    rows += [(10**6 + k, rows[k % 5][1]) for k in range(40)]
    got = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == brute_cut(rows) and sum(r[2] for r in got) > 5_000


def test_substring_dedup_hard_cases(spark):
    df = hard(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert cut(df) == brute_cut(rows)
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(None, long), (3, long), (3, long), (3, long + " more"), (4, "x " + long), (4, "x " + long), (5, long)]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == brute_cut(rows)
    clash = spark.createDataFrame([(1, long, "mine", 7), (2, long, "yours", 8)], "doc_id long, text string, kept string, row long")
    out = substring_dedup.remove_repeated_words(clash)
    assert out.columns == ["doc_id", "text", "row", "n_words", "n_removed", "kept", "kept_sha256"] and {r["doc_id"]: (r["row"], r["n_removed"]) for r in out.collect()} == {1: (7, 0), 2: (8, 80)}
    assert substring_dedup.remove_repeated_words(empty(spark)).count() == 0

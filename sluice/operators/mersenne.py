"""Permutations on one Mersenne twister stream, drawn in parallel.

The published tests draw all coins from one generator, in order. The generator is linear over GF(2), so
its state any number of outputs on is a sum of its next 19,937 states: those that the remainder of
x**outputs by the generator's characteristic polynomial names. Blocks of coins start there, each in a
task of its own.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.thresholds import numbered

#: Words of the generator's state, and the degree of its polynomial.
WORDS, DEGREE = 624, 19937
#: Coins of a task, and blocks whose coins one task takes for an iteration.
COINS, BLOCKS = 1 << 25, 1 << 20
CELLS = ("tp", "fp", "fn", "tn")


def seeded(seed: int) -> np.ndarray:
    """The state that the published stream starts from."""
    return np.random.RandomState([seed]).get_state()[1]


def _generator(state: np.ndarray) -> np.random.RandomState:
    out = np.random.RandomState(0)
    out.set_state(("MT19937", state, WORDS))
    return out


def _following(state: np.ndarray, count: int) -> np.ndarray:
    """The state's words and at least `count` words after them, before they are tempered."""
    generator, out = _generator(state), [state]
    for _ in range(-(-count // WORDS)):
        generator.random_sample(WORDS // 2)  # each takes two words
        out.append(generator.get_state()[1])
    return np.concatenate(out)


@functools.cache
def polynomial() -> int:
    """The characteristic polynomial, its bits as a number, found from one bit of a sequence by Berlekamp and Massey's algorithm."""
    bits = (_following(seeded(1), 2 * DEGREE + WORDS)[WORDS : WORDS + 2 * DEGREE] & 1).tolist()
    # connection polynomials, lowest power first; seen holds the sequence so far, the latest bit lowest
    now, before, length, since, seen = 1, 1, 0, 1, 0
    for k, bit in enumerate(bits):
        seen = (seen << 1) | bit
        if not (now & seen).bit_count() & 1:
            since += 1
        elif 2 * length <= k:
            now, before = now ^ (before << since), now
            length, since = k + 1 - length, 1
        else:
            now ^= before << since
            since += 1
    assert length == DEGREE
    return int(format(now, "b").zfill(length + 1)[::-1], 2)  # the reciprocal


def _remainder(value: int) -> int:
    by = polynomial()
    while (over := value.bit_length() - 1 - DEGREE) >= 0:
        value ^= by << over
    return value


def power(outputs: int) -> int:
    """x**outputs modulo the polynomial."""
    out = 1
    for digit in format(outputs, "b"):
        out = _remainder(int("0".join(format(out, "b")), 2) << int(digit))  # squared: its digits move apart
    return out


def jumped(state: np.ndarray, by: int) -> np.ndarray:
    """The state as many outputs on as `by`, a power of x, stands for."""
    words = _following(state, DEGREE)
    named = np.flatnonzero(np.array(list(format(by, "b")[::-1])) == "1")
    windows = np.lib.stride_tricks.sliding_window_view(words, WORDS)
    out = np.zeros(WORDS, words.dtype)
    for a in range(0, len(named), 1024):
        out ^= np.bitwise_xor.reduce(windows[named[a : a + 1024]], axis=0)
    return out


def _moved(blocks: pa.Table, state: np.ndarray, first: int, count: int, wide: int, step: int) -> pa.Table:
    """(iter, tp, fp, fn, tn): what the coins of iterations first to first + count - 1 move, of blocks numbered below wide.

    state: that of the first coin of the first iteration; step: the power of x that leads from one
    iteration's coins to the next's, 0 where they follow each other.
    """
    at, diff = blocks.column("k").to_numpy(), np.stack([blocks.column(c).to_numpy() for c in CELLS], 1)
    out, generator = [], _generator(state)
    together = 1 if step else max(1, BLOCKS // wide)
    for a in range(0, count, together):
        n = min(together, count - a)
        coins = generator.random_sample((n, wide)) < 0.5
        out.append(coins[:, at].astype(np.int64) @ diff)
        if step and a + 1 < count:
            state = jumped(state, step)
            generator = _generator(state)
    moved = np.concatenate(out)
    return pa.table({"iter": np.arange(first, first + count, dtype=np.int64), **{c: moved[:, k] for k, c in enumerate(CELLS)}})


def swaps(blocks: DataFrame, order: str, iters: int, seed: int, skip: int = 0) -> tuple[DataFrame, int]:
    """((iter, tp, fp, fn, tn), coins): what swaps move in each iteration from 1 on, and the coins drawn.

    blocks: order, and what each block's swap moves, tp to tn. An iteration draws a coin for each
    block in order, from the seeded stream after its first `skip` coins. Blocks that move nothing have
    coins that aren't looked at, and aren't shipped; the others are dealt over parts of BLOCKS blocks
    and COINS coins.
    """
    listed = numbered(blocks, order, "k")
    m = listed.count()
    spark, start = blocks.sparkSession, seeded(seed)
    if not m:
        return spark.range(1, iters + 1).select(F.col("id").alias("iter"), *(F.lit(0).cast("long").alias(c) for c in CELLS)), 0
    wide = min(m, BLOCKS)
    each = max(1, COINS // wide)  # iterations of a task
    chunks = -(-iters // each)
    some = listed.where(" or ".join(f"{c} <> 0" for c in CELLS)).select(F.expr(f"k div {wide}").alias("part"), (F.col("k") % wide).alias("k"), *(F.col(c).cast("long").alias(c) for c in CELLS))
    some = some.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        part, chunk = (int(x.as_py()) for x in key)
        own, first = min(wide, m - part * wide), chunk * each
        state = jumped(start, power(2 * (skip + first * m + part * wide)))
        return _moved(rows, state, first + 1, min(each, iters - first), own, power(2 * m) if own < m else 0)

    moved = some.groupBy("part", "chunk").applyInArrow(task, "iter long, tp long, fp long, fn long, tn long")
    every = spark.range(1, iters + 1).withColumnRenamed("id", "iter")
    sums = moved.groupBy("iter").agg(*(F.sum(c).alias(c) for c in CELLS))
    return every.join(sums, "iter", "left").select("iter", *(F.coalesce(c, F.lit(0)).alias(c) for c in CELLS)), iters * m

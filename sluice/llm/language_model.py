"""LM scoring: Brown class-based bigrams, with classes from exchange clustering.

The most frequent words are exchanged one by one; every task then holds the classes of the FREQUENT
most frequent words, which move in rounds against counts of their neighbours' classes; each other
word that is seen twice or more gets its class from its neighbours' classes by a shuffle on the
word, so the clustered vocabulary grows with the corpus. Words seen once, and unseen ones, are
classed by their shapes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.shared import chunks, documents, lowered, materialize, prefix_hash, small_batches, span_hash, utf8, word_spans

#: Words that every task holds (numbers of 16 bits, with the shapes' and the end's); of these, the words that
#: the driver exchanges one by one; and classes. Sizes that don't grow: all other words are classed and counted by joins.
FREQUENT, SEEDS, CLASSES, SWEEPS, ROUNDS = (1 << 16) - 64, 1024, 64, 4, 2
#: Classes of the words that are seen once or never: by length, last byte and non-ASCII bytes.
SHAPES = 32
#: Added to a word's count, and to a class transition's.
ADDED, ADDED_TRANSITION = 0.1, 0.1
#: Tokens for which a round's counts are dealt over one part more, the least number of parts, and numbers
#: that a task gathers before it merges them.
PART_TOKENS, PARTS, _HELD = 1 << 23, 32, 1 << 21

_KIND = np.full(256, 3, np.int64)
_KIND[[*range(65, 91), *range(97, 123)]] = 0
_KIND[128:] = 1
_KIND[48:58] = 2


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape of each word, A-Z folded; words per text). Null texts are empty."""
    raw, offsets = utf8(texts)
    starts, ends, counts = word_spans(raw, offsets)
    words = span_hash(prefix_hash(lowered(raw)), starts, ends)
    if not len(starts):
        return words, np.zeros(0, np.int64), counts
    wide = np.concatenate(([0], np.cumsum(raw >= 128)))
    length = np.digitize(ends - starts, (3, 6, 10))
    return words, length * 8 + _KIND[raw[ends - 1]] * 2 + (wide[ends] > wide[starts]), counts


def _merged(parts: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, their weights' sums, place of each one's first)."""
    values, first, index = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    return values, np.bincount(index, np.concatenate(weights), len(values)).astype(np.int64), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts in a task, merged while they are few enough to hold."""

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[2].astype(np.int32)), pa.array(held[1])], ["word", "shape", "n"])

    held = None
    for whole in batches:
        for batch in chunks(whole):
            words, shapes, _ = tokens_of(batch.column(0))
            values, n, first = _merged([words], [np.ones(len(words))])
            own = values, n, shapes[first]
            if held is not None:
                values, n, first = _merged([held[0], own[0]], [held[1], own[1]])
                own = values, n, np.concatenate((held[2], own[2]))[first]
            held = own
            if len(held[0]) > _HELD:
                yield out()
                held = None
    if held is not None and len(held[0]):
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, shape, n): the counts of all words of a one-column table of texts, by 64-bit hash."""
    return materialize(texts.mapInArrow(_count, "word long, shape int, n long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")), "words")


@dataclass
class Vocabulary:
    """The frequent words: symbol k is the k-th most frequent; after them come SHAPES symbols of the others, and the end."""

    words: np.ndarray  # sorted hashes
    symbol: np.ndarray  # of each of them
    counts: np.ndarray  # of each symbol
    shape: np.ndarray
    ends: int  # texts learnt from
    total: int
    distinct: int

    def look_up(self, tokens: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return shapes
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, self.symbol[at], len(self.words) + shapes)


def vocabulary(counts: DataFrame, texts: int, frequent: int) -> Vocabulary:
    """From word_counts of so many texts. The driver gets `frequent` rows and a row."""
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Vocabulary(words[order], order, top.column("n").to_numpy(), top.column("shape").to_numpy().astype(np.int64), texts, (whole["n"] or 0) + texts, whole["v"] + (texts > 0))


def _encode(batches: Iterator[pa.RecordBatch], known: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Texts as symbols of 16 bits, and the hashes of their other words."""
    row = TaskContext.get().partitionId() << 33
    for whole in batches:
        for batch in chunks(whole):
            tokens, shapes, counts = tokens_of(batch.column(1))
            symbols = known.look_up(tokens, shapes)
            rare = symbols >= len(known.words)
            flat, at = symbols.astype("<u2").tobytes(), np.concatenate(([0], np.cumsum(counts)))
            listed = np.concatenate(([0], np.cumsum(rare)))[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(counts))),
                    batch.column(0),
                    batch.column(2),
                    pa.array([flat[2 * a : 2 * z] for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(listed, pa.int32()), pa.array(tokens[rare].view(np.int64))),
                ],
                ["row", "key", "learn", "symbols", "rare"],
            )
            row += len(counts)


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a column of packed numbers, numbers per row)."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw.tobytes(), kind).astype(np.int64), np.diff(at) // size


def _neighbours(groups: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups before and after each token; `end` stands before and after a text."""
    before, after = np.concatenate(([end], groups[:-1])), np.concatenate((groups[1:], [end]))
    some = counts > 0
    last = np.cumsum(counts)[some]
    before[last - counts[some]] = end
    after[last - 1] = end
    return (before, after) if len(groups) else (groups, groups)


def _pairs(batches: Iterator[pa.RecordBatch], kind: str, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's counts of pairs of neighbours' groups; the last group is the end."""
    k = int(group.max()) + 1
    total = np.zeros(k * k, np.int64)
    for batch in batches:
        symbols, counts = _flat(batch.column(0), kind)
        groups = group[symbols]
        before, after = _neighbours(groups, counts, k - 1)
        total += np.bincount(before * k + groups, minlength=k * k)
        last = np.cumsum(counts)[counts > 0] - 1
        total += np.bincount(groups[last] * k + k - 1, minlength=k * k)
        total[k * k - 1] += (counts == 0).sum()
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["cell", "n"])


def pair_table(rows: DataFrame, column: str, kind: str, group: np.ndarray) -> np.ndarray:
    """How often each group follows each, over all rows; the driver gets a number a pair of groups."""
    k = int(group.max()) + 1
    found = rows.select(column).mapInArrow(lambda it: _pairs(it, kind, group), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, movable: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of symbols by the exchange algorithm: each movable symbol, in order, goes where the class bigram likelihood is greatest.

    The first `movable` symbols start dealt over `classes` classes; each other symbol keeps a class
    of its own. Ties go to the lower class; sweeps end early when nothing moves.
    """
    size = len(pairs)
    classes = min(classes, max(movable, 1))
    group = np.concatenate((np.arange(movable) % classes, classes + np.arange(size - movable)))
    k = classes + size - movable
    pairs = pairs.astype(float)
    table = np.zeros((k, k))
    np.add.at(table, (group[:, None], group[None, :]), pairs)
    for _ in range(sweeps):
        moved = False
        for w in range(movable):
            own = group[w]
            to, back, self_ = np.bincount(group, pairs[w], k), np.bincount(group, pairs[:, w], k), pairs[w, w]
            to[own] -= self_
            back[own] -= self_
            table[own] -= to
            table[:, own] -= back
            table[own, own] -= self_
            row, column, n_row, n_column = table.sum(1)[:classes] + back[:classes], table.sum(0)[:classes] + to[:classes], to.sum() + self_, back.sum() + self_
            here = np.arange(classes)
            a = _xlogx(table[:classes] + to) - _xlogx(table[:classes])
            b = _xlogx(table[:, :classes].T + back) - _xlogx(table[:, :classes].T)
            corner = table[here, here]
            gain = a.sum(1) - a[here, here] + b.sum(1) - b[here, here] + _xlogx(corner + to[:classes] + back[:classes] + self_) - _xlogx(corner)
            gain -= _xlogx(row + n_row) - _xlogx(row) + _xlogx(column + n_column) - _xlogx(column)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved |= best != own
            group[w] = best
            table[best] += to
            table[:, best] += back
            table[best, best] += self_
        if not moved:
            break
    return group


def _fitting(table: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a neighbour before, one after and a token itself add to the log likelihood of a word in each class."""
    table = table + ADDED_TRANSITION
    return np.log(table[:, :classes]), np.log(table[:classes]).T, np.log(table.sum(1)[:classes]) + np.log(table.sum(0)[:classes])


def _contexts(batches: Iterator[pa.RecordBatch], known: int, group: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A task's counts of the groups before and after each frequent word; word w is dealt to part w modulo `parts`."""
    k = int(group.max()) + 1
    held: list[np.ndarray] = []
    weights: list[np.ndarray] = []

    def merge() -> None:
        values, n, _ = _merged(held, weights)
        held[:], weights[:] = [values], [n]

    per = -(-known // parts)
    for batch in batches:
        symbols, counts = _flat(batch.column(0), "<u2")
        before, after = _neighbours(group[symbols], counts, k - 1)
        own = symbols < known
        at = (symbols[own] % parts * per + symbols[own] // parts) * (2 * k)
        held += [at + before[own], at + k + after[own]]
        weights += [np.ones(own.sum(), np.int64)] * 2
        if sum(map(len, held)) > 2 * _HELD:
            merge()
    if not held:
        return
    merge()
    values, n = held[0], weights[0]
    if not len(values):
        return
    at = np.flatnonzero(np.concatenate(([True], np.diff(values // (2 * k * per)) > 0)))
    for a, z in zip(at, np.append(at[1:], len(values)), strict=True):
        part = int(values[a] // (2 * k * per))
        cells = np.diff(values[a:z] - part * per * 2 * k, prepend=0).astype("<u4")
        data = zstandard.compress(cells.tobytes() + n[a:z].astype("<u4").tobytes(), 1)  # a task's counts are below 2**32
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])


def _move(batches: Iterator[pa.RecordBatch], table: np.ndarray, classes: int, known: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The class of each frequent word that its neighbours fit best, ties to the lower class; from rows sorted by part, of which sums are held."""
    k, per = len(table), -(-known // parts)
    left, right, own = _fitting(table, classes)
    part, total = None, np.zeros(0)

    def out() -> pa.RecordBatch:
        counts = total.reshape(per, 2, k)
        n = counts[:, 0].sum(1)
        fit = counts[:, 0] @ left + counts[:, 1] @ right - n[:, None] * own
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(part + some * parts), pa.array(np.argmax(fit[some], axis=1).astype(np.int32))], ["symbol", "class"])

    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != part:
                if part is not None:
                    yield out()
                part, total = p, np.zeros(per * 2 * k)
            cells, n = np.frombuffer(zstandard.decompress(data.as_buffer()), "<u4").reshape(2, -1)
            total[np.cumsum(cells, dtype=np.int64)] += n
    if part is not None:
        yield out()


def cluster(learnt: DataFrame, known: Vocabulary, seeds: int, classes: int, rounds: int) -> tuple[np.ndarray, int]:
    """(group of each symbol, number of classes), from encoded texts.

    The `seeds` most frequent words are exchanged one by one on the driver, the others standing in
    their shapes' groups. In each round after that all frequent words move to the class that their
    neighbours' groups fit best. Groups are the classes, then the shapes, then the end.
    """
    f = len(known.words)
    seeds = min(seeds, f)
    shapes = np.concatenate((known.shape, np.arange(SHAPES + 1)))
    first = np.where(np.arange(len(shapes)) < seeds, np.arange(len(shapes)), seeds + shapes)
    first[-1] = seeds + SHAPES
    group = exchange(pair_table(learnt, "symbols", "<u2", first), seeds, classes)[first]
    classes = int(group[-1]) - SHAPES
    parts = min(max(PARTS, known.total // PART_TOKENS), max(f, 1))
    for _ in range(rounds if f > 1 else 0):
        table, now = pair_table(learnt, "symbols", "<u2", group), group
        counted = learnt.select("symbols").mapInArrow(lambda it, now=now: _contexts(it, f, now, parts), "part int, data binary")
        dealt = counted.repartition(parts, "part").sortWithinPartitions("part")
        moved = dealt.mapInArrow(lambda it, table=table: _move(it, table, classes, f, parts), "symbol long, class int").toArrow()  # a row a frequent word
        group = now.copy()
        group[moved.column("symbol").to_numpy()] = moved.column("class").to_numpy()
    return group, classes


def _rare_contexts(batches: Iterator[pa.RecordBatch], known: int, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, pair of the groups around it, shape, n) of the words that aren't frequent."""
    k = int(group.max()) + 1
    for batch in batches:
        symbols, counts = _flat(batch.column(0), "<u2")
        before, after = _neighbours(group[symbols], counts, k - 1)
        rare = symbols >= known
        words, cells, shapes = batch.column(1).flatten().to_numpy(), (before * k + after)[rare], symbols[rare] - known
        order = np.lexsort((cells, words))
        words, cells, shapes = words[order], cells[order], shapes[order]
        new = np.concatenate(([True], (words[1:] != words[:-1]) | (cells[1:] != cells[:-1]))) if len(words) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[at]), pa.array(cells[at].astype(np.int32)), pa.array(shapes[at].astype(np.int32)), pa.array(np.diff(np.append(at, len(words))))], ["word", "cell", "shape", "n"]
        )


def _rare_classes(batches: Iterator[pa.RecordBatch], table: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """(word, n, group), from rows sorted by word: words seen once keep their shapes' groups."""
    k = len(table)
    left, right, own = _fitting(table, classes)
    last: tuple | None = None  # the sums of a batch's last word, which may go on in the next

    def out(words, n, shapes, fit):
        group = np.where(n > 1, np.argmax(fit, axis=1), classes + shapes)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n), pa.array(group.astype(np.int32))], ["word", "n", "group"])

    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 15):
            part = batch.slice(a, 1 << 15)
            words, cells, shapes, n = (part.column(c).to_numpy() for c in range(4))
            at = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            fit = np.add.reduceat((left[cells // k] + right[cells % k] - own) * n[:, None], at, axis=0)
            words, shapes, n = words[at], shapes[at], np.add.reduceat(n, at)
            if last is not None:
                if last[0][0] == words[0]:
                    n[0] += last[1][0]
                    fit[0] += last[3][0]
                else:
                    yield out(*last)
            last = words[-1:], n[-1:], shapes[-1:], fit[-1:]
            if len(words) > 1:
                yield out(words[:-1], n[:-1], shapes[:-1], fit[:-1])
    if last is not None:
        yield out(*last)


def rare_words(learnt: DataFrame, known: Vocabulary, group: np.ndarray, table: np.ndarray, classes: int) -> DataFrame:
    """(word, n, group) of all learnt words that aren't frequent; any number of them."""
    found = learnt.select("symbols", "rare").mapInArrow(lambda it: _rare_contexts(it, len(known.words), group), "word long, cell int, shape int, n long")
    found = found.repartition("word").sortWithinPartitions("word")
    return materialize(found.mapInArrow(lambda it: _rare_classes(it, table, classes), "word long, n long, group int"), "rare")


def _grouped(batches: Iterator[pa.RecordBatch], known: Vocabulary, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Encoded texts with what is known of their rare words, as groups of a byte each and sums over the words."""
    f, logs = len(known.words), np.append(np.log10(known.counts + ADDED), 0.0)
    end = np.log10(known.ends + ADDED)
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            names = batch.schema.names
            symbols, counts = _flat(batch.column(names.index("symbols")), "<u2")
            groups = group[symbols]
            rare = symbols >= f
            begin = np.concatenate(([0], np.cumsum(rare)))[np.cumsum(counts) - counts]  # each text's first rare word
            lists = batch.column(names.index("classed"))
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            if lists.null_count:
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            packed = lists.flatten().to_numpy()
            groups[np.flatnonzero(rare)[np.repeat(begin, sizes) + (packed >> 8)]] = packed & 255
            doc = np.repeat(np.arange(len(counts)), counts)
            word = np.bincount(doc, logs[np.minimum(symbols, f)], len(counts)) + end + batch.column(names.index("rare_word")).fill_null(0.0).to_numpy(zero_copy_only=False)
            seen = np.bincount(doc, ~rare, len(counts)).astype(np.int64) + (known.ends > 0) + batch.column(names.index("rare_known")).fill_null(0).to_numpy(zero_copy_only=False)
            flat, at = groups.astype(np.uint8).tobytes(), np.concatenate(([0], np.cumsum(counts)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("key")), batch.column(names.index("learn")), pa.array(counts + 1), pa.array(seen), pa.array(word),
                 pa.array([flat[x:z] for x, z in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                ["key", "learn", "n_tokens", "n_known", "word", "groups"],
            )


def grouped(encoded: DataFrame, rare: DataFrame, known: Vocabulary, group: np.ndarray) -> DataFrame:
    """(key, learn, n_tokens, n_known, word, groups): texts as their tokens' groups. word: the sum of log10 of counts plus ADDED."""
    kind = encoded.schema["key"].dataType.simpleString()
    listed = encoded.select("row", F.posexplode("rare").alias("at", "word")).join(rare.hint("merge"), "word", "left")
    classed = F.when(F.col("n") > 1, F.shiftleft(F.col("at").cast("long"), 8) + F.col("group"))
    listed = listed.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADDED)).alias("rare_word"), F.count("n").alias("rare_known"), F.collect_list(classed).alias("classed")
    )
    rows = encoded.select("row", "key", "learn", "symbols").join(listed.hint("merge"), "row", "left")
    return materialize(rows.mapInArrow(lambda it: _grouped(it, known, group), f"key {kind}, learn boolean, n_tokens long, n_known long, word double, groups binary"), "grouped")


@dataclass
class Model:
    transition: np.ndarray  # log10
    emission: np.ndarray  # of each group: log10 of what a word's count + ADDED is divided by
    known: Vocabulary


def _model(rows: DataFrame, rare: DataFrame, known: Vocabulary, group: np.ndarray) -> Model:
    """Smoothed transitions and emissions from the groups of the texts that are learnt from."""
    k = int(group[-1]) + 1
    table = pair_table(rows.where("learn"), "groups", "u1", np.arange(k))
    distinct = np.bincount(group[: len(known.words)], minlength=k)
    distinct[-1] += known.ends > 0
    for r in rare.groupBy("group").count().collect():  # a row a group
        distinct[r["group"]] += r["count"]
    transition = np.log10((table + ADDED_TRANSITION) / (table.sum(1, keepdims=True) + ADDED_TRANSITION * k))
    return Model(transition, np.log10(table.sum(0) + ADDED * (distinct + 1)), known)


def _score(batches: Iterator[pa.RecordBatch], transition: np.ndarray, emission: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a text's groups add to its score."""
    end = len(emission) - 1
    for batch in batches:
        groups, counts = _flat(batch.column(batch.schema.get_field_index("groups")), "u1")
        before, _ = _neighbours(groups, counts, end)
        doc = np.repeat(np.arange(len(counts)), counts)
        last = np.full(len(counts), end)
        last[counts > 0] = groups[np.cumsum(counts)[counts > 0] - 1]
        rest = np.bincount(doc, transition[before, groups] - emission[groups], len(counts)) + transition[last, end] - emission[end]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rest)], [*batch.schema.names[:4], "rest"])


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", frequent: int | None = None, seeds: int | None = None, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """(a model of the rows of docs that `learn` names, the grouped table of all rows).

    The driver gets the FREQUENT most frequent words, their classes and pair counts of groups, whose
    numbers don't grow; word counts and the classes of all other words are tables of any size.
    """
    frequent, seeds = frequent or FREQUENT, seeds or SEEDS
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    texts = rows.where("learn").select("text")
    known = vocabulary(word_counts(texts), texts.count(), frequent)
    sent = docs.sparkSession.sparkContext.broadcast(known)  # FREQUENT entries at most
    kind = rows.schema["key"].dataType.simpleString()
    encoded = materialize(rows.select("key", "text", "learn").mapInArrow(lambda it: _encode(it, sent.value), f"row long, key {kind}, learn boolean, symbols binary, rare array<long>"), "encoded")
    learnt = encoded.where("learn")
    group, classes = cluster(learnt, known, seeds, classes, rounds)
    rare = rare_words(learnt, known, group, pair_table(learnt, "symbols", "<u2", group), classes)
    table = grouped(encoded, rare, known, group)
    return _model(table, rare, known, group), table


def score_documents(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row per document.

    learn: a condition that names the rows whose texts are learnt from (null: not). base_score is
    the log10 probability under word counts plus ADDED; score is that under the class model, log10
    of class transition times word emission, summed over the text's words and its end; perplexity is
    10 ** (-score / n_tokens). All counts are exact; every learnt word has a class, those seen once
    and unseen ones the class of their shape; every class's emissions are smoothed like the base.

    Null and empty texts are one end. Whole texts are read; ties in frequency go by hash; repeated
    rows are each scored; null keys stay; an empty table gives an empty result and no rows to learn
    from the scores of no counts. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    model, table = fit(docs, learn, key, text, **how)
    kind = table.schema["key"].dataType.simpleString()
    transition, emission, known = model.transition, model.emission, model.known
    out = table.select("key", "n_tokens", "n_known", "word", "groups").mapInArrow(lambda it: _score(it, transition, emission), f"key {kind}, n_tokens long, n_known long, word double, rest double")
    return out.select(
        F.col("key").alias(key),
        "n_tokens",
        "n_known",
        F.lit(int(known.total)).cast("long").alias("train_tokens"),
        (F.col("word") - F.col("n_tokens") * float(np.log10(known.total + ADDED * (known.distinct + 1)))).alias("base_score"),
        (F.col("word") + F.col("rest")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return score_documents(docs, ~held_out).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )

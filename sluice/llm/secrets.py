"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty in sensitive contexts."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.shared import documents, small_batches

#: The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = (*KEYWORDS, "credential", "bearer", "authorization", "private key", "private_key")

#: Common identifiers and code words, which are on every page, beside the parts of words that are counted in the documents.
IDENTIFIERS = """accessToken apiKey application authorization authToken base64 bearer buffer callback certificate className client
    clientSecret config configuration connection connectionString const container content context cookie credential
    credentials database default define description digest document element encoding endpoint environment example
    export expires function getElementById handler hashCode header headers hostname identifier identity import index
    integer interface localhost location message method module namespace null object options package parameter
    password passphrase path payload placeholder private privateKey process production property protected public
    publicKey redirect refresh refreshToken register request resource response return schema secret secretKey security
    server service session sessionId signature static storage string struct template timestamp token undefined
    username value variable version webhook your_api_key_here changeme example_token""".split()
#: Runs that are no secrets, in every dictionary.
FILLERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "x" * 16, "0" * 16]

#: Parts of words and identifiers, with the sign before them, of 3 to LONGEST_PART characters; the PARTS most frequent are kept.
#: All are shorter than a candidate, so a secret that is copied never becomes an identifier as a whole.
PART, LONGEST_PART, PARTS = "[+/_=.-]?(?:[A-Z]?[a-z]+|[A-Z]+)", 15, 2176
#: Every PAGE-th of them is on the page that a candidate is compressed with; the others are in the dictionary.
PAGE = 17

_CONTEXT = re.compile("|".join(CONTEXT_WORDS), re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_LETTER = re.compile("[A-Za-z]")
#: Code points between a sensitive word, or a secret found so, and a candidate on either side; and those of text that prime the compressor.
REACH, AROUND = 48, 256
#: Least bytes of a candidate, and of what base spans leave of one.
SHORTEST = 16
#: Least share of a candidate's bytes that the primed compressor still needs, and the compressor's level.
NOVELTY, LEVEL = 0.78, 1


@lru_cache(maxsize=4)
def _words(parts: str) -> tuple[bytes, bytes]:
    """(dictionary, page) of the parts, joined by spaces and the most frequent first, and of the fixed words; see PAGE."""
    ranked = parts.split()
    page = " ".join([*IDENTIFIERS, *ranked[PAGE - 1 :: PAGE]])
    del ranked[PAGE - 1 :: PAGE]
    return " ".join([*FILLERS, *reversed(ranked)]).encode(), page.encode()


def marginal_bytes(candidate: str, before: str, after: str, parts: str = "") -> int:
    """Compressed bytes that candidate adds to a page of identifiers and word parts, under a dictionary of more parts and its surroundings.

    The page makes the symbols' codes those of words: letters of a name get short ones, a random string none,
    whatever is around it. Without a letter it counts as digits.
    """
    if not _LETTER.search(candidate):
        return -(-len(candidate) * 10 // 24)
    words, page = _words(parts)
    primed = zstandard.ZstdCompressionDict(words + f" {after} {before}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False)
    return len(squeeze.compress(page + b" " + candidate.encode())) - len(squeeze.compress(page + b" "))


def _uncovered(a: int, b: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the spans `taken`, which are in order, leave of a span."""
    for k in range(max(0, bisect_right(taken, (a, a)) - 1), len(taken)):
        x, y = taken[k]
        if x >= b:
            break
        if y <= a:
            continue
        if x > a:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _novel(text: str, taken: list[tuple[int, int]], parts: str) -> Iterator[tuple[str, int, int]]:
    """Candidates within REACH of a sensitive word, before or after it, or of a secret reached so, that are novel.

    What base spans leave of a candidate is measured if it is SHORTEST or more. A secret reaches on:
    so do base spans that lie in reach.
    """
    taken = _union(taken)
    pieces = [(a, b, False) for m in _CANDIDATE.finditer(text) for a, b in _uncovered(*m.span(), taken) if b - a >= SHORTEST]
    if not pieces:
        return
    pieces = sorted(pieces + [(a, b, True) for a, b in taken])
    known: dict[int, bool] = {}
    words = [m.span() for m in _CONTEXT.finditer(text)]

    def secret(k: int) -> bool:
        if k not in known:
            a, b, base = pieces[k]
            known[k] = base or marginal_bytes(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], parts) >= NOVELTY * (b - a)
        return known[k]

    def sweep(order: range, near) -> set[int]:
        """Secrets in reach, going one way: near(k, reach) tells whether piece k is reached from a word, or from the end `reach` of the last secret."""
        found, reach = set(), None
        for k in order:
            if near(k, reach) and secret(k):
                found.add(k)
                reach = pieces[k][1] if order.step > 0 else pieces[k][0]
        return found

    starts, ends = [a for a, _ in words], [b for _, b in words]

    def after(k: int, reach: int | None) -> bool:
        a = pieces[k][0]
        w = bisect_right(ends, a) - 1
        return w >= 0 and a - ends[w] <= REACH or reach is not None and a - reach <= REACH

    def ahead(k: int, reach: int | None) -> bool:
        b = pieces[k][1]
        w = bisect_left(starts, b)
        return w < len(starts) and starts[w] - b <= REACH or reach is not None and reach - b <= REACH

    for k in sorted(sweep(range(len(pieces)), after) | sweep(range(len(pieces) - 1, -1, -1), ahead)):
        a, b, base = pieces[k]
        if not base:
            yield "novel", a, b


def spans_of(text: str | None, parts: str = "") -> str:
    """All spans of one text as kind:start:end, by start, then kind in the order of KINDS; code points, end exclusive. parts: see word_parts."""
    if not text:
        return ""
    low = text.lower()  # only to skip texts that can't match; matching is on the text itself
    spans: list[tuple[str, int, int]] = []
    if any(k in low for k in KEYWORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    if any(k in low for k in CONTEXT_WORDS):
        spans += list(_novel(text, [x[1:] for x in spans], parts))
    spans.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: A maximal run of 24 or more: the runs of HEX that don't fail, without a match for each short run.
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


@F.pandas_udf(T.StringType())
def _redact_udf(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)


def redact(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    """text with the union of its spans replaced by mark."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def word_parts(docs: DataFrame, text: str = "text") -> str:
    """The most frequent parts of the words of all rows' whole texts, joined by spaces, most frequent first (ties: in code point order).

    Counted on the executors; the driver gets PARTS rows at most. Without words it is empty.
    """
    parts = docs.select(F.explode(F.regexp_extract_all(text, F.lit(PART), F.lit(0))).alias("part")).where(F.length("part").between(3, LONGEST_PART))
    return " ".join(r["part"] for r in parts.groupBy("part").count().orderBy(F.desc("count"), "part").limit(PARTS).collect())


def secret_spans(text: Column | str, parts: str = "") -> Column:
    """The spans of a text column, as spans_of gives them. Null and empty texts have none."""

    @F.pandas_udf(T.StringType())
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: spans_of(t, parts), na_action=None)

    return spans(F.col(text) if isinstance(text, str) else text)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """docs with their secret spans in column `out`; docs is read twice, first for the parts of its words.

    Null or empty text: the empty string. Very long texts are scanned whole. Repeated rows and
    ties give the same spans; an empty table stays empty; other columns pass through, and a
    column already called `out` is replaced.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out, secret_spans(text, word_parts(docs, text)))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each secret span of the text replaced by [SECRET]; null stays null, other columns pass through."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text, _redact_udf(F.col(text), secret_spans(text, word_parts(docs, text))))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir)).select("doc_id", "spans")
    each = F.filter(F.split("spans", ","), lambda x: x != "")
    base = F.filter(each, lambda x: ~x.startswith("novel:"))
    count = lambda kind: F.size(F.filter(each, lambda x: x.startswith(kind + ":"))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        "spans",
        count("novel").alias("n_novel"),
    )

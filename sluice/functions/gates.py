"""The structural validator as Column expressions over one scope a row.

A scope has files (array of names), canon, vocab (text, null if missing) and claims: an array of
struct<text, terms, evidence_commit, evidence_date>, empty if there are none or they can't be parsed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Files of a complete scope and the forms of terms, definitions and front matter.
TRIAD = ("CANON.md", "VOCAB.md", "README.md")
TERM = r"\[\[([^\]]+)\]\]"
DEFINITION = r"(?md)^\s*[-*]\s*([^:]+?)\s*:\s*\S"
CLAIMS = "array<struct<text:string,terms:array<string>,evidence_commit:string,evidence_date:string>>"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Distinct [[terms]] of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), 1), strip))


def definitions(vocab: Column) -> Column:
    """Distinct names that bullet lines define, without brackets."""
    found = F.regexp_extract_all(F.coalesce(vocab, F.lit("")), F.lit(DEFINITION), 1)
    inner = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, TERM, 1), F.lit("")), x)
    return F.array_distinct(F.transform(found, lambda x: strip(inner(x))))


def front_matter(canon: Column, key: str) -> Column:
    """What stands after the first `key:` at the start of a line; null if nothing does."""
    return F.nullif(strip(F.regexp_extract(F.coalesce(canon, F.lit("")), rf"(?md)^{key}:\s*(.+)$", 1)), F.lit(""))


def parse_claims(claims_json: Column) -> Column:
    """Claims of a JSON array; an empty array where it can't be parsed."""
    return F.coalesce(F.from_json(claims_json, CLAIMS), F.from_json(F.lit("[]"), CLAIMS))


def claims_parse(claims_json: Column) -> Column:
    """Whether a text is JSON; null for none."""
    return F.when(claims_json.isNotNull(), F.try_parse_json(claims_json).isNotNull())


def missing_files(files: Column) -> Column:
    """Files of a complete scope that aren't there, in order."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, TRIAD)), F.coalesce(files, F.array().cast("array<string>"))))


def triad(files: Column) -> Column:
    return F.size(missing_files(files)) == 0


def inheritance(canon: Column) -> Column:
    return F.coalesce(F.startswith(front_matter(canon, "inherits"), F.lit("/")), F.lit(False))


def undefined(canon: Column, vocab: Column) -> Column:
    """Terms used in either text that the vocabulary doesn't define, in order."""
    return F.array_sort(F.array_except(F.array_union(terms(canon), terms(vocab)), definitions(vocab)))


def vocabulary(claims: Column, vocab: Column) -> Column:
    defined = definitions(vocab)
    used = F.array_distinct(F.flatten(F.transform(claims, lambda c: F.coalesce(c["terms"], F.array().cast("array<string>")))))
    return F.size(F.array_except(used, defined)) == 0


def in_scope(claims: Column, canon: Column) -> Column:
    """Every claim's date lies in the declared window; dates compare as strings, ends included."""
    start, end = front_matter(canon, "window_start"), front_matter(canon, "window_end")
    date = lambda c: F.nullif(strip(F.coalesce(c["evidence_date"], F.lit(""))), F.lit(""))
    return F.forall(claims, lambda c: F.coalesce((start <= date(c)) & (date(c) <= end), F.lit(False)))

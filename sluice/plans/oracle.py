"""Common parts of the SQL that states the queries in another engine's terms."""

from __future__ import annotations

ITEMS = r"""
items AS (
  SELECT d.doc_id AS pos, d.text AS prose, d.source AS topic, d.lang, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled,
    CASE WHEN l.doc_id IS NULL THEN CASE d.doc_id % 3 WHEN 0 THEN 'Gintro' WHEN 1 THEN 'Gevid' ELSE 'Gscope' END
         WHEN l.quality = 1 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'C1' ELSE 'C4' END
         WHEN d.doc_id % 2 = 0 THEN 'C3' ELSE 'C2' END AS klass,
    CASE WHEN l.doc_id IS NULL THEN TRUE ELSE l.quality <> 1 END AS gt_slop
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PROXIES = r"""
proxies AS (
  SELECT *, coalesce(length(regexp_replace(prose, '[\p{L}\p{N}\s]', '', 'g'))::DOUBLE / nullif(length(prose), 0) > 0.06, FALSE) AS b2,
    coalesce(len(list_distinct(regexp_extract_all(lower(prose), '[a-z0-9]+')))::DOUBLE / nullif(len(regexp_extract_all(lower(prose), '[a-z0-9]+')), 0) < 0.35, FALSE) AS b1b
  FROM items)"""

DECISIONS = r"""
decisions AS (
  SELECT pos, klass, topic, lang, gt_slop, labelled, 'B0' AS arm, FALSE AS reject FROM proxies
  UNION ALL SELECT pos, klass, topic, lang, gt_slop, labelled, 'B1b', b1b FROM proxies
  UNION ALL SELECT pos, klass, topic, lang, gt_slop, labelled, 'B2', b2 FROM proxies
  UNION ALL SELECT pos, klass, topic, lang, gt_slop, labelled, 'T', klass NOT IN ('C1', 'C3') FROM proxies
  UNION ALL SELECT pos, klass, topic, lang, gt_slop, labelled, 'T-Introspection', klass NOT IN ('C1', 'C3', 'Gintro') FROM proxies
  UNION ALL SELECT pos, klass, topic, lang, gt_slop, labelled, 'T-Evidence', klass NOT IN ('C1', 'C3', 'Gevid') FROM proxies
  UNION ALL SELECT pos, klass, topic, lang, gt_slop, labelled, 'T-Scope', klass NOT IN ('C1', 'C3', 'Gscope') FROM proxies)"""

CELLS = """count(*) FILTER (reject AND gt_slop) AS tp, count(*) FILTER (reject AND NOT gt_slop) AS fp,
  count(*) FILTER (NOT reject AND gt_slop) AS fn, count(*) FILTER (NOT reject AND NOT gt_slop) AS tn, count(*) AS n"""

VOTES = """
votes AS (
  SELECT pos, topic, lang, labelled, gt_slop, CASE WHEN NOT labelled THEN 'abstain' WHEN quality = 0 THEN 'slop' ELSE 'legit' END AS r1,
    CASE WHEN NOT labelled THEN 'abstain' WHEN toxic = 1 THEN 'slop' ELSE 'legit' END AS r2, CASE WHEN b2 THEN 'slop' ELSE 'legit' END AS r3
  FROM proxies),
panel AS (
  SELECT *, ((r1 = 'slop')::INT + (r2 = 'slop')::INT + (r3 = 'slop')::INT)::BIGINT AS n_slop, ((r1 = 'legit')::INT + (r2 = 'legit')::INT + (r3 = 'legit')::INT)::BIGINT AS n_legit
  FROM votes),
voted AS (SELECT *, CASE WHEN n_slop > n_legit THEN 'slop' ELSE 'legit' END AS panel_gt FROM panel)"""

LEDGER = """
ledger AS (SELECT o_orderkey AS pos, substr(sha256(o_orderkey::VARCHAR), 1, 40) AS sha, strftime(o_orderdate, '%Y-%m-%d') AS committed_date FROM orders WHERE o_orderkey < 200)"""

SCOPES = r"""
lens AS (SELECT min(committed_date) AS w0, max(committed_date) AS w1 FROM ledger),
anchored AS (
  SELECT i.*, l.sha, l.committed_date, klass IN ('C2', 'C4') AS bare, list_sort(list_distinct(list_slice(regexp_extract_all(prose, '[A-Za-z]{4,}'), 1, 3))) AS used,
    CASE klass WHEN 'C1' THEN least(w0, committed_date) WHEN 'Gscope' THEN '1990-01-01' ELSE committed_date END AS w_start,
    CASE klass WHEN 'C1' THEN greatest(w1, committed_date) WHEN 'Gscope' THEN '1990-12-31' ELSE committed_date END AS w_end,
    CASE klass WHEN 'Gevid' THEN repeat('0', 40) ELSE sha END AS cites
  FROM items i JOIN ledger l ON i.pos % (SELECT count(*) FROM ledger) = l.pos CROSS JOIN lens),
scopes AS (
  SELECT *, CASE WHEN NOT bare THEN 'inherits: /' || chr(10) || 'window_start: ' || w_start || chr(10) || 'window_end: ' || w_end || chr(10) || chr(10) || 'Governs '
      || array_to_string(list_transform(used, lambda t: '[[' || t || ']]'), ' ') || CASE klass WHEN 'Gintro' THEN ' [[Unresolved]]' ELSE '' END || '.' || chr(10) END AS canon,
    CASE WHEN NOT bare THEN '# VOCAB' || chr(10) || array_to_string(list_transform(used, lambda t: '- [[' || t || ']]: defined locally' || chr(10)), '') END AS vocab
  FROM anchored),
parsed AS (
  SELECT *, list_distinct(list_transform(regexp_extract_all(coalesce(canon, ''), '\[\[([^\]]+)\]\]', 1), lambda t: trim(t))) AS canon_terms,
    list_distinct(list_transform(regexp_extract_all(coalesce(vocab, ''), '\[\[([^\]]+)\]\]', 1), lambda t: trim(t))) AS vocab_terms,
    list_distinct(list_transform(regexp_extract_all(coalesce(vocab, ''), '(?m)^\s*[-*]\s*([^:]+?)\s*:\s*\S', 1), lambda t: replace(replace(t, '[[', ''), ']]', ''))) AS defs,
    nullif(regexp_extract(coalesce(canon, ''), '(?m)^window_start:\s*(.+)$', 1), '') AS ws, nullif(regexp_extract(coalesce(canon, ''), '(?m)^window_end:\s*(.+)$', 1), '') AS we
  FROM scopes),
flags AS (
  SELECT *, NOT bare AS triad_ok, coalesce(regexp_extract(canon, '(?m)^inherits:\s*(.+)$', 1) LIKE '/%', FALSE) AS inheritance_ok,
    len(list_filter(list_concat(canon_terms, vocab_terms), lambda t: NOT list_contains(defs, t))) = 0 AS introspection_ok,
    bare OR len(list_filter(used, lambda t: NOT list_contains(defs, t))) = 0 AS gate_vocab_ok,
    bare OR cites IN (SELECT sha FROM ledger) AS gate_evidence_ok,
    bare OR coalesce(ws <= committed_date AND committed_date <= we, FALSE) AS gate_scope_ok
  FROM parsed)"""


def wilson(k: str, n: str) -> tuple[str, str]:
    p, z2 = f"(({k})::DOUBLE / nullif({n}, 0))", "3.8416"
    centre, half, scale = f"({p} + {z2} / (2 * ({n})))", f"1.96 * sqrt({p} * (1 - {p}) / ({n}) + {z2} / (4.0 * ({n}) * ({n})))", f"(1 + {z2} / ({n}))"
    guard = f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE "
    return f"{guard} round(greatest(0.0, ({centre} - {half}) / {scale}), 3) END", f"{guard} round(least(1.0, ({centre} + {half}) / {scale}), 3) END"


def share(k: str, n: str) -> str:
    return f"CASE WHEN ({n}) = 0 THEN 0.0 ELSE ({k})::DOUBLE / ({n}) END"


PHI = """CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
  ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END"""
ODDS = "(tp + 0.5::DOUBLE) * (tn + 0.5::DOUBLE) / ((fp + 0.5::DOUBLE) * (fn + 0.5::DOUBLE))"
F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"


def sql(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select

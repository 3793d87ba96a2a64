"""SQL for DuckDB that gives the rows of the corpus queries from their definitions, by plainer means than the operators'.

Quadratic in places: meant for small tables.
"""

from __future__ import annotations

from . import pii, secret_scan

WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: str, pattern: str, valid: str, texts: str) -> str:
    """Rows doc_id, kind, s, e of the leftmost matches of a pattern that are valid (an expression over m, gap)."""
    p = _quoted(pattern)
    return f"""
  SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e FROM (
    SELECT doc_id, m, gap, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, {p})) AS m, unnest(string_split_regex(text, {p})[:len(regexp_extract_all(text, {p}))]) AS gap,
             unnest(range(len(regexp_extract_all(text, {p})))) AS i
      FROM {texts} WHERE regexp_matches(text, {p}))
    WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  WHERE {valid}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN i % 2 = 1 THEN ord({_DIGITS}[-i]) - 48 ELSE 2 * (ord({_DIGITS}[-i]) - 48) - CASE WHEN ord({_DIGITS}[-i]) > 52 THEN 9 ELSE 0 END END FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0::BIGINT, [CASE WHEN ord(c) < 58 THEN ord(c) - 48 ELSE ord(c) - 55 END::BIGINT FOR c IN string_split(m[5:] || m[:4], '')]), lambda a, c: (CASE WHEN c < 10 THEN a * 10 + c ELSE a * 100 + c END) % 97) = 1"

_SSN = r"\bssn\b|social security|insurance"

#: Patterns without what only speeds up or bounds the operator's own.
_PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len([p FOR p IN string_split(m, '.') IF p::DOUBLE > 255]) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", _MOD97),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", f"regexp_matches(lower(right(gap, {pii.NEAR})), {_quoted(_SSN)})"),
]


def _spans(texts: str, kinds: list[str], base: tuple, parts: list[str], order: str) -> str:
    """One row a document: counts of the base kinds, the hash of their spans, and all spans."""
    place = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds))
    names = ", ".join(f"'{k}'" for k in base)
    counts = ",\n       ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    one = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}
), placed AS (SELECT *, CASE kind {place} END AS k FROM spans)
SELECT t.doc_id, {counts},
       sha256(coalesce(string_agg({one}, ',' ORDER BY {order}) FILTER (kind IN ({names})), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY {order}), '') AS spans
FROM texts t LEFT JOIN placed p USING (doc_id) GROUP BY t.doc_id"""


PII = _spans("texts", list(pii.KINDS), pii.BASE, [_matches(k, p, v, "texts") for k, p, v in _PERSONAL], "k, s")


def _secrets() -> list[str]:
    out = []
    for kind, head, tail, least, fold in secret_scan.RULES:
        pattern, full = (f"(?i:{x})" if fold else x for x in (head + tail, least))
        if kind == "hex":
            pattern = "[0-9a-f]+"
        if kind == "assign":  # letters of the value count in either case anyway
            full = f"(?s:.*?){full}"
        out.append(_matches(kind, pattern, f"regexp_full_match(m, {_quoted(full)})", "texts"))
    return out


SECRETS = _spans("texts", secret_scan.KINDS, secret_scan.BASE, _secrets(), "s, k")

NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

LINES = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, list_sort(list_distinct(regexp_extract_all(unnest(l), '{WORD}'))) AS s FROM split),
worded AS (SELECT * FROM lines WHERE len(s) > 0),
sets AS (SELECT row_number() OVER () AS id, s, len(s) AS n, first FROM (SELECT s, min((doc_id, line_no)) AS first FROM worded GROUP BY s)),
tokens AS (SELECT id, n, unnest(s) AS t FROM sets),
counted AS (SELECT id, n, t, count(*) OVER (PARTITION BY t) AS k FROM tokens),
prefixes AS (SELECT id, n, t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, t) AS r FROM counted) WHERE r <= n - ceil(n * 80 / 100) + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefixes a JOIN prefixes b ON a.t = b.t AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT p.a, p.b, y.first AS other FROM pairs p JOIN sets x ON x.id = p.a JOIN sets y ON y.id = p.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), linked AS (SELECT a AS id, count(*) AS links, min(other) AS before FROM links GROUP BY a),
marks AS (
  SELECT w.doc_id, w.line_no, coalesce(k.links, 0) AS links, least(z.first, coalesce(k.before, z.first)) < (w.doc_id, w.line_no) AS removed
  FROM worded w JOIN sets z ON z.s = w.s LEFT JOIN linked k ON k.id = z.id
), by_document AS (
  SELECT doc_id, sum(links)::BIGINT AS n_links, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (removed), '') AS removed_lines
  FROM marks GROUP BY doc_id
), contents AS (SELECT doc_id, list((line_no, s) ORDER BY line_no) AS c FROM worded GROUP BY doc_id),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS class_id FROM contents)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, len(d.l) AS n_lines, coalesce(m.n_removed, 0) AS n_removed, coalesce(m.n_links, 0) AS n_links, coalesce(m.removed_lines, '') AS removed_lines
FROM split d LEFT JOIN classes c USING (doc_id) LEFT JOIN by_document m USING (doc_id)
"""

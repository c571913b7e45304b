"""DuckDB SQL of the operators that SQL can express."""

from offermarket.llm import license_scan

BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def line_dedup(source: str, text: str = "coalesce(text, '')") -> str:
    """Common table expressions ending in ``kept(doc_id, n_lines, n_dropped, kept)``."""
    return f"""
split AS (SELECT doc_id, string_split({text}, chr(10)) AS parts FROM {source}),
lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, {BLANKS}), {LOWER}) AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.keeper AS lost
  FROM keyed k LEFT JOIN shared s ON k.key = s.key),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS kept
  FROM marked GROUP BY doc_id)"""


WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SOLID = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
FAILS = [
    f"len({SOLID}) < 200",
    f"100 * len(list_distinct({SOLID})) < 50 * len({SOLID})",
    "100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)",
    "regexp_matches(text, '[#$%&*|]')",
    "doc_id > min(doc_id) OVER (PARTITION BY text)",
]
MASK = " + ".join(f"CASE WHEN {fails} THEN {1 << i} ELSE 0 END" for i, fails in enumerate(FAILS))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


_TEMPLATES = [(label, license_scan.template_words(text)) for label, text in license_scan.TEMPLATES]
STRIDE = max(len(words) for _, words in _TEMPLATES)
TEMPLATE_ROWS = ", ".join(
    f"('{label}', {_quoted(sorted(set(words)))}, {license_scan.needed(len(set(words)))})" for label, words in _TEMPLATES
)
PHRASE_ROWS = ", ".join(
    f"('{label}', {_quoted(license_scan.template_words(phrase))})" for phrase, label in license_scan.PHRASES.items()
)

ORACLES = {
    "op2_line_dedup": f"""
WITH {line_dedup("documents")}
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept""",
    "op4_suffix_decontamination": f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM docs CROSS JOIN (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, words)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_exact_dedup": """
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM bare WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
    "op11_filter_audit": f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
masked AS (SELECT doc_id, part, {MASK} AS mask FROM texts),
marked AS (
  SELECT m.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND l.toxic = 1) AS toxic
  FROM masked m),
grouped AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
  FROM marked GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS own,
         coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
audited AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(n_good) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(n_toxic) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM grouped CROSS JOIN steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM audited""",
    "op12_license_scan": f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
phrases(label, p) AS (VALUES {PHRASE_ROWS}),
templates(label, tokens, least) AS (VALUES {TEMPLATE_ROWS}),
places AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM docs) d JOIN phrases p
  ON d.w[i + 1] = p.p[1] AND d.w[i + 1:i + len(p.p)] = p.p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS names
  FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, list_distinct(w[i * {STRIDE} + 1:(i + 2) * {STRIDE}]) AS block
  FROM (SELECT doc_id, w, unnest(range(greatest(1, ceil(len(w) / {STRIDE})::INTEGER - 1))) AS i FROM docs)),
met AS (
  SELECT doc_id, label, len(list_intersect(block, tokens)) / len(tokens) AS share
  FROM blocks CROSS JOIN templates WHERE len(list_intersect(block, tokens)) >= least),
own AS (SELECT doc_id, max(share) AS score, list_distinct(list(label)) AS names FROM met GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base.names, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(own.names, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(own.score, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op13_lexical_search": f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, sum(len(w))::BIGINT AS length FROM docs),
items AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM postings CROSS JOIN total GROUP BY term, docs),
shares AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))) AS share
  FROM postings JOIN weights USING (term) CROSS JOIN total),
scores AS (SELECT item_id, doc_id, sum(share)::BIGINT AS score FROM items JOIN shares USING (term) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 50""",
}

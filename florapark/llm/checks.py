"""SQL for DuckDB that gives the rows of corpus queries by plain means."""

from __future__ import annotations

from florapark.llm import quality

WORD = r"[^\x20\x09-\x0D]+"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 2))) t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT edge.b, root FROM reach JOIN edge ON edge.a = reach.doc_id
), part AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, part.root AS component_id, d.doc_id = part.root AS kept
FROM documents d JOIN part ON part.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

SOURCE_DIVERGENCE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{TERM}') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3
), x AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, lc FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), n AS (SELECT lang, source, sum(c) AS n, sum(lc) AS ln, count(*) AS v FROM c GROUP BY ALL
), p AS (
  SELECT c.lang, c.source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS p, 1 + (1000000000::HUGEINT * (lc + 1)) // (ln + v) AS q
  FROM c JOIN n ON n.lang = c.lang AND n.source = c.source
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM part)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

FILL_IN_MIDDLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), v AS (
  SELECT *, array_to_string(w[1:least(a, b)], '') AS pre, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(w[greatest(a, b) + 1:], '') AS suf FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM v
"""


def quality_rules(risk: float = 0.03, delta: float = 0.05, cost: float = 5.0) -> str:
    """The counts, the certified cutoffs and the verdicts of the quality rules."""
    rules = quality.rules()
    each = risk / len(rules)
    cuts = ", ".join(f"('{r.name}', {k}, {j + 1}, {c!r}::DOUBLE)" for k, r in enumerate(rules) for j, c in enumerate(r.cutoffs))
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, t, '{r.name}' AS rule, {r.value} AS v FROM st" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) x(i)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (SELECT doc_id, count(DISTINCT j) AS c FROM twice, unnest([i, i + 1, i + 2]) x(j) GROUP BY 1
), line AS (SELECT doc_id, count(*) AS c, count(DISTINCT l) AS k FROM d, unnest(string_split(t, chr(10))) x(l) WHERE regexp_matches(l, '{WORD}') GROUP BY 1
), st AS (
  SELECT d.doc_id, stratum, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_exclaims, coalesce(line.c, 0) AS n_lines, coalesce(line.c - line.k, 0) AS n_dup_lines,
         coalesce(rep.c, 0) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN line ON line.doc_id = d.doc_id
), cut(rule, place, step, cutoff) AS (VALUES {cuts}
), v AS ({values}
), once AS (SELECT DISTINCT v.stratum, v.t, v.rule, v.v, l.quality = 1 AS good FROM v JOIN labels l ON l.doc_id = v.doc_id WHERE l.quality IS NOT NULL
), stepped AS (SELECT stratum, rule, good, (SELECT count(*) FROM cut WHERE cut.rule = once.rule AND cutoff >= once.v) + 1 AS step FROM once
), c AS (SELECT stratum, rule, step, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE NOT good) AS bad FROM stepped GROUP BY ALL
), u AS (
  SELECT *, sum(good) OVER (PARTITION BY stratum, rule) AS n_good, sum(bad) OVER (PARTITION BY stratum, rule) AS n_bad,
         sum(good) OVER (PARTITION BY stratum, rule ORDER BY step) AS lost, sum(bad) OVER (PARTITION BY stratum, rule ORDER BY step) AS caught FROM c
), p AS (
  SELECT *, CASE WHEN lost >= n_good * {each!r} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1)
         + j * ln({each!r}::DOUBLE) + (n_good - j) * ln(1 - {each!r}::DOUBLE))) FROM unnest(range(0, CAST(lost AS BIGINT) + 1)) x(j)) END AS p FROM u
), f AS (
  SELECT *, max(CASE WHEN n_good > 0 AND p <= {delta!r} / ((SELECT greatest(count(DISTINCT stratum), 1) FROM c) * {len(rules)}) THEN 0 ELSE 1 END)
         OVER (PARTITION BY stratum, rule ORDER BY step) AS failed,
         caught / greatest(n_bad, 1) - {cost!r} * lost / greatest(n_good, 1) AS gain FROM p
), best AS (
  SELECT stratum, f.rule, arg_max(cutoff, (gain, -f.step)) AS cutoff FROM f JOIN cut ON cut.rule = f.rule AND cut.step = f.step
  WHERE failed = 0 AND gain > 0 GROUP BY ALL
), hit AS (
  SELECT v.doc_id, list(v.rule ORDER BY place) AS rejected_by FROM v JOIN best ON best.stratum = v.stratum AND best.rule = v.rule
  JOIN cut ON cut.rule = v.rule AND cut.step = 1 WHERE v.v > best.cutoff GROUP BY 1
)
SELECT st.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND hit.doc_id IS NULL AS kept, coalesce(rejected_by, []) AS rejected_by
FROM st LEFT JOIN hit ON hit.doc_id = st.doc_id
"""

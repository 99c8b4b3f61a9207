"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), base AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
), own AS (
  SELECT *, CASE
    WHEN rule IS NOT NULL THEN NULL
    WHEN starts_with(host, 'docs.') OR contains(host, '.docs.') THEN '||docs.'
    WHEN starts_with(host, 'cheap-pills.') OR contains(host, '.cheap-pills.') THEN '||cheap-pills.'
    WHEN contains(host || path, '/wp-login.php') THEN '/wp-login.php'
    WHEN starts_with(host, 'adserver.') OR contains(host, '.adserver.') THEN '||adserver.'
    WHEN starts_with(host, 'tracker.') OR contains(host, '.tracker.') THEN '||tracker.'
    WHEN contains('//' || host || path, '/casino/') THEN '/casino/'
    WHEN contains('//' || host || path, '/poker/') THEN '/poker/'
    WHEN contains(host || path, '-pills.') THEN '-pills.'
    WHEN starts_with(host, 'ads.') OR contains(host, '.ads.') THEN '||ads.'
    WHEN contains('//' || host || path, '/xxx/') THEN '/xxx/' END AS own_rule
  FROM base
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL OR own_rule IS NULL OR own_rule = '||docs.' THEN 'allow' ELSE 'block' END AS verdict,
       own_rule
FROM own
"""


def mix_sql(docs: str, weights=(5, 2, 1), share: float = 1.5, max_copies: float = 2.0, seed: str = "mix") -> str:
    """The sample of ``mix_sources`` over the relation ``docs``, as a list of WITH parts that ends in ``mixed``.

    Sources and classes are filled by trying how many of them, in order of cap / weight, are capped.
    """
    return rf"""
sized AS (
  SELECT *, coalesce('=' || source, '~') AS key,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM {docs}
), classed AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM sized
), found AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key
), weighed AS (
  SELECT *, CAST([{", ".join(str(w) for w in weights)}][1 + (row_number() OVER (ORDER BY encode(key)) - 1) % {len(weights)}] AS DOUBLE) AS weight, {max_copies}::DOUBLE * source_size AS cap FROM found
), levels AS (
  SELECT a.key, a.cap / a.weight AS ratio,
         ({share}::DOUBLE * (SELECT sum(source_size) FROM found) - coalesce((SELECT sum(b.cap) FROM weighed b WHERE b.cap / b.weight < a.cap / a.weight), 0.0)) / (SELECT sum(b.weight) FROM weighed b WHERE b.cap / b.weight >= a.cap / a.weight) AS level FROM weighed a
), goal AS (
  SELECT w.key, source_size, CASE WHEN NOT EXISTS (SELECT 1 FROM levels WHERE ratio > level) THEN cap ELSE least(cap, weight * (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level)) END AS target FROM weighed w
), classes AS (
  SELECT key, class, CAST(sum(size) AS BIGINT) AS words, 1.0::DOUBLE + class AS w FROM classed GROUP BY key, class
), rates AS (
  SELECT a.key, a.class, (target - {max_copies}::DOUBLE * coalesce((SELECT sum(b.words) FROM classes b WHERE b.key = a.key AND b.w > a.w), 0)) / nullif((SELECT sum(b.w * b.words) FROM classes b WHERE b.key = a.key AND b.w <= a.w), 0) AS level, {max_copies}::DOUBLE / a.w AS ratio FROM classes a JOIN goal USING (key) WHERE words > 0
), expected AS (
  SELECT c.key, c.class, c.words, CASE WHEN c.words = 0 THEN 0.0 ELSE least({max_copies}::DOUBLE, c.w * coalesce((SELECT arg_min(level, ratio) FROM rates r WHERE r.key = c.key AND r.ratio > r.level), {max_copies}::DOUBLE)) END AS e FROM classes c
), parts AS (
  SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p, sum(floor(e) * words) OVER (PARTITION BY key) AS certain FROM expected
), ranked AS (
  SELECT s.*, source_size, target, whole, p, target - certain AS rest, (u / (1 - u)) / (p / (1 - p)) AS odds FROM classed s JOIN parts USING (key, class) JOIN goal USING (key)
), cumulated AS (
  SELECT *, CASE WHEN p > 0 THEN sum(size) FILTER (p > 0) OVER (PARTITION BY key ORDER BY CASE WHEN p > 0 THEN 0 ELSE 1 END, odds, u, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM ranked
), mixed AS (
  SELECT *, whole + CAST(coalesce(rest > upto - size AND upto - size / 2.0 <= rest, false) AS BIGINT) AS copies FROM cumulated
)"""


OP3 = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"


def op5() -> str:
    from .license_scan import BASE, NOTICES

    templates = BASE + NOTICES
    rows = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {p}, '{a} {b}', {len(w) - 1})" for i, t in enumerate(templates) for w in [t.words()] for p, (a, b) in enumerate(zip(w, w[1:], strict=False)))
    return rf"""
WITH idx(template, label, base, place, gram, size) AS (VALUES {rows}
), t AS (
  SELECT doc_id, text, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TOKEN}') AS w FROM documents
), g AS (
  SELECT r, w[i] || ' ' || w[i + 1] AS gram, i - 1 AS pos FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM t)
), votes AS (
  SELECT r, template, label, base, size, pos - place AS diagonal, count(*) AS votes, min(pos) AS first, max(pos) AS last, list(place) AS ats
  FROM g JOIN idx USING (gram) GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 2 THEN 0 ELSE 1 END AS fresh
  FROM votes WHERE NOT base WINDOW w AS (PARTITION BY r, template ORDER BY diagonal, first)
), grouped AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal, first) AS grp FROM marked
), spans AS (
  SELECT r, template, label, size, grp, len(list_distinct(flatten(list(ats)))) / size AS share, min(first) AS first, max(last) AS last
  FROM grouped GROUP BY r, template, label, size, grp
), found AS (
  SELECT r, label, true AS base, diagonal AS pos, 1.0::DOUBLE AS share FROM votes WHERE base AND votes = size
  UNION ALL SELECT r, label, false, first, share FROM spans WHERE share >= 0.8 AND last - first < size * 2 + 2
), by_doc AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(pos) FILTER (base) AS first_word, max(pos) FILTER (base) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM t LEFT JOIN by_doc USING (r)
"""


OP4 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), win AS (
  SELECT r, coalesce(doc_id, 9223372036854775807) AS d, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t)
), judged AS (
  SELECT r, i, row(d, i) > min(row(d, i)) OVER (PARTITION BY s) AS later FROM win
), covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM judged WHERE later
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN covered USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""


#: All pairs that share a shingle, and the classes that their links join.
OP2 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), cut AS (
  SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM t WHERE len(w) > 0
), bag AS (
  SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS k FROM cut GROUP BY ALL
), weight AS (
  SELECT doc_id, sum(k) AS n FROM bag GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.k, b.k)) AS shared FROM bag a JOIN bag b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN weight x ON x.doc_id = a JOIN weight y ON y.doc_id = b WHERE shared >= 0.8 * (x.n + y.n - shared)
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(id, other) AS (
  SELECT a, b FROM ways UNION SELECT r.id, w.b FROM reach r JOIN ways w ON r.other = w.a
), least_other AS (
  SELECT id, min(other) AS other FROM reach GROUP BY id
)
SELECT doc_id, least(doc_id, other) AS class_id FROM documents LEFT JOIN least_other ON id = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1, "op2_near_dedup": OP2, "op3_mix_sources": OP3, "op4_substring_dedup": OP4, "op5_license_scan": op5()}

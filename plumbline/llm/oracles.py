"""DuckDB SQL that gives the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from plumbline.llm.decontam import WINDOW
from plumbline.llm.hostrules import BASE, MAX_HOST_RATE, REPEAT_WINDOW, RULES, SURE
from plumbline.llm.merkle import COLUMNS
from plumbline.llm.warc import MIN_REVISIT_BYTES

OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p),
r AS (SELECT *, size >= {MIN_REVISIT_BYTES} AND first IS NOT NULL AND (page_id IS NULL OR page_id < first) AS again FROM g)
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM r
"""


def _prior(name: str) -> str:
    """The columns a and b of the beta prior of a rule, from the sums over all hosts."""
    mean = f"least(greatest(f_{name} / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))"
    between = f"(q_{name} / n - (f_{name} / n) ** 2) - {mean} * (1 - {mean}) * greatest(hosts - 1, 0) / n"
    strength = f"least(greatest(CASE WHEN {between} > 0 THEN {mean} * (1 - {mean}) / ({between}) - 1 ELSE 1e6 END, 1e0), 1e6)"
    return f"{mean} * {strength} AS a_{name}, (1 - {mean}) * {strength} AS b_{name}"


OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
windows AS (SELECT r, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i,
  unnest([array_to_string(ws[x : x + {REPEAT_WINDOW - 1}], ' ') FOR x IN range(1, len(ws) - {REPEAT_WINDOW - 2})]) AS win FROM w),
often AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
steps AS (SELECT r, least({REPEAT_WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - {REPEAT_WINDOW})) AS step FROM often),
covered AS (SELECT r, CAST(sum(step) AS BIGINT) AS n FROM steps GROUP BY r),
m AS (SELECT w.r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN covered ON w.r = covered.r),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS docs, {", ".join(f"CAST(count(*) FILTER ({rule}) AS DOUBLE) AS fail_{name}" for name, rule in RULES.items())} FROM m GROUP BY host),
s AS (SELECT CAST(count(*) AS DOUBLE) AS hosts, sum(docs) AS n, {", ".join(f"sum(fail_{x}) AS f_{x}, sum(fail_{x} * fail_{x} / docs) AS q_{x}" for x in RULES)} FROM h),
prior AS (SELECT {", ".join(map(_prior, RULES))} FROM s),
rates AS (SELECT host, {", ".join(f"docs + a_{x} + b_{x} AS w_{x}, (fail_{x} + a_{x}) / (docs + a_{x} + b_{x}) AS r_{x}" for x in RULES)} FROM h, prior),
bad AS (SELECT host, {" OR ".join(f"r_{x} - {SURE}::DOUBLE * sqrt(r_{x} * (1 - r_{x}) / (w_{x} + 1)) > {MAX_HOST_RATE}" for x in RULES)} AS is_bad FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {" OR ".join(RULES[x] for x in BASE)} AS base_failed,
  NOT ({" OR ".join(RULES[x] for x in BASE)}) AND NOT is_bad AS kept
FROM m JOIN bad ON m.host IS NOT DISTINCT FROM bad.host
"""

WORDS6 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS6} AS ws FROM documents),
it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS name, {WORDS6} AS ws FROM benchmark),
sized AS (SELECT name, ws, least({WINDOW}, len(ws)) AS n FROM it WHERE len(ws) > 0),
iw AS (SELECT DISTINCT name, n, unnest([array_to_string(ws[x : x + n - 1], ' ') FOR x IN range(1, len(ws) - n + 2)]) AS win FROM sized),
sizes AS (SELECT DISTINCT n FROM sized),
dw AS (SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest([array_to_string(ws[x : x + n - 1], ' ') FOR x IN range(1, len(ws) - n + 2)]) AS win FROM d, sizes WHERE len(ws) >= n),
found AS (SELECT r, i, n, name FROM dw JOIN iw USING (n, win)),
hits AS (SELECT DISTINCT r, i, i + n AS e FROM found),
fresh AS (SELECT r, greatest(0, e - greatest(i, coalesce(max(e) OVER (PARTITION BY r ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i))) AS c FROM hits),
covered AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_hit FROM fresh GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT name)) AS names FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.r = covered.r LEFT JOIN named ON d.r = named.r
"""

_CRC32 = "list_reduce(list_concat([4294967295::BIGINT], [CAST(unicode(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))"
_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"


OP12 = f"""
WITH RECURSIVE d AS (SELECT lang AS g, doc_id, {_leaf("n_chars")} AS leaf, {_leaf(f"CASE WHEN xor({_CRC32}, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
lv(g, k, pos, node) AS (SELECT g, 0, pos, leaf FROM p UNION ALL
  SELECT g, k + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM lv) x WHERE c > 1 GROUP BY g, k, pos // 2),
tops AS (SELECT g, max(k) AS height FROM lv GROUP BY g),
s AS (SELECT lv.g, node AS subroot, row_number() OVER (ORDER BY lv.g NULLS FIRST) - 1 AS pos, height FROM lv JOIN tops ON lv.g IS NOT DISTINCT FROM tops.g AND k = height),
tl(k, pos, node) AS (SELECT 0, pos, subroot FROM s UNION ALL
  SELECT k + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM tl) x WHERE c > 1 GROUP BY k, pos // 2),
root AS (SELECT k AS height, node AS root FROM tl ORDER BY k DESC LIMIT 1),
steps AS (SELECT p.g, p.pos, r.k, (p.pos >> r.k) & 1 AS side, coalesce(lv.node, '') AS other FROM (SELECT p.g, p.pos, unnest(range(0, height)) AS k FROM p JOIN tops ON p.g IS NOT DISTINCT FROM tops.g) r
    JOIN p ON p.g IS NOT DISTINCT FROM r.g AND p.pos = r.pos LEFT JOIN lv ON lv.g IS NOT DISTINCT FROM r.g AND lv.k = r.k AND lv.pos = xor(r.pos >> r.k, 1)
  UNION ALL SELECT p.g, p.pos, s.height + r.k, (s.pos >> r.k) & 1, coalesce(tl.node, '') FROM (SELECT s.pos, unnest(range(0, (SELECT height FROM root))) AS k FROM s) r
    JOIN s ON s.pos = r.pos JOIN p ON p.g IS NOT DISTINCT FROM s.g LEFT JOIN tl ON tl.k = r.k AND tl.pos = xor(s.pos >> r.k, 1)),
paths AS (SELECT g, pos, list(side ORDER BY k) AS sides, list(other ORDER BY k) AS others FROM steps GROUP BY g, pos),
folds(g, pos, k, node) AS (SELECT g, pos, 0, changed FROM p UNION ALL
  SELECT f.g, f.pos, f.k + 1, CASE WHEN q.sides[f.k + 1] = 1 THEN sha256(q.others[f.k + 1] || node) ELSE sha256(node || q.others[f.k + 1]) END FROM folds f JOIN paths q ON q.g IS NOT DISTINCT FROM f.g AND q.pos = f.pos WHERE f.k < len(q.sides)),
ends AS (SELECT g, pos, arg_max(node, k) AS folded_root FROM folds GROUP BY g, pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(others, ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN s ON p.g IS NOT DISTINCT FROM s.g CROSS JOIN root LEFT JOIN paths ON p.g IS NOT DISTINCT FROM paths.g AND p.pos = paths.pos JOIN ends ON p.g IS NOT DISTINCT FROM ends.g AND p.pos = ends.pos
"""

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tokenloom.llm.quality import ALPHA, DELTA
from tokenloom.llm.quality import RULES as QUALITY_RULES
from tokenloom.llm.secrets import BASE, RULES

WORD = "'[^\\x20\\x09-\\x0D]+'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Every rule over every text, without an index."""
    parts = []
    for rank, rule in enumerate(RULES):
        p = _quoted(rule.pattern)
        parts.append(
            f"SELECT doc, {rank} AS rank, {_quoted(rule.kind)} AS kind, unnest(string_split_regex(body, {p})) AS gap, "
            f"unnest(regexp_extract_all(body, {p}, 0)) AS hit, unnest(regexp_extract_all(body, {p}, {rule.group})) AS counted, "
            f"generate_subscripts(string_split_regex(body, {p}), 1) AS i, {rule.least} AS least FROM d WHERE regexp_matches(body, {p})"
        )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = {_quoted(k)}) AS BIGINT) AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS body FROM documents),
m AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc, rank ORDER BY i) - coalesce(length(hit), 0) AS s FROM m
),
spans AS (
  SELECT doc, rank, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(hit) AS BIGINT) AS shown
  FROM placed WHERE hit IS NOT NULL AND length(counted) >= least
),
per_doc AS (
  SELECT doc, {counts},
    string_agg(shown, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(shown, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (doc)
"""


def near_vectors() -> str:
    """All pairs of a label, and components by spreading the least id."""
    return """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
sound AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y, b.vec_id AS other FROM sound a JOIN sound b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
),
reach(r, x) AS (
  SELECT r, r FROM sound UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.x
),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.x GROUP BY reach.r),
n AS (SELECT x AS r, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id IS NOT DISTINCT FROM coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN least USING (r) LEFT JOIN n USING (r)
"""


def suffix_dedup(length: int = 50) -> str:
    """Every window of every text, as hexadecimal digits, with the least document that has it."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n FROM d),
w AS (SELECT r, doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), {2 * length}) AS s FROM n, range(n - {length - 1}) t(i) WHERE doc_id IS NOT NULL AND n >= {length}),
least AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT r, i FROM w JOIN least USING (s) WHERE first < doc_id),
island AS (SELECT *, sum(CASE WHEN i - p <= {length} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS nr FROM (SELECT *, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM hit)),
span AS (SELECT r, min(i) AS a, max(i) + {length} AS z FROM island GROUP BY r, nr),
piece AS (SELECT span.r, a, z, substr(h, CAST(2 * lag(z, 1, 0) OVER (PARTITION BY span.r ORDER BY a) + 1 AS BIGINT), CAST(2 * (a - lag(z, 1, 0) OVER (PARTITION BY span.r ORDER BY a)) AS BIGINT)) AS part FROM span JOIN n USING (r)),
g AS (SELECT r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(part, '' ORDER BY a) AS head, max(z) AS last FROM piece GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM n LEFT JOIN g USING (r)"""


def source_mix() -> str:
    """Targets by rising ratio of limit to weight; takings by running sums in the order of the keys."""
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k, md5(coalesce(text, '')) AS m FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, ([3.0, 1.0, 2.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM s),
q AS (SELECT *, 2.0::DOUBLE * source_size / w AS ratio, 2.0::DOUBLE * source_size AS most FROM o),
lv AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM q),
fin AS (SELECT *, first_value(level) OVER (ORDER BY CASE WHEN ratio > level THEN 0 ELSE 1 END, ratio, nr) AS final, bool_or(ratio > level) OVER () AS bounded, bool_or(ratio > level) OVER (ORDER BY ratio, nr) AS is_open FROM lv),
t AS (SELECT source, source_size, CASE WHEN bounded AND is_open THEN w * final ELSE most END AS target FROM fin),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CASE WHEN epochs < 2 THEN CAST(floor(target - epochs * source_size) AS BIGINT) ELSE 0 END AS rest FROM e),
run AS (SELECT d.*, r.source_size, r.target, r.epochs, r.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, m) - d.size AS before FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM run"""


def near_copies(least: float = 0.8) -> str:
    """Multiset overlap of all pairs that share a shingle, and components by spreading the least id."""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), {WORD}) AS w FROM documents),
c AS (SELECT r, doc_id, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS content, w FROM d),
u AS (SELECT content, any_value(w) AS w, row_number() OVER () AS k FROM c WHERE content IS NOT NULL GROUP BY content),
sh AS MATERIALIZED (SELECT k, unnest(CASE WHEN len(w) < 5 THEN [content] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM u),
n AS MATERIALIZED (SELECT k, s, count(*) AS n FROM sh GROUP BY ALL),
size AS MATERIALIZED (SELECT k, sum(n) AS total FROM n GROUP BY k),
pair AS (SELECT a.k AS x, b.k AS y, sum(least(a.n, b.n)) AS low FROM n a JOIN n b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN size p ON p.k = x JOIN size q ON q.k = y WHERE low >= {least} * (p.total + q.total - low)),
reach(k, x) AS (SELECT k, k FROM u UNION SELECT reach.k, link.y FROM reach JOIN link ON link.x = reach.x),
first AS (SELECT u.k, min(doc_id) AS first FROM u JOIN c USING (content) GROUP BY u.k),
cls AS (SELECT reach.k, min(first) AS class_id FROM reach JOIN first ON first.k = reach.x GROUP BY reach.k)
SELECT doc_id, CASE WHEN c.content IS NULL THEN doc_id ELSE class_id END AS class_id, c.content IS NULL OR doc_id = class_id AS kept
FROM c LEFT JOIN u USING (content) LEFT JOIN cls USING (k)"""


def quality_rules(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The counts, the labelled holdout at each grid point, exact binomial tails, and the strictest cutoff before the first failure."""
    points = [(i, k, f, c, r.endswith("_low")) for i, (r, (f, grid)) in enumerate(QUALITY_RULES.items()) for k, c in enumerate(grid)]
    values = ", ".join(f"({i}, {k}, '{f}', {c}::DOUBLE, {low})" for i, k, f, c, low in points)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {WORD}) AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {WORD})) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS gram FROM w WHERE len(w) >= 3),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(3) q(j) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered ON covered.r = w.r),
m AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
p(rule, k, feature, cutoff, low) AS (VALUES {values}),
x AS (SELECT m.r, m.doc_id, m.lang, p.rule, p.k, CASE feature WHEN 'symbol_ratio' THEN symbol_ratio WHEN 'dup_line_ratio' THEN dup_line_ratio WHEN 'repeat_ratio' THEN repeat_ratio ELSE word_length END AS v, cutoff, low FROM m, p),
y AS (SELECT *, CASE WHEN low THEN v <= cutoff ELSE v >= cutoff END AS beyond FROM x),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1),
held AS (SELECT lang, rule, k, count(*) AS n, count(*) FILTER (beyond) AS hits FROM y WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
lim AS (SELECT {delta} / (count(DISTINCT coalesce(lang, chr(1))) * {len(QUALITY_RULES)}) AS level FROM held),
tail AS (SELECT *, list_sum(list_transform(range(hits + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) AS tail FROM held),
passing AS (SELECT lang, rule, k FROM (SELECT *, bool_and(tail <= level) OVER (PARTITION BY lang, rule ORDER BY k) AS ok FROM tail, lim) WHERE ok),
cut AS (SELECT lang, rule, max(k) AS k FROM passing GROUP BY ALL),
failed AS (SELECT DISTINCT y.r FROM y JOIN cut ON y.lang IS NOT DISTINCT FROM cut.lang AND y.rule = cut.rule AND y.k = cut.k WHERE beyond)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed.r IS NULL AS kept FROM m LEFT JOIN failed USING (r)"""


def turn_trie() -> str:
    """Every prefix as a list of turns, and every node's sums over the prefixes that begin with it."""
    return """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
turns AS (SELECT *, dense_rank() OVER (ORDER BY role, text) AS id FROM own),
bits AS (
  SELECT c, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: list_prepend(CAST(ord(x) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
  FROM (SELECT DISTINCT c FROM own)
),
convs AS (SELECT c, c - c % 5 AS b, xor(v, 4294967295) % 9 AS h FROM bits),
lists AS (SELECT c, list(id ORDER BY k) AS ids FROM turns GROUP BY c),
whole AS (
  SELECT n.c, coalesce(x.ids[1:n.h], CAST([] AS BIGINT[])) || o.ids[n.h + 1:] AS ids
  FROM convs n JOIN lists o USING (c) LEFT JOIN lists x ON x.c = n.b
),
sized AS (SELECT id, any_value(octet_length(encode(text))) AS n_bytes FROM turns GROUP BY id),
steps AS (SELECT c, d, ids[1:d] AS p, CASE WHEN d > 0 THEN ids[1:d - 1] END AS q, len(ids) = d AS ended, ids[d] AS id FROM whole, unnest(range(len(ids) + 1)) t(d)),
nodes AS (
  SELECT p, any_value(q) AS q, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256, any_value(id) AS id
  FROM steps GROUP BY p
),
weighed AS (SELECT n.*, (n_convs - 1) * coalesce(n_bytes, 0) AS own_saved, p NOT IN (SELECT q FROM nodes WHERE q IS NOT NULL) AS leaf FROM nodes n LEFT JOIN sized USING (id)),
sums AS (SELECT p[1:e] AS p, count(*) FILTER (leaf) AS n_leaves, sum(own_saved) AS saved, count(*) FILTER (d = e + 1) AS n_children FROM weighed, unnest(range(d + 1)) t(e) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (p) LEFT JOIN nodes up ON up.p = n.q"""


def centroid_clusters() -> str:
    """All distances, in plain integers, for three rounds and once more."""
    rounds = ""
    for k in range(4):
        rounds += f"""
a{k} AS (
  SELECT row, vec_id, q, arg_min(number, (distance, number)) AS cluster, min(distance) AS distance
  FROM (SELECT row, vec_id, v.q, number, list_sum(list_transform(list_zip(v.q, c.q), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS HUGEINT))) AS distance FROM v, c{k} c) GROUP BY ALL HAVING true
),"""
        if k < 3:
            rounds += f"""
m{k} AS (SELECT cluster, i, CAST(sum(q[i]) AS HUGEINT) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY ALL),
f{k} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM m{k} GROUP BY cluster),
c{k + 1} AS (SELECT number, coalesce(f.q, c.q) AS q FROM c{k} c LEFT JOIN f{k} f ON f.cluster = c.number),"""
    rounds = rounds.replace("row, vec_id, q, arg_min", "row, any_value(vec_id) AS vec_id, any_value(q) AS q, arg_min").replace("GROUP BY ALL HAVING true", "GROUP BY row")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS number, q FROM v QUALIFY number < 16),{rounds}
w AS (SELECT cluster, sum(distance) AS within FROM a3 GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(within AS BIGINT) AS cluster_inertia,
  CAST((SELECT sum(within) FROM w) AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a3 a JOIN w USING (cluster) JOIN c3 c ON c.number = a.cluster"""

"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from .secrets import RULES

OP1 = r"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5('11|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS dg
  FROM documents),
s0 AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS full_rows FROM d GROUP BY skey),
s1 AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, source_size * 2.0::DOUBLE AS lim FROM s0),
s2 AS (SELECT *, lim / w AS ratio FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM s2 WINDOW b AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT skey, source_size, full_rows, coalesce(least(lim, (SELECT arg_min(level, (ratio, skey)) FROM s3 WHERE level <= ratio) * w), lim) AS target FROM s3),
k AS (SELECT greatest(1, least(256, CAST(floor(coalesce(min(target) FILTER (WHERE target > 0), 0) / 1000) AS BIGINT))) AS block, sum(target) AS total, count(*) AS n FROM s4),
k2 AS (SELECT block, total, CAST(floor(total / block + 0.5) AS BIGINT) AS seats FROM k),
q1 AS (SELECT skey, unnest(range(CAST(ceil(target / block) AS BIGINT) + 2)) AS seat, target FROM s4, k2 WHERE target > 0),
q2 AS (SELECT skey, row_number() OVER (ORDER BY target / (2 * seat + 1) DESC, skey, seat) AS r FROM q1),
s5 AS (SELECT s4.*, greatest(1, CAST(ceil(source_size / 2000000) AS BIGINT), CAST(ceil(full_rows / 4096) AS BIGINT)) AS parts, (SELECT count(*) FROM q2, k2 WHERE q2.skey = s4.skey AND q2.r <= k2.seats) AS seats FROM s4),
d2 AS (SELECT *, CASE WHEN size > 0 THEN (row_number() OVER (PARTITION BY skey, dg, size) - 1) // 1024 ELSE 0 END AS run FROM d),
e AS (SELECT d2.*, source_size, target, seats, CAST('0x' || substr(md5(dg || '|' || size || '|' || run), 1, 8) AS BIGINT) % parts AS shard FROM d2 JOIN s5 USING (skey)),
c0 AS (SELECT skey, shard, CAST(sum(size) AS BIGINT) AS cell, max(seats) AS seats FROM e GROUP BY skey, shard),
c1 AS (SELECT skey, shard, cell, c0.seats, unnest(range(CAST(ceil(2 * cell / block) AS BIGINT) + 3)) AS seat FROM c0, k2 WHERE cell > 0),
c2 AS (SELECT skey, shard, seats, row_number() OVER (PARTITION BY skey ORDER BY cell / (2 * seat + 1) DESC, shard, seat) AS r FROM c1),
c3 AS (SELECT skey, shard, count(*) AS won FROM c2 WHERE r <= seats GROUP BY skey, shard),
c4 AS (SELECT c0.skey, c0.shard, cell, CAST(ceil(cell / block) AS BIGINT) AS n, block, coalesce(won, 0) AS won FROM c0 LEFT JOIN c3 ON c0.skey = c3.skey AND c0.shard = c3.shard, k2),
c5 AS (SELECT *, least(won, 2 * n) AS quota FROM c4),
c6 AS (SELECT skey, shard, cell, block, n, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS blocks,
  CASE WHEN n > 0 THEN CAST('0x' || substr(md5('11|' || skey || '|' || shard), 1, 8) AS BIGINT) % n ELSE 0 END AS a FROM c5),
f AS (SELECT e.*, coalesce(sum(size) OVER (PARTITION BY skey, shard ORDER BY dg, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM e)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(p + size, least(cell, (a + blocks) * block)) - greatest(p, a * block))
  + greatest(0, least(p + size, greatest(0, (a + blocks - n) * block)) - p) AS BIGINT) AS taken
FROM f JOIN c6 USING (skey, shard)
"""

OP8 = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
h AS (SELECT rid, i, p.n, item FROM p JOIN bw ON bw.n = p.n AND bw.win = array_to_string(p.w[i:i + p.n - 1], ' ')),
hw AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""



OP5 = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""


OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM o GROUP BY ALL HAVING count(*) >= 10),
s AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
t AS (SELECT c.*, x.a AS l, y.a AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
u AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS within FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM (SELECT *, unnest(range(2, k)) AS m FROM b WHERE k > 2)) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b LEFT JOIN u USING (lang, phrase) WHERE within IS NULL OR 100 * within < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN s USING (lang) WHERE rank <= 2000
"""


OP13 = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
c AS (SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM o WHERE length(run) >= 5 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(x, i, 2) AS BIGINT) FOR i IN range(1, length(x), 2)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT DISTINCT word, n, near, near_n FROM (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION ALL SELECT e.word, e.n, w.word, w.n FROM e JOIN w ON e.cut = w.word UNION ALL SELECT w.word, w.n, e.word, e.n FROM e JOIN w ON e.cut = w.word)),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, encode(near))) AS near FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN near END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM w LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL
"""


def op2() -> str:
    """Spans of every rule as the query has them: text before a match and the matches before it add up to where it starts."""
    steps, lists = [], []
    for i, rule in enumerate(RULES):
        p = rule.pattern.replace("'", "''")
        steps.append(f"regexp_extract_all(t, '({p})', 1) AS m{i}, regexp_extract_all(t, '({p})', {rule.group + 1}) AS g{i}, string_split_regex(t, '{p}') AS b{i}")
        start = f"CAST(list_sum([length(x) FOR x IN b{i}[1:j]]) + coalesce(list_sum([length(x) FOR x IN m{i}[1:j - 1]]), 0) AS BIGINT)"
        lists.append(f"[{{'s': {start}, 'n': {i}, 'e': {start} + length(m{i}[j]), 'k': '{rule.kind}'}} FOR j IN range(1, len(m{i}) + 1) IF length(g{i}[j]) >= {rule.least}]")
    base = ", ".join(str(i) for i, r in enumerate(RULES) if r.base)
    spelled = lambda a: f"coalesce(array_to_string([x.k || ':' || x.s || ':' || x.e FOR x IN {a}], ','), '')"
    counts = ", ".join(f"CAST(len([x FOR x IN a IF x.n = {i}]) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {", ".join(steps)} FROM d),
s AS (SELECT doc_id, list_sort({" || ".join(lists)}) AS a FROM m)
SELECT doc_id, {counts}, sha256({spelled(f"[y FOR y IN a IF y.n IN ({base})]")}) AS base_sha256, {spelled("a")} AS spans FROM s
"""


ORACLES = {"op1_mixing": OP1, "op2_secrets": op2(), "op5_warc": OP5, "op8_decontamination": OP8, "op11_collocations": OP11, "op13_spelling": OP13}

"""SQL twins of the corpus queries, in plain definitions."""

from __future__ import annotations

WORDS = """ws AS (
  SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM ws)"""

# Classes: documents with equal words, then all pairs with a shared shingle, then their closure.
OP2 = f"""WITH RECURSIVE {WORDS},
bag AS (SELECT doc_id, g, count(*) AS k FROM (
    SELECT doc_id, i, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g,
      count(*) OVER (PARTITION BY doc_id) AS n FROM word)
  WHERE i <= greatest(n - 5, 0) GROUP BY 1, 2),
size AS (SELECT doc_id, sum(k) AS n FROM bag GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.k, b.k)) AS s
  FROM bag a JOIN bag b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 10 * s >= 8 * (x.n + y.n - s)),
near AS (SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT doc_id, doc_id FROM documents),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1"""

OP3 = f"""WITH {WORDS},
win AS (SELECT doc_id, i, md5(g) AS h FROM (
    SELECT doc_id, i, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS g,
      count(*) OVER (PARTITION BY doc_id) AS n FROM word) WHERE i <= n - 35),
twice AS (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win SEMI JOIN twice USING (h)),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS t, count(*) AS k
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(k, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM ws LEFT JOIN kept USING (doc_id)"""

# Bytes as pairs of hexadecimal digits.
OP9 = """WITH hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h
  FROM (SELECT doc_id, x, unnest(range(greatest(len(x) // 2 - 199, 0))) AS i FROM hx)),
twice AS (SELECT h FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM win SEMI JOIN twice USING (h)),
part AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new
  FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (
    SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM part) GROUP BY doc_id, r),
cut AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since, b FROM run),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head,
    max(b) AS until, sum(b - a) AS gone, count(*) AS n FROM cut JOIN hx USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(until, 0) + 1))) AS kept_sha256
FROM hx LEFT JOIN kept USING (doc_id)"""

OP7 = f"""WITH {WORDS},
win AS (SELECT doc_id, i, g FROM (
    SELECT doc_id, i, string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g,
      count(*) OVER (PARTITION BY doc_id) AS n FROM word) WHERE i <= n - 8),
twice AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win SEMI JOIN twice USING (doc_id, g)) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
base AS (SELECT d.doc_id, d.source, CAST(len(ws.w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM documents d JOIN ws USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY 1),
total AS (SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS h, sum(f * f / n) AS ff FROM host),
prior AS (SELECT *, m * (1 - m) AS noise, ff / n - m * m - m * (1 - m) * h / n AS spread FROM total),
strength AS (SELECT m, CASE WHEN spread > 0 THEN least(1e6, greatest(10.0, noise / spread - 1)) ELSE 1e6 END AS k
  FROM prior),
rated AS (SELECT source, (f + m * k) / (n + k) AS rate FROM host, strength)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept, round(rate, 9) AS host_rate
FROM judged JOIN rated ON judged.source IS NOT DISTINCT FROM rated.source"""

# Targets by filling sources up in the order of the level at which they are full.
OP6 = f"""WITH {WORDS},
doc AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u FROM ws),
src AS (SELECT source, sum(size) AS s, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos
  FROM doc GROUP BY 1),
capped AS (SELECT *, [3.0, 1.0, 2.0][pos % 3 + 1] AS weight, 2.0 * s AS cap FROM src),
fill AS (SELECT *, cap / weight AS full_at,
    (1.5 * sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
aim AS (SELECT source, CAST(s AS BIGINT) AS source_size,
    least(cap, coalesce((SELECT first(level ORDER BY full_at, pos) FROM fill WHERE level <= full_at) * weight, cap))
      AS target FROM fill),
want AS (SELECT *, CAST(floor(target / nullif(source_size, 0)) AS BIGINT) AS whole0,
    greatest(1, CAST(ceil(source_size / 1000000) AS BIGINT)) AS blocks FROM aim),
part AS (SELECT *, coalesce(whole0, 0) AS whole, target - coalesce(whole0, 0) * source_size AS part FROM want),
placed AS (SELECT doc.*, source_size, target, whole, part, ((u >> 30) * blocks) >> 30 AS block
  FROM doc JOIN part ON doc.source IS NOT DISTINCT FROM part.source),
upto AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY block, u, doc_id, size
    ROWS UNBOUNDED PRECEDING) AS upto,
  sum(size) OVER (PARTITION BY source ORDER BY block) - sum(size) OVER (PARTITION BY source, block) AS before
  FROM placed),
inside AS (SELECT *, upto <= part AND size > 0 AS inside FROM upto),
edge AS (SELECT source, max(block) AS block FROM inside WHERE before < part GROUP BY 1),
short AS (SELECT i.source, min(part - CASE WHEN inside THEN upto ELSE before END) AS short
  FROM inside i JOIN edge e ON i.source IS NOT DISTINCT FROM e.source AND i.block = e.block GROUP BY 1),
more AS (SELECT i.source, first(i.doc_id ORDER BY abs(size - short), u, i.doc_id) AS doc_id
  FROM inside i JOIN edge e ON i.source IS NOT DISTINCT FROM e.source AND i.block = e.block
    JOIN short s ON i.source IS NOT DISTINCT FROM s.source
  WHERE NOT inside AND abs(size - short) < short GROUP BY 1)
SELECT i.doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (whole + CASE WHEN inside OR m.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM inside i LEFT JOIN more m ON i.source IS NOT DISTINCT FROM m.source AND i.doc_id = m.doc_id"""

OP11 = """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS place,
    first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked"""


OP12 = """WITH part AS (SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
gram AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (
      SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
      FROM part, (SELECT unnest(range(1, 6)) AS m)))
  GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(f) AS n FROM gram WHERE m = 1 GROUP BY 1),
cand AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM gram WHERE m > 1 AND f >= 100),
cut AS (SELECT lang, g, k, CAST(floor_div AS BIGINT) AS score, l, r FROM (
    SELECT c.lang, c.g, k, x.f AS l, y.f AS r,
      (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS floor_div
    FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN total t USING (lang)
      JOIN gram x ON x.lang = c.lang AND x.g = array_to_string(c.w[1 : k], ' ') AND x.m = k
      JOIN gram y ON y.lang = c.lang AND y.g = array_to_string(c.w[k + 1 : c.m], ' ') AND y.m = c.m - k)),
best AS (SELECT lang, g, arg_min({'score': score, 'l': l, 'r': r}, (score, k)) AS b FROM cut GROUP BY 1, 2),
inner_ AS (SELECT lang, m2, array_to_string(w[i : i + m2 - 1], ' ') AS g, max(a) AS longer FROM (
    SELECT *, unnest(range(1, m - m2 + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS m2 FROM cand)) GROUP BY 1, 2, 3),
kept AS (SELECT c.lang, c.g, c.a, b.b FROM cand c JOIN best b ON b.lang = c.lang AND b.g = c.g
    LEFT JOIN inner_ i ON i.lang = c.lang AND i.g = c.g AND i.m2 = c.m
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, encode(g)) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, g AS phrase, a, b.l AS l, b.r AS r, CAST(n AS BIGINT) AS n, b.score AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


def _rounds(rounds: int = 5) -> str:
    """Rounds written out: (c)entroids by component, vectors (n)ear them, and the next centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""n{r} AS MATERIALIZED (SELECT vec_id, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT p.vec_id, p.x, c.k, list_sum(list_transform(list_zip(p.x, c.x),
      lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2]))) AS d FROM point p, c{r} c) GROUP BY 1, 2)"""
        )
        steps.append(
            f"""m{r} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT k, i, sum(CAST(v AS HUGEINT)) AS s, count(*) AS n
    FROM (SELECT k, unnest(x) AS v, unnest(range(len(x))) AS i FROM n{r}) GROUP BY 1, 2) GROUP BY 1)"""
        )
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))")
    return ",\n".join(steps)


OP13 = f"""WITH point AS MATERIALIZED (SELECT vec_id,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) - 1 AS k, x
  FROM point ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x LIMIT 40),
{_rounds()}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM n5 JOIN c5 c USING (k)"""

TWINS = {
    "op2_bag_minhash": OP2,
    "op3_doubling_windows": OP3,
    "op6_source_mix": OP6,
    "op7_host_rules": OP7,
    "op9_prefix_free": OP9,
    "op11_exact_copies": OP11,
    "op12_collocations": OP12,
    "op13_centroids": OP13,
}

"""DuckDB SQL with the results of those text queries that SQL can express on whole tables."""

from .quality import BOILERPLATE, NOTICE

W = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP3 = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {W}))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per
), rising AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM weighed
), level AS (
  SELECT a.*, (1.5 * (SELECT sum(source_size) FROM per)::DOUBLE
      - 2.0 * coalesce((SELECT sum(source_size) FROM rising b WHERE b.k < a.k), 0)::DOUBLE)
      / (SELECT sum(weight) FROM rising b WHERE b.k >= a.k)::DOUBLE AS level FROM rising a
), chosen AS (
  SELECT (SELECT level FROM level WHERE level * weight <= 2.0 * source_size ORDER BY k LIMIT 1) AS level
), targets AS (
  SELECT source, source_size, least(2.0 * source_size::DOUBLE, coalesce((SELECT level FROM chosen), 'inf'::DOUBLE) * weight) AS target FROM weighed
), weighted AS (
  SELECT *, (5040 // len(bin(size)))::BIGINT AS w FROM sizes
), classes AS (
  SELECT source, w, sum(size)::BIGINT AS n FROM weighted GROUP BY source, w
), fitted AS (
  SELECT c.source, c.w, (t.target - 2.0 * coalesce((SELECT sum(d.n) FROM classes d WHERE d.source IS NOT DISTINCT FROM c.source AND d.w > c.w), 0)::DOUBLE)
      / (SELECT sum(d.w * d.n) FROM classes d WHERE d.source IS NOT DISTINCT FROM c.source AND d.w <= c.w)::DOUBLE AS f
  FROM classes c JOIN targets t ON t.source IS NOT DISTINCT FROM c.source
), factors AS (
  SELECT t.source, t.source_size, t.target, (SELECT f FROM fitted x WHERE x.source IS NOT DISTINCT FROM t.source AND isfinite(f) AND f * w <= 2.0 ORDER BY w DESC LIMIT 1) AS f FROM targets t
), expected AS (
  SELECT s.doc_id, s.source, s.size, x.source_size, x.target,
    CASE WHEN s.size > 0 THEN least(2.0, coalesce(x.f * s.w, 2.0)) ELSE 0.0 END::DOUBLE AS e,
    (('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM weighted s JOIN factors x ON x.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM expected
), ordered AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS r FROM ranked
), summed AS (
  SELECT *, sum(CASE WHEN r IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY r NULLS LAST, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, r, doc_id) AS tie, sum(whole * size) OVER (PARTITION BY source) AS sure FROM ordered
)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN r IS NOT NULL AND upto - tie / 2 <= target - sure THEN size ELSE 0 END)::BIGINT AS taken FROM summed
"""

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT row, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), found AS (
  SELECT row, i, g.n, item_id FROM grams g JOIN windows USING (n, g)
), covered AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row, i, n FROM found)) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS i FROM found) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), {W}) AS w FROM documents
), grams AS (
  SELECT row, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY md5(g)) AS n FROM grams) WHERE n > 1
), gone AS (
  SELECT DISTINCT row, p FROM (SELECT row, unnest(range(i, i + 35)) AS p FROM again)
), kept AS (
  SELECT row, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT row, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (row, p) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)
"""

_NOTICES = "|".join(BOILERPLATE)
OP8 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {W}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT row, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM again) GROUP BY row
), judged AS (
  SELECT row, line, len(regexp_extract_all(line, {W})) AS n, len(line) - len(replace(line, ' |', ' ')) AS bars,
    len(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS marks, len(regexp_replace(line, '[^\p{{Lu}}]+', '', 'g')) AS upper_, len(regexp_replace(line, '[^\p{{Ll}}]+', '', 'g')) AS lower_
  FROM (SELECT row, unnest(lines) AS line FROM d)
), stay AS (
  SELECT row, sum(n) AS n_kept_words FROM judged
  WHERE NOT (regexp_matches(lower(line), '{_NOTICES}') AND n <= {NOTICE} * len(regexp_extract_all(lower(line), '{_NOTICES}'))) AND NOT (bars >= greatest(2, n / 6) OR marks > n / 4 OR (n >= 4 AND upper_ > lower_)
    OR (n < 5 AND NOT regexp_matches(line, '[.!?:;…"''”’»)\]]\s*$'))) GROUP BY row
), base AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words
  FROM d LEFT JOIN repeats USING (row) LEFT JOIN stay USING (row)
), failed AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_kept_words <= 0.5 * n_words AND n_kept_words > 0 AS kept, n_kept_words FROM failed
"""

_T = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
OP11 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {_T}) AS t FROM documents
), b AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {_T})) AS t FROM benchmark
), whole AS (
  SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d
), counted AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY row, term
), asked AS (
  SELECT item, unnest(t) AS term FROM b
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, whole WHERE term IN (SELECT term FROM asked) GROUP BY term
), lengths AS (
  SELECT row, doc_id, 100 - 50 + ((50 * len(t) * n) // l) AS m FROM d, whole WHERE len(t) > 0
), scores AS (
  SELECT item, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (row) GROUP BY item, row
), ranked AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scores JOIN lengths USING (row) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN b USING (item) WHERE rank <= 50
"""


def _clustered(k: int, rounds: int) -> str:
    """Rounds of assigning and averaging, one CTE after another; division rounds down below 0 too."""
    down = "CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END"
    q = f"""WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INT AS c, x FROM kept ORDER BY c LIMIT {k}
)"""
    for r in range(rounds + 1):
        q += f""", a{r} AS (
  SELECT row, (min((d, c)))[1] AS distance, (min((d, c)))[2] AS cluster
  FROM (SELECT row, c, list_sum(list_transform(list_zip(kept.x, c{r}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY row
)"""
        if r < rounds:
            q += f""", s{r} AS (
  SELECT cluster, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, unnest(range(64)) AS i FROM a{r} JOIN kept USING (row)) GROUP BY cluster, i
), c{r + 1} AS (
  SELECT c, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT cluster, list({down} ORDER BY i) AS x FROM s{r} GROUP BY cluster) m ON cluster = c
)"""
    return q + f"""
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN c{rounds} ON c = cluster"""


OP13 = _clustered(16, 3)

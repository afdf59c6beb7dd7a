"""DuckDB SQL of the catalogue's queries, composed from named parts."""

from __future__ import annotations

G, BETA0, PPX, Q = 40, 0.1, 30, 91

X = "x AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
LONG = X + ", long AS (SELECT id, unnest(range(len(x)))::INT AS dim, unnest(x) AS v FROM x)"
Y = f"y AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS y1, embedding[2]::DOUBLE * 100 AS y2, {BETA0}::DOUBLE AS beta, label FROM embeddings)"
SQ = "list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
DIST = X + f", dist AS (SELECT a.id AS i, b.id AS j, {SQ} AS sqdist FROM x a, x b)"
NEAR = DIST + ", near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sqdist, i <> j, j) AS rank FROM dist)"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


FRAME = f"""{Y}, f AS (SELECT arg_min(y1 - 3 / sqrt(2 * beta), y1) AS x0, arg_max(y1 + 3 / sqrt(2 * beta), y1) AS x1,
  arg_min(y2 - 3 / sqrt(2 * beta), y2) AS y0, arg_max(y2 + 3 / sqrt(2 * beta), y2) AS y1, count(*) AS n FROM y)"""
CELLS = f"cells AS (SELECT (cx + cy * {G})::BIGINT AS cell, cx::INT AS cx, cy::INT AS cy FROM range({G}) a(cx), range({G}) b(cy))"
AREA = f"((f.x1 - f.x0) / {G - 1} * ((f.y1 - f.y0) / {G - 1}))"
KERNEL = f"y.beta * exp(-y.beta * (power(y.y1 - (f.x0 + c.cx * ((f.x1 - f.x0) / {G - 1})), 2) + power(y.y2 - (f.y0 + c.cy * ((f.y1 - f.y0) / {G - 1})), 2)))"
RASTER = f"{FRAME}, {CELLS}, raster AS (SELECT c.cell, any_value(c.cx) AS cx, any_value(c.cy) AS cy, sum({KERNEL}) * any_value({AREA} / (pi() * f.n)) AS z FROM cells c, y, f GROUP BY c.cell)"
CLASSES = f"{FRAME}, {CELLS}, classed AS (SELECT c.cell, y.label AS class, sum({KERNEL}) * any_value({AREA} / (pi() * f.n)) AS p FROM cells c, y, f GROUP BY c.cell, y.label)"
NB8 = "nb8 AS (SELECT a.cell, b.cell AS nb FROM cells a JOIN cells b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1)"
SHED = f"""{RASTER}, {NB8}, parent AS (SELECT n.cell, arg_max(n.nb, (r.z, n.nb)) AS up FROM nb8 n JOIN raster r ON r.cell = n.nb GROUP BY n.cell),
chase AS (SELECT cell, up, 0 AS k FROM parent UNION ALL SELECT c.cell, p.up, k + 1 FROM chase c JOIN parent p ON p.cell = c.up WHERE p.up <> c.up),
ends AS (SELECT cell, arg_max(up, k) AS peak FROM chase GROUP BY cell),
ids AS (SELECT peak, row_number() OVER (ORDER BY z DESC, peak)::INT AS cluster FROM (SELECT DISTINCT peak FROM ends) e JOIN raster r ON r.cell = e.peak),
shed AS (SELECT cell, cluster, peak FROM ends JOIN ids USING (peak))"""
BOX = "lim AS (SELECT floor(min(y1)) AS a, ceil(max(y1)) AS b, floor(min(y2)) AS c, ceil(max(y2)) AS d FROM y)"
PCELL = f"""pc AS (SELECT id, least(floor((y1 - a) * ({G} / (b - a))), {G - 1})::INT AS cx, least(floor((y2 - c) * ({G} / (d - c))), {G - 1})::INT AS cy FROM y, lim)"""
POINTS = f"{SHED}, {BOX}, {PCELL}, labels AS (SELECT id, cluster FROM pc JOIN shed ON shed.cell = pc.cx + pc.cy * {G})"
MOMENTS = f"{POINTS}, {LONG}, mom AS (SELECT cluster, dim, count(*) AS n, avg(v) AS mean, coalesce(var_samp(v), 0) AS var FROM long JOIN labels USING (id) GROUP BY cluster, dim)"


def levels(key: str, value: str, source: str, n: int = 8) -> str:
    cuts = ", ".join(f"{i / n}" for i in range(1, n))
    return f"""WITH v AS (SELECT {key} AS key, ({value})::DOUBLE AS v FROM {source}), q AS (SELECT quantile_cont(v, [{cuts}]) AS q FROM v)
    SELECT key, (CASE WHEN v IS NULL THEN {n + 1} ELSE 1 + len(list_filter(q, lambda c: c < v)) END)::INT AS level FROM v, q"""


def boxes(head: str, source: str, group: str, value: str, names: str) -> str:
    """Hinges as the medians of both halves, the middle value in each."""
    return f"""{head} s AS (SELECT {group} AS g, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
    o AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS k, count(*) OVER (PARTITION BY g) AS n FROM s),
    h AS (SELECT g, v, k, n, floor((n + 3) / 2) / 2 AS h FROM o),
    q AS (SELECT g, avg(v) FILTER (k = floor(h) OR k = ceil(h)) AS q1, avg(v) FILTER (k = floor((n + 1) / 2) OR k = ceil((n + 1) / 2)) AS med, avg(v) FILTER (k = floor(n + 1 - h) OR k = ceil(n + 1 - h)) AS q3 FROM h GROUP BY g)
    SELECT {names}, {r('min(v)')} AS lo, {r('any_value(q1)')} AS q1, {r('any_value(med)')} AS med, {r('any_value(q3)')} AS q3, {r('max(v)')} AS hi
    FROM s JOIN q USING (g) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY g"""


def draw(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"((('0x' || substr(md5({text}), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


def normal(*parts: str) -> str:
    return f"(sqrt(-2 * ln({draw(chr(39) + 'r' + chr(39), *parts)})) * cos(2 * pi() * {draw(chr(39) + 'a' + chr(39), *parts)}))"


#: The Lambert value by Newton steps on w + ln(-w) = ln(-x), as columns w0, w1, ...
def lambert(x: str, source: str, keep: str) -> str:
    start = f"CASE WHEN {x} < -1 / exp(1) OR {x} >= 0 THEN NULL WHEN {x} < -0.25 THEN -1 - sqrt(greatest(0, 2 * (1 + exp(1) * {x}))) ELSE ln(-{x}) - ln(-ln(-{x})) END"
    q = f"SELECT {keep}, ln(CASE WHEN {x} < 0 THEN -{x} END) AS lx, {start} AS w FROM {source}"
    for _ in range(12):
        q = f"SELECT {keep}, lx, CASE WHEN w IS NULL OR w >= -1 THEN w ELSE least(w - (w + ln(-w) - lx) / (1 + 1 / w), -1) END AS w FROM ({q})"
    return q


def calibrated(head: str, ppx: int, q: str) -> str:
    """``head`` defines near(i, j, sqdist, rank); gives cal(id, beta, z, lq). The state is one row a point and round."""
    return f"""{head}, near_q AS (SELECT i AS id, list(sqdist ORDER BY rank) FILTER (rank <= {q}) AS l, max(sqdist) FILTER (rank = {q} + 1) AS lq FROM near GROUP BY i),
    arg AS (SELECT id, l, lq, CASE WHEN lq > 0 THEN -2 * pi() * lq / power({3 * ppx}, 2) END AS a FROM near_q),
    base AS (SELECT id, l, lq, -w / (2 * lq) AS bw FROM ({lambert('a', 'arg', 'id, l, lq')})),
    run AS (
      SELECT id, 0 AS it, 1.0::DOUBLE AS b, 0.0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, false AS done FROM base
      UNION ALL
      SELECT id, it + 1, CASE WHEN took THEN bw WHEN ok THEN b WHEN gap < 0 THEN CASE WHEN isinf(hi) THEN 2 * b ELSE (b + hi) / 2 END ELSE (b + lo) / 2 END,
        CASE WHEN NOT took AND NOT ok AND gap < 0 THEN b ELSE lo END, CASE WHEN NOT took AND NOT ok AND gap >= 0 THEN b ELSE hi END, took OR ok
      FROM (SELECT *, h = 0 AND bw IS NOT NULL AND b > bw AS took, abs(ln({ppx}) - h) < ln(1 / 0.99999) AS ok, ln({ppx}) - h AS gap FROM (
        SELECT *, CASE WHEN z > 1 THEN b * s / z + ln(z) ELSE 0 END AS h FROM (
          SELECT r.id, r.it, r.b, r.lo, r.hi, base.bw, list_sum(list_transform(base.l, lambda d: exp(-r.b * d))) - 1 AS z, list_sum(list_transform(base.l, lambda d: d * exp(-r.b * d))) AS s
          FROM run r JOIN base USING (id) WHERE NOT r.done AND r.it < 100)))
    ), last AS (SELECT id, arg_max(b, it) AS beta FROM run GROUP BY id),
    cal AS (SELECT id, beta, lq, list_sum(list_transform(l, lambda d: exp(-beta * d))) - 1 AS z FROM last JOIN base USING (id))"""


PART = """p AS (SELECT p_size::DOUBLE AS s, p_retailprice AS t, min(p_partkey) AS id FROM part GROUP BY p_size, p_retailprice)"""
PART_X = {False: f"{PART}, x AS (SELECT id, [s, t] AS x FROM p)", True: f"{PART}, x AS (SELECT id, [s / m, t / m] AS x FROM p, (SELECT greatest(max(s), max(t)) AS m FROM p))"}


def part_near(scaled: bool) -> str:
    return PART_X[scaled] + f", dist AS (SELECT a.id AS i, b.id AS j, {SQ} AS sqdist FROM x a, x b), near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sqdist, i <> j, j) AS rank FROM dist)"


PART_Q = "least(91, (SELECT count(*) FROM p) - 1)"
EMB_Q = "least({}, (SELECT count(*) FROM embeddings) - 1)"
CHUNK = f"""{DIST}, {Y}, k AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE exp(-2.0 * sqdist) / 3.0 END AS k FROM dist),
mutual AS (SELECT a.i, a.j, a.k AS kij, b.k AS kji, row_number() OVER (PARTITION BY a.i ORDER BY a.k + b.k DESC, a.j) AS rank FROM k a JOIN k b ON a.i = b.j AND a.j = b.i WHERE a.i <> a.j),
pick AS (SELECT * FROM mutual WHERE rank <= 20), tot AS (SELECT i, sum(kij) AS n FROM pick GROUP BY i),
aff AS (SELECT p.i, p.j, 0.5 / (SELECT count(*) FROM x) * (kij / t.n + kji / u.n) AS p FROM pick p JOIN tot t ON t.i = p.i JOIN tot u ON u.i = p.j),
z AS (SELECT id, y1 / 10 AS y1, y2 / 10 AS y2 FROM y),
q AS (SELECT a.id AS i, b.id AS j, a.y1 - b.y1 AS d1, a.y2 - b.y2 AS d2, 1 / (1 + power(a.y1 - b.y1, 2) + power(a.y2 - b.y2, 2)) AS q FROM z a JOIN z b ON a.id <> b.id)"""
RANKS = f"""{DIST}, {Y}, ydist AS (SELECT a.id AS i, b.id AS j, power(a.y1 - b.y1, 2) + power(a.y2 - b.y2, 2) AS sqdist FROM y a, y b)"""
YNEAR = f"""{Y}, dist AS (SELECT a.id AS i, b.id AS j, power(a.y1 - b.y1, 2) + power(a.y2 - b.y2, 2) AS sqdist FROM y a, y b),
near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sqdist, i <> j, j) AS rank FROM dist)"""
#: Of each point the five entries of greatest absolute value, all others 0.
SPARSE = f"""x0 AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
o AS (SELECT id, unnest(range(len(x)))::INT AS dim, unnest(x) AS v FROM x0), t AS (SELECT id, dim, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY -abs(v), dim) <= 5 THEN v ELSE 0 END AS v FROM o),
x AS (SELECT id, list(v ORDER BY dim) AS x FROM t GROUP BY id), dist AS (SELECT a.id AS i, b.id AS j, {SQ} AS sqdist FROM x a, x b),
near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sqdist, i <> j, j) AS rank FROM dist)"""
KNP = f"""{RANKS}, n AS (SELECT count(*) AS n FROM x), top AS (SELECT log2(n - 5) AS t, n FROM n),
ks AS (SELECT DISTINCT ceil(power(2, 1 + s * ((t - 1) / 99)))::INT AS k FROM top, range(99) r(s) UNION SELECT ceil(power(2, t))::INT FROM top),
rx AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY sqdist, j) AS rx FROM dist), ry AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY sqdist, j) AS ry FROM ydist),
met AS (SELECT greatest(rx, ry) AS rank, count(*) AS c FROM rx JOIN ry USING (i, j) GROUP BY ALL),
curve AS (SELECT k, c / (k * n) AS q, greatest(ceil((n - 1) * (c / (k * n))) - k, 0) / (n - 1 - k) AS r FROM (SELECT k, n, (SELECT coalesce(sum(c), 0) FROM met WHERE rank <= k)::DOUBLE AS c FROM ks, n))"""

KNP_100 = KNP.replace("log2(n - 5)", "log2(96)")
COVARIANCE = "cov AS (SELECT var_samp(p_size) AS a, var_samp(p_retailprice) AS b, covar_samp(p_size, p_retailprice) AS c, avg(p_size) AS s, avg(p_retailprice) AS t FROM part)"
FATHERS = """e AS (SELECT a.cluster, a.cell, ra.z, b.cell AS nb, rb.z AS nz, b.cluster AS other FROM shed a JOIN nb8 n ON n.cell = a.cell JOIN shed b ON b.cell = n.nb JOIN raster ra ON ra.cell = a.cell JOIN raster rb ON rb.cell = b.cell WHERE a.cluster <> b.cluster),
up AS (SELECT cluster, arg_max(other, (z, -cell, nz, -nb)) AS father FROM e GROUP BY cluster), t AS (SELECT cluster, max(z) AS top FROM shed JOIN raster USING (cell) GROUP BY cluster),
fathers AS (SELECT t.cluster, CASE WHEN u.top >= t.top THEN up.father ELSE t.cluster END AS father FROM t LEFT JOIN up ON up.cluster = t.cluster LEFT JOIN t u ON u.cluster = up.father)"""
POOLED = f"""WITH RECURSIVE {MOMENTS}, {FATHERS}, both_ AS (SELECT f.cluster AS child, f.father, a.dim, a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2, a.var AS v1, b.var AS v2, (a.n * a.mean + b.n * b.mean) / (a.n + b.n) AS mean
  FROM fathers f JOIN mom a ON a.cluster = f.cluster JOIN mom b ON b.cluster = f.father AND b.dim = a.dim WHERE f.cluster <> f.father),
pooled AS (SELECT child, father, dim, n1 + n2 AS n, mean, (n1 * (v1 + m1 * m1 - mean * mean) + n2 * (v2 + m2 * m2 - mean * mean)) / (n1 + n2) AS var FROM both_)"""
#: Greedy merging to {TO} clusters by its ratio, within the first level of fathers (the given tables need no other to five); ``label`` has each cluster's present one.
#: Of clusters joined, sums of n and n * mean give the ratio: the squares of all points together stay as they are.
MERGED = f"""WITH RECURSIVE {MOMENTS}, {FATHERS}, g AS (SELECT dim, sum(n * mean) / sum(n) AS grand FROM mom GROUP BY dim),
whole AS (SELECT sum(n) FILTER (dim = 0) AS total, sum(n * (var + mean * mean)) AS squares, (SELECT count(*) FROM ids) AS k FROM mom),
kids AS (SELECT i.cluster, f.father, coalesce((SELECT list(h.cluster) FROM fathers h WHERE h.father = i.cluster AND h.cluster <> h.father), []) AS kids FROM ids i JOIN fathers f USING (cluster) WHERE f.father <> f.cluster),
walk AS (SELECT 0 AS step, (SELECT list(cluster ORDER BY cluster) FROM ids) AS label, 0 AS child, 0 AS father,
    (SELECT (sum(power(mean - grand, 2)) / (count(DISTINCT cluster) - 1)) / (sum(n * var) / (any_value(total) - count(DISTINCT cluster))) FROM mom JOIN g USING (dim), whole) AS s2nr
  UNION ALL SELECT step + 1, list_transform(any_value(label), lambda v: CASE WHEN v = arg_max(child, (round(ratio, 12), -child)) THEN arg_max(father, (round(ratio, 12), -child)) ELSE v END),
    arg_max(child, (round(ratio, 12), -child)), arg_max(father, (round(ratio, 12), -child)), max(ratio)
  FROM (SELECT step, any_value(label) AS label, child, father, (sum(power(s / n - grand, 2)) / (count(DISTINCT root) - 1)) / ((any_value(squares) - sum(s * s / n)) / (any_value(total) - count(DISTINCT root))) AS ratio
    FROM (SELECT step, any_value(label) AS label, child, father, CASE WHEN label[cluster] = child THEN father ELSE label[cluster] END AS root, dim, sum(n) AS n, sum(n * mean) AS s
      FROM (SELECT w.step, w.label, c.cluster AS child, c.father FROM walk w, whole, kids c
        WHERE w.step < whole.k - {{TO}} AND w.label[c.cluster] = c.cluster AND len(list_filter(c.kids, lambda v: w.label[v] = v)) = 0) cand, mom
      GROUP BY step, child, father, root, dim) joined JOIN g USING (dim), whole GROUP BY step, child, father) scored GROUP BY step)"""
#: The layout's points with the precision they have in it.
ADAPTIVE = calibrated(YNEAR.replace("y AS (", "y0 AS (", 1).replace("FROM y a, y b", "FROM y0 a, y0 b"), PPX, EMB_Q.format(Q)) + ", y AS (SELECT id, y1, y2, cal.beta, label FROM y0 JOIN cal USING (id))"

ORACLES: dict[str, str] = {
    "pair_sqdist": f"WITH {X} SELECT a.id AS i, b.id AS j, {r(SQ)} AS sqdist FROM x a JOIN x b ON a.id < b.id",
    "nn_quantile": f"WITH {NEAR} SELECT i AS vec_id, {r('sqdist')} AS lq FROM near WHERE rank = {Q + 1}",
    "knn_rank": f"WITH {NEAR} SELECT i, j, rank::INT AS rank FROM near WHERE rank <= 10",
    "neighbour_bound": f"WITH {NEAR} SELECT i, j, {r('sqdist')} AS sqdist FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY j) AS k FROM near WHERE rank <= {Q + 1} AND i <> j) WHERE k <= 90",
    "sparse_sqdist": f"""WITH {LONG}, top AS (SELECT id, dim + 1 AS k, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -abs(v), dim) AS o FROM long) WHERE o <= 5)
        SELECT i, j, {r('sum(d * d)')} AS sqdist FROM (SELECT i, j, k, sum(v) AS d FROM (
          SELECT a.id AS i, b.id AS j, t.k, t.v FROM x a JOIN x b ON a.id < b.id JOIN top t ON t.id = a.id
          UNION ALL SELECT a.id, b.id, t.k, -t.v FROM x a JOIN x b ON a.id < b.id JOIN top t ON t.id = b.id) GROUP BY i, j, k) GROUP BY i, j""",
    "distance_source": f"WITH {Y}, d AS (SELECT a.id AS i, b.id AS j, sqrt(power(a.y1 - b.y1, 2) + power(a.y2 - b.y2, 2)) AS d FROM y a JOIN y b ON a.id < b.id) SELECT i, j, {r('d * d', 4)} AS sqdist FROM d",
    "center_scale": f"WITH {LONG}, c AS (SELECT id, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM long) SELECT id AS vec_id, dim, {r('v / (SELECT max(abs(v)) FROM c)')} AS v FROM c",
    "csv_positions": f"SELECT row_number() OVER (ORDER BY p_partkey) AS id, {r('p_size::DOUBLE')} AS p_size, {r('p_retailprice::DOUBLE')} AS p_retailprice FROM part",
    "mixture": f"""WITH l AS (SELECT c_custkey::BIGINT AS id, floor({draw("'4'", "'label'", "c_custkey::VARCHAR")} * 16)::INT AS label FROM customer),
        d AS (SELECT id, label, dim::INT AS dim FROM l, range(4) t(dim))
        SELECT id, label, dim, {r(f"""10 * {normal("'4'", "'centre'", "label::VARCHAR", "dim::VARCHAR")} + (0.5 + 1.5 * {draw("'4'", "'spread'", "label::VARCHAR")}) * {normal("'4'", "'x'", "id::VARCHAR", "dim::VARCHAR")}""")} AS v FROM d""",
    "label_factor": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment)::INT AS code FROM customer",
    "label_factor_brand": "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand)::INT AS code FROM part",
    "source_shape": "SELECT count(*) AS n, max(len(embedding))::BIGINT AS m FROM embeddings",
    "whiten_centre": f"WITH {LONG} SELECT id AS vec_id, dim, {r('v - avg(v) OVER (PARTITION BY dim)')} AS v FROM long",
    "whiten_zscore": f"WITH {LONG} SELECT id AS vec_id, dim, {r('(v - avg(v) OVER (PARTITION BY dim)) / stddev_samp(v) OVER (PARTITION BY dim)')} AS v FROM long",
    "column_prune": f"WITH {LONG} SELECT id AS vec_id, dim, {r('v')} AS v FROM long WHERE dim < 3",
    "pca_whitened": "SELECT d::INT AS dim, 1.0::DOUBLE AS var FROM range(5) r(d)",
    "entropy_at_beta": f"""WITH {NEAR}, s AS (SELECT i, sum(exp(-sqdist)) - 1 AS z, sum(sqdist * exp(-sqdist)) AS s FROM near WHERE rank <= {Q} GROUP BY i)
        SELECT i AS vec_id, {r('z')} AS z, {r('CASE WHEN z > 1 THEN s / z + ln(z) ELSE 0 END')} AS h FROM s""",
    "beta_calibration": "WITH RECURSIVE " + calibrated(NEAR, PPX, EMB_Q.format(91)) + f" SELECT id AS vec_id, {r('beta')} AS beta, {r('2 * z')} AS znorm, {r('lq')} AS lq FROM cal",
    "beta_calibration_feat": "WITH RECURSIVE " + calibrated(part_near(True), PPX, PART_Q) + f" SELECT id, {r('beta', 4)} AS beta, {r('lq', 4)} AS lq FROM cal",
    "beta_calibration_raw": "WITH RECURSIVE " + calibrated(part_near(False), PPX, PART_Q) + f" SELECT id, {r('beta')} AS beta, {r('lq')} AS lq FROM cal",
    "beta_calibration_distance": "WITH RECURSIVE " + calibrated(YNEAR, PPX, EMB_Q.format(91)) + f" SELECT id, {r('beta', 5)} AS beta, {r('lq', 5)} AS lq FROM cal",
    "beta_calibration_sparse": "WITH RECURSIVE " + calibrated(SPARSE, PPX, EMB_Q.format(91)) + f" SELECT id, {r('beta', 5)} AS beta, {r('lq', 5)} AS lq FROM cal",
    "beta_many_perplexities": " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {calibrated(NEAR, p, EMB_Q.format(3 * p + 1))} SELECT id AS vec_id, {p}::INT AS ppx, {r('beta')} AS beta FROM cal)" for p in (5, 10, 30)),
    "normalised_distances": f"WITH {YNEAR} SELECT i, j, {r('sqdist / (SELECT max(sqdist) FROM dist)', 5)} AS sqdist FROM dist WHERE i < j",
    "global_affinity_sparse": f"WITH {SPARSE} SELECT i, j, {r('2 * exp(-2.0 * sqdist) / 3.0', 7)} AS p FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY j) AS k FROM near WHERE rank <= {Q + 1} AND i <> j) WHERE k <= 90",
    "neighbour_check": f"WITH {CHUNK} SELECT i AS id, count(*) FILTER (p > 0) AS positive, {r('sum(p)', 9)} AS total FROM aff GROUP BY i",
    "covariate_maps": f"SELECT key, 'p_size' AS var, level FROM ({levels('p_partkey', 'p_size', 'part')}) UNION ALL SELECT key, 'p_retailprice', level FROM ({levels('p_partkey', 'p_retailprice', 'part')})",
    "precision_levels": f"""WITH RECURSIVE {calibrated(NEAR, PPX, EMB_Q.format(91))}, v AS (SELECT id AS key, round(beta, 9) AS v FROM cal), q AS (SELECT quantile_cont(v, [{", ".join(str(i / 8) for i in range(1, 8))}]) AS q FROM v)
        SELECT key AS vec_id, (1 + len(list_filter(q, lambda c: c < v)))::INT AS level FROM v, q""",
    "embed_scheme": f"WITH n AS (SELECT count(*) AS n, count(*) * 2 / 4 AS z FROM embeddings) SELECT n, z::DOUBLE AS z, round_even(least(3.0 * {PPX} * 2 / 4, z - 1), 0)::INT AS nn, floor(4 * ln(n))::INT AS epochs, ceil(4 * ln(z))::INT AS iters FROM n",
    "chunk_assignment": f"WITH c AS (SELECT vec_id AS id, floor({draw(chr(39) + '7:1' + chr(39), 'vec_id::VARCHAR')} * 4)::INT AS c FROM embeddings) SELECT ((c - l + 4) % 4)::INT AS worker, (l + 1)::INT AS layer, id FROM c, range(2) r(l)",
    "layout_start": f"WITH d AS (SELECT vec_id AS id, (l + 1)::INT AS layer, sqrt({draw(chr(39) + '7r' + chr(39), 'vec_id::VARCHAR', '(l + 1)::VARCHAR')}) * sqrt(0.5) / 2 AS r, 2 * pi() * {draw(chr(39) + '7a' + chr(39), 'vec_id::VARCHAR', '(l + 1)::VARCHAR')} AS a FROM embeddings, range(2) t(l)) SELECT id, layer, {r('r * cos(a)')} AS y1, {r('r * sin(a)')} AS y2 FROM d",
    "local_affinity": f"WITH {CHUNK} SELECT i, j, {r('p', 9)} AS p FROM aff",
    "tsne_one_step": f"""WITH {CHUNK}, a AS (SELECT q.i, sum(p * q * d1) / (SELECT sum(p) FROM aff) AS a1, sum(p * q * d2) / (SELECT sum(p) FROM aff) AS a2 FROM q JOIN aff USING (i, j) GROUP BY q.i),
        b AS (SELECT i, sum(q * q * d1) / (SELECT sum(q) FROM q) AS b1, sum(q * q * d2) / (SELECT sum(q) FROM q) AS b2 FROM q GROUP BY i) SELECT i AS id, {r('a1 - b1', 9)} AS dy1, {r('a2 - b2', 9)} AS dy2 FROM a JOIN b USING (i)""",
    "tsne_cost": f"WITH {CHUNK} SELECT {r('((SELECT sum(p * ln(1 / q)) / sum(p) FROM q JOIN aff USING (i, j)) + ln((SELECT sum(q) FROM q))) / ln((SELECT count(*) * (count(*) - 1.0) FROM x))')} AS cost",
    "global_affinity": f"WITH {NEAR} SELECT i, j, {r('2 * exp(-2.0 * sqdist) / 3.0', 9)} AS p FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY j) AS k FROM near WHERE rank <= {Q + 1} AND i <> j) WHERE k <= 90",
    "embedding_size": f"WITH {Y} SELECT {r('sqrt(power(max(y1) - min(y1), 2) + power(max(y2) - min(y2), 2))')} AS size FROM y",
    "layer_average": f"WITH {Y} SELECT id, {r('(y1 + y2) / 2')} AS y1, {r('(y1 + y2) / 2')} AS y2 FROM y",
    "grid_frame": f"""WITH {Y}, {BOX}, a AS (SELECT 'x' AS axis, a AS lo, b AS hi FROM lim UNION ALL SELECT 'y', c, d FROM lim)
        SELECT axis, {G}::INT AS size, {r('lo')} AS min, {r('hi')} AS max, {r('hi - lo')} AS range, {r(f'{G} / (hi - lo)')} AS factor, {r(f'(SELECT sqrt(sum(power((hi - lo) / {G}, 2))) FROM a)')} AS diag FROM a""",
    "raster_bounds": f"WITH {FRAME} SELECT {r('x0')} AS x0, {r('x1')} AS x1, {r('y0')} AS y0, {r('y1')} AS y1, {r(AREA)} AS d FROM f",
    "point_cell": f"WITH {Y}, {BOX}, {PCELL} SELECT id AS vec_id, cx, cy, (cx + cy * {G})::BIGINT AS cell FROM pc",
    "cell_neighbours8": f"WITH {RASTER}, {NB8} SELECT n.cell, n.nb FROM nb8 n JOIN raster r ON r.cell = n.cell JOIN raster s ON s.cell = n.nb",
    "cell_neighbours4": f"WITH {RASTER} SELECT a.cell, b.cell AS nb FROM raster a JOIN raster b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) <= 1",
    "pakde_adaptive": f"WITH RECURSIVE {ADAPTIVE}, {RASTER.removeprefix(Y + ', ')} SELECT cell, {r('z * 1e6', 3)} AS z FROM raster",
    "adaptive_clusters": f"WITH RECURSIVE {ADAPTIVE}, {POINTS.removeprefix(Y + ', ')} SELECT id AS vec_id, cluster FROM labels",
    "map_scatter": f"WITH {Y} SELECT id, {r('y1')} AS y1, {r('y2')} AS y2, label AS class FROM y",
    "class_map": f"""WITH RECURSIVE {SHED}, {CLASSES.removeprefix(f"{FRAME}, {CELLS}, ")}, t AS (SELECT cell, sum(p) AS s, min(p) AS lo, max(p) AS hi, arg_max(class, (p, class)) AS best FROM classed GROUP BY cell),
        h AS (SELECT cell, best AS class FROM t WHERE lo < hi AND s > (SELECT min(s) + (max(s) - min(s)) / 16 FROM t)),
        rim AS (SELECT DISTINCT a.cell FROM shed a JOIN cells ca ON ca.cell = a.cell JOIN cells cb ON abs(ca.cx - cb.cx) + abs(ca.cy - cb.cy) = 1 JOIN shed b ON b.cell = cb.cell WHERE a.cluster <> b.cluster)
        SELECT cell, {r(f'f.x0 + raster.cx * ((f.x1 - f.x0) / {G - 1})')} AS gx, {r(f'f.y0 + raster.cy * ((f.y1 - f.y0) / {G - 1})')} AS gy, {r('z * 1e6', 4)} AS z, cluster, rim.cell IS NOT NULL AS border, cell = peak AS peak,
        coalesce(h.class, -1) AS class, coalesce({r('p * 1e6', 4)}, 0.0) AS p FROM raster JOIN shed USING (cell) LEFT JOIN rim USING (cell) LEFT JOIN h USING (cell) LEFT JOIN classed USING (cell, class), f""",
    "fuzzy_class_map": f"WITH {CLASSES} SELECT cell, class, CASE WHEN min(p) OVER w = max(p) OVER w THEN 0 ELSE {r('p * 1e6', 4)} END AS p FROM classed WINDOW w AS (PARTITION BY cell)",
    "pca_parts": f"WITH {COVARIANCE} SELECT unnest([0, 1])::INT AS dim, {r('unnest([(a + b + root) / 2, (a + b - root) / 2])', 4)} AS var FROM (SELECT a, b, sqrt((a - b) * (a - b) + 4 * c * c) AS root FROM cov)",
    "pca_parts_length": f"WITH {COVARIANCE} SELECT p_partkey, {r('(b * ds * ds - 2 * c * ds * dt + a * dt * dt) / (a * b - c * c)')} AS length FROM (SELECT p_partkey, p_size - s AS ds, p_retailprice - t AS dt FROM part, cov), cov",
    "s2nr_pooled": f"{POOLED} SELECT child, father, dim, n, {r('mean')} AS mean, {r('var')} AS var FROM pooled",
    "s2nr_merge": f"{MERGED.format(TO=5)} SELECT step, child, father, {r('s2nr')} AS s2nr, 1 AS level FROM walk WHERE step > 0",
    "s2nr_optk": f"{MERGED.format(TO=2)}, fall AS (SELECT step, s2nr - lead(s2nr) OVER (ORDER BY step) AS drop FROM walk) SELECT (k - arg_max(step, (drop, -step)))::INT AS k FROM fall, whole WHERE drop IS NOT NULL GROUP BY k",
    "merge_trace": f"{MERGED.format(TO=5)} SELECT step, (k - step)::INT AS clusters, {r('s2nr')} AS s2nr, 1 AS level, coalesce({r('s2nr - lead(s2nr) OVER (ORDER BY step)')}, 0.0) AS drop FROM walk, whole",
    "s2nr_candidates": f"""{POOLED}, g AS (SELECT dim, sum(n * mean) / sum(n) AS grand FROM mom GROUP BY dim), k AS (SELECT count(DISTINCT cluster) AS c, sum(n) FILTER (dim = 0) AS total FROM mom),
        kept AS (SELECT p.child, p.father, m.dim, m.n, m.mean, m.var FROM (SELECT DISTINCT child, father FROM pooled) p JOIN mom m ON m.cluster <> p.child AND m.cluster <> p.father UNION ALL SELECT child, father, dim, n, mean, var FROM pooled)
        SELECT child, father, {r('(sum(power(mean - grand, 2)) / any_value(c - 2)) / (sum(n * var) / any_value(total - c + 1))')} AS s2nr FROM kept JOIN g USING (dim), k GROUP BY child, father""",
    "knp_curves": f"SELECT 'first' AS name, * FROM (WITH {KNP_100} SELECT k, {r('q')} AS q, {r('r')} AS r FROM curve) UNION ALL SELECT 'next', * FROM (WITH {KNP_100.replace('embedding[1]', 'embedding[3]').replace('embedding[2]', 'embedding[4]')} SELECT k, {r('q')} AS q, {r('r')} AS r FROM curve)",
    "pakde_raster": f"WITH {RASTER} SELECT cell, {r('z * 1e6', 4)} AS z FROM raster",
    "density_mass": f"WITH {RASTER} SELECT {r('sum(z)')} AS total FROM raster",
    "density_peaks": f"WITH {RASTER}, {NB8} SELECT r.cell, {r('any_value(r.z) * 1e6', 4)} AS z FROM raster r JOIN nb8 n ON n.cell = r.cell JOIN raster s ON s.cell = n.nb GROUP BY r.cell HAVING any_value(r.z) >= max(s.z)",
    "watershed_cells": f"WITH RECURSIVE {SHED} SELECT cell, cluster FROM shed",
    "cluster_peaks": f"WITH RECURSIVE {SHED} SELECT cluster, peak AS peak_cell FROM ids",
    "point_clusters": f"WITH RECURSIVE {POINTS} SELECT id AS vec_id, cluster FROM labels",
    "cluster_borders": f"WITH RECURSIVE {SHED} SELECT a.cell, b.cell AS nb FROM shed a JOIN cells ca ON ca.cell = a.cell JOIN cells cb ON abs(ca.cx - cb.cx) + abs(ca.cy - cb.cy) = 1 AND cb.cell > ca.cell JOIN shed b ON b.cell = cb.cell WHERE a.cluster <> b.cluster",
    "cluster_moments": f"WITH RECURSIVE {MOMENTS} SELECT cluster, dim, n, {r('mean')} AS mean, {r('var')} AS var FROM mom",
    "cluster_fathers": f"""WITH RECURSIVE {SHED}, e AS (SELECT a.cluster, a.cell, ra.z, b.cell AS nb, rb.z AS nz, b.cluster AS other FROM shed a JOIN nb8 n ON n.cell = a.cell JOIN shed b ON b.cell = n.nb JOIN raster ra ON ra.cell = a.cell JOIN raster rb ON rb.cell = b.cell WHERE a.cluster <> b.cluster),
        up AS (SELECT cluster, arg_max(other, (z, -cell, nz, -nb)) AS father FROM e GROUP BY cluster), t AS (SELECT cluster, max(z) AS top FROM shed JOIN raster USING (cell) GROUP BY cluster)
        SELECT t.cluster, CASE WHEN u.top >= t.top THEN up.father ELSE t.cluster END AS father FROM t LEFT JOIN up ON up.cluster = t.cluster LEFT JOIN t u ON u.cluster = up.father""",
    "s2nr_value": f"""WITH RECURSIVE {MOMENTS}, g AS (SELECT dim, sum(n * mean) / sum(n) AS grand FROM mom GROUP BY dim), c AS (SELECT count(*) AS c, sum(n) AS total FROM mom WHERE dim = 0)
        SELECT {r('(sum(power(mean - grand, 2)) / any_value(c - 1)) / (sum(n * var) / any_value(total - c))')} AS s2nr FROM mom JOIN g USING (dim), c""",
    "class_density": f"WITH {CLASSES} SELECT cell, class, {r('p * 1e6', 4)} AS p FROM classed",
    "class_conditional": f"WITH {CLASSES} SELECT cell, class, {r('p / sum(p) OVER (PARTITION BY class) * 1e6', 3)} AS p FROM classed",
    "hard_class_map": f"""WITH {CLASSES}, t AS (SELECT cell, sum(p) AS s, min(p) AS lo, max(p) AS hi, arg_max(class, (p, class)) AS best FROM classed GROUP BY cell), e AS (SELECT min(s) AS a, max(s) AS b FROM t)
        SELECT cell, CASE WHEN s > a + (b - a) / 16 AND lo < hi THEN best ELSE -1 END AS class FROM t, e""",
    "quantile_levels": levels("l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR", "l_extendedprice", "lineitem"),
    "quantile_levels_size": levels("p_partkey", "p_size", "part"),
    "quantile_levels_few": "WITH d AS (SELECT v, round_even(row_number() OVER (ORDER BY v) * 8 / (count(*) OVER ()), 0)::INT AS level FROM (SELECT DISTINCT l_linenumber AS v FROM lineitem)) SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS key, level FROM lineitem JOIN d ON v = l_linenumber",
    "quantile_levels_events": levels("event_id", "value", "events"),
    "box_stats": boxes("WITH", "customer", "c_mktsegment", "c_acctbal", "g AS grp"),
    "box_stats_clusters": boxes(f"WITH RECURSIVE {POINTS}, {LONG}, b AS (SELECT cluster, dim, v FROM long JOIN labels USING (id)),", "b", "(cluster, dim)", "v", "g[1] AS cluster, g[2] AS dim"),
    "knp_curve": f"WITH {KNP} SELECT k, {r('q')} AS q, {r('r')} AS r FROM curve",
    "knp_auc": f"WITH {KNP} SELECT {r('sum(r * dk) / max(k)')} AS lin_auc, {r('sum(r / log10(k)) / sum(1 / log10(k))')} AS log_auc FROM (SELECT k, r, k - lag(k, 1, 1) OVER (ORDER BY k) AS dk FROM curve)",
    "hl_correlation": f"WITH {RANKS} SELECT {r('avg(c)')} AS mean_r FROM (SELECT i, corr(a.sqdist, b.sqdist) AS c FROM dist a JOIN ydist b USING (i, j) GROUP BY i)",
    "full_pipeline": f"WITH RECURSIVE {POINTS} SELECT cluster, coalesce(n, 0)::BIGINT AS n, {r('z * 1e6', 4)} AS peak_z FROM ids JOIN raster ON raster.cell = peak LEFT JOIN (SELECT cluster, count(*) AS n FROM labels GROUP BY cluster) USING (cluster)",
}

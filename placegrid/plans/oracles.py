"""DuckDB SQL for the registered queries, written from the semantics and not from the plans."""

from __future__ import annotations

from placegrid.functions.numbers import NUMBER
from placegrid.plans import fixtures as X

_NUM = "CASE WHEN regexp_full_match(trim({0}), '" + NUMBER.strip("^$") + "') THEN TRY_CAST(trim({0}) AS DOUBLE) END"


def num(text: str) -> str:
    return _NUM.format(text)


def named(expression: str, source: str = "customer", key: str = "c_custkey", name: str = "name") -> str:
    return f"SELECT {key}, {expression.replace('{k}', key)} AS {name} FROM {source}"


_D2 = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_VECTORS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
qs AS (SELECT * FROM e WHERE vec_id % 10 = 0), ts AS (SELECT * FROM e WHERE vec_id % 10 <> 0)"""


def _top(k: int, queries: str = "qs", where: str = "true") -> str:
    return f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY d2, target) AS rank, target, d2
    FROM (SELECT a.vec_id AS query, b.vec_id AS target, {_D2} AS d2 FROM {queries} a, ts b WHERE {where}) QUALIFY rank <= {k}"""


_TRUTH = """truth AS (SELECT a.vec_id AS query, b.vec_id AS target FROM qs a JOIN ts b ON a.label = b.label),
s AS (SELECT n.query, max(CASE WHEN n.rank <= 1 AND t.target IS NOT NULL THEN 1 ELSE 0 END) AS success_at_1,
      max(CASE WHEN n.rank <= 5 AND t.target IS NOT NULL THEN 1 ELSE 0 END) AS success_at_5, max(CASE WHEN n.rank <= 10 AND t.target IS NOT NULL THEN 1 ELSE 0 END) AS success_at_10
      FROM near n LEFT JOIN truth t ON n.query = t.query AND n.target = t.target GROUP BY n.query)"""
_EVAL = f"WITH {_VECTORS}, near AS ({_top(10)}), {_TRUTH}"
_EXPANDED = f"""near5 AS ({_top(5)}),
xs AS (SELECT q.vec_id, i - 1 AS pos, 0.8::DOUBLE * q.v[i] + (1 - 0.8::DOUBLE) * avg(t.v[i]) AS x
       FROM near5 n JOIN qs q ON n.query = q.vec_id JOIN ts t ON n.target = t.vec_id, range(1, 65) r(i) GROUP BY q.vec_id, i, q.v[i])"""

_DASH = f"""WITH n AS ({named(X.DASH)}), f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^[^%]*%', ''), '@.*$', '') AS s FROM n),
p AS (SELECT *, CASE WHEN contains(s, '_') THEN split_part(s, '_', 1) END AS a, CASE WHEN contains(s, '_') THEN split_part(s, '_', 2) END AS b FROM f),
c AS (SELECT *, {num('a')} AS y, {num('b')} AS x FROM p)"""
_AT = f"WITH n AS ({named(X.AT)}), f AS (SELECT *, string_split(regexp_replace(name, '\\.[^.]*$', ''), '@') AS s FROM n)"

_PLACES = f"""q AS (SELECT s_suppkey AS query, {X.LAT.replace('{k}', 's_suppkey')} AS qlat, {X.LON.replace('{k}', 's_suppkey')} AS qlon FROM supplier),
t AS (SELECT c_custkey AS target, {X.LAT.replace('{k}', 'c_custkey')} AS lat, {X.LON.replace('{k}', 'c_custkey')} AS lon FROM customer)"""


def _metres(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2 * 6371000.0 * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))"


_WITHIN = f"SELECT query, target, d FROM (SELECT query, target, {_metres('qlat', 'qlon', 'lat', 'lon')} AS d FROM q, t WHERE abs(qlat - lat) < 0.01) WHERE d <= "



def _cleaned(source: str, p: str = "") -> str:
    """CTEs from a relation (event_id, t) to {p}c(event_id, clean)."""
    return f"""{p}u AS (SELECT event_id, trim(regexp_replace(replace(regexp_replace(trim(t), '```json', '', 'gi'), '```', ''), ',\\s*([}}\\]])', '\\1', 'g'), chr(10) || chr(9) || ' ') AS t FROM {source}),
{p}m AS (SELECT event_id, t, regexp_extract(t, '(?s)\\[.*\\]') AS l, regexp_extract(t, '(?s)\\{{.*\\}}') AS o FROM {p}u),
{p}c AS (SELECT event_id, CASE WHEN lower(t) = 'none' THEN 'None' WHEN l <> '' AND (o = '' OR instr(t, '[') < instr(t, '{{')) THEN l WHEN o <> '' THEN o ELSE t END AS clean FROM {p}m)"""


_CLEAN = f"r AS (SELECT event_id, {X.REPLY} AS t FROM events), {_cleaned('r')}"

_CELLS = "k(key) AS (SELECT chr(65 + r.i::INT) || (c.i + 1) FROM range(0, {n}) r(i), range(0, {n}) c(i))"
_GRID = f"g AS (SELECT event_id, {X.GRID} AS j FROM events)"
_CELL = "TRY_CAST(json_extract_string(j, '$.' || key) AS DOUBLE)"
_PATCHED = f"{_GRID}, {_CELLS.format(n=4)}, pg AS (SELECT event_id, key, CASE WHEN {_CELL} IS NULL THEN 1.0 ELSE least(greatest({_CELL}, 0), 2) END AS w FROM g, k)"


def _valid(n: int) -> str:
    return f"SELECT event_id, bool_and(coalesce({_CELL} BETWEEN 0 AND 2, false)) AS v FROM g, (WITH {_CELLS.format(n=n)} SELECT * FROM k) GROUP BY event_id"


_POINTS = f"""pt AS (SELECT event_id, {X.POINTS} AS j FROM events),
it AS (SELECT event_id, i::INT AS i, json_extract(j, '$[' || i || ']') AS p FROM pt, range(0, 2) r(i)),
co AS (SELECT event_id, i, json_array_length(p, '$.center') AS n, TRY_CAST(json_extract_string(p, '$.center[0]') AS DOUBLE) AS x, TRY_CAST(json_extract_string(p, '$.center[1]') AS DOUBLE) AS y,
       TRY_CAST(json_extract_string(p, '$.weight') AS DOUBLE) AS w, CASE WHEN json_type(p, '$.reasoning') = 'VARCHAR' THEN trim(json_extract_string(p, '$.reasoning')) END AS reasoning FROM it)"""
_POINT_OK = "coalesce(n = 2 AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w BETWEEN 0 AND 2 AND reasoning <> '', false)"
_PATCH_POINTS = f"""WITH {_POINTS}, ok AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY i) - 1 AS pos FROM co WHERE n = 2 AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND reasoning <> ''),
pp AS (SELECT event_id, pos::INT AS pos, least(greatest(x, 0), 1) AS x, least(greatest(y, 0), 1) AS y, least(greatest(w, 0), 2) AS w, reasoning FROM ok)"""

_PROCESSED = f"""WITH {_CLEAN}, {_POINTS}, pv AS (SELECT event_id, bool_and({_POINT_OK}) AS v FROM co GROUP BY event_id),
d AS (SELECT c.event_id, clean, clean = 'None' AS none, clean = 'None' OR left(clean, 1) = '[' AS f, clean = 'None' OR (left(clean, 1) = '[' AND v) AS k FROM c JOIN pv ON c.event_id = pv.event_id)"""
_JSON = "CASE WHEN json_valid({0}) THEN {0} END"
#: Annotation documents after repair: x the result's text, kind, flags f (NULL: left as it was), k and none, n items or keys.
_REPAIRED = f"""WITH doc AS (SELECT event_id, {_JSON.format('(' + X.DOCUMENT + ')')} AS t FROM events),
raw AS (SELECT event_id, json_type(t, '$.result') AS r, t IS NOT NULL AND coalesce(json_extract_string(t, '$.no_weighting') = 'true', false) AND coalesce(json_type(t, '$.result') = 'NULL', true) AS none,
        json_extract_string(t, '$.result') AS s, json_extract(t, '$.result')::VARCHAR AS j FROM doc),
src AS (SELECT event_id, s AS t FROM raw WHERE r = 'VARCHAR'), {_cleaned('src', 's')},
x AS (SELECT raw.event_id, none, {_JSON.format("(CASE WHEN r = 'VARCHAR' THEN clean WHEN r IN ('OBJECT', 'ARRAY') THEN j END)")} AS x FROM raw LEFT JOIN sc ON raw.event_id = sc.event_id),
y AS (SELECT event_id, none, x, json_type(x) AS kind FROM x),
it AS (SELECT event_id, json_extract(x, '$[' || i || ']') AS p FROM y, range(0, 4) r(i) WHERE kind = 'ARRAY' AND i < json_array_length(x)),
co AS (SELECT event_id, json_array_length(p, '$.center') AS n, TRY_CAST(json_extract_string(p, '$.center[0]') AS DOUBLE) AS x, TRY_CAST(json_extract_string(p, '$.center[1]') AS DOUBLE) AS y,
       TRY_CAST(json_extract_string(p, '$.weight') AS DOUBLE) AS w, CASE WHEN json_type(p, '$.reasoning') = 'VARCHAR' THEN trim(json_extract_string(p, '$.reasoning')) END AS reasoning FROM it),
pv AS (SELECT event_id, bool_and({_POINT_OK}) AS v, count(*) AS items, count(*) FILTER (n = 2 AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND reasoning <> '') AS fit FROM co GROUP BY event_id),
d AS (SELECT y.event_id, none, CASE WHEN none OR kind IN ('OBJECT', 'ARRAY') THEN true END AS f,
      CASE WHEN none OR kind = 'OBJECT' THEN true WHEN kind = 'ARRAY' THEN coalesce(v, false) OR coalesce(fit, 0) > 0 END AS k,
      CASE WHEN kind = 'OBJECT' THEN 16 + (json_type(x, '$.note') IS NOT NULL)::INT WHEN kind = 'ARRAY' THEN coalesce(CASE WHEN v THEN items ELSE fit END, 0) END::INT AS n
      FROM y LEFT JOIN pv ON y.event_id = pv.event_id)"""
_GRIDS = f"""gr AS (SELECT event_id, {X.GRID} AS j FROM events),
gt AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Sure: ' || j WHEN 1 THEN j ELSE ' NONE' END AS t, j FROM gr)"""

_FEATURES = """cells AS (SELECT vec_id, ((i - 1) // 16)::INT AS c, (((i - 1) % 16) // 4)::INT AS y, ((i - 1) % 4)::INT AS x, pow(greatest(embedding[i]::DOUBLE, 1e-6::DOUBLE), 3) AS p FROM embeddings, range(1, 65) r(i)),
att AS (SELECT *, least(((vec_id * 7 + y * 4 + x) % 25)::DOUBLE / 10, 2.0::DOUBLE) AS a FROM cells),
co AS (SELECT vec_id, y, x, pow(greatest(sum(p) / (16 + 1e-6::DOUBLE), 1e-6::DOUBLE), 1::DOUBLE / 3) AS k FROM cells GROUP BY vec_id, y, x),
me AS (SELECT vec_id, avg(k) AS m FROM co GROUP BY vec_id),
ex AS (SELECT att.*, co.k / (me.m + 1e-6::DOUBLE) AS e FROM att JOIN co ON att.vec_id = co.vec_id AND att.y = co.y AND att.x = co.x JOIN me ON att.vec_id = me.vec_id)"""
_WEIGHTED = "pow(sum((e + alpha * (a - e)) * p) / (sum(e + alpha * (a - e)) + 1e-6::DOUBLE), 1::DOUBLE / 3)"

_RASTER = "px(y, x) AS (SELECT a.i::INT, b.i::INT FROM range(0, 6) a(i), range(0, 10) b(i))"

_EXPAND = f"""mk AS (SELECT conv_id, turn, role, conv_id % 4 AS extra FROM conversations),
xp AS (SELECT conv_id, turn, 'Compare {{IMAGE_0}} with ' || array_to_string(list_transform(range(turn, turn + extra + 1), lambda i: '{{IMAGE_' || i || '}}'), ' ') || ' and ' || role AS expanded, role, extra FROM mk)"""
_WORDS = "len(list_filter(regexp_split_to_array(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"

ORACLES = {
    "knn_topk_l2": f"WITH {_VECTORS} SELECT query, rank::INT AS rank, target, round(d2, 6) AS d2, round(-d2, 6) AS score FROM ({_top(10)})",
    "knn_chunked_merge": f"WITH {_VECTORS} SELECT query, rank::INT AS rank, target, round(d2, 6) AS d2 FROM ({_top(10)})",
    "knn_candidate_rerank": f"WITH {_VECTORS} SELECT query, rank::INT AS rank, target, round(d2, 6) AS d2 FROM ({_top(5, where='a.label = b.label')})",
    "aqe_expand": f"WITH {_VECTORS}, {_EXPANDED} SELECT vec_id AS query, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM xs",
    "aqe_knn": f"WITH {_VECTORS}, {_EXPANDED}, nq AS (SELECT vec_id, list(x ORDER BY pos) AS v FROM xs GROUP BY vec_id) SELECT query, rank::INT AS rank, target, round(d2, 6) AS d2 FROM ({_top(10, 'nq')})",
    "l2_normalize": "SELECT vec_id, (i - 1)::INT AS pos, round(embedding[i]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 6) + 0.0 AS x FROM embeddings, range(1, 65) r(i)",
    "success_at_k": f"{_EVAL} SELECT * FROM s",
    "success_rate": f"{_EVAL} SELECT count(*) AS queries, round(avg(success_at_1), 6) AS rate_at_1, round(avg(success_at_5), 6) AS rate_at_5, round(avg(success_at_10), 6) AS rate_at_10 FROM s",
    "metrics_long": f"{_EVAL}, r AS (SELECT count(*) AS n, avg(success_at_1) AS a, avg(success_at_5) AS b, avg(success_at_10) AS c FROM s) SELECT metric, round(value, 6) AS value FROM (SELECT 'total_queries' AS metric, n::DOUBLE AS value FROM r UNION ALL SELECT 'success_rate_at_1', a FROM r UNION ALL SELECT 'success_percent_at_1', round(a * 100, 2) FROM r UNION ALL SELECT 'success_rate_at_5', b FROM r UNION ALL SELECT 'success_percent_at_5', round(b * 100, 2) FROM r UNION ALL SELECT 'success_rate_at_10', c FROM r UNION ALL SELECT 'success_percent_at_10', round(c * 100, 2) FROM r)",
    "individual_results": f"{_EVAL}, p AS (SELECT query, count(*)::INT AS num_predicted, string_agg(target::VARCHAR, ';' ORDER BY rank) AS predicted FROM near GROUP BY query), g AS (SELECT query, count(*)::INT AS num_gt, string_agg(target::VARCHAR, ';' ORDER BY target) AS gt FROM truth GROUP BY query) SELECT s.query, num_predicted, coalesce(num_gt, 0)::INT AS num_gt, predicted, coalesce(gt, '') AS gt, success_at_1, success_at_5, success_at_10 FROM s JOIN p ON s.query = p.query LEFT JOIN g ON s.query = g.query",
    "retrieval_sink": f"WITH {_VECTORS} SELECT query, rank::INT AS rank, target, round(round(-d2, 10), 6) AS score FROM ({_top(10)})",
    "parse_dash": f"{_DASH} SELECT c_custkey, CASE WHEN y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 THEN y END AS lat, CASE WHEN y BETWEEN -90 AND 90 AND x BETWEEN -180 AND 180 THEN x END AS lon FROM c",
    "parse_at": f"{_AT}, p AS (SELECT c_custkey, CASE WHEN len(s) > 7 THEN s[6] ELSE s[5] END AS a, CASE WHEN len(s) > 7 THEN s[7] ELSE s[6] END AS b FROM f), c AS (SELECT c_custkey, {num('a')} AS y, {num('b')} AS x FROM p) SELECT c_custkey, CASE WHEN x IS NOT NULL THEN y END AS lat, CASE WHEN y IS NOT NULL THEN x END AS lon FROM c",
    "utm_dash": f"WITH n AS ({named(X.DASH)}), f AS (SELECT *, string_split(regexp_replace(name, '\\.[^.]*$', ''), '@') AS s FROM n), c AS (SELECT c_custkey, {num('s[5]')} AS e, {num('s[6]')} AS o FROM f) SELECT c_custkey, CASE WHEN o IS NOT NULL THEN e END AS east, CASE WHEN e IS NOT NULL THEN o END AS north FROM c",
    "utm_at": f"{_AT}, c AS (SELECT c_custkey, {num('s[2]')} AS e, {num('s[3]')} AS o FROM f) SELECT c_custkey, CASE WHEN o IS NOT NULL THEN e END AS east, CASE WHEN e IS NOT NULL THEN o END AS north FROM c",
    "place_id": f"WITH d AS ({named(X.DASH)}), a AS ({named(X.AT, name='aname')}) SELECT d.c_custkey, CASE WHEN contains(name, '%') THEN split_part(name, '%', 1) ELSE split_part(name, '@', 1) END AS dash_id, CASE WHEN len(string_split(aname, '@')) >= 7 THEN array_to_string(string_split(aname, '@')[2:7], '@') ELSE aname END AS at_id FROM d JOIN a ON d.c_custkey = a.c_custkey",
    "suffix_filters": f"WITH n AS ({named(X.AT)}), e AS (SELECT *, lower(regexp_extract(name, '[^.]*$')) AS s FROM n) SELECT c_custkey, (s IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'gif'))::INT AS annotation, (s IN ('jpg', 'jpeg', 'png'))::INT AS query, (s IN ('json', 'jpg', 'jpeg', 'png'))::INT AS truth, (s IN ('jpg', 'jpeg', 'png', 'bmp', 'tiff', 'tif'))::INT AS resize, regexp_replace(name, '\\.[^.]*$', '') || '.json' AS annotation_name FROM e",
    "haversine_pairs": f"WITH {_PLACES} SELECT query, round({_metres('qlat', 'qlon', '(lat + 0.01::DOUBLE)', 'lon')}, 6) AS metres FROM q JOIN t ON query = target",
    "radius_gt": f"WITH {_PLACES} SELECT query, target, round(d, 3) AS distance_m FROM ({_WITHIN} 100)",
    "radius_gt_counts": f"WITH {_PLACES}, w AS ({_WITHIN} 100) SELECT q.query, count(w.target) AS targets FROM q LEFT JOIN w ON q.query = w.query GROUP BY q.query",
    "geo_success": f"WITH {_PLACES}, w AS ({_WITHIN} 100), near AS (SELECT query, target, row_number() OVER (PARTITION BY query ORDER BY target * 31 % 101, target) AS rank FROM ({_WITHIN} 300) QUALIFY rank <= 10) SELECT n.query, max(CASE WHEN rank <= 1 AND w.target IS NOT NULL THEN 1 ELSE 0 END) AS success_at_1, max(CASE WHEN rank <= 5 AND w.target IS NOT NULL THEN 1 ELSE 0 END) AS success_at_5, max(CASE WHEN rank <= 10 AND w.target IS NOT NULL THEN 1 ELSE 0 END) AS success_at_10 FROM near n LEFT JOIN w ON n.query = w.query AND n.target = w.target GROUP BY n.query",
    "clean_response": f"WITH {_CLEAN} SELECT event_id, clean FROM c",
    "verify_grid": f"WITH {_GRID}, a AS ({_valid(4)}), b AS ({_valid(3)}) SELECT a.event_id, a.v AS valid4, b.v AS valid3 FROM a JOIN b ON a.event_id = b.event_id",
    "patch_grid": f"WITH {_PATCHED} SELECT event_id, key AS cell, round(w, 6) AS w, NULL::VARCHAR AS other FROM pg UNION ALL SELECT event_id, 'note', NULL, json_extract_string(j, '$.note') FROM g WHERE json_type(j, '$.note') IS NOT NULL",
    "verify_points": f"WITH {_POINTS} SELECT event_id, bool_and({_POINT_OK}) AS valid FROM co GROUP BY event_id",
    "patch_points": f"{_PATCH_POINTS} SELECT event_id, pos, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, reasoning FROM pp",
    "process_replies": f"""{_PROCESSED}, {_GRIDS}, {_cleaned('gt', 'g')}, {_CELLS.format(n=4)},
gv AS (SELECT event_id, bool_and(coalesce(TRY_CAST(json_extract_string(j, '$.' || key) AS DOUBLE) BETWEEN 0 AND 2, false)) AS v FROM gt, k GROUP BY event_id)
SELECT d.event_id, CASE WHEN NOT d.none THEN d.clean END AS result, d.f AS p_format_verified, d.k AS p_content_verified, d.none AS p_no_weighting,
       gc.clean = 'None' OR left(gc.clean, 1) = '{{' AS g_format_verified, gc.clean = 'None' OR (left(gc.clean, 1) = '{{' AND v) AS g_content_verified, gc.clean = 'None' AS g_no_weighting
FROM d JOIN gc ON d.event_id = gc.event_id JOIN gv ON d.event_id = gv.event_id""",
    "save_response": f"{_PROCESSED} SELECT d.event_id, CASE WHEN none THEN NULL WHEN f AND k THEN clean ELSE t END AS result, f AS format_verified, k AS content_verified, none AS no_weighting FROM d JOIN r ON d.event_id = r.event_id",
    "repair_documents": f"{_REPAIRED} SELECT event_id, f AS format_verified, k AS content_verified, none AS no_weighting, n FROM d",
    "batch_clean_report": f"{_REPAIRED} SELECT count(*) AS total, count(*) FILTER (f IS NULL) AS format_false, count(*) FILTER (NOT k) AS content_false, count(*) FILTER (none) AS no_weighting FROM d",
    "failed_docs": f"{_REPAIRED} SELECT event_id FROM d WHERE NOT (coalesce(f, false) AND coalesce(k, false))",
    "remove_failed": f"{_REPAIRED} SELECT event_id, none AS no_weighting FROM d WHERE f AND k",
    "top100_process": f"""WITH r AS (SELECT event_id, {X.MATCHES} AS t FROM events), {_cleaned('r')}, j AS (SELECT r.event_id, t, clean, {_JSON.format('clean')} AS j FROM c JOIN r ON c.event_id = r.event_id),
{{matches}} SELECT event_id, CASE WHEN j IS NOT NULL THEN clean END AS cleaned, coalesce(json_type(j) = 'OBJECT', false) AS format_verified, valid AS content_verified, CASE WHEN j IS NULL THEN t END AS original FROM v""",
    "top100_verify": f"WITH r AS (SELECT event_id, {X.MATCHES} AS t FROM events), {_cleaned('r')}, j AS (SELECT event_id, clean, '' AS t, {_JSON.format('clean')} AS j FROM c), {{matches}} SELECT event_id, valid, valid AND json_type(j, '$.top_100') IS NOT NULL AS strict FROM v",
    "grid_map_sharp": f"WITH {_PATCHED}, {_RASTER}, g2 AS (SELECT event_id, y, x, (CASE WHEN y >= 4 THEN 3 WHEN y >= 3 THEN 2 WHEN y >= 2 THEN 1 ELSE 0 END)::INT AS r, (CASE WHEN x >= 8 THEN 3 WHEN x >= 5 THEN 2 WHEN x >= 2 THEN 1 ELSE 0 END)::INT AS c FROM g, px WHERE json_type(j, '$.note') IS NULL) SELECT g2.event_id, y, x, round(w, 6) AS w FROM g2 JOIN pg ON pg.event_id = g2.event_id AND pg.key = chr(65 + r) || (c + 1)",
    "grid_map_bilinear": f"""WITH {_PATCHED}, {_RASTER}, s AS (SELECT event_id, y, x, greatest((y + 0.5::DOUBLE) * (4::DOUBLE / 6) - 0.5::DOUBLE, 0) AS sy, greatest((x + 0.5::DOUBLE) * (4::DOUBLE / 10) - 0.5::DOUBLE, 0) AS sx FROM g, px WHERE json_type(j, '$.note') IS NULL),
taps AS (SELECT event_id, y, x, least(floor(sy)::INT + dy.i, 3) AS r, least(floor(sx)::INT + dx.i, 3) AS c, (CASE WHEN dy.i = 1 THEN sy - least(floor(sy), 3) ELSE 1 - (sy - least(floor(sy), 3)) END) * (CASE WHEN dx.i = 1 THEN sx - least(floor(sx), 3) ELSE 1 - (sx - least(floor(sx), 3)) END) AS f FROM s, range(0, 2) dy(i), range(0, 2) dx(i))
SELECT t.event_id, y, x, round(sum(f * w), 6) AS w FROM taps t JOIN pg ON pg.event_id = t.event_id AND pg.key = chr(65 + r::INT) || (c + 1) GROUP BY t.event_id, y, x""",
    "point_map_rbf": f"""WITH {_POINTS}, pp AS (SELECT event_id, least(greatest(x, 0), 1) AS x, least(greatest(y, 0), 1) AS y, least(greatest(w, 0), 2) AS w FROM co WHERE n = 2 AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL), {{softmax}}
SELECT e.event_id, e.y, e.x, round(coalesce(v.w, 1.0), 6) AS w FROM (SELECT event_id, a.i::INT AS y, b.i::INT AS x FROM events, range(0, 4) a(i), range(0, 4) b(i)) e LEFT JOIN v ON e.event_id = v.event_id AND e.y = v.y AND e.x = v.x""",
    "attention_resize": """WITH c AS (SELECT event_id, r.i AS r, c.i AS c, ((event_id * 7 + (r.i * 3 + c.i) * 3) % 21)::DOUBLE / 10 AS w FROM events, range(0, 2) r(i), range(0, 3) c(i)),
s AS (SELECT event_id, y.i::INT AS y, x.i::INT AS x, greatest((y.i + 0.5::DOUBLE) * (2::DOUBLE / 4) - 0.5::DOUBLE, 0) AS sy, greatest((x.i + 0.5::DOUBLE) * (3::DOUBLE / 5) - 0.5::DOUBLE, 0) AS sx FROM events, range(0, 4) y(i), range(0, 5) x(i)),
taps AS (SELECT event_id, y, x, least(floor(sy)::INT + dy.i, 1) AS r, least(floor(sx)::INT + dx.i, 2) AS c, (CASE WHEN dy.i = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx.i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS f FROM s, range(0, 2) dy(i), range(0, 2) dx(i))
SELECT t.event_id, y, x, round(sum(f * w), 6) + 0.0 AS w FROM taps t JOIN c ON c.event_id = t.event_id AND c.r = t.r AND c.c = t.c GROUP BY t.event_id, y, x""",
    "attention_dispatch": f"""WITH doc AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 3 <> 2 THEN {_JSON.format('(' + X.DOCUMENT + ')')} END AS t FROM events),
d AS (SELECT event_id, CASE WHEN json_type(t, '$.result') IS NOT NULL THEN json_extract(t, '$.result') ELSE t::JSON END AS d FROM doc),
k AS (SELECT event_id, d, json_type(d) AS kind, len(json_keys(d)) AS cells FROM d),
it AS (SELECT event_id, json_extract(d, '$[' || i || ']') AS p FROM k, range(0, 4) r(i) WHERE kind = 'ARRAY'),
pp AS (SELECT event_id, least(greatest(x, 0), 1) AS x, least(greatest(y, 0), 1) AS y, least(greatest(w, 0), 2) AS w FROM (SELECT event_id, json_array_length(p, '$.center') AS n, TRY_CAST(json_extract_string(p, '$.center[0]') AS DOUBLE) AS x,
       TRY_CAST(json_extract_string(p, '$.center[1]') AS DOUBLE) AS y, TRY_CAST(json_extract_string(p, '$.weight') AS DOUBLE) AS w FROM it) WHERE n = 2 AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL), {{softmax}},
pm AS (SELECT event_id, avg(w) AS m FROM v GROUP BY event_id),
keys(key) AS (SELECT chr(65 + r.i::INT) || (c.i + 1) FROM range(0, 4) r(i), range(0, 4) c(i)),
gm AS (SELECT event_id, avg(CASE WHEN TRY_CAST(json_extract_string(d, '$.' || key) AS DOUBLE) IS NULL THEN 1.0 ELSE least(greatest(TRY_CAST(json_extract_string(d, '$.' || key) AS DOUBLE), 0), 2) END) AS m FROM k, keys WHERE kind = 'OBJECT' AND cells = 16 GROUP BY event_id)
SELECT k.event_id, CASE WHEN kind = 'ARRAY' THEN 'points' WHEN kind = 'OBJECT' AND cells IN (1, 4, 9, 16, 25) THEN 'grid' WHEN kind = 'OBJECT' THEN 'fallback' ELSE 'plain' END AS attention_status,
       round(CASE WHEN kind = 'ARRAY' THEN coalesce(pm.m, 1.0) WHEN kind = 'OBJECT' THEN gm.m END, 6) AS mean FROM k LEFT JOIN pm ON k.event_id = pm.event_id LEFT JOIN gm ON k.event_id = gm.event_id""",
    "linear_projection": "SELECT vec_id, o.i::INT AS pos, round(sum(((o.i * 7 + i.i * 3) % 11 - 5)::DOUBLE / 10 * embedding[i.i + 1]::DOUBLE) + o.i::DOUBLE / 4, 5) AS x FROM embeddings, range(0, 8) o(i), range(0, 64) i(i) GROUP BY vec_id, o.i",
    "feature_dimensions": "SELECT vec_id, (CASE vec_id % 4 WHEN 0 THEN 512 WHEN 1 THEN 512 ELSE 2048 END)::INT AS cosplace, (CASE vec_id % 4 WHEN 0 THEN 512 WHEN 1 THEN 512 ELSE 2048 END)::INT AS eigenplaces, (CASE vec_id % 4 WHEN 0 THEN 512 WHEN 1 THEN 512 WHEN 2 THEN 1536 ELSE 2048 END)::INT AS attention, (CASE WHEN vec_id % 4 < 2 THEN 512 ELSE len(embedding) END)::INT AS dimension FROM embeddings",
    "input_normalise": "SELECT vec_id, c.i::INT AS channel, p.i::INT AS pos, round((embedding[p.i + 1]::DOUBLE - (CASE c.i WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END)::DOUBLE) / (CASE c.i WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END)::DOUBLE, 6) + 0.0 AS x FROM embeddings, range(0, 3) c(i), range(0, 8) p(i)",
    "image_sizes": """WITH i AS (SELECT p_partkey, (p_partkey * 37 % 3000 + 1)::DOUBLE AS w, (p_partkey * 91 % 2200 + 1)::DOUBLE AS h FROM part), s AS (SELECT *, 1024 / greatest(w, h) AS s, w / h AS a FROM i),
f AS (SELECT *, floor(512 / a) AS fl, ceil(512 / a) AS fc, floor(512 * a) AS tl, ceil(512 * a) AS tc FROM s)
SELECT p_partkey, (CASE WHEN s < 1 THEN floor(w * s) ELSE w END)::INT AS resize_width, (CASE WHEN s < 1 THEN floor(h * s) ELSE h END)::INT AS resize_height,
       round_even(w * least(s, 1), 0)::INT AS ruler_width, round_even(h * least(s, 1), 0)::INT AS ruler_height,
       (CASE WHEN w <= 512 AND h <= 512 THEN w WHEN w >= h THEN 512 ELSE greatest(CASE WHEN abs(a - tl / 512) <= abs(a - tc / 512) THEN tl ELSE tc END, 1) END)::INT AS thumb_width,
       (CASE WHEN w <= 512 AND h <= 512 THEN h WHEN w >= h THEN greatest(CASE WHEN fl > 0 AND abs(a - 512 / fl) <= abs(a - 512 / fc) THEN fl ELSE fc END, 1) ELSE 512 END)::INT AS thumb_height,
       (CASE WHEN p_partkey % 2 = 1 THEN 640 WHEN w <= h THEN 512 ELSE floor(512 * w / h) END)::INT AS input_width, (CASE WHEN p_partkey % 2 = 1 THEN 480 WHEN w <= h THEN floor(512 * h / w) ELSE 512 END)::INT AS input_height FROM f""",
    "ruler_ticks": "WITH g AS (SELECT p_partkey, p_partkey % 7 AS g, CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE p_partkey % 7 END AS n FROM part) SELECT p_partkey, g > 0 AS lines, i::INT AS i, round(i::DOUBLE / n, 6) AS tick FROM g, range(0, 8) r(i) WHERE i <= n",
    "gem_standard": f"WITH {_FEATURES} SELECT vec_id, c, round(pow(avg(p), 1::DOUBLE / 3), 6) AS g FROM cells GROUP BY vec_id, c",
    "gem_weighted": f"WITH {_FEATURES}, z AS (SELECT *, 0.5::DOUBLE AS alpha FROM ex) SELECT vec_id, c, round({_WEIGHTED}, 6) AS g FROM z GROUP BY vec_id, c",
    "alpha_sweep": f"WITH {_FEATURES}, z AS (SELECT ex.*, alpha FROM ex, (VALUES (0::DOUBLE), (0.5::DOUBLE), (1::DOUBLE)) v(alpha)), r AS (SELECT alpha, vec_id, c, CASE WHEN alpha = 0 THEN pow(avg(p), 1::DOUBLE / 3) ELSE {_WEIGHTED} END AS g FROM z GROUP BY alpha, vec_id, c) SELECT alpha, round(avg(g), 6) AS mean, count(*) AS n FROM r GROUP BY alpha",
    "resume_pending": "SELECT o_orderkey AS item FROM orders WHERE o_orderstatus <> 'F'",
    "retry_pending": "WITH l AS (SELECT l_orderkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_returnflag = 'R' DESC) = 1) SELECT o_orderkey AS item FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l WHERE l_returnflag <> 'R')",
    "prefix_done": "WITH o AS (SELECT 'img_' || (s_suppkey * 10) || '_generated_1.png' AS name FROM supplier), i AS (SELECT 'img_' || c_custkey || '.jpg' AS item FROM customer) SELECT item FROM i WHERE EXISTS (SELECT 1 FROM o WHERE regexp_full_match(name, regexp_extract(item, '^(.*)[.]', 1) || '_generated_[0-9]+[.][^.]*'))",
    "shard_completeness": "WITH e AS (SELECT DISTINCT event_id // 10 AS shard FROM events), f AS (SELECT event_id // 10 AS shard, count(*) FILTER (event_id % 11 <> 3) AS n FROM events WHERE event_id % 7 <> 0 GROUP BY 1) SELECT count(*) AS expected, count(*) FILTER (n > 0) AS found, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n = 0) AS corrupt, round(count(*) FILTER (n > 0) / count(*), 6) AS rate FROM e LEFT JOIN (SELECT * FROM f WHERE shard % 9 <> 4) f ON e.shard = f.shard",
    "upsert_latest": "SELECT user_id AS item, event_id AS attempt, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "batch_assign": "SELECT doc_id, lpad(((row_number() OVER (ORDER BY doc_id) - 1) // 32)::VARCHAR, 6, '0') AS batch FROM documents",
    "progress_summary": "SELECT count(*) AS total_items, count(*) FILTER (o_orderstatus = 'F') AS processed_items, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS success_rate FROM orders",
    "eta_duration": "SELECT p_partkey, CASE WHEN s < 60 THEN printf('%.1fs', round(s, 1)) WHEN s < 3600 THEN printf('%.1fm', round(s / 60, 1)) ELSE printf('%.1fh', round(s / 3600, 1)) END AS eta FROM (SELECT p_partkey, (p_partkey * 13)::DOUBLE AS s FROM part)",
    "usage_rollup": f"WITH w AS (SELECT role, {_WORDS}::BIGINT AS n FROM conversations) SELECT role, sum(CASE WHEN role IN ('user', 'system') THEN n ELSE 0 END)::BIGINT AS prompt_tokens, sum(CASE WHEN role IN ('user', 'system') THEN 0 ELSE n END)::BIGINT AS completion_tokens, 0::BIGINT AS thinking_tokens, sum(n)::BIGINT AS total_tokens, count(*) AS api_calls FROM w GROUP BY role",
    "token_estimate": f"SELECT conv_id, turn, ({_WORDS} + 1500 * (turn % 3))::BIGINT AS tokens FROM conversations",
    "marker_expand": f"WITH {_EXPAND} SELECT conv_id, turn, expanded FROM xp",
    "marker_parts": f"""WITH {_EXPAND}, a AS (SELECT conv_id, turn, regexp_split_to_array(expanded, '\\{{IMAGE_[0-9]+\\}}') AS t, regexp_extract_all(expanded, '\\{{IMAGE_([0-9]+)\\}}', 1) AS m FROM xp),
b AS (SELECT conv_id, turn, 2 * i AS o, 'text' AS kind, trim(t[i]) AS value FROM a, range(1, 20) r(i) WHERE i <= len(t) UNION ALL SELECT conv_id, turn, 2 * i + 1, 'image', m[i] FROM a, range(1, 20) r(i) WHERE i <= len(m))
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) - 1)::INT AS pos, kind, value FROM b WHERE CASE WHEN kind = 'image' THEN value::INT < 3 ELSE value <> '' END""",
    "prompt_search": "SELECT * FROM (SELECT 'c' || (item_id % 3) AS category, 'Prompt_' || item_id AS name, text FROM benchmark) WHERE contains(lower(text), 'prompt_1') OR contains(lower(name), 'prompt_1')",
    "prompt_categories": "SELECT DISTINCT 'c' || (item_id % 3) AS category FROM benchmark",
    "prompt_listing": "SELECT 'Prompt_' || item_id AS name, text FROM benchmark WHERE item_id % 3 = 1",
    "prompt_upsert": "WITH p AS (SELECT 'c' || (item_id % 3) AS category, 'Prompt_' || item_id AS name, text FROM benchmark) SELECT category, name, CASE WHEN name LIKE '%1' THEN 'new ' || name ELSE text END AS text FROM p UNION ALL SELECT 'c9', name, 'new ' || name FROM p WHERE name LIKE '%1'",
    "prompt_filled": "SELECT n_nationkey, 'Find ' || n_name || ' in ' || n_regionkey || '; keep {braces}.' AS prompt FROM nation",
    "first_candidate": "SELECT 'i' || c_custkey || '.json' AS annotation, CASE WHEN c_custkey % 3 = 0 THEN 'i' || c_custkey || '.jpg' WHEN c_custkey % 2 = 0 THEN 'i' || c_custkey || '.png' WHEN c_custkey % 5 <> 0 THEN 'i' || c_custkey || '.jpeg' END AS image FROM customer",
    "distance_matrix": f"WITH {_PLACES} SELECT query, target, round({_metres('qlat', 'qlon', 'lat', 'lon')}, 3) AS distance_m FROM q, t WHERE query % 50 = 0",
    "available_ks": f"{_EVAL} SELECT count(*) AS queries, '1,5,10' AS ks FROM s",
    "failure_split": f"{_EVAL} SELECT query, CASE WHEN success_at_10 = 1 THEN 'success' ELSE 'failure' END AS outcome FROM s",
    "result_hits": f"{_EVAL} SELECT n.query, n.rank::INT AS rank, n.target, t.target IS NOT NULL AS hit FROM near n LEFT JOIN truth t ON n.query = t.query AND n.target = t.target",
    "outputs_synced": "SELECT 'o' || o_orderkey || '.jpg' AS item FROM orders WHERE o_orderstatus = 'F'",
    "result_keys": "SELECT 'o' || o_orderkey || '.jpg' AS item FROM orders WHERE o_orderkey % 3 = 0",
    "rerank_tasks": f"WITH {_VECTORS}, near AS ({_top(5)}) SELECT 'v' || query || '.jpg' AS item, string_agg('/db/v' || target || '.jpg', ';' ORDER BY rank) AS candidates FROM near WHERE query % 100 <> 50 GROUP BY query",
    "status_counts": "SELECT count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders",
    "size_plan": "WITH s AS (SELECT count(DISTINCT event_id // 10) AS shards, count(*) * 9000000 / 1073741824::DOUBLE AS gib FROM events) SELECT shards, round(gib, 6) AS gib, CASE WHEN gib > 6 THEN 'chunked' ELSE 'single' END AS strategy, (CASE WHEN gib > 6 THEN greatest(1, floor(gib / 5)) ELSE 1 END)::BIGINT AS chunks, greatest(1, floor(shards / (CASE WHEN gib > 6 THEN greatest(1, floor(gib / 5)) ELSE 1 END)))::BIGINT AS shards_per_chunk FROM s",
    "chunk_ranges": "WITH s AS (SELECT DISTINCT event_id // 10 AS shard FROM events), p AS (SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS i, greatest(1, count(*) OVER () // 7) AS per FROM s) SELECT least(i // per, 6)::BIGINT AS chunk, min(shard) AS first, max(shard) AS last, count(*) AS n FROM p GROUP BY 1",
    "missing_shards": "WITH s AS (SELECT event_id // 10 AS shard, count(*) FILTER (event_id % 10 < event_id % 13) AS rows FROM events GROUP BY 1) SELECT shard, CASE WHEN shard % 9 = 4 THEN 'missing' ELSE 'corrupt' END AS reason FROM s WHERE shard % 9 = 4 OR shard % 5 = 2 OR rows = 0",
    "feature_cache": "SELECT '/db/' || c_custkey || '.jpg' AS path FROM customer WHERE c_custkey % 4 = 1",
    "feature_count_check": "SELECT count(*) AS expected, count(*) FILTER (label <> 3) AS found, count(*) FILTER (label = 3) = 0 AS complete FROM embeddings",
    "checkpoint_summary": "WITH l AS (SELECT l_orderkey AS item, l_linenumber::BIGINT * 1000000000 + l_partkey AS attempt, l_returnflag = 'R' AS bad FROM lineitem), n AS (SELECT item, bad FROM l QUALIFY row_number() OVER (PARTITION BY item ORDER BY attempt DESC) = 1) SELECT (SELECT count(*) FROM l) AS attempts, (SELECT max(attempt) FROM l) AS last_attempt, count(*) AS items, count(*) FILTER (NOT bad) AS processed, count(*) FILTER (bad) AS failed FROM n",
    "path_order": "SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS position FROM supplier",
    "message_parts_converted": """WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'inline_data' WHEN role = 'user' AND turn % 3 = 1 THEN 'file_data' END AS image FROM conversations WHERE role IN ('user', 'assistant')),
r AS (SELECT conv_id, pos::INT AS pos, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, image, text, turn FROM m)
SELECT conv_id, pos, role, 0 AS part, image AS kind, CASE image WHEN 'inline_data' THEN to_hex(conv_id) ELSE 'https://x/' || conv_id END AS value FROM r WHERE image IS NOT NULL
UNION ALL SELECT conv_id, pos, role, (image IS NOT NULL)::INT, 'text', text FROM r""",
    "chat_fold": "SELECT conv_id AS conversation, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1) || ':' || length(text) AS reply FROM conversations WHERE role = 'user'",
    "chat_with_history": "SELECT conv_id AS conversation, turn, (2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ':' || length(text) AS reply FROM conversations WHERE role = 'user'",
    "image_analysis": "SELECT s_suppkey::VARCHAR AS item, '2:8' AS response FROM supplier",
    "generated_images": "SELECT 's' || s_suppkey AS item, i::INT AS index, 's' || s_suppkey || '_generated_' || i || '.png' AS name, CASE WHEN i % 2 = 1 THEN 's' || s_suppkey || '_' || i || '.jpg' END AS kept FROM supplier, range(0, 4) r(i)",
    "history_round_trip": "SELECT conv_id AS conversation, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, text AS content FROM conversations",
    "usage_report": f"""WITH w AS (SELECT role, {_WORDS}::BIGINT AS n FROM conversations), u AS (SELECT sum(CASE WHEN role IN ('user', 'system') THEN n ELSE 0 END)::BIGINT AS p, sum(CASE WHEN role IN ('user', 'system') THEN 0 ELSE n END)::BIGINT AS c, sum(n)::BIGINT AS t, count(*) AS a FROM w)
SELECT unnest(['prompt_tokens: ' || p, 'completion_tokens: ' || c, 'thinking_tokens: 0', 'total_tokens: ' || t, 'api_calls: ' || a]) AS line FROM u""",
    "rate_spacing": "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events) SELECT user_id, count(*) AS calls, count(*) FILTER (gap < 3000000) AS early FROM g GROUP BY user_id",
    "rate_paced": "WITH n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) SELECT user_id, ts, make_timestamp(max(epoch_us(ts) - n * 60000000) OVER (PARTITION BY user_id ORDER BY n) + n * 60000000) AS start FROM n",
    "conversation_fold": "SELECT conv_id, count(*) AS turns, string_agg(CASE role WHEN 'assistant' THEN 'model' ELSE role END, ',' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations WHERE role <> 'system' GROUP BY conv_id",
    "rate_audit": "SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, count(*) AS calls, count(*) > 2 AS over FROM events GROUP BY 1",
    "streaming_equals_batch": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type",
}


#: From j (event_id, t, clean, j): whether an answer's matches are null or a list whose items have image_number and confidence.
_MATCHES = """mi AS (SELECT event_id, json_extract(j, '$.matches[' || i || ']') AS m FROM j, range(0, 10) r(i) WHERE json_type(j, '$.matches') = 'ARRAY' AND i < json_array_length(j, '$.matches')),
mv AS (SELECT event_id, bool_and(json_type(m, '$.image_number') IS NOT NULL AND json_type(m, '$.confidence') IS NOT NULL) AS good FROM mi GROUP BY event_id),
v AS (SELECT j.*, CASE json_type(j, '$.matches') WHEN 'NULL' THEN true WHEN 'ARRAY' THEN coalesce(good, true) ELSE false END AS valid FROM j LEFT JOIN mv ON j.event_id = mv.event_id)"""
#: From pp (event_id, x, y, w) to v (event_id, y, x, w) of a 4 x 4 map.
_SOFTMAX = """l AS (SELECT event_id, a.i::INT AS gy, b.i::INT AS gx, w, -(pow(b.i::DOUBLE / 3 - x, 2) + pow(a.i::DOUBLE / 3 - y, 2)) / (2 * 0.2::DOUBLE * 0.2::DOUBLE + 1e-12::DOUBLE) AS l FROM pp, range(0, 4) a(i), range(0, 4) b(i)),
m AS (SELECT event_id, gy, gx, max(l) AS m FROM l GROUP BY ALL),
v AS (SELECT l.event_id, l.gy AS y, l.gx AS x, least(greatest(sum(exp(l - m) * w) / sum(exp(l - m)), 0), 2) AS w FROM l JOIN m ON l.event_id = m.event_id AND l.gy = m.gy AND l.gx = m.gx GROUP BY l.event_id, l.gy, l.gx)"""


def oracle_sql() -> dict[str, str]:
    return {n: q.replace("{matches}", _MATCHES).replace("{softmax}", _SOFTMAX) for n, q in ORACLES.items()}

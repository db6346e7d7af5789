"""Pieces of SQL that the oracles share: the same definitions, written for DuckDB.

Every piece works scene by scene; statements start with WITH RECURSIVE, for the components.
"""

from __future__ import annotations

from pixelquarry.sources.scenes import HEIGHT, PAIR_SQL, WIDTH, fields_sql, grid_sql


def nd(a: str, b: str) -> str:
    return f"CASE WHEN abs(({a})+({b})) >= 1e-6 THEN greatest(-1.0, least(1.0, (({a})-({b}))/(({a})+({b})))) END"


INDICES = {
    "ndvi": nd("nir", "red"),
    "ndwi": nd("green", "nir"),
    "mndwi": nd("green", "swir1"),
    "ndbi": nd("swir1", "nir"),
    "bsi": "CASE WHEN swir1+red+nir+blue <> 0 THEN greatest(-1.0, least(1.0, ((swir1+red)-(nir+blue))/((swir1+red)+(nir+blue)))) END",
    "exg": "CASE WHEN red+green+blue <> 0 THEN greatest(-1.0, least(1.0, (2*green-red-blue)/(red+green+blue))) END",
}
PX, FIELDS = grid_sql(), fields_sql()
BEFORE, AFTER = PAIR_SQL


def histogram(name: str, values: str, bins: int) -> str:
    """CTEs: ``name`` (scene_id, bin, n, lo, hi, valid) of the column x of ``values``."""
    return f"""{name}_v AS (SELECT scene_id, x FROM ({values}) WHERE x IS NOT NULL),
{name}_b AS (SELECT scene_id, min(x) AS lo, max(x) AS hi, count(*) AS valid FROM {name}_v GROUP BY scene_id HAVING max(x) - min(x) >= 1e-9),
{name}_c AS (SELECT scene_id, least(floor((x-lo)/(hi-lo)*{bins}), {bins - 1})::INT AS bin, count(*) AS n FROM {name}_v JOIN {name}_b USING (scene_id) GROUP BY 1, 2),
{name}_g AS (SELECT b.*, g.bin::INT AS bin FROM {name}_b b, range({bins}) AS g(bin)),
{name} AS (SELECT scene_id, bin, coalesce(n, 0) AS n, lo, hi, valid FROM {name}_g LEFT JOIN {name}_c USING (scene_id, bin))"""


def shares(name: str, bins: int) -> str:
    """CTE ``name``_s: shares p, centres x, running sums w and m, total mean mt."""
    return f"""{name}_p AS (SELECT *, n / sum(n) OVER (PARTITION BY scene_id) AS p, lo + (bin + 0.5) * ((hi-lo)/{bins}) AS x FROM {name}),
{name}_w AS (SELECT *, sum(p) OVER o AS w, sum(p*x) OVER o AS m FROM {name}_p WINDOW o AS (PARTITION BY scene_id ORDER BY bin)),
{name}_s AS (SELECT *, arg_max(m, bin) OVER (PARTITION BY scene_id) AS mt FROM {name}_w)"""


def otsu(name: str, values: str, bins: int = 256) -> str:
    """CTEs that end in ``name``_o (scene_id, threshold, quality)."""
    g = "OVER (PARTITION BY scene_id)"
    return f"""{histogram(name, values, bins)},
{shares(name, bins)},
{name}_t AS (SELECT *, CASE WHEN w*(1-w) > 1e-15 THEN (mt*w-m)**2/(w*(1-w)) ELSE 0 END AS s FROM {name}_s WHERE valid >= 16),
{name}_u AS (SELECT *, max(s) {g} AS top, sum(p*(x-mt)**2) {g} AS total FROM {name}_t),
{name}_n AS (SELECT *, s >= top*(1-1e-9) AS near, min(CASE WHEN s = top THEN bin END) {g} AS first FROM {name}_u),
{name}_r AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY scene_id ORDER BY bin) AS run FROM {name}_n),
{name}_h AS (SELECT *, max(CASE WHEN bin = first THEN run END) {g} AS home FROM {name}_r),
{name}_f AS (SELECT scene_id, ((min(bin) + max(bin)) // 2)::INT AS bin FROM {name}_h WHERE near AND run = home GROUP BY scene_id),
{name}_o AS (SELECT scene_id, x AS threshold, CASE WHEN total > 1e-12 THEN greatest(0, least(1, s/total)) ELSE 0 END AS quality
  FROM {name}_r JOIN {name}_f USING (scene_id, bin))"""


def three_classes(name: str, shares: str) -> str:
    """CTE ``name`` (scene_id, low, high, quality): the two cuts of three classes."""
    return f"""{name}_t AS (SELECT *, sum(p*(x-mt)**2) OVER (PARTITION BY scene_id) AS total FROM {shares}),
{name}_2 AS (SELECT a.scene_id, a.x AS low, b.x AS high, a.bin AS i, b.bin AS j, b.total,
  (a.m-a.w*b.mt)**2/a.w + ((b.m-a.m)-(b.w-a.w)*b.mt)**2/(b.w-a.w) + ((b.mt-b.m)-(1-b.w)*b.mt)**2/(1-b.w) AS s
  FROM {name}_t a JOIN {name}_t b ON a.scene_id = b.scene_id AND b.bin > a.bin WHERE a.w > 1e-12 AND b.w-a.w > 1e-12 AND 1-b.w > 1e-12),
{name} AS (SELECT scene_id, low, high, CASE WHEN total > 1e-12 THEN least(1, s/total) ELSE 0 END AS quality FROM {name}_2
  QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY round(s, 12) DESC, i, j) = 1)"""


def prominence(name: str, values: str, cuts: str, cut: str) -> str:
    """CTE ``name``_pr (scene_id, prominence): of the valley at the cut that ``cuts`` has."""
    best = "QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY d DESC, bin) = 1"
    return f"""{histogram(name, values, 128)},
{name}_d AS (SELECT scene_id, bin, valid, lo + (bin + 0.5) * ((hi-lo)/128) AS x, sum(n) OVER (PARTITION BY scene_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS d FROM {name}),
{name}_l AS (SELECT scene_id, bin, d, valid FROM {name}_d JOIN {cuts} k USING (scene_id) WHERE {name}_d.x < k.{cut} {best}),
{name}_i AS (SELECT scene_id, bin, d FROM {name}_d JOIN {cuts} k USING (scene_id) WHERE {name}_d.x >= k.{cut} {best}),
{name}_y AS (SELECT l.scene_id, any_value(l.valid) AS valid, 1 - min(v.d) / any_value(least(l.d, r.d)) AS depth FROM {name}_l l JOIN {name}_i r USING (scene_id)
  JOIN {name}_d v ON v.scene_id = l.scene_id AND v.bin BETWEEN l.bin AND r.bin GROUP BY l.scene_id),
{name}_pr AS (SELECT scene_id, coalesce(CASE WHEN valid >= 100 THEN greatest(0, least(1, depth)) END, 0) AS prominence FROM (SELECT DISTINCT scene_id FROM ({values}) WHERE x IS NOT NULL) LEFT JOIN {name}_y USING (scene_id))"""


def bimodality(name: str, values: str) -> str:
    """CTE ``name``_bi (scene_id, bimodality)."""
    return f"""{name}_m1 AS (SELECT scene_id, count(x) AS n, avg(x) AS mu, stddev_pop(x) AS sd FROM ({values}) WHERE x IS NOT NULL GROUP BY scene_id),
{name}_m2 AS (SELECT scene_id, any_value(n)::DOUBLE AS n, any_value(sd) AS sd, avg(((x-mu)/nullif(sd,0))**3) AS skew, avg(((x-mu)/nullif(sd,0))**4) - 3 AS kurt
  FROM ({values}) JOIN {name}_m1 USING (scene_id) WHERE x IS NOT NULL GROUP BY scene_id),
{name}_bi AS (SELECT scene_id, coalesce(CASE WHEN n >= 32 AND sd >= 1e-12 THEN greatest(0, least(1, (skew**2+1)/(kurt + 3*(n-1)**2/((n-2)*(n-3))))) END, 0) AS bimodality FROM {name}_m2)"""


def adaptive(name: str, values: str, fallback: float, region: bool = False) -> str:
    """CTEs that end in ``name``_a (scene_id, threshold, method, quality)."""
    raised = f"CASE WHEN valid >= 16 THEN greatest({fallback}, middle) ELSE {fallback} END" if region else f"{fallback}"
    good = "coalesce(quality >= 0.55 AND bimodality >= 5.0/9.0, false)"
    return f"""{otsu(name, values)},
{bimodality(name, values)},
{name}_q AS (SELECT scene_id, count(x) AS valid, median(x) AS middle FROM ({values}) GROUP BY scene_id),
{name}_a AS (SELECT scene_id, CASE WHEN {good} THEN threshold ELSE {raised} END::DOUBLE AS threshold, CASE WHEN {good} THEN 'otsu' ELSE 'literature' END AS method,
  coalesce(quality, 0) AS quality FROM {name}_q LEFT JOIN {name}_o USING (scene_id) LEFT JOIN {name}_bi USING (scene_id))"""


def components(name: str, places: str) -> str:
    """CTE ``name``_l (scene_id, r, c, id, lab): 8-connected components of the places of a table,
    named by their first place."""
    return f"""{name}_k AS MATERIALIZED (SELECT scene_id, r, c, scene_id*{WIDTH * HEIGHT} + r*{WIDTH} + c AS id FROM {places}),
{name}_e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM {name}_k a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) o(dr, dc)
  JOIN {name}_k b ON b.scene_id = a.scene_id AND b.r = a.r + dr AND b.c = a.c + dc),
{name}_cc(id, lab) USING KEY (id) AS (SELECT id, id FROM {name}_k UNION (SELECT e.b, min(x.lab) FROM {name}_cc x JOIN {name}_e e ON x.id = e.a
  JOIN recurring.{name}_cc AS y ON y.id = e.b WHERE x.lab < y.lab GROUP BY e.b)),
{name}_l AS MATERIALIZED (SELECT scene_id, r, c, id, lab FROM {name}_k JOIN {name}_cc USING (id))"""


_CROSS = "(VALUES (-1,0),(0,-1),(0,0),(0,1),(1,0)) o(dr, dc)"
_ELLIPSE = "(SELECT dr, dc FROM range(-2, 3) i(dr), range(-2, 3) j(dc) WHERE abs(dr) < 2 OR dc = 0) o"


def _dilated(name: str, places: str, frame: str, element: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT f.scene_id, f.r, f.c FROM {places} p, {element} JOIN {frame} f ON f.scene_id = p.scene_id AND f.r = p.r + dr AND f.c = p.c + dc)"""


def _eroded(name: str, places: str, frame: str, element: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT p.scene_id, p.r, p.c FROM {places} p, {element} LEFT JOIN {frame} f ON f.scene_id = p.scene_id AND f.r = p.r + dr AND f.c = p.c + dc
  LEFT JOIN {places} q ON q.scene_id = f.scene_id AND q.r = f.r AND q.c = f.c GROUP BY ALL HAVING bool_and(f.r IS NULL OR q.r IS NOT NULL))"""


def cleaned(name: str, frame: str, mask: str, min_area: int) -> str:
    """CTE ``name`` (scene_id, r, c): the places of ``frame`` where ``mask`` holds, opened by a cross,
    closed by an ellipse of radius 2, and freed of components below ``min_area``."""
    return f"""{name}_0 AS MATERIALIZED (SELECT scene_id, r, c FROM {frame} WHERE {mask}),
{_eroded(name + '_1', name + '_0', frame, _CROSS)},
{_dilated(name + '_2', name + '_1', frame, _CROSS)},
{_dilated(name + '_3', name + '_2', frame, _ELLIPSE)},
{_eroded(name + '_4', name + '_3', frame, _ELLIPSE)},
{components(name, name + '_4')},
{name} AS (SELECT scene_id, r, c FROM {name}_l WHERE lab IN (SELECT lab FROM {name}_l GROUP BY lab HAVING count(*) >= {min_area}))"""


CLASS_NAME = "CASE class_code WHEN 1 THEN 'water' WHEN 2 THEN 'vegetation' WHEN 3 THEN 'built_up' WHEN 4 THEN 'bare_soil' ELSE 'unclassified' END"


def landcover(name: str, px: str) -> str:
    """CTEs that end in ``name`` (scene_id, r, c, bands, indices, valid, class_code, evidence)."""
    n = name
    return f"""{n}_px AS MATERIALIZED (SELECT *, {INDICES['mndwi']} AS mndwi, {INDICES['ndvi']} AS ndvi, {INDICES['ndbi']} AS ndbi, nir IS NOT NULL AS valid FROM ({px})),
{adaptive(n + 'w', f'SELECT scene_id, mndwi AS x FROM {n}_px', 0.0)},
{adaptive(n + 'v', f'SELECT scene_id, ndvi AS x FROM {n}_px', 0.30)},
{n}_1 AS MATERIALIZED (SELECT p.*, coalesce(mndwi > w.threshold, false) AS wat, coalesce(ndvi > v.threshold, false) AND NOT coalesce(mndwi > w.threshold, false) AS veg
  FROM {n}_px p LEFT JOIN {n}w_a w USING (scene_id) LEFT JOIN {n}v_a v USING (scene_id)),
{adaptive(n + 'b', f'SELECT scene_id, CASE WHEN valid AND NOT wat AND NOT veg THEN ndbi END AS x FROM {n}_1', 0.0, True)},
{n}_2 AS MATERIALIZED (SELECT p.*, coalesce(valid AND NOT wat AND NOT veg AND ndbi > b.threshold, false) AS raw FROM {n}_1 p LEFT JOIN {n}b_a b USING (scene_id)),
{cleaned(n + 'x', n + '_2', 'raw', 25)},
{n}_3 AS MATERIALIZED (SELECT p.*, x.r IS NOT NULL AS bui FROM {n}_2 p LEFT JOIN {n}x x ON x.scene_id = p.scene_id AND x.r = p.r AND x.c = p.c),
{n} AS MATERIALIZED (SELECT *, CASE WHEN bui THEN 3 WHEN wat THEN 1 WHEN veg THEN 2 WHEN valid THEN 4 ELSE 0 END AS class_code,
  CASE WHEN bui THEN greatest(0, least(1, CASE WHEN ndbi IS NOT NULL THEN (ndbi+1)/2 END)) WHEN wat THEN greatest(0, least(1, mndwi)) WHEN veg THEN greatest(0, least(1, ndvi)) ELSE 0 END AS evidence
  FROM {n}_3)"""

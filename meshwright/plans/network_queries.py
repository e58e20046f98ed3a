"""Network queries over the graph derived from customers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W, functions as F

from meshwright.functions.paths import EXACT_NODES, PIVOTS, TileGraph
from meshwright.operators import network as N
from meshwright.operators.ranges import nearest
from meshwright.planning.joins import merged
from meshwright.planning.lineage import materialise
from meshwright.plans.fixtures import APSP_SQL, NODES_SQL, edges, edges_sql, nodes
from meshwright.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_ED = f"WITH {edges_sql()}"
_AP = f"WITH RECURSIVE {edges_sql()}{APSP_SQL}"
_TILE = ",\nsize AS (SELECT tile, count(*) AS n FROM (SELECT DISTINCT tile, u FROM e2) GROUP BY 1), home AS (SELECT DISTINCT u AS id, tile FROM e2)"
_COMP = ",\ncomp AS (SELECT s AS id, min(n) AS comp FROM ap GROUP BY s)"


def _graph(spark, folder):
    """Linked nodes with their places, and edges: what a traced graph consists of. Written once, as most queries read both often."""
    e = _edges(spark, folder)
    return materialise(nodes(spark, folder).join(merged(N.linked_nodes(e)), ["tile", "id"], "left_semi"), "nodes"), e


def _edges(spark, folder):
    return materialise(edges(spark, folder), "edges")


@query("g_degree", _ED + " SELECT tile, id, count(*) AS degree FROM (SELECT tile, u AS id FROM ed UNION ALL SELECT tile, v FROM ed) GROUP BY 1, 2")
def g_degree(spark, folder):
    return N.degrees(edges(spark, folder))


@query("flt_zero_edge", f"WITH {NODES_SQL}, e AS (SELECT a.tile, a.id AS u, b.id AS v FROM nd a JOIN nd b ON a.tile = b.tile AND a.id < b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) BETWEEN 1 AND 5625) SELECT tile, id FROM nd WHERE id IN (SELECT u FROM e UNION SELECT v FROM e)")
def flt_zero_edge(spark, folder):
    """Nodes that keep an edge of positive length."""
    return _graph(spark, folder)[0].select("tile", "id")


@query("flt_spur", _ED + """, dg AS (SELECT tile, id, count(*) AS k FROM (SELECT tile, u AS id FROM ed UNION ALL SELECT tile, v FROM ed) GROUP BY 1, 2)
 SELECT ed.tile, u, v, w FROM ed JOIN dg a ON a.id = u JOIN dg b ON b.id = v WHERE NOT (w < 40000 AND (a.k = 1 OR b.k = 1))""")
def flt_spur(spark, folder):
    """Edges but short ones with a loose end, by the degrees before any is dropped."""
    e = edges(spark, folder)
    d = N.degrees(e)
    a, b = (d.select("tile", F.col("id").alias(c), F.col("degree").alias(f"k{c}")) for c in "uv")
    return e.join(merged(a), ["tile", "u"]).join(merged(b), ["tile", "v"]).filter("not (w < 40000 and (ku = 1 or kv = 1))").select("tile", "u", "v", "w")


@query("g_components", _AP + _COMP + " SELECT tile, comp.id, comp FROM comp JOIN (SELECT DISTINCT tile, u AS id FROM e2) h ON h.id = comp.id")
def g_components(spark, folder):
    n, e = _graph(spark, folder)
    return N.components(n, e)


@query("g_stats", _AP + _TILE + _COMP + """, cs AS (SELECT tile, comp, count(*) AS c FROM comp JOIN home USING (id) GROUP BY 1, 2)
 SELECT tile, CAST(sum(c) AS BIGINT) AS nodes, any_value(k) AS edges, count(*) AS components, max(c) AS lcc_nodes, round(max(c)/sum(c), 4) AS lcc_fraction, round(any_value(w)/1000.0::DOUBLE, 1) AS total_length
 FROM cs JOIN (SELECT tile, count(*) AS k, sum(w)::BIGINT AS w FROM ed GROUP BY 1) USING (tile) GROUP BY tile""")
def g_stats(spark, folder):
    n, e = _graph(spark, folder)
    return N.stats(e, N.components(n, e))


@query("g_lcc_frac", _AP + _TILE + _COMP + """, cs AS (SELECT tile, comp, count(*) AS c FROM comp JOIN home USING (id) GROUP BY 1, 2), a AS (SELECT c_nationkey AS tile, count(*) AS n FROM customer GROUP BY 1)
 SELECT tile, round(max(c)/any_value(n), 4) AS lcc_of_all FROM cs JOIN a USING (tile) GROUP BY tile""")
def g_lcc_frac(spark, folder):
    """Largest component over all original nodes, isolated ones too."""
    n, e = _graph(spark, folder)
    size = N.components(n, e).groupBy("tile", "comp").count().groupBy("tile").agg(F.max("count").alias("c"))
    every = nodes(spark, folder).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    return size.join(every, "tile").select("tile", F.round(F.col("c") / F.col("n"), 4).alias("lcc_of_all"))


@query("g_lcc_sub", _AP + _TILE + _COMP + """, cs AS (SELECT tile, comp, count(*) AS c FROM comp JOIN home USING (id) GROUP BY 1, 2), top AS (SELECT tile, comp FROM cs QUALIFY row_number() OVER (PARTITION BY tile ORDER BY c DESC, comp) = 1)
 SELECT ed.tile, u, v, w FROM ed JOIN comp ON comp.id = u JOIN top ON top.tile = ed.tile AND top.comp = comp.comp""")
def g_lcc_sub(spark, folder):
    """Edges of each tile's largest component."""
    n, e = _graph(spark, folder)
    c = N.components(n, e)
    top = c.groupBy("tile", "comp").count().withColumn("r", F.row_number().over(W.partitionBy("tile").orderBy(F.desc("count"), "comp"))).filter("r = 1")
    keep = merged(c.join(top, ["tile", "comp"], "left_semi").select("tile", "id"))
    return e.join(keep.withColumnRenamed("id", "u"), ["tile", "u"], "left_semi").join(keep.withColumnRenamed("id", "v"), ["tile", "v"], "left_semi").select("tile", "u", "v", "w")


@query("g_apsp", _AP + " SELECT s, n, d FROM ap")
def g_apsp(spark, folder):
    n, e = _graph(spark, folder)
    return N.all_pairs(n, e).select("s", "n", "d")


@query("g_eff", _AP + _TILE + " SELECT tile, any_value(size.n) AS n, round(sum(CASE WHEN d > 0 THEN 1000.0::DOUBLE/d END)/(any_value(size.n)*(any_value(size.n)-1)), 8) AS eff FROM ap JOIN home ON home.id = ap.s JOIN size USING (tile) GROUP BY tile")
def g_eff(spark, folder):
    n, e = _graph(spark, folder)
    return N.mean_inverse(n, e).select("tile", "n", F.round("eff", 8).alias("eff"))


@query("g_sssp", _AP + _TILE + " SELECT tile, n AS id, d FROM ap JOIN (SELECT tile, min(id) AS s FROM home GROUP BY 1) USING (s)")
def g_sssp(spark, folder):
    """Distances from each tile's least node."""
    n, e = _graph(spark, folder)

    def run(tile, nd, ed):
        g = TileGraph(nd.id, ed.u, ed.v, ed.w)
        d = pd.Series(g.from_source(0)[0])
        at = d[d < float("inf")].index
        return pd.DataFrame({"tile": tile, "id": g.ids[at], "d": d[at].astype("int64")})

    return N.per_tile(n, e, run, "tile int, id long, d long")


@query("g_path", _AP + _TILE + """ SELECT tile, s AS src, n AS dst, d AS length FROM ap JOIN (SELECT tile, min(id) AS s FROM home GROUP BY 1) USING (s)
 QUALIFY row_number() OVER (PARTITION BY tile ORDER BY d DESC, n) = 1""")
def g_path(spark, folder):
    """The path from each tile's least node to the farthest one, walked back over parents."""
    n, e = _graph(spark, folder)

    def run(tile, nd, ed):
        g = TileGraph(nd.id, ed.u, ed.v, ed.w)
        dist, parent, order, _, _ = g.from_source(0)
        far = min(order, key=lambda k: (-dist[k], g.ids[k]))
        weight, at = 0.0, far
        while parent[at] >= 0:
            weight += next(w for b, w in g.near[at] if b == parent[at] and dist[at] == dist[b] + w)
            at = parent[at]
        return pd.DataFrame({"tile": [tile], "src": [g.ids[0]], "dst": [g.ids[far]], "length": [int(weight)]})

    return N.per_tile(n, e, run, "tile int, src long, dst long, length long")


_SG = """,
q(s, n, d) AS (SELECT DISTINCT u, u, CAST(0 AS BIGINT) FROM e2 UNION ALL SELECT q.s, e2.v, q.d + e2.w FROM q JOIN e2 ON q.n = e2.u JOIN ap ON ap.s = q.s AND ap.n = e2.v AND ap.d = q.d + e2.w),
sg AS (SELECT s, n, d, count(*) AS c FROM q GROUP BY ALL)"""
_BC = _SG + _TILE + """,
raw AS (SELECT a.n AS id, sum(a.c*b.c*1.0::DOUBLE/st.c) AS t FROM sg a JOIN sg b ON b.s = a.n JOIN sg st ON st.s = a.s AND st.n = b.n
  WHERE a.s <> a.n AND b.n <> a.n AND a.s <> b.n AND a.d + b.d = st.d GROUP BY a.n),
bc AS (SELECT tile, id, round(coalesce(t, 0)/(CASE WHEN n > 2 THEN (n-1)*(n-2) ELSE 1 END), 8) AS bc FROM home LEFT JOIN raw USING (id) JOIN size USING (tile))"""


def _bc(spark, folder):
    """Scores from every source, whatever a tile's size."""
    n, e = _graph(spark, folder)
    return n, e, N.node_betweenness(n, e).select("tile", "id", F.round("bc", 8).alias("bc"))


@query("g_node_bc", _AP + _BC + " SELECT * FROM bc")
def g_node_bc(spark, folder):
    return _bc(spark, folder)[2]


@query("g_edge_bc", _AP + _SG + _TILE + """ SELECT e.tile, e.u, e.v, round(coalesce(sum(a.c*b.c*1.0::DOUBLE/st.c), 0)/(any_value(size.n)*(any_value(size.n)-1)), 8) AS bc FROM ed e JOIN size USING (tile)
 JOIN e2 o ON (o.u = e.u AND o.v = e.v) OR (o.u = e.v AND o.v = e.u) JOIN sg a ON a.n = o.u JOIN sg b ON b.s = o.v JOIN sg st ON st.s = a.s AND st.n = b.n AND st.d = a.d + o.w + b.d GROUP BY 1, 2, 3""")
def g_edge_bc(spark, folder):
    n, e = _graph(spark, folder)
    return N.betweenness(n, e, pivots=PIVOTS, exact=EXACT_NODES)[1].select("tile", "u", "v", F.round("bc", 8).alias("bc"))


@query("g_bc_sampled")
def g_bc_sampled(spark, folder, pivots: int = 350, exact: int = 450):
    """Betweenness, exact in tiles of up to 450 nodes, from 350 pivots scaled up in larger ones."""
    n, e = _graph(spark, folder)
    return N.betweenness(n, e, pivots=pivots, exact=exact)[0].select("tile", "id", F.round("bc", 8).alias("bc"))


@query("g_tiers", _AP + _BC + """, p AS (SELECT tile, quantile_cont(bc, 0.75) AS p75, quantile_cont(bc, 0.9) AS p90 FROM bc WHERE bc > 1e-9 GROUP BY 1)
 SELECT bc.tile, id, bc, CASE WHEN bc > 1e-9 AND bc >= p90 THEN 'critical' WHEN bc > 1e-9 AND bc >= p75 THEN 'important' ELSE 'normal' END AS tier FROM bc LEFT JOIN p ON p.tile = bc.tile""")
def g_tiers(spark, folder):
    return N.tiers(_bc(spark, folder)[2])


_RANK = ", r AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY bc DESC, id) AS rnk FROM bc)"


@query("g_topk", _AP + _BC + _RANK + " SELECT tile, id, bc, CAST(rnk AS INTEGER) AS rnk FROM r WHERE rnk <= 10")
def g_topk(spark, folder):
    """The ten gatekeepers of each tile."""
    w = W.partitionBy("tile").orderBy(F.desc("bc"), "id")
    return _bc(spark, folder)[2].withColumn("rnk", F.row_number().over(w)).filter("rnk <= 10")


@query("win_rank", _AP + _BC + " SELECT tile, id, CAST(row_number() OVER (PARTITION BY tile ORDER BY bc DESC, id) AS INTEGER) AS rnk FROM bc")
def win_rank(spark, folder):
    return _bc(spark, folder)[2].select("tile", "id", F.row_number().over(W.partitionBy("tile").orderBy(F.desc("bc"), "id")).alias("rnk"))


_DEM = """, mid AS (SELECT ed.tile, (a.x+b.x)/2 AS mx, (a.y+b.y)/2 AS my, w FROM ed JOIN nd a ON a.id = u JOIN nd b ON b.id = v),
dem AS (SELECT n.tile, n.id, CAST(coalesce(sum(w), 0) AS BIGINT) AS demand FROM (SELECT * FROM nd WHERE id IN (SELECT u FROM ed UNION SELECT v FROM ed)) n
  LEFT JOIN mid ON mid.tile = n.tile AND (n.x-mx)*(n.x-mx)+(n.y-my)*(n.y-my) <= 22500 GROUP BY 1, 2)"""


@query("g_density", _ED + _DEM + " SELECT * FROM dem")
def g_density(spark, folder):
    n, e = _graph(spark, folder)
    return N.road_density(n, e)


@query("g_service", _AP + _BC + _DEM + """, raw2 AS (SELECT bc.tile, id, demand, bc*(demand/CASE WHEN max(demand) OVER w > 0 THEN max(demand) OVER w ELSE 1 END) AS s FROM bc JOIN dem USING (id) WINDOW w AS (PARTITION BY bc.tile))
 SELECT tile, id, demand, round(s/CASE WHEN max(s) OVER w > 0 THEN max(s) OVER w ELSE 1 END, 4) AS svc FROM raw2 WINDOW w AS (PARTITION BY tile)""")
def g_service(spark, folder):
    n, e, bc = _bc(spark, folder)
    return N.service(bc, N.road_density(n, e))


_HOPS = """, tip AS (SELECT tile, id FROM (SELECT tile, u AS id FROM ed UNION ALL SELECT tile, v FROM ed) GROUP BY 1, 2 HAVING count(*) = 1),
e2 AS (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed),
h0 AS (SELECT tile, id, id AS near FROM tip), h1 AS (SELECT * FROM h0 UNION SELECT tile, id, v FROM h0 JOIN e2 ON u = near),
h2 AS (SELECT * FROM h1 UNION SELECT tile, id, v FROM h1 JOIN e2 ON u = near), h3 AS (SELECT * FROM h2 UNION SELECT tile, id, v FROM h2 JOIN e2 ON u = near)"""


def _tips(e):
    return N.degrees(e).filter("degree = 1").select("tile", "id")


@query("g_khop", _ED + _HOPS + " SELECT * FROM h3")
def g_khop(spark, folder):
    """Nodes within three edges of each loose end."""
    e = _edges(spark, folder)
    return N.k_hops(e, _tips(e))


@query("g_angle", _ED + _HOPS + """, s AS (SELECT h3.tile, h3.id, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, sum(x*x)::BIGINT AS xx, sum(y*y)::BIGINT AS yy, sum(x*y)::BIGINT AS xy FROM h3 JOIN nd ON nd.id = near GROUP BY 1, 2),
 a AS (SELECT tile, id, 2*(n*xy-sx*sy) AS c, (n*xx-sx*sx)-(n*yy-sy*sy) AS f FROM s)
 SELECT tile, id, CASE WHEN c <> 0 OR f <> 0 THEN round(((degrees(atan2(c::DOUBLE, f::DOUBLE))/2)%180+180)%180, 6) END AS angle FROM a""")
def g_angle(spark, folder):
    e = _edges(spark, folder)
    return N.directions(nodes(spark, folder), e, _tips(e)).select("tile", "id", F.round("angle", 6).alias("angle"))


@query("g_gap_pairs", f"WITH RECURSIVE {edges_sql(60)}{APSP_SQL}{_COMP}" + """, tip AS (SELECT u AS id FROM e2 GROUP BY 1 HAVING count(*) = 1), t AS (SELECT nd.*, comp FROM nd JOIN tip USING (id) JOIN comp USING (id))
 SELECT a.tile, a.id AS a, b.id AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM t a JOIN t b ON a.tile = b.tile AND a.id < b.id AND a.comp <> b.comp WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 9025""")
def g_gap_pairs(spark, folder):
    """Loose ends of different components at most 95 apart, on the sparser graph."""
    return N.gap_pairs(nodes(spark, folder), edges(spark, folder, 60), 95)


@query("g_ablate")
def g_ablate(spark, folder):
    n, e = _graph(spark, folder)
    return N.ablation(n, e)


@query("g_flood")
def g_flood(spark, folder):
    n, e = _graph(spark, folder)
    return N.flooding(n, e)


@query("agg_minmax", _ED + " SELECT tile, min(elev) AS low, max(elev) AS high, arg_min(id, (elev, id)) AS lowest FROM nd WHERE id IN (SELECT u FROM ed UNION SELECT v FROM ed) GROUP BY 1")
def agg_minmax(spark, folder):
    n, _ = _graph(spark, folder)
    return n.groupBy("tile").agg(F.min("elev").alias("low"), F.max("elev").alias("high"), F.min_by("id", F.struct("elev", "id")).alias("lowest"))


_CLOSED = """,
c2 AS (SELECT * FROM e2 WHERE u % 17 <> 0 AND v % 17 <> 0),
aq(s, n, d) USING KEY (s, n) AS (
  SELECT DISTINCT u, u, CAST(0 AS BIGINT) FROM c2
  UNION
  SELECT x.s, x.v, x.d FROM (SELECT aq.s, c2.v, min(aq.d + c2.w) AS d FROM aq JOIN c2 ON aq.n = c2.u GROUP BY aq.s, c2.v) x
  LEFT JOIN recurring.aq q ON q.s = x.s AND q.n = x.v WHERE q.d IS NULL OR x.d < q.d)""" + _TILE
_EFFS = """, b AS (SELECT tile, any_value(size.n) AS n, sum(CASE WHEN d > 0 THEN 1000.0::DOUBLE/d END)/(any_value(size.n)*(any_value(size.n)-1)) AS base FROM ap JOIN home ON home.id = ap.s JOIN size USING (tile) GROUP BY tile),
f AS (SELECT tile, sum(CASE WHEN d > 0 THEN 1000.0::DOUBLE/d END) AS t FROM aq JOIN home ON home.id = aq.s GROUP BY tile)"""


def _closed(n):
    return n.filter("id % 17 = 0").select("tile", "id")


@query("whatif_resilience", _AP + _CLOSED + _EFFS + " SELECT tile, round(base, 8) AS base_eff, round(coalesce(t,0)/(n*(n-1)), 8) AS eff, round(coalesce(t,0)/(n*(n-1))/base, 3) AS r FROM b LEFT JOIN f USING (tile)")
def whatif_resilience(spark, folder):
    """Close every 17th node: efficiency before and after, and the resilience index."""
    n, e = _graph(spark, folder)
    return N.what_if(n, e, _closed(n))


QUERIES["g_whatif"], SQL["g_whatif"] = whatif_resilience, SQL["whatif_resilience"]


@query("g_cached_curve", _AP + _CLOSED + _EFFS + " SELECT tile, CASE WHEN tile % 2 = 0 THEN round((tile % 10)/10.0::DOUBLE, 1) ELSE round(coalesce(t,0)/(n*(n-1))/base, 3) END AS r FROM b LEFT JOIN f USING (tile)")
def g_cached_curve(spark, folder):
    """A stored value where there is one (here: for even tiles); only the other tiles are computed."""
    n, e = _graph(spark, folder)
    stored = n.select("tile").distinct().filter("tile % 2 = 0").select("tile", F.round((F.col("tile") % 10) / 10.0, 1).alias("r"))
    open_ = n.join(stored, "tile", "left_anti")
    fresh = N.what_if(open_, e.join(stored, "tile", "left_anti"), _closed(open_)).select("tile", "r")
    return stored.unionByName(fresh)


#: Every k-th of the reachable pairs s < t in order, k a fortieth of their number (at least 1).
_PAIRS = """, al AS (SELECT tile, s, n AS t, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY tile) AS k FROM ap JOIN home ON home.id = ap.s WHERE n > s WINDOW w AS (PARTITION BY tile ORDER BY s, n)),
pr AS (SELECT tile, s, t FROM al WHERE i % greatest(1, k//40) = 0)"""


@query("g_sector", _AP + _TILE + _PAIRS + " SELECT * FROM pr")
def g_sector(spark, folder):
    """Sample routes of each tile: 40 to 79 of its reachable pairs, at an even stride."""
    return N.stride_pairs(*_graph(spark, folder))


_ROUTES = """, pr AS (SELECT tile, s, n AS t FROM ap JOIN home ON home.id = ap.s WHERE n > s)"""


@query("g_travel", _AP + _CLOSED + _ROUTES + """ SELECT pr.tile, count(*) AS routes, count(*) FILTER (WHERE aq.d IS NULL) AS severed, CAST(floor(100.0::DOUBLE*count(*) FILTER (WHERE aq.d IS NULL)/count(*) + 0.5) AS BIGINT) AS cut_pct, round(coalesce(avg(aq.d*1.0::DOUBLE/ap.d - 1), 0), 6) AS delay
 FROM pr JOIN ap ON ap.s = pr.s AND ap.n = pr.t LEFT JOIN aq ON aq.s = pr.s AND aq.n = pr.t GROUP BY 1""")
def g_travel(spark, folder):
    """Routes between all reachable pairs, routes cut, their share, and the mean relative delay on open ones, after closing nodes."""
    n, e = _graph(spark, folder)
    whole, cut = F.col("routes"), F.col("severed")
    return N.trips(n, e, _closed(n)).filter("routes > 0").select(
        "tile", "routes", "severed", F.floor(F.lit(100.0) * cut / whole + 0.5).cast("long").alias("cut_pct"),
        F.round(F.when(whole > cut, F.col("delay") / (whole - cut)).otherwise(0.0), 6).alias("delay"),
    )


@query("g_od", _AP + _BC + _RANK + """, top AS (SELECT tile, id FROM r WHERE rnk = 1) SELECT top.tile, a.s AS src, b.n AS dst, top.id AS through, st.d AS length FROM top JOIN ap a ON a.n = top.id JOIN ap b ON b.s = top.id JOIN ap st ON st.s = a.s AND st.n = b.n
 WHERE a.s < b.n AND a.s <> top.id AND b.n <> top.id AND a.d + b.d = st.d QUALIFY row_number() OVER (PARTITION BY top.tile ORDER BY st.d DESC, a.s, b.n) = 1""")
def g_od(spark, folder):
    """The longest shortest path through each tile's top gatekeeper."""
    n, e, bc = _bc(spark, folder)
    top = bc.withColumn("k", F.row_number().over(W.partitionBy("tile").orderBy(F.desc("bc"), "id"))).filter("k = 1").select("tile", F.col("id").alias("through"))
    return N.longest_through(n, e, top.withColumnRenamed("through", "id"))


@query("g_snap", f"WITH {NODES_SQL} SELECT a.tile, a.id, b.id AS nearest, round(sqrt((a.x+2-b.x)*(a.x+2-b.x)+(a.y-1-b.y)*(a.y-1-b.y)), 6) AS distance FROM nd a JOIN nd b ON a.tile = b.tile AND b.id % 3 <> 0 AND (a.x+2-b.x)*(a.x+2-b.x)+(a.y-1-b.y)*(a.y-1-b.y) <= 2025 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.x+2-b.x)*(a.x+2-b.x)+(a.y-1-b.y)*(a.y-1-b.y), b.id) = 1")
def g_snap(spark, folder):
    """Shifted truth nodes to the nearest model node within 45 pixels."""
    n = nodes(spark, folder)
    shifted = n.select("tile", "id", (F.col("x") + 2).alias("x"), (F.col("y") - 1).alias("y"))
    model = n.filter("id % 3 <> 0").select("tile", "id", "x", "y")
    out = nearest(shifted, ["tile"], 45, model, "id", "id")
    return out.select("tile", "id", "nearest", F.round("distance", 6).alias("distance"))


_LINES = """ln AS (SELECT DISTINCT doc_key, osm_lines FROM export_web_geo), l1 AS (SELECT doc_key, unnest(osm_lines) AS l, generate_subscripts(osm_lines, 1) - 1 AS i FROM ln),
vx AS (SELECT doc_key, i, j, p[1] AS la, p[2] AS lo FROM (SELECT doc_key, i, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS j FROM l1) WHERE p[1] IS NOT NULL AND p[2] IS NOT NULL AND abs(p[1]) <= 90 AND abs(p[2]) <= 180 AND NOT (p[1] = 0 AND p[2] = 0)),
sg AS (SELECT doc_key, la, lo, lead(la) OVER w AS lb, lead(lo) OVER w AS mo FROM vx WINDOW w AS (PARTITION BY doc_key, i ORDER BY j))"""


@query("g_osm_graph", f"WITH {_LINES} SELECT DISTINCT doc_key, CASE WHEN (la, lo) < (lb, mo) THEN la ELSE lb END AS a_lat, CASE WHEN (la, lo) < (lb, mo) THEN lo ELSE mo END AS a_lng, CASE WHEN (la, lo) < (lb, mo) THEN lb ELSE la END AS b_lat, CASE WHEN (la, lo) < (lb, mo) THEN mo ELSE lo END AS b_lng FROM sg WHERE lb IS NOT NULL AND (la <> lb OR lo <> mo)")
def g_osm_graph(spark, folder):
    """Simple edges between consecutive vertices of reference lines; repeated vertices are one node."""
    d = table(spark, folder, "export_web_geo").select("doc_key", "osm_lines").distinct()
    v = d.select("doc_key", F.posexplode("osm_lines").alias("i", "l")).select("doc_key", "i", F.posexplode("l").alias("j", "p"))
    v = v.select("doc_key", "i", "j", F.try_element_at("p", F.lit(1)).alias("la"), F.try_element_at("p", F.lit(2)).alias("lo"))
    v = v.filter("la is not null and lo is not null and abs(la) <= 90 and abs(lo) <= 180 and not (la = 0 and lo = 0)")
    w = W.partitionBy("doc_key", "i").orderBy("j")
    s = v.withColumn("a", F.struct("la", "lo")).withColumn("b", F.lead(F.struct("la", "lo")).over(w)).filter(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return s.select("doc_key", lo["la"].alias("a_lat"), lo["lo"].alias("a_lng"), hi["la"].alias("b_lat"), hi["lo"].alias("b_lng")).distinct()


@query("win_lead", f"WITH {_LINES} SELECT doc_key, count(*) AS steps, round(sum(abs(lb-la)), 6) AS rise FROM sg WHERE lb IS NOT NULL GROUP BY 1")
def win_lead(spark, folder):
    """Consecutive differences along each line."""
    d = table(spark, folder, "export_web_geo").select("doc_key", "osm_lines").distinct()
    v = d.select("doc_key", F.posexplode("osm_lines").alias("i", "l")).select("doc_key", "i", F.posexplode("l").alias("j", "p"))
    v = v.select("doc_key", "i", "j", F.try_element_at("p", F.lit(1)).alias("la"), F.try_element_at("p", F.lit(2)).alias("lo"))
    v = v.filter("la is not null and lo is not null and abs(la) <= 90 and abs(lo) <= 180 and not (la = 0 and lo = 0)")
    s = v.withColumn("d", F.lead("la").over(W.partitionBy("doc_key", "i").orderBy("j")) - F.col("la")).filter("d is not null")
    return s.groupBy("doc_key").agg(F.count(F.lit(1)).alias("steps"), F.round(F.sum(F.abs("d")), 6).alias("rise"))

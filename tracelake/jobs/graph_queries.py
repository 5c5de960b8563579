"""Queries of workflow graphs and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import pages
from ..sources.adapters import GRAPH_SQL, graph, known_edges, table
from .registry import query

WITH = f"WITH RECURSIVE {GRAPH_SQL}"
CLOSURE_SQL = "pc AS (SELECT DISTINCT revision_id, f, t FROM ge UNION SELECT pc.revision_id, pc.f, ge.t FROM pc JOIN ge ON ge.revision_id = pc.revision_id AND ge.f = pc.t)"
ENTRY_SQL = "en AS (SELECT revision_id, node_id FROM gn WHERE NOT EXISTS (SELECT 1 FROM ge WHERE ge.revision_id = gn.revision_id AND ge.t = gn.node_id))"

DOMINATORS_SQL = """re AS (SELECT * FROM en UNION SELECT re.revision_id, ge.t FROM re JOIN ge ON ge.revision_id = re.revision_id AND ge.f = re.node_id),
wo AS (SELECT en.revision_id, d.node_id AS d, en.node_id AS n FROM en JOIN re d ON d.revision_id = en.revision_id AND d.node_id <> en.node_id UNION SELECT wo.revision_id, d, ge.t FROM wo JOIN ge ON ge.revision_id = wo.revision_id AND ge.f = wo.n AND ge.t <> wo.d),
dm AS (SELECT a.revision_id, a.node_id, d.node_id AS dominator FROM re a JOIN re d ON a.revision_id = d.revision_id WHERE a.node_id = d.node_id OR NOT EXISTS (SELECT 1 FROM wo WHERE wo.revision_id = a.revision_id AND wo.d = d.node_id AND wo.n = a.node_id))"""
#: hd: loops by header; bo: their bodies; ed: edges with their place in a loop; pa: parents; de: depths.
LOOPS_SQL = """be AS (SELECT DISTINCT ge.revision_id, f, t FROM ge JOIN dm ON dm.revision_id = ge.revision_id AND dm.node_id = ge.f AND dm.dominator = ge.t),
bo AS (SELECT revision_id, t AS h, f AS n FROM be UNION SELECT bo.revision_id, bo.h, ge.f FROM bo JOIN ge ON ge.revision_id = bo.revision_id AND ge.t = bo.n AND bo.n <> bo.h JOIN re ON re.revision_id = ge.revision_id AND re.node_id = ge.f),
bd AS (SELECT * FROM bo UNION SELECT revision_id, t, t FROM be),
hd AS (SELECT b.revision_id, b.h, gn.ord, 'loop_' || row_number() OVER (PARTITION BY b.revision_id ORDER BY gn.ord) AS loop_id, (SELECT count(*) FROM bd WHERE bd.revision_id = b.revision_id AND bd.h = b.h) AS size
  FROM (SELECT DISTINCT revision_id, t AS h FROM be) b JOIN gn ON gn.revision_id = b.revision_id AND gn.node_id = b.h),
cm AS (SELECT x.revision_id, x.h, y.h AS o, count(*) AS common FROM bd x JOIN bd y ON x.revision_id = y.revision_id AND x.n = y.n AND x.h <> y.h GROUP BY ALL),
pa AS (SELECT cm.revision_id, cm.h, arg_min(cm.o, (o.size, o.ord)) AS parent FROM cm JOIN hd c ON c.revision_id = cm.revision_id AND c.h = cm.h JOIN hd o ON o.revision_id = cm.revision_id AND o.h = cm.o WHERE common = c.size AND o.size > c.size GROUP BY 1, 2),
de AS (SELECT revision_id, h, h AS up, 0 AS depth FROM hd UNION SELECT de.revision_id, de.h, pa.parent, depth + 1 FROM de JOIN pa ON pa.revision_id = de.revision_id AND pa.h = de.up),
ed AS (SELECT hd.revision_id, hd.h, ge.edge_id, ge.ord, ge.f, ge.t, (ge.revision_id, hd.h, ge.f) IN (SELECT (revision_id, h, n) FROM bd) AS fi, (ge.revision_id, hd.h, ge.t) IN (SELECT (revision_id, h, n) FROM bd) AS ti FROM hd JOIN ge ON ge.revision_id = hd.revision_id),
es AS (SELECT revision_id, h, COALESCE(string_agg(edge_id, ',' ORDER BY ord) FILTER (fi AND ti), '') AS internal_edges, COALESCE(string_agg(edge_id, ',' ORDER BY ord) FILTER (NOT fi AND ti), '') AS entry_edges,
  COALESCE(string_agg(edge_id, ',' ORDER BY ord) FILTER (fi AND t = h AND (revision_id, f, h) IN (SELECT (revision_id, node_id, dominator) FROM dm)), '') AS back_edges, COALESCE(string_agg(edge_id, ',' ORDER BY ord) FILTER (fi AND NOT ti), '') AS exit_edges FROM ed GROUP BY 1, 2)"""
MUTUAL_SQL = "mu AS (SELECT a.revision_id, a.f AS node_id, min(a.t) AS low FROM pc a JOIN pc b ON a.revision_id = b.revision_id AND a.f = b.t AND a.t = b.f GROUP BY 1, 2), sc AS (SELECT revision_id, node_id, least(node_id, low) AS c FROM mu)"


def known(spark: SparkSession, sf_dir: str, forward: bool = False) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph(spark, sf_dir)
    return nodes, known_edges(nodes, edges, forward)


def texts(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in columns})


def list_sql(edge: str, key: str) -> str:
    return f"COALESCE((SELECT string_agg({edge}, ',' ORDER BY ord) FROM ge WHERE ge.revision_id = gn.revision_id AND ge.{key} = gn.node_id), '')"


@query(f"""{WITH}, so AS (SELECT revision_id, f, t, min(ord) AS ord FROM ge GROUP BY 1, 2, 3)
SELECT revision_id, node_id, {list_sql('edge_id', 'f')} AS outgoing, {list_sql('edge_id', 't')} AS incoming,
COALESCE((SELECT string_agg(t, ',' ORDER BY ord) FROM so WHERE so.revision_id = gn.revision_id AND so.f = gn.node_id), '') AS successors, COALESCE((SELECT string_agg(f, ',' ORDER BY ord) FROM so WHERE so.revision_id = gn.revision_id AND so.t = gn.node_id), '') AS predecessors FROM gn""")
def d19_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(G.adjacency(*known(spark, sf_dir)), "outgoing", "incoming", "successors", "predecessors")


@query(f"{WITH} SELECT revision_id, node_id, NOT EXISTS (SELECT 1 FROM ge WHERE ge.revision_id = gn.revision_id AND ge.t = gn.node_id) AS is_entry, NOT EXISTS (SELECT 1 FROM ge WHERE ge.revision_id = gn.revision_id AND ge.f = gn.node_id) AS is_exit FROM gn")
def j1_entry_exit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entry_exit_nodes(*known(spark, sf_dir))


@query(f"""{WITH}, {ENTRY_SQL}, ex AS (SELECT revision_id, node_id FROM gn WHERE r%3=0 AND ord=1) SELECT revision_id, node_id, 'ENTRY_HAS_INCOMING' AS code FROM ex WHERE (revision_id, node_id) NOT IN (SELECT (revision_id, node_id) FROM en)
UNION ALL SELECT DISTINCT revision_id, NULL, 'NO_ENTRY' FROM gn WHERE revision_id NOT IN (SELECT revision_id FROM en) AND revision_id NOT IN (SELECT revision_id FROM ex)""")
def j1_entry_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = known(spark, sf_dir)
    explicit = nodes.filter((F.substring("revision_id", 2, 9).cast("long") % 3 == 0) & (F.col("ord") == 1)).select("revision_id", "node_id")
    return G.entry_diagnostics(nodes, edges, explicit)


@query(f"{WITH}, {ENTRY_SQL}, re AS (SELECT * FROM en UNION SELECT re.revision_id, ge.t FROM re JOIN ge ON ge.revision_id = re.revision_id AND ge.f = re.node_id) SELECT * FROM re")
def j2_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = known(spark, sf_dir)
    return G.reachable(edges, G.entry_exit_nodes(nodes, edges).filter("is_entry"))


@query(f"{WITH}, {CLOSURE_SQL}, mu AS (SELECT a.revision_id, a.f, min(a.t) AS low FROM pc a JOIN pc b ON a.revision_id = b.revision_id AND a.f = b.t AND a.t = b.f GROUP BY 1, 2) SELECT gn.revision_id, node_id, least(node_id, COALESCE(low, node_id)) AS component_id, low IS NOT NULL AS is_cycle FROM gn LEFT JOIN mu ON mu.revision_id = gn.revision_id AND f = node_id")
def j3_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.strong_components(*known(spark, sf_dir))


@query(f"{WITH}, {ENTRY_SQL}, {DOMINATORS_SQL} SELECT * FROM dm")
def j4_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dominators(*known(spark, sf_dir))


@query(f"""{WITH}, {ENTRY_SQL}, {DOMINATORS_SQL}, {LOOPS_SQL}
SELECT hd.revision_id, hd.loop_id, hd.h AS header, (SELECT string_agg(n, ',' ORDER BY gn.ord) FROM bd JOIN gn ON gn.revision_id = bd.revision_id AND gn.node_id = bd.n WHERE bd.revision_id = hd.revision_id AND bd.h = hd.h) AS node_ids, internal_edges, entry_edges, back_edges, exit_edges, up.loop_id AS parent,
  (SELECT max(depth) FROM de WHERE de.revision_id = hd.revision_id AND de.h = hd.h) AS depth
FROM hd JOIN es ON es.revision_id = hd.revision_id AND es.h = hd.h LEFT JOIN pa ON pa.revision_id = hd.revision_id AND pa.h = hd.h LEFT JOIN hd up ON up.revision_id = hd.revision_id AND up.h = pa.parent""")
def j5_natural_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(G.natural_loops(*known(spark, sf_dir)), "node_ids", "internal_edges", "entry_edges", "back_edges", "exit_edges")


@query(f"""{WITH}, {ENTRY_SQL}, {DOMINATORS_SQL}, {LOOPS_SQL}, {CLOSURE_SQL}, {MUTUAL_SQL},
p1 AS (SELECT ge.revision_id, 1 AS p, 'CYCLE_ENTRIES' AS code, b.c AS subject FROM ge JOIN sc b ON b.revision_id = ge.revision_id AND b.node_id = ge.t LEFT JOIN sc a ON a.revision_id = ge.revision_id AND a.node_id = ge.f WHERE a.c IS DISTINCT FROM b.c GROUP BY ALL HAVING count(DISTINCT ge.t) > 1),
p2 AS (SELECT DISTINCT revision_id, 2 AS p, 'IRREDUCIBLE_CYCLE' AS code, c AS subject FROM sc WHERE (revision_id, c) NOT IN (SELECT (sc.revision_id, sc.c) FROM sc JOIN hd ON hd.revision_id = sc.revision_id AND hd.h = sc.node_id)),
p3 AS (SELECT cm.revision_id, 3 AS p, 'LOOPS_OVERLAP' AS code, x.loop_id AS subject FROM cm JOIN hd x ON x.revision_id = cm.revision_id AND x.h = cm.h JOIN hd y ON y.revision_id = cm.revision_id AND y.h = cm.o WHERE x.loop_id < y.loop_id AND common < least(x.size, y.size)),
p4 AS (SELECT revision_id, 4 AS p, 'LOOP_ENTRY_INVALID' AS code, edge_id AS subject FROM ed WHERE NOT fi AND ti AND t <> h),
al AS (SELECT * FROM p1 UNION SELECT * FROM p2 UNION SELECT * FROM p3 UNION SELECT * FROM p4)
SELECT DISTINCT revision_id, code, subject FROM al WHERE p = (SELECT min(p) FROM al b WHERE b.revision_id = al.revision_id)""")
def j6_loop_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.loop_diagnostics(*known(spark, sf_dir))


@query(f"{WITH}, le AS (SELECT revision_id, node_id, 0 AS level FROM gn UNION SELECT le.revision_id, ge.t, level + 1 FROM le JOIN ge ON ge.revision_id = le.revision_id AND ge.f = le.node_id AND ge.f < ge.t) SELECT revision_id, node_id, max(level) AS level FROM le GROUP BY 1, 2")
def j7_topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.topological_levels(*known(spark, sf_dir, forward=True))


@query(f"""{WITH}, gp AS (SELECT * FROM (VALUES ('a'), ('a/b'), ('c')) t(g)), me AS (SELECT revision_id, g, node_id, path = g AS direct FROM gn JOIN gp ON path = g OR starts_with(path, g || '/')),
ed AS (SELECT revision_id, g, edge_id, path = g AS direct FROM ge JOIN gp ON path = g OR starts_with(path, g || '/')),
io AS (SELECT m.revision_id, m.g, m.node_id, NOT EXISTS (SELECT 1 FROM ge JOIN me o ON o.revision_id = ge.revision_id AND o.node_id = ge.f WHERE ge.revision_id = m.revision_id AND ge.t = m.node_id AND o.g = m.g) OR EXISTS (SELECT 1 FROM ge WHERE ge.revision_id = m.revision_id AND ge.t = m.node_id AND NOT EXISTS (SELECT 1 FROM me o WHERE o.revision_id = ge.revision_id AND o.g = m.g AND o.node_id = ge.f)) AS en,
  NOT EXISTS (SELECT 1 FROM ge JOIN me o ON o.revision_id = ge.revision_id AND o.node_id = ge.t WHERE ge.revision_id = m.revision_id AND ge.f = m.node_id AND o.g = m.g) OR EXISTS (SELECT 1 FROM ge WHERE ge.revision_id = m.revision_id AND ge.f = m.node_id AND NOT EXISTS (SELECT 1 FROM me o WHERE o.revision_id = ge.revision_id AND o.g = m.g AND o.node_id = ge.t)) AS ex FROM me m)
SELECT me.revision_id, me.g AS group_id, CASE WHEN me.g = 'a/b' THEN 'a' END AS parent_group_id, CASE WHEN me.g = 'a/b' THEN 'b' ELSE me.g END AS label, string_agg(me.node_id, ',' ORDER BY me.node_id) AS node_ids, COALESCE(string_agg(me.node_id, ',' ORDER BY me.node_id) FILTER (direct), '') AS direct_node_ids,
  COALESCE((SELECT string_agg(edge_id, ',' ORDER BY edge_id) FROM ed WHERE ed.revision_id = me.revision_id AND ed.g = me.g), '') AS edge_ids, COALESCE((SELECT string_agg(edge_id, ',' ORDER BY edge_id) FROM ed WHERE ed.revision_id = me.revision_id AND ed.g = me.g AND direct), '') AS direct_edge_ids,
  COALESCE(string_agg(me.node_id, ',' ORDER BY me.node_id) FILTER (en), '') AS entry_node_ids, COALESCE(string_agg(me.node_id, ',' ORDER BY me.node_id) FILTER (ex), '') AS exit_node_ids
FROM me JOIN io ON io.revision_id = me.revision_id AND io.g = me.g AND io.node_id = me.node_id GROUP BY 1, 2""")
def j8_workflow_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(G.workflow_groups(*known(spark, sf_dir)), "node_ids", "direct_node_ids", "edge_ids", "direct_edge_ids", "entry_node_ids", "exit_node_ids")


@query(f"""{WITH} SELECT revision_id, 'DUPLICATE_NODE' AS code, node_id AS subject FROM gn WHERE ord = 5 AND r%4=0 UNION ALL SELECT revision_id, 'DUPLICATE_EDGE', edge_id FROM ga WHERE ord = 8
UNION ALL SELECT revision_id, 'UNKNOWN_FROM', edge_id FROM ga WHERE (revision_id, f) NOT IN (SELECT (revision_id, node_id) FROM gn) UNION ALL SELECT revision_id, 'UNKNOWN_TO', edge_id FROM ga WHERE (revision_id, t) NOT IN (SELECT (revision_id, node_id) FROM gn)""")
def j9_graph_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    twice = nodes.filter((F.col("ord") == 5) & (F.substring("revision_id", 2, 9).cast("long") % 4 == 0))
    return G.graph_integrity(nodes.union(twice), edges.union(edges.filter("ord = 8")))


@query(f"""{WITH}, fe AS (SELECT * FROM ge WHERE f < t), sk AS (SELECT revision_id, node_id FROM gn WHERE ord = 0 AND r%3=0),
li AS (SELECT revision_id, node_id FROM gn WHERE (revision_id, node_id) NOT IN (SELECT (revision_id, t) FROM fe) AND (revision_id, node_id) NOT IN (SELECT (revision_id, node_id) FROM sk)
  UNION SELECT li.revision_id, fe.t FROM li JOIN fe ON fe.revision_id = li.revision_id AND fe.f = li.node_id WHERE fe.ord%5 <> 2 AND (fe.revision_id, fe.t) NOT IN (SELECT (revision_id, node_id) FROM sk))
SELECT revision_id AS run_id, node_id FROM gn WHERE (revision_id, node_id) NOT IN (SELECT (revision_id, node_id) FROM li)""")
def j11_propagate_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revision has one run, of its name. The SQL turns the rule round: a node lives if some edge from a living node is selected."""
    nodes, edges = known(spark, sf_dir, forward=True)
    decisions = edges.filter("ord % 5 = 2").select(F.col("revision_id").alias("run_id"), "edge_id", F.lit(False).alias("selected"))
    entries = nodes.filter("ord = 0").select(F.col("revision_id").alias("run_id"), "node_id").filter(F.substring("run_id", 2, 9).cast("long") % 3 == 0)
    runs = nodes.select("revision_id", F.col("revision_id").alias("run_id")).distinct()
    return G.propagate_skips(edges, decisions, entries, runs)


@query("""WITH c AS (SELECT p_partkey AS pair_id, 'x' || i AS name, CASE i%3 WHEN 0 THEN 'int' WHEN 1 THEN 'str' END AS an, (p_partkey + i)%2=0 AS rq, CAST(i AS VARCHAR) AS df FROM part, range(4) t(i)), o AS (SELECT p_partkey AS pair_id, 'x' || i AS name, CASE WHEN (p_size + i)%4=0 THEN NULL WHEN i%3=0 THEN 'int' ELSE 'str' END AS an, (p_size + i)%3=0 AS rq, CAST(i + p_size%2 AS VARCHAR) AS df FROM part, range(1, 6) t(i)), e AS (SELECT p_partkey AS pair_id, p_size%5=0 AS ex FROM part),
j AS (SELECT COALESCE(c.pair_id, o.pair_id) AS pair_id, COALESCE(c.name, o.name) AS name, c.name IS NOT NULL AS hc, o.name IS NOT NULL AS ho, c.an AS ca, o.an AS oa, c.rq AS cr, o.rq AS orq, c.df AS cd, o.df AS od FROM c FULL JOIN o ON c.pair_id = o.pair_id AND c.name = o.name)
SELECT * FROM (SELECT j.pair_id, name, unnest(list_filter([CASE WHEN hc AND NOT ho THEN CASE WHEN ex THEN 'only_through_extra' ELSE 'missing' END END, CASE WHEN hc AND ho AND NOT cr AND orq THEN 'newly_required' END, CASE WHEN hc AND ho AND ca IS DISTINCT FROM oa THEN CASE WHEN ca IS NOT NULL AND oa IS NOT NULL THEN 'annotations_differ' ELSE 'annotation_unknown' END END, CASE WHEN hc AND ho AND NOT cr AND NOT orq AND cd IS DISTINCT FROM od THEN 'defaults_differ' END, CASE WHEN ho AND NOT hc AND orq THEN 'extra_required' END], lambda x: x IS NOT NULL)) AS code FROM j JOIN e USING (pair_id)),
LATERAL (SELECT CASE WHEN code IN ('missing', 'newly_required', 'extra_required') THEN 'error' ELSE 'warning' END AS severity)""")
def c14_compare_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    c = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.col("p_partkey").alias("pair_id"), F.concat(F.lit("x"), F.col("i").cast("string")).alias("name"), F.when(F.col("i") % 3 == 0, "int").when(F.col("i") % 3 == 1, "str").alias("annotation"), ((F.col("p_partkey") + F.col("i")) % 2 == 0).alias("required"), F.col("i").cast("string").alias("default"), F.lit(False).alias("allow_extra"))
    o = p.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(F.col("p_partkey").alias("pair_id"), F.concat(F.lit("x"), F.col("i").cast("string")).alias("name"), F.when((F.col("p_size") + F.col("i")) % 4 == 0, None).when(F.col("i") % 3 == 0, "int").otherwise("str").alias("annotation"), ((F.col("p_size") + F.col("i")) % 3 == 0).alias("required"), (F.col("i") + F.col("p_size") % 2).cast("string").alias("default"), (F.col("p_size") % 5 == 0).alias("allow_extra"))
    return G.compare_contracts(c, o)


@query(f"{WITH}, me AS (SELECT revision_id, node_id FROM gn WHERE path = 'a' OR starts_with(path, 'a/')) SELECT revision_id, edge_id FROM ge WHERE path = 'a' OR starts_with(path, 'a/') OR ((revision_id, f) IN (SELECT (revision_id, node_id) FROM me) AND (revision_id, t) IN (SELECT (revision_id, node_id) FROM me))")
def b8_scope_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = known(spark, sf_dir)
    return pages.scope_edges(edges, nodes, ["a"]).select("revision_id", "edge_id")


@query(f"{WITH} SELECT revision_id, node_id, ord FROM gn WHERE path = 'a/b'")
def b8_scope_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = known(spark, sf_dir)
    return pages.scope_executions(nodes.select("revision_id", "node_id", "ord"), nodes, ["a", "b"])

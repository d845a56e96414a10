"""The library's queries over the sample tables, and the SQL that gives the same rows.

Graphs: ``parts``, orders and the parts on their lines; ``customers``, customers and their orders; ``turns``, the turns of
a conversation in a row; ``copies``, documents of equal text. Where vertices are dealt out, they are to four parts.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.random import start_time
from weftgraph.operators import contraction as C
from weftgraph.operators import edges as E
from weftgraph.operators import labels as L
from weftgraph.operators import partitions as P
from weftgraph.plans import connectivity as K
from weftgraph.plans.connectivity import Graph, component_labels, symmetric
from weftgraph.plans.lineage import cut, shared_folder
from weftgraph.sources import generators, readers, writers

PARTS = 4
PART = P.round_robin(PARTS, 2)
BETA, SEED = 0.1, 1


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def order_of(column: str):
    return F.col(column) * 2


def other_of(column: str):
    return F.col(column) * 2 + 1


def parts(spark: SparkSession, d: str) -> Graph:
    edges = _read(spark, d, "lineitem", "l_orderkey", "l_partkey").select(order_of("l_orderkey").alias("src"), other_of("l_partkey").alias("dst")).distinct()
    orders = _read(spark, d, "orders", "o_orderkey").select(order_of("o_orderkey").alias("v"))
    return Graph(edges, orders.union(_read(spark, d, "part", "p_partkey").select(other_of("p_partkey").alias("v"))))


def _sparse(spark: SparkSession, d: str) -> Graph:
    """The part of ``parts`` whose lines are of 49 and more; most orders have none."""
    lines = _read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").where("l_quantity >= 49")
    edges = lines.select(order_of("l_orderkey").alias("src"), other_of("l_partkey").alias("dst")).distinct()
    return Graph(edges, K.endpoints(edges))


def _heavy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a line of 50."""
    return _read(spark, d, "lineitem", "l_orderkey", "l_quantity").where("l_quantity >= 50").select(order_of("l_orderkey").alias("v")).distinct()


def customers(spark: SparkSession, d: str) -> Graph:
    orders = _read(spark, d, "orders", "o_custkey", "o_orderkey")
    edges = orders.select(order_of("o_custkey").alias("src"), other_of("o_orderkey").alias("dst"))
    known = _read(spark, d, "customer", "c_custkey").select(order_of("c_custkey").alias("v"))
    return Graph(edges, known.union(edges.select("dst")))


def turns(spark: SparkSession, d: str) -> Graph:
    at = (F.col("conv_id") * 10000 + F.col("turn")).alias("v")
    said = _read(spark, d, "conversations", "conv_id", "turn")
    here, there = said.select("conv_id", "turn", at), said.select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), at.alias("w"))
    edges = here.join(there, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))).select(F.col("v").alias("src"), F.col("w").alias("dst"))
    return Graph(edges, here.select("v"))


def copies(spark: SparkSession, d: str) -> Graph:
    docs = _read(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5("text").alias("key"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("src"))
    return Graph(docs.join(first, "key").select("src", F.col("doc_id").alias("dst")), docs.select(F.col("doc_id").alias("v")))


def _both(graph: Graph) -> DataFrame:
    return symmetric(graph.edges)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vertices: each order with the part whose number is that of its customer."""
    return _read(spark, d, "orders", "o_orderkey", "o_custkey").select(order_of("o_orderkey").alias("a"), other_of("o_custkey").alias("b"))


def _renamed(spark: SparkSession, d: str) -> DataFrame:
    """Every part by the least part of its brand."""
    part = _read(spark, d, "part", "p_partkey", "p_brand")
    least = part.groupBy("p_brand").agg(F.min("p_partkey").alias("least"))
    return part.join(least, "p_brand").select(other_of("p_partkey").alias("v"), other_of("least").alias("new"))


def _dense_customers(spark: SparkSession, d: str) -> tuple[Graph, int]:
    """The graph of customers with ids from 0 without gaps: customers, then orders."""
    n = _read(spark, d, "customer", "c_custkey").count()
    orders = _read(spark, d, "orders", "o_custkey", "o_orderkey")
    total = n + orders.count()
    edges = orders.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + n).alias("dst"))
    return Graph(symmetric(edges), spark.range(total).select(F.col("id").alias("v"))), total


def _folder(spark: SparkSession) -> str:
    """A place for files that all executors see."""
    return f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"


def _state(graph: Graph) -> DataFrame:
    return graph.vertices.select("v", F.col("v").alias("label"))


def _local(graph: Graph) -> DataFrame:
    return P.local_component_labels(_both(graph), graph.vertices, PART)


def _starts(graph: Graph, n: int) -> DataFrame:
    return graph.vertices.select("v", start_time(F.col("v"), BETA, SEED, n).alias("start"))


def _clusters(spark: SparkSession, d: str) -> tuple[Graph, DataFrame, DataFrame, int]:
    graph = customers(spark, d)
    n = graph.vertices.count()
    both = cut(_both(graph))
    return graph, both, K.exponential_clusters(both, graph.vertices, BETA, SEED, n), n


def _min_mapping(both: DataFrame, vertices: DataFrame) -> DataFrame:
    return K.min_label_step(vertices.select("v", F.col("v").alias("label")), both).select("v", F.col("label").alias("cv"))


def _undo(spark: SparkSession, d: str) -> DataFrame:
    graph = parts(spark, d)
    both = _both(graph)
    first = _min_mapping(both, graph.vertices)
    quotient = K.quotient_edges(both, first)
    second = _min_mapping(quotient, K.endpoints(quotient))
    return C.compose([first, second])


def _split(spark: SparkSession, d: str) -> DataFrame:
    graph = customers(spark, d)
    both = _both(graph)
    heavy = E.high_degree(both, graph.vertices, 0.05)
    return C.component_labels_of_split(*C.split_high_degree(both, graph.vertices, heavy, PARTS - 1))


def _files(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        graph, n = _dense_customers(spark, d)
        path = _folder(spark)
        once = graph.edges.where(F.col("src") < F.col("dst"))
        if kind == "metis":
            writers.write_adjacency(graph, path)
            return readers.read_adjacency(spark, path).edges
        if kind == "metis_parts":
            size = -(-n // PARTS)
            writers.write_adjacency(graph, path, [max(0, min(size, n - k * size)) for k in range(PARTS)])
            return readers.read_adjacency_parts(spark, path)[0].edges
        if kind == "edgelist":
            writers.write_edge_list(once, n, path)
            return readers.read_edge_list(spark, path).edges
        if kind == "edgelist_parts":
            writers.write_edge_list_parts(once, n, PARTS, path)
            return readers.read_edge_list_parts(spark, path).edges
        if kind == "dispatch":
            writers.write_edge_list(once, n, path)
            return readers.load_graph(spark, readers.Source(input="edgefile", path=path)).edges
        writers.write_binary(once, n, f"{path}/edges.bin")
        return readers.read_binary(spark, f"{path}/edges.bin").edges

    return query


Query = Callable[[SparkSession, str], DataFrame]


def _of(graph: Callable[[SparkSession, str], Graph], op: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, d: op(graph(spark, d))


def _cc(graph: Callable[[SparkSession, str], Graph], strategy: str, **conf) -> Query:
    return lambda spark, d: component_labels(graph(spark, d), strategy, **conf)


def queries() -> dict[str, Query]:
    labels = lambda g: component_labels(g)
    return {
        # connected sets
        "cc_default": _cc(parts, "default"),
        "cc_sequential": _cc(customers, "sequential"),
        "cc_label_propagation": _cc(turns, "label_propagation"),
        "cc_shortcut": _cc(turns, "shortcut"),
        "cc_shortcut_heavy": _cc(turns, "shortcut", hitters=8),
        "cc_exponential": _cc(customers, "exponential", base=1000),
        "cc_exponential_bfs": _cc(customers, "exponential_bfs", base=1000),
        "cc_local_contraction": _cc(parts, "local_contraction", base=1000),
        "cc_parts_single": _of(customers, lambda g: C.component_labels_by_parts(_both(g), g.vertices, PART)),
        "cc_parts_twice": _of(customers, lambda g: C.component_labels_by_parts(_both(g), g.vertices, PART, "twice")),
        "cc_parts_local": _of(turns, lambda g: C.component_labels_by_parts(_both(g), g.vertices, PART, "local")),
        "component_sizes": _of(copies, lambda g: L.component_sizes(labels(g))),
        "component_size_histogram": _of(copies, lambda g: L.size_histogram(labels(g))),
        "component_count": _of(copies, lambda g: L.component_count(labels(g))),
        "same_component": lambda s, d: L.same_component(_asked(s, d), labels(parts(s, d))),
        "heavy_hitters": _of(customers, lambda g: K.heavy_labels(labels(g), 1000)),
        "top_k_labels": _of(customers, lambda g: L.top_labels(labels(g), 10)),
        "dense_labels": _of(copies, lambda g: L.dense_labels(labels(g))),
        # edges and vertices
        "edges_symmetric": _of(parts, _both),
        "edges_rebased": _of(parts, lambda g: E.rebase(g.edges)),
        "adjacency_lists": _of(customers, lambda g: E.adjacency_lists(_both(g))),
        "non_isolated_vertices": _of(parts, lambda g: E.non_isolated(g.vertices, _both(g))),
        "isolated_vertices": lambda s, d: E.isolated(parts(s, d).vertices, _both(_sparse(s, d))),
        "add_vertices": lambda s, d: E.add_vertices(customers(s, d).vertices, parts(s, d).vertices),
        "remove_vertices": lambda s, d: E.remove_vertices(parts(s, d).edges, parts(s, d).vertices, _heavy_lines(s, d))[0],
        "remove_vertices_left": lambda s, d: E.remove_vertices(parts(s, d).edges, parts(s, d).vertices, _heavy_lines(s, d))[1],
        "active_vertices": _of(parts, lambda g: K.endpoints(K.quotient_edges(_both(g), _min_mapping(_both(g), g.vertices)))),
        "is_adjacent": lambda s, d: E.adjacent(_asked(s, d), _both(parts(s, d))),
        "duplicate_edges": lambda s, d: E.duplicates(_read(s, d, "lineitem", "l_partkey", "l_suppkey").select(order_of("l_partkey").alias("src"), other_of("l_suppkey").alias("dst"))),
        "high_degree_vertices": _of(parts, lambda g: E.high_degree(_both(g), g.vertices, 0.2)),
        "sampled_neighborhood": _of(parts, lambda g: E.sample_neighbors(_both(g), 0.25, SEED)),
        "vertex_degree": _of(parts, lambda g: E.degrees(_both(g))),
        "graph_size": _of(parts, lambda g: E.graph_size(g.edges, g.vertices)),
        "sorted_edges": _of(parts, lambda g: E.by_source(g.edges)),
        "neighbor_messages": _of(parts, lambda g: E.neighbor_messages(_both(g), _state(g))),
        "relink_edges": lambda s, d: E.relink(parts(s, d).edges, _renamed(s, d)),
        "remove_edges": lambda s, d: E.remove(parts(s, d).edges, _read(s, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").where("l_returnflag = 'R'").select(order_of("l_orderkey").alias("src"), other_of("l_partkey").alias("dst"))),
        "bfs_reach": lambda s, d: E.breadth_first(_both(parts(s, d)), 0),
        # parts
        "ghost_vertices": _of(parts, lambda g: P.ghosts(_both(g), PART)),
        "cut_edges": _of(parts, lambda g: P.cut_edges(_both(g), PART)),
        "interface_vertices": _of(turns, lambda g: P.interface(_both(g), PART)),
        "interior_vertices": _of(customers, lambda g: P.interior(_both(g), g.vertices, PART)),
        "adjacent_partitions": _of(parts, lambda g: P.adjacent_parts(_both(g), PART)),
        "local_ids": _of(parts, lambda g: P.local_ids(g.vertices, PART)),
        "vertex_owner": _of(parts, lambda g: P.owners(g.vertices, P.ranges(g.vertices, PARTS))),
        "vertex_owner_equal": _of(parts, lambda g: P.owners_of_equal_ranges(g.vertices, PARTS)),
        "part_vertices": _of(customers, lambda g: P.part_vertices(_both(g), g.vertices, PART)),
        "partition_stats": _of(parts, lambda g: P.part_stats(_both(g), g.vertices, PART)),
        "graph_params": _of(parts, lambda g: P.graph_params(_both(g), g.vertices, PART)),
        "avg_max_degree": _of(parts, lambda g: P.mean_max_degree(_both(g), g.vertices, PART, PARTS)),
        "partition_ranges": _of(parts, lambda g: P.part_ranges(_both(g), PART)),
        "comm_volume": _of(parts, lambda g: P.message_volume(_both(g), PART)),
        "local_component_labels": _of(customers, _local),
        "component_prefix_sum": _of(customers, lambda g: L.component_prefix_sum(_local(g))),
        "cag": _of(customers, lambda g: C.component_graph(_both(g), _local(g))),
        "local_contraction_graph": _of(customers, lambda g: C.local_contraction_graph(_both(g), _local(g), PART)),
        "ghost_component_map": _of(customers, lambda g: C.ghost_component_labels(_both(g), _local(g), PART)),
        "largest_interface_component": _of(customers, lambda g: C.largest_interface_component(_both(g), _local(g), PART)),
        # steps of algorithms
        "min_label_step": _of(parts, lambda g: K.min_label_step(_state(g), _both(g))),
        "pointer_jump": _of(parts, lambda g: K.pointer_jump_step(K.min_label_step(_state(g), _both(g)))),
        "start_times": _of(parts, lambda g: _starts(g, 1000)),
        "shift_step": _of(parts, lambda g: K.shift_step(_starts(g, 1000).select("v", F.col("start").alias("deviate"), F.col("v").alias("label")), _both(g))),
        "exp_clusters": lambda s, d: _clusters(s, d)[2],
        "cluster_parents": lambda s, d: (lambda g, both, state, n: L.cluster_parents(state, both, _starts(g, n)))(*_clusters(s, d)),
        "label_shortcuts": lambda s, d: (lambda g, both, state, n: L.label_shortcuts(state, L.cluster_parents(state, both, _starts(g, n)), PART))(*_clusters(s, d)),
        "two_hop_min": _of(customers, lambda g: K.two_hop_min(_both(g), g.vertices, SEED)),
        "quotient_edges": _of(parts, lambda g: K.quotient_edges(_both(g), _min_mapping(_both(g), g.vertices))),
        "project_back": _of(copies, lambda g: K.project_back(_min_mapping(_both(g), g.vertices), component_labels(g))),
        "undo_mapping": _undo,
        "split_high_degree": _split,
        "run_statistics": lambda s, d: L.run_statistics(_read(s, d, "events", "event_type", "value"), "event_type", "value"),
        # files and generators
        "src_metis": _files("metis"),
        "src_metis_parts": _files("metis_parts"),
        "src_edgelist": _files("edgelist"),
        "src_edgelist_parts": _files("edgelist_parts"),
        "src_binary": _files("binary"),
        "src_dispatch": _files("dispatch"),
        "gen_dispatch": lambda s, d: readers.load_graph(s, readers.Source(gen="grid_2d", n=60, m=40)).edges,
        "gen_grid_2d": lambda s, d: generators.grid_2d(s, 60, 40).edges,
        "gen_grid_2d_thinned": lambda s, d: generators.grid_2d(s, 60, 40, p=0.7, seed=SEED).edges,
        "gen_grid_2d_periodic": lambda s, d: generators.grid_2d(s, 60, 40, periodic=True).edges,
        "gen_rgg": lambda s, d: generators.rgg(s, 2000, 0.03).edges,
        "gen_rgg_3d": lambda s, d: generators.rgg(s, 2000, 0.08, 3).edges,
        "gen_gnm": lambda s, d: generators.gnm(s, 5000, 20000).edges,
        "gen_rhg": lambda s, d: generators.rhg(s, 2000).edges,
        "gen_ba": lambda s, d: generators.ba(s, 5000, 4).edges,
        "gen_rdg": lambda s, d: generators.rdg(s, 2000).edges,
        "gen_rdg_small": lambda s, d: generators.rdg(s, 60).edges,
        "gen_rdg_3d": lambda s, d: generators.rdg(s, 1000, 3).edges,
    }


# --- the same in SQL -----------------------------------------------------------------------------------------------

_EDGES = {
    "parts": "SELECT DISTINCT l_orderkey*2 AS src, l_partkey*2+1 AS dst FROM lineitem",
    "customers": "SELECT o_custkey*2 AS src, o_orderkey*2+1 AS dst FROM orders",
    "turns": "SELECT a.conv_id*10000+a.turn AS src, b.conv_id*10000+b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn+1",
    "copies": "SELECT min(doc_id) OVER (PARTITION BY text) AS src, doc_id AS dst FROM documents",
}
_VERTICES = {
    "parts": "SELECT o_orderkey*2 AS v FROM orders UNION ALL SELECT p_partkey*2+1 FROM part",
    "customers": "SELECT c_custkey*2 AS v FROM customer UNION ALL SELECT o_orderkey*2+1 FROM orders",
    "turns": "SELECT conv_id*10000+turn AS v FROM conversations",
    "copies": "SELECT doc_id AS v FROM documents",
}
_CC = """cc(v,label) USING KEY (v) AS (
  SELECT DISTINCT v, v FROM vs
  UNION
  SELECT b.dst, min(cc.label) FROM cc JOIN b ON cc.v=b.src JOIN recurring.cc r ON r.v=b.dst WHERE cc.label<r.label GROUP BY b.dst)"""
_PE = lambda v: f"(({v}) // 2) % {PARTS}"
_LOCAL = f"""lb AS (SELECT {_PE('src')} AS p, src AS a, dst AS z FROM b UNION SELECT {_PE('src')}, dst, src FROM b),
lc(p,v,label) USING KEY (p,v) AS (
  SELECT DISTINCT * FROM (SELECT p, a AS v, a AS label FROM lb UNION ALL SELECT {_PE('v')}, v, v FROM vs)
  UNION
  SELECT lb.p, lb.z, min(lc.label) FROM lc JOIN lb ON lc.p=lb.p AND lc.v=lb.a JOIN recurring.lc r ON r.p=lb.p AND r.v=lb.z WHERE lc.label<r.label GROUP BY lb.p, lb.z),
loc AS (SELECT p AS pe, v, min(v) OVER (PARTITION BY p, label) AS label FROM lc WHERE {_PE('v')}=p)"""
_R = "2147483646e0"
_MULTIPLIED = "((((v % 4294967296) + {s}) % 4294967296) % 2147483647)"


def _start_sql(n: str) -> str:
    s = _MULTIPLIED.format(s=SEED)
    return f"""x0 AS (SELECT v, CASE WHEN {s}=0 THEN 1 ELSE {s} END AS x FROM vs),
x1 AS (SELECT v, (x*16807)%2147483647 AS x1, (((x*16807)%2147483647)*16807)%2147483647 AS x2 FROM x0),
st AS (SELECT v, CAST(floor(-ln(1-(CAST(x1-1 AS DOUBLE)+CAST(x2-1 AS DOUBLE)*{_R})/({_R}*{_R}))/{BETA}) AS BIGINT) AS start FROM x1)"""


_EXP = """ec(v,k) USING KEY (v) AS (
  SELECT v, struct_pack(d:=start,l:=v) FROM st
  UNION
  SELECT b.dst, min(struct_pack(d:=ec.k.d+1,l:=ec.k.l)) FROM ec JOIN b ON ec.v=b.src JOIN recurring.ec r ON r.v=b.dst
    WHERE struct_pack(d:=ec.k.d+1,l:=ec.k.l)<r.k GROUP BY b.dst)"""
_PARENT = """par AS (SELECT o.v, min(CASE WHEN o.k.l=o.v AND o.k.d=st.start THEN o.v ELSE b.src END) AS parent
  FROM ec o JOIN st USING (v) LEFT JOIN (SELECT b.src, b.dst, s.k.d+1 AS d, s.k.l AS l FROM b JOIN ec s ON b.src=s.v) b ON b.dst=o.v AND b.d=o.k.d AND b.l=o.k.l GROUP BY o.v)"""


def _sql(graph: str, body: str, *more: str, recursive: bool = False) -> str:
    ctes = [f"e AS ({_EDGES[graph]})", "b AS (SELECT src,dst FROM e UNION ALL SELECT dst,src FROM e)", f"vs AS ({_VERTICES[graph]})", *more]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + f"\n{body}"


def _hashed_sql(a: str, b: str, seed: int) -> str:
    return f"(((((({a})%2147483647)*48271+(({b})%2147483647)*16807+{seed})%2147483647)*16807)%2147483647*16807)%2147483647"


def _mixed_ctes(source: str, salts: int, seed: int = 1) -> str:
    """Tables m0, m1, ... that add to the ids ``v`` of a table the numbers x0, x1, ..."""
    out, of = [], source
    for k in range(salts):
        out.append(f"a{k} AS (SELECT *, {_hashed_sql('v', str(7919 * (k + 1)), seed)} AS a{k} FROM {of})")
        out.append(f"b{k} AS (SELECT *, {_hashed_sql(f'(a{k}*a{k})%2147483647+v', str(104729 + k), seed + k)} AS b{k} FROM a{k})")
        out.append(f"m{k} AS (SELECT *, (b{k}*((a{k}+12345)%2147483647))%2147483647 AS x{k} FROM b{k})")
        of = f"m{k}"
    return ", ".join(out)


def _both_ways(pairs: str) -> str:
    return f"SELECT src, dst FROM ({pairs}) UNION ALL SELECT dst, src FROM ({pairs})"


def _rgg_sql(n: int, r: float, dimensions: int) -> str:
    away = "+".join(f"(p.x{k}/2147483647e0-q.x{k}/2147483647e0)*(p.x{k}/2147483647e0-q.x{k}/2147483647e0)" for k in range(dimensions))
    near = f"SELECT p.v AS src, q.v AS dst FROM m{dimensions - 1} p JOIN m{dimensions - 1} q ON p.v<q.v WHERE 0e0+{away}<={r}*CAST({r} AS DOUBLE)"
    return f"WITH v0 AS (SELECT range AS v FROM range({n})), {_mixed_ctes('v0', dimensions)}, near AS MATERIALIZED ({near}) {_both_ways('SELECT * FROM near')}"


def _rhg_sql(n: int, gamma: float = 2.8, degree: float = 8) -> str:
    alpha = (gamma - 1) / 2
    radius = 2 * math.log(2 * n * (alpha / (alpha - 0.5)) ** 2 / (math.pi * degree))
    points = f"SELECT v, least(acosh(1+x1/2147483647e0*{math.cosh(alpha * radius) - 1!r}::DOUBLE)/{alpha!r}::DOUBLE, {radius!r}::DOUBLE) AS r, x2/2147483647e0*{2 * math.pi!r}::DOUBLE AS t FROM m2"
    near = f"SELECT a.v AS src, b.v AS dst FROM p a JOIN p b ON a.v<b.v WHERE cosh(a.r)*cosh(b.r)-sinh(a.r)*sinh(b.r)*cos(a.t-b.t)<={math.cosh(radius)!r}::DOUBLE"
    return f"WITH v0 AS (SELECT range AS v FROM range({n})), {_mixed_ctes('v0', 3)}, p AS MATERIALIZED ({points}), near AS MATERIALIZED ({near}) {_both_ways('SELECT * FROM near')}"


def _ba_sql(n: int, d: int, seed: int = 1) -> str:
    big = "18446744073709551616::UHUGEINT"
    scramble = lambda x, places, factor: f"(xor({x}, {x}//{1 << places}::UHUGEINT)*{factor}::UHUGEINT)%{big}"
    ends = f"e//{d}, s//2//{d}"
    return f"""WITH RECURSIVE c(e,s) AS (SELECT range, 2*range+1 FROM range({n * d}) UNION ALL
  SELECT e, CAST(xor(x2, x2//{1 << 31}::UHUGEINT)%s::UHUGEINT AS BIGINT) FROM (SELECT *, {scramble('x1', 27, 0x94D049BB133111EB)} AS x2 FROM (SELECT *, {scramble('x0', 30, 0xBF58476D1CE4E5B9)} AS x1 FROM (
    SELECT e, s, (s::UHUGEINT+{seed * 0x9E3779B97F4A7C15 % (1 << 64)}::UHUGEINT)%{big} AS x0 FROM c WHERE s%2=1)))),
k AS MATERIALIZED (SELECT DISTINCT least({ends}) AS src, greatest({ends}) AS dst FROM c WHERE s%2=0 AND e//{d}<>s//2//{d}) {_both_ways('SELECT * FROM k')}"""


def _delaunay_sql(n: int) -> str:
    """Edges of the triangles whose circles hold no other point."""
    points = "SELECT v, x0/2147483647e0 AS x, x1/2147483647e0 AS y FROM m1"
    row = lambda p: (f"({p}.x-d.x)", f"({p}.y-d.y)", f"(({p}.x-d.x)*({p}.x-d.x)+({p}.y-d.y)*({p}.y-d.y))")
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = map(row, "abc")
    inside = f"({ax}*({by}*{cz}-{bz}*{cy})-{ay}*({bx}*{cz}-{bz}*{cx})+{az}*({bx}*{cy}-{by}*{cx}))*((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))>0"
    held = f"SELECT DISTINCT a.v AS a, b.v AS b, c.v AS c FROM p a JOIN p b ON a.v<b.v JOIN p c ON b.v<c.v JOIN p d ON d.v NOT IN (a.v, b.v, c.v) WHERE {inside}"
    free = "SELECT a.v AS a, b.v AS b, c.v AS c FROM p a JOIN p b ON a.v<b.v JOIN p c ON b.v<c.v EXCEPT SELECT a, b, c FROM held"
    edges = "SELECT a AS src, b AS dst FROM free UNION SELECT b, c FROM free UNION SELECT a, c FROM free"
    return f"WITH v0 AS (SELECT range AS v FROM range({n})), {_mixed_ctes('v0', 2)}, p AS MATERIALIZED ({points}), held AS MATERIALIZED ({held}), free AS MATERIALIZED ({free}), k AS MATERIALIZED ({edges}) {_both_ways('SELECT * FROM k')}"


def oracle_sql() -> dict[str, str]:
    cc = lambda g, body: _sql(g, body, _CC, recursive=True)
    local = lambda g, body, *more: _sql(g, body, _LOCAL, *more, recursive=True)
    crossing = f"{_PE('src')}<>{_PE('dst')}"
    labels = "SELECT v, label FROM cc"
    asked = "SELECT o_orderkey*2 AS a, o_custkey*2+1 AS b FROM orders"
    step = "ms AS (SELECT vs.v, least(vs.v, coalesce(min(b.src), vs.v)) AS label FROM vs LEFT JOIN b ON b.dst=vs.v GROUP BY vs.v)"
    q1 = "q AS (SELECT DISTINCT x.label AS src, y.label AS dst FROM b JOIN ms x ON b.src=x.v JOIN ms y ON b.dst=y.v WHERE x.label<>y.label)"
    q2 = "m2 AS (SELECT src AS v, least(src, min(dst)) AS cv FROM q GROUP BY src)"
    starts = _start_sql("1000")
    dense = "n AS (SELECT count(*) AS n FROM customer), d AS (SELECT o_custkey AS src, o_orderkey+n AS dst FROM orders, n)"
    dense_edges = f"WITH {dense} SELECT src, dst FROM d UNION ALL SELECT dst, src FROM d"
    s = f"CASE WHEN {_MULTIPLIED.format(s=SEED)}=0 THEN 1 ELSE {_MULTIPLIED.format(s=SEED)} END"
    hop0 = f"h0 AS (SELECT v, (((({s})*16807)%2147483647)*16807)%2147483647%100 AS d, v AS l FROM vs)"
    hop = lambda a, z: f"{z} AS (SELECT v, arg_min(d, (d,l)) AS d, arg_min(l, (d,l)) AS l FROM (SELECT v,d,l FROM {a} UNION ALL SELECT b.dst, {a}.d, {a}.l FROM b JOIN {a} ON b.src={a}.v) GROUP BY v)"
    stats = f"""ps AS (SELECT {_PE('vs.v')} AS pe, count(*) AS n, CAST(coalesce(sum(m),0) AS BIGINT) AS m, CAST(coalesce(sum(c),0) AS BIGINT) AS cut, coalesce(max(m),0) AS max_degree
  FROM vs LEFT JOIN (SELECT src, count(*) AS m, count(*) FILTER (WHERE {crossing}) AS c FROM b GROUP BY src) x ON x.src=vs.v GROUP BY 1)"""
    grid = "WITH g AS (SELECT range AS v FROM range(2400)), e AS (SELECT v AS src, v+1 AS dst FROM g WHERE v%40<39 UNION ALL SELECT v, v+40 FROM g WHERE v<2360) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"
    out = {
        "cc_default": cc("parts", labels),
        "cc_sequential": cc("customers", labels),
        "cc_label_propagation": cc("turns", labels),
        "cc_shortcut": cc("turns", labels),
        "cc_shortcut_heavy": cc("turns", labels),
        "cc_exponential": cc("customers", labels),
        "cc_exponential_bfs": cc("customers", labels),
        "cc_local_contraction": cc("parts", labels),
        "cc_parts_single": cc("customers", labels),
        "cc_parts_twice": cc("customers", labels),
        "cc_parts_local": cc("turns", labels),
        "component_sizes": cc("copies", "SELECT label, count(*) AS size FROM cc GROUP BY label"),
        "component_size_histogram": cc("copies", "SELECT size, count(*) AS num FROM (SELECT count(*) AS size FROM cc GROUP BY label) GROUP BY size"),
        "component_count": cc("copies", "SELECT count(*) FILTER (WHERE size>1) AS num_nontrivial, count(*) AS num_all FROM (SELECT count(*) AS size FROM cc GROUP BY label)"),
        "same_component": cc("parts", f"SELECT a, p.b AS b, coalesce(x.label=y.label,false) AS same FROM ({asked}) p LEFT JOIN cc x ON x.v=p.a LEFT JOIN cc y ON y.v=p.b"),
        "heavy_hitters": cc("customers", "SELECT label, count(*) AS cnt FROM cc GROUP BY label HAVING count(*)*1000 > (SELECT count(*) FROM cc)"),
        "top_k_labels": cc("customers", "SELECT label, count(*) AS cnt FROM cc GROUP BY label ORDER BY cnt DESC, label LIMIT 10"),
        "dense_labels": cc("copies", "SELECT v, CAST(dense_rank() OVER (ORDER BY label)-1 AS BIGINT) AS dense FROM cc"),
        "edges_symmetric": _sql("parts", "SELECT src, dst FROM b"),
        "edges_rebased": _sql("parts", "SELECT src-1 AS src, dst-1 AS dst FROM e"),
        "adjacency_lists": _sql("customers", "SELECT src AS v, list_sort(list(dst)) AS neighbors FROM b GROUP BY src"),
        "non_isolated_vertices": _sql("parts", "SELECT v FROM vs WHERE v IN (SELECT src FROM b)"),
        "isolated_vertices": _sql("parts", "SELECT v FROM vs WHERE v NOT IN (SELECT l_orderkey*2 FROM lineitem WHERE l_quantity>=49 UNION SELECT l_partkey*2+1 FROM lineitem WHERE l_quantity>=49)"),
        "add_vertices": f"SELECT v FROM ({_VERTICES['customers']}) UNION SELECT v FROM ({_VERTICES['parts']})",
        "remove_vertices": _sql("parts", "SELECT src, dst FROM e WHERE src NOT IN (SELECT l_orderkey*2 FROM lineitem WHERE l_quantity>=50)"),
        "remove_vertices_left": _sql("parts", "SELECT v FROM vs WHERE v NOT IN (SELECT l_orderkey*2 FROM lineitem WHERE l_quantity>=50)"),
        "active_vertices": _sql("parts", "SELECT src AS v FROM q UNION SELECT dst FROM q", step, q1),
        "is_adjacent": _sql("parts", f"SELECT a, p.b AS b, EXISTS (SELECT 1 FROM b x WHERE x.src=p.a AND x.dst=p.b) AS adjacent FROM ({asked}) p"),
        "duplicate_edges": "SELECT l_partkey*2 AS src, l_suppkey*2+1 AS dst, count(*) AS times FROM lineitem GROUP BY 1,2 HAVING count(*)>1",
        "high_degree_vertices": _sql("parts", "SELECT src AS v, count(*) AS degree FROM b GROUP BY src HAVING count(*) >= (SELECT floor(0.2*sqrt(CAST(count(*) AS DOUBLE))) FROM vs)"),
        "sampled_neighborhood": _sql("parts", f"SELECT src, dst FROM b WHERE ((((src%2147483647)*48271+(dst%2147483647)*16807+{SEED})%2147483647*16807)%2147483647*16807)%2147483647 < {int(0.25 * 2147483647)}"),
        "vertex_degree": _sql("parts", "SELECT src AS v, count(*) AS degree FROM b GROUP BY src"),
        "graph_size": _sql("parts", "SELECT (SELECT count(*) FROM vs) AS n, count(*) AS m FROM (SELECT DISTINCT least(src,dst), greatest(src,dst) FROM e)"),
        "sorted_edges": _sql("parts", "SELECT src, dst FROM e ORDER BY src, dst"),
        "neighbor_messages": _sql("parts", "SELECT dst AS v, src AS sender, src AS label FROM b"),
        "relink_edges": _sql("parts", "SELECT src, p.new AS dst FROM e JOIN (SELECT p_partkey*2+1 AS v, min(p_partkey) OVER (PARTITION BY p_brand)*2+1 AS new FROM part) p ON p.v=e.dst"),
        "remove_edges": _sql("parts", "SELECT src, dst FROM e WHERE (src,dst) NOT IN (SELECT (l_orderkey*2, l_partkey*2+1) FROM lineitem WHERE l_returnflag='R')"),
        "bfs_reach": _sql("parts", "SELECT v, distance FROM bf", """bf(v,distance) USING KEY (v) AS (SELECT DISTINCT src, CAST(0 AS BIGINT) FROM b WHERE src=0
  UNION SELECT b.dst, min(bf.distance)+1 FROM bf JOIN b ON bf.v=b.src LEFT JOIN recurring.bf r ON r.v=b.dst WHERE r.v IS NULL GROUP BY b.dst)""", recursive=True),
        "ghost_vertices": _sql("parts", f"SELECT DISTINCT {_PE('src')} AS pe, dst AS v, {_PE('dst')} AS owner FROM b WHERE {crossing}"),
        "cut_edges": _sql("parts", f"SELECT src, dst FROM b WHERE {crossing}"),
        "interface_vertices": _sql("turns", f"SELECT DISTINCT src AS v FROM b WHERE {crossing}"),
        "interior_vertices": _sql("customers", f"SELECT v FROM vs WHERE v NOT IN (SELECT src FROM b WHERE {crossing})"),
        "adjacent_partitions": _sql("parts", f"SELECT DISTINCT {_PE('src')} AS pe, {_PE('dst')} AS other FROM b WHERE {crossing}"),
        "local_ids": _sql("parts", f"SELECT v, {_PE('v')} AS pe, row_number() OVER (PARTITION BY {_PE('v')} ORDER BY v)-1 AS local_id FROM vs"),
        "vertex_owner": _sql("parts", f"SELECT v, v // (SELECT CAST(ceil((max(v)+1)/{PARTS}.0) AS BIGINT) FROM vs) AS pe FROM vs"),
        "vertex_owner_equal": _sql("parts", f"SELECT v, v // (SELECT CAST(ceil((max(v)+1)/{PARTS}.0) AS BIGINT) FROM vs) AS pe FROM vs"),
        "part_vertices": _sql("customers", f"SELECT {_PE('v')} AS pe, v, false AS ghost FROM vs UNION ALL SELECT DISTINCT {_PE('src')}, dst, true FROM b WHERE {crossing}"),
        "partition_stats": _sql("parts", "SELECT pe, n, m, cut, max_degree FROM ps", stats),
        "graph_params": _sql("parts", "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(m)//2 AS BIGINT) AS m, min(cut) AS min_cut, max(cut) AS max_cut, max(max_degree) AS max_degree FROM ps", stats),
        "avg_max_degree": _sql("parts", f"SELECT CAST(sum(max_degree)//{PARTS} AS BIGINT) AS avg_max_degree FROM ps", stats),
        "partition_ranges": _sql("parts", f"""SELECT f.pe, f.a AS first_v, f.z AS last_v, min(b.dst) AS first_dst, max(b.dst) AS last_dst
  FROM (SELECT {_PE('src')} AS pe, min(src) AS a, max(src) AS z FROM b GROUP BY 1) f JOIN b ON b.src=f.a GROUP BY f.pe, f.a, f.z"""),
        "comm_volume": _sql("parts", f"SELECT pe, other, count(*) AS messages FROM (SELECT DISTINCT {_PE('src')} AS pe, {_PE('dst')} AS other, src FROM b WHERE {crossing}) GROUP BY pe, other"),
        "local_component_labels": local("customers", "SELECT pe, v, label FROM loc"),
        "component_prefix_sum": local("customers", """SELECT pe, n_labels, CAST(coalesce(sum(n_labels) OVER (ORDER BY pe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS "offset", CAST(sum(n_labels) OVER () AS BIGINT) AS total
  FROM (SELECT pe, count(DISTINCT label) AS n_labels FROM loc GROUP BY pe)"""),
        "cag": local("customers", "SELECT DISTINCT x.label AS src, y.label AS dst FROM b JOIN loc x ON b.src=x.v JOIN loc y ON b.dst=y.v WHERE x.label<>y.label"),
        "local_contraction_graph": local("customers", "SELECT DISTINCT x.cv AS src, y.cv AS dst FROM b JOIN cm x ON b.src=x.v JOIN cm y ON b.dst=y.v WHERE x.cv<>y.cv", f"cm AS (SELECT v, CASE WHEN v IN (SELECT src FROM b WHERE {crossing}) THEN v ELSE label END AS cv FROM loc)"),
        "ghost_component_map": local("customers", f"SELECT DISTINCT {_PE('b.src')} AS pe, b.dst AS v, loc.label AS cv FROM b JOIN loc ON loc.v=b.dst WHERE {crossing}"),
        "largest_interface_component": local("customers", f"""SELECT pe, other, cv, cnt FROM (SELECT *, row_number() OVER (PARTITION BY pe, other ORDER BY cnt DESC, cv) AS k FROM (
  SELECT loc.pe, i.other, loc.label AS cv, count(*) AS cnt FROM (SELECT DISTINCT src, {_PE('dst')} AS other FROM b WHERE {crossing}) i JOIN loc ON loc.v=i.src GROUP BY ALL)) WHERE k=1"""),
        "min_label_step": _sql("parts", "SELECT v, label FROM ms", step),
        "pointer_jump": _sql("parts", "SELECT a.v, least(a.label, coalesce(r.label,a.label)) AS label FROM ms a LEFT JOIN ms r ON r.v=a.label", step),
        "start_times": _sql("parts", "SELECT v, start FROM st", starts.replace("{s}", str(SEED))),
        "shift_step": _sql("parts", "SELECT v, arg_min(d, (d,l)) AS deviate, arg_min(l, (d,l)) AS label FROM (SELECT v, start AS d, v AS l FROM st UNION ALL SELECT b.dst, st.start+1, st.v FROM b JOIN st ON b.src=st.v) GROUP BY v", starts),
        "exp_clusters": _sql("customers", "SELECT v, k.d AS deviate, k.l AS label FROM ec", starts, _EXP, recursive=True),
        "cluster_parents": _sql("customers", "SELECT v, parent FROM par", starts, _EXP, _PARENT, recursive=True),
        "label_shortcuts": _sql("customers", f"SELECT {_PE('ec.v')} AS pe, ec.k.l AS label, arg_min(parent, (ec.k.d, ec.v)) AS parent FROM ec JOIN par ON par.v=ec.v GROUP BY 1,2", starts, _EXP, _PARENT, recursive=True),
        "two_hop_min": _sql("customers", "SELECT v, d AS deviate, l AS label FROM h2", hop0, hop("h0", "h1"), hop("h1", "h2")),
        "quotient_edges": _sql("parts", "SELECT src, dst FROM q", step, q1),
        "project_back": _sql("copies", "SELECT ms.v, coalesce(cc.label, ms.label) AS label FROM ms LEFT JOIN cc ON cc.v=ms.label", _CC, step, recursive=True),
        "undo_mapping": _sql("parts", "SELECT ms.v, coalesce(m2.cv, ms.label) AS cv FROM ms LEFT JOIN m2 ON m2.v=ms.label", step, q1, q2),
        "split_high_degree": cc("customers", labels),
        "run_statistics": "SELECT event_type, count(value) AS runs, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS deviation FROM events GROUP BY event_type",
        "gen_grid_2d": grid, "gen_dispatch": grid,
        "gen_grid_2d_thinned": f"WITH g AS (SELECT range AS v FROM range(2400)), e AS (SELECT v AS src, v+1 AS dst FROM g WHERE v%40<39 UNION ALL SELECT v, v+40 FROM g WHERE v<2360), k AS (SELECT * FROM e WHERE {_hashed_sql('src', 'dst', SEED)}<{int(0.7 * 2147483647)}) {_both_ways('SELECT * FROM k')}",
        "gen_grid_2d_periodic": "WITH g AS (SELECT range AS v FROM range(2400)), e AS (SELECT v AS src, v//40*40+(v+1)%40 AS dst FROM g UNION ALL SELECT v, (v+40)%2400 FROM g) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e",
        "gen_rgg": _rgg_sql(2000, 0.03, 2),
        "gen_rhg": _rhg_sql(2000),
        "gen_ba": _ba_sql(5000, 4),
        "gen_rdg_small": _delaunay_sql(60),
        "gen_rgg_3d": _rgg_sql(2000, 0.08, 3),
        "gen_gnm": f"WITH v0 AS (SELECT range AS v FROM range({int(1.2 * 20000) + 64})), {_mixed_ctes('v0', 2)}, k AS MATERIALIZED (SELECT least(x0%5000,x1%5000) AS src, greatest(x0%5000,x1%5000) AS dst, min(v) AS i FROM m1 WHERE x0%5000<>x1%5000 GROUP BY 1,2 ORDER BY i LIMIT 20000) {_both_ways('SELECT src, dst FROM k')}",
    }
    return out | {f"src_{kind}": dense_edges for kind in ("metis", "metis_parts", "edgelist", "edgelist_parts", "binary", "dispatch")}

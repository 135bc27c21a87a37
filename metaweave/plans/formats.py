"""Registered queries that write the order tables in each format and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaweave.functions import arrays as A
from metaweave.operators import accuracy as X
from metaweave.operators import compare as C
from metaweave.operators import hierarchy as H
from metaweave.operators import layout as G
from metaweave.operators import louvain as L
from metaweave.operators import metapath as M
from metaweave.operators import sketch as S
from metaweave.operators import validate as V
from metaweave.operators import weights as N
from metaweave.plans import queries as Q
from metaweave.plans.queries import query
from metaweave.plans.scratch import cut, scratch_path
from metaweave.sources import sinks, text
from metaweave.sources import tables as T
from metaweave.streaming import replay

_P = "p AS (SELECT l_suppkey AS s, l_partkey AS p, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2)"


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, weight``: how many lines of a part a supplier has."""
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return lines.select(F.concat(F.lit("S:"), "l_suppkey").alias("src"), F.concat(F.lit("P:"), "l_partkey").alias("dst"), "weight")


def homogeneous(spark, sf_dir) -> M.Homogeneous:
    edges = lines_of(spark, sf_dir)
    return M.Homogeneous(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges, None)


def _file(spark, df: DataFrame, tag: str) -> str:
    """The column ``value`` as a text file of the shared folder."""
    path = scratch_path(spark, tag)
    df.select("value").write.text(path)
    return path


_EDGES = f"WITH {_P} SELECT 'S:' || s AS src, 'P:' || p AS dst, w AS weight FROM p"


@query(_EDGES)
def s1_k2_edge_list(spark, sf_dir):
    path = scratch_path(spark, "edges.txt")
    sinks.write(homogeneous(spark, sf_dir), path)
    return text.read_edges(spark, path)


@query(_EDGES)
def s10_k3_plain_edge_list(spark, sf_dir):
    path = scratch_path(spark, "edges.edgelist")
    sinks.write(homogeneous(spark, sf_dir), path)
    return text.read_edges(spark, path, strict=False)


@query(_EDGES)
def k1_k4_csv(spark, sf_dir):
    path = scratch_path(spark, "edges.csv")
    sinks.write(homogeneous(spark, sf_dir), path)
    rows = spark.read.csv(path, header=True, schema="a string, b string, weight double")
    return rows.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")


@query(_EDGES)
def k5_json(spark, sf_dir):
    path = scratch_path(spark, "edges.json")
    sinks.write(homogeneous(spark, sf_dir), path)
    rows = spark.read.schema("kind string, src string, dst string, weight double").json(path)
    return rows.where("kind = 'edge'").drop("kind")


@query("SELECT (l_linenumber % 3)::INT AS level, 'S:' || l_suppkey AS src, 'P:' || l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2, 3")
def k6_level_edges(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("level"), F.concat(F.lit("S:"), "l_suppkey").alias("src"), F.concat(F.lit("P:"), "l_partkey").alias("dst"))
    path = scratch_path(spark, "levels")
    sinks.write_level_edges(lines.groupBy("level", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")), path)
    out = [text.read_edges(spark, f"{path}/level={i}").withColumn("level", F.lit(i)) for i in range(3)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("level", "src", "dst", "weight")


_NAMED = "SELECT 1 AS level, 'c0_l1_' || c_nationkey AS comm, 'C:' || c_custkey AS node FROM customer UNION ALL SELECT 2, 'c0_l2_' || n_regionkey, 'c0_l1_' || n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)"


def named_levels(spark, sf_dir) -> DataFrame:
    c, n = T.table(spark, sf_dir, "customer"), T.table(spark, sf_dir, "nation")
    one = c.select(F.concat(F.lit("c0_l1_"), "c_nationkey").alias("comm"), F.concat(F.lit("C:"), "c_custkey").alias("node"))
    n = n.join(c.select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    return one.unionAll(n.select(F.concat(F.lit("c0_l2_"), "n_regionkey").alias("comm"), F.concat(F.lit("c0_l1_"), "n_nationkey").alias("node")))


@query(_NAMED)
def s11_k7_mapping(spark, sf_dir):
    path = scratch_path(spark, "mapping")
    sinks.write_mapping(named_levels(spark, sf_dir), path)
    return text.read_mapping(spark, path).select("level", "comm", "node")


@query(f"SELECT level, comm AS parent, node AS child FROM ({_NAMED})")
def s12_k7_hierarchy(spark, sf_dir):
    path = scratch_path(spark, "hierarchy")
    sinks.write_hierarchy(named_levels(spark, sf_dir).withColumnsRenamed({"comm": "parent", "node": "child"}), path)
    return text.read_hierarchy(spark, path)


@query("SELECT max(r_name) AS root FROM region")
def s13_k7_root(spark, sf_dir):
    path, top = scratch_path(spark, "root"), T.table(spark, sf_dir, "region").agg(F.max("r_name").alias("r")).first()["r"]
    sinks.write_root(spark, top, path)
    return spark.createDataFrame([(text.read_root(spark, path),)], "root string")


@query(f"WITH {Q._SK.format(k=Q._K, k1=Q._K + 1)} SELECT node::VARCHAR AS node, ((node * 2654435761 + 12345) % 4294967291)::VARCHAR AS own, array_to_string(hs, ',') AS hashes FROM sk")
def s14_k8_sketches(spark, sf_dir):
    found, own = Q.customer_sketches(spark, sf_dir, Q._K)
    long = found.select("node", F.lit(0).alias("layer"), F.get("layers", F.lit(0)).alias("hashes"))
    path = scratch_path(spark, "sketches")
    sinks.write_sketches(long, own, Q._K, 1, path)
    return text.read_sketches(spark, path).select("node", Q.shown("own").alias("own"), Q.shown("hashes").alias("hashes"))


@query("WITH p AS (SELECT DISTINCT l_suppkey::VARCHAR AS a, 'x' || l_partkey AS b FROM lineitem) SELECT a AS src, b AS dst FROM p")
def k9_sketch_graph(spark, sf_dir):
    pairs = T.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("u"), F.concat(F.lit("x"), "l_partkey").alias("v")).distinct()
    path = scratch_path(spark, "pairs")
    sinks.write_sketch_graph(pairs, path)
    return text.read_edges(spark, path).where("dst <> '='").select("src", "dst")


@query(f"WITH {Q._MV} SELECT move, node::INT AS node, to_comm::INT AS to_comm FROM mv")
def s15_k10_move_log(spark, sf_dir):
    moves = Q.event_moves(spark, sf_dir)[0].select("move", "level", F.col("node").cast("int").alias("node"), F.col("to_comm").cast("int").alias("to_comm"))
    path = scratch_path(spark, "moves")
    sinks.write_moves(moves, path)
    return replay.read_moves(spark, path).select("move", "node", "to_comm")


@query("SELECT 'S:' || s_suppkey AS id, 'Type_' || s_nationkey AS type FROM supplier")
def s2_properties(spark, sf_dir):
    rows = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S:"), "s_suppkey", F.lit(" "), "s_nationkey").alias("value"))
    return text.read_properties(spark, _file(spark, rows, "properties"))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS s, 1000000 + l_partkey AS p FROM lineitem) SELECT s AS src, p AS dst FROM p UNION ALL SELECT p, s FROM p")
def s5_numbered_edges(spark, sf_dir):
    return text.read_numbered_edges(spark, numbered(spark, sf_dir))


def numbered(spark, sf_dir) -> str:
    pairs = T.table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") + 1000000).alias("p")).distinct()
    return _file(spark, pairs.select(F.concat_ws(" ", "l_suppkey", "p").alias("value")), "numbered")


@query(
    """WITH m AS (SELECT max(s_suppkey) AS m FROM supplier) SELECT i AS id, coalesce(s_nationkey, 0)::INT AS type FROM (SELECT unnest(range(m + 1)) AS i FROM m) LEFT JOIN supplier ON s_suppkey = i"""
)
def s6_numbered_types(spark, sf_dir):
    s = T.table(spark, sf_dir, "supplier")
    path = _file(spark, s.select(F.concat_ws(" ", "s_suppkey", "s_nationkey").alias("value")), "types")
    return text.read_numbered_types(spark, path, s.select(F.col("s_suppkey").alias("src"), F.col("s_suppkey").alias("dst")))


@query("SELECT node, array_to_string(list(DISTINCT other ORDER BY other), ',') AS others FROM (SELECT l_suppkey AS node, 1000000 + l_partkey AS other FROM lineitem UNION ALL SELECT 1000000 + l_partkey, l_suppkey FROM lineitem) GROUP BY 1")
def s19_distinct_adjacency(spark, sf_dir):
    return text.distinct_adjacency(spark, numbered(spark, sf_dir)).select("node", Q.shown("others").alias("others"))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM p) AS edges, (SELECT count(*) FROM (SELECT s FROM p UNION SELECT 1000000 + p FROM p)) AS distinct_ids")
def s18_s20_upload(spark, sf_dir):
    rows = T.table(spark, sf_dir, "supplier").select(F.concat_ws(" ", "s_suppkey", "s_nationkey").alias("value"))
    edges, types = numbered(spark, sf_dir), _file(spark, rows, "types")
    ids = text.normalised_edges(spark, edges)[1].agg(F.count(F.lit(1)).alias("distinct_ids"))
    return text.upload_summary(spark, edges, types, types).drop("bytes").crossJoin(ids)


def path_file(spark, sf_dir) -> str:
    regions = T.table(spark, sf_dir, "region").orderBy("r_regionkey")
    return _file(spark, regions.select(F.col("r_regionkey").cast("string").alias("value")), "path")


@query("SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INT AS at, 'Type_' || r_regionkey AS type FROM region")
def s3_path(spark, sf_dir):
    found = text.read_path(spark, path_file(spark, sf_dir)).node_types
    return spark.createDataFrame(list(enumerate(found)), "at int, type string")


@query("SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INT AS at, r_regionkey::INT AS type FROM region UNION ALL SELECT -1, 0")
def s7_numbered_path(spark, sf_dir):
    """The types of the file; at -1 those of a file that isn't there."""
    found = [*enumerate(text.read_numbered_path(spark, path_file(spark, sf_dir))), *((-1, t) for t in text.read_numbered_path(spark, scratch_path(spark, "none")))]
    return spark.createDataFrame(found, "at int, type int")


@query(
    f"""WITH {_P}, e AS (SELECT 'S:' || s AS a, 'P:' || p AS b, w FROM p)
        SELECT a AS src, b AS dst, 'Type_0_to_Type_1' AS etype, w AS weight FROM e UNION ALL SELECT b, a, 'Type_1_to_Type_0', w FROM e"""
)
def s4_three_files(spark, sf_dir):
    ends = [T.table(spark, sf_dir, t).select(F.concat(F.lit(f"{c}:"), key, F.lit(f" {i}")).alias("value")) for i, (t, c, key) in enumerate((("supplier", "S", "s_suppkey"), ("part", "P", "p_partkey")))]
    edges = scratch_path(spark, "edges.txt")
    sinks.write(homogeneous(spark, sf_dir), edges)
    graph, _ = text.load_graph(spark, edges, _file(spark, ends[0].unionAll(ends[1]), "properties"), path_file(spark, sf_dir), directed=False)
    return graph.edges.select("src", "dst", "etype", "weight")


#: Entries of one document where a format holds whole documents.
_DOCUMENT = 1000


def _documents(spark, rows: DataFrame, key: str, value, tag: str) -> str:
    """One text file for every ``_DOCUMENT`` keys, of what ``value`` makes of its rows."""
    part = F.floor(F.col(key) / _DOCUMENT).alias("part")
    path = scratch_path(spark, tag)
    rows.groupBy(part).agg(value.alias("value")).repartition("part").write.partitionBy("part").text(path)
    return path


def supplier_documents(spark, sf_dir):
    one, s = F.concat(F.lit("S:"), "s_suppkey"), T.table(spark, sf_dir, "supplier")
    node = F.struct(one.alias("key"), F.create_map(F.lit("type"), F.lit("supplier"), F.lit("name"), F.col("s_name")).alias("value"))
    edge = F.struct(one.alias("from"), F.concat(F.lit("N:"), "s_nationkey").alias("to"), F.lit("of").alias("type"), F.col("s_acctbal").cast("double").alias("weight"))
    whole = F.to_json(F.struct(F.map_from_entries(F.collect_list(node)).alias("nodes"), F.collect_list(edge).alias("edges")))
    return text.read_graph_json(spark, _documents(spark, s, "s_suppkey", whole, "graph-json"))


@query("SELECT 'S:' || s_suppkey AS id, 'supplier' AS type, s_name AS name FROM supplier")
def s8_graph_json_nodes(spark, sf_dir):
    return supplier_documents(spark, sf_dir).nodes.select("id", "type", F.col("props")["name"].alias("name"))


@query("SELECT 'S:' || s_suppkey AS src, 'N:' || s_nationkey AS dst, 'of' AS etype, s_acctbal::DOUBLE AS weight FROM supplier")
def s8_graph_json_edges(spark, sf_dir):
    return supplier_documents(spark, sf_dir).edges.select("src", "dst", "etype", "weight")


@query("SELECT (row_number() OVER (ORDER BY r_name) - 1)::INT AS at, r_name AS type, CASE WHEN r_name < (SELECT max(r_name) FROM region) THEN 'to_' || r_name END AS leaves_by FROM region")
def s9_meta_path_json(spark, sf_dir):
    names = F.array_sort(F.collect_list("r_name"))
    kinds = F.transform(F.slice(names, 1, F.size(names) - 1), lambda n: F.concat(F.lit("to_"), n))
    rows = T.table(spark, sf_dir, "region").agg(F.to_json(F.struct(F.lit("regions").alias("id"), names.alias("node_sequence"), kinds.alias("edge_sequence"))).alias("value"))
    found = text.read_meta_path_json(spark, _file(spark, rows.coalesce(1), "meta-path"))
    return spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(zip(found.node_types, [*found.edge_types, None]))], "at int, type string, leaves_by string")


@query("SELECT 'level_1' AS level, 'C:' || c_custkey AS id, c_acctbal::DOUBLE AS x, c_nationkey::DOUBLE AS y, 1.5::DOUBLE AS radius, (c_custkey / 4.0)::DOUBLE AS pagerank FROM customer")
def s16_levels_json(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    place = F.struct(F.col("c_acctbal").cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"), F.lit(1.5).alias("radius"), (F.col("c_custkey") / 4.0).alias("pagerank"))
    entry = F.struct(F.concat(F.lit("C:"), "c_custkey").alias("key"), place.alias("value"))
    whole = F.to_json(F.create_map(F.lit("level_1"), F.map_from_entries(F.collect_list(entry))))
    return text.read_levels_json(spark, _documents(spark, c, "c_custkey", whole, "levels-json"))


# ---------------------------------------------------------------- steps without a query of their own elsewhere


@query(f"WITH {Q._HA} SELECT c_custkey AS node, coalesce(comm, 0)::BIGINT AS comm FROM customer LEFT JOIN (SELECT node, comm FROM ha WHERE level = 2 AND comm < 7) ON node = c_custkey")
def c22b_flattened(spark, sf_dir):
    """The second level, from which communities 7 and above are taken away, so that their leaves miss one."""
    leaves = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return H.flattened(Q.customer_hierarchies(spark, sf_dir)[0].where("comm < 7"), leaves, 2)


@query(
    """WITH o AS (SELECT c_nationkey AS idx, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS a, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
       h AS (SELECT * FROM o WHERE a IS NOT NULL AND b IS NOT NULL),
       s AS (SELECT min(a) - 1e-10 AS la, min(b) - 1e-10 AS lb, sum(a) AS ta, sum(b) AS tb, count(*) AS n FROM h),
       w AS (SELECT abs(sum((a - la) / (ta - n * la) - (b - lb) / (tb - n * lb)) OVER (ORDER BY idx)) AS c FROM h, s)
       SELECT count(*) AS communities, round(avg(abs(a - b)), 2)::DOUBLE AS mae, (SELECT round(sum(c), 6) FROM w)::DOUBLE AS wasserstein,
              round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6)::DOUBLE AS cosine, round(corr(a, b), 6)::DOUBLE AS pearson FROM h"""
)
def x15_weight_distances(spark, sf_dir):
    """Order volume of the nations, open against filled."""
    o = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    side = lambda status: o.where(F.col("o_orderstatus") == status).select(F.col("c_nationkey").alias("comm"), F.col("o_totalprice").alias("weight"))
    return X.weight_distances(side("O"), side("F")).select("communities", F.round("mae", 2).alias("mae"), *Q.r6("wasserstein", "cosine", "pearson"))


def rule_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'blank type' AS rule, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 50 = 0")
def v2_node_rules(spark, sf_dir):
    return rule_counts(V.node_problems(Q.dirty_graph(spark, sf_dir).nodes))


@query(
    """WITH l AS (SELECT l_suppkey AS s, l_partkey AS p, l_quantity - 1.5 AS w FROM lineitem WHERE l_suppkey % 10 <> 0)
       SELECT 'unknown target' AS rule, count(*) AS n FROM l WHERE p % 7 = 0 UNION ALL SELECT 'negative weight', count(*) FROM l WHERE w < 0
       UNION ALL SELECT 'duplicate edge', count(*) - count(DISTINCT (s, p)) FROM l"""
)
def v3_edge_rules(spark, sf_dir):
    return rule_counts(V.edge_problems(Q.dirty_graph(spark, sf_dir)))


@query("SELECT 'S:' || s_suppkey AS id, 'supplier' AS type FROM supplier")
def v8_nodes_of_type(spark, sf_dir):
    return T.supply_graph(spark, sf_dir).nodes_of("supplier")


@query("SELECT count(*) AS n FROM lineitem WHERE NOT l_quantity - 25 >= 0")
def v14_invalid_weights(spark, sf_dir):
    edges = T.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") - 25).alias("weight"))
    return V.invalid_weights(edges).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {Q._SPS} SELECT DISTINCT src AS id FROM w")
def m13_node_set(spark, sf_dir):
    g = T.supply_graph(spark, sf_dir)
    return M.node_set(M.endpoints(g, T.SPS), T.SPS).select("id")


@query(f"WITH {Q._SPS} SELECT src, dst, weight FROM w WHERE weight >= (SELECT avg(weight) FROM w)")
def m19_above(spark, sf_dir):
    edges = cut(Q.sps(spark, sf_dir).edges, "ties")
    return N.above(edges, edges.agg(F.avg("weight")).first()[0] or 0.0)


@query(f"SELECT c_custkey AS node, 0 AS layer, {Q._HASH.format('c_custkey')} AS hash FROM customer")
def b1_owners(spark, sf_dir):
    return Q.customer_owners(spark, sf_dir)[0]


def sketch_column(spark, sf_dir) -> DataFrame:
    found, _ = Q.customer_sketches(spark, sf_dir, Q._K)
    return found.select("node", "layers", F.get("layers", F.lit(0)).alias("h"))


_S16 = Q._SK.format(k=Q._K, k1=Q._K + 1)


@query(f"WITH {_S16} SELECT node, len(hs) >= {Q._K} AS is_full, len(hs)::INT AS held FROM sk")
def b10_fullness(spark, sf_dir):
    return sketch_column(spark, sf_dir).select("node", A.full("layers", Q._K).alias("is_full"), F.size("h").alias("held"))


@query(f"WITH {_S16} SELECT node, round(CASE WHEN len(hs) >= {Q._K} THEN {Q._K - 1} * 4294967295.0::DOUBLE / hs[{Q._K}] ELSE len(hs) END, 4)::DOUBLE AS n FROM sk")
def b12_cardinality_of_the_reader(spark, sf_dir):
    return sketch_column(spark, sf_dir).select("node", F.round(A.cardinality_first("layers", Q._K), 4).alias("n"))


@query(f"WITH {_S16} SELECT node, round({Q._K - 1} * 4294967295.0::DOUBLE / hs[{Q._K}], 4) AS n FROM sk WHERE len(hs) >= {Q._K}")
def b13_cardinality_of_one_layer(spark, sf_dir):
    return sketch_column(spark, sf_dir).where(F.size("h") >= Q._K).select("node", F.round(A.cardinality_one("h", Q._K), 4).alias("n"))


@query(
    f"""WITH {_S16}, q AS (SELECT a.node, a.hs AS x, b.hs AS y FROM sk a JOIN sk b ON b.node = a.node + 1)
        SELECT node, array_to_string(list_sort(list_distinct(list_concat(x, y)))[1:{Q._K}], ',') AS merged, array_to_string(list_sort(list_intersect(x, y)), ',') AS common, len(list_intersect(x, y))::INT AS n FROM q"""
)
def b4_b5_b6_neighbours_merged(spark, sf_dir):
    s = sketch_column(spark, sf_dir)
    both = s.select("node", F.col("layers").alias("x")).join(s.select((F.col("node") - 1).alias("node"), F.col("layers").alias("y")), "node")
    first = lambda c: F.get(F.col(c), F.lit(0))
    merged = F.get(A.merge_layers("x", "y", Q._K), F.lit(0))
    return both.select("node", F.array_join(merged.cast("array<string>"), ",").alias("merged"), F.array_join(F.array_sort(A.common(first("x"), first("y"))).cast("array<string>"), ",").alias("common"), A.common_layers("x", "y").alias("n"))


@query(f"WITH {_S16} SELECT node, round(CASE WHEN len(hs) >= {Q._K} THEN {Q._K - 1} * 4294967295.0::DOUBLE / hs[{Q._K}] ELSE len(hs) END, 4)::DOUBLE AS degree FROM sk")
def b17_degrees(spark, sf_dir):
    return S.degrees(*Q.customer_sketches(spark, sf_dir, Q._K), Q._K).select("node", F.round("degree", 4).alias("degree"))


@query(f"WITH {Q._TIES} SELECT comm, tot FROM tot")
def b24_community_cardinality(spark, sf_dir):
    canon, assign = Q.ties_and_partition(spark, sf_dir)
    return S.community_cardinality(L.degrees(canon).withColumnRenamed("k", "degree"), assign)


@query(f"WITH {Q._HA} SELECT node, comm FROM ha WHERE level = 2 AND comm = 3")
def l18_g9_cluster_nodes(spark, sf_dir):
    return G.cluster_nodes(Q.customer_hierarchies(spark, sf_dir)[0], 2, 3).withColumn("comm", F.lit(3).cast("bigint"))


@query(f"WITH {Q._TIES} SELECT least(u, v) AS u, greatest(u, v) AS v FROM t")
def g8_simple_edges(spark, sf_dir):
    ties = T.supplier_ties(spark, sf_dir)
    return G.simple_edges(H.both_directions(ties))


@query(f"WITH {Q._RAND} SELECT round(r, 6)::DOUBLE AS rand, round((SELECT count(*) FROM (SELECT DISTINCT a, b FROM t)) , 6)::DOUBLE AS cells FROM q")
def c1_c9_cells(spark, sf_dir):
    a, b = Q.customer_partitions(spark, sf_dir)
    return C.rand_index(a, b).select(F.round("rand", 6).alias("rand")).crossJoin(C.contingency(a, b).agg(F.count(F.lit(1)).cast("double").alias("cells")))

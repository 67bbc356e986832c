"""Registered queries: each applies an operator to a graph in the tables. Names begin
with the operator's id. oracles.py has the same results as DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..lineage import cut, fresh_path
from ..operators import accounting, actions, dynamic, fixpoint, graph, layout, runs, verify
from ..sources import generators, readers, writers
from ..streaming import levels
from . import views
from .oracles import ORACLE  # noqa: F401
from .views import table

QUERIES: dict = {}
DIM_X = DIM_Y = 16


def query(f):
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, *columns: str, places: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _users(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("src").alias("id")).union(steps.select("dst")).distinct()


def _placed(spark, d):
    ids = views.parts(spark, d)
    return layout.place_cyclic(ids, 0, ids.count(), DIM_X, DIM_Y)


# fixpoint queries


@query
def gq01_bfs(spark: SparkSession, d: str) -> DataFrame:
    return fixpoint.bfs(views.part_graph(spark, d), 0, vertices=views.parts(spark, d))


@query
def gq01_bfs_unreached(spark, d):
    edges, ids = views.geo_graph(spark, d)
    return fixpoint.bfs(edges, 0, vertices=ids)


@query
def gq02_sssp(spark, d):
    return fixpoint.sssp(views.part_graph(spark, d), 0, vertices=views.parts(spark, d))


@query
def gq03_pagerank(spark, d):
    return _round(fixpoint.pagerank(views.part_graph(spark, d), views.parts(spark, d), 5), "score")


@query
def gq03_pagerank_leaking(spark, d):
    return _round(fixpoint.pagerank(*views.supply_graph(spark, d), 3), "score")


@query
def gq04_bfs_salted(spark, d):
    return fixpoint.bfs(views.part_graph(spark, d), 0, vertices=views.parts(spark, d), salt=4)


@query
def gq05_sssp_salted(spark, d):
    return fixpoint.sssp(views.part_graph(spark, d), 0, vertices=views.parts(spark, d), salt=4)


@query
def gq06_pagerank_two_phase(spark, d):
    return _round(fixpoint.pagerank(views.part_graph(spark, d), views.parts(spark, d), 5, salt=4), "score")


@query
def gq07_bfs_bounded(spark, d):
    return fixpoint.bfs(views.part_graph(spark, d), 0, max_hops=2, vertices=views.parts(spark, d))


@query
def gq07_deepening(spark, d):
    return fixpoint.deepening(views.part_graph(spark, d), 0, 3)


@query
def gq08_sssp_bounded(spark, d):
    return fixpoint.sssp(views.part_graph(spark, d), 0, max_hops=3, vertices=views.parts(spark, d))


@query
def gq09_pagerank_nested(spark, d):
    return _round(fixpoint.nested_pagerank(views.part_graph(spark, d), views.parts(spark, d), 2, 2), "score")


@query
def gq10_pagerank_given_start(spark, d):
    return _round(fixpoint.pagerank(views.part_graph(spark, d), views.parts(spark, d), 2, init=1.0), "score")


@query
def gq11_dynamic_bfs(spark, d):
    steps, root = views.user_increments(spark, d)
    steps = cut(steps)
    state = dynamic.GrowingLevels(spark, root)
    try:
        changes = [state.insert(steps.where(F.col("increment") == k).select("src", "dst")) for k in range(1, 11)]
    finally:
        state.close()
    changes[0] = changes[0].unionByName(dynamic.first_levels(spark, root))
    return dynamic.level_history(changes).select("increment", "id", "level")


def _stream(spark, d, relax=True):
    steps, root = views.user_increments(spark, d)
    steps = cut(steps.withColumn("weight", F.lit(1).cast("long")))
    folder = fresh_path(spark, "stream")
    for k in range(1, 11):  # one file each, in order of their times
        steps.where(F.col("increment") == k).select(F.col("src") + 1, F.col("dst") + 1, "weight").coalesce(1).write.mode("append").csv(f"{folder}/in", sep="\t")
    running, store = levels.stream_levels(spark, f"{folder}/in", root, f"{folder}/state", relax=relax)
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    return store


@query
def gq12_streaming_bfs(spark, d):
    return _stream(spark, d).history(10)


@query
def str07_deferred_bfs(spark, d):
    return levels.deferred(_stream(spark, d, relax=False), 10)


@query
def str06_ingest_only(spark, d):
    store = _stream(spark, d, relax=False)
    each = [store.edges(k + 1).agg(F.count("*").alias("edges")).select(F.lit(k + 1).cast("long").alias("increment"), "edges") for k in range(10)]
    return reduce(DataFrame.unionByName, each)


@query
def gq13_bfs_reached_only(spark, d):
    return fixpoint.bfs(views.geo_graph(spark, d)[0], 1)


@query
def gq14_sssp_reached_only(spark, d):
    return fixpoint.sssp(views.supply_graph(spark, d)[0], 0)


@query
def gq15_pagerank_dangling(spark, d):
    return _round(fixpoint.pagerank(*views.supply_graph(spark, d), 3, dangling="uniform"), "score")


@query
def gq16_components(spark, d):
    edges, ids = views.geo_graph(spark, d)
    return fixpoint.components(edges, ids)


@query
def agg15_component_sizes(spark, d):
    edges, ids = views.geo_graph(spark, d)
    return _round(fixpoint.component_sizes(fixpoint.components(edges, ids)), "percent", places=6)


@query
def gq17_diameter(spark, d):
    found = cut(fixpoint.largest_diameters(views.user_pairs(spark, d)))  # five rows
    return _round(found.crossJoin(F.broadcast(found.agg(F.avg("diameter").alias("average")))), "average")


@query
def gq18_clustering(spark, d):
    edges = views.user_pairs(spark, d)
    return _round(fixpoint.clustering(edges, graph.vertices_of(edges)), "coefficient")


@query
def gq19_average_path(spark, d):
    return _round(fixpoint.average_path(views.user_pairs(spark, d)), "average")


@query
def gq20_path_distribution(spark, d):
    return fixpoint.path_distribution(views.user_pairs(spark, d))


# joins


@query
def jn01_frontier_edges(spark, d):
    near = fixpoint.bfs(views.part_graph(spark, d), 0, max_hops=1).where("level = 1")
    return views.part_graph(spark, d).join(near, F.col("src") == F.col("id")).select("src", "dst", "weight", (F.col("level") + 1).alias("level"))


@query
def jn02_message_improves(spark, d):
    edges = views.part_graph(spark, d)
    one, two = fixpoint.sssp(edges, 0, max_hops=1), fixpoint.sssp(edges, 0, max_hops=2)
    return two.join(one.withColumnRenamed("distance", "old"), "id", "left").where("old is null or distance < old").select("id", "distance", "old")


@query
def jn03_not_visited(spark, d):
    return views.parts(spark, d).join(fixpoint.bfs(views.part_graph(spark, d), 0, max_hops=1), "id", "left_anti")


@query
def jn04_chunk_relay(spark, d):
    chunks = layout.split_lists(views.part_graph(spark, d), 10)
    return views.parts(spark, d).join(chunks, "id").groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.size("dsts")).alias("edges"))


@query
def jn05_sibling_replicas(spark, d):
    r = layout.assign_rhizome(views.part_graph(spark, d), 3, 5).select("dst", "rhizome").distinct()
    return r.alias("a").join(r.alias("b"), "dst").where("a.rhizome <> b.rhizome").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("relays"))


@query
def jn06_continuations(spark, d):
    steps, root = views.user_increments(spark, d)
    held = fixpoint.bfs(steps.where("increment <= 1"), root)
    return dynamic.continuations(held, steps.where("increment = 2")).groupBy("id").agg(F.min("value").alias("value"), F.count("*").alias("messages"))


@query
def jn07_address_lookup(spark, d):
    return views.part_graph(spark, d).join(_placed(spark, d).withColumnRenamed("id", "dst"), "dst").groupBy("cc_id").agg(F.count("*").alias("messages"))


@query
def jn08_verify(spark, d):
    edges, ids = views.part_graph(spark, d), views.parts(spark, d)
    return verify.verify_exact(fixpoint.bfs(edges, 0, vertices=ids), fixpoint.bfs(edges, 0, max_hops=2), "level")


@query
def jn09_baseline(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    best = runs.best_runs(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", ["l_quantity"])
    return _round(runs.speedups(best, (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "l_extendedprice", ["l_returnflag", "l_linestatus"]), "speedup")


@query
def jn10_sums_or_zero(spark, d):
    edges, ids = views.supply_graph(spark, d)
    sums = edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("s"))
    return ids.join(sums, "id", "left").select("id", F.coalesce("s", F.lit(0)).alias("total"))


# filters


@query
def flt01_zero_in(spark, d):
    return graph.zero_in(*views.supply_graph(spark, d))


@query
def flt02_zero_out(spark, d):
    return graph.zero_out(*views.supply_graph(spark, d))


@query
def flt03_predicate(spark, d):
    edges = views.part_graph(spark, d)
    at = fixpoint.bfs(edges, 0)
    a, b = at.withColumnsRenamed({"id": "src", "level": "a"}), at.withColumnsRenamed({"id": "dst", "level": "b"})
    return edges.join(a, "src").join(b, "dst").where("b = a + 1").select("src", "dst", "weight")


@query
def flt04_combined_messages(spark, d):
    return views.part_graph(spark, d).groupBy("dst").agg(F.min("weight").alias("least"), (F.count("*") - 1).alias("pruned"))


@query
def flt05_max_depth(spark, d):
    return fixpoint.bfs(views.part_graph(spark, d), 5, max_hops=1)


@query
def flt06_defined_level(spark, d):
    edges, ids = views.geo_graph(spark, d)
    return fixpoint.bfs(edges, 0, vertices=ids).where(F.col("level") < fixpoint.UNREACHED)


@query
def flt07_run_filter(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_quantity >= 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query
def flt08_comment_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> '' and line not like '%|%'").groupBy("doc_id").agg(F.count("*").alias("lines"))


# scalar functions


@query
def scl01_zero_based(spark, d):
    return views.part_graph(spark, d).select(S.zero_based(F.col("src") + 1).alias("src"), S.zero_based(F.col("dst") + 1).alias("dst"))


@query
def scl02_cell_coordinates(spark, d):
    x, y = S.cell_xy(F.col("id"), DIM_Y)
    return views.parts(spark, d).select("id", x.alias("x"), y.alias("y"), S.cell_id(x, y, DIM_Y).alias("back"))


def _cells(spark, d):
    a = _placed(spark, d).select(F.col("id").alias("src"), F.col("cc_id").alias("c1"))
    b = _placed(spark, d).select(F.col("id").alias("dst"), F.col("cc_id").alias("c2"))
    return views.part_graph(spark, d).select("src", "dst").distinct().join(a, "src").join(b, "dst")


@query
def scl03_next_hop(spark, d):
    c1, c2 = F.col("c1"), F.col("c2")
    return _cells(spark, d).select("src", "dst", S.direction(c1, c2, DIM_X, DIM_Y).alias("mesh"), S.direction(c1, c2, DIM_X, DIM_Y, "TORUS").alias("torus"))


@query
def scl04_hops(spark, d):
    c1, c2 = F.col("c1"), F.col("c2")
    return _cells(spark, d).select("src", "dst", S.hops(c1, c2, DIM_X, DIM_Y).alias("mesh"), S.hops(c1, c2, DIM_X, DIM_Y, "TORUS").alias("torus"))


@query
def scl05_in_box(spark, d):
    return _cells(spark, d).select("src", "dst", S.in_box(F.col("c1"), F.col("c2"), DIM_Y, 8, 8).alias("near"))


@query
def scl06_use_mesh(spark, d):
    return _cells(spark, d).select("src", "dst", S.use_mesh(F.col("c1"), F.col("c2"), DIM_X, DIM_Y).alias("mesh"))


@query
def scl07_congestion(spark, d):
    return graph.degrees(views.part_graph(spark, d), views.parts(spark, d)).select("id", S.congestion(F.col("in_degree")).alias("level"))


@query
def scl08_activity_code(spark, d):
    o, i = F.col("out_degree"), F.col("in_degree")
    level = S.congestion(i)
    code = S.activity_code(o % 2 == 0, i % 3 != 0, i >= 20, level)
    return graph.degrees(views.part_graph(spark, d), views.parts(spark, d)).select("id", code.alias("code"))


@query
def scl09_activity_class(spark, d):
    return views.parts(spark, d).groupBy(S.activity_class((F.col("id") % 12).cast("int")).alias("class")).agg(F.count("*").alias("n"))


@query
def scl10_percentages(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("part"), F.count("*").alias("whole"))
    return o.select("o_orderpriority", F.round(S.percent(F.col("part"), F.col("whole")), 8).alias("percent"))


@query
def scl11_comparison(spark, d):
    rows = table(spark, d, "lineitem")
    got = runs.compare(rows, F.col("l_linestatus") == "O", F.col("l_linestatus") == "F", ["l_returnflag", "l_linenumber"], "l_extendedprice")
    return _round(got, "decrease", "increase")


def _cost(spark, d, network, ruche=None):
    args = [F.col("l_orderkey") + 1, F.col("l_partkey") + 1, F.col("l_suppkey") + 1, F.col("l_quantity"), F.lit(32), F.lit(2_097_152)]
    area, energy, time = S.cost_model(network, *[a.cast("double") for a in args], ruche_operons=None if ruche is None else ruche.cast("double"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.round(area, 6).alias("area"), F.round(energy * 1e6, 6).alias("energy_uj"), F.round(time * 1e9, 3).alias("time_ns"))


@query
def scl12_cost_mesh(spark, d):
    return _cost(spark, d, "MESH")


@query
def scl12_cost_torus(spark, d):
    return _cost(spark, d, "TORUS")


@query
def scl13_cost_ruche(spark, d):
    return _cost(spark, d, "RUCHE", F.floor((F.col("l_partkey") + 1) / 3))


@query
def scl13_cost_ruche_torus(spark, d):
    return _cost(spark, d, "RUCHE_TORUS", F.floor((F.col("l_partkey") + 1) / 3))


@query
def scl14_throttle(spark, d):
    kind = F.when(F.col("p_size") % 2 == 0, "TORUS").otherwise("MESH")
    return table(spark, d, "part").select("p_partkey", S.throttle_period(F.col("p_size"), F.col("p_size") + 3, kind).alias("period"))


@query
def scl15_chip_dim(spark, d):
    return table(spark, d, "part").select("p_partkey", S.chip_dim(F.col("p_size"), F.col("p_partkey") % 4).alias("dim"))


@query
def scl16_names(spark, d):
    return table(spark, d, "part").select("p_partkey", S.on_off(F.col("p_size") > 25).alias("throttle"), S.network_name(F.col("p_size") % 2).alias("network"))


@query
def scl17_queue_full(spark, d):
    return table(spark, d, "part").select("p_partkey", S.queue_full(F.col("p_size"), 50, 60.0).alias("full"))


@query
def scl18_instruction_cost(spark, d):
    counts = graph.degrees(views.part_graph(spark, d), views.parts(spark, d)).select("id", F.col("in_degree").alias("add"), F.col("out_degree").alias("mul"), F.lit(1).alias("div"), F.col("out_degree").alias("load"))
    return accounting.instruction_cycles(counts).select("id", "cycles")


@query
def scl19_text(spark, d):
    return table(spark, d, "part").select("p_partkey", S.name_part(F.concat_ws("_", "p_brand", "p_type", "p_size"), 2).alias("third"), S.two_places(F.col("p_retailprice")).alias("price"), writers.run_name("run", F.col("p_brand"), F.col("p_size").cast("string")).alias("name"))


@query
def scl20_slices(spark, d):
    lists = graph.adjacency(views.part_graph(spark, d))
    cut_ = S.slice_of(F.col("neighbours"), 1, 3)
    return lists.select("id", F.size(cut_).alias("n"), F.aggregate(cut_, F.lit(0).cast("long"), lambda a, x: a + x["dst"]).alias("total"))


# aggregations


@query
def agg01_min_messages(spark, d):
    return views.part_graph(spark, d).groupBy(F.col("dst").alias("id")).agg(F.min("weight").alias("value"))


@query
def agg02_sum_and_count(spark, d):
    return views.part_graph(spark, d).groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("total"), F.count("*").alias("messages"))


@query
def agg03_two_level_sum(spark, d):
    r = layout.assign_rhizome(views.part_graph(spark, d), 4, 3)
    part = r.groupBy("dst", "rhizome").agg(F.sum("weight").alias("s"))
    return part.groupBy(F.col("dst").alias("id")).agg(F.sum("s").alias("total"), F.count("*").alias("replicas"))


@query
def agg04_degrees(spark, d):
    return graph.degrees(*views.supply_graph(spark, d))


@query
def agg05_degree_describe(spark, d):
    got = graph.describe(graph.degrees(views.part_graph(spark, d), views.parts(spark, d)), "out_degree")
    return _round(got, *[c for c in got.columns if c not in ("n", "least", "most")], places=6)


@query
def agg06_top_degree(spark, d):
    return graph.top_degree(views.part_graph(spark, d), views.parts(spark, d))


@query
def agg07_cell_totals(spark, d):
    cells = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("created"), (F.col("o_custkey") % 7).alias("queue"))
    return runs.cell_totals(cells, ["created"], ["queue"])


@query
def agg08_averages(spark, d):
    n = _placed(spark, d).groupBy("cc_id").agg(F.count("*").alias("objects"))
    return _round(n.agg(F.avg("objects").alias("average")), "average")


@query
def agg09_running_maximum(spark, d):
    e = table(spark, d, "events")
    return _round(e.groupBy("user_id").agg(F.max("value").alias("most"), F.sum("value").alias("total")), "most", "total", places=4)


@query
def agg10_active_cells(spark, d):
    states = table(spark, d, "events").select((F.col("event_id") % 50).alias("cycle"), F.col("user_id").alias("cell"), (F.col("event_id") % 3).alias("code"))
    return _round(runs.activity(states, 256), "percent")


@query
def agg11_best_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderkey")
    return runs.best_runs(rows, ["o_orderpriority", "o_orderstatus"], "o_totalprice", ["o_orderkey"])


@query
def agg12_distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query
def agg13_histogram(spark, d):
    return runs.histogram(table(spark, d, "lineitem"), "l_extendedprice", 40)


@query
def agg14_series(spark, d):
    states = table(spark, d, "events").select((F.col("event_id") % 20).alias("cycle"), F.col("user_id").alias("cell"), (F.col("event_id") % 4).alias("code"))
    return runs.activity(states, 100).select("cycle", "active").orderBy("cycle")


@query
def agg16_verification(spark, d):
    edges, ids = views.part_graph(spark, d), views.parts(spark, d)
    a, b = fixpoint.pagerank(edges, ids, 2), fixpoint.pagerank(edges, ids, 1)
    return _round(verify.summary(verify.verify_tolerance(a, b, "score")), "largest", places=10)


@query
def agg17_trials(spark, d):
    return _round(runs.over_trials(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity"), "mean")


# windows, sorts, sets, transforms


@query
def win01_rhizome(spark, d):
    return layout.assign_rhizome(views.part_graph(spark, d), 3, 5).groupBy("dst", "rhizome").agg(F.count("*").alias("edges"))


@query
def win02_offsets(spark, d):
    return graph.csr(views.part_graph(spark, d), views.parts(spark, d))[0]


@query
def win03_positions(spark, d):
    return graph.positions(views.part_graph(spark, d)).groupBy("src").agg(F.max("pos").alias("last"), F.sum(F.col("pos") * F.col("dst")).alias("mixed"))


@query
def win04_deltas(spark, d):
    steps = views.user_increments(spark, d)[0]
    each = steps.groupBy("increment").agg(F.count("*").alias("edges"))
    total = each.select("increment", F.sum("edges").over(Window.orderBy("increment")).alias("edges"))  # ten rows
    return runs.deltas(total, "increment", "edges")


@query
def win05_best_row(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query
def srt01_sorted(spark, d):
    return fixpoint.bfs(views.part_graph(spark, d), 3).orderBy("id")


@query
def srt02_top(spark, d):
    return graph.top_degree(views.part_graph(spark, d), views.parts(spark, d), "in_degree")


@query
def srt03_top_components(spark, d):
    edges, ids = views.geo_graph(spark, d)
    return fixpoint.components(edges, ids).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(5)


@query
def srt04_lists_equal(spark, d):
    """The lists of every seventh source differ in one weight."""
    edges = views.part_graph(spark, d)
    first = F.row_number().over(Window.partitionBy("src").orderBy("dst", "weight")) == 1
    other = edges.withColumn("weight", F.when(first & (F.col("src") % 7 == 0), F.col("weight") + 100).otherwise(F.col("weight")))
    back = graph.adjacency(other.orderBy(F.desc("dst"), F.desc("weight"))).withColumnRenamed("neighbours", "other")
    return graph.adjacency(edges).join(back, "id").select("id", (F.col("neighbours") == F.col("other")).alias("equal"))


@query
def srt05_root_first(spark, d):
    ids = views.parts(spark, d)
    return graph.root_first(ids, 7, ids.count())


@query
def srt06_shuffled(spark, d):
    """Each vertex once, each position once, the root first, and not in order of ids."""
    ids = views.parts(spark, d)
    got = graph.shuffled(ids, 7)
    moved = F.sum((F.col("id") != F.col("position")).cast("long")) * 2 > F.count("*")
    return got.agg(F.countDistinct("id").alias("ids"), F.countDistinct("position").alias("positions"), F.max("position").alias("last"), F.min(F.when(F.col("position") == 0, F.col("id"))).alias("first"), moved.alias("moved"))


@query
def srt07_sample(spark, d):
    ids = views.parts(spark, d)
    return graph.first_and_last(ids, ids.count())


@query
def set01_union(spark, d):
    steps = views.user_increments(spark, d)[0]
    return steps.select("src", "dst").distinct()


@query
def set02_symmetrized(spark, d):
    return graph.symmetrize(views.part_graph(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query
def set03_missing(spark, d):
    near = fixpoint.bfs(views.part_graph(spark, d), 0, max_hops=1)
    return graph.missing_ids(near, views.parts(spark, d).count())


@query
def set04_edge_differences(spark, d):
    edges = views.part_graph(spark, d)
    return graph.edge_differences(edges, edges.where("weight < 50")).groupBy("src", "dst", "weight", "side").agg(F.count("*").alias("n"))


@query
def trf01_adjacency(spark, d):
    lists = graph.adjacency(views.part_graph(spark, d))
    return lists.select("id", F.size("neighbours").alias("n"), F.element_at("neighbours", 1)["dst"].alias("first"), F.element_at("neighbours", -1)["dst"].alias("last"))


@query
def trf05_csr(spark, d):
    return graph.csr(views.part_graph(spark, d), views.parts(spark, d))[1]


@query
def trf06_germinate(spark, d):
    edges, ids = views.geo_graph(spark, d)
    return graph.zero_in(edges, ids).union(ids.where("id = 40")).distinct()


@query
def trf07_verify(spark, d):
    """Against a golden table with wrong, missing and extra rows planted."""
    edges, ids = views.part_graph(spark, d), views.parts(spark, d)
    golden = fixpoint.sssp(edges, 0, vertices=ids, salt=3).where("id % 10 != 4")
    golden = golden.withColumn("distance", F.col("distance") + F.when(F.col("id") % 10 == 3, 2).otherwise(0)).union(ids.where("id % 10 = 5").select(F.col("id") + 10_000_000, F.lit(1).cast("long")))
    checked = cut(verify.verify_exact(fixpoint.sssp(edges, 0, vertices=ids), golden, "distance"))
    return checked.groupBy("status").agg(F.count("*").alias("n"), F.max(F.abs(F.col("computed") - F.col("golden"))).alias("largest"))


@query
def trf08_validate(spark, d):
    """Lists from which the edges of weight 50 were lost and in which those of weight 49 are heavier."""
    edges = views.part_graph(spark, d)
    lists = graph.adjacency(edges.where("weight != 50").withColumn("weight", F.when(F.col("weight") == 49, 60).otherwise(F.col("weight")).cast("long")))
    found = lists.select(F.col("id").alias("src"), F.explode("neighbours").alias("e")).select("src", "e.dst", "e.weight")
    return graph.edge_differences(edges, found).groupBy("side", "weight").agg(F.count("*").alias("differences"))


# layout and accounting


@query
def lay01_split_trees(spark, d):
    return layout.rpvo_layout(graph.degrees(views.part_graph(spark, d), views.parts(spark, d)), 5, 10, 2)


@query
def lay01_chunks(spark, d):
    return layout.split_lists(views.part_graph(spark, d), 8).select("id", "chunk", F.size("dsts").alias("n"))


@query
def lay02_replicas(spark, d):
    return layout.assign_rhizome(views.part_graph(spark, d), 4, 6).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("rhizome").alias("replicas"))


@query
def lay03_cyclic(spark, d):
    return _placed(spark, d)


@query
def lay04_vicinity(spark, d):
    """Of the placements: how many, how far at most, how many on the cell itself or off the grid."""
    got = layout.place_vicinity(views.parts(spark, d), F.col("id") % 256, 2, DIM_X, DIM_Y)
    dx, dy = F.abs(F.col("cc_id") % 16 - F.col("id") % 256 % 16), F.abs(F.floor(F.col("cc_id") / 16) - F.floor(F.col("id") % 256 / 16))
    return got.agg(F.count("*").alias("n"), F.max(dx).alias("dx"), F.max(dy).alias("dy"), F.sum((F.col("cc_id") == F.col("id") % 256).cast("long")).alias("own"), F.sum((~F.col("cc_id").between(0, 255)).cast("long")).alias("off"))


@query
def lay05_channels(spark, d):
    e = table(spark, d, "events").select("ts", "event_id", "user_id")
    return layout.stream_chunks(e, ["ts", "event_id"], 16, e.count()).groupBy("channel").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query
def lay06_memory(spark, d):
    sizes = graph.degrees(views.part_graph(spark, d), views.parts(spark, d)).select("id", (32 + 16 * F.col("out_degree")).alias("bytes"))
    return layout.memory_report(_placed(spark, d), sizes, 4000)


@query
def acc01_messages(spark, d):
    edges = cut(views.part_graph(spark, d))
    return accounting.message_stats(edges, fixpoint.bfs(edges, 0))


@query
def acc03_diffusions(spark, d):
    return accounting.diffusion_stats(views.part_graph(spark, d), 0)


@query
def acc04_hops(spark, d):
    return accounting.hop_total(views.part_graph(spark, d), _placed(spark, d), DIM_X, DIM_Y, "TORUS")


@query
def acc06_objects(spark, d):
    edges, ids = views.part_graph(spark, d), views.parts(spark, d)
    shapes = layout.rpvo_layout(graph.degrees(edges, ids), 5, 10, 2)
    replicas = layout.assign_rhizome(edges, 4, 6).groupBy(F.col("dst").alias("id")).agg(F.countDistinct("rhizome").alias("replicas"))
    return accounting.allocated(shapes, replicas)


# files: written to the shared folder and read back


@query
def src01_edge_list(spark, d):
    path, edges = fresh_path(spark, "edges"), views.part_graph(spark, d)
    writers.write_edge_list(edges, views.parts(spark, d).count(), path)
    return readers.read_edge_list(spark, path)[0]


@query
def src02_header(spark, d):
    path = fresh_path(spark, "edges")
    writers.write_edge_list(views.part_graph(spark, d), views.parts(spark, d).count(), path)
    return readers.read_vertices(spark, path)


@query
def src03_increment(spark, d):
    path = fresh_path(spark, "increment")
    views.part_graph(spark, d).select(F.col("src") + 1, F.col("dst") + 1, "weight").write.csv(path, sep="\t")
    return readers.read_increment(spark, path)


@query
def src05_golden(spark, d):
    path = fresh_path(spark, "golden")
    writers.write_golden(fixpoint.bfs(views.geo_graph(spark, d)[0], 0), "level", 0, path)
    return readers.read_golden(spark, path, "level")[0]


@query
def src06_scores(spark, d):
    path = fresh_path(spark, "scores")
    writers.write_scores(fixpoint.pagerank(views.part_graph(spark, d), views.parts(spark, d), 1), path)
    return _round(readers.read_scores(spark, path), "score")


@query
def src09_digraph(spark, d):
    path = fresh_path(spark, "edges")
    writers.write_edge_list(views.part_graph(spark, d), views.parts(spark, d).count(), path)
    return readers.read_digraph(spark, path)


@query
def src12_frames(spark, d):
    path = fresh_path(spark, "frames")
    cells = views.parts(spark, d).select((F.col("id") % 5).alias("cycle"), F.floor(F.col("id") / 5 / 8).alias("row"), (F.floor(F.col("id") / 5) % 8).alias("col"), (F.col("id") % 12).cast("int").alias("code"))
    writers.write_frames(cells, 8, 8, path)
    return readers.read_frames(spark, path).select("cycle", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "code")


@query
def snk07_csr_text(spark, d):
    path = fresh_path(spark, "csr")
    writers.write_csr(views.part_graph(spark, d), views.parts(spark, d), path)
    return readers.in_order(spark, path).select("nth", "value")


def _shape(edges: DataFrame, n: int) -> DataFrame:
    """What a generated graph has to keep to: edges, different edges, loops, ids off the range, one-way
    pairs, weights off the range, and whether it is one component."""
    edges = cut(edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    one_way = edges.select("src", "dst").exceptAll(back.select("src", "dst")).count()
    parts = fixpoint.components(edges, edges.sparkSession.range(n)).select("component").distinct().count()
    off = ~F.col("src").between(0, n - 1) | ~F.col("dst").between(0, n - 1)
    got = edges.agg(
        F.count("*").alias("edges"), F.countDistinct("src", "dst").alias("different"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"), F.sum(off.cast("long")).alias("off"),
        F.sum((~F.col("weight").between(1, 5)).cast("long")).alias("weights_off"),
    )
    return got.withColumns({"one_way": F.lit(one_way).cast("long"), "components": F.lit(parts).cast("long")})


@query
def gen04_random_graph(spark, d):
    """A dense one: 224 of the 240 possible edges."""
    return _shape(generators.erdos_renyi(spark, 4, 14), 16).drop("one_way")


@query
def gen04_undirected(spark, d):
    return _shape(generators.connected(lambda seed: generators.erdos_renyi(spark, 8, 8, directed=False, seed=seed), 256), 256)


@query
def gen05_rmat(spark, d):
    return _shape(generators.rmat(spark, 8, 4), 256).select("edges", "off", "weights_off")


@query
def gen01_preferential_closing(spark, d):
    return _shape(generators.preferential(spark, 8, 4, closing=0.4), 256)


@query
def gen02_preferential(spark, d):
    return _shape(generators.preferential(spark, 8, 4), 256)


@query
def gen03_small_world(spark, d):
    return _shape(generators.connected(lambda seed: generators.small_world(spark, 8, 4, seed=seed), 256), 256).select("loops", "off", "one_way", "weights_off", "components", (F.col("edges") == F.col("different")).alias("simple"))


# programs of message handlers


def _program(spark, d):
    edges, ids = views.part_graph(spark, d), views.parts(spark, d)
    return edges.select("src", "dst").distinct(), ids


@query
def udf03_program_bfs(spark, d):
    """Levels and parents: a state of two columns, germinated by a message from the host."""
    edges, ids = _program(spark, d)
    none = F.lit(None).cast("long")
    start = ids.select("id", none.alias("level"), none.alias("parent"))
    first = spark.range(0, 1).select("id", F.lit(0).cast("long").alias("level"), F.lit(-1).cast("long").alias("parent"))
    return actions.run(actions.bfs_tree(), edges, start, germinate=first)


@query
def udf06_gated_pagerank(spark, d):
    """PageRank as a program whose gate waits for a sum of as many messages as there are in-edges."""
    edges, ids = _program(spark, d)
    degrees = graph.degrees(edges, ids)
    n = ids.count()
    start = degrees.select("id", F.lit(1.0 / n).alias("score"), F.col("out_degree").alias("out"), F.col("in_degree").alias("inn"), F.lit(True).alias("active"))
    return _round(actions.run(actions.pagerank(n), edges, start, rounds=3, everyone=True), "score").select("id", "score")


@query
def udf01_registered(spark, d):
    """A handler by its number: after two rounds, which vertices have been told by at least three others, and by how many."""
    edges, ids = _program(spark, d)
    book = actions.Registry()
    told = actions.Action({"by": F.col("src")}, {"by": F.count_distinct}, {"told": F.col("told") + F.col("m_by")}, predicate=F.col("m_by") >= 3, diffuse=F.col("told") == 0)
    number = book.register("told", told)
    start = ids.select("id", F.lit(0).cast("long").alias("told"), (F.col("id") % 5 == 0).alias("active"))
    return actions.run(book[number], edges, start, rounds=1).where("told > 0").select("id", "told", F.lit(number).alias("number"))


@query
def udf08_on_insert(spark, d):
    """A hook of its own on inserted edges: what they send counts as ten steps, later passes along them as one."""
    steps, root = views.user_increments(spark, d)
    steps = cut(steps)
    state = dynamic.GrowingLevels(spark, root, on_insert=F.col("value") + 10)
    try:
        for k in (1, 2):
            state.insert(steps.where(F.col("increment") == k).select("src", "dst"))
        return state.levels()
    finally:
        state.close()


# more files


def _text(spark, lines: DataFrame, name: str, header: list[str]) -> str:
    """lines (place, line) under header, as one file in a fresh folder."""
    path = fresh_path(spark, name)
    writers.write_lines([spark.createDataFrame(list(enumerate(header)), "place long, line string"), lines], path)
    return path


def _coordinates(spark, d, shift: int) -> tuple[DataFrame, int, int]:
    edges, n = views.part_graph(spark, d), views.parts(spark, d).count()
    return edges.select(F.col("src").alias("place"), F.concat_ws(" ", F.col("src") + shift, F.col("dst") + shift).alias("line")), n, edges.count()


@query
def src07_matrix(spark, d):
    lines, n, m = _coordinates(spark, d, 1)
    path = _text(spark, lines, "matrix", ["%%MatrixMarket matrix coordinate pattern general", "% parts", f"{n} {n} {m}"])
    return readers.read_matrix(spark, path)[0].groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum((~F.col("weight").between(1, 5)).cast("long")).alias("off"))


@query
def trf02_matrix_to_edges(spark, d):
    lines, n, m = _coordinates(spark, d, 1)
    source, target = _text(spark, lines, "matrix", ["%%MatrixMarket matrix coordinate pattern general", f"{n} {n} {m}"]), fresh_path(spark, "edges")
    writers.convert(spark, source, target, "matrix")
    edges, n = readers.read_edge_list(spark, target)
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).withColumn("vertices", F.lit(n).cast("long"))


@query
def src08_parmat(spark, d):
    lines, n, m = _coordinates(spark, d, 0)
    return readers.read_parmat(spark, _text(spark, lines, "parmat", [f"{n} {n} {m}"]))[0].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def trf03_parmat_to_edges(spark, d):
    lines, n, m = _coordinates(spark, d, 0)
    source, target = _text(spark, lines, "parmat", [f"{n} {n} {m}"]), fresh_path(spark, "edges")
    writers.convert(spark, source, target, "parmat")
    return readers.read_edge_list(spark, target)[0].groupBy("src", "dst").agg(F.count("*").alias("n"))


def _increment_files(spark, d, most: int = 10) -> tuple[list[str], int]:
    steps, root = views.user_increments(spark, d)
    steps, folder = cut(steps), fresh_path(spark, "increments")
    paths = [f"{folder}/{k}" for k in range(1, most + 1)]
    for k, path in enumerate(paths, 1):
        steps.where(F.col("increment") == k).select(F.col("src") + 1, F.col("dst") + 1, F.lit(1)).write.csv(path, sep="\t")
    return paths, root


@query
def src10_cumulative(spark, d):
    return readers.read_cumulative(spark, _increment_files(spark, d)[0]).select("src", "dst")


@query
def trf04_cumulative_goldens(spark, d):
    paths, root = _increment_files(spark, d, 3)
    target = fresh_path(spark, "cumulative") + "/graph"
    writers.cumulative(spark, paths, target, 1 + readers.read_cumulative(spark, paths).agg(F.max("src")).first()[0], root)
    each = [readers.read_golden(spark, f"{target}_{k}.bfs", "level", fill=False)[0].select(F.lit(k).alias("increment"), "id", "level") for k in (1, 2, 3)]
    counts = [readers.read_edge_list(spark, f"{target}_{k}")[0].agg(F.lit(k).alias("increment"), F.count("*").alias("edges")) for k in (1, 2, 3)]
    return reduce(DataFrame.unionByName, each).join(F.broadcast(reduce(DataFrame.unionByName, counts)), "increment")


@query
def src04_stream_channels(spark, d):
    paths, root = _increment_files(spark, d, 2)
    folder = fresh_path(spark, "stream")
    for path in paths:  # one file each
        spark.read.text(path).coalesce(1).write.mode("append").text(f"{folder}/in")
    running, store = levels.stream_levels(spark, f"{folder}/in", root, f"{folder}/state", relax=False, dim_x=4)
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    return store.channels(2).groupBy("batch", "channel").agg(F.count("*").alias("edges"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))


def _run_files(spark, d) -> str:
    """Run statistics files made of the nations: one for each, with its series and cells."""
    folder = fresh_path(spark, "runs")
    for r in table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect():
        k = r.n_nationkey
        name = f"bfs_graph_G{r.n_regionkey}_v_100_e_{500 + k}_rpvo_2_cut_7_trail_{k % 3}_x_16_y_16_th_x_thr_1_recv_4_vic_2_g_ch_3_e_mn_5_e_mx_9_term_OFF_net_{'TORUS' if k % 2 else 'MESH'}_on_pr_ON"
        sections = {
            "graph": [("graph_file", f"G{r.n_regionkey}"), ("vertices", 100), ("edges", 500 + k), ("root_vertex", 0)],
            "chip": [("shape", "square"), ("dim_x", 16), ("dim_y", 16), ("total_compute_cells", 256), ("total_chip_memory(bytes)", 256 * 4096), ("throttle", k % 2), ("recv_buff_size", 4)],
            "congestion": [("policy", "static"), ("threshold", 3)],
            "totals": [("total_cycles", 1000 + 10 * k), ("total_objects_created", 300 + k), ("total_actions_created", 700 + k), ("total_actions_performed_work", 600 + k), ("total_actions_false_on_predicate", 100), ("diffusions_created", 50 + k), ("diffusions_performed_work", 40 + k), ("diffusions_false_on_predicate", 10), ("diffusions_filtered", 1), ("actions_overlaped", 2), ("diffusions_pruned", 3), ("operons_moved", 9000 + k)],
            "objects": [("avg_objects_per_cc", 1.5)], "active": [("avg_cells_active_percent", 20.25)],
        }
        series = spark.range(3).select(F.col("id").alias("cycle"), (F.col("id") * 10.5).alias("cells"), F.lit(0.0).alias("htree"))
        cells = spark.range(4).select(F.col("id").alias("cc_id"), F.lit("compute").alias("cc_type"), (F.col("id") + k).alias("objects"))
        writers.write_sections(sections, series, cells, f"{folder}/{name}")
    return f"{folder}/*"


@query
def trf09_consolidate(spark, d):
    """Run files into one table, appended as CSV and read back."""
    target = fresh_path(spark, "consolidated") + "/graph_bfs"
    writers.write_report(readers.consolidate(spark, _run_files(spark, d)), target)
    rows = readers.read_runs(spark, target)
    return _round(rows.select("edges", "trail", "network", "throttle", "total_cycles", "actions_performed", "operons_moved", "memory_cc", "rpvo_max", "pruning", "graph_file", "app", (F.col("chip_area") * 1e3).alias("area"), (F.col("time") * 1e9).alias("time_ns")), "area", "time_ns", places=6)


@query
def src11_statistics(spark, d):
    got = readers.read_statistics(spark, _run_files(spark, d))
    file = F.element_at(F.split("path", "/"), -2)
    series = got["activity"].groupBy(file.alias("file")).agg(F.count("*").alias("cycles"), F.sum("cells").alias("active"))
    objects = got["cells"].where("name = 'objects'").groupBy(file.alias("file")).agg(F.sum(F.col("value").cast("long")).alias("objects"))
    edges = got["totals"].where("name = 'edges'").select(file.alias("file"), F.col("value").cast("long").alias("edges"))
    return series.join(objects, "file").join(edges, "file").select("edges", "cycles", "active", "objects")


@query
def src15_name_fields(spark, d):
    """Two patterns; the fields of the names."""
    base = _run_files(spark, d)[:-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{base}*MESH*", f"{base}*TORUS*"]).where("path like '%part-%'").select(F.element_at(F.split("path", "/"), -2).alias("path"))
    return files.select(*readers.name_fields(F.col("path"))).select("graph", "edges", "trail", "throttle", "network", "pruning")


@query
def src16_partition_labels(spark, d):
    path = fresh_path(spark, "labels")
    views.parts(spark, d).select(F.col("id") + 1, (F.col("id") % 8).cast("int")).write.csv(path, sep="\t")
    return readers.read_partition_labels(spark, path)


@query
def snk08_text_report(spark, d):
    path = fresh_path(spark, "report")
    for column in ("out_degree", "in_degree"):
        writers.write_text(_round(graph.describe(graph.degrees(views.part_graph(spark, d), views.parts(spark, d)), column, [0.5]), "mean", "std", places=4).select("n", "mean", "least", "most"), f"degrees: {column}", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query
def trf10_frame_grid(spark, d):
    cells = views.parts(spark, d).select((F.col("id") % 3).alias("cycle"), F.floor(F.col("id") / 3 / 8).alias("row"), (F.floor(F.col("id") / 3) % 8).alias("col"), (F.col("id") % 12).cast("int").alias("code"))
    path = fresh_path(spark, "frames")
    writers.write_frames(cells, 8, 8, path)
    grid = readers.frame_grid(readers.read_frames(spark, path))
    return grid.select("cycle", F.posexplode("grid").alias("row", "cells")).select("cycle", "row", F.array_join("cells", "|").alias("classes"))

"""Hand-made graphs: repeated edges, loops, sinks, sources, unreachable cycles."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import scalars as S
from weftgraph.operators import dynamic, fixpoint, graph, layout, verify

E1 = [(0, 1, 7), (0, 1, 2), (0, 2, 3), (1, 3, 4), (2, 2, 1), (2, 3, 1), (3, 4, 5), (5, 3, 1), (6, 7, 1), (7, 6, 1)]
U = fixpoint.UNREACHED


@pytest.fixture(scope="module")
def e1(spark):
    return spark.createDataFrame(E1, "src long, dst long, weight long"), spark.range(8)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_degrees(e1):
    got = graph.degrees(*e1)
    assert column(got, "out_degree") == [3, 1, 2, 1, 0, 1, 1, 1]
    assert column(got, "in_degree") == [0, 2, 2, 3, 1, 0, 1, 1]
    assert column(graph.zero_in(*e1), "id") == [0, 5] and column(graph.zero_out(*e1), "id") == [4]


def test_levels_and_distances(e1):
    edges, ids = e1
    assert column(fixpoint.bfs(edges, 0, vertices=ids), "level") == [0, 1, 1, 2, 3, U, U, U]
    assert column(fixpoint.sssp(edges, 0, vertices=ids), "distance") == [0, 2, 3, 4, 9, U, U, U]
    for hops, want in ((1, [0, 2, 3, U, U, U, U, U]), (2, [0, 2, 3, 4, U, U, U, U]), (3, [0, 2, 3, 4, 9, U, U, U])):
        assert column(fixpoint.sssp(edges, 0, max_hops=hops, vertices=ids), "distance") == want


@pytest.mark.parametrize("salt", [0, 3])
def test_pagerank(e1, salt):
    want = {
        1: [0.01875, 0.08958333, 0.10729167, 0.284375, 0.125, 0.01875, 0.125, 0.125],
        2: [0.01875, 0.029375, 0.06966146, 0.15643229, 0.26046875, 0.01875, 0.125, 0.125],
        3: [0.01875, 0.029375, 0.05366862, 0.08926237, 0.15171745, 0.01875, 0.125, 0.125],
    }
    for k in (1, 3) if salt else want:
        assert column(fixpoint.pagerank(*e1, k, salt=salt), "score") == pytest.approx(want[k], abs=1e-8)


def test_pagerank_keeps_mass_when_shared(e1):
    assert sum(column(fixpoint.pagerank(*e1, 4, dangling="uniform"), "score")) == pytest.approx(1)


def test_growing_graph(spark):
    ids = spark.range(7)
    make = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    edges = make([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)])
    found = fixpoint.bfs(edges, 0)
    assert column(fixpoint.with_all(found, ids, "level"), "level") == [0, 1, 2, 3, 4, 5, U]
    for delta, want in (([(0, 3)], [0, 1, 2, 1, 2, 3, U]), ([(0, 5), (5, 6)], [0, 1, 2, 1, 2, 1, 2]), ([(5, 4), (4, 1)], [0, 1, 2, 1, 2, 1, 2])):
        edges, found = dynamic.apply_increment(edges, found, make(delta))
        assert column(fixpoint.with_all(found, ids, "level"), "level") == want


def test_components_and_clustering(e1):
    edges, ids = e1
    assert column(fixpoint.components(edges, ids), "component") == [0, 0, 0, 0, 0, 0, 6, 6]
    got = fixpoint.clustering(edges, ids)
    assert column(got, "triangles") == [0] * 8
    closed = edges.union(edges.sparkSession.createDataFrame([(1, 2, 1)], edges.schema))
    assert column(fixpoint.clustering(closed, ids), "triangles") == [1, 2, 2, 1, 0, 0, 0, 0]


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long, weight long")
    assert column(fixpoint.bfs(edges, 0, vertices=spark.range(2)), "level") == [0, U]
    assert column(fixpoint.components(edges, spark.range(2)), "component") == [0, 1]
    assert fixpoint.pagerank(edges, spark.range(0)).count() == 0


def test_replicas(spark):
    edges = spark.range(9).select(F.col("id").alias("src"), F.lit(1).cast("long").alias("dst"), F.lit(1).cast("long").alias("weight"))
    got = layout.assign_rhizome(edges, 3, 2).orderBy("src").collect()
    assert [r.rhizome for r in got] == [0, 0, 1, 1, 2, 2, 0, 0, 1]


def test_hops(spark):
    pairs = spark.createDataFrame([(0, 24), (0, 4), (7, 12), (3, 3), (20, 2)], "a int, b int")
    got = pairs.select(*[S.hops(F.col("a"), F.col("b"), 5, 5, k).alias(k) for k in ("MESH", "TORUS")]).collect()
    assert [tuple(r) for r in got] == [(8, 2), (4, 1), (1, 1), (0, 0), (6, 3)]


def test_split_lists():
    assert [layout.tree_shape(d, 10, 15, 3) for d in (10, 11, 20, 21, 31, 50, 100)] == [(1, 0), (2, 1), (3, 1), (4, 1), (4, 1), (6, 2), (11, 2)]
    assert [layout.tree_shape(d, 10, 30, 2) for d in (11, 20, 21, 31, 50, 100)] == [(2, 1), (2, 1), (3, 1), (4, 2), (4, 2), (7, 2)]


def test_vicinity_is_near_and_elsewhere(spark):
    got = layout.place_vicinity(spark.range(500), F.col("id") % 25, 1, 5, 5).collect()
    assert all(r.cc_id != r.id % 25 and abs(r.cc_id % 5 - r.id % 25 % 5) <= 1 and abs(r.cc_id // 5 - r.id % 25 // 5) <= 1 for r in got)


def test_csr_and_ordinal(e1):
    edges, ids = e1
    offsets, targets = graph.csr(edges, ids)
    assert column(offsets, "offset") == [0, 3, 4, 6, 7, 7, 8, 9]
    assert [r.dst for r in targets.orderBy("place").collect()] == [1, 1, 2, 3, 2, 3, 4, 3, 7, 6]
    assert [r.nth for r in graph.ordinal(ids, ["id"]).orderBy("id").collect()] == list(range(8))


def test_verification_sees_both_sides(spark):
    a, b = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "id long, level long"), spark.createDataFrame([(1, 2), (2, 9), (3, 1)], "id long, level long")
    assert {r.id: r.status for r in verify.verify_exact(a, b, "level").collect()} == {0: "extra", 1: "ok", 2: "wrong", 3: "missing"}


def test_paths_of_whole_components(spark):
    """A path, a path with leaves (the largest, no id under 40) and a small cycle."""
    edges = [(i, i + 1) for i in range(9)] + [(1000 + i, 1001 + i) for i in range(7)] + [(1000 + i, 1100 + 16 * i + j) for i in range(8) for j in range(15)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def levels(root):
        out, todo = {root: 0}, [root]
        for v in todo:
            for w in near[v] - out.keys():
                out[w] = out[v] + 1
                todo.append(w)
        return out

    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, weight long")
    assert {tuple(r) for r in fixpoint.largest_diameters(df).collect()} == {(0, 10, 9), (1000, 128, 9), (500, 3, 1)}
    all_ = [k for v in near for k in levels(v).values() if k]
    got = fixpoint.average_path(df).first()
    assert got.pairs == len(all_) and abs(got.average - sum(all_) / len(all_)) < 1e-9
    big = sorted(v for v in near if v >= 1000)
    ends = [k for v in big[:50] + big[-50:] for k in levels(v).values() if k]
    assert {r.level: r.pairs for r in fixpoint.path_distribution(df).collect()} == {k: ends.count(k) for k in set(ends)}
    few = fixpoint.path_distribution(df.where("src between 500 and 502")).collect()
    assert [tuple(r) for r in few] == [(1, 6)]
    blocks = {tuple(r) for r in fixpoint.source_counts(df.where("src < 9"), spark.range(10), block=8).collect()}
    assert blocks == {tuple(r) for r in fixpoint.source_counts(df.where("src < 9"), spark.range(10)).collect()}


def test_hook_wave_through_better_vertices(spark):
    """The wave of an inserted edge goes on behind a vertex that is as near already (2 at 11), over a new edge whose hook is dear."""
    steps = [[(0, 1), (1, 2), (2, 3)], [(0, 5), (5, 2), (2, 6), (6, 7)], [(7, 3)]]
    state = dynamic.GrowingLevels(spark, 0, on_insert=F.col("value") + 10)
    for edges in steps:
        state.insert(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.level for r in state.levels().collect()} == {0: 0, 1: 10, 2: 11, 3: 12, 5: 10, 6: 12, 7: 13}
    state.close()


def test_all_pairs_take_few_jobs(spark):
    """A long path takes as many levels as it has edges, but no rounds of Spark jobs."""
    df = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    spark.sparkContext.setJobGroup("all pairs", "")
    try:
        got = fixpoint.average_path(df).first()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("all pairs"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (got.pairs, round(got.average, 9)) == (41 * 40, 14.0) and jobs < 40


def test_held_graph_equals_dealt_edges(spark, monkeypatch):
    """Hubs, tiles, several blocks, both directions of a round, loops, vertices alone, sources that no edge has."""
    monkeypatch.setattr(fixpoint, "CELLS", 256)
    edges = [(0, i) for i in range(1, 90)] + [(i, i + 1) for i in range(89, 100)] + [(i, 3 * i % 90) for i in range(20, 60)] + [(200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(edges, "src long, dst long")
    some = spark.range(0, 400, 3)
    for sources in (some, graph.vertices_of(df)):
        a, b = fixpoint.level_totals(df, sources), fixpoint.level_totals(df, sources, pairs=0)
        assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    far = {r.id: r.level for r in fixpoint.farthest(df, graph.vertices_of(df)).collect()}
    assert far == {300: 0} | {r.id: r.level for r in fixpoint.farthest(df, graph.vertices_of(df), pairs=0).collect()}
    own = fixpoint.held(df)
    for hub, tile, gather, cells in ((5, 3, 4, 0), (1 << 12, 1 << 11, 1 << 16, 1 << 21), (2, 7, 1, 40)):
        for name, value in (("HUB", hub), ("TILE", tile), ("GATHER", gather), ("CELLS", cells)):
            monkeypatch.setattr(fixpoint, name, value)
        assert fixpoint._farthest(own, ids := own.ids.argsort(), own.waves(ids))[1].tolist() == [far[i] for i in sorted(far)]

"""Results against golden files, which plain Python makes here: searches with queues and heaps, and a power iteration."""

import heapq
import random

import pytest

from weftgraph.operators import actions, dynamic, fixpoint, program, verify
from weftgraph.sources import readers


def graph(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n) if r.random() < 0.8 else r.randrange(1 + n // 50), r.randrange(1, 6)) for _ in range(m)]


def distances(edges, root, weighted):
    out = {}
    for s, t, w in edges:
        out.setdefault(s, []).append((t, w if weighted else 1))
    found, todo = {}, [(0, root)]
    while todo:
        d, v = heapq.heappop(todo)
        if v not in found:
            found[v] = d
            for t, w in out.get(v, ()):
                heapq.heappush(todo, (d + w, t))
    return found


def scores(edges, n, rounds):
    degree = [0] * n
    for s, _, _ in edges:
        degree[s] += 1
    r = [1 / n] * n
    for _ in range(rounds):
        new = [0.15 / n] * n
        for s, t, _ in edges:
            new[t] += 0.85 * r[s] / degree[s]
        r = new
    return r


def written(path, n, edges, root):
    (path / "g").write_text("\n".join([f"{n}\t{n}", str(len(edges)), *("\t".join(map(str, e)) for e in edges)]) + "\n")
    for name, weighted in (("bfs", False), ("sssp", True)):
        rows = sorted(distances(edges, root, weighted).items())
        (path / f"g.{name}").write_text("\n".join(["# Source", str(root), *(f"{v}\t{d}" for v, d in rows)]) + "\n")
    (path / "g.pagerank").write_text("\n".join(f"{v}\t{x}" for v, x in enumerate(scores(edges, n, 8))) + "\n")


@pytest.mark.parametrize(("n", "m", "seed", "least"), [(300, 1000, 2, None), (300, 4000, 3, 16)])
def test_levels_distances_scores(spark, tmp_path, monkeypatch, n, m, seed, least):
    """least: from so many edges on sources are cut into parts, as hubs are."""
    if least:
        monkeypatch.setattr(program, "LEAST_HUB", least)
    rows = graph(n, m, seed)
    if least:
        rows = [(k % 4 // 2, t, w) if k % 2 else (s, t, w) for k, (s, t, w) in enumerate(rows)]
    written(tmp_path, n, rows, 0)
    edges, size = readers.read_edge_list(spark, f"{tmp_path}/g")
    if least:
        links = program.Links(edges)
        assert links.cut and sum(t.count() for t in links.plain) + sum(t.count() for t, _ in links.cut) == m
        links.close()
    for column, query, ending in (("level", fixpoint.bfs, "bfs"), ("distance", fixpoint.sssp, "sssp")):
        golden, root = readers.read_golden(spark, f"{tmp_path}/g.{ending}", column)
        golden = fixpoint.with_all(golden.where(f"{column} < {fixpoint.UNREACHED}"), spark.range(n), column)
        got = verify.summary(verify.verify_exact(query(edges, root, vertices=spark.range(size)), golden, column)).first()
        assert (got.n, got.errors) == (n, 0)
    got = verify.summary(verify.verify_tolerance(fixpoint.pagerank(edges, spark.range(size), 8), readers.read_scores(spark, f"{tmp_path}/g.pagerank"), "score", 1e-9)).first()
    assert (got.n, got.errors) == (n, 0)


def test_increments(spark):
    edges = graph(200, 700, 4)
    state = dynamic.GrowingLevels(spark, 0)
    changes = []
    for k in range(7):
        part = spark.createDataFrame([e[:2] for e in edges[100 * k : 100 * k + 100]], "src long, dst long")
        changes.append(state.insert(part))
        assert {r.id: r.level for r in state.levels().collect()} == distances(edges[: 100 * k + 100], 0, False)
    state.close()
    changes[0] = changes[0].unionByName(dynamic.first_levels(spark, 0))
    got = dynamic.level_history(changes).collect()
    for k in range(7):
        assert {r.id: r.level for r in got if r.increment == k + 1} == distances(edges[: 100 * k + 100], 0, False)


def test_programs(spark):
    edges = list({e[:2]: e for e in graph(120, 500, 5)}.values())
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    ids = spark.range(120)
    start = ids.selectExpr("id", "cast(null as long) AS level", "cast(null as long) AS parent")
    first = spark.createDataFrame([(0, 0, -1)], "id long, level long, parent long")
    got = {r.id: r for r in actions.run(actions.bfs_tree(), df, start, germinate=first).collect()}
    want = distances(edges, 0, False)
    assert {v: r.level for v, r in got.items() if r.level is not None} == want
    for s, t, _ in edges:
        if t in want and t and want.get(s, 999) + 1 == want[t]:
            assert got[t].parent <= s
    with pytest.raises(Exception, match="error event"):
        book = actions.Registry()
        actions.run(book["error"], df, ids.selectExpr("id", "id AS x", "true AS active"), rounds=1, everyone=True)
    same = actions.run(book[0], df, ids.selectExpr("id", "id AS x", "true AS active"), rounds=1)
    assert all(r.id == r.x for r in same.collect())


def test_labels(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("1\t3\n2\t1\n")
    assert sorted(map(tuple, readers.read_partition_labels(spark, f"{tmp_path}/l.tsv").collect())) == [(0, 3), (1, 1)]


def test_command_line(spark, tmp_path, capsys):
    from weftgraph.__main__ import main

    written(tmp_path, 30, graph(30, 90, 6), 0)
    assert main(["sssp", "-f", f"{tmp_path}/g", "-verify", f"{tmp_path}/g.sssp", "-o", f"{tmp_path}/out"], spark) == 0
    assert main(["bfs", "-f", f"{tmp_path}/g", "-verify", f"{tmp_path}/g.sssp", "-o", f"{tmp_path}/out"], spark) == 1
    assert "0 errors" in capsys.readouterr().out and spark.read.parquet(f"{tmp_path}/out").count() == 30

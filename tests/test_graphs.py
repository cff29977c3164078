"""Centrality, components and communities against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import centrality, communities, components, lineage_cut


def brandes(edges):
    out, nodes = defaultdict(set), {x for e in edges for x in e}
    for a, b in edges:
        if a != b:
            out[a].add(b)
    nodes = {x for a in out for x in (a, *out[a])}
    between, close = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        dist, paths, before, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
        close[s] = (len(dist) - 1, sum(dist.values()))
    return between, close


@pytest.mark.parametrize("batch", [6, 1000])
def test_centrality(spark, batch):
    rng = random.Random(batch)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(26)] + [(20, 21), (21, 20), (20, 21), (3, 3)]
    between, close = brandes(edges)
    got = {r["node"]: r for r in centrality.centrality(spark.createDataFrame(edges, "src int, dst int"), batch).collect()}
    assert got.keys() == between.keys()
    for k, r in got.items():
        assert abs(r["betweenness"] - between[k]) < 1e-9 and r["reached"] == close[k][0]
        assert r["closeness"] is None if not close[k][0] else abs(r["closeness"] - close[k][0] / close[k][1]) < 1e-12
    assert batch == 6 or centrality.centrality(spark.createDataFrame([], "src int, dst int")).count() == 0


def plain_components(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {r["node"]: r["component"] for r in components.weak_components(df).collect()} == plain_components(edges)
    alone = components.weak_components(df.limit(0), spark.createDataFrame([(5,), (5,), (6,)], "node int"))
    assert sorted(tuple(r) for r in alone.collect()) == [(5, 5), (6, 6)]
    summary = components.graph_summary(df.withColumn("weight", F.lit(1.0))).first()
    sizes = defaultdict(int)
    for c in plain_components(edges).values():
        sizes[c] += 1
    assert (summary["n_components"], summary["largest_component"], summary["n_edges"]) == (len(sizes), max(sizes.values()), len(edges))


def test_links_of_components_shrink_by_the_round(spark, tmp_path, monkeypatch):
    """All links of all components were shuffled again in every round."""
    rows, name = [], lambda i: i * 7919 % 20011
    for at in range(0, 4000, 10):
        rows += [(name(i), name(i + 1)) for i in range(at, at + 9)]
    star, sizes = [(20011, i) for i in range(20012, 21012)], []

    def counted(df, step="step"):
        out = lineage_cut.written(df, step)
        if step == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "written", counted)
    edges = rows + star + [(None, 5), (30000, None)]
    got = components.weak_components(spark.createDataFrame(edges, "src int, dst int")).collect()
    assert sum(sizes) < 3 * sizes[0] and sizes[-1] == 0
    assert {r["node"]: r["component"] for r in got} == plain_components(rows + star + [(5, 5), (30000, 30000)]) | {None: None}


def test_mending_equals_rebuilding(spark):
    """After each of several random batches of additions, moves and removals."""
    rng, kind = random.Random(3), "id int, src int, dst int, changed_at int"
    table = {i: (i, rng.randrange(40), rng.randrange(40), 0) for i in range(25)}
    edges = spark.createDataFrame(list(table.values()), kind)
    known = components.weak_components(edges)
    for turn in range(1, 4):
        changes = [(i, rng.randrange(40), rng.randrange(40), turn, False) for i in rng.sample(range(40), 4)]
        changes += [(i, *table[i][1:3], turn, True) for i in rng.sample(sorted(table), 4)]
        gone = {c[0] for c in changes if c[4]}
        for c in changes:
            if c[0] in gone:
                table.pop(c[0], None)
            else:
                table[c[0]] = c[:4]
        told = spark.createDataFrame(changes, f"{kind}, gone boolean")
        after = components.apply_changes(edges, told)
        assert sorted(map(tuple, after.collect())) == sorted(table.values())
        assert sorted(map(tuple, components.apply_changes(after, told).collect())) == sorted(table.values())
        known = components.written(components.mend_components(known, after, components.touched_nodes(edges, told)), "known")
        edges = components.written(after, "edges")
        assert {r["node"]: r["component"] for r in known.collect()} == plain_components([r[1:3] for r in table.values()])


def quality(edges, of):
    m = sum(w for *_, w in edges)
    inside, total = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[of[a]] += w
        total[of[b]] += w
        inside[of[a]] += w if of[a] == of[b] else 0
    return sum(inside[c] / m - (total[c] / (2 * m)) ** 2 for c in total)


def plain_louvain(edges):
    """Nodes in order, each to the best neighbouring community, until nothing moves; then the contracted graph."""
    member, edges = {x: x for a, b, _ in edges for x in (a, b)}, list(edges)
    m = sum(w for *_, w in edges)
    while True:
        near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for a, b, w in edges:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        of = {x: x for x in k}
        total, moved, any_move = dict(k), True, False
        while moved:
            moved = False
            for x in sorted(k):
                total[of[x]] -= k[x]
                gain = defaultdict(float)
                gain[of[x]] = -k[x] * total[of[x]] / (2 * m)
                for c in {of[y] for y in near[x]}:
                    gain[c] = sum(w for y, w in near[x].items() if of[y] == c) - k[x] * total[c] / (2 * m)
                best = max(gain, key=lambda c: (gain[c], c == of[x], -c))
                if gain[best] > gain[of[x]] + 1e-9:
                    of[x], moved, any_move = best, True, True
                total[of[x]] += k[x]
        if not any_move:
            return member
        member = {x: of[c] for x, c in member.items()}
        grown = defaultdict(float)
        for a, b, w in edges:
            grown[tuple(sorted((of[a], of[b])))] += w
        edges = [(a, b, w) for (a, b), w in grown.items()]


def graphs():
    ring = [(5 * c + i, 5 * c + j, 1.0) for c in range(8) for i in range(5) for j in range(i)] + [(5 * c, (5 * c + 7) % 40, 1.0) for c in range(8)]
    rng = random.Random(4)
    planted = [(i, j, float(rng.randrange(1, 4))) for i in range(45) for j in range(i) if rng.random() < (0.5 if i % 3 == j % 3 else 0.06)]
    sparse = [(i, j, 1.0) for i in range(60) for j in range(i) if rng.random() < 0.05]
    return {"ring": ring, "planted": planted, "sparse": sparse}


@pytest.mark.parametrize("name", ["ring", "planted", "sparse"])
def test_louvain_is_no_worse_than_the_plain_one(spark, name):
    edges = graphs()[name]
    df = spark.createDataFrame(edges, "src int, dst int, weight double").repartition(3)
    found = communities.louvain(df)
    of = {r["node"]: r["community"] for r in found.collect()}
    assert of.keys() == {x for a, b, _ in edges for x in (a, b)} and all(of[c] == c and c <= x for x, c in of.items())
    assert abs(communities.modularity(df, found) - quality(edges, of)) < 1e-9
    assert quality(edges, of) >= quality(edges, plain_louvain(edges)) - 1e-9


def test_louvain_of_few_edges(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 3, 2.0), (None, 4, 1.0)], "src int, dst int, weight double")
    assert {r["node"]: r["community"] for r in communities.louvain(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert communities.louvain(df.limit(0)).count() == 0


def test_root_paths_are_not_shuffled_at_the_end(spark):
    from tallyframe.operators import records

    edges = spark.createDataFrame([(1, 1, 2, 0.5), (2, 2, 3, 0.5), (3, 9, 3, 1.0), (4, 3, 2, 1.0)], "id int, src int, dst int, score double")
    found = records.root_paths(edges, 5)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["root"], r["problem"], tuple(r["path"]), r["depth"], r["score"]) for r in found.collect()} == {(1, 2, (2, 1), 1, 0.5), (1, 3, (3, 2, 1), 2, 0.25), (9, 3, (3, 9), 1, 1.0), (9, 2, (2, 3, 9), 2, 1.0)}

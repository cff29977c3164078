"""Every ledger query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from tallyframe.plans import algorithms, detection, enrichment, ledger, records, rows

QUERIES, SQL = ledger.QUERIES | enrichment.QUERIES | records.QUERIES | rows.QUERIES | detection.QUERIES | algorithms.QUERIES, ledger.SQL | enrichment.SQL | records.SQL | rows.SQL | detection.SQL | algorithms.SQL

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{f'{path}/*.parquet' if path.is_dir() else path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert _rows(ours.columns, [tuple(r) for r in ours.collect()]) == _rows(columns, theirs.fetchall())


def test_pagerank_sums_to_one(spark):
    ranks = [r["rank"] for r in QUERIES["entity_pagerank"](spark, SF).collect()]
    assert abs(sum(ranks) - 1) < 1e-4


def test_all_queries_leave_no_event_or_edge_out(spark, duck):
    events = duck.execute("SELECT count(*) FROM events").fetchone()[0]
    assert sum(r["usage"] for r in QUERIES["all_mapping_upsert"](spark, SF).collect()) == events
    links = duck.execute(f"WITH {ledger.RELATIONSHIPS_SQL} SELECT source_event_id, target_event_id, confidence_score FROM relationships WHERE confidence_score >= 0.55").fetchall()
    following = {}
    for a, b, score in links:
        following.setdefault(a, []).append((b, score))
    chains = {}
    for root in following:
        reached = {root: (0, 1.0)}
        for depth in range(1, 6):
            step = {}
            for node, (at, score) in reached.items():
                for b, gain in following.get(node, []) if at == depth - 1 else []:
                    if b not in reached:
                        step[b] = max(step.get(b, (depth, 0.0)), (depth, score * gain))
            reached |= step
        chains |= {(root, node): found for node, found in reached.items() if found[0]}
    out = {(r["root"], r["node"]): (r["depth"], r["score"]) for r in QUERIES["all_causal_chains"](spark, SF).collect()}
    assert out.keys() == chains.keys() and all(out[k][0] == d and abs(out[k][1] - s) < 1e-8 for k, (d, s) in chains.items())
    assert {(r["root"], r["node"]) for r in QUERIES["all_counterfactual_amounts"](spark, SF).collect()} == chains.keys()
    ends = {(node, root) for root, node in chains if root not in {b for _, b, _ in links}}
    assert {(r["root"], r["node"]) for r in QUERIES["all_root_causes"](spark, SF).collect()} == ends
    edges = duck.execute(f"WITH {ledger.EDGES_SQL} SELECT src, dst FROM entity_edges").fetchall()
    hops, newest = {0: 0}, {0}
    for h in range(1, 6):
        newest = {b for a, b in edges if a in newest} - hops.keys()
        hops |= dict.fromkeys(newest, h)
    assert {r["node"]: r["hops"] for r in QUERIES["all_shortest_paths"](spark, SF).collect()} == hops


def test_entry_and_registries_agree(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["user_id", "month", "income", "expense", "net", "n_events"]


def test_minhash_pairs_hold_every_close_name(spark, duck):
    names = duck.execute("SELECT DISTINCT p_brand, p_name FROM part").fetchall()
    grams = lambda name: {f"  {w} "[i : i + 3] for w in name.lower().split() for i in range(len(w) + 1)}
    alike = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    found = {(r["p_brand"], r["name"], r["other"]): r["exact"] for r in QUERIES["minhash_pairs"](spark, SF).collect()}
    assert found and all(abs(alike(a, b) - exact) < 1e-4 for (_, a, b), exact in found.items())
    close = {(p, a, b) for p, a in names for q, b in names if p == q and a < b and alike(a, b) >= 0.8}
    assert close <= found.keys()

"""Queries over series, graphs and dated rates, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, centrality, communities, components, profiles
from ..operators.lineage_cut import own_folder, written
from ..operators.timeseries import daily_series
from ..sources.adapters import EDGES_SQL, LEDGER_SQL, RELATIONSHIPS_SQL, entity_edges, ledger_events, relationships
from ..sources.records import ctes, view
from ..streaming import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def platform_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(platform, day, at, value): daily amounts of each platform, days numbered from 0, empty ones 0."""
    days = daily_series(ledger_events(spark, sf_dir).select("source_platform", "source_ts", "amount_usd"), "source_platform", "source_ts", "amount_usd")
    first = days.groupBy(F.col("source_platform").alias("platform")).agg(F.min("day").alias("first"))
    return days.join(first, F.col("source_platform") == F.col("platform")).select("platform", "day", F.datediff("day", "first").cast("bigint").alias("at"), "value")


_SERIES_SQL = f"""{LEDGER_SQL}, sums AS (SELECT source_platform AS platform, CAST(source_ts AS DATE) AS day, CAST(sum(amount_usd) AS DOUBLE) AS value FROM ledger_events GROUP BY 1, 2),
 days AS (SELECT platform, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM sums GROUP BY 1),
 series AS (SELECT platform, day, row_number() OVER (PARTITION BY platform ORDER BY day) - 1 AS at_day, coalesce(value, 0.0) AS value FROM days LEFT JOIN sums USING (platform, day))"""


def _profile_sql(m: int) -> str:
    return f"""{_SERIES_SQL}, windows AS (SELECT platform, at_day AS p, list(value) OVER (PARTITION BY platform ORDER BY at_day ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS x FROM series),
 shapes AS (SELECT platform, p, list_max(x) = list_min(x) AS flat, [v - list_avg(x) FOR v IN x] AS c FROM windows WHERE len(x) = {m}),
 units AS (SELECT platform, p, flat, CASE WHEN flat THEN c ELSE [v / sqrt(list_dot_product(c, c)) FOR v IN c] END AS u FROM shapes),
 pairs AS (SELECT a.platform, a.p, b.p AS q, round(CASE WHEN a.flat AND b.flat THEN 0 WHEN a.flat OR b.flat THEN sqrt({m}) ELSE sqrt(greatest(0, {2 * m} * (1 - list_dot_product(a.u, b.u)))) END, 6) AS d
  FROM units a JOIN units b ON a.platform = b.platform AND abs(a.p - b.p) > {profiles.zone(m)}),
 profile AS (SELECT platform, p, min(d) AS distance, arg_min(q, (d, q)) AS neighbour FROM pairs GROUP BY 1, 2)"""


@_query("matrix_profile", f"WITH {_profile_sql(7)} SELECT platform, CAST(p AS BIGINT) AS at_day, distance, CAST(neighbour AS BIGINT) AS neighbour FROM profile")
def matrix_profile(spark, sf_dir):
    """The nearest other week, in shape, of every week of every platform."""
    return profiles.matrix_profile(platform_series(spark, sf_dir), "platform", "at", "value", 7).withColumnRenamed("at", "at_day")


@_query("motif_discovery")
def motif_discovery(spark, sf_dir):
    """The three closest pairs of weeks of every platform."""
    found = profiles.matrix_profile(platform_series(spark, sf_dir), "platform", "at", "value", 7)
    return profiles.motifs(found, "platform", "at", 7).select("platform", "rank", F.col("at").alias("at_day"), "neighbour", "distance")


@_query("motif_periods")
def motif_periods(spark, sf_dir):
    """The window, of 7, 14 and 30 days, whose best motif stands out on each platform."""
    return profiles.motif_periods(platform_series(spark, sf_dir), "platform", "at", "value").withColumn("confidence", F.round("confidence", 6))


@_query("arc_curve", f"""WITH {_profile_sql(7)}, steps AS (SELECT platform, least(p, neighbour) AS place, 1 AS step FROM profile UNION ALL SELECT platform, greatest(p, neighbour), -1 FROM profile),
 arcs AS (SELECT platform, p, n, sum(coalesce(step, 0)) OVER (PARTITION BY platform ORDER BY p) AS arcs FROM (SELECT platform, p, count(*) OVER (PARTITION BY platform) AS n FROM profile) LEFT JOIN (SELECT platform, place AS p, sum(step) AS step FROM steps GROUP BY 1, 2) USING (platform, p))
 SELECT platform, CAST(p AS BIGINT) AS at_day, CASE WHEN p < 7 OR p >= n - 7 THEN 1.0 ELSE least(round(arcs / (2 * p * (n - p) / n), 9), 1) END AS crossing FROM arcs""")
def arc_curve(spark, sf_dir):
    """How many of the arcs between like weeks cross each day, against chance."""
    found = profiles.matrix_profile(platform_series(spark, sf_dir), "platform", "at", "value", 7)
    return profiles.arc_curve(found, "platform", "at", 7).withColumnRenamed("at", "at_day")


@_query("regime_segments")
def regime_segments(spark, sf_dir):
    """Up to four days at which each platform's amounts change their shape, with mean and deviation of the weeks on either side."""
    series = platform_series(spark, sf_dir)
    found = profiles.regime_changes(series, "platform", "at", "value", 7)
    dated = found.join(series.select("platform", "at", "day"), ["platform", "at"])
    return dated.select("platform", "day", "rank", *(F.round(c, 6).alias(c) for c in ("crossing", "mean_before", "sd_before", "mean_after", "sd_after", "magnitude")))


def heavy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade between entities that weighs more than the mean."""
    edges = entity_edges(spark, sf_dir)
    return edges.join(edges.agg(F.avg("n_lines").alias("mean"))).where("n_lines > mean").drop("mean")


_HEAVY_SQL = f"{EDGES_SQL.strip()}, heavy AS (SELECT src, dst, n_lines FROM entity_edges WHERE n_lines > (SELECT avg(n_lines) FROM entity_edges)), graph AS (SELECT src, dst FROM heavy WHERE src <> dst), nodes AS (SELECT src AS node FROM graph UNION SELECT dst FROM graph)"
#: Longest shortest path that the SQL follows; 25 entities of which half are linked are much closer.
_DEEPEST = 8
_LEVELS_SQL = ", ".join(
    ["l0 AS (SELECT node AS s, node AS t, CAST(1 AS DOUBLE) AS paths FROM nodes)"]
    + [
        f"l{d} AS (SELECT s, dst AS t, sum(paths) AS paths FROM l{d - 1} JOIN graph ON t = src WHERE NOT EXISTS (FROM ({' UNION ALL '.join(f'SELECT s, t FROM l{k}' for k in range(d))}) seen WHERE seen.s = l{d - 1}.s AND seen.t = dst) GROUP BY 1, 2)"
        for d in range(1, _DEEPEST + 1)
    ]
)


@_query("entity_centrality", f"""WITH {_HEAVY_SQL}, {_LEVELS_SQL}, far AS ({" UNION ALL ".join(f"SELECT s, t, {d} AS d, paths FROM l{d}" for d in range(_DEEPEST + 1))}),
 between AS (SELECT a.t AS node, sum(a.paths * b.paths / c.paths) AS b FROM far a JOIN far b ON a.t = b.s JOIN far c ON a.s = c.s AND b.t = c.t WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = c.d GROUP BY 1),
 close AS (SELECT s AS node, count(*) AS reached, sum(d) AS hops FROM far WHERE d > 0 GROUP BY 1)
 SELECT node, round(coalesce(b, 0), 6) AS betweenness, round(reached / hops, 9) AS closeness, coalesce(reached, 0) AS reached FROM nodes LEFT JOIN between USING (node) LEFT JOIN close USING (node)""")
def entity_centrality(spark, sf_dir):
    """Betweenness and closeness of entities along their heavier trade."""
    found = centrality.centrality(heavy_edges(spark, sf_dir))
    return found.select("node", F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 9).alias("closeness"), "reached")


@_query("entity_louvain")
def entity_louvain(spark, sf_dir):
    """Communities of entities by the modularity of their trade."""
    return communities.louvain(entity_edges(spark, sf_dir).select("src", "dst", F.col("n_lines").cast("double").alias("weight")))


@_query("entity_graph_summary", f"""WITH {_HEAVY_SQL}, n AS (SELECT count(*) AS n_edges FROM heavy), v AS (SELECT count(*) AS n_nodes FROM (SELECT src FROM heavy UNION SELECT dst FROM heavy)),
 reach AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM heavy), ends AS (SELECT a, b FROM reach UNION SELECT b, a FROM reach UNION SELECT a, a FROM reach UNION SELECT b, b FROM reach),
 r2 AS (SELECT DISTINCT x.a, y.b FROM ends x JOIN ends y ON x.b = y.a), r4 AS (SELECT DISTINCT x.a, y.b FROM r2 x JOIN r2 y ON x.b = y.a), r8 AS (SELECT DISTINCT x.a, y.b FROM r4 x JOIN r4 y ON x.b = y.a), r16 AS (SELECT DISTINCT x.a, y.b FROM r8 x JOIN r8 y ON x.b = y.a), r32 AS (SELECT DISTINCT x.a, y.b FROM r16 x JOIN r16 y ON x.b = y.a),
 c AS (SELECT component, count(*) AS k FROM (SELECT a, min(b) AS component FROM r32 GROUP BY 1) GROUP BY 1)
 SELECT n_nodes, n_edges, round(2 * n_edges / n_nodes, 6) AS avg_degree, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, (SELECT count(*) FROM c) AS n_components, (SELECT max(k) FROM c) AS largest_component FROM n, v""")
def entity_graph_summary(spark, sf_dir):
    """Nodes, edges, degree, density and weak components of the heavier trade."""
    return components.graph_summary(heavy_edges(spark, sf_dir))


def _linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships(ledger_events(spark, sf_dir)).select(F.col("relationship_id").alias("id"), F.col("source_event_id").alias("src"), F.col("target_event_id").alias("dst"), F.lit(0).alias("changed_at"))


@_query("event_components", f"WITH {RELATIONSHIPS_SQL.strip()}, n AS (SELECT event_id, min(event_id) OVER (PARTITION BY file_id) AS component, count(*) OVER (PARTITION BY file_id) AS k FROM ledger_events) SELECT event_id, component FROM n WHERE k > 1")
def event_components(spark, sf_dir):
    """Events that relationships connect, each with the smallest of its component."""
    return components.weak_components(_linked_events(spark, sf_dir)).select(F.col("node").alias("event_id"), "component")


@_query("mended_event_components", f"""WITH {RELATIONSHIPS_SQL.strip()}, links AS (SELECT source_event_id AS a, target_event_id AS b FROM relationships WHERE relationship_id % 7 <> 0),
 chain AS (SELECT event_id, file_id, row_number() OVER w AS k, coalesce(lag(event_id) OVER w IN (SELECT a FROM links), false) AS joined, event_id IN (SELECT a FROM links) AS goes_on FROM ledger_events WINDOW w AS (PARTITION BY file_id ORDER BY source_ts, event_id)),
 parts AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY k) AS part FROM chain WHERE joined OR goes_on)
 SELECT event_id, min(event_id) OVER (PARTITION BY file_id, part) AS component FROM parts""")
def mended_event_components(spark, sf_dir):
    """Components after changes: relationships but every third are known first, then those are added and every seventh of all goes; only touched components are built again."""
    links = written(_linked_events(spark, sf_dir), "links")
    known, later = links.where("id % 3 <> 0"), links.where("id % 3 = 0 AND id % 7 <> 0").withColumn("gone", F.lit(False))
    changes = later.unionByName(links.where("id % 7 = 0").withColumn("gone", F.lit(True))).withColumn("changed_at", F.lit(1))
    before = written(components.weak_components(known), "before")
    after = written(components.apply_changes(known, changes), "after")
    return components.mend_components(before, after, components.touched_nodes(known, changes)).select(F.col("node").alias("event_id"), "component")


@_query("amounts_at_dated_rates", f"""WITH {ctes("dated_amounts", "dated_rates")} SELECT event_id, a.currency, a.day, amount, rate, r.day AS rate_day, round(CAST(amount AS DOUBLE) * rate, 4) AS amount_usd
 FROM dated_amounts a ASOF LEFT JOIN dated_rates r ON a.currency = r.currency AND a.day >= r.day""")
def amounts_at_dated_rates(spark, sf_dir):
    """Amounts at their currency's latest rate of that day or before; nine tenths are of one currency, and one has no rates."""
    found = asof.asof_join(view(spark, sf_dir, "dated_amounts"), view(spark, sf_dir, "dated_rates"), "currency", "day", "rate", out="rate", out_at="rate_day")
    return found.withColumn("amount_usd", F.round(F.col("amount").cast("double") * F.col("rate"), 4))


_ENRICHED = {"relationships": "instances", "causal": "causal_rows", "temporal": "temporal_rows", "patterns": "pattern_rows", "cross_platform": "cross_rows", "predicted": "predicted_rows", "causes": "cause_rows"}


@_query("enriched_view_after_batches", f"""WITH {RELATIONSHIPS_SQL.strip()}, {ctes(*_ENRICHED.values())}
 SELECT r.id, r.user_id, r.source_event_id, r.target_event_id, r.relationship_type, r.pattern_id, r.confidence_score, coalesce(c.causal_score, 0.0) AS causal_strength, coalesce(c.causal_direction, 'none') AS causal_direction,
  t.id AS temporal_pattern_id, coalesce(t.confidence_score, 0.0) AS recurrence_score, coalesce('Every ' || CAST(avg_days_between AS VARCHAR) || ' days', 'none') AS recurrence_frequency, coalesce(seasonal_period_days, 0) AS seasonal_pattern_id, coalesce(seasonal_amplitude, 0.0) AS seasonal_strength,
  p.id AS pattern_id_enriched, coalesce(p.relationship_type, '') AS pattern_name, x.id AS cross_platform_id, coalesce(source_platform, '') AS platform_sources, d.id AS predicted_relationship_id, coalesce(d.confidence_score, 0.0) AS prediction_confidence, coalesce(prediction_reasoning, '') AS prediction_reason,
  a.id AS root_cause_id, coalesce(root_cause_description, '') AS root_cause_analysis
 FROM instances r LEFT JOIN causal_rows c ON r.id = c.relationship_id AND r.user_id = c.user_id LEFT JOIN temporal_rows t ON r.relationship_type = t.relationship_type AND r.user_id = t.user_id LEFT JOIN pattern_rows p ON r.pattern_id = p.id AND r.user_id = p.user_id
 LEFT JOIN cross_rows x ON r.source_event_id = x.source_event_id AND r.target_event_id = x.target_event_id AND r.user_id = x.user_id LEFT JOIN predicted_rows d ON r.source_event_id = d.source_event_id AND r.user_id = d.user_id AND d.status IN ('pending', 'fulfilled')
 LEFT JOIN cause_rows a ON r.source_event_id = a.problem_event_id AND r.user_id = a.user_id""")
def enriched_view_after_batches(spark, sf_dir):
    """The stored view of relationships and six tables around them: built without some rows and with stale ones, then mended by two batches of changed keys."""
    # relationships are made once; of the tables around them only aggregates are written, the others are filters
    made = written(relationships(ledger_events(spark, sf_dir)), "relationships")
    final = {name: view(spark, sf_dir, source, relationships=made) for name, source in _ENRICHED.items()}
    final |= {name: written(final[name], name) for name in ("temporal", "patterns")}
    links = final["relationships"]
    late, stale = links.where("id % 8 = 3"), links.where("id % 6 = 1")
    early = links.where("id % 8 <> 3").withColumn("confidence_score", F.when(F.col("id") % 6 == 1, 0.0).otherwise(F.col("confidence_score")))
    steps = [
        final | {"relationships": early, "causal": final["causal"].where("relationship_id % 2 = 0"), "predicted": final["predicted"].limit(0), "patterns": final["patterns"].where("id <> 2")},
        final | {"predicted": final["predicted"].limit(0)},
        final,
    ]
    now = {"tables": steps[0]}
    kept = views.EnrichedView(spark, own_folder(spark, "enriched-view"), lambda: now["tables"])
    kept.build()
    told = [views.changed_keys("relationships", late.unionByName(stale)), views.changed_keys("causal", final["causal"].where("relationship_id % 2 <> 0")), views.changed_keys("patterns", final["patterns"].where("id = 2"))]
    now["tables"] = steps[1]
    kept.merge(told[0].unionByName(told[1]).unionByName(told[2]), 1)
    now["tables"] = steps[2]
    kept.merge(views.changed_keys("predicted", final["predicted"]), 2)
    return kept.current()


@_query("refreshed_dashboard_metrics", f"WITH {LEDGER_SQL} SELECT user_id, count(*) AS n_events, CAST(sum(amount_usd) AS DOUBLE) AS amount, count(DISTINCT vendor_standard) AS n_vendors, max(source_ts) AS last_event FROM ledger_events GROUP BY 1")
def refreshed_dashboard_metrics(spark, sf_dir):
    """A table of metrics by user: made from two thirds of the events, then again for the users that got more."""
    events = written(ledger_events(spark, sf_dir), "events")
    now = {"rows": events.where("event_id % 3 <> 0")}

    def metrics(rows: DataFrame) -> DataFrame:
        return rows.groupBy("user_id").agg(F.count("*").alias("n_events"), F.sum("amount_usd").cast("double").alias("amount"), F.countDistinct("vendor_standard").alias("n_vendors"), F.max("source_ts").alias("last_event"))

    kept = views.MetricsView(spark, own_folder(spark, "metrics"), lambda: now["rows"], metrics)
    kept.refresh()
    now["rows"] = events
    kept.refresh(1, events.where("event_id % 3 = 0"))
    return kept.current()

"""Queries of joins, aggregations, views, change data, measures, clustering and graph loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import changes, clustering, dedupe, graph, measures, relations, sequences, views
from ..sources import bridge as B
from ..streaming import events as streams
from .registry import query

_REL = """CASE WHEN kind IN ('import', 'inherit') THEN 'depends_on' WHEN kind IN ('call', 'render') THEN 'calls' WHEN kind = 'http' THEN CASE WHEN target_file IS NOT NULL THEN 'http_contract' WHEN target_kind = 'resource' THEN 'external_api' END
    WHEN kind = 'database' AND (target_file IS NOT NULL OR target_kind = 'resource') THEN CASE operation WHEN 'read' THEN 'reads' WHEN 'write' THEN 'writes' END WHEN kind = 'event' THEN CASE operation WHEN 'publish' THEN 'publishes_event' WHEN 'subscribe' THEN 'subscribes_event' END END"""
_PLACED = """, placed AS (SELECT r.*, s.module AS source_module, CASE WHEN target_kind = 'resource' THEN resource_id ELSE t.module END AS target_module FROM b_relations r LEFT JOIN b_module_files s ON source_file = s.file LEFT JOIN b_module_files t ON target_file = t.file),
    cand AS (SELECT *, _REL_ AS relation FROM placed WHERE source_module IS NOT NULL AND target_module IS NOT NULL AND source_module <> target_module),
    edge AS (SELECT *, CASE WHEN operation = 'subscribe' THEN target_module ELSE source_module END AS source, CASE WHEN operation = 'subscribe' THEN source_module ELSE target_module END AS target FROM cand WHERE relation IS NOT NULL)""".replace("_REL_", _REL)  # fmt: skip
_REASON = """, skip AS (SELECT *, CASE WHEN target_file IS NOT NULL AND source_module = target_module THEN 'same-module' WHEN target_kind = 'unresolved' AND n_candidates > 1 THEN 'ambiguous-target' WHEN target_kind = 'external' THEN 'external' WHEN kind IN ('event', 'process') AND operation IS NULL THEN 'direction-unknown' ELSE 'unlocated-target' END AS reason FROM placed WHERE id NOT IN (SELECT id FROM edge))"""


def _facts(spark, d):
    return B.relations(spark, d), B.module_files(spark, d)


def _classes(spark, d):
    return B.relation_classes(spark, d), None  # the modules are there already


@query("a1_relationships", B.with_views(_PLACED + " SELECT source, target, relation, confidence, count(DISTINCT id) AS "
    "n_relations, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, "
    "coalesce(array_to_string(list_sort(list(DISTINCT operation) FILTER (operation IS NOT NULL)), ','), '') AS "
    "operations, min(detail) AS description, min(id) AS first_relation, max(id) AS last_relation, source || '-' || "
    "target || '-' || relation || '-' || confidence AS id FROM edge GROUP BY source, target, relation, confidence",
    "relations", "module_files"))
def relationships(spark, d):
    out = relations.relationships(*_classes(spark, d))
    return out.withColumns({"kinds": F.array_join("kinds", ","), "operations": F.array_join("operations", ",")})


@query("a2_skipped", B.with_views(_PLACED + _REASON + " SELECT kind, reason, count(*) AS n, min(id) AS first_id FROM "
    "skip GROUP BY kind, reason", "relations", "module_files"))
def _(spark, d):
    return relations.skipped(*_classes(spark, d))


@query("a3_outcomes", B.with_views(_PLACED + _REASON + ", reasons AS (SELECT DISTINCT id, reason FROM skip) SELECT "
    "kind, CASE reason WHEN 'same-module' THEN 'module-internal' WHEN 'external' THEN 'external' WHEN "
    "'ambiguous-target' THEN 'ambiguous' WHEN 'direction-unknown' THEN 'unsupported' WHEN 'unlocated-target' THEN "
    "'unresolved' ELSE 'architecture-edge' END AS outcome, count(*) AS n FROM b_relations LEFT JOIN reasons USING (id) "
    "GROUP BY ALL", "relations", "module_files"))
def _(spark, d):
    return relations.outcomes(*_classes(spark, d))


@query("a4_module_summary", B.with_views(_PLACED + " SELECT source_module AS module, count(*) FILTER (kind IN "
    "('import', 'inherit')) AS dependencies, count(*) FILTER (target_file IS NOT NULL AND source_module = "
    "target_module) AS internal, count(*) FILTER (target_kind = 'unresolved') AS unresolved, count(*) FILTER "
    "(target_kind IN ('external', 'resource')) AS external FROM placed WHERE source_module IS NOT NULL GROUP BY 1",
    "relations", "module_files"))
def _(spark, d):
    return relations.module_summary(*_facts(spark, d))


@query("a5_scan_summary", B.with_views("SELECT scope, module, count(*) AS files, sum(size) AS bytes FROM b_files GROUP "
    "BY ALL", "files"))
def _(spark, d):
    return B.files(spark, d).groupBy("scope", "module").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("a6_quality", B.with_views(", f AS (SELECT count(*) AS eligible, count(*) FILTER (status = 'parsed') AS parsed, "
    "count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'unsupported') AS unsupported FROM "
    "b_files), r AS (SELECT count(*) FILTER (kind = 'import') AS imports, count(*) FILTER (kind = 'call') AS calls, "
    "count(*) FILTER (target_kind = 'unresolved') AS unresolved, count(*) FILTER (target_kind = 'unresolved' AND "
    "n_candidates > 1) AS ambiguous FROM b_relations) SELECT *, parsed / eligible AS completeness FROM f, r", "files",
    "relations"))
def _(spark, d):
    return measures.quality(B.files(spark, d), B.relations(spark, d))


@query("a7_capabilities", B.with_views(
    f", l AS (SELECT scope, path, status, split_part(path, '.', -1) AS language FROM b_files), g AS (SELECT scope, language, count(DISTINCT path) AS files, count(DISTINCT path) FILTER (status = 'parsed') AS parsed, count(DISTINCT path) FILTER (status = 'failed') AS limited FROM l GROUP BY ALL) SELECT *, CASE WHEN parsed = 0 THEN 'unavailable' WHEN parsed < files THEN 'partial' ELSE 'available' END AS state FROM g", "files"))
def _(spark, d):
    return measures.capabilities(B.files(spark, d).withColumn("language", F.split_part("path", F.lit("."), F.lit(-1))))


@query("a8_coverage", B.with_views(", a AS (SELECT count(*) AS files, count(*) FILTER (file IN (SELECT file FROM "
    "b_module_files WHERE module LIKE '%1')) AS owned FROM (SELECT DISTINCT file FROM b_module_files)), b AS (SELECT "
    "count(*) AS edges, count(*) FILTER (n_relations > 0) AS proven FROM b_edges) SELECT *, owned / files AS "
    "file_coverage, CASE WHEN edges > 0 THEN proven / edges ELSE 0 END AS evidence_coverage, file_coverage >= 0.7 AND "
    "evidence_coverage >= 0.3 AS valid FROM a, b", "module_files", "edges"))
def _(spark, d):
    m = B.module_files(spark, d)
    return measures.coverage(m.select(F.col("file").alias("path")), m.where("module like '%1'"), B.edges(spark, d))


@query("a9_majority", B.with_views("SELECT module, label, votes FROM (SELECT module, scope AS label, count(*) AS "
    "votes, row_number() OVER (PARTITION BY module ORDER BY count(*) DESC, scope) AS rn FROM b_files GROUP BY module, "
    "scope) WHERE rn = 1", "files"))
def _(spark, d):
    return relations.majority(B.files(spark, d).withColumn("label", F.col("scope")), "module", "label")


@query("a10_unique_label", B.with_views("SELECT module, CASE WHEN count(DISTINCT scope) = 1 THEN min(scope) END AS "
    "scope FROM b_files GROUP BY module", "files"))
def _(spark, d):
    return relations.unique_label(B.files(spark, d), "module", "scope")


@query("a13_resources", B.with_views(", k AS (SELECT kind, source_file, CASE kind WHEN 'http' THEN 'api:GET:https://h' "
    "|| length(symbol) || ':/x' WHEN 'event' THEN 'event:bus:' || symbol WHEN 'database' THEN 'database:app:' || "
    "symbol END AS key FROM b_relations WHERE kind IN ('http', 'event', 'database')) SELECT key, min(kind) AS kind, "
    "count(*) AS n_operations, count(DISTINCT source_file) AS n_files, 'resource:' || substr(sha256(key), 1, 24) AS id "
    "FROM k GROUP BY key", "relations"))
def _(spark, d):
    r = B.relations(spark, d).where("kind in ('http', 'event', 'database')")
    target = F.when(F.col("kind") == "http", F.concat(F.lit("https://h"), F.length("symbol"), F.lit(
        "/x?y=1"))).when(F.col("kind") == "database", F.concat(F.lit("select * from "), "symbol")).otherwise(F.col(
        "symbol"))
    ops = r.select("id", "kind", target.alias("target"), F.lit("GET").alias("method"), F.when(F.col("kind") == "event",
        F.lit("bus")).alias("receiver"), F.lit("app").alias("scope"), F.col("source_file").alias("file"))
    return relations.resources(ops)


@query("a15_collapsed", B.with_views(", n AS (SELECT id, CASE WHEN group_path[1] = 'ASIA' THEN 'group:ASIA' WHEN "
    "group_path[2] = 'EUROPE/1' THEN 'group:EUROPE/1' ELSE id END AS shown FROM b_nodes), e AS (SELECT e.*, a.shown AS "
    "a, b.shown AS b FROM b_edges e JOIN n a ON source = a.id JOIN n b ON target = b.id) SELECT CASE WHEN a = source "
    "AND b = target THEN id ELSE 'aggregate:' || a || ':' || b || ':' || relation END AS id, a AS source, b AS target, "
    "relation, CASE WHEN bool_and(confidence = 'confirmed') THEN 'confirmed' ELSE 'inferred' END AS confidence, "
    "count(*) AS n_edges, min(id) AS first_edge FROM e WHERE a <> b GROUP BY 1, 2, 3, 4", "nodes", "edges"))
def _(spark, d):
    return views.collapsed(B.nodes(spark, d), B.edges(spark, d), ["ASIA", "EUROPE/1"])


@query("a16_confidence_scores", "SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' "
    "END AS level FROM (SELECT *, floor((parsing_score + symbols_score + relations_score + evidence_score + "
    "freshness_score) * 10 + 0.5) / 10 AS score FROM (SELECT s_suppkey AS id, floor((s_suppkey % 11 / 10.0::DOUBLE) * "
    "25 * 10 + 0.5) / 10 AS parsing_score, floor((s_suppkey % 7 / 6.0::DOUBLE) * 25 * 10 + 0.5) / 10 AS symbols_score, "
    "floor((s_suppkey % 5 / 4.0::DOUBLE) * 25 * 10 + 0.5) / 10 AS relations_score, floor((s_suppkey % 3 / 2.0::DOUBLE) "
    "* 15 * 10 + 0.5) / 10 AS evidence_score, CASE WHEN s_suppkey % 2 = 0 THEN 10.0 ELSE 0.0 END AS freshness_score "
    "FROM supplier))")
def _(spark, d):
    k = F.col("s_suppkey")
    m = B.table(spark, d, "supplier").select(k.alias("id"), (k % 11 / 10.0).alias("parsing"), (k % 7 / 6.0).alias(
        "symbols"), (k % 5 / 4.0).alias("relations"), (k % 3 / 2.0).alias("evidence"), (k % 2 == 0).alias("current"))
    return measures.confidence_scores(m).drop("parsing", "symbols", "relations", "evidence", "current")


@query("a17_risk_scores",
    B.with_views(
    """, e AS (SELECT id, count(*) AS edges, count(DISTINCT relation) AS rels FROM (SELECT source AS id, relation FROM b_edges UNION ALL SELECT target, relation FROM b_edges) GROUP BY id),
    p AS (SELECT n.id, (length(n.id) % 4 * 8)::DOUBLE AS sensitive_score, floor(least(1.0, coalesce(edges, 0) / 6.0::DOUBLE) * 25 * 10 + 0.5) / 10 AS central_score, least(20, length(n.id) % 3 * 4 + 2)::DOUBLE AS effect_score, least(15, coalesce(edges, 0) * 3 + coalesce(rels, 0) * 2)::DOUBLE AS impact_score, CASE WHEN node_type = 'test' THEN 0.0 ELSE 10.0 END AS test_score FROM b_nodes n LEFT JOIN e USING (id))
    SELECT *, floor((sensitive_score + central_score + effect_score + impact_score + test_score) * 10 + 0.5) / 10 AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM p""", "nodes", "edges"))  # fmt: skip
def _(spark, d):
    n, e = B.nodes(spark, d), B.edges(spark, d)
    ends = e.select(F.explode(F.array("source", "target")).alias("id"), "relation").groupBy("id").agg(F.count("*")
        .alias("edges"), F.countDistinct("relation").alias("relations"))
    size = F.length("id")
    said = F.concat(F.when(size % 4 >= 1, F.lit("auth ")).otherwise(F.lit("")), F.when(size % 4 >= 2, F.lit("payment "))
        .otherwise(F.lit("")), F.when(size % 4 >= 3, F.lit("token")).otherwise(F.lit("")))
    m = n.select("id", "node_type").join(ends, "id", "left").select("id", measures.sensitive_points(said, F.lit(""),
        F.lit("")).alias("sensitive"), F.coalesce("edges", F.lit(0)).alias("edges"), F.lit(25).alias("modules"),
        (size % 3).alias("effects"), F.lit(1).alias("external_calls"), F.coalesce("relations", F.lit(0)).alias(
        "relations"), F.lit(1).alias("files"), (F.col("node_type") == "test").alias("tested"))
    return measures.risk_scores(m).drop("sensitive", "edges", "modules", "effects", "external_calls", "relations",
        "files", "tested")


@query("a19_diff_counts", B.with_views("SELECT count(*) FILTER (doc_id % 10 = 0) AS added, count(*) FILTER (doc_id % "
    "10 = 1) AS removed, count(*) FILTER (doc_id % 10 = 2) AS modified FROM b_files", "files"))
def _(spark, d):
    f, m = B.files(spark, d), F.col("doc_id") % 10
    return changes.diff_counts(f.where(m != 0), f.where(m != 1).withColumn("size", F.when(m == 2, F.col("size") + 1)
        .otherwise(F.col("size"))), "path", ["path", "size", "hash"])


@query("a20_confusion", "SELECT lang, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE "
    "WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + "
    "fn) END AS f1 FROM (SELECT lang, count(*) FILTER (p AND h) AS tp, count(*) FILTER (NOT p AND h) AS fp, count(*) "
    "FILTER (p AND NOT h) AS fn, count(*) FILTER (NOT p AND NOT h) AS tn FROM (SELECT lang, quality = 1 AS p, n_chars "
    "> 400 AS h FROM labels JOIN documents USING (doc_id)) GROUP BY lang)")
def _(spark, d):
    j = B.table(spark, d, "labels").join(B.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return measures.confusion(j.select(F.col("doc_id").alias("id"), "lang", (F.col("quality") == 1).alias("present")),
        j.where("n_chars > 400").select(F.col("doc_id").alias("id")), "lang")


@query("a21_percentiles", B.with_views("SELECT metric, band, count(value) AS n, quantile_disc(value, 0.5) AS p50, "
    "quantile_disc(value, 0.95) AS p95, median(value) AS median, max(value) AS max FROM b_samples GROUP BY metric, "
    "band", "samples"))
def _(spark, d):
    return measures.percentiles(B.samples(spark, d), ["metric", "band"], "value")


@query("a23_complete_means", "SELECT event_type, CASE WHEN count(v) = count(*) THEN avg(v) END AS mean FROM (SELECT "
    "event_type, CASE WHEN event_type LIKE 'p%' AND event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events) GROUP "
    "BY event_type")
def _(spark, d):
    v = F.when(~(F.col("event_type").like("p%") & (F.col("event_id") % 3 == 0)), F.col("value"))
    return B.table(spark, d, "events").select("event_type", v.alias("v")).groupBy(
        "event_type").agg(measures.mean_if_complete("v").alias("mean"))


@query("a24_budgets", B.with_views(", p AS (SELECT scenario, band, metric, project, count(value) AS n, "
    "quantile_disc(value, 0.95) AS p95 FROM b_samples GROUP BY ALL) SELECT scenario, band, metric, max(p95) AS worst, "
    "bool_and(n >= 5) AS complete, any_value(CASE band WHEN 'small' THEN 50.0 WHEN 'medium' THEN 100.0 ELSE 200.0 END) "
    "AS \"limit\", bool_and(n >= 5) AND max(p95) <= any_value(CASE band WHEN 'small' THEN 50.0 WHEN 'medium' THEN "
    "100.0 ELSE 200.0 END) AS passed FROM p GROUP BY scenario, band, metric", "samples"))
def _(spark, d):
    s = B.samples(spark, d)
    limits = s.select("metric", "band").distinct().withColumns({"limit": F.when(F.col("band") == "small", 50.0)
        .when(F.col("band") == "medium", 100.0).otherwise(200.0), "least": F.lit(5)})
    return measures.budgets(s, limits)


@query("a25_ratio_budgets", B.with_views(", a AS (SELECT metric, quantile_disc(value, 0.95) AS p FROM b_samples WHERE "
    "scenario = 'warm' GROUP BY metric), b AS (SELECT metric, quantile_disc(value, 0.95) AS p FROM b_samples WHERE "
    "scenario = 'cold' AND metric <> 'view' GROUP BY metric) SELECT metric, CASE WHEN b.p > 0 THEN a.p / b.p END AS "
    "ratio, CASE WHEN b.p IS NULL OR b.p <= 0 THEN 'not-comparable' WHEN a.p / b.p <= 1.05 THEN 'passed' ELSE 'failed' "
    "END AS verdict FROM a LEFT JOIN b USING (metric)", "samples"))
def _(spark, d):
    s = B.samples(spark, d)
    p95 = lambda x: x.groupBy("metric").agg(measures.nearest_rank("value", 0.95).alias("p95"))
    return measures.ratio_budgets(p95(s.where("scenario = 'warm'")), p95(s.where(
        "scenario = 'cold' and metric <> 'view'")))


@query("a26_long_tasks", B.with_views("SELECT project, count(*) FILTER (value >= 50) AS n, coalesce(sum(value) FILTER "
    "(value >= 50), 0) AS total, coalesce(max(value) FILTER (value >= 50), 0) AS longest FROM b_samples GROUP BY "
    "project", "samples"))
def _(spark, d):
    return measures.long_tasks(B.samples(spark, d), ["project"], "value")


@query("a27_window_peaks", B.with_views("SELECT user_id, max(value) AS peak, arg_min(value, event_id) AS entry, "
    "max(value) - arg_min(value, event_id) AS rise FROM b_samples GROUP BY user_id", "samples"))
def _(spark, d):
    return measures.window_peaks(B.samples(spark, d), ["user_id"], "event_id", "value")


@query("a33_diagnostics")
def _(spark, d):
    f, r = _code(spark, d)
    c = clustering.clusters(f, r)
    return clustering.diagnostics(c, clustering.categories(c), B.files(spark, d).select("file", "module"))


@query("a34_titles", B.with_views("SELECT id, title, suffix, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN "
    "title || ' · ' || suffix ELSE title END AS shown FROM (SELECT id, domain AS title, lower(id) AS suffix FROM "
    "b_nodes UNION ALL SELECT 'x', 'alone', 'y')", "nodes"))
def _(spark, d):
    t = B.nodes(spark, d).select("id", F.col("domain").alias("title"), F.lower("id").alias("suffix"))
    return relations.title_suffixes(t.unionByName(spark.createDataFrame([("x", "alone", "y")],
        "id string, title string, suffix string")))


@query("a35_sequence_problems", B.with_views(", m AS (SELECT diagram, evidence, unnest([sender, receiver]) AS p FROM "
    "b_messages) SELECT diagram, 'unknown-end' AS problem, count(*) AS n FROM m WHERE p = 'system' GROUP BY 1 UNION "
    "ALL SELECT diagram, 'no-evidence', count(*) FROM b_messages WHERE evidence IS NULL GROUP BY 1 UNION ALL SELECT "
    "diagram, 'low-coverage', count(*) FROM b_messages GROUP BY 1 HAVING count(evidence) / count(*) < 0.7", "messages"))
def _(spark, d):
    m = B.messages(spark, d)
    known = m.select("diagram", F.explode(F.array("sender", "receiver")).alias("participant")).distinct().where(
        "participant <> 'system'")
    return sequences.problems(m, known)


@query("a36_paired", "SELECT p_size AS pair, avg(p_retailprice) FILTER (p_partkey % 2 = 0) AS \"off\", "
    "avg(p_retailprice) FILTER (p_partkey % 2 = 1) AS \"on\", avg(p_retailprice) FILTER (p_partkey % 2 = 1) - "
    "avg(p_retailprice) FILTER (p_partkey % 2 = 0) AS delta FROM part GROUP BY p_size")
def _(spark, d):
    runs = B.table(spark, d, "part").groupBy(F.col("p_size").alias("pair"), F.when(F.col("p_partkey") % 2 == 0, F.lit(
        "off")).otherwise(F.lit("on")).alias("mode")).agg(F.avg("p_retailprice").alias("value"))
    return measures.paired(runs)


# ---- joins


@query("j2_scopes", B.with_views("SELECT path AS file, CASE WHEN path LIKE '%/src/%' THEN module || ':src' ELSE module "
    "END AS scope FROM b_files", "files"))
def _(spark, d):
    f = B.files(spark, d)
    tops = f.select("module").distinct()
    scopes = tops.select(F.col("module").alias("scope"), F.col("module").alias("root")).union(tops.select(F.concat(
        "module", F.lit(":src")), F.concat("module", F.lit("/src"))))
    return relations.in_scope(f.select("file"), scopes)


@query("j3_endpoints",
    B.with_views(
    """, q AS (SELECT * FROM b_endpoints WHERE kind = 'request'), r AS (SELECT * FROM b_endpoints WHERE kind = 'route'),
    p AS (SELECT q.id AS request, r.id AS route, CASE WHEN q.confidence = 'confirmed' AND r.confidence = 'confirmed' THEN 'confirmed' ELSE 'inferred' END AS confidence FROM q JOIN r ON q.method = r.method AND CASE WHEN q.service IS NOT NULL AND r.service IS NOT NULL THEN q.service = r.service ELSE q.origin = r.origin END
        WHERE len(list_filter(string_split(q.path, '/'), lambda s: s <> '')) = 2 AND list_filter(string_split(q.path, '/'), lambda s: s <> '')[1] = split_part(r.path, '/', 2))
    SELECT request, min(route) AS route, min(confidence) AS confidence, substr(sha256('http' || chr(0) || request || chr(0) || min(route)), 1, 24) AS relation_id FROM p GROUP BY request HAVING count(*) = 1""", "endpoints"))  # fmt: skip
def _(spark, d):
    return relations.match_endpoints(B.endpoints(spark, d))


@query("j4_relative_imports", B.with_views("SELECT file, './' || split_part(split_part(file, '/', -1), '.', 1) AS "
    "spec, file AS target FROM b_files WHERE path NOT LIKE '%date.util%' AND regexp_matches(path, "
    "'\\.(ts|py|go|java|tsx|rs)$')", "files"))
def _(spark, d):
    f = B.files(spark, d)
    imports = f.select("file", F.concat(F.lit("./"), F.split_part(X.file_name(F.col("file")), F.lit("."), F.lit(1)))
        .alias("spec"))
    return relations.resolve_relative(imports, f)


@query("j5_python_imports", B.with_views("SELECT 'x.py' AS file, replace(regexp_replace(path, '\\.py$', ''), '/', '.') "
    "AS spec, path AS target FROM b_files WHERE path LIKE '%.py' AND path NOT LIKE '%date.util%'", "files"))
def _(spark, d):
    f = B.files(spark, d)
    imports = f.select(F.lit("x.py").alias("file"), F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(
        ".")).alias("spec"))
    return relations.resolve_by_suffix(imports, f)


@query("j6_unresolved_left", B.with_views("SELECT kind, count(*) AS n FROM b_relations WHERE target_file IS NULL GROUP "
    "BY kind", "relations"))
def _(spark, d):
    r = B.relations(spark, d)
    return dedupe.unmatched(r, r.where("target_file is not null"), ["target_file"]).groupBy("kind").agg(F.count("*")
        .alias("n"))


@query("j7_replaced", B.with_views("SELECT confidence, count(*) AS n FROM (SELECT CASE WHEN kind = 'import' THEN "
    "'confirmed' ELSE confidence END AS confidence FROM b_relations) GROUP BY confidence", "relations"))
def _(spark, d):
    r = B.relations(spark, d)
    return relations.replaced(r, r.where("kind = 'import'").withColumn("confidence", F.lit("confirmed"))).groupBy(
        "confidence").agg(F.count("*").alias("n"))


@query("j13_callables", "SELECT o_orderkey AS id, 'f' || o_orderkey % m AS name, o_custkey % 3 AS arity, CASE WHEN c.n "
    "= 1 THEN c.t ELSE -1 END AS target, coalesce(c.n, 0) AS candidates FROM orders CROSS JOIN (SELECT count(*) * 3 // "
    "4 AS m FROM part) LEFT JOIN (SELECT p_partkey % m AS k, p_size % 3 AS a, count(*) AS n, min(p_partkey) AS t FROM "
    "part CROSS JOIN (SELECT count(*) * 3 // 4 AS m FROM part) GROUP BY ALL) c ON o_orderkey % m = c.k AND o_custkey % "
    "3 = c.a")
def _(spark, d):
    part = B.table(spark, d, "part")
    names = F.broadcast(part.agg(F.floor(F.count("*") * 3 / 4).alias(
        "m")))  # one row: names spread with the table, some on two declarations
    calls = B.table(spark, d, "orders").crossJoin(names).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"),
        F.col("o_orderkey") % F.col("m")).alias("name"), (F.col("o_custkey") % 3).alias("arity"))
    decl = part.crossJoin(names).select(F.concat(F.lit("f"), F.col("p_partkey") % F.col("m")).alias("name"), (F.col(
        "p_size") % 3).cast("long").alias("arity"), F.col("p_partkey").alias("declaration"))
    return relations.callable_targets(calls, decl).withColumn("target", F.coalesce("target", F.lit(-1)))


@query("j14_predecessors", B.with_views("SELECT module, scope AS previous, count(*) AS shared_files FROM b_files GROUP "
    "BY ALL", "files"))
def _(spark, d):
    f = B.files(spark, d)
    return relations.predecessors(f.select("file", "module"), f.select("file", F.col("scope").alias("module")))


@query("j15_mutual_unique", "SELECT sha256(text) AS hash, min(doc_id) AS left_id, min(doc_id) AS right_id FROM "
    "documents GROUP BY text HAVING count(*) = 1 AND min(doc_id) % 5 <> 0")
def _(spark, d):
    f = B.files(spark, d).select(F.col("doc_id").alias("id"), "hash")
    return relations.mutual_unique(f, f.where("id % 5 <> 0"), "hash")


@query("j17_overlaps", B.with_views("SELECT file, count(*) AS owners, array_to_string(list_sort(list(module)), ',') AS "
    "modules FROM (SELECT file, module FROM b_files UNION SELECT file, scope FROM b_files WHERE doc_id % 4 = 0) GROUP "
    "BY file HAVING count(*) > 1", "files"))
def _(spark, d):
    f = B.files(spark, d)
    return relations.overlapping(f.select("file", "module").union(f.where("doc_id % 4 = 0").select("file",
        "scope"))).withColumn("modules", F.array_join("modules", ","))


@query("j18_details", B.with_views("SELECT r.id, r.kind FROM b_relations r SEMI JOIN (SELECT file FROM b_module_files "
    "WHERE module = 'NATION_3') m ON r.source_file = m.file", "relations", "module_files"))
def _(spark, d):
    r, m = _facts(spark, d)
    return r.join(m.where("module = 'NATION_3'").select(F.col("file").alias("source_file")), "source_file",
        "left_semi").select("id", "kind")


@query("j19_overlay", B.with_views("SELECT id, CASE WHEN id LIKE 'customer/1%' THEN 'edited ' || id ELSE title END AS "
    "title FROM b_nodes WHERE id NOT LIKE 'customer/2%' UNION ALL SELECT 'mine', 'My node'", "nodes"))
def _(spark, d):
    n = B.nodes(spark, d).select("id", "title")
    edits = n.where("id like 'customer/1%'").select("id", F.concat(F.lit("edited "), "id").alias("title"))
    return relations.overlay(n, edits, n.where("id like 'customer/2%'"), spark.createDataFrame([("mine", "My node")],
        "id string, title string"))


@query("j22_dangling", B.with_views("SELECT id FROM b_edges WHERE source LIKE 'customer/1%' OR target LIKE "
    "'customer/1%'", "edges"))
def _(spark, d):
    return relations.dangling(B.edges(spark, d), B.nodes(spark, d).where("id not like 'customer/1%'")).select("id")


@query("j23_aliases", B.with_views("SELECT diagram, turn, CASE WHEN sender = 'user' THEN 'u' WHEN sender = 'assistant' "
    "THEN 'a' END AS sender_id, CASE WHEN receiver = 'user' THEN 'u' WHEN receiver = 'assistant' THEN 'a' END AS "
    "receiver_id FROM b_messages", "messages"))
def _(spark, d):
    people = spark.createDataFrame([("u", "User", 1), ("a", "assistant", 2)], "id string, title string, ord int")
    return relations.alias_ends(B.messages(spark, d), people).select("diagram", "turn", "sender_id", "receiver_id")


@query("j26_remapped", B.with_views("SELECT 'n' || id AS id, title FROM b_nodes WHERE id LIKE '%4' UNION ALL SELECT "
    "id, title FROM b_nodes WHERE id = 'supplier/3' AND id NOT LIKE '%4'", "nodes"))
def _(spark, d):
    n = B.nodes(spark, d).select("id", "title")
    ids = n.where("id like '%4' ").select(F.col("id").alias("old_id"), F.concat(F.lit("n"), "id").alias("new_id"))
    return relations.remapped(n, ids, n.where("id = 'supplier/3' and id not like '%4'"))


# ---- views


def _graph(spark, d):
    return B.nodes(spark, d), B.edges(spark, d)


@query("f3_induced", B.with_views("SELECT id FROM b_edges WHERE source IN (SELECT id FROM b_nodes WHERE layer <> "
    "'test') AND target IN (SELECT id FROM b_nodes WHERE layer <> 'test')", "nodes", "edges"))
def _(spark, d):
    n, e = _graph(spark, d)
    return views.induced(e, n.where("layer <> 'test'")).select("id")


@query("f4_groups", B.with_views(", c AS (SELECT id FROM b_nodes WHERE resource_kind IS NULL AND "
    "list_contains(group_path, 'ASIA')) SELECT id FROM c UNION SELECT id FROM b_nodes WHERE origin = 'manual' UNION "
    "SELECT n.id FROM b_nodes n JOIN b_edges e ON (n.id = e.source AND e.target IN (SELECT id FROM c)) OR (n.id = "
    "e.target AND e.source IN (SELECT id FROM c)) WHERE n.resource_kind IS NOT NULL", "nodes", "edges"))
def _(spark, d):
    return views.in_groups(*_graph(spark, d), ["ASIA"]).select("id")


@query("f5_view", B.with_views(", t AS (SELECT id FROM b_nodes WHERE node_type = 'test') SELECT id, relation FROM "
    "b_edges WHERE CASE WHEN coalesce(origin, '') = 'manual' THEN FALSE WHEN relation = 'tests' THEN TRUE WHEN source "
    "IN (SELECT id FROM t) OR target IN (SELECT id FROM t) THEN FALSE ELSE (relation = 'calls' AND confidence = "
    "'confirmed') OR relation = 'reads' END", "nodes", "edges"))
def _(spark, d):
    return views.shown_edges(*_graph(spark, d), extra=["reads", "tests"]).select("id", "relation")


@query("f6_event_boundaries", B.with_views("SELECT CASE WHEN event_id IS NOT NULL THEN 'event-boundary:' || event_id "
    "ELSE 'unresolved-event:' || id END AS id, count(*) AS n_edges, bool_and(event_id IS NULL) AS unresolved FROM "
    "b_edges WHERE relation IN ('publishes_event', 'subscribes_event') GROUP BY 1", "edges"))
def _(spark, d):
    return views.event_boundaries(B.edges(spark, d))[1]


@query("f7_connected", B.with_views(", l AS (SELECT unnest([source, target]) AS id FROM b_edges WHERE coalesce(origin, "
    "'') <> 'manual' AND relation NOT IN ('depends_on', 'tests') AND (relation <> 'calls' OR confidence = "
    "'confirmed')) SELECT id, id IN (SELECT id FROM l) AS connected FROM b_nodes WHERE resource_kind IS NULL AND "
    "node_type <> 'test'", "nodes", "edges"))
def _(spark, d):
    return views.connection_counts(*_graph(spark, d))


@query("f8_connection_kind", B.with_views(_PLACED.replace("b_module_files",
    "(SELECT file, file AS module FROM b_module_files)") + ", s AS (SELECT source_module AS module, count(*) FILTER "
    "(target_file IS NOT NULL AND source_module = target_module) AS internal, count(*) FILTER (target_kind = "
    "'unresolved') AS unresolved, count(*) FILTER (target_kind IN ('external', 'resource')) AS external FROM placed "
    "WHERE source_module IS NOT NULL GROUP BY 1), e AS (SELECT id, bool_and(relation = 'depends_on') AS deps FROM "
    "(SELECT source AS id, relation FROM b_edges UNION ALL SELECT target, relation FROM b_edges) GROUP BY id) SELECT "
    "n.id, CASE WHEN deps IS NULL THEN CASE WHEN internal > 0 THEN 'internal' WHEN unresolved > 0 THEN 'unresolved' "
    "WHEN external > 0 THEN 'external' ELSE 'none' END WHEN deps THEN 'dependency' END AS connection FROM b_nodes n "
    "LEFT JOIN e USING (id) LEFT JOIN s ON n.id = s.module", "nodes", "edges", "relations", "module_files"))
def _(spark, d):
    r, m = _facts(spark, d)
    return views.connection_kind(*_graph(spark, d), relations.module_summary(r, m.withColumn("module", F.col("file"))))


@query("f9_degrees", B.with_views("SELECT n.id, (SELECT count(*) FROM b_edges WHERE target = n.id) AS upstream, "
    "(SELECT count(*) FROM b_edges WHERE source = n.id) AS downstream, (SELECT bool_and(confidence = 'confirmed') FROM "
    "b_edges WHERE source = n.id OR target = n.id) AS confirmed FROM b_nodes n", "nodes", "edges"))
def _(spark, d):
    return views.degrees(*_graph(spark, d))


@query("f11_sequence_filter", B.with_views("SELECT diagram, unnest(['user', 'assistant']) AS participant FROM (SELECT "
    "DISTINCT diagram FROM b_messages WHERE sender IN ('user', 'assistant') AND kind = 'call' AND lower(concat_ws(' ', "
    "sender, receiver, text)) LIKE '%the%') WHERE TRUE UNION SELECT diagram, sender FROM b_messages WHERE FALSE",
    "messages"))
def _(spark, d):
    m = B.messages(spark, d).where("sender in ('user', 'assistant')")
    return sequences.filtered(m, "The", ["call"])[1]


@query("f13_clustering_relations", B.with_views("SELECT kind, count(*) AS n FROM b_relations WHERE confidence = "
    "'confirmed' AND kind IN ('call', 'database', 'event') AND target_file IS NOT NULL GROUP BY kind", "relations"))
def _(spark, d):
    return B.relations(spark, d).where(F.col("kind").isin(clustering.KINDS) & (F.col("confidence") == "confirmed")
        & F.col("target_file").isNotNull()).groupBy("kind").agg(F.count("*").alias("n"))


@query("f15_neighbourhood", B.with_views("SELECT id FROM b_nodes WHERE id = 'customer/7' OR id IN (SELECT target FROM "
    "b_edges WHERE source = 'customer/7') OR id IN (SELECT source FROM b_edges WHERE target = 'customer/7')", "nodes",
    "edges"))
def _(spark, d):
    return views.neighbourhood(*_graph(spark, d), "customer/7").select("id")


@query("f18_entries", B.with_views(", x AS (SELECT id, files, (SELECT count(*) FROM b_edges WHERE target = n.id) AS i, "
    "(SELECT count(*) FROM b_edges WHERE source = n.id) AS o FROM b_nodes n) SELECT id, i = 0 AND o > 0 AS entry, o = "
    "0 AND i > 0 AS sink, len(list_filter(files, lambda f: regexp_matches(lower(f), 'controller\\.[^.]+$'))) > 0 AS "
    "boundary FROM x", "nodes", "edges"))
def _(spark, d):
    return views.entries_and_sinks(*_graph(spark, d))


@query("g10_frontier")
def _(spark, d):
    return views.frontier(B.nodes(spark, d).select("id", "group_path"), 9)


# ---- change data


def _snapshots(spark, d):
    f, i = B.files(spark, d), F.col("doc_id")
    old = f.where(i % 10 != 0).withColumn("hash", F.when(i % 7 == 0, F.lit("old")).otherwise(F.col("hash")))
    return old, f.where(i % 11 != 3)


@query("c1_scan_delta", B.with_views("SELECT path, status FROM (SELECT path, CASE WHEN doc_id % 10 = 0 AND doc_id % 11 "
    "= 3 THEN NULL WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 11 = 3 THEN 'deleted' WHEN doc_id % 7 = 0 THEN "
    "'modified' ELSE 'unchanged' END AS status FROM b_files) WHERE status IS NOT NULL", "files").replace(
    "status FROM b_files", "status FROM (SELECT doc_id, path FROM b_files)"))
def _(spark, d):
    return changes.scan_delta(*_snapshots(spark, d))


@query("c2_changed_fields", B.with_views("SELECT path, status, CASE WHEN status = 'modified' THEN 'hash' ELSE '' END "
    "AS fields FROM (SELECT path, CASE WHEN doc_id % 10 = 0 AND doc_id % 11 = 3 THEN NULL WHEN doc_id % 10 = 0 THEN "
    "'added' WHEN doc_id % 11 = 3 THEN 'deleted' WHEN doc_id % 7 = 0 THEN 'modified' END AS status FROM (SELECT "
    "doc_id, path FROM b_files)) WHERE status IS NOT NULL", "files"))
def _(spark, d):
    return changes.changed_fields(*_snapshots(spark, d), "path", ["size", "hash"]).withColumn("fields", F.array_join(
        "fields", ","))


@query("c3_normalized", B.with_views("SELECT module, last(scope ORDER BY doc_id) AS title, "
    "array_to_string(list_sort(['a', 'b', last(scope ORDER BY doc_id)]), ',') AS tags FROM b_files GROUP BY module",
    "files"))
def _(spark, d):
    s = B.files(spark, d).select("module", "doc_id", F.concat(F.lit("  "), "scope", F.lit(" ")).alias("title"),
        F.array(F.lit("b"), F.lit("a"), "scope", F.lit("b")).alias("tags"))
    return changes.normalized(s, ["title"], ["tags"], "module", "doc_id").select("module", "title", F.array_join("tags",
        ",").alias("tags"))


@query("c4_acknowledged", B.with_views("SELECT path, hash FROM (SELECT path, CASE WHEN module = 'src1' THEN CASE WHEN "
    "doc_id % 11 <> 3 THEN hash END ELSE CASE WHEN doc_id % 10 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE hash "
    "END END END AS hash FROM (SELECT doc_id, path, module, hash FROM b_files)) WHERE hash IS NOT NULL", "files"))
def _(spark, d):
    old, new = _snapshots(spark, d)
    ids = B.files(spark, d).where("module = 'src1'").select("path")
    return changes.acknowledged(old.select("path", "hash"), new.select("path", "hash"), ids, "path")


@query("c5_user_state", B.with_views("SELECT id, state, title FROM (SELECT id, CASE WHEN id LIKE 'customer/2%' THEN "
    "'hidden' WHEN id LIKE 'customer/1%' THEN 'edited' END AS state, CASE WHEN id LIKE 'customer/1%' THEN 'new' END AS "
    "title FROM b_nodes) WHERE state IS NOT NULL UNION ALL SELECT 'mine', 'manual', 'Mine'", "nodes"))
def _(spark, d):
    g = B.nodes(spark, d).select("id", "title")
    e = g.where("id not like 'customer/2%'").withColumn("title", F.when(F.col("id").like("customer/1%"), F.lit("new"))
        .otherwise(F.col("title"))).unionByName(spark.createDataFrame([("mine", "Mine")], "id string, title string"))
    return changes.user_state(g, e, "id", ["title"])


@query("c6_reconciled", "SELECT s_suppkey AS id, outcome, CASE WHEN outcome IN ('added', 'updated') THEN n WHEN "
    "outcome = 'tombstone' THEN -1 ELSE u END AS value FROM (SELECT s_suppkey, u, n, CASE WHEN o IS NOT NULL AND u IS "
    "NULL THEN CASE WHEN n IS NOT NULL THEN 'tombstone' END WHEN o IS NULL AND u IS NOT NULL THEN CASE WHEN n IS NULL "
    "THEN 'manual' WHEN u = n THEN 'kept' ELSE 'conflict' END WHEN o IS NULL THEN CASE WHEN n IS NOT NULL THEN 'added' "
    "END WHEN n IS NULL THEN CASE WHEN u <> o THEN 'orphan' END WHEN u <> o AND n <> o AND u <> n THEN 'conflict' WHEN "
    "u <> o THEN 'user' WHEN n <> o THEN 'updated' ELSE 'kept' END AS outcome FROM (SELECT s_suppkey, CASE WHEN "
    "s_suppkey % 5 <> 0 THEN 1 END AS o, CASE WHEN s_suppkey % 7 <> 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 "
    "END END AS u, CASE WHEN s_suppkey % 11 <> 0 THEN CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END END AS "
    "n FROM supplier)) WHERE outcome IS NOT NULL")
def _(spark, d):
    k = F.col("id")
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    old = s.where(k % 5 != 0).withColumn("v", F.lit(1))
    user = s.where(k % 7 != 0).withColumn("v", F.when(k % 3 == 0, 2).otherwise(1))
    new = s.where(k % 11 != 0).withColumn("v", F.when(k % 4 == 0, 2).when(k % 4 == 1, 3).otherwise(1))
    return changes.reconciled(old, user, new, "id", "v").withColumn("value", F.coalesce("value", F.lit(-1)))


@query("c8_invalidated", "SELECT doc_id AS id, doc_id % 11 = 3 AS gone FROM documents WHERE doc_id % 11 = 3 OR doc_id "
    "% 5 = 0")
def _(spark, d):
    f = B.files(spark, d).select(F.col("doc_id").alias("id"), changes.row_fingerprint(["path", "size"]).alias(
        "fingerprint"))
    return changes.invalidated(f.withColumn("fingerprint", F.when(F.col("id") % 5 == 0, F.lit("old")).otherwise(F.col(
        "fingerprint"))), f.where("id % 11 <> 3"))


@query("c9_overrides", B.with_views("SELECT id, layer AS system_level, CASE WHEN id LIKE 'customer/1%' THEN 'high' "
    "ELSE layer END AS effective_level, CASE WHEN id LIKE 'customer/1%' THEN layer <> 'api' END AS changed FROM "
    "b_nodes", "nodes"))
def _(spark, d):
    n = B.nodes(spark, d).select("id", F.col("layer").alias("level"))
    o = n.where("id like 'customer/1%' or id like 'customer/2%'").select("id", F.lit("high").alias("level"),
        F.when(F.col("id").like("customer/1%"), F.lit("because")).otherwise(F.lit(" ")).alias("reason"), F.lit("api")
        .alias("level_then"))
    return changes.with_override(n, o)


@query("c10_corrected", B.with_views("SELECT id, source, CASE WHEN source LIKE 'customer/1%' AND source <> "
    "'supplier/7' THEN 'supplier/7' ELSE target END AS target, relation, CASE WHEN source LIKE 'customer/1%' AND "
    "target <> 'supplier/7' THEN 'inferred' ELSE confidence END AS confidence, source LIKE 'customer/1%' AND target <> "
    "'supplier/7' AS corrected FROM b_edges", "edges"))
def _(spark, d):
    e = B.edges(spark, d)
    patches = e.where("source like 'customer/1%'").select("id", F.lit(None).cast("string").alias("source"), F.lit(
        "supplier/7").alias("target"), F.lit(None).cast("string").alias("relation"))
    return changes.corrected(e, patches.unionByName(e.where("source = 'supplier/7'").select("id", F.lit(None).cast(
        "string").alias("source"), F.lit("supplier/7").alias("target"), F.lit(None).cast("string").alias("relation"))))


@query("c11_reuse", B.with_views("SELECT 'reused' AS what, count(*) AS n FROM b_files WHERE doc_id % 10 <> 0 AND "
    "doc_id % 7 <> 0 AND doc_id % 11 <> 3 UNION ALL SELECT 'extracted', count(*) FROM b_files WHERE (doc_id % 10 = 0 "
    "OR doc_id % 7 = 0) AND doc_id % 11 <> 3", "files"))
def _(spark, d):
    reuse, extract = changes.to_reuse(*_snapshots(spark, d))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(reuse, "reused").unionByName(count(extract, "extracted"))


@query("c12_review_state", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'reviewing' WHEN o_orderkey % 5 "
    "= 0 THEN 'local' WHEN o_orderkey % 3 = 0 THEN 'stale' WHEN o_orderkey % 2 = 0 THEN 'reviewed' ELSE 'local' END AS "
    "state FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    r = B.table(spark, d, "orders").select(k.alias("id"), (k % 7 == 0).alias("running"), F.when(k % 5 != 0, F.lit("a"))
        .alias("reviewed_input"), F.when(k % 3 == 0, F.lit("b")).otherwise(F.lit("a")).alias("current_input"),
        (k % 2 == 0).alias("adopted"))
    return changes.review_state(r).select("id", "state")


@query("c13_deadlines", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'pending' WHEN event_id % 90 <= 30 "
    "THEN 'completed' ELSE 'timeout' END AS outcome FROM events")
def _(spark, d):
    k = F.col("event_id")
    r = B.table(spark, d, "events").select(k.alias("id"), F.col("ts").alias("started"), F.when(k % 5 != 0, F.col("ts")
        + F.make_dt_interval(secs=(k % 90).cast("decimal(18,6)"))).alias("completed"), F.lit(30).cast("decimal(18,6)")
        .alias("timeout"))
    return changes.in_time(r).select("id", "outcome")


@query("c14_pending", "SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'discarded' WHEN c_custkey % 6 = 1 "
    "THEN 'kept' WHEN c_custkey % 6 = 2 THEN 'bound' ELSE 'pending' END AS state, CASE WHEN c_custkey % 6 = 2 THEN 't' "
    "|| c_custkey END AS bound_to FROM customer")
def _(spark, d):
    k = F.col("id")
    items = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    act = F.when(k % 6 == 0, F.lit("discard")).when(k % 6 == 1, F.lit("keep")).otherwise(F.lit("rebind"))
    to = F.when(k % 6 == 2, F.concat(F.lit("t"), k)).when(k % 6 == 3, F.lit("same"))
    once = items.where("id % 6 < 4").select("id", act.alias("action"), to.alias("to"))
    twice = items.where("id % 6 = 4").select("id", F.lit("keep").alias("action"), F.lit(None).cast("string").alias(
        "to"))
    return changes.resolve_pending(items, once.unionByName(twice).unionByName(twice))


@query("c15_adoption", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'not-applicable' WHEN o_orderkey % "
    "5 = 0 THEN 'stale' WHEN o_orderkey % 3 = 0 THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'applied' "
    "END AS adoption FROM orders")
def _(spark, d):
    k = F.col("o_orderkey")
    r = B.table(spark, d, "orders").select(k.alias("id"), (k % 7 != 0).alias("ok"), F.lit("a").alias("base"),
        F.when(k % 5 == 0, F.lit("b")).otherwise(F.lit("a")).alias("now"), (k % 3 != 0).alias("valid"),
        F.when(k % 2 == 0, F.lit("manual")).otherwise(F.lit("auto")).alias("mode"))
    return changes.adoption(r).select("id", "adoption")


@query("u2_rebased", B.with_views("SELECT module, array_to_string(list_sort(['b', 'd', 'u', scope]), ',') AS files "
    "FROM (SELECT module, min(scope) AS scope FROM b_files GROUP BY module)", "files"))
def _(spark, d):
    m = B.files(spark, d).groupBy("module").agg(F.min("scope").alias("s"))
    a = lambda *x: F.array(*[F.lit(v) if v != "s" else F.col("s") for v in x])
    return m.select("module", F.array_join(dedupe.rebased(a("a", "b", "s"), a("b", "s", "u"), a("a", "b", "d", "s")),
        ",").alias("files"))


@query("u6_rollback", "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'restore' ELSE 'delete' END AS "
    "action FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 2 = 0)")
def _(spark, d):
    p = B.table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), "doc_id").alias("path"))
    return changes.rollback(p.where("doc_id % 6 = 0"), p.where("doc_id % 3 = 0"), p.where("doc_id % 3 = 1"), p.where(
        "doc_id % 2 = 1"))


# ---- windows, top-k, greedy


@query("w1_numbered", B.with_views("SELECT diagram, turn, sequence FROM (SELECT diagram, turn, row_number() OVER "
    "(PARTITION BY diagram ORDER BY turn) AS sequence FROM b_messages) WHERE sequence <= 6", "messages"))
def _(spark, d):
    return sequences.numbered(B.messages(spark, d), "diagram", ["turn"], 6).select("diagram", "turn", "sequence")


@query("w2_ports",
    B.with_views(
    """, p AS (SELECT source AS node, CASE length(target) % 2 WHEN 0 THEN 'left' ELSE 'right' END AS side, id AS edge FROM b_edges), c AS (SELECT *, count(*) OVER (PARTITION BY node, side) AS n, CASE side WHEN 'left' THEN row_number() OVER (PARTITION BY node, side ORDER BY edge DESC) ELSE row_number() OVER (PARTITION BY node, side ORDER BY edge) END AS place FROM p)
    SELECT node, side, edge, n, place, CASE WHEN n > 6 THEN 50.0 ELSE place * (100.0::DOUBLE / (n + 1)) END AS "offset" FROM c""", "edges"))  # fmt: skip
def _(spark, d):
    p = B.edges(spark, d).select(F.col("source").alias("node"), F.when(F.length("target") % 2 == 0, F.lit("left"))
        .otherwise(F.lit("right")).alias("side"), F.col("id").alias("edge"))
    return graph.ranked_ports(p)


@query("w4_grid", B.with_views("SELECT id, (rank() OVER (ORDER BY id) - 1) % 4 AS x, (rank() OVER (ORDER BY id) - 1) "
    "// 4 AS y FROM b_nodes", "nodes"))
def _(spark, d):
    n = dedupe.with_number(B.nodes(spark, d).select("id"), ["id"], "i", 8)
    return n.select("id", F.pmod("i", F.lit(4)).alias("x"), F.floor(F.col("i") / 4).alias("y"))


@query("t1_tree_order", B.with_views("SELECT folder, files, bytes FROM (SELECT folder, count(*) AS files, sum(size) AS "
    "bytes FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, size FROM b_files) GROUP BY folder) ORDER BY "
    "files DESC, bytes DESC, folder LIMIT 25", "files"))
def _(spark, d):
    f = B.files(spark, d).groupBy(X.parent(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum(
        "size").alias("bytes"))
    return f.orderBy(F.desc("files"), F.desc("bytes"), "folder").limit(25)


@query("t2_ranked", B.with_views("SELECT module, id, place FROM (SELECT module, path AS id, row_number() OVER "
    "(PARTITION BY module ORDER BY size DESC, path) AS place FROM b_files) WHERE place <= 14", "files"))
def _(spark, d):
    f = B.files(spark, d).select("module", F.col("path").alias("id"), "size")
    return sequences.ranked(f, "module", F.desc("size")).select("module", "id", "place")


@query("t3_contributions", B.with_views("SELECT module AS owner, arg_max(scope, (s, scope)) AS largest, sum(s) AS "
    "total FROM (SELECT module, scope, sum(size) AS s FROM b_files GROUP BY ALL) GROUP BY module", "files"))
def _(spark, d):
    return sequences.contributions(B.files(spark, d).groupBy(F.col("module").alias("owner"), F.col("scope").alias(
        "part")).agg(F.sum("size").alias("size")))


@query("t4_budget_fill")
def _(spark, d):
    f = B.files(spark, d)
    return sequences.fill(f.select(F.col("module").alias("owner"), F.col("path").alias("id"), F.col("scope").alias(
        "kind"), F.col("size").alias("size"), (F.col("doc_id") % 3).alias("rank"), (F.col("doc_id") % 40 == 0).alias(
        "mandatory")), 12_000, quota=5)


@query("m2_bounded_log", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY "
    "conv_id ORDER BY turn) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) "
    "WHERE b <= 900 AND p <= 5")
def _(spark, d):
    return sequences.bounded_log(B.table(spark, d, "conversations"), "conv_id", "turn", 900, 5).select("conv_id",
        "turn")


@query("m3_newest_request", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS newest, count(*) - 1 AS superseded "
    "FROM events GROUP BY user_id")
def _(spark, d):
    return streams.newest_request(B.table(spark, d, "events"), "user_id", "ts", "event_id")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) "
    "AS total FROM events GROUP BY ALL")
def _(spark, d):
    return streams.tumbling(B.table(spark, d, "events"))


# ---- graph loops and clustering


@query("g1_reachable", B.with_views(
    f", r AS (SELECT 'customer/7' AS id, 0 AS steps UNION SELECT target, steps + 1 FROM r JOIN b_edges ON source = r.id WHERE steps < 30) SELECT id, min(steps) AS steps FROM r GROUP BY id", "edges", recursive=True))
def _(spark, d):
    return graph.reachable(B.edges(spark, d), spark.createDataFrame([("customer/7",)], "id string"))


# Recursive SQL for these is too slow (the closure holds every pair); tests hold them against plain code.


@query("g2_components")
def _(spark, d):
    return graph.components(*_graph(spark, d))


@query("g3_strong_components")
def _(spark, d):
    return graph.strong_components(*_graph(spark, d))


def _condensed(spark, d):
    n, e = _graph(spark, d)
    e = graph.settled(e.select("source", "target").distinct())
    parts = graph.settled(graph.strong_components(n, e))
    return parts, graph.condensed(e, parts)


@query("g4_condensed")
def _(spark, d):
    return _condensed(spark, d)[1]


@query("g6_layers")
def _(spark, d):
    parts, e = _condensed(spark, d)
    return graph.layers(parts.select(F.col("component").alias("id")).distinct(), e)


@query("g9_areas")
def _(spark, d):
    n, e = _graph(spark, d)
    m = n.select(F.col("id").alias("module"), F.lit("s").alias("scope"), "category", F.when(F.length("id") % 4 != 0,
        F.col("domain")).alias("label"), (F.length("id") % 5 == 0).alias("strong"))
    return clustering.areas(m, e.where("confidence = 'confirmed'").select("source", "target"), graph.components)


@query("g13_fingerprint")
def _(spark, d):
    return graph.fingerprint(*_graph(spark, d))


def _code(spark, d):
    """The documents' files, and confirmed calls between neighbouring ones of a scope."""
    f = B.files(spark, d)
    by = f.select("doc_id", "file", "scope")
    k = F.col("doc_id")
    pairs = by.select("scope", F.col("file").alias("source_file"), F.explode(F.array(k + 8, k + 13, k * 2 + 1)).alias(
        "doc_id")).join(by.withColumnRenamed("file", "target_file"), ["doc_id", "scope"])
    r = pairs.select(F.when(k % 3 == 0, F.lit("event")).otherwise(F.lit("call")).alias("kind"), "source_file",
        "target_file", F.when(k % 10 == 0, F.lit("inferred")).otherwise(F.lit("confirmed")).alias("confidence"))
    return f.select("file", "scope"), r


@query("g7_clusters")
def _(spark, d):
    return clustering.clusters(*_code(spark, d))


@query("a11_categories")
def _(spark, d):
    return clustering.categories(clustering.clusters(*_code(spark, d)))

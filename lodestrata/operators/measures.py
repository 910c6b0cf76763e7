"""Measurement: percentiles, budgets, confusion matrices, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X


def nearest_rank(value: str, q: float) -> Column:
    """The value at rank ceil(q * n)."""
    return F.expr(f"percentile_disc({q}) within group (order by {value})")


def mean_if_complete(value: str) -> Column:
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def percentiles(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    return samples.groupBy(*by).agg(F.count(value).alias("n"), nearest_rank(value, 0.5).alias("p50"),
        nearest_rank(value, 0.95).alias("p95"), F.median(value).alias("median"), F.max(value).alias("max"))


def budgets(samples: DataFrame, limits: DataFrame, value: str = "value") -> DataFrame:
    """samples(scenario, band, project, metric, value) against limits(metric, band, limit, least): the p95 of each project with enough samples, the worst project counts."""
    per = samples.groupBy("scenario", "band", "metric", "project").agg(F.count(value).alias("n"), nearest_rank(value,
        0.95).alias("p95"))
    judged = per.join(F.broadcast(limits), ["metric", "band"])  # a table of limits: some rows
    return judged.groupBy("scenario", "band", "metric").agg(F.max("p95").alias("worst"), F.min(F.col("n") >= F.col(
        "least")).alias("complete"), F.first("limit").alias("limit")).withColumn("passed", F.col("complete") & (F.col(
        "worst") <= F.col("limit")))


def ratio_budgets(now: DataFrame, before: DataFrame, most: float = 1.05) -> DataFrame:
    """Metrics against a baseline (metric, p95): not comparable without one or with a baseline of 0."""
    j = now.join(before.select("metric", F.col("p95").alias("base")), "metric", "left")
    ratio = F.when(F.col("base") > 0, F.col("p95") / F.col("base"))
    return j.select("metric", ratio.alias("ratio"), F.when(ratio.isNull(), F.lit("not-comparable")).when(ratio <= most,
        F.lit("passed")).otherwise(F.lit("failed")).alias("verdict"))


def confusion(labels: DataFrame, predictions: DataFrame, by: str) -> DataFrame:
    """labels(id, by, present) and predictions(id): counts, precision, recall and F1 per category; null where nothing is divided."""
    j = labels.join(predictions.select("id", F.lit(True).alias("hit")).distinct(), "id", "left").withColumn("hit",
        F.coalesce("hit", F.lit(False)))
    counted = j.groupBy(by).agg(F.count_if(F.col("present") & F.col("hit")).alias("tp"), F.count_if(~F.col("present")
        & F.col("hit")).alias("fp"), F.count_if(F.col("present") & ~F.col("hit")).alias("fn"), F.count_if(~F.col(
        "present") & ~F.col("hit")).alias("tn"))
    return counted.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), "f1": F.try_divide(F.col(
        "tp") * 2.0, 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def long_tasks(durations: DataFrame, by: list[str], value: str, least: float = 50.0) -> DataFrame:
    long = F.when(F.col(value) >= least, F.col(value))
    return durations.groupBy(*by).agg(F.count(long).alias("n"), F.coalesce(F.sum(long), F.lit(0.0)).alias("total"),
        F.coalesce(F.max(long), F.lit(0.0)).alias("longest"))


def window_peaks(samples: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Peak, first value and their difference per action window."""
    return samples.groupBy(*by).agg(F.max(value).alias("peak"), F.min_by(value, at).alias("entry")).withColumn("rise",
        F.col("peak") - F.col("entry"))


def timings(events: DataFrame, stages: list[str]) -> DataFrame:
    """events(id, stage, at): milliseconds between consecutive stages; valid if all are there in order."""
    wide = events.groupBy("id").pivot("stage", stages).agg(F.min("at"))
    ordered = F.lit(True)
    for a, b in zip(stages, stages[1:], strict=False):
        ordered = ordered & F.coalesce(F.col(a) <= F.col(b), F.lit(False))
    ms = lambda a, b: ((F.unix_micros(b) - F.unix_micros(a)) / 1000).alias(f"{a}_{b}")
    return wide.select("id", *[ms(a, b) for a, b in zip(stages, stages[1:], strict=False)], ordered.alias("valid"))


def paired(runs: DataFrame) -> DataFrame:
    """runs(pair, mode, value) with modes on and off: the difference of each pair."""
    return runs.groupBy("pair").pivot("mode", ["off", "on"]).agg(F.first("value")).withColumn("delta", F.col(
        "on") - F.col("off"))


def quality(files: DataFrame, relations: DataFrame) -> DataFrame:
    """How much of a project was understood, in one row."""
    f = files.agg(F.count("*").alias("eligible"), F.count_if(F.col("status") == "parsed").alias("parsed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "unsupported").alias(
        "unsupported"))
    r = relations.agg(F.count_if(F.col("kind") == "import").alias("imports"), F.count_if(F.col("kind") == "call").alias(
        "calls"), F.count_if(F.col("target_kind") == "unresolved").alias("unresolved"), F.count_if((F.col(
        "target_kind") == "unresolved") & (F.col("n_candidates") > 1)).alias("ambiguous"))
    both = f.join(F.broadcast(r), F.lit(True))  # one row each
    return both.withColumn("completeness", F.when(F.col("eligible") > 0, F.col("parsed") / F.col("eligible"))
        .otherwise(F.lit(1.0)))


def capabilities(files: DataFrame) -> DataFrame:
    """Per scope and language: files, how many were read, and a status."""
    got = files.groupBy("scope", "language").agg(F.countDistinct("path").alias("files"), F.countDistinct(F.when(F.col(
        "status") == "parsed", F.col("path"))).alias("parsed"), F.countDistinct(F.when(F.col("status") == "failed",
        F.col("path"))).alias("limited"))
    return got.withColumn("state", F.when(F.col("parsed") == 0, F.lit("unavailable")).when(F.col("parsed") < F.col(
        "files"), F.lit("partial")).otherwise(F.lit("available")))


def coverage(files: DataFrame, module_files: DataFrame, edges: DataFrame, evidence: str = "n_relations") -> DataFrame:
    """Shares of files in a module and of edges with evidence, and whether they suffice (0.70 and 0.30)."""
    a = files.select(F.col("path").alias("file")).distinct().join(module_files.select("file", F.lit(1).alias("own"))
        .distinct(), "file", "left").agg(F.count("*").alias("files"), F.count("own").alias("owned"))
    b = edges.agg(F.count("*").alias("edges"), F.count_if(F.col(evidence) > 0).alias("proven"))
    share = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(F.lit(0.0))
    return a.join(F.broadcast(b), F.lit(True)).withColumns({"file_coverage": share("owned", "files"),
        "evidence_coverage": share("proven", "edges")}).withColumn("valid", (F.col("file_coverage") >= 0.7) & (F.col(
        "evidence_coverage") >= 0.3))


def confidence_scores(modules: DataFrame) -> DataFrame:
    """modules(id, parsing, symbols, relations, evidence, current) with ratios from 0 to 1: factors of 25, 25, 25, 15 and 10 points, rounded, and their sum and level."""
    parts = {"parsing": 25, "symbols": 25, "relations": 25, "evidence": 15}
    scored = modules.withColumns({f"{k}_score": X.half_up(F.coalesce(F.col(k), F.lit(0.0)) * w) for k,
        w in parts.items()} | {"freshness_score": F.when(F.col("current"), F.lit(10.0)).otherwise(F.lit(0.0))})
    total = X.half_up(sum((F.col(f"{k}_score") for k in [*parts, "freshness"]), F.lit(0.0)))
    return scored.withColumn("score", total).withColumn("level", X.level(F.col("score"), 80, 50))


def parsing_quality(status: Column, depth: Column) -> Column:
    return F.when(status == "unsupported", F.lit(0.25)).when(status != "parsed", F.lit(0.0)).when(depth == "semantic",
        F.lit(1.0)).when(depth == "syntax", F.lit(0.8)).otherwise(F.lit(0.55))


def evidence_completeness(file: Column, symbol: Column, line: Column) -> Column:
    return F.when(file.isNotNull(), 0.4).otherwise(0.0) + F.when(symbol.isNotNull(),
        0.3).otherwise(0.0) + F.when(line.isNotNull(), 0.3).otherwise(0.0)


# What counts as sensitive in code, in descriptions and in paths.
SENSITIVE = [r"\bauth(?:entication|orization)?\b", r"\bpermission\b|\baccess control\b|\brbac\b",
    r"\bpayment\b|\bbilling\b|\bcheckout\b", r"\bcredential\b|\bsecret\b|\btoken\b|\bprivate key\b",
    r"\bpersonal data\b|\bprivacy\b|\buser data\b|\bpii\b"]
DESCRIBED = r"\bauth\b|\bsecurity\b|\bpayment\b|\bbilling\b|\bpermission\b|\bprivacy\b"
IN_PATH = [r"\bauth\b", r"\bsecurity\b", r"\bpayment\b", r"\bpermission\b"]


def sensitive_points(behaviour: Column, description: Column, paths: Column) -> Column:
    count = lambda text, patterns: sum((F.regexp_count(F.lower(text), F.lit(p)) for p in patterns),
        F.lit(0))
    return F.least(F.lit(30), count(behaviour, SENSITIVE) * 8 + F.least(F.lit(8), count(description, [DESCRIBED]) * 4)
        + F.least(F.lit(6), count(paths, IN_PATH) * 3))


def risk_scores(modules: DataFrame) -> DataFrame:
    """modules(id, sensitive, edges, modules, effects, external_calls, relations, files, tested): points for sensitivity (30), centrality (25), side effects (20), impact (15) and missing tests (10)."""
    central = F.when(F.col("modules") > 1, F.least(F.lit(1.0), F.col("edges") / F.least(F.lit(6), F.col(
        "modules") - 1))).otherwise(0.0) * 25
    parts = {
        "sensitive_score": X.half_up(F.col("sensitive").cast("double")),
        "central_score": X.half_up(central),
        "effect_score": X.half_up(F.least(F.lit(20), F.col("effects") * 4 + F.col("external_calls") * 2).cast(
            "double")),
        "impact_score": X.half_up(F.least(F.lit(15), F.col("edges") * 3 + F.col("relations") * 2 + F.least(F.lit(5),
            F.greatest(F.lit(0), F.col("files") - 1))).cast("double")),
        "test_score": F.when(F.col("tested"), F.lit(0.0)).otherwise(F.lit(10.0)),
    }
    total = X.half_up(sum((F.col(p) for p in parts), F.lit(0.0)))
    return modules.withColumns(parts).withColumn("score", total).withColumn("level", X.level(F.col("score"), 70, 30))


def execution_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The riskiest and the least certain module, how many are central (4 edges or more), and edges across technologies."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias(
        "degree"))
    j = nodes.join(ends, "id", "left")
    a = j.agg(F.max_by("id", F.struct("risk", "id")).alias("riskiest"), F.min_by("id", F.struct("certainty", "id"))
        .alias("least_certain"), F.count_if(F.col("degree") >= 4).alias("central"))
    s = nodes.select(F.col("id").alias("source"), F.col("stack").alias("s1")), nodes.select(F.col("id").alias("target"),
        F.col("stack").alias("s2"))
    b = edges.join(s[0], "source").join(s[1], "target").agg(F.count_if(F.col("s1") != F.col("s2")).alias("cross_stack"))
    return a.join(F.broadcast(b), F.lit(True))  # one row each

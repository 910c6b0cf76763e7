"""Schemas of the entity tables (DDL), and invariants as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "path string, parent string, name string, depth int, language string, size long, modified_at timestamp, hash string"
RELATIONS = "id string, kind string, source_file string, target_file string, target_kind string, resource_id string, n_candidates int, operation string, confidence string, detail string, symbol string"
MODULE_FILES = "file string, module string"
ENDPOINTS = "id string, kind string, file string, method string, path string, service string, origin string, confidence string"
SAMPLES = "scenario string, band string, project string, metric string, value double"


def broken_relations(relations: DataFrame) -> DataFrame:
    """Relations that break an invariant: a call without a target, an unresolved one that claims to be confirmed, a file target without a file."""
    problem = F.when((F.col("kind") == "call") & F.col("target_kind").isNull(), F.lit(
        "call-without-target")).when((F.col("target_kind") == "unresolved") & (F.col("confidence") != "inferred"),
        F.lit("unresolved-but-confirmed")).when((F.col("target_kind") == "file") & F.col("target_file").isNull(), F.lit(
        "file-target-without-file"))
    return relations.select("id", problem.alias("problem")).where("problem is not null")

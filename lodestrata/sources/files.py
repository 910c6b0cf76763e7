"""Sources: inventories of files, documents of facts, logs of runs and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X

# Folders and files that a scan leaves out.
IGNORED_FOLDERS = [".git", ".svn", ".hg", ".idea", ".vscode", ".vs", ".codex", ".cursor", ".claude", ".gemini",
    ".copilot", ".continue", "node_modules", "vendor", "dist", "out", "build", "release", "coverage", ".next", ".turbo",
    ".vercel", ".runtime", ".cache", ".parcel-cache", ".pytest_cache", ".ruff_cache", ".mypy_cache", "__pycache__",
    ".venv", "venv", "env", "target", "Pods", "DerivedData", ".pnpm-store", ".npm", ".gradle", ".m2", ".cargo", "logs",
    "tmp", "temp", "test-results", "generated", "__generated__"]
IGNORED_FILES = r"\.log$|(^|/)\.DS_Store$|(^|/)\.env(\.[^/]*)?$|\.(key|pem|p12|pfx|crt|cer)$|(^|/)[^/]*credentials[^/]*\.(json|yml|yaml)$|(^|/)[^/]*secret[^/]*\.(json|yml|yaml)$|(^|/)[^/]*\.app/|(^|/)\.yarn/cache/"


def ignored():
    folders = "|".join(f.replace(".", r"\.") for f in IGNORED_FOLDERS)
    return F.col("path").rlike(rf"(^|/)({folders})/") | F.col("path").rlike(IGNORED_FILES)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder: path below it, size, time of change, language.  Contents are not read: the column is pruned from the scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length",
        "modificationTime")
    below = F.regexp_replace(F.substring_index("path", root.rstrip("/"), -1), "^/", "")
    files = found.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias(
        "modified_at")).where(~ignored())
    return files.withColumn("language", X.language(F.col("path")))


def contents(spark: SparkSession, root: str, most_bytes: int = 220_000) -> DataFrame:
    """Path and text of files up to a size; larger ones are left out before they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col(
        "length") <= most_bytes)
    below = F.regexp_replace(F.substring_index("path", root.rstrip("/"), -1), "^/", "")
    return found.select(below.alias("path"), F.decode("content", "UTF-8").alias("content")).where(~ignored())


def selected(files: DataFrame, selection: DataFrame) -> DataFrame:
    """A chosen set of files (path, hash): those that exist with this hash; `problem` names what is wrong with the others."""
    twice = selection.groupBy("path").agg(F.count("*").alias("n"), F.min("hash").alias("wanted"))
    unsafe = F.col("path").rlike(r"(^|/)\.\.(/|$)|^/|\\")
    j = twice.join(files.select("path", "hash"), "path", "left")
    problem = F.when(unsafe, F.lit("unsafe")).when(F.col("n") > 1, F.lit("duplicate")).when(F.col("hash").isNull(),
        F.lit("missing")).when(F.col("hash") != F.col("wanted"), F.lit("changed"))
    return j.select("path", problem.alias("problem"))


def documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents, which must fit the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def runs(results: DataFrame) -> DataFrame:
    """Runs (run_id, status, finished) with safe ids, newest first; a time that is none sorts as 0."""
    return results.where(X.safe_id(F.col("run_id"))).withColumn("at", X.sortable_time(F.col(
        "finished"))).orderBy(F.desc("at"), "run_id")


def porcelain(lines: DataFrame) -> DataFrame:
    """Change status lines (line: two letters, a blank, a path, for renames `old -> new`) as rows."""
    path = F.regexp_replace(F.substr("line", F.lit(4)), r"^.* -> ", "")
    return lines.where(F.length("line") > 3).select(F.regexp_replace(path, '^"|"$', "").alias("path"),
        X.change_status(F.substring("line", 1, 2)).alias("status"))


def numstat(lines: DataFrame) -> DataFrame:
    """Lines of added, deleted and path between tabs; binary files (-) count as 0."""
    p = F.split("line", "\t")
    return lines.where(F.size(p) == 3).select(F.element_at(p, 3).alias("path"), F.coalesce(F.try_to_number(F.element_at(
        p, 1), F.lit("999999999")).cast("long"), F.lit(0)).alias("additions"), F.coalesce(F.try_to_number(F.element_at(
        p, 2), F.lit("999999999")).cast("long"), F.lit(0)).alias("deletions"))


def inventory_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Where a frozen inventory (path, size, hash) and what is found differ."""
    e, f = expected.select("path", F.col("size").alias("s1"), F.col("hash").alias("h1")), found.select("path", F.col(
        "size").alias("s2"), F.col("hash").alias("h2"))
    problem = F.when(F.col("h1").isNull(), F.lit("unexpected")).when(F.col("h2").isNull(), F.lit("missing")).when(F.col(
        "s1") != F.col("s2"), F.lit("size")).when(F.col("h1") != F.col("h2"), F.lit("hash"))
    return e.join(f, "path", "full").select("path", problem.alias("problem")).where("problem is not null")


def classified(files: DataFrame) -> DataFrame:
    """files(path, regular): source, configuration, license, other, or why a file is excluded."""
    name = F.lower(X.file_name(F.col("path")))
    kind = (
        F.when(~F.col("regular"), F.lit("excluded:not-regular"))
        .when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), F.lit("excluded:unsafe"))
        .when(name.rlike(r"^(license|licence|copying|notice)(\.|$)"), F.lit("license"))
        .when(name.isin("package.json", "tsconfig.json", "pyproject.toml", "pom.xml", "go.mod", "go.work",
            "pnpm-workspace.yaml", "build.gradle", "settings.gradle") | name.rlike(r"^tsconfig\..*\.json$"), F.lit(
            "configuration"))
        .when(X.language(F.col("path"), X.CODE_LANGUAGES).isNotNull(), F.lit("source"))
        .otherwise(F.lit("other"))
    )
    return files.select("path", kind.alias("kind"))

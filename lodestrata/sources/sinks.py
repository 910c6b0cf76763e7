"""Sinks: generations of tables that become visible at once, and exports."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Somebody else's generation came first, or what a generation rests on has changed."""


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_new(spark: SparkSession, name: str, text: str) -> bool:
    """Writes a small file whole, if there is none of its name: False if there is.  Of several writers at once one succeeds.

    The text goes to a file of its own, which takes the name in one step that fails where the name is taken: a hard link on a local disk, a rename without
    overwriting elsewhere."""
    path, fs = _path(spark, name)
    own, _ = _path(spark, f"{name}.{uuid.uuid4().hex}.new")
    fs.mkdirs(path.getParent())
    if fs.getUri().getScheme() == "file":
        here, there = own.toUri().getPath(), path.toUri().getPath()
        with open(here, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(here, there)
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
        return True
    out = fs.create(own, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(own, path, options)
    except Py4JJavaError as e:
        fs.delete(own, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def newest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the newest generation: number, generation, tables, revision, at; None before the first.  Manifests are numbered files."""
    folder, fs = _path(spark, f"{root}/manifest")
    if not fs.exists(folder):
        return None
    numbers = [name for f in fs.listStatus(folder) if re.fullmatch(r"\d{12}", name := f.getPath().getName())]
    if not numbers:
        return None
    stream = fs.open(_path(spark, f"{root}/manifest/{max(numbers)}")[0])
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: str | None = None, revision: int = 0, checks: Sequence[DataFrame] = ()) -> str:
    """Writes tables as a new generation and names it in a manifest last, so that readers see all of it or nothing.

    expected: the generation that the caller's data came from; another one by now, or by the time the manifest is put, refuses the write: the manifest's number is
    the expected one's and one, and only one writer gets it.  checks: tables of problems that must have no rows when all is written (what a snapshot says of inputs
    that have changed, say)."""
    before = newest(spark, root)
    if expected is not None and (before or {}).get("generation") != expected:
        raise Conflict(f"generation {expected} is no longer current")
    generation = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/gen={generation}/{name}")
    for problems in checks:
        if (first := problems.first()) is not None:
            raise Conflict(f"not published: {first.asDict()}")
    number = before["number"] + 1 if before else 1
    entry = {"generation": generation, "tables": sorted(tables), "revision": revision, "at": time.time_ns()}
    while not put_new(spark, f"{root}/manifest/{number:012d}", json.dumps({"number": number, **entry})):
        if expected is not None:
            raise Conflict(f"generation {expected} is no longer current")
        number += 1
    return generation


def current(spark: SparkSession, root: str) -> str | None:
    """The newest generation; None before the first."""
    return (newest(spark, root) or {}).get("generation")


def save_graph(spark: SparkSession, root: str, nodes: DataFrame, edges: DataFrame, files: DataFrame, known: DataFrame, expected: str, revision: int) -> str:
    """Publishes a graph that a user has changed: nodes(id, ...), edges(id, source, target, ...), files(file, module) of known(file).

    Refused with a Conflict: another generation or revision than the caller's, repeated ids, edges into nowhere, files of no scan or owned twice."""
    now = newest(spark, root)
    if now is None or now["generation"] != expected:
        raise Conflict(f"generation {expected} is no longer current")
    if now["revision"] != revision:
        raise Conflict(f"revision {revision} is no longer current")
    strange = files.join(known.select("file"), "file", "left_anti").select(F.lit("unknown-file").alias("problem"), F.col("file").cast("string").alias("subject"))
    problem = canvas_problems(nodes, edges, files).unionByName(strange).first()
    if problem is not None:
        raise Conflict(f"{problem['problem']}: {problem['subject']}")
    return publish(spark, root, {"nodes": nodes, "edges": edges, "files": files}, expected, revision + 1)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/gen={current(spark, root)}/{name}")


def latest(history: DataFrame, by: list[str], at: str, unique: str, most: int = 100) -> DataFrame:
    """The newest entries of a history."""
    w = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(unique)) if by else Window.orderBy(F.desc(at),
        F.desc(unique))
    if not by:
        return history.orderBy(F.desc(at), F.desc(unique)).limit(most)
    return history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def canvas_problems(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """What forbids saving a graph: repeated ids, edges into nowhere, files owned twice.  (problem, subject)."""
    twice = lambda df, c, p: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(p).alias("problem"),
        F.col(c).cast("string").alias("subject"))
    ids = nodes.select(F.col("id").alias("end"))
    ends = edges.select("id", F.explode(F.array("source", "target")).alias("end")).join(ids, "end",
        "left_anti").select(F.lit("unknown-end").alias("problem"), F.col("id").cast("string").alias(
        "subject")).distinct()
    return twice(nodes, "id", "repeated-node").unionByName(twice(edges, "id", "repeated-edge")).unionByName(twice(
        files.select("file", "module").distinct(), "file", "file-owned-twice")).unionByName(ends)


def as_markdown(rows: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """A section per row."""
    lines = [F.concat(F.lit(f"- {f}: "), F.coalesce(F.col(f).cast("string"), F.lit("none"))) for f in fields]
    return rows.select(F.col(title).alias("title"), F.concat_ws("\n", F.concat(F.lit("## "), F.col(title).cast(
        "string")), *lines).alias("markdown"))


def as_json(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return rows.select(key, F.to_json(F.struct(*fields)).alias("document"))

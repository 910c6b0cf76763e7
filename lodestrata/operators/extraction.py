"""From text to rows: facts of source files, endpoints, JSON in free text."""

from __future__ import annotations

import ast
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X

MOST_BYTES = 220_000
# HTTP in source text: kind, what stands before the verb, the verbs (None: it is a GET without one), what stands behind, the quotes of the path.
VERBS = "get|post|put|patch|delete|options|head"
SPOKEN = [
    ("request", r"\bfetch", None, "", "`\"'"),
    ("request", r"(?i)\b(?:axios|http|client)\.", VERBS, "", "`\"'"),
    ("route", r"(?i)\b(?:app|router)\.", VERBS, "", "\"'"),
    ("route", r"(?i)@\w+\.", VERBS, "", "\"'"),
    ("route", "(?i)@", "Get|Post|Put|Patch|Delete|Request", "Mapping", "\"'"),
    ("route", r"\.", "GET|POST|PUT|PATCH|DELETE", "", "\""),
]
# What an external call does: by what its name begins with, holds or is (the second column says whether case counts), first match first;
# a call whose first literal is an address is an http call too.
ADDRESS = r"^https?://"
EXTERNAL = [
    ("http", True, r"^(fetch|axios(\.|$)|request|got\.|http\.|https\.)"),
    ("database", False, r"(prisma|sequelize|mongoose|knex|repository|db|database)\."),
    ("filesystem", True, r"^(fs\.|readFile|writeFile)"),
    ("process", True, r"^(spawn|exec|execFile|fork)$"),
    ("queue", False, r"(publish|subscribe|enqueue|queue|emit)\b"),
]


def analyzer(path: Column) -> Column:
    """Which analyzer reads a file, first match first."""
    return F.when(path.rlike(r"\.vue$"), F.lit("vue")).when(path.rlike(r"\.(ts|tsx|js|jsx)$"), F.lit(
        "typescript")).when(path.rlike(r"\.py$"), F.lit("python")).when(path.rlike(r"\.java$"), F.lit(
        "java")).when(path.rlike(r"\.go$"), F.lit("go")).otherwise(F.lit("fallback"))


def readable(files: DataFrame) -> DataFrame:
    """files(path, size) of code languages with their status: too large ones are failed without being read."""
    code = files.withColumn("language", X.language(F.col("path"), X.CODE_LANGUAGES)).where("language is not null")
    return code.withColumn("status", F.when(F.col("size") > MOST_BYTES, F.lit("failed")).otherwise(F.lit("parsed")))


# What a file says for a project by the facts in it, and by its path (pattern, points).
FACT_POINTS = {"n_symbols": 3, "n_calls": 2, "n_external": 5, "n_imports": 1}
PATH_POINTS = [(r"(^|/)(main|index|app|server|bootstrap)\.[^.]+$", 40), (r"ipc|controller|service|worker|gateway|adapter|repository|store|dispatcher|scheduler", 25),
    ("test|spec|fixture|example|generated", -20)]


def representative(files: DataFrame, most: int) -> DataFrame:
    """The files(path, n_symbols, n_calls, n_external, n_imports) that say most about a project: by the facts in them, and by their paths."""
    low = F.lower("path")
    facts = [F.coalesce(c, F.lit(0)) * n for c, n in FACT_POINTS.items()]
    points = reduce(lambda a, b: a + b, [*facts, *[F.when(low.rlike(pattern), n).otherwise(0) for pattern, n in PATH_POINTS]])
    return files.withColumn("points", points.cast("long")).orderBy(F.desc("points"), "path").limit(most)


def text_facts(files: DataFrame) -> DataFrame:
    """files(path, content): imports, symbols and calls as regular expressions find them, whatever the language."""
    all_ = lambda p, g=1: F.regexp_extract_all("content", F.lit(p), F.lit(g))
    imports = F.array_distinct(F.concat(all_(r"""\bimport\b[^'"\n;]*['"]([^'"]+)['"]"""), all_(
        r"(?m)^\s*from\s+([\w.]+)\s+import\b"), all_(r"(?m)^\s*import\s+([\w.]+)\s*;?\s*$"), all_(
        r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""")))
    symbols = F.array_distinct(all_(r"\b(?:class|interface|function|def|func|struct|enum|trait)\s+([A-Za-z_]\w*)"))
    calls = F.slice(F.array_distinct(F.filter(all_(r"\b([A-Za-z_][\w.]*)\s*\("), lambda c: ~c.isin("if", "for", "while",
        "switch", "return", "catch", "function"))), 1, 80)
    return files.select("path", imports.alias("imports"), symbols.alias("symbols"), calls.alias("calls"))


def _spoken(kind: str, before: str, verbs: str | None, behind: str, quotes: str) -> Column:
    """What a rule of SPOKEN finds in content: kind, method, path of each match."""
    opened = r"\s*\(\s*" + (r"(?:value\s*=\s*)?" if behind else "")
    pattern = F.lit(f"{before}({verbs or ''}){behind}{opened}[{quotes}]([^{quotes}]+)[{quotes}]")
    method, path = (F.regexp_extract_all("content", pattern, F.lit(group)) for group in (1, 2))
    return F.zip_with(method, path, lambda m, p: F.struct(F.lit(kind).alias("kind"), (F.lit("GET") if verbs is None
        else X.http_method(m)).alias("method"), p.alias("path")))


def endpoints(files: DataFrame) -> DataFrame:
    """files(path, content): HTTP requests and routes, the first of each kind, method and normal path."""
    found = F.concat(*[_spoken(*rule) for rule in SPOKEN])
    rows = files.select(F.col("path").alias("file"), F.posexplode(found).alias("pos", "e")).select("file", "pos",
        "e.*").withColumn("normal", X.http_path(F.col("path")))
    return rows.groupBy("file", "kind", "method", "normal").agg(F.min("pos").alias("pos"), F.min_by("path", "pos")
        .alias("path"))


def rendered(files: DataFrame) -> DataFrame:
    """Components that markup in files(path, content) renders."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(
        r"<([A-Z][A-Za-z0-9]*(?:\.[A-Z][A-Za-z0-9]*)*)[\s/>]"), F.lit(1)))).alias("component"))


def external_kind(name: Column, literal: Column | None = None) -> Column:
    """What an external call does, by its name and, if known, its first literal argument; null for what is none."""
    addressed = F.lit(False) if literal is None else F.coalesce(literal.rlike(ADDRESS), F.lit(False))
    fits = [(kind, name.rlike(pattern if cased else f"(?i){pattern}")) for kind, cased, pattern in EXTERNAL]
    return F.coalesce(*[F.when(here | addressed if kind == "http" else here, F.lit(kind)) for kind, here in fits])


PYTHON_FACTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("fact", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("line",
    T.IntegerType()), T.StructField("arity", T.IntegerType())])


def _python_facts(path: str, content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "error", type(e).__name__, "", int(getattr(e, "lineno", 0) or 0), None)]
    out: list[tuple] = []
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, scope = stack.pop()
        inner = scope
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            arity = None if kind == "class" else len(node.args.posonlyargs) + len(node.args.args)
            out.append((path, kind, node.name, scope, node.lineno, arity))
            inner = f"{scope}.{node.name}".lstrip(".")
            if kind == "class":
                out += [(path, "inherit", ast.unparse(b), inner, node.lineno, None) for b in node.bases]
        elif isinstance(node, ast.Import):
            out += [(path, "import", a.name, scope, node.lineno, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(path, "import", "." * node.level + (f"{node.module}." if node.module else "") + a.name, scope,
                node.lineno, None) for a in node.names]
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            out.append((path, "call", ast.unparse(node.func), scope, node.lineno, len(node.args)))
        stack += [(c, inner) for c in reversed(list(ast.iter_child_nodes(node)))]
    return out


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of Python files (path, content) from their syntax trees: classes, functions, imports, base classes, calls, or the syntax error."""

    def run(batches):
        for pdf in batches:
            rows = [f for p, c in zip(pdf["path"], pdf["content"], strict=True) for f in _python_facts(p, c or "")]
            yield pd.DataFrame(rows, columns=PYTHON_FACTS.names).astype({"line": "Int32", "arity": "Int32"})

    return files.select("path", "content").mapInPandas(run, PYTHON_FACTS)


def first_json(text: str | None, required: str | None = None) -> str | None:
    """The first whole JSON object in free text that has the required key; fenced blocks are looked at first, an envelope's text is looked into."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    for part in [*re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.S), text]:
        at = part.find("{")
        while at >= 0:
            try:
                found, end = decoder.raw_decode(part, at)
            except ValueError:
                at = part.find("{", at + 1)
                continue
            if not required or required in found:
                return json.dumps(found, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            for key in ("result", "response", "output", "text", "content"):
                if isinstance(found.get(key), str) and (inner := first_json(found[key], required)):
                    return inner
            at = part.find("{", end)
    return None


def structured(outputs: DataFrame, required: str | None = None) -> DataFrame:
    """outputs(id, text) with the JSON object that each text holds, as canonical text."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: first_json(t, required))

    return outputs.select("id", find("text").alias("json"))


def checked(responses: DataFrame, known: DataFrame) -> DataFrame:
    """Problems of responses(id, item) against known(item): unknown and repeated items."""
    unknown = responses.join(known.select("item").distinct(), "item", "left_anti").select("id", "item", F.lit("unknown")
        .alias("problem"))
    twice = responses.groupBy("id", "item").agg(F.count("*").alias("n")).where("n > 1").select("id", "item", F.lit(
        "duplicate").alias("problem"))
    return unknown.distinct().unionByName(twice)

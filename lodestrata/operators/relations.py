"""Resolution of relations between files, and their aggregation into relationships between modules.

Tables: relations(id, kind, source_file, target_file, target_kind, resource_id, operation, confidence, detail, symbol),
module_files(file, module), where a file belongs to one module.  Relations alike may come as one row with n and last_id (counted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from .dedupe import keep_first

# Extensions that an import may leave out, in the order they are tried.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".vue", ".py", ".java", ".go", ".rs"]


def architecture_relation() -> Column:
    """The relation between modules that a kind (and operation) of relation between files stands for; null for none."""
    kind, operation = F.col("kind"), F.col("operation")
    located = F.col("target_file").isNotNull() | (F.col("target_kind") == "resource")
    return (
        F.when(kind.isin("import", "inherit"), F.lit("depends_on"))
        .when(kind.isin("call", "render"), F.lit("calls"))
        .when(kind == "http", F.when(F.col("target_file").isNotNull(), F.lit("http_contract")).when(F.col(
            "target_kind") == "resource", F.lit("external_api")))
        .when(kind.isin("database", "filesystem") & located, F.when(operation == "read", F.lit("reads"))
            .when(operation == "write", F.lit("writes")))
        .when(kind == "test", F.lit("tests"))
        .when((kind == "process") & (operation == "invoke"), F.lit("process_invocation"))
        .when(kind == "event", F.when(operation == "publish", F.lit("publishes_event")).when(operation == "subscribe",
            F.lit("subscribes_event")))
    )


def with_modules(relations: DataFrame, module_files: DataFrame | None) -> DataFrame:
    """Adds the modules at both ends (null where a file has none; a resource stands for itself); without module_files they are there already."""
    if module_files is None:
        return relations
    source = module_files.select(F.col("file").alias("source_file"), F.col("module").alias("source_module"))
    target = module_files.select(F.col("file").alias("target_file"), F.col("module").alias("target_module"))
    joined = relations.join(source, "source_file", "left").join(target, "target_file", "left")
    return joined.withColumn("target_module", F.when(F.col("target_kind") == "resource", F.col("resource_id"))
        .otherwise(F.col("target_module")))


def counted(relations: DataFrame) -> DataFrame:
    """relations with n and last_id: a row may stand for n relations alike, id being their least id and detail their least one."""
    return relations if "n" in relations.columns else relations.withColumns({"n": F.lit(1), "last_id": F.col("id")})


def module_edges(relations: DataFrame, module_files: DataFrame | None, categories: DataFrame | None = None) -> DataFrame:
    """Candidate edges: located at both ends, in two modules, with a relation; a subscription points from publisher to subscriber, a test module's calls are tests."""
    found = with_modules(relations, module_files).where("source_module is not null and target_module is not null and "
        "source_module <> target_module")
    relation = architecture_relation()
    if categories is not None:
        found = found.join(categories.select(F.col("module").alias("source_module"), "category"), "source_module",
            "left")
        relation = F.when((F.col("category") == "test-surface") & F.col("kind").isin("call", "render"), F.lit(
            "tests")).otherwise(relation)
    flip = F.coalesce(F.col("operation") == "subscribe", F.lit(False))
    return found.withColumn("relation", relation).where("relation is not null").withColumns({"source": F.when(flip,
        F.col("target_module")).otherwise(F.col("source_module")), "target": F.when(flip, F.col("source_module"))
        .otherwise(F.col("target_module"))})


def relationships(relations: DataFrame, module_files: DataFrame | None, categories: DataFrame | None = None) -> DataFrame:
    """Edges by (source, target, relation, confidence) with counts and the sorted sets of what they are made of.  Ids are unique (sorted_unique), so
    rows are counted, and everything is combined before the one shuffle by edge."""
    edges = module_edges(counted(relations), module_files, categories).withColumn("confidence", F.coalesce("confidence", F.lit(
        "unrated")))
    grouped = edges.groupBy("source", "target", "relation", "confidence").agg(
        F.sum("n").cast("long").alias("n_relations"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set("operation")).alias("operations"),
        F.min("detail").alias("description"),
        F.min("id").alias("first_relation"),
        F.max("last_id").alias("last_relation"),
    )
    return grouped.withColumn("id", F.concat_ws("-", "source", "target", "relation", "confidence"))


def skip_reason(relations: DataFrame, module_files: DataFrame | None) -> DataFrame:
    """Relations that make no edge, with the reason: both are functions of the located row, so the ends are looked up once."""
    return located(relations, module_files).where("not edge").drop("edge")


def located(relations: DataFrame, module_files: DataFrame | None) -> DataFrame:
    """relations with the modules at both ends, whether each makes an edge, and the reason if it makes none."""
    placed = with_modules(relations, module_files)
    apart = F.col("source_module") != F.col("target_module")
    edge = F.coalesce(apart, F.lit(False)) & architecture_relation().isNotNull()
    reason = (
        F.when(F.col("target_file").isNotNull() & F.col("source_module").eqNullSafe(F.col("target_module")) & F.col(
            "source_module").isNotNull(), F.lit("same-module"))
        .when((F.col("target_kind") == "unresolved") & (F.col("n_candidates") > 1), F.lit("ambiguous-target"))
        .when(F.col("target_kind") == "external", F.lit("external"))
        .when(F.col("kind").isin("event", "process") & F.col("operation").isNull(), F.lit("direction-unknown"))
        .otherwise(F.lit("unlocated-target"))
    )
    return placed.withColumn("edge", edge).withColumn("reason", F.when(~F.col("edge"), reason))


def skipped(relations: DataFrame, module_files: DataFrame | None) -> DataFrame:
    """How many relations of each kind make no edge, by reason."""
    return skip_reason(counted(relations), module_files).groupBy("kind", "reason").agg(F.sum("n").cast("long").alias("n"), F.min("id")
        .alias("first_id"))


def outcomes(relations: DataFrame, module_files: DataFrame | None) -> DataFrame:
    """What becomes of the relations of each kind."""
    names = {"same-module": "module-internal", "external": "external", "ambiguous-target": "ambiguous",
        "direction-unknown": "unsupported", "unlocated-target": "unresolved"}
    outcome = F.when(F.col("edge"), F.lit("architecture-edge")).otherwise(X.mapped(F.col("reason"), names))
    return located(counted(relations), module_files).groupBy("kind", outcome.alias("outcome")).agg(F.sum("n").cast("long").alias("n"))


def module_summary(relations: DataFrame, module_files: DataFrame) -> DataFrame:
    """Per module: its relations that are dependencies, internal, unresolved, external."""
    own = with_modules(relations, module_files).where("source_module is not null")
    return own.groupBy(F.col("source_module").alias("module")).agg(
        F.count_if(F.col("kind").isin("import", "inherit")).alias("dependencies"),
        F.count_if(F.col("target_file").isNotNull() & (F.col("source_module") == F.col("target_module"))).alias(
            "internal"),
        F.count_if(F.col("target_kind") == "unresolved").alias("unresolved"),
        F.count_if(F.col("target_kind").isin("external", "resource")).alias("external"),
    )


def in_scope(files: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each file with the deepest scope whose root it lies under (file, scope): a file's folders are exploded, so this is an equi-join, not a LIKE join."""
    roots = files.select("file", F.explode(F.array_append(X.folders(F.col("file")), F.lit(""))).alias("root"))
    found = roots.join(scopes.select("scope", "root"), "root")
    return found.groupBy("file").agg(F.min_by("scope", F.struct(-F.length("root"), "scope")).alias("scope"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(file, spec) whose spec starts with a dot, with target: the first candidate file that exists."""
    base = X.joined_path(F.concat_ws("/", F.nullif(X.parent(F.col("file")), F.lit("")), F.col("spec")))
    tails = ["", *EXTENSIONS, *[f"/index{e}" for e in EXTENSIONS]]
    tried = imports.where(F.startswith(F.col("spec"), F.lit("."))).withColumn("base", base).select("file", "spec",
        F.posexplode(F.transform(F.array(*map(F.lit, tails)), lambda t: F.concat(F.col("base"), t))).alias("pos",
        "target"))
    hit = tried.join(files.select(F.col("file").alias("target")).distinct(), "target")
    return hit.groupBy("file", "spec").agg(F.min_by("target", "pos").alias("target"))


def resolve_by_suffix(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports(file, spec) with a dotted module as spec, with target: the one file whose path ends in it."""
    parts = F.split("file", "/")
    suffixes = files.where(F.col("file").rlike(r"\.py$")).select(F.col("file").alias("target"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i,
        F.size(parts)), "/"))).alias("suffix"))
    module = F.replace("spec", F.lit("."), F.lit("/"))
    wanted = imports.where(~F.startswith(F.col("spec"), F.lit("."))).distinct().select("file", "spec",
        F.explode(F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))).alias("suffix"))
    return wanted.join(suffixes, "suffix").groupBy("file", "spec").agg(F.countDistinct("target").alias("n"), F.min(
        "target").alias("target")).where("n = 1").drop("n")


def match_endpoints(endpoints: DataFrame) -> DataFrame:
    """Requests with their one route: same method, same service (or origin, unless both name a service), segments equal or a parameter.

    The shuffle is on method, segment count and the place compared; only what those leave open is checked pair by pair."""
    segments = F.filter(F.split(F.split_part("path", F.lit("?"), F.lit(1)), "/"), lambda s: s != "")
    ends = endpoints.withColumn("seg", segments).withColumn("n_seg", F.size("seg"))
    places = F.array_compact(F.array(F.when(F.col("service").isNotNull(), F.concat(F.lit("s:"), "service")),
        F.when(F.col("origin").isNotNull(), F.concat(F.lit("o:"), "origin"))))
    ends = ends.withColumn("place", F.explode(places))
    a, b = ends.where("kind = 'request' and method <> 'UNKNOWN'").alias("a"), ends.where("kind = 'route'").alias("b")
    both_services = F.col("a.service").isNotNull() & F.col("b.service").isNotNull()
    same_place = F.when(both_services, F.startswith(F.col("a.place"), F.lit("s:"))).otherwise(F.startswith(F.col(
        "a.place"), F.lit("o:")))
    parameter = lambda s: F.startswith(s, F.lit(":")) | s.rlike(r"^[{\[$].*$") | (s == "*")
    equal = F.forall(F.zip_with(F.col("a.seg"), F.col("b.seg"), lambda x, y: parameter(x) | parameter(y) | (x == y)),
        lambda x: x)
    pairs = a.join(b, (F.col("a.method") == F.col("b.method")) & (F.col("a.n_seg") == F.col("b.n_seg")) & (F.col(
        "a.place") == F.col("b.place"))).where(same_place & equal)
    one = pairs.groupBy(F.col("a.id").alias("request")).agg(F.countDistinct("b.id").alias("n"), F.min("b.id").alias(
        "route"), F.min(F.when((F.col("a.confidence") == "confirmed") & (F.col("b.confidence") == "confirmed"), F.lit(
        "confirmed")).otherwise(F.lit("inferred"))).alias("confidence"))
    return one.where("n = 1").select("request", "route", "confidence", X.nul_joined_hash(F.lit("http"), F.col(
        "request"), F.col("route")).alias("relation_id"))


def predecessors(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Modules of two versions (file, module) that share a file."""
    return current.join(previous.withColumnRenamed("module", "previous"), "file").groupBy("module",
        "previous").agg(F.count("*").alias("shared_files"))


def mutual_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two tables (id, key) whose key is theirs alone on both sides."""
    one = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("id")
        .alias(name)).where("n = 1").drop("n")
    return one(left, "left_id").join(one(right, "right_id"), key)


def overlapping(module_files: DataFrame) -> DataFrame:
    """Files owned more than once, with their owners."""
    return module_files.distinct().groupBy("file").agg(F.count("*").alias("owners"), F.array_sort(F.collect_list(
        "module")).alias("modules")).where("owners > 1")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    known = nodes.select("id")
    source = edges.join(known.withColumnRenamed("id", "source"), "source", "left_anti")
    target = edges.join(known.withColumnRenamed("id", "target"), "target", "left_anti")
    return source.unionByName(target).distinct()


def overlay(base: DataFrame, edits: DataFrame, hidden: DataFrame, manual: DataFrame, key: str = "id") -> DataFrame:
    """Generated rows without the hidden ones, with the user's values where there are any, and the user's own rows."""
    fields = [c for c in edits.columns if c != key]
    named = edits.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    shown = base.join(hidden.select(key).distinct(), key, "left_anti").join(named, key, "left")
    return shown.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
        for c in base.columns]).unionByName(manual.select(*base.columns))


def remapped(values: DataFrame, ids: DataFrame, manual: DataFrame) -> DataFrame:
    """values(id, ...) under new ids (old_id, new_id); manual ids stay, others without a new id go."""
    table = ids.select(F.col("old_id").alias("id"), "new_id").unionByName(manual.select("id", F.col("id").alias(
        "new_id")))
    return values.join(table, "id").drop("id").withColumnRenamed("new_id", "id").select(*values.columns)


def alias_ends(messages: DataFrame, participants: DataFrame) -> DataFrame:
    """messages with sender and receiver ids found by exact alias first, then by the kebab-case of the name; later participants win an alias."""
    alias = participants.select("id", "ord", F.explode(F.array(F.col("id"), X.kebab(F.col("id")), F.col("title"),
        X.kebab(F.col("title")))).alias("alias")).groupBy("alias").agg(F.max_by("id", "ord").alias("found"))
    out = messages
    for end in ("sender", "receiver"):
        exact = alias.select(F.col("alias").alias(end), F.col("found").alias("_exact"))
        slug = alias.select(F.col("alias").alias("_slug"), F.col("found").alias("_by_slug"))
        out = out.join(exact, end, "left").withColumn("_slug", X.kebab(F.col(end))).join(slug, "_slug",
            "left").withColumn(f"{end}_id", F.coalesce("_exact", "_by_slug")).drop("_exact", "_by_slug", "_slug")
    return out


def callable_targets(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """calls(id, name, arity) with the one declaration of that name and arity; without exactly one they stay unresolved."""
    found = declarations.groupBy("name", "arity").agg(F.count("*").alias("n"), F.min("declaration").alias("target"))
    return calls.join(found, ["name", "arity"], "left").select("id", "name", "arity", F.when(F.col("n") == 1, F.col(
        "target")).alias("target"), F.coalesce("n", F.lit(0)).alias("candidates"))


def resources(operations: DataFrame) -> DataFrame:
    """Resources that operations(id, kind, target, method, receiver, scope, file) name, with how many and which of them."""
    kind, target = F.col("kind"), F.col("target")
    absolute = X.joined_path(F.replace(target, F.lit("\\"), F.lit("/")))
    key = (
        F.when((kind == "http") & target.rlike("(?i)^https?://"), F.concat(F.lit("api:"), F.coalesce("method", F.lit(
            "UNKNOWN")), F.lit(":"), X.url_origin(target), F.lit(":"), X.url_path(target)))
        .when((kind == "http") & target.rlike("^/(?!/)"), F.concat(F.lit("api:"), F.coalesce("method", F.lit(
            "UNKNOWN")), F.lit(":scope:"), "scope", F.lit(":"), F.regexp_extract(target, "^[^?#]*", 0)))
        .when((kind == "event") & F.col("receiver").isNotNull(), F.concat_ws(":", F.lit("event"), "receiver", target))
        .when(kind == "database", F.concat(F.lit("database:"), F.coalesce("receiver", "scope"), F.lit(":"),
            X.sql_table(target)))
        .when((kind == "filesystem") & absolute.rlike("^(/|[A-Za-z]:/)"), F.concat(F.lit("filesystem:absolute:"),
            absolute))
        .when(kind == "process", F.concat_ws(":", F.lit("process"), "scope", target))
    )
    named = operations.where(F.trim(target) != "").withColumn("key", key).where("key is not null")
    return named.groupBy("key").agg(F.min("kind").alias("kind"), F.count("*").alias("n_operations"), F.countDistinct(
        "file").alias("n_files")).withColumn("id", F.concat(F.lit("resource:"), F.substring(F.sha2(F.col("key"), 256),
        1, 24)))


def sorted_unique(relations: DataFrame) -> DataFrame:
    """Relations by id, the first by file, kind and detail.  Nearly all ids are there once, so combining before the shuffle would sort every row for nothing: they are dealt by id first, and sorted once."""
    return keep_first(relations.repartition("id"), ["id"], [F.col(c) for c in ("source_file", "target_file", "kind", "detail", "confidence")])


def replaced(relations: DataFrame, programmatic: DataFrame) -> DataFrame:
    """Relations with those of the same id from a better source in their place, and the better source's others."""
    return relations.join(programmatic.select("id").distinct(), "id", "left_anti").unionByName(programmatic.select(
        *relations.columns))


def majority(rows: DataFrame, group: str, label: str, rank: Column | None = None) -> DataFrame:
    """The most frequent label of each group; on a tie the lower rank, then the name."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), rank if rank is not None else F.lit(0), F.col(label))
    return counts.groupBy(group).agg(F.min_by(label, order).alias(label), F.max("n").alias("votes"))


def unique_label(rows: DataFrame, group: str, label: str) -> DataFrame:
    """A group's label if there is just one, else null."""
    return rows.groupBy(group).agg(F.when(F.countDistinct(label) == 1, F.min(label)).alias(label))


def title_suffixes(titles: DataFrame) -> DataFrame:
    """titles(id, title, suffix): titles that occur twice get their suffix."""
    twice = F.count("*").over(Window.partitionBy("title")) > 1
    return titles.withColumn("shown", F.when(twice, F.concat_ws(" · ", "title", "suffix")).otherwise(F.col("title")))

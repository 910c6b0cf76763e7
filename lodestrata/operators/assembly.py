"""Assembly of graphs and reviews: memberships, roles, projections, matched relations, evidence, edits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as X

# How many folders get a role, and how many roles are rolled up into one.
MOST_FOLDERS, MOST_ROLES = 30, 4
# What a participant of a sequence is, by category and by words of its path, first match first.
PARTICIPANTS = {
    "api-boundary": "gateway",
    "domain-service": "service",
    "data-access": "database",
    "external-integration": "external",
    "job-worker": "worker",
    "shared-utility": "utility",
    "test-surface": "component",
    "unknown": "component",
}
PARTICIPANT_WORDS = [
    ("gateway", ["gateway", "api", "controller", "route", "router"]),
    ("database", ["repository", "db", "database", "schema"]),
    ("worker", ["worker", "queue", "job"]),
    ("external", ["client", "external", "payment", "webhook"]),
]
# What is said of a folder, by words of its path, first match first.
FOLDER_SENTENCES = [
    (["test", "spec", "__tests__"], "Groups regression coverage for the %s."),
    (["component", "view", "page", "panel", "workspace", "node"], "Groups UI components and interaction surfaces for "
        "the %s."),
    (["service", "domain", "core", "workflow", "analysis", "analyzer"],
        "Groups service logic and workflow orchestration for the %s."),
    (["store", "storage", "schema", "database", "repo", "repository", "data"], "Groups storage and data handling code "
        "for the %s."),
    (["agent", "cli", "ipc", "adapter", "bridge"], "Groups agent, command, or process-boundary integration code for "
        "the %s."),
    (["util", "helper", "shared", "common", "config"], "Groups shared support utilities for the %s."),
]
# Which resources are drawn as what.
RESOURCE_TYPES = {"api": "api", "database": "data", "filesystem": "data"}
# What a call of a known interface does: language's module, interface, kind, operation.
INTERFACES = [
    ("requests", "get", "http", "invoke"),
    ("requests", "post", "http", "invoke"),
    ("httpx", "get", "http", "invoke"),
    ("net/http", "Get", "http", "invoke"),
    ("net/http", "Do", "http", "invoke"),
    ("java.net.http.HttpClient", "send", "http", "invoke"),
    ("urllib.request", "urlopen", "http", "invoke"),
    ("builtins", "open", "filesystem", "read"),
    ("pathlib", "read_text", "filesystem", "read"),
    ("pathlib", "write_text", "filesystem", "write"),
    ("java.nio.file.Files", "readString", "filesystem", "read"),
    ("java.nio.file.Files", "writeString", "filesystem", "write"),
    ("os", "ReadFile", "filesystem", "read"),
    ("os", "WriteFile", "filesystem", "write"),
    ("subprocess", "run", "process", "invoke"),
    ("os/exec", "Run", "process", "invoke"),
    ("java.lang.ProcessBuilder", "start", "process", "invoke"),
    ("sqlite3", "executemany", "database", "write"),
    ("sqlite3", "execute", "database", "invoke"),
    ("database/sql", "Query", "database", "read"),
    ("database/sql", "Exec", "database", "write"),
    ("java.sql.Statement", "executeQuery", "database", "read"),
    ("java.sql.Statement", "executeUpdate", "database", "write"),
]


def _says(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in text, in whatever case."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


# ---- memberships and roles


def group_members(memberships: DataFrame) -> DataFrame:
    """memberships(group_id, module, title): the modules and titles of each group, sorted."""
    found = memberships.groupBy("group_id").agg(F.collect_set("module").alias("modules"), F.collect_set("title").alias(
        "titles"))
    return found.select("group_id", F.array_sort("modules").alias("modules"), F.array_sort("titles").alias("titles"))


def with_module(files: DataFrame, owned: DataFrame, role: Column) -> DataFrame:
    """files(path, role) with the module that owns them (path, module, category) and, where they have none, a role."""
    return files.join(owned, "path", "left").withColumn("role", F.coalesce("role", role))


def folder_sentence(path: Column, category: Column, files: Column) -> Column:
    """What a folder of a module of some category is for."""
    label = F.lower(category)
    plain = F.format_string("Groups %d related files in %s for the %s.", files, X.file_name(path), label)
    rules = [F.when(_says(path, words), F.format_string(sentence, label)) for words, sentence in FOLDER_SENTENCES]
    return F.coalesce(*rules, plain)


def folder_roles(files: DataFrame, most: int = MOST_FOLDERS) -> DataFrame:
    """files(module, category, path): the role of each folder above a module's files, the first so many of a module."""
    above = files.select("module", "category", F.explode(X.folders(F.col("path"))).alias("folder"))
    counted = above.groupBy("module", "category", "folder").agg(F.count("*").alias("files"))
    place = F.row_number().over(Window.partitionBy("module").orderBy("folder"))
    first = counted.withColumn("place", place).where(F.col("place") <= most)
    label = X.mapped(F.col("category"), X.CATEGORY_LABELS)
    return first.select("module", "folder", folder_sentence(F.col("folder"), label, F.col("files")).alias("role"))


def rolled_up(files: DataFrame, roles: DataFrame, most: int = MOST_ROLES) -> DataFrame:
    """A role for each folder above files(path): its own in roles(path, role), else what the first different roles below it come to.

    Level by level from the deepest, as a folder's role counts for the folders above it."""
    known = roles.select("path", "role")
    leaves = files.select("path").distinct().join(known, "path", "left")
    depth = F.size(F.filter(F.split("path", "/"), lambda p: p != ""))
    # path, its first file, and its roles in order: of a folder its own comes first, then those below it
    below = leaves.select("path", F.col("path").alias("first"), depth.alias("depth"), F.array_compact(F.array("role"))
        .alias("roles"))
    levels = below.agg(F.max("depth").alias("d")).first()["d"] or 0
    done = None
    for level in range(levels, 1, -1):
        here = below.where(F.col("depth") == level)
        each = here.select(X.parent(F.col("path")).alias("path"), "first", F.posexplode_outer("roles").alias("pos",
            "role"))
        firsts = each.groupBy("path", "role").agg(F.min(F.struct("first", "pos")).alias("at"))
        rows = F.sort_array(F.collect_list(F.when(F.col("role").isNotNull(), F.struct("at",
            "role"))))  # different roles
        folder = firsts.groupBy("path").agg(F.min("at.first").alias("first"), rows.alias("rows")).join(known, "path",
            "left")
        found = F.slice(F.transform("rows", lambda x: x["role"]), 1, most)
        folder = folder.withColumn("found", found).drop("rows")
        more = F.format_string("%s, plus %d related responsibilities.", F.regexp_replace(F.try_element_at("found",
            F.lit(1)), r"\.$", ""), F.size("found") - 1)
        role = F.coalesce("role", F.when(F.size("found") == 1, F.try_element_at("found", F.lit(1))).when(F.size(
            "found") > 1, more))
        folder = folder.withColumn("role", role)
        result = folder.where("role is not null").select("path", "role")
        done = result if done is None else done.unionByName(result)
        together = F.slice(F.array_distinct(F.concat(F.array_compact(F.array("role")), "found")), 1, most + 1)
        below = below.where(F.col("depth") < level).unionByName(folder.select("path", "first", F.lit(level - 1).alias(
            "depth"), together.alias("roles")))
    return known.limit(0) if done is None else done


def participant_kind(category: Column) -> Column:
    return X.mapped(category, PARTICIPANTS)


def participant_of_path(path: Column) -> Column:
    return F.coalesce(*[F.when(_says(path, words), F.lit(kind)) for kind, words in PARTICIPANT_WORDS], F.lit("service"))


def signature(text: Column) -> Column:
    """The first line of a declaration without what opens its body."""
    line = F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), "\r$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"\s*\{\s*$", ""), r":\s*$", ""))


# What makes a version inexact: beginnings, signs, parts.
INEXACT = [r"(?i)^(latest|unknown|unspecified|\*|x|\^|~|>=|<=|>|<)", r"[|*^~<>]", r"(?:^|[.\s])[xX](?:$|[.\s])",
    r"\s+-\s+"]


def exact_version(text: Column) -> Column:
    """Whether a version is there and names one release."""
    plain = F.trim(text)
    loose = F.exists(F.array(*map(F.lit, INEXACT)), lambda p: F.regexp_like(plain, p))
    return F.coalesce((plain != "") & ~loose, F.lit(False))


@F.pandas_udf(T.BooleanType())
def normal_text(texts: pd.Series) -> pd.Series:
    """Whether a text is there and in Unicode's composed normal form."""
    return texts.map(lambda t: bool(t) and unicodedata.is_normalized("NFC", t))


# ---- graphs


def as_graph(modules: DataFrame, relationships: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of modules(id, title, category) and resources(id, title, kind), and edges of relationships(id, source, target, relation, confidence)."""
    label, category = X.mapped(F.col("category"), X.CATEGORY_LABELS), F.col("category")
    nodes = modules.select(
        "id",
        "title",
        label.alias("subtitle"),
        X.mapped(category, X.NODE_TYPES).alias("node_type"),
        F.coalesce(X.mapped(category, X.CATEGORY_LAYERS), F.lit("infrastructure")).alias("layer"),
    )
    kind = F.coalesce(X.mapped(F.col("kind"), RESOURCE_TYPES), F.lit("external"))
    drawn = resources.select("id", "title", F.col("kind").alias("subtitle"), kind.alias("node_type"), F.lit(
        "integration").alias("layer"))
    return nodes.unionByName(drawn), relationships.select("id", "source", "target", "relation", "confidence")


def overview(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Generated nodes and edges with their light columns."""
    generated = F.coalesce(F.col("origin") != "manual", F.lit(True))
    return nodes.where(generated).select(*columns), edges.where(generated).select("id", "source", "target", "relation",
        "confidence")


def same_view(left: DataFrame, right: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Which of right's rows (by key) have the identity of left's; nulls are equal."""
    a = left.select(key, *[F.col(c).alias(f"left_{c}") for c in identity])
    equal = F.lit(True)
    for c in identity:
        equal = equal & F.col(f"left_{c}").eqNullSafe(F.col(c))
    return a.join(right.select(key, *identity), key).select(key, equal.alias("same"))


def graph_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether the lists of ids before and after differ in length or before has one that after has not: one row."""
    lost = before.select("id").join(after.select("id"), "id", "left_anti").agg(F.count("*").alias("lost"))
    counts = before.agg(F.count("*").alias("n_before")).join(F.broadcast(after.agg(F.count("*").alias("n_after"))),
        F.lit(True))
    both = counts.join(F.broadcast(lost), F.lit(True))  # one row each
    return both.select(((F.col("n_before") != F.col("n_after")) | (F.col("lost") > 0)).alias("changed"))


def expanded_for_node(node_groups: Column, collapsed: Column) -> Column:
    """The collapsed groups that stay so when a node is to be seen: those that it is not in."""
    return F.array_except(collapsed, node_groups)


def expanded_for_group(nodes: DataFrame, group: str, collapsed: list[str]) -> DataFrame:
    """The collapsed groups after one is opened: the others, and the groups directly in it."""
    at = F.array_position("groups", group).cast("int")
    inner = nodes.where(at > 0).select(F.try_element_at("groups", at + 1).alias("group")).where("group is not null")
    others = nodes.sparkSession.createDataFrame([(c,) for c in collapsed if c != group], "group string")
    return inner.unionByName(others).distinct()


def restored(visible: DataFrame, generated: DataFrame) -> DataFrame:
    """visible(id, origin) and the generated rows that it has not; a row by hand with a generated id is a conflict."""
    clash = visible.where("origin = 'manual'").join(generated.select("id"), "id", "left_semi").withColumn("state",
        F.lit("conflict"))
    rest = visible.join(clash.select("id"), "id", "left_anti").withColumn("state", F.lit("kept"))
    back = generated.join(visible.select("id"), "id", "left_anti").withColumn("state", F.lit("restored"))
    return clash.unionByName(rest).unionByName(back, allowMissingColumns=True)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes without those in gone(id), their neighbours marked as stale, and the edges that lead to none of these."""
    out = gone.select("id").distinct()
    from_gone = edges.join(out.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias(
        "id"))
    to_gone = edges.join(out.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias(
        "id"))
    near = from_gone.unionByName(to_gone).distinct().withColumn("stale", F.lit(True))
    left = nodes.join(out, "id", "left_anti").join(near, "id", "left").withColumn("stale", F.coalesce("stale",
        F.lit(False)))
    kept = edges.join(out.select(F.col("id").alias("source")), "source", "left_anti").join(out.select(F.col("id").alias(
        "target")), "target", "left_anti")
    return left, kept


# ---- reviews


def matched_relations(previous: DataFrame, current: DataFrame, id_map: DataFrame) -> DataFrame:
    """Which relation of current (id, source, target, relation, pending) is which of previous, whose ends id_map(old_id, new_id) leads over.

    One with the same id and ends first; of the others those that are each other's only match by ends and relation.  On either side an id is there once."""
    ends = id_map.select(F.col("old_id").alias("source"), F.col("new_id").alias("to_source"))
    old = previous.where("not pending").join(ends, "source")
    old = old.join(ends.select(F.col("source").alias("target"), F.col("to_source").alias("to_target")), "target")
    old = old.select(F.col("id").alias("old_id"), "to_source", "to_target", "relation")
    new = current.where("not pending").select(F.col("id").alias("new_id"), F.col("source").alias("to_source"), F.col(
        "target").alias("to_target"), "relation")
    key = ["to_source", "to_target", "relation"]
    # both sides are dealt by key once: ids that meet under a key are the same relation, what is left under it is counted
    sides = old.select(*key, F.col("old_id").alias("id"), F.lit(1).alias("n_old"), F.lit(0).alias("n_new")).unionByName(new.select(*key, F.col("new_id").alias("id"), F.lit(0).alias("n_old"), F.lit(1).alias("n_new")))
    met = sides.dropna(subset=key).repartition(*key).groupBy(*key, "id").agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
    both = (F.col("n_old") > 0) & (F.col("n_new") > 0)
    w = Window.partitionBy(*key)
    lone = lambda c: F.when(~both, c)
    met = met.withColumns({"lone_old": F.sum(lone(F.col("n_old"))).over(w), "lone_new": F.sum(lone(F.col("n_new"))).over(w), "new_id": F.min(F.when(~both & (F.col("n_new") > 0), F.col("id"))).over(w)})
    only = (F.col("lone_old") == 1) & (F.col("lone_new") == 1) & (F.col("n_old") > 0)
    return met.where(both | only).select(F.col("id").alias("old_id"), F.when(both, F.col("id")).otherwise(F.col("new_id")).alias("new_id"))


def enhanced(modules: DataFrame, review: DataFrame, words: list[str]) -> DataFrame:
    """modules(id, ...) with the words that a review of them has instead of their own; nothing else changes."""
    said = review.select("id", *[F.col(w).alias(f"review_{w}") for w in words])
    return modules.join(said, "id", "left").withColumns({w: F.coalesce(f"review_{w}", w) for w in words}).drop(*[
        f"review_{w}" for w in words])


def evidence_confidence(evidence: DataFrame, relations: DataFrame, by_id: Column | None = None, by_file: Column | None = None) -> DataFrame:
    """evidence(evidence_id, relation_id, file, symbol, detail) with the confidence of the first of relations(place, id, source_file, symbol, detail,
    confidence) that it is from: by the relation's id if it has one, else by its file; inferred if none fits.  An evidence_id is there once.

    by_id, by_file: conditions on symbol that hold for all evidence with and without a relation's id; as symbols must be equal, other relations are not dealt there."""
    same = F.struct("symbol", "detail")  # nulls in it are equal, and it is one key, by which both sides are dealt once

    def joined(part: DataFrame, of: str, to: str, asked: Column | None) -> DataFrame:
        # the first relation of each key is found before evidence meets it, so a row of evidence meets one at most
        part = part.withColumn("same", same)
        keyed = (relations if asked is None else relations.where(asked)).where(F.col(to).isNotNull()).select(F.col(to).alias("r_of"), same.cast(part.schema["same"].dataType).alias("r_same"), "place", "confidence")
        first = keyed.repartition("r_of", "r_same").groupBy("r_of", "r_same").agg(F.min_by("confidence", "place").alias("confidence"))
        return part.join(first, (F.col(of) == F.col("r_of")) & (F.col("same") == F.col("r_same")), "left").drop("same", "r_of", "r_same")

    found = joined(evidence.where("relation_id is not null"), "relation_id", "id", by_id).unionByName(joined(evidence.where("relation_id is null"), "file", "source_file", by_file))
    return found.withColumn("confidence", F.coalesce("confidence", F.lit("inferred")))


def first_of_each(items: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The first item of each key, a null being a value like others."""
    whole = F.struct(*[F.col(c) for c in items.columns])
    return items.groupBy(*keys).agg(F.min_by(whole, F.col(place)).alias("row_")).select("row_.*")


def once_by_hash(evidence: DataFrame, identity: list[str], place: str) -> DataFrame:
    """Evidence with an id made of its identity, the last of those that share one."""
    named = evidence.withColumn("evidence_id", F.concat(F.lit("evidence-"), X.nul_joined_hash(*[F.col(c)
        for c in identity], size=64)))
    whole = F.struct(*[F.col(c) for c in named.columns])
    return named.groupBy("evidence_id").agg(F.max_by(whole, F.col(place)).alias("row_")).select("row_.*")


def representatives(evidence: DataFrame, place: str) -> DataFrame:
    """evidence(module, ...): the first of each module that is not a relationship's."""
    return first_of_each(evidence.where("relationship_id is null"), ["module"], place)


def enriched(files: DataFrame, symbols: DataFrame, errors: DataFrame) -> DataFrame:
    """files(path, status) with their linked symbols (path, n_symbols); one with errors (path) and symbols has failed."""
    wrong = errors.groupBy("path").agg(F.count("*").alias("n_errors"))
    both = files.join(symbols, "path", "left").join(wrong, "path", "left")
    status = F.when(F.col("n_symbols").isNotNull() & (F.col("n_errors") > 0), F.lit("failed")).otherwise(F.col(
        "status"))
    depth = F.when(F.col("n_symbols").isNotNull(), F.lit("semantic")).otherwise(F.lit("lightweight"))
    return both.select("path", status.alias("status"), depth.alias("depth"), F.coalesce("n_symbols", F.lit(0)).alias(
        "n_symbols"))


# ---- binding


def declarations_in_sight(names: DataFrame, declarations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """For each use of a name (id, scope, name) the one declaration (scope, name, declaration) in its scope or in one that its scope depends on
    (scope, on); candidates says how many there are."""
    sight = dependencies.select("scope", F.col("on").alias("of")).unionByName(dependencies.select("scope", F.col(
        "scope").alias("of")))
    sight = sight.unionByName(names.select("scope", F.col("scope").alias("of"))).distinct()
    # declarations are counted by scope and name before uses meet them
    index = declarations.groupBy(F.col("scope").alias("of"), "name").agg(F.count("*").alias("n"), F.min("declaration")
        .alias("declaration"))
    seen = sight.join(index, "of").groupBy("scope", "name").agg(F.sum("n").alias("candidates"), F.min("declaration")
        .alias("declaration"))
    found = names.join(seen, ["scope", "name"], "left")
    target = F.when(F.col("candidates") == 1, F.col("declaration"))
    return found.select("id", F.coalesce("candidates", F.lit(0)).alias("candidates"), target.alias("declaration"))


def through_exports(uses: DataFrame, exports: DataFrame) -> DataFrame:
    """Follows uses (id, module, name) through re-exports (module, name, to_module, to_name; to_module null: declared here) to the declaring module.

    By pointer doubling over the exported names: each round every name points twice as far, so a chain of n takes log2 n rounds.  Names that still point at
    one that goes on when every chain without a cycle must have ended are on a cycle; these stay unresolved, as does a name that a module does not export once."""
    from .clustering import settled

    one = exports.groupBy("module", "name").agg(F.count("*").alias("n"), F.min("to_module").alias("to_module"), F.min(
        "to_name").alias("to_name")).where("n = 1")
    at = settled(one.select("module", "name", F.coalesce("to_module", "module").alias("to_module"), F.when(F.col("to_module").isNull(), F.col("name")).otherwise(
        F.col("to_name")).alias("to_name"), F.col("to_module").isNull().alias("here")))
    total, reach = at.count(), 1
    while reach < total and not at.where("not here").isEmpty():
        far = at.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.col("to_module").alias("far_module"), F.col("to_name").alias(
            "far_name"), F.col("here").alias("far_here"))
        # a name that is not exported leads nowhere: its use is dropped here
        step = at.where("not here").join(far, ["to_module", "to_name"]).select("module", "name", F.col("far_module").alias("to_module"), F.col("far_name").alias("to_name"),
            F.col("far_here").alias("here"))
        at, reach = settled(at.where("here").unionByName(step)), 2 * reach
    found = uses.join(at.where("here"), ["module", "name"]).select("id", F.col("to_module").alias("declared_in"), F.col("to_name").alias("declared_as"))
    return uses.select("id").join(found, "id", "left")


def reaching(assignments: DataFrame, calls: DataFrame) -> DataFrame:
    """Which assignments (name, at, path, identity) of a name reach calls (id, name, at, path): id, set_at, identity.

    path is the array of branches that hold a line, outermost first, each as control:arm.  Of the assignments before a call and not in another arm
    than it, the last one whose branches all hold the call too rules out those before it."""
    a = assignments.select("name", F.col("at").alias("set_at"), F.col("path").alias("set_path"), "identity")
    met = calls.join(a, "name").where("set_at <= at")
    control = lambda x: F.split_part(x, F.lit(":"), F.lit(1))
    other = lambda s: F.exists("path", lambda p: (control(p) == control(s)) & (p != s))
    met = met.where(~F.exists("set_path", other))
    last = Window.partitionBy("id", "set_path").orderBy(F.desc("set_at"))
    met = met.withColumn("rank", F.row_number().over(last)).where("rank = 1")
    outer = F.slice("path", F.lit(1), F.size("set_path")) == F.col("set_path")
    met = met.withColumn("outer", outer).withColumn("from", F.max(F.when(F.col("outer"), F.col("set_at")))
        .over(Window.partitionBy("id")))
    met = met.where(F.when(F.col("outer"), F.col("set_at") == F.col("from")).otherwise(F.col("set_at") > F.coalesce(
        "from", F.lit(-1))))
    return met.select("id", "set_at", "identity")


def branch_binding(assignments: DataFrame, calls: DataFrame) -> DataFrame:
    """What a local name stands for at calls (id, name, at, path): the identity that all assignments (name, at, path, identity) which reach it agree on;
    where they disagree the name is ambiguous."""
    found = reaching(assignments, calls).groupBy("id").agg(F.count_distinct("identity").alias("n"), F.min("identity").alias("identity"))
    state = F.when(F.col("n") == 1, F.lit("bound")).when(F.col("n") > 1, F.lit("ambiguous")).otherwise(F.lit(
        "unresolved"))
    return calls.select("id").join(found, "id", "left").select("id", state.alias("state"), F.when(F.col("n") == 1,
        F.col("identity")).alias("identity"))


def package_targets(imports: DataFrame, packages: DataFrame, exports: DataFrame) -> DataFrame:
    """Where imports (id, scope, spec) of workspace packages (package, scope, rank: who sees it, nearest first) lead by their exports (package, key, target).

    The longest package name before a slash counts, of packages of that name the nearest; an exact key comes before a pattern with one *, of patterns
    the longest.  null: no such export."""
    parts = F.split("spec", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tried = imports.select("id", "scope", "spec", F.explode(prefixes).alias("package"))
    met = tried.join(packages, ["scope", "package"])
    met = met.groupBy("id").agg(F.max_by(F.struct("package", "spec", "root"), F.struct(F.length("package"), -F.col(
        "rank"))).alias("m")).select("id", "m.*")
    met = met.withColumn("key", F.concat(F.lit("."), F.substr("spec", F.length("package") + 1)))
    keyed = met.join(exports.withColumnRenamed("key", "pattern"), ["package", "root"])
    head, tail = F.split_part("pattern", F.lit("*"), F.lit(1)), F.split_part("pattern", F.lit("*"), F.lit(2))
    star = F.contains("pattern", F.lit("*"))
    fits = F.when(star, F.startswith("key", head) & F.endswith("key", tail) & (F.length("key") >= F.length(head)
        + F.length(tail))).otherwise(F.col("key") == F.col("pattern"))
    middle = F.substring("key", F.length(head) + 1, F.length("key") - F.length(head) - F.length(tail))
    led = F.when(star, F.replace("target", F.lit("*"), middle)).otherwise(F.col("target"))
    best = keyed.where(fits).groupBy("id").agg(F.max_by(led, F.struct(~star, F.length(head), F.col("pattern"))).alias(
        "target"))
    return imports.select("id").join(best, "id", "left")


def interface_operations(calls: DataFrame) -> DataFrame:
    """calls(id, module, member, target): what they do, where their module and member are a known interface's; confirmed if the target is known."""
    rules = calls.sparkSession.createDataFrame(INTERFACES, "module string, member string, kind string, operation "
        "string")
    found = calls.join(F.broadcast(rules), ["module", "member"])  # a small fixed table
    return found.select("id", "kind", "operation", F.when(F.col("target").isNotNull(), F.lit("confirmed"))
        .otherwise(F.lit("inferred")).alias("confidence"))


def typed_targets(relations: DataFrame, scanned: DataFrame) -> DataFrame:
    """relations(id, spec, resolved, reason) with a target of a kind: a scanned file (path), unresolved if relative or for a reason, else external."""
    files = scanned.select(F.col("path").alias("resolved"), F.lit(True).alias("known"))
    kind = F.when(F.col("known"), F.lit("file")).when(F.col("reason").isNotNull() | F.startswith("spec", F.lit(".")),
        F.lit("unresolved")).otherwise(F.lit("external"))
    both = relations.join(files, "resolved", "left").withColumn("target_kind", kind)
    return both.select("id", "target_kind", F.when(F.col("target_kind") == "file", F.col("resolved")).otherwise(F.col(
        "spec")).alias("target"))


def snapshot_changes(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """Which files of a pinned snapshot (path, hash) have changed, gone or come by the time a result is published: a result may stand if there are none."""
    a, b = pinned.select("path", F.col("hash").alias("was")), found.select("path", F.col("hash").alias("now"))
    state = F.when(F.col("was").isNull(), F.lit("added")).when(F.col("now").isNull(), F.lit("deleted")).when(F.col(
        "was") != F.col("now"), F.lit("changed"))
    return a.join(b, "path", "full").select("path", state.alias("state")).where("state is not null")


def guidance_context(delta: DataFrame, label: str) -> DataFrame:
    """A delta (id, status, fields) as one document of canonical JSON a row, for export."""
    return delta.select("id", F.to_json(F.struct(F.lit(label).alias("label"), "id", "status", "fields")).alias(
        "document"))

"""Grouping files into modules, and modules into areas.

A file's seed (key, kind, name, anchor) comes from its path alone.  Support files that three domains use become shared; named support files join the
one responsibility they are named after and call; a lone file joins the one group that uses it if it is named after it; unknown files join
the one group beside them.  All steps are plain joins; the lone files' step depends on its own results in order, and goes in rounds over those files
that wait for others."""

from __future__ import annotations

from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .graph import settled, set_hash
from .relations import majority

# Folder and file names that name no feature.
GENERIC_DIRECTORIES = ["agents", "api", "app", "apps", "backend", "client", "components", "config", "contexts", "data",
    "domain", "external", "features", "frontend", "hooks", "integration", "integrations", "lib", "libs", "main",
    "messaging", "mobile", "model", "models", "modules", "node", "nodes", "packages", "pages", "renderer",
    "repositories", "repository", "routes", "service", "services", "shared", "src", "server", "storage", "stores", "ui",
    "utils", "utilities", "views", "web", "workers", "worker", "common", "helpers"]
GENERIC_NAMES = ["api", "app", "common", "constants", "controller", "helpers", "index", "init", "main", "module",
    "repository", "route", "router", "service", "services", "shared", "types", "util", "utils"]
SUPPORT_SUFFIXES = ["helper", "helpers", "util", "utils", "utility", "utilities"]
KINDS = ["call", "render", "database", "filesystem", "event"]
RANKS = {"domain-service": 0, "api-boundary": 1, "data-access": 2, "job-worker": 3, "external-integration": 4,
    "shared-utility": 5, "test-surface": 6, "unknown": 7}
MOST_FILES = 20


def _any(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _last_feature(parts: Column, below: Column) -> Column:
    """The place (from 1) of the last folder up to `below` that names a feature; 0 for none."""
    places = F.when(below >= 1, F.sequence(F.lit(1), below)).otherwise(F.array().cast("array<int>"))
    named = F.filter(places, lambda i: ~F.array_contains(_any(GENERIC_DIRECTORIES), F.lower(F.element_at(parts, i)))
        & ~F.array_contains(_any(GENERIC_NAMES), X.kebab(F.element_at(parts, i))))
    return F.coalesce(F.array_max(named), F.lit(0))


def seeds(files: DataFrame) -> DataFrame:
    """files(file, ...) with kind, name, anchor and key of each file's seed."""
    path = X.normal_path(F.col("file"))
    d = files.withColumn("path", path).withColumn("parts", F.split("path", "/")).withColumn("low", F.transform("parts",
        F.lower)).withColumn("n", F.size("parts")).withColumn("stem", X.responsibility_stem(F.col("path"))).withColumn(
        "suffix", X.suffix_word(F.col("path")))
    first = lambda names: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.col("n")),
        lambda i: F.array_contains(_any(names), F.element_at("low", i)))), F.lit(0))
    head = lambda k: F.when(k >= 1, F.array_join(F.slice("parts", 1, k), "/")).otherwise(F.lit(""))
    d = settled(
        d)  # each step names what the next uses often; without a cut their expressions would be written out again and again
    d = d.withColumns({"i_test": first(["test", "tests", "__tests__"]), "i_ext": first(["integration", "integrations",
        "external"]), "i_src": first(["src"]), "i_con": first(["contracts"]), "i_shared": first(["shared", "common"])})
    test = X.is_test_path(F.col("path"))
    test_feature = _last_feature(F.col("parts"), F.when(F.col("i_test") > 0, F.col("i_test") - 1).otherwise(F.col(
        "n") - 1))
    folder = head(F.col("n") - 1)
    at_test = F.array_join(F.filter(F.slice("parts", 1, F.col("i_test") + 1), lambda s: ~F.contains(s, F.lit("."))),
        "/")
    test_anchor = F.when(test_feature > 0, head(test_feature)).when(F.col("i_test") > 0, at_test).otherwise(folder)
    after_src = F.regexp_replace(F.coalesce(F.try_element_at("low", F.col("i_src") + 1), F.lit("")), r"\.[^.]+$", "")
    contract = F.when((F.col("i_src") > 0) & (after_src == "types"), F.col("i_src") + 1).when(F.col("i_con") > 0, F.col(
        "i_con"))
    next_shared = F.try_element_at("parts", F.col("i_shared") + 1)
    shared = (F.col("i_shared") > 0) & next_shared.isNotNull() & ~F.contains(next_shared, F.lit("."))
    ext_name = F.coalesce(F.when(F.col("i_ext") < F.col("n"), X.kebab(F.try_element_at("parts", F.col("i_ext") + 1))),
        F.col("stem"))
    feature = _last_feature(F.col("parts"), F.col("n") - 1)
    support_folder = F.exists(F.slice("low", 1, F.greatest(F.col("n") - 1, F.lit(0))), lambda s: F.array_contains(_any([
        "shared", "common", "utils", "utilities", "helpers"]), s))
    specific = F.col("suffix").isin(X.RESPONSIBILITY_SUFFIXES) & ~F.col("suffix").isin(SUPPORT_SUFFIXES)
    own = (F.col("stem") != "") & ~F.col("stem").isin(GENERIC_NAMES)
    supporting = ~specific & (support_folder | F.col("suffix").isin(SUPPORT_SUFFIXES))
    whole = F.array_join(X.name_parts(F.col("path")), "-")
    d = settled(d.withColumns({"contract": contract, "feature": feature, "test": test, "test_anchor": test_anchor,
        "next_shared": next_shared, "shared": shared, "ext_name": ext_name, "supporting": supporting,
        "specific": specific, "own": own, "whole": whole, "folder": folder}))
    test, test_anchor, next_shared, shared, ext_name, supporting, specific, own, whole, folder = map(F.col, ("test",
        "test_anchor", "next_shared", "shared", "ext_name", "supporting", "specific", "own", "whole", "folder"))
    kind = F.when(test, F.lit("test")).when(F.col("contract").isNotNull() | shared, F.lit("support")).when(F.col(
        "i_ext") > 0, F.lit("external")).when(F.col("feature") > 0, F.lit("feature")).when(supporting, F.when(own,
        F.lit("support")).otherwise(F.lit("unknown"))).when(own | (specific & ~whole.isin(GENERIC_NAMES)), F.lit(
        "responsibility")).otherwise(F.lit("unknown"))
    d = settled(d.withColumn("kind", kind))
    name = F.when(test, F.lit("tests")).when(F.col("contract").isNotNull(), F.lit("shared-contracts")).when(F.col(
        "kind") == "unknown", F.lit("unknown")).when(shared, F.concat(F.lit("shared-"),
        X.kebab(next_shared))).when(F.col("kind") == "external", ext_name).when(F.col("kind") == "feature",
        X.kebab(F.element_at("parts", F.greatest(F.col("feature"), F.lit(1))))).when(own, F.col(
        "stem")).otherwise(whole)
    anchor = F.when(test, test_anchor).when(F.col("contract").isNotNull(), head(F.col("contract"))).when((F.col(
        "kind") == "support") & shared, head(F.col("i_shared") + 1)).when(F.col("kind") == "external",
        F.array_join(F.slice("parts", F.greatest(F.col("i_ext"), F.lit(1)), 2), "/")).when(F.col("kind") == "feature",
        head(F.col("feature"))).when(F.col("kind").isin("responsibility", "unknown"), folder)
    d = settled(d.withColumns({"name": name, "anchor": F.nullif(anchor, F.lit(""))}))
    a = F.coalesce("anchor", F.lit(""))
    key = F.when(F.col("kind") == "test", F.concat(F.lit("tests:"), a)).when(F.col("kind") == "support", F.concat(F.lit(
        "support:"), F.coalesce("anchor", "name"))).when(F.col("kind") == "external", F.concat(F.lit("external:"),
        "name")).when(F.col("kind") == "feature", F.concat(F.lit("feature:"), a)).when(F.col("kind") ==
        "responsibility", F.concat(F.lit("responsibility:"), a, F.lit(":"), "name")).otherwise(F.concat(F.lit(
        "unknown:"), F.coalesce("anchor", "path")))
    return d.select(*files.columns, "kind", "name", "anchor", key.alias("key"))


def confirmed_between(relations: DataFrame, files: DataFrame) -> DataFrame:
    """Confirmed relations of the kinds that bind files, with both ends among files."""
    known = files.select("file").distinct()
    own = relations.where(F.col("confidence").eqNullSafe("confirmed") & F.col("kind").isin(KINDS)).select(F.col("kind")
        .alias("relation"), "source_file", "target_file").distinct()
    return own.join(known.withColumnRenamed("file", "source_file"), "source_file",
        "left_semi").join(known.withColumnRenamed("file", "target_file"), "target_file", "left_semi")


def _sides(between: DataFrame, seeded: DataFrame) -> DataFrame:
    s = seeded.select(F.col("file").alias("source_file"), *[F.col(c).alias(f"s_{c}") for c in ("kind", "name", "key",
        "scope")])
    t = seeded.select(F.col("file").alias("target_file"), *[F.col(c).alias(f"t_{c}") for c in ("kind", "name", "key",
        "scope")])
    return between.join(s, "source_file").join(t, "target_file").where("s_scope = t_scope")


def shared_support(seeded: DataFrame, between: DataFrame, least: int = 3) -> DataFrame:
    """Support files without a folder of their own that at least `least` domains use (file, domains)."""
    sides = _sides(between, seeded).where("t_kind = 'support' and s_kind in ('feature', 'responsibility')")
    used = sides.groupBy(F.col("target_file").alias("file")).agg(F.countDistinct("s_key").alias("domains")).where(F.col(
        "domains") >= least)
    return used.join(seeded.where("anchor is null and name <> 'shared-contracts'").select("file"), "file", "left_semi")


def _merge_alone(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the lone files of a scope in the order of their groups: the one group that uses each, if it is named after a file of that group.  Earlier moves count."""
    moved: dict[str, str] = {}
    out = []
    ordered = pdf.sort_values(["key", "source_file"])
    rows = zip(*(ordered[c] for c in ("key", "file", "name", "source_file", "s_key", "s_name")))
    for key, users in groupby(rows, key=lambda r: r[0]):
        names: dict[str, tuple] = {}
        for _, file, name, source, group, s_name in users:
            group = moved.get(source, group)
            if group != key:
                names[group] = min(names.get(group, (len(s_name), source, s_name)), (len(s_name), source, s_name))
        if len(names) > 1:
            out.append((file, None, True))
        elif names:
            ((group, (_, _, s_name)),) = names.items()
            if name.startswith(f"{s_name}-"):
                moved[file] = group
                out.append((file, group, False))
    return pd.DataFrame(out, columns=["file", "joined", "ambiguous"])


def merge_alone(near: DataFrame, most_rounds: int = 20) -> DataFrame:
    """What _merge_alone finds (file, joined, ambiguous), by joins: near(scope, key, file, name, source_file, s_key, s_name) are lone files and their users.

    A lone file waits for those users alone that may move before it: lone ones of a smaller key that are named after one of their users.  Each round decides
    what waits for nothing any more, or is used by two groups already.  Only what still waits after most_rounds, in long chains of such files, is left to Python groups."""
    named = lambda s_name: F.startswith("name", F.concat(s_name, F.lit("-")))
    near = settled(near.select("scope", "key", "file", "name", "source_file", "s_key", "s_name").distinct())
    movable = near.where(named("s_name")).select("scope", F.col("file").alias("source_file"), F.col("key").alias("before")).distinct()
    waits = F.coalesce(F.col("before") < F.col("key"), F.lit(False))
    pending = settled(near.join(movable, ["scope", "source_file"], "left").withColumn("waits", waits).drop("before"))
    other = F.when(~F.col("waits") & (F.col("s_key") != F.col("key")), F.col("s_key"))
    user = F.when(other.isNotNull(), F.struct(F.length("s_name").alias("n"), "source_file", "s_name"))
    out = []
    for _ in range(most_rounds):
        each = pending.groupBy("scope", "key", "file", "name").agg(F.min(other).alias("one"), F.max(other).alias("two"), F.min(user).alias("user"), F.bool_or("waits").alias("waits"))
        several = F.coalesce(F.col("one") != F.col("two"), F.lit(False))
        ready = each.where(several | ~F.col("waits")).select("scope", "key", "file", F.when(~several & named(F.col("user.s_name")), F.col("one")).alias("joined"), several.alias("ambiguous"))
        ready = settled(ready)
        out.append(ready.where("joined is not null or ambiguous").select("file", "joined", "ambiguous"))
        left = pending.join(ready.select("scope", "key"), ["scope", "key"], "left_anti")
        moved = ready.select("scope", F.col("file").alias("source_file"), F.col("joined").alias("moved"), F.lit(True).alias("decided"))
        now = F.col("waits") & F.coalesce("decided", F.lit(False))
        pending = settled(left.join(moved, ["scope", "source_file"], "left").withColumns({"s_key": F.when(now, F.coalesce("moved", "s_key")).otherwise(F.col("s_key")), "waits": F.col("waits") & ~now}).drop("moved",
            "decided"))
        if pending.isEmpty():
            break
    else:
        out.append(pending.groupBy("scope").applyInPandas(_merge_alone, "file string, joined string, ambiguous boolean"))
    return reduce(DataFrame.unionByName, out)


def clusters(files: DataFrame, relations: DataFrame) -> DataFrame:
    """files(file, scope) with kind, name, key, and the group that each file ends up in; ambiguous says that several groups were as near."""
    seeded = settled(seeds(files))
    between = settled(confirmed_between(relations, files))
    shared = shared_support(seeded, between).select("file", F.lit("shared:utilities").alias("g1"))
    step = seeded.join(shared, "file", "left").withColumn("grp", F.coalesce("g1", "key")).drop("g1")
    step = settled(step)

    # named support files beside the one responsibility they are named after
    prefix = F.split_part("name", F.lit("-"), F.lit(1))
    homes = step.where("kind = 'responsibility'").groupBy("scope", "name").agg(F.countDistinct("grp").alias("n"), F.min(
        "grp").alias("home")).where("n = 1").select("scope", F.col("name").alias("prefix"), "home")
    named = step.where("kind = 'support' and anchor is null and grp <> 'shared:utilities'").withColumn("prefix",
        prefix).where((F.col("prefix") != F.col("name")) & ~F.col("prefix").isin(GENERIC_NAMES)).join(homes, ["scope",
        "prefix"]).select("file", "home")
    calls = between.where("relation in ('call', 'render')")
    ends = calls.select(F.col("source_file").alias("file"), F.col("target_file").alias(
        "other")).union(calls.select(F.col("target_file").alias("file"), F.col("source_file").alias("other")))
    met = ends.join(step.select(F.col("file").alias("other"), F.col("grp").alias("other_grp")), "other").join(named,
        "file").where("other_grp = home").select("file", "home").distinct()
    step = settled(step.join(met, "file", "left").withColumn("grp", F.coalesce("home", "grp")).drop("home"))

    # lone responsibilities
    alone = step.groupBy("scope", "grp").agg(F.count("*").alias("n"), F.min("file").alias("file")).where(
        "n = 1").select("file")
    lone = step.where((F.col("kind") == "responsibility") & X.boundary_priority(F.col("file")).isNull()).join(alone,
        "file", "left_semi").select("scope", "file", "name", F.col("grp").alias("key"))
    users = step.where("kind in ('feature', 'responsibility')").select(F.col("file").alias("source_file"), F.col("grp")
        .alias("s_key"), F.col("name").alias("s_name"), F.col("scope").alias("s_scope"))
    near = between.withColumnRenamed("target_file", "file").join(lone, "file").join(users, "source_file").where(
        "scope = s_scope")
    joined = merge_alone(near)
    step = settled(step.join(joined, "file", "left").withColumns({"grp": F.coalesce("joined", "grp"),
        "ambiguous": F.coalesce("ambiguous", F.lit(False))}).drop("joined"))

    # unknown files beside one group
    around = between.select(F.col("source_file").alias("file"), F.col("target_file").alias(
        "other")).union(between.select(F.col("target_file").alias("file"), F.col("source_file").alias("other")))
    groups = step.where("kind not in ('unknown', 'support', 'test')").select(F.col("file").alias("other"), F.col("grp")
        .alias("other_grp"), F.col("scope").alias("other_scope"))
    unknown = step.where("kind = 'unknown'").select("file", "scope")
    beside = around.join(unknown, "file").join(groups, "other").where("scope = other_scope").groupBy(
        "file").agg(F.countDistinct("other_grp").alias("n"), F.min("other_grp").alias("beside"))
    step = step.join(beside, "file", "left").withColumns({"grp": F.when(F.col("n") == 1, F.col("beside"))
        .otherwise(F.col("grp")), "ambiguous": F.col("ambiguous") | F.coalesce(F.col("n") > 1, F.lit(False))})
    return settled(step.select("file", "scope", "kind", "name", "anchor", "key", F.col("grp").alias("cluster"),
        "ambiguous"))


def categories(clustered: DataFrame) -> DataFrame:
    """Category of each cluster: by kind, else by what most of its files are."""
    signals = settled(clustered.withColumn("signals", X.role_signals(F.col("file"), F.col("kind"))))
    files = signals.withColumn("category", X.category_of_signals(F.col("signals")))
    by_files = majority(files, "cluster", "category", X.mapped(F.col("category"), {k: str(v) for k, v in RANKS.items()})
        .cast("int")).select("cluster", F.col("category").alias("most"))
    heads = clustered.groupBy("cluster").agg(F.min_by("kind", F.struct(F.col("key") != F.col("cluster"), F.col("file")))
        .alias("kind"), F.bool_or(F.col("anchor").isNotNull() | (F.col("name") == "shared-contracts")).alias(
        "anchored"), F.count("*").alias("files"))
    kind = F.when(F.col("cluster") == "shared:utilities", F.lit("shared")).otherwise(F.col("kind"))
    fixed = X.mapped(kind, {"test": "test-surface", "external": "external-integration", "shared": "shared-utility",
        "unknown": "unknown"})
    support = F.when(kind == "support", F.when(F.col("anchored"), F.lit("shared-utility")).otherwise(F.lit(
        "domain-service")))
    return heads.join(by_files, "cluster").select("cluster", F.coalesce(fixed, support, "most").alias("category"),
        "files")


def diagnostics(clustered: DataFrame, categorised: DataFrame, previous: DataFrame) -> DataFrame:
    """What a reader should look at, one row a finding: (code, subject, n)."""
    lineage = clustered.select("file", "cluster").join(previous.select("file", F.col("module").alias("previous")),
        "file").select("cluster", "previous").distinct()
    several = lambda by, of: lineage.groupBy(by).agg(F.countDistinct(of).alias("n")).where("n > 1")
    signals = clustered.select("file", F.size(X.role_signals(F.col("file"), F.col("kind"))).alias("n")).where("n > 1")
    parts = [
        categorised.where("category = 'unknown'").select(F.lit("unknown-files").alias("code"), F.col("cluster").alias(
            "subject"), F.col("files").alias("n")),
        categorised.where(F.col("files") > MOST_FILES).select(F.lit("oversized-module").alias("code"), F.col("cluster")
            .alias("subject"), F.col("files").alias("n")),
        several("cluster", "previous").select(F.lit("lineage-merge").alias("code"), F.col("cluster").alias("subject"),
            "n"),
        several("previous", "cluster").select(F.lit("lineage-split").alias("code"), F.col("previous").alias("subject"),
            "n"),
        clustered.where("ambiguous").select(F.lit("ambiguous-ownership").alias("code"), F.col("file").alias("subject"),
            F.lit(1).cast("long").alias("n")),
        signals.select(F.lit("mixed-role-signals").alias("code"), F.col("file").alias("subject"), F.col("n").cast(
            "long").alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def areas(modules: DataFrame, links: DataFrame, components) -> DataFrame:
    """Areas of modules(module, scope, category, label, strong) with confirmed links(source, target): modules of one label that hang together are an area, if one of them is
    strong or there are two; others stand alone by category.  components is the operator that finds what hangs together."""
    open_ = modules.where("label is not null and category not in ('shared-utility', 'test-surface', "
        "'external-integration')")
    a, b = open_.select(F.col("module").alias("source"), F.col("scope").alias("s1"), F.col("label").alias(
        "l1")), open_.select(F.col("module").alias("target"), F.col("scope").alias("s2"), F.col("label").alias("l2"))
    inside = links.join(a, "source").join(b, "target").where("s1 = s2 and l1 = l2").select("source",
        "target").distinct()
    parts = components(open_.select(F.col("module").alias("id")), inside).withColumnRenamed("id", "module")
    placed = open_.join(parts, "module")
    sums = placed.groupBy("component").agg(F.bool_or("strong").alias("any_strong"), F.count("*").alias("n"),
        set_hash(F.col("module")).alias("h")).where("any_strong or n >= 2")
    grouped = placed.join(sums, "component").select("module", F.concat(F.lit("group:function:"), "scope", F.lit(":"),
        "label", F.when(F.col("any_strong"), F.lit("")).otherwise(F.concat(F.lit(":"), F.substring("h", 1, 12)))).alias(
        "area"))
    users = links.join(grouped.select(F.col("module").alias("source"), F.col("area").alias("user_area")),
        "source").groupBy(F.col("target").alias("module")).agg(F.countDistinct("user_area").alias("users"))
    rest = modules.join(grouped.select("module"), "module", "left_anti").join(users, "module", "left")
    prefix = F.when(F.col("category") == "shared-utility", F.when(F.col("users") > 1, F.lit("infrastructure"))
        .otherwise(F.lit("support"))).when(F.col("category") == "test-surface", F.lit("tests")).when(F.col(
        "category") == "external-integration", F.lit("integration")).otherwise(F.lit("review"))
    alone = rest.select("module", F.concat_ws(":", F.lit("group"), prefix, "scope", "module").alias("area"))
    return grouped.unionByName(alone)

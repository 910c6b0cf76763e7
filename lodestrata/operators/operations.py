"""What source files do outside of themselves: HTTP, files, processes and databases, by the API that a call is bound to and by its arguments.

A call counts by what it is bound to, whatever it is called: a shadowed name or a method of one's own is no operation.  Its target is a constant: a text, or a
name that every value which reaches it sets to one text.  Names are propagated over their settings until nothing changes, in a lattice of three: unknown (a
setting that is no text), a text, conflict (two texts).  What a factory was given (a path, an address, a method) stays with the object that it made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexers
from .binding import Binder
from .clustering import settled

# APIs: kind, operation (null: it depends on the name or the statement), modules, names.
WEB = "get post put patch delete head options request Get Post PostForm Head Do".split()
APIS = [
    ("http", "invoke", ["requests", "httpx", "net/http"], WEB),
    ("http", "invoke", ["java.net.http.HttpClient"], ["send", "sendAsync"]),
    ("http", "invoke", ["urllib.request"], ["urlopen"]),
    ("http", "invoke", ["http.client"], ["request"]),
    ("http", "invoke", ["global", "undici"], ["fetch"]),
    ("http", "invoke", ["axios"], ["default", "get", "post", "put", "patch", "delete", "head", "options", "request"]),
    ("filesystem", None, ["builtins"], ["open"]),
    ("filesystem", None, ["pathlib"], "read_text read_bytes write_text write_bytes open unlink mkdir".split()),
    ("filesystem", None, ["java.nio.file.Files"], "readString readAllBytes readAllLines newInputStream write writeString newOutputStream delete deleteIfExists createFile createDirectory".split()),
    ("filesystem", None, ["os"], "ReadFile Open WriteFile Create Remove Mkdir MkdirAll".split()),
    ("filesystem", None, ["fs", "fs/promises"], ("readFile readFileSync readdir readdirSync stat statSync access accessSync createReadStream writeFile writeFileSync appendFile appendFileSync mkdir mkdirSync "
        "unlink unlinkSync rm rmSync createWriteStream").split()),
    ("process", "invoke", ["subprocess"], "run Popen call check_call check_output".split()),
    ("process", "invoke", ["os/exec"], "Run Start Output CombinedOutput".split()),
    ("process", "invoke", ["java.lang.ProcessBuilder"], ["start"]),
    ("process", "invoke", ["child_process"], "exec execSync execFile execFileSync spawn spawnSync fork".split()),
    ("database", None, ["sqlite3"], "execute executemany executescript run all get exec".split()),
    ("database", None, ["better-sqlite3", "pg"], "exec run all get query".split()),
    ("database", "read", ["database/sql"], "Query QueryContext QueryRow QueryRowContext".split()),
    ("database", "write", ["database/sql"], "Exec ExecContext".split()),
    ("database", "read", ["java.sql.DriverManager", "java.sql.Connection", "java.sql.Statement", "java.sql.PreparedStatement"], ["executeQuery"]),
    ("database", "write", ["java.sql.DriverManager", "java.sql.Connection", "java.sql.Statement", "java.sql.PreparedStatement"], ["executeUpdate"]),
    ("database", None, ["java.sql.DriverManager", "java.sql.Connection", "java.sql.Statement", "java.sql.PreparedStatement"], ["execute"]),
]
WRITES = r"^(write|Write|append|Create|create|delete|Remove|rm|unlink|mkdir|Mkdir|newOutput)"
SELECTS, CHANGES = ["SELECT", "WITH", "PRAGMA"], ["INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "REPLACE"]
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def arguments(b: Binder) -> DataFrame:
    """Of each called bracket: path, open (its i), n (position), key (of a keyword), text (if it is a constant text or number), node (if it is a name or chain)."""
    w = b.facts.words
    inside = w.where("parent >= 0").join(b.facts.calls.select("path", F.col("i").alias("parent")), ["path", "parent"], "left_semi")
    order = Window.partitionBy("path", "parent").orderBy("i")
    inside = inside.withColumn("n", F.sum((F.col("text") == ",").cast("int")).over(order)).where("text <> ','")
    named = (F.col("language") == "python") & (F.col("kind") == "name") & (F.col("n1") == "=")
    one = inside.groupBy("path", "parent", "n").agg(F.min(F.struct("i", "text", "kind", named.alias("named"))).alias("a"), F.min_by("n2_i", "i").alias("behind"), F.max("chain").alias("last_chain"), F.max(
        "i").alias("last_i"))
    one = one.select("path", F.col("parent").alias("open"), F.col("n").cast("int").alias("n"), F.when(F.col("a.named"), F.col("a.text")).alias("key"), F.when(F.col("a.named"), F.col("behind")).otherwise(F.col("a.i"))
        .alias("i"), "last_chain", "last_i")
    word = w.select("path", "i", F.col("text").alias("word"), F.col("kind").alias("word_kind"))
    alone = F.col("i") == F.col("last_i")
    text = F.when(alone & (F.col("word_kind") == "string"), lexers.literal(F.col("word"))).when(alone & (F.col("word_kind") == "number"), F.col("word"))
    ends = b.facts.chains.groupBy("path", "chain").agg(F.max("k").alias("last"))
    # a list's first item counts for the list
    first = w.where("text = '[' and kind = 'open'").select("path", "i", (F.col("i") + 1).alias("next_i"))
    item = w.where("kind = 'string'").select("path", F.col("i").alias("next_i"), lexers.literal(F.col("text")).alias("item"))
    listed = first.join(item, ["path", "next_i"]).select("path", "i", "item")
    both = one.join(word, ["path", "i"], "left").join(listed, ["path", "i"], "left").join(ends.withColumnRenamed("chain", "i"), ["path", "i"], "left")
    whole = F.col("last_chain") == F.col("i")
    return both.select("path", "open", "n", "key", F.coalesce(text, "item").alias("text"), F.when(whole & F.col("last").isNotNull(), F.concat_ws(":", "path", F.col("i").cast("string"), F.col("last").cast(
        "string"))).alias("node"))


def constants(b: Binder) -> DataFrame:
    """The one text that each name stands for where it is used: (node, text).  A fixpoint over settings."""
    w = b.facts.words.select("path", F.col("i").alias("value"), F.col("kind").alias("word_kind"), F.col("text").alias("word"))
    ends = b.facts.chains.groupBy("path", "chain").agg(F.max("k").alias("last"))
    s = b.settings.join(w, ["path", "value"], "left").join(ends.withColumnRenamed("chain", "value"), ["path", "value"], "left")
    s = settled(s.select("node", F.when(F.col("word_kind") == "string", lexers.literal(F.col("word"))).alias("text"), F.when(F.col("last") == 0, F.concat_ws(":", "path", F.col("value").cast("string"), F.lit("0"))).alias(
        "dep")))
    alias = s.where("dep is not null").select("node", "dep")
    known = delta = settled(s.where("text is not null").select("node", "text").distinct())
    unclear = fresh = settled(s.where("text is null and dep is null").select("node").unionByName(alias.join(s.select(F.col("node").alias("dep")).distinct(), "dep", "left_anti").select("node")).distinct())
    while not (delta.isEmpty() and fresh.isEmpty()):
        delta = settled(alias.join(delta.withColumnRenamed("node", "dep"), "dep").select("node", "text").distinct().join(known, ["node", "text"], "left_anti"))
        fresh = settled(alias.join(fresh.withColumnRenamed("node", "dep"), "dep").select("node").distinct().join(unclear, "node", "left_anti"))
        known, unclear = known.unionByName(delta), unclear.unionByName(fresh)
    return settled(known.groupBy("node").agg(F.count("*").alias("n"), F.min("text").alias("text")).where("n = 1").join(unclear.distinct(), "node", "left_anti").select("node", "text"))


def carried(b: Binder, seeds: DataFrame) -> DataFrame:
    """seeds(node, text) and what they go on to: members of, calls on and names for what they are of, unless these have one of their own."""
    on = b.waits.where("op in ('alias', 'member', 'call')").select("node", "dep")
    known = delta = settled(seeds.groupBy("node").agg(F.min("text").alias("text")))
    while not delta.isEmpty():
        delta = settled(on.join(delta.withColumnRenamed("node", "dep"), "dep").groupBy("node").agg(F.min("text").alias("text")).join(known.select("node"), "node", "left_anti"))
        known = known.unionByName(delta)
    return settled(known)


def operations(files: DataFrame, scopes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """path, line, column, module, api, kind, operation (read, write, invoke), method (HTTP), target (null: not known), confidence."""
    b = Binder(files, scopes, links)
    found = b.identities()
    args, names = settled(arguments(b)), constants(b)
    args = settled(args.join(names.withColumnRenamed("text", "constant"), "node", "left").withColumn("text", F.coalesce("text", "constant")).drop("constant"))
    node = lambda k: F.concat_ws(":", "path", F.col("chain").cast("string"), k.cast("string"))
    calls = b.facts.calls.select("path", "language", "chain", "k", F.col("i").alias("open"), node(F.col("k")).alias("made"), node(F.col("k") - 1).alias("node"))
    outside = settled(calls.join(found.where("kind = 'external'").select("node", "members"), "node"))
    outside = outside.withColumn("module", F.regexp_replace(F.col("members")[0], "^node:", "")).withColumn("api", F.when(F.size("members") > 1, F.element_at("members", -1)).otherwise(F.regexp_extract(F.col("members")[0],
        r"([^./]+)$", 1)))
    positional = args.where("key is null").select("path", "open", "n", "text", F.col("node").alias("arg_node"))
    at = lambda n, name: positional.where(F.col("n") == n).select("path", "open", F.col("text").alias(name), F.col("arg_node").alias(f"{name}_node"))
    keyed = args.where("key is not null").groupBy("path", "open").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("text", "node").alias("v")))).alias("keys"))
    whole = outside.join(at(0, "a0"), ["path", "open"], "left").join(at(1, "a1"), ["path", "open"], "left").join(at(2, "a2"), ["path", "open"], "left").join(keyed, ["path", "open"], "left")
    key = lambda name: F.try_element_at("keys", F.lit(name))
    nth = F.when((F.col("module") == "database/sql") & ((F.col("api") == "Open") | F.endswith("api", F.lit("Context"))) | (F.col("module") == "os/exec") & (F.col("api") == "CommandContext") | (F.col("module") == "net/http") & (F.col(
        "api") == "NewRequest") | (F.col("module") == "http.client") & (F.col("api") == "request"), 1).when((F.col("module") == "net/http") & (F.col("api") == "NewRequestWithContext"), 2).otherwise(0)
    said = F.when(nth == 1, F.col("a1")).when(nth == 2, F.col("a2")).otherwise(F.col("a0"))
    said_node = F.when(nth == 1, F.col("a1_node")).when(nth == 2, F.col("a2_node")).otherwise(F.col("a0_node"))
    whole = whole.withColumn("said", F.coalesce(said, key("url")["text"])).withColumn("said_node", F.coalesce(said_node, key("url")["node"]))
    host, port = F.coalesce("a0", key("host")["text"]), F.coalesce("a1", F.lit(""))
    origin = F.concat(F.when(F.col("api") == "HTTPSConnection", "https://").otherwise("http://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))
    connection = (F.col("module") == "sqlite3") & F.col("api").isin("connect", "Database") | (F.col("module") == "database/sql") & (F.col("api") == "Open") | (F.col("api") == "getConnection")
    whole = settled(whole.withColumn("given", F.when(connection, None).when(F.col("module") == "http.client", F.when(F.col("api").isin("HTTPConnection", "HTTPSConnection"), origin)).otherwise(F.col("said"))))
    targets = carried(b, whole.where("given is not null").select(F.col("made").alias("node"), F.col("given").alias("text")))
    verb = F.upper(F.coalesce(key("method")["text"], F.when(F.startswith("api", F.lit("NewRequest")), F.when(F.col("api") == "NewRequest", F.col("a0")).otherwise(F.col("a1"))), F.when(F.col("module") ==
        "java.net.http.HttpRequest", F.col("api"))))
    methods = carried(b, whole.where(verb.isin(METHODS)).select(F.col("made").alias("node"), verb.alias("text")))
    rules = reduce(lambda rest, r: F.when(F.col("module").isin(r[2]) & F.col("api").isin(r[3]), F.struct(F.lit(r[0]).alias("kind"), F.lit(r[1]).cast("string").alias("operation"))).otherwise(rest), reversed(APIS), F.lit(
        None).cast("struct<kind:string,operation:string>"))
    hits = whole.withColumn("rule", rules).where("rule is not null")
    of = lambda t, c, name: t.select(F.col("node").alias(c), F.col("text").alias(name))
    hits = hits.join(of(targets, "node", "own_target"), "node", "left").join(of(targets, "said_node", "arg_target"), "said_node", "left").join(of(methods, "node", "own_method"), "node", "left").join(of(methods,
        "said_node", "arg_method"), "said_node", "left")
    argued = F.coalesce("said", "arg_target")
    client = F.when(argued.rlike("^https?://"), argued).when(F.startswith(argued, F.lit("/")), F.concat("own_target", argued))
    target = F.when(F.col("module") == "http.client", client).otherwise(F.coalesce(argued, "own_target"))
    kind = F.col("rule.kind")
    spoken = F.when(F.upper("api").isin(METHODS), F.upper("api"))
    method = F.when(kind == "http", F.coalesce(F.when(F.col("module") == "http.client", F.when(F.upper("a0").isin(METHODS), F.upper("a0"))), spoken, F.when(verb.isin(METHODS), verb), "arg_method", "own_method", F.when(
        F.col("api").isin("urlopen", "fetch") & F.col("a1").isNull() & F.col("a1_node").isNull() & key("data").isNull(), F.lit("GET")), F.lit("UNKNOWN")))
    statement = F.upper(F.regexp_extract(F.coalesce(target, F.lit("")), r"^\s*(\w+)", 1))
    opened = (F.col("module") == "builtins") & F.coalesce("a1", key("mode")["text"]).rlike("[wax+]")
    operation = F.coalesce(F.col("rule.operation"), F.when(kind == "filesystem", F.when(F.coalesce(opened, F.lit(False)) | F.col("api").rlike(WRITES), "write").otherwise("read")), F.when(statement.isin(SELECTS), "read").when(
        statement.isin(CHANGES), "write").when(F.col("api").isin("executemany", "executescript"), "write").otherwise("invoke"))
    place = b.facts.chains.where("k = 0").select("path", "chain", "line", "column")
    return hits.join(place, ["path", "chain"]).select("path", "line", "column", "module", "api", kind.alias("kind"), operation.alias("operation"), method.alias("method"), target.alias("target"), F.when(target.isNotNull(),
        "confirmed").otherwise("inferred").alias("confidence"))

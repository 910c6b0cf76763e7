"""Queries of sources, scalar functions, filters and distinct rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import dedupe, extraction, graph, measures, sequences, views
from ..sources import bridge as B
from ..sources import configs
from ..sources import files as S
from ..sources import sinks
from .registry import query

_EXT = "lower(regexp_extract(path, '[^./][^/]*?(\\.[^./]+)$', 1))"
_EXTS = {".ts": "TypeScript", ".tsx": "TypeScript React", ".py": "Python", ".go": "Go", ".java": "Java", ".rs": "Rust"}
_ALL = _EXTS | {".json": "JSON", ".md": "Markdown", ".sql": "SQL"}
_case = lambda values: "CASE " + _EXT + "".join(f" WHEN '{k}' THEN '{v}'" for k,
    v in values.items()) + " END"
_TEST = "(regexp_matches('/' || lower(path) || '/', '/(test|tests|__tests__)/') OR regexp_matches(lower(path), '\\.(test|spec)\\.[^.]+$|_test\\.go$'))"
_NAME = "regexp_extract(path, '[^/]*$')"
_KEBAB = lambda x: f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_WORDS = _KEBAB(f"regexp_replace(regexp_replace({_NAME}, '\\.[^.]+$', ''), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')")
_ROLE = "|".join(sorted(X.RESPONSIBILITY_SUFFIXES, key=lambda w: (-len(w), w)))


@query("s1_scan_ignored", B.with_views("SELECT path, size FROM b_files WHERE NOT regexp_matches(path, "
    "'(^|/)(dist|build|logs)/') AND NOT regexp_matches(path, 'secret')", "files"))
def _(spark, d):
    return B.files(spark, d).where(~S.ignored()).select("path", "size")


@query("s3_selected_files", B.with_views("SELECT path, CASE WHEN path LIKE '%tests%' THEN 'changed' END AS problem "
    "FROM b_files WHERE doc_id % 3 = 0", "files"))
def _(spark, d):
    f = B.files(spark, d)
    wanted = f.where("doc_id % 3 = 0").select("path", F.when(F.col("path").contains("tests"), F.lit("other"))
        .otherwise(F.col("hash")).alias("hash"))
    return S.selected(f, wanted)


@query("s6_code_files", B.with_views(
    f"SELECT path, {_case(_EXTS)} AS language, CASE WHEN size > 220000 THEN 'failed' ELSE 'parsed' END AS status FROM b_files WHERE {_case(_EXTS)} IS NOT NULL", "files"))
def _(spark, d):
    return extraction.readable(B.files(spark, d).select("path", "size")).select("path", "language", "status")


@query("s8_representative", B.with_views(
    "SELECT path, points, size FROM (SELECT path, size, CAST(3 * (size % 11) + 2 * (size % 7) + 5 * (size % 3) + size % 5 + CASE WHEN regexp_matches(lower(path), '(^|/)(main|index|app|server|bootstrap)[.][^.]+$') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(lower(path), 'ipc|controller|service|worker|gateway|adapter|repository|store|dispatcher|scheduler') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(lower(path), 'test|spec|fixture|example|generated') THEN 20 ELSE 0 END AS BIGINT) AS points FROM b_files) ORDER BY points DESC, path LIMIT 40", "files"))
def _(spark, d):
    counted = B.files(spark, d).select("path", "size", *[F.pmod("size", F.lit(m)).alias(c) for c, m in (("n_symbols", 11), ("n_calls", 7), ("n_external", 3), ("n_imports", 5))])
    return extraction.representative(counted, 40).select("path", "points", "size")


@query("s15_changes_parsed", "SELECT 'src/f' || doc_id || '.ts' AS path, ['modified', 'added', 'deleted', 'untracked', "
    "'renamed'][doc_id % 5 + 1] AS status FROM documents")
def _(spark, d):
    code = F.element_at(F.array(*map(F.lit, [" M", "A ", " D", "??", "R "])), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("src/f"), "doc_id", F.lit(".ts"))
    lines = B.table(spark, d, "documents").select(F.concat(code, F.lit(" "), F.when(F.col("doc_id") % 5 == 4,
        F.concat(F.lit("old.ts -> "), name)).otherwise(name)).alias("line"))
    return S.porcelain(lines)


@query("s16_runs", "SELECT 'run-' || event_id AS run_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE epoch_us(ts) // 1000 "
    "END AS at FROM events WHERE event_id % 6 <> 0")
def _(spark, d):
    e = B.table(spark, d, "events").select(F.concat(F.when(F.col("event_id") % 6 == 0, F.lit("../")).otherwise(F.lit(
        "run-")), "event_id").alias("run_id"), F.when(F.col("event_id") % 4 == 0, F.lit("never"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("finished"))
    return S.runs(e).select("run_id", "at")


@query("k3_canvas_problems", B.with_views(", n AS (SELECT id FROM b_nodes WHERE id NOT LIKE 'customer/1%'), e AS "
    "(SELECT * FROM b_edges) SELECT 'unknown-end' AS problem, id AS subject FROM e WHERE source NOT IN (SELECT id FROM "
    "n) OR target NOT IN (SELECT id FROM n)", "nodes", "edges"))
def _(spark, d):
    return sinks.canvas_problems(B.nodes(spark, d).where("id not like 'customer/1%'"), B.edges(spark, d),
        B.module_files(spark, d))


@query("k6_history_kept", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY "
    "user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def _(spark, d):
    return sinks.latest(B.table(spark, d, "events"), ["user_id"], "ts", "event_id", 5).select("user_id", "event_id")


@query("k7_exports", B.with_views("SELECT id AS title, '## ' || id || chr(10) || '- layer: ' || layer || chr(10) || '- "
    "origin: ' || coalesce(origin, 'none') AS markdown FROM b_nodes", "nodes"))
def _(spark, d):
    return sinks.as_markdown(B.nodes(spark, d), "id", ["layer", "origin"])


@query("k8_event_log", "SELECT conv_id, string_agg(role || ': ' || turn, chr(10) ORDER BY turn) AS text, count(*) AS n "
    "FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = B.table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "turn").alias("line"))
    return sequences.serialized(c, "conv_id", "turn")


@query("e1_analyzer", B.with_views(
    f"SELECT CASE WHEN regexp_matches(path, '\\.(ts|tsx|js|jsx)$') THEN 'typescript' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java' WHEN path LIKE '%.go' THEN 'go' ELSE 'fallback' END AS analyzer, count(*) AS n FROM b_files GROUP BY 1", "files"))
def _(spark, d):
    return B.files(spark, d).groupBy(extraction.analyzer(F.col("path")).alias("analyzer")).agg(F.count("*").alias("n"))


_CALLS = ["fetch", "axios.get", "db.users.find", "prisma.user.create", "fs.readFileSync", "readFile", "spawn",
    "execFile", "events.publish", "taskQueue", "prefetchX", "queryBuilder", "https.get", "render", "job.enqueue"]
_DOES = ["http", "http", "database", "database", "filesystem", "filesystem", "process", "process", "queue", "queue",
    None, None, "http", None, "queue"]


def _code_of_pages(spark, d):
    """A source file a page, which requests the page and serves its host."""
    p = B.table(spark, d, "pages").select("page_id", X.url_path(F.col("url")).alias("at"))
    spoken = F.element_at(F.array(*map(F.lit, ["fetch(`{}?x=1`)", "Axios.post('{}')", "router.PUT(\"{}\", f)",
        "@bp.delete('{}')", "@PatchMapping(value = \"{}\")", "g.POST(\"{}\", h)", "other.get({})"])), (F.col(
        "page_id") % 7 + 1).cast("int"))
    return p.select(F.concat(F.lit("f"), "page_id", F.lit(".ts")).alias("path"), F.concat(F.replace(spoken, F.lit("{}"),
        F.col("at")), F.lit("\napp.get('/all/:id')\napp.get('/all/{key}')")).alias("content"))


@query("e5_endpoints", "SELECT 'f' || page_id || '.ts' AS file, kind, method, normal FROM (SELECT page_id, ['request', "
    "'request', 'route', 'route', 'route', 'route'][page_id % 7 + 1] AS kind, ['GET', 'POST', 'PUT', 'DELETE', "
    "'PATCH', 'POST'][page_id % 7 + 1] AS method, '/' || array_to_string(list_filter(string_split(regexp_extract(url, "
    "'(?i)^https?://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> ''), '/') AS normal FROM pages WHERE page_id % 7 < 6) "
    "UNION ALL SELECT 'f' || page_id || '.ts', 'route', 'GET', '/all/:param' FROM pages")
def _(spark, d):
    return extraction.endpoints(_code_of_pages(spark, d)).select("file", "kind", "method", "normal")


@query("e7_external_kind",
    f"SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'http' ELSE [{', '.join('NULL' if x is None else repr(x) for x in _DOES)}][event_id % 15 + 1] END AS external FROM events")
def _(spark, d):
    name = F.element_at(F.array(*map(F.lit, _CALLS)), (F.col("event_id") % 15 + 1).cast("int"))
    literal = F.when(F.col("event_id") % 29 == 0, F.lit("https://x.example/y"))
    return B.table(spark, d, "events").select("event_id", extraction.external_kind(name, literal).alias("external"))


def _python_of_parts(spark, d):
    """A Python file a part: a class with a base, a method that calls, an import; every tenth has an error."""
    k = F.col("p_partkey").cast("string")
    broken = F.when(F.col("p_partkey") % 10 == 0, F.lit("def (:\n")).otherwise(F.lit(""))
    code = F.concat(broken, F.lit("from pkg.m"), k, F.lit(" import a\nclass C"), k, F.lit(
        "(Base):\n    def run(self, x, y):\n        return a.go(x, y)\n"))
    return B.spread(B.table(spark, d, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("p"), k, F.lit(".py")).alias("path"), code.alias("content"))


@query("e10_python_facts", "SELECT 'p' || p_partkey || '.py' AS path, f.fact, f.name, f.scope, f.line, f.arity FROM "
    "part, LATERAL (VALUES ('import', 'pkg.m' || p_partkey || '.a', '', 1, NULL), ('class', 'C' || p_partkey, '', 2, "
    "NULL), ('inherit', 'Base', 'C' || p_partkey, 2, NULL), ('function', 'run', 'C' || p_partkey, 3, 3), ('call', "
    "'a.go', 'C' || p_partkey || '.run', 4, 2)) f(fact, name, scope, line, arity) WHERE p_partkey % 10 <> 0 UNION ALL "
    "SELECT 'p' || p_partkey || '.py', 'error', 'SyntaxError', '', 1, NULL FROM part WHERE p_partkey % 10 = 0")
def _(spark, d):
    return extraction.python_facts(_python_of_parts(spark, d))


@query("e3_text_facts", "SELECT 'p' || p_partkey || '.py' AS path, 'pkg.m' || p_partkey AS imports, 'C' || p_partkey "
    "|| ',run' AS symbols, 'C' || p_partkey || ',run,a.go' AS calls FROM part WHERE p_partkey % 10 <> 0 UNION ALL "
    "SELECT 'p' || p_partkey || '.py', 'pkg.m' || p_partkey, 'C' || p_partkey || ',run', 'def,C' || p_partkey || "
    "',run,a.go' FROM part WHERE p_partkey % 10 = 0")
def _(spark, d):
    f = extraction.text_facts(_python_of_parts(spark, d))
    return f.select("path", *[F.array_join(c, ",").alias(c) for c in ("imports", "symbols", "calls")])


@query("e6_rendered", "SELECT 's' || s_suppkey AS path, unnest(['App', 'Ui.Row' || s_suppkey]) AS component FROM "
    "supplier")
def _(spark, d):
    k = F.col("s_suppkey").cast("string")
    code = F.concat(F.lit("<App a={1}><div><Ui.Row"), k, F.lit(" /><App></App></div></App>"))
    return extraction.rendered(B.table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("path"), code.alias(
        "content")))


@query("e12_structured", "SELECT event_id AS id, CASE WHEN event_id % 4 <> 3 THEN '{\"id\":' || event_id || '}' END AS "
    "json FROM events")
def _(spark, d):
    k = F.col("event_id").cast("string")
    own = F.concat(F.lit('{"id": '), k, F.lit("}"))
    text = F.element_at(F.array(F.concat(F.lit("so: "), own, F.lit(" ok")), F.concat(F.lit('{"no": 1}\n```json\n'), own,
        F.lit("\n```")), F.concat(F.lit('{"result": "'), F.replace(own, F.lit('"'), F.lit('\\"')), F.lit('"}')), F.lit(
        "{broken")), (F.col("event_id") % 4 + 1).cast("int"))
    return extraction.structured(B.table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("text")),
        "id")


@query("e13_checked", "SELECT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS item, 'unknown' AS problem FROM lineitem "
    "WHERE l_partkey % 9 = 0 GROUP BY ALL UNION ALL SELECT l_orderkey, CAST(l_partkey AS VARCHAR), 'duplicate' FROM "
    "lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    item = F.col("p_partkey").cast("string").alias("item")
    answers = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string")
        .alias("item"))
    return extraction.checked(answers, B.table(spark, d, "part").where("p_partkey % 9 <> 0").select(item))


@query("s15_numstat", "SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END AS additions, "
    "CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_chars END AS deletions FROM documents")
def _(spark, d):
    count = lambda c: F.when(F.col("doc_id") % 5 == 0, F.lit("-")).otherwise(F.col(c).cast("string"))
    return S.numstat(B.table(spark, d, "documents").select(F.concat_ws("\t", count("doc_id"), count("n_chars"),
        F.concat(F.lit("f"), "doc_id")).alias("line")))


@query("s10_packages", "SELECT path, format, name, version, members, dependencies FROM (SELECT c_custkey AS k, 'c' || "
    "k || '/' || ['package.json', 'pyproject.toml', 'go.mod', 'pnpm-workspace.yaml', 'pom.xml', 'tsconfig.json', "
    "'x.ini'][k % 7 + 1] AS path, ['npm', 'python', 'go', 'pnpm', 'maven', 'tsconfig', 'other'][k % 7 + 1] AS format, "
    "['n' || k, 'n' || k, 'example.org/n' || k, NULL, 'n' || k, NULL, NULL][k % 7 + 1] AS name, ['1.' || k, '1.' || k, "
    "NULL, NULL, '1.' || k, NULL, NULL][k % 7 + 1] AS version, ['libs/*', '', './a', 'apps/' || k || ',libs', 'core', "
    "'src', ''][k % 7 + 1] AS members, ['left,right', 'left', 'example.com/m' || k, '', 'left', '../lib', ''][k % 7 + "
    "1] AS dependencies FROM customer)")
def _(spark, d):
    texts = [
        ("package.json", '{"name": "n#", "version": "1.#", "workspaces": ["libs/*"], "dependencies": {"right": "1"}, '
            '"devDependencies": {"left": "2"}}'),
        ("pyproject.toml", '[project]\nname = "n#"\nversion = "1.#"\ndependencies = ["left>=1"]'),
        ("go.mod", "module example.org/n#\n\nrequire example.com/m# v1.2.3\n\nuse ./a\n"),
        ("pnpm-workspace.yaml", "packages:\n  - 'apps/#'\n  - libs\nother: 1\n"),
        ("pom.xml",
            "<project><artifactId>n#</artifactId><version>1.#</version><modules><module>core</module></modules><dependencies><dependency><artifactId>left</artifactId></dependency></dependencies></project>"),
        ("tsconfig.json", '// all\n{"include": ["src",], "references": [{"path": "../lib"}]}'),
        ("x.ini", "a=#"),
    ]
    pick = lambda i: F.element_at(F.array(*[F.lit(t[i]) for t in texts]), (F.col("c_custkey") % 7 + 1).cast(
        "int"))
    k = F.col("c_custkey").cast("string")
    files = B.table(spark, d, "customer").select(F.concat(F.lit("c"), k, F.lit("/"), pick(0)).alias("path"),
        F.replace(pick(1), F.lit("#"), k).alias("content"))
    found = configs.packages(files)
    return found.select("path", "format", "name", "version", F.array_join("members", ",").alias("members"),
        F.array_join("dependencies", ",").alias("dependencies"))


@query("j25_scopes", B.with_views("SELECT DISTINCT 'typescript:' || regexp_replace(path, '/[^/]*$', '') AS scope, "
    "'typescript' AS language, regexp_replace(path, '/[^/]*$', '') AS root FROM b_files WHERE doc_id % 3 = 0 UNION "
    "SELECT 'go:' || regexp_replace(path, '/[^/]*$', ''), 'go', regexp_replace(path, '/[^/]*$', '') FROM b_files WHERE "
    "doc_id % 3 = 1", "files"))
def _(spark, d):
    name = F.element_at(F.array(*map(F.lit, ["/package.json", "/go.mod", "/readme"])), (F.col("doc_id") % 3 + 1).cast(
        "int"))
    return configs.scopes(B.files(spark, d).select(F.concat(X.parent(F.col("path")), name).alias("path")))


@query("a28_timings", "SELECT o_orderkey AS id, epoch_ms(max(l_shipdate)) - epoch_ms(min(l_shipdate)) AS span FROM "
    "lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(spark, d):
    s = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").cast("timestamp")
        .alias("a"), F.max("l_shipdate").cast("timestamp").alias("b"))
    events = s.select("id", F.explode(F.array(F.struct(F.lit("begin").alias("stage"), F.col("a").alias("at")),
        F.struct(F.lit("end").alias("stage"), F.col("b").alias("at")))).alias("e")).select("id", "e.*")
    return measures.timings(events, ["begin", "end"]).select("id", F.col("begin_end").cast("long").alias("span"))


@query("a29_execution_summary", B.with_views(", d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM "
    "b_edges UNION ALL SELECT target FROM b_edges) GROUP BY id), n AS (SELECT id, length(id) % 7 AS risk, length(id) % "
    "5 AS certainty, stacks[1] AS stack FROM b_nodes) SELECT arg_max(id, (risk, id)) AS riskiest, arg_min(id, "
    "(certainty, id)) AS least_certain, (SELECT count(*) FROM d WHERE degree >= 4) AS central, (SELECT count(*) FROM "
    "b_edges JOIN n a ON source = a.id JOIN n b ON target = b.id WHERE a.stack <> b.stack) AS cross_stack FROM n",
    "nodes", "edges"))
def _(spark, d):
    n = B.nodes(spark, d).select("id", (F.length("id") % 7).alias("risk"), (F.length("id") % 5).alias("certainty"),
        F.element_at("stacks", 1).alias("stack"))
    return measures.execution_summary(n, B.edges(spark, d))


@query("x1_language", B.with_views(f"SELECT path, {_case(_ALL)} AS language FROM b_files", "files"))
def _(spark, d):
    return B.files(spark, d).select("path", X.language(F.col("path")).alias("language"))


@query("x2_names", B.with_views(
    f"SELECT path, {_KEBAB('path')} AS kebab, {_WORDS} AS words, regexp_replace({_WORDS}, '(?:(?:^|-)(?:{_ROLE}))+$', '') AS stem, split_part({_WORDS}, '-', -1) AS suffix FROM b_files", "files"))
def _(spark, d):
    p = F.col("path")
    return B.files(spark, d).select("path", X.kebab(p).alias("kebab"), F.array_join(X.name_parts(p), "-").alias(
        "words"), X.responsibility_stem(p).alias("stem"), X.suffix_word(p).alias("suffix"))


_GENERIC = "[" + ", ".join(f"'{w}'" for w in X.GENERIC_TOKENS) + "]"
_AREAS = "[" + ", ".join(f"'{w}'" for w in X.AREA_WORDS) + "]"


@query("x4_responsibility_label", B.with_views(
    f", w AS (SELECT path, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({_NAME}, '(?i)\\.(d\\.)?(tsx?|jsx?|mjs|cjs|py|java|go)$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '' AND NOT list_contains({_GENERIC}, x)), '-') AS label FROM b_files) SELECT path, CASE WHEN label <> '' AND NOT list_contains({_AREAS}, label) THEN label END AS label FROM w", "files"))
def _(spark, d):
    return B.files(spark, d).select("path", X.responsibility_label(X.file_name(F.col("path"))).alias("label"))


@query("x5_titles", B.with_views(", w AS (SELECT path, list_filter(regexp_split_to_array(path, '[-_/]'), lambda x: x "
    "<> '') AS p FROM b_files) SELECT path, array_to_string(list_transform(p, lambda x: upper(x[1]) || x[2:]), ' ') AS "
    "title FROM w", "files"))
def _(spark, d):
    return B.files(spark, d).select("path", X.title_case(F.col("path")).alias("title"))


@query("x6_paths", B.with_views("SELECT path, path AS normal, regexp_replace(path, '^[^/]*/', '') AS climbed, "
    "regexp_replace(path, '/?[^/]*$', '') AS parent FROM b_files", "files"))
def _(spark, d):
    p = F.col("path")
    messy = F.concat(F.lit("./"), F.replace(p, F.lit("/"), F.lit("\\")), F.lit("/"))
    climbed = X.joined_path(F.concat(F.split_part(p, F.lit("/"), F.lit(1)), F.lit("/./../"), F.regexp_replace(p,
        "^[^/]*/", "")))
    return B.files(spark, d).select("path", X.normal_path(messy).alias("normal"), climbed.alias("climbed"), X.parent(p)
        .alias("parent"))


@query("x8_http_paths", "SELECT page_id, '/' || page_id || '/:param/x' AS normal, CASE WHEN page_id % 2 = 0 THEN 'GET' "
    "ELSE 'UNKNOWN' END AS method, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, "
    "coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages")
def _(spark, d):
    p = F.col("page_id")
    raw = F.concat(F.lit("//"), p, F.when(p % 2 == 0, F.lit("/:id")).otherwise(F.lit("/${user}")), F.lit("//x/?q=1"))
    return B.table(spark, d, "pages").select(p, X.http_path(raw).alias("normal"), X.http_method(F.when(p % 2 == 0,
        F.lit("get")).otherwise(F.lit("trace"))).alias("method"), X.url_origin(F.col("url")).alias("origin"),
        X.url_path(F.col("url")).alias("path"))


_STATEMENTS = ["SELECT a, b FROM t{} WHERE a = 'x from y'", "insert into s.t{} (a) values (1)", "update t{} set a = 2",
    "delete from t{} where a = 1;", "select * from t{} join u using (a)", "select 1 from t{} where a in (select a from "
    "u)", "truncate t{}"]


@query("x10_sql_tables", "SELECT p_partkey, [ 't' || k, 's.t' || k, 't' || k, 't' || k, NULL, NULL, NULL][p_partkey % "
    "7 + 1] AS tbl, ['read', 'write', 'write', 'write', 'read', 'read', 'invoke'][p_partkey % 7 + 1] AS verb FROM "
    "(SELECT p_partkey, p_partkey % 13 AS k FROM part)")
def _(spark, d):
    k = F.col("p_partkey")
    sql = F.replace(F.element_at(F.array(*map(F.lit, _STATEMENTS)), (k % 7 + 1).cast("int")), F.lit("{}"), (k % 13)
        .cast("string"))
    return B.spread(B.table(spark, d, "part").select(k), "p_partkey").select(k, X.sql_table(sql).alias("tbl"), X.sql_operation(sql).alias("verb"))


@query("x12_folders", B.with_views("SELECT folder, count(*) AS files, sum(size) AS bytes FROM (SELECT "
    "unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS folder, size FROM (SELECT "
    "string_split(path, '/') AS p, size FROM b_files)) GROUP BY folder", "files"))
def _(spark, d):
    return graph.descendants(B.files(spark, d))


@query("x13_common_directory", B.with_views(", f AS (SELECT module, unnest(list_transform(range(1, len(p)), lambda i: "
    "array_to_string(p[1:i], '/'))) AS folder FROM (SELECT module, string_split(path, '/') AS p FROM b_files)), n AS "
    "(SELECT module, count(*) AS n FROM b_files GROUP BY module) SELECT n.module, coalesce((SELECT arg_max(folder, "
    "length(folder)) FROM (SELECT folder, count(*) AS c FROM f WHERE f.module = n.module GROUP BY folder) WHERE c = "
    "n.n), '') AS folder FROM n", "files"))  # fmt: skip
def _(spark, d):
    return graph.common_directory(B.files(spark, d).select("module", "path"))


@query("x14_hashes", B.with_views("SELECT path, substr(sha256('file' || chr(0) || path || chr(0) || size), 1, 24) AS "
    "id, CASE WHEN length(path) > 30 THEN substr(path, 1, 29) || '…' ELSE path END AS short FROM b_files", "files"))
def _(spark, d):
    p = F.col("path")
    return B.files(spark, d).select("path", X.nul_joined_hash(F.lit("file"), p, F.col("size")).alias("id"),
        X.ellipsis(p, 30).alias("short"))


@query("x17_rounding", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice / 7.0 * 10 + 0.5) / 10 AS "
    "rounded FROM lineitem")
def _(spark, d):
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.half_up(F.col(
        "l_extendedprice") / 7.0).alias("rounded"))


_LOW = "lower(path)"
_CTX = f"({_LOW} || ' ' || regexp_replace({_WORDS}, '(?:(?:^|-)(?:{_ROLE}))+$', '') || '-' || split_part({_WORDS}, '-', -1))"
_SIGNALS = f"""CASE WHEN {_TEST} THEN ['test-surface'] ELSE list_filter([CASE WHEN regexp_matches({_CTX}, 'controller|route|router|endpoint|ipc|gateway') OR regexp_matches('/' || {_LOW} || '/', '/(api|routes|ipc)/') THEN 'api-boundary' END,
    CASE WHEN regexp_matches({_CTX}, 'repository|repo|database|migration|schema') OR regexp_matches('/' || {_LOW} || '/', '/(storage|data|database)/') THEN 'data-access' END, CASE WHEN regexp_matches({_CTX}, 'service|domain|core|workflow|analysis|analyzer') THEN 'domain-service' END,
    CASE WHEN regexp_matches({_CTX}, 'worker|queue|consumer|cron|scheduler') THEN 'job-worker' END], lambda x: x IS NOT NULL) END"""


@query("x18_role_signals", B.with_views(
    f", s AS (SELECT path, {_SIGNALS} AS s FROM b_files) SELECT path, array_to_string(CASE WHEN s = ['test-surface'] THEN s WHEN length(path) % 5 = 0 THEN ['external-integration'] WHEN len(s) = 0 THEN [CASE WHEN length(path) % 5 = 1 THEN 'unknown' ELSE 'domain-service' END] ELSE s END, ',') AS signals FROM s", "files"))
def _(spark, d):
    return B.files(spark, d).select("path", F.array_join(X.role_signals(F.col("path"), F.element_at(F.array(*map(F.lit,
        ["external", "unknown", "feature", "support", "test"])), (F.length("path") % 5 + 1).cast("int"))), ",").alias(
        "signals"))


@query("x19_boundaries", B.with_views("SELECT path, CASE " + " ".join(
    f"WHEN regexp_matches(lower(path), '{p}') THEN {i}" for i, p in enumerate(X.BOUNDARIES)) +
    " ELSE -1 END AS priority FROM b_files", "files"))
def _(spark, d):
    return B.files(spark, d).select("path", F.coalesce(X.boundary_priority(F.col("path")), F.lit(-1)).alias("priority"))


@query("x21_technology",
    B.with_views(
    """, t AS (SELECT module, CASE WHEN module LIKE '%1' THEN 'data-access' ELSE 'domain-service' END AS category, bool_or(regexp_matches(lower(path), '\\.(tsx|jsx|vue|svelte|css|scss|html)$')) AS fe, bool_or(regexp_matches(lower(path), '\\.(py|java|go|rs|php|cs|rb)$')) AS be, bool_or(regexp_matches(lower(path), '\\.(sql|prisma)$')) AS da FROM b_files GROUP BY module)
    SELECT module, coalesce(nullif(concat_ws(',', CASE WHEN fe THEN 'frontend' END, CASE WHEN be THEN 'backend' END, CASE WHEN da OR category = 'data-access' THEN 'data' END), ''), 'backend') AS stacks FROM t""", "files"))  # fmt: skip
def _(spark, d):
    m = B.files(spark, d).groupBy("module").agg(F.collect_set("path").alias("files"))
    return m.select("module", F.array_join(X.technology_stacks(F.col("files"), F.when(F.col("module").endswith("1"),
        F.lit("data-access")).otherwise(F.lit("domain-service"))), ",").alias("stacks"))


@query("x22_labels", B.with_views("SELECT id, node_type, layer FROM b_nodes", "nodes"))
def _(spark, d):
    n = B.nodes(spark, d)
    return n.select("id", X.mapped(F.col("category"), X.NODE_TYPES).alias("node_type"), X.mapped(F.col("category"),
        X.CATEGORY_LAYERS, F.lit("infrastructure")).alias("layer"))


@query("x23_lines", "SELECT doc_id, length(regexp_replace(text, '[^\\n]', '', 'g')) + 1 AS line FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", X.line_at(F.col("text"), F.length("text")).cast("long")
        .alias("line"))


_MESSAGES = ["HTTP 503 from upstream", "Invalid API key", "429 too many", "unknown model x", "ECONNRESET",
    "quota reached", "it broke"]


@query("x26_failures", "SELECT event_id, ['provider', 'authentication', 'rate-limit', 'model-not-found', 'connection', "
    "'rate-limit', 'process'][event_id % 7 + 1] AS code FROM events")
def _(spark, d):
    return B.table(spark, d, "events").select("event_id", X.failure_code(F.element_at(F.array(*map(F.lit, _MESSAGES)),
        (F.col("event_id") % 7 + 1).cast("int"))).alias("code"))


@query("x33_payload_bytes", "SELECT doc_id, strlen('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}') AS "
    "bytes FROM documents")
def _(spark, d):
    return B.table(spark, d, "documents").select("doc_id", F.octet_length(F.to_json(F.struct("doc_id", "source"))).cast(
        "long").alias("bytes"))


@query("d1_relations_once", B.with_views("SELECT id, source_file, target_file, kind, detail FROM (SELECT *, "
    "row_number() OVER (PARTITION BY id ORDER BY source_file, target_file NULLS FIRST, kind, detail, confidence) AS rn "
    "FROM b_relations) WHERE rn = 1", "relations"))
def _(spark, d):
    from ..operators.relations import sorted_unique

    return B.relation_texts(sorted_unique(B.relation_numbers(spark, d).drop("symbol")).select("id", "source_file", "target_file", "kind", "detail"))


@query("d2_capped", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY event_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY "
    "event_id) AS rn FROM events) WHERE rn = 1) WHERE place <= 3")
def _(spark, d):
    return dedupe.capped(B.table(spark, d, "events"), ["user_id", "event_type"], ["user_id"], ["event_id"], 3).select(
        "user_id", "event_type", "event_id")


@query("d3_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM "
    "events GROUP BY user_id")
def _(spark, d):
    return dedupe.keep_last(B.table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"],
        "event_id")


@query("d6_short_hashes", B.with_views(", v AS (SELECT DISTINCT sha256(path) AS h, path FROM b_files) SELECT path, "
    "substr(h, 1, n) AS short_id FROM (SELECT path, h, n, row_number() OVER (PARTITION BY path ORDER BY n) AS rn FROM "
    "(SELECT path, h, unnest([2, 6, 10, 14]) AS n FROM v) a WHERE (SELECT count(*) FROM v b WHERE b.h[1:a.n] = "
    "a.h[1:a.n]) = 1) WHERE rn = 1", "files"))
def _(spark, d):
    return dedupe.short_hashes(B.files(spark, d).select("path").distinct(), F.col("path"), 2, 4).select("path",
        "short_id")


@query("d7_dictionary", "SELECT lang, rank() OVER (ORDER BY f) - 1 AS code FROM (SELECT lang, min(doc_id) AS f FROM "
    "documents GROUP BY lang)")
def _(spark, d):
    return dedupe.dictionary(B.table(spark, d, "documents"), "lang", "doc_id")


@query("f1_node_filter", B.with_views("SELECT id FROM b_nodes WHERE layer = 'domain' AND list_has_any(stacks, ['data', "
    "'frontend'])", "nodes"))
def _(spark, d):
    return views.filtered(B.nodes(spark, d), "domain", ["data", "frontend"]).select("id")


@query("f2_why_empty", "SELECT 'no-matches' AS state, 'combination' AS cause")
def _(spark, d):
    return views.why_empty(B.nodes(spark, d).where("id <> 'x'"), "api", ["backend"])


@query("f10_search", B.with_views("SELECT id FROM b_nodes WHERE resource_kind IS NULL AND (lower(title) LIKE '%ier/1%' "
    "OR len(list_filter(files, lambda f: lower(f) LIKE '%ier/1%')) > 0) ORDER BY id LIMIT 8", "nodes"))
def _(spark, d):
    return views.search(B.nodes(spark, d), "IER/1").select("id")


@query("f16_visible_tree", B.with_views("SELECT path FROM b_files WHERE source_open AND path NOT LIKE '%/tests/%' "
    "ORDER BY path LIMIT 50".replace("source_open", "module IN ('src1', 'src2')"), "files"))
def _(spark, d):
    f = B.files(spark, d)
    open_ = f.select(F.explode(X.folders(F.col("path"))).alias("folder")).distinct().where(
        "folder rlike '^src[12](/|$)' and folder not like '%/tests'")
    return views.visible_rows(f.select("path"), open_, 50)


@query("f17_safety", "SELECT count(*) FILTER (doc_id % 50 = 0) AS sensitive, count(*) FILTER (doc_id % 9 * 100 > 500) "
    "AS large, count(*) FILTER (doc_id % 7 = 0) AS deleted, 'blocked' AS level FROM documents")
def _(spark, d):
    i = F.col("doc_id")
    changes = B.table(spark, d, "documents").select(F.when(i % 50 == 0, F.lit("a/.env")).otherwise(F.lit("a/b.ts"))
        .alias("path"), F.when(i % 7 == 0, F.lit("deleted")).otherwise(F.lit("modified")).alias("status"), (i % 9 * 100)
        .alias("additions"), F.lit(0).alias("deletions"))
    return views.safety(changes)


@query("f19_inventory", "SELECT path, problem FROM (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN "
    "'missing' WHEN doc_id % 10 = 1 THEN 'unexpected' WHEN doc_id % 10 = 2 THEN 'size' WHEN doc_id % 10 = 3 THEN "
    "'hash' END AS problem FROM documents) WHERE problem IS NOT NULL")
def _(spark, d):
    f = B.files(spark, d).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), "size", "hash")
    m = F.col("doc_id") % 10
    return S.inventory_problems(f.where(m != 1), f.where(m != 0).withColumns({"size": F.when(m == 2, F.col("size") + 1)
        .otherwise(F.col("size")), "hash": F.when(m == 3, F.lit("x")).otherwise(F.col("hash"))}))


@query("f22_classified", B.with_views(
    f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN doc_id % 19 = 0 THEN 'excluded:not-regular' WHEN {_case(_EXTS)} IS NOT NULL THEN 'source' ELSE 'other' END AS kind FROM b_files) GROUP BY kind", "files"))
def _(spark, d):
    return S.classified(B.files(spark, d).withColumn("regular", F.col("doc_id") % 19 != 0)).groupBy("kind").agg(F.count(
        "*").alias("n"))


@query("g14_tree", B.with_views(", p AS (SELECT DISTINCT path FROM b_files), a AS (SELECT DISTINCT "
    "unnest(list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/'))) AS path FROM (SELECT "
    "string_split(path, '/') AS s FROM p)), r AS (SELECT path, 'file' AS type FROM p UNION ALL SELECT path, 'folder' "
    "FROM a) SELECT path, regexp_replace(path, '/?[^/]*$', '') AS parent, regexp_extract(path, '[^/]*$') AS name, "
    "len(string_split(path, '/')) AS depth, type FROM r", "files"))
def _(spark, d):
    return graph.tree(B.files(spark, d).select("path"))

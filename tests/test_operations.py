"""Operations by API and arguments, on small files in four languages."""

from pyspark.sql import functions as F

from lodestrata.functions import lexers
from lodestrata.operators import operations

SCOPES = "scope string, language string, root string, source_roots array<string>, package string, dependencies array<string>"
SOURCES = {
    "py/net.py": "from urllib.request import Request, urlopen\nfrom http.client import HTTPSConnection, HTTPConnection\nimport requests as r\nimport sqlite3\nimport subprocess\nfrom pathlib import Path\nBASE = 'https://base.test/x'\n"
        "def f(host, flag):\n    made = Request(url='https://a.test/u', method='POST')\n    urlopen(url=made)\n    urlopen('https://b.test/v')\n    c = HTTPSConnection('s.test', 443)\n    c.request('GET', '/api')\n"
        "    HTTPConnection(host).request('GET', '/no')\n    url = 'https://c.test'\n    again = url\n    r.get(again)\n    one = 'p'\n    if flag:\n        one = 'q'\n    r.post(one)\n    same = 'z'\n    if flag:\n        same = 'z'\n"
        "    r.put(same)\n    r.delete(host)\n    Path('data.txt').read_text()\n    open('log.txt', 'w')\n    open('log.txt')\n    subprocess.run(['echo', 'x'])\n    db = sqlite3.connect('file.db')\n    db.execute('SELECT 1')\n"
        "    db.execute('insert into t values (1)')\ndef g(urlopen, open):\n    urlopen('https://shadow.test')\n    open('shadow')\n",
    "ts/a.ts": "import * as fs from 'fs';\nimport { readFile, writeFile } from 'node:fs/promises';\nimport axios from 'axios';\nimport { Pool } from 'pg';\nimport { exec } from 'child_process';\nconst where = '/etc/a';\n"
        "function f(fetch2: any) {\n  fs.readFileSync(where);\n  readFile('b');\n  writeFile('c', 'x');\n  fetch('https://t.test');\n  axios.post('/p');\n  const pool = new Pool();\n  pool.query('UPDATE t SET a = 1');\n  exec('ls');\n}\n"
        "function g(fetch: any, fs: any) { fetch('no'); fs.readFileSync('no'); }\n",
    "go/m.go": "package main\nimport (\n  h \"net/http\"\n  \"os\"\n  \"os/exec\"\n)\nfunc main() {\n  r, err := h.NewRequest(\"PUT\", \"https://go.test/u\", nil)\n  c := h.Client{}\n  c.Do(r)\n  os.ReadFile(\"d.txt\")\n  cmd := exec.Command(\"echo\")\n"
        "  cmd.Run()\n  _ = err\n}\n",
    "java/p/A.java": "package p; import java.nio.file.Files; import java.nio.file.Path; class A { void f() { Files.readString(Path.of(\"data.txt\")); new ProcessBuilder(\"ls\").start(); } }",
}


def test_operations(spark):
    rows = [(f"{lang}:{root}", lang, root, [root], root, []) for lang, root in (("python", "py"), ("typescript", "ts"), ("go", "go"), ("java", "java"))]
    files = spark.createDataFrame(list(SOURCES.items()), "path string, content string").withColumn("language", lexers.language_of(F.col("path")))
    files = files.withColumn("scope", F.concat_ws(":", "language", F.split_part("path", F.lit("/"), F.lit(1))))
    found = operations.operations(files, spark.createDataFrame(rows, SCOPES)).collect()
    got = sorted((r["path"].split("/")[0], r["kind"], r["operation"], r["method"] or "", r["target"] or "") for r in found)
    assert got == sorted([
        ("py", "http", "invoke", "POST", "https://a.test/u"), ("py", "http", "invoke", "GET", "https://b.test/v"), ("py", "http", "invoke", "GET", "https://s.test:443/api"), ("py", "http", "invoke", "GET", ""),
        ("py", "http", "invoke", "GET", "https://c.test"), ("py", "http", "invoke", "POST", ""), ("py", "http", "invoke", "PUT", "z"), ("py", "http", "invoke", "DELETE", ""), ("py", "filesystem", "read", "", "data.txt"),
        ("py", "filesystem", "write", "", "log.txt"), ("py", "filesystem", "read", "", "log.txt"), ("py", "process", "invoke", "", "echo"), ("py", "database", "read", "", "SELECT 1"),
        ("py", "database", "write", "", "insert into t values (1)"), ("ts", "filesystem", "read", "", "/etc/a"), ("ts", "filesystem", "read", "", "b"), ("ts", "filesystem", "write", "", "c"),
        ("ts", "http", "invoke", "GET", "https://t.test"), ("ts", "http", "invoke", "POST", "/p"), ("ts", "database", "write", "", "UPDATE t SET a = 1"), ("ts", "process", "invoke", "", "ls"),
        ("go", "http", "invoke", "PUT", "https://go.test/u"), ("go", "filesystem", "read", "", "d.txt"), ("go", "process", "invoke", "", "echo"), ("java", "filesystem", "read", "", "data.txt"),
        ("java", "process", "invoke", "", "ls")])

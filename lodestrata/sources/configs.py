"""Configuration files as scopes and packages: JSON, TOML, XML, a YAML list, and two formats by regular expression."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X

SCHEMA = "path string, format string, name string, version string, members array<string>, dependencies array<string>, problem string"


def yaml_list(text: str, key: str = "packages") -> list[str]:
    """The items of one list in a YAML file."""
    out, inside = [], False
    for line in text.splitlines():
        if re.match(rf"{key}\s*:\s*(#.*)?$", line):
            inside = True
        elif m := re.match(rf"{key}\s*:\s*\[(.*)\]", line):
            return [x.strip().strip("'\"") for x in m[1].split(",") if x.strip()]
        elif inside and (m := re.match(r"\s*-\s+(.*?)\s*(?:#.*)?$", line)):
            out.append(m[1].strip("'\""))
        elif inside and line.strip() and not line.lstrip().startswith("#"):
            break
    return out


def read_config(path: str, text: str) -> tuple:
    """(path, format, name, version, members, dependencies, problem)."""
    base = path.rsplit("/", 1)[-1]
    try:
        if base == "package.json":
            d = json.loads(text)
            members = d.get("workspaces") or []
            members = members.get("packages", []) if isinstance(members, dict) else members
            return path, "npm", d.get("name"), d.get("version"), members, sorted({**d.get("dependencies", {}), **d.get(
                "devDependencies", {})}), None
        if re.fullmatch(r"tsconfig(\..*)?\.json", base):
            d = json.loads(re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)^\s*//.*$", "", text)))
            return path, "tsconfig", None, None, d.get("include") or [], [r["path"] for r in d.get("references",
                [])], None
        if base == "pnpm-workspace.yaml":
            return path, "pnpm", None, None, yaml_list(text), [], None
        if base == "pyproject.toml":
            d = tomllib.loads(text)
            p = d.get("project") or d.get("tool", {}).get("poetry", {})
            deps = p.get("dependencies") or []
            return path, "python", p.get("name"), p.get("version"), [], sorted(re.split(r"[\s<>=!~;\[]", x)[0]
                for x in deps), None
        if base == "pom.xml":
            if "<!DOCTYPE" in text or "<!ENTITY" in text:
                raise ValueError("a DTD is not read")
            root = ET.fromstring(text)
            ns = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
            one = lambda t: root.findtext(ns + t)
            return path, "maven", one("artifactId"), one("version"), [m.text or "" for m in root.iterfind(
                f"{ns}modules/{ns}module")], sorted(d.findtext(ns + "artifactId") or "" for d in root.iterfind(
                f"{ns}dependencies/{ns}dependency")), None
        if base in ("go.mod", "go.work"):
            name = re.search(r"(?m)^module\s+(\S+)", text)
            uses = re.findall(r"(?m)^\s*(?:use\s+)?(\.{1,2}/\S*|\.)\s*$", text)
            needs = re.findall(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-/]+)\s+v[\w.\-+]+", text)
            return path, "go", name and name[1], None, uses, sorted(set(needs)), None
        if base.startswith(("build.gradle", "settings.gradle")):
            name = re.search(r"rootProject\.name\s*=\s*['\"]([^'\"]+)", text)
            return path, "gradle", name and name[1], None, [m.strip(":").replace(":", "/") for line in re.findall(
                r"(?m)^\s*include[ (](.*)$", text) for m in re.findall(r"['\"]([^'\"]+)['\"]",
                line)], sorted(set(re.findall(r"project\(['\"]:?([^'\"]+)['\"]\)", text))), None
    except (ValueError, ET.ParseError, AttributeError, KeyError, TypeError) as e:
        return path, "invalid", None, None, [], [], type(e).__name__
    return path, "other", None, None, [], [], None


def packages(files: DataFrame) -> DataFrame:
    """What configuration files (path, content) say."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([read_config(p, c or "") for p, c in zip(pdf["path"], pdf["content"], strict=True)],
                columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


# Which configuration makes a folder the root of a language's scope.
ROOT_FILES = {"package.json": "typescript", "tsconfig.json": "typescript", "pyproject.toml": "python", "setup.py":
    "python", "pom.xml": "java", "build.gradle": "java", "go.mod": "go"}


def scopes(files: DataFrame) -> DataFrame:
    """Scopes (scope, language, root) of files(path): the folders that hold a root file of a language."""
    found = files.withColumn("language", X.mapped(X.file_name(F.col("path")), ROOT_FILES)).where("language is not null")
    return found.select(F.concat_ws(":", "language", X.parent(F.col("path"))).alias("scope"), "language",
        X.parent(F.col("path")).alias("root")).distinct()

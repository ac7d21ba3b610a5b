"""Path aliases of TypeScript and JavaScript projects, as the table module_rules.

The config files of a snapshot are few and small; they are resolved on the driver.
"""

from __future__ import annotations

import json
import os
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession

from ..schemas import MODULE_RULES

_SKIP = {".git", "node_modules", "target", ".direnv"}
_NAMES = ("tsconfig.json", "jsconfig.json")
_JSONC = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*[\s\S]*?\*/')
_TRAILING = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[}\]])')


def read_jsonc(text: str):
    """JSON with // and /* */ comments and trailing commas; strings are left alone."""
    bare = _JSONC.sub(lambda m: m[0] if m[0][0] == '"' else " ", text)
    return json.loads(_TRAILING.sub(lambda m: m[0] if m[0][0] == '"' else "", bare))


def normal(path: str) -> str | None:
    """A path below the root with . and .. resolved; None if it leaves the root; '' for the root."""
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _load(root: str, path: str, seen: frozenset) -> tuple[str | None, dict[str, list[str]]]:
    """(base url, pattern to targets) of a config with what it extends; a cycle or a fault gives nothing."""
    if path in seen or not os.path.isfile(os.path.join(root, path)):
        return None, {}
    try:
        with open(os.path.join(root, path), encoding="utf-8") as f:
            config = read_jsonc(f.read())
    except (ValueError, OSError):
        return None, {}
    folder = posixpath.dirname(path)
    base, rules = None, {}
    given = config.get("extends")
    for parent in [given] if isinstance(given, str) else given or []:
        at = extended(folder, parent)
        if at is not None:
            b, r = _load(root, at, seen | {path})
            base, rules = b if b is not None else base, rules | r
    options = config.get("compilerOptions") or {}
    if isinstance(options.get("baseUrl"), str):
        base = normal(posixpath.join(folder, options["baseUrl"]))
    for pattern, targets in (options.get("paths") or {}).items():
        inside = [t for t in (normal(posixpath.join(folder, x)) for x in targets if isinstance(x, str)) if t is not None]
        if inside:
            rules[pattern] = inside
    return base, rules


def extended(folder: str, parent: str) -> str | None:
    """The config that extends names: relative to the folder, or a package; its last extension becomes .json."""
    at = posixpath.join(folder, parent) if parent.startswith(".") else parent.lstrip("/") if parent.startswith("/") else posixpath.join("node_modules", parent)
    head, _, name = at.rpartition("/")
    name = (name.rpartition(".")[0] or name) + ".json" if not name.endswith(".json") else name
    return normal(posixpath.join(head, name))


def find(root: str) -> list[str]:
    """Config files by depth, tsconfig before jsconfig, then path."""
    out = []
    for folder, dirs, files in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in _SKIP)
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        out += [posixpath.join("" if rel == "." else rel, n) for n in _NAMES if n in files]
    return sorted(out, key=lambda p: (p.count("/"), _NAMES.index(posixpath.basename(p)), p))


def rules(root: str) -> list[tuple[str, str | None, str, list[str]]]:
    """(scope folder, base url, pattern, targets); the first config of a folder wins."""
    out, done = [], set()
    for path in find(root):
        scope = posixpath.dirname(path)
        if scope in done:
            continue
        done.add(scope)
        base, found = _load(root, path, frozenset())
        out += [(scope, base, pattern, targets) for pattern, targets in sorted(found.items())]
        if base is not None:  # specifiers are looked for below the base folder besides
            out.append((scope, base, "*", [posixpath.join(base, "*") if base else "*"]))
    return out


def module_rules(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(rules(root), MODULE_RULES)

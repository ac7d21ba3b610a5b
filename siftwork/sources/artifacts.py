"""Stored indexes: where they lie, whether they still fit, and clearing them away."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import time
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMAT_VERSION = 1
CACHE_LIMIT = 2 * 1024**3
META_LIMIT = 1024**2
_TOOL = "siftwork"


@dataclass(frozen=True)
class Meta:
    commit: str
    created_at: int
    format_version: int = FORMAT_VERSION

    def fits(self, commit: str) -> bool:
        return self.format_version == FORMAT_VERSION and self.commit == commit


@dataclass(frozen=True)
class Spec:
    """owner/repo[@ref]"""

    owner: str
    repo: str
    ref: str | None = None

    @classmethod
    def parse(cls, text: str) -> "Spec":
        path, at, ref = text.partition("@")
        parts = path.split("/")
        if len(parts) != 2 or not all(re.fullmatch(r"[A-Za-z0-9._-]+", p) and p not in (".", "..") for p in parts):
            raise ValueError(f"not an owner/repo[@ref]: {text!r}")
        if at and (not ref or ref.startswith("-")):
            raise ValueError(f"not a ref: {ref!r}")
        return cls(*parts, ref or None)


def component(name: str) -> str:
    """A name that may stand in a path by itself."""
    if name in ("", ".", "..") or "/" in name or "\\" in name:
        raise ValueError(f"not a path component: {name!r}")
    return name


def cache_root() -> Path:
    if own := os.environ.get("SIFTWORK_CACHE_DIR"):
        return Path(own)
    base = os.environ.get("XDG_CACHE_HOME") or (os.path.expanduser("~/.cache") if os.path.expanduser("~") != "~" else "/tmp")
    return Path(base) / _TOOL


def _place(spec: Spec) -> str:
    """The ref is part of the path, so two refs of a repository never answer for each other."""
    ref = re.sub(r"[^A-Za-z0-9._-]", "_", spec.ref) if spec.ref else "HEAD"
    return "/".join(("repos", component(spec.owner), component(spec.repo), component(ref)))


def artifact_dir(spec: Spec, root: Path | None = None) -> Path:
    return (root or cache_root()) / _place(spec)


def artifact_uri(spec: Spec, root: str | Path | None = None) -> str:
    """The same below a root that may be a URI."""
    return f"{str(root or cache_root()).rstrip('/')}/{_place(spec)}"


def save_meta(folder: str | Path, commit: str) -> Meta:
    meta = Meta(commit, int(time.time()))
    path = Path(folder) / "meta.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(".new")
    new.write_text(json.dumps(asdict(meta)))
    new.rename(path)
    return meta


def load_meta(folder: str | Path) -> Meta | None:
    """None where there is none, it is too large, or it cannot be read: the caller then builds anew."""
    path = Path(folder) / "meta.json"
    try:
        if path.stat().st_size > META_LIMIT:
            return None
        return Meta(**json.loads(path.read_text()))
    except (OSError, ValueError, TypeError):
        return None


def head_commit(repo: str | Path) -> str | None:
    try:
        return subprocess.run(["git", "-C", str(repo), "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def cleanup(folder: str | Path) -> bool:
    """Deletes a cache folder; refuses one whose path does not name the tool."""
    path = Path(folder).resolve()
    if _TOOL not in str(path):
        raise ValueError(f"refusing to delete {path}")
    if not path.exists():
        return False
    shutil.rmtree(path)
    return True


def evict(root: Path, limit: int = CACHE_LIMIT) -> list[str]:
    """Deletes the artifacts that were touched longest ago until the rest fits."""
    found = []
    for p in Path(root).glob("repos/*/*/*"):
        files = [f for f in p.rglob("*") if f.is_file()]
        found.append((max((f.stat().st_mtime for f in files), default=p.stat().st_mtime), str(p), sum(f.stat().st_size for f in files)))
    total, gone = sum(f[2] for f in found), []
    for _, path, size in sorted(found):
        if total <= limit:
            break
        cleanup(path)
        gone.append(path)
        total -= size
    return gone


def evicted(sizes: DataFrame, limit: int, *keys: str, buckets: int = 64) -> DataFrame:
    """The same choice over a table (keys, path, size, touched_at): newest first, all beyond the limit.

    The running size is made in two steps, over ranges of the time a key was touched in and then
    within a range, so that a key with very many rows is not sorted in one task.
    """
    by = list(keys)
    spans = sizes.groupBy(*by).agg(F.min("touched_at").cast("double").alias("_lo"), F.max("touched_at").cast("double").alias("_hi"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / buckets, F.lit(1e-9))
    placed = sizes.join(spans, by).withColumn("_b", F.coalesce(F.floor((F.col("_hi") - F.col("touched_at").cast("double")) / width), F.lit(buckets)))
    sums = placed.groupBy(*by, "_b").agg(F.sum("size").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("size").over(Window.partitionBy(*by, "_b").orderBy(F.desc("touched_at"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0))
    kept = placed.join(sums.select(*by, "_b", before.alias("_before")), [*by, "_b"]).withColumn("kept_size", F.col("_before") + inside)
    return kept.where(F.col("kept_size") > limit).drop("_lo", "_hi", "_b", "_before")

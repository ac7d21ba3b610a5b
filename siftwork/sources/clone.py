"""Getting a repository snapshot onto the driver's disk."""

from __future__ import annotations

import errno
import os
import shutil
import subprocess
import tempfile
from pathlib import Path


def clone(url: str, target: Path, ref: str | None = None) -> Path:
    """A shallow clone of one branch or tag at target; one that is there already is used as it is.

    The clone is made beside the target and renamed, so a half-made one is never seen.
    """
    if (target / ".git").exists():
        return target
    if ref is not None and (not ref or ref.startswith("-")):
        raise ValueError(f"not a ref: {ref!r}")
    target.parent.mkdir(parents=True, exist_ok=True)
    work = Path(tempfile.mkdtemp(prefix=target.name + "-", dir=target.parent))
    made = work / "clone"
    try:
        subprocess.run(["git", "clone", "--quiet", "--depth", "1", "--single-branch", *(["--branch", ref] if ref else []), "--", url, str(made)], check=True, capture_output=True, text=True)
        try:
            os.rename(made, target)
        except OSError as e:
            if e.errno == errno.EXDEV:
                shutil.copytree(made, target)
            elif not (target / ".git").exists():  # another process may have been first
                raise
    except subprocess.CalledProcessError as e:
        raise RuntimeError(f"cannot clone {url}: {e.stderr.strip()}") from e
    finally:
        shutil.rmtree(work, ignore_errors=True)
    return target

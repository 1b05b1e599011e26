"""Git work trees as sources: listing, changed files, blobs. Git runs on the driver; its answers become tables."""

from __future__ import annotations

import hashlib
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SUFFIXES = {".scala": "scala", ".java": "java"}
FILES = "path string, oid string, lang string"


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def language(path: str) -> str | None:
    return SUFFIXES.get(Path(path).suffix)


def blob_id(data: bytes) -> str:
    """The id that git gives to these bytes."""
    return hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest()


def listing(root: str, staged: bool = False) -> list[tuple[str, str, str]]:
    """(path, oid, lang) of tracked sources. The id is what git has in its index; of files that git says have been edited since, it is that of the present
    content, so edits that are not staged are seen and no other file is read. With ``staged`` those are not asked for."""
    edited = set() if staged else set(filter(None, (_git(root, "diff-files", "--name-only", "-z") or "").split("\0")))
    out = []
    for entry in filter(None, (_git(root, "ls-files", "--stage", "-z") or "").split("\0")):
        head, _, path = entry.partition("\t")
        lang = language(path)
        if not lang:
            continue
        oid = head.split()[1]
        if path in edited:
            try:
                oid = blob_id((Path(root) / path).read_bytes())
            except OSError:
                pass
        out.append((path, oid, lang))
    return out


def ls_files(spark: SparkSession, root: str, staged: bool = False) -> DataFrame:
    return spark.createDataFrame(listing(root, staged), FILES)


def changed(root: str, ref: str) -> list[str] | None:
    """Tracked sources that differ from ``ref``; None if git refuses."""
    out = _git(root, "diff", "--name-only", "-z", ref)
    return None if out is None else [p for p in out.split("\0") if p and language(p)]


def show(root: str, ref: str, path: str) -> str | None:
    return _git(root, "show", f"{ref}:{path}")

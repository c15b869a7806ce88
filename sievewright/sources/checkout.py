"""Source files of a checkout.

Spark's file sources skip names that begin with `_` or `.`, which source trees have, so paths are listed on the driver
and contents are read by tasks, one file at a time. Tasks need the checkout at the same path (a shared mount).
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FILES, LANGUAGES

# Folders that never hold sources of the checkout's own.
SKIPPED = frozenset({".git", "node_modules", "vendor", "dist", "build", "target", ".venv", "__pycache__"})
# Files that make their folder a module.
MODULE_FILES = {"package.json": r'"name"\s*:\s*"([^"]+)"', "go.mod": r"(?m)^module\s+(\S+)", "pom.xml": r"<artifactId>([^<]+)</artifactId>", "build.gradle": None, "build.gradle.kts": None, "Package.swift": r'name:\s*"([^"]+)"'}


def _git(root: Path, *what: str) -> list[str] | None:
    try:
        out = subprocess.run(["git", "-C", str(root), "ls-files", "-z", *what], capture_output=True, check=True, timeout=600).stdout
    except (OSError, subprocess.SubprocessError):
        return None
    return [os.fsdecode(x) for x in out.split(b"\0") if x]


def walk(root: str, suffixes: Iterable[str] | None = None, skip: frozenset[str] = SKIPPED) -> Iterator[str]:
    """Paths under root of these suffixes, sorted, without skipped folders; links to folders aren't followed."""
    wanted = tuple(suffixes) if suffixes is not None else None
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in skip)
        for name in sorted(files):
            if wanted is None or name.endswith(wanted):
                yield os.path.relpath(os.path.join(folder, name), root)


def listing(spark: SparkSession, root: str, suffixes: Iterable[str] | None = None, with_ignored: bool = False) -> DataFrame:
    """path, resolved and ignored of a checkout's files, without content: by git where it can, else by a walk. Ignored files are left out unless asked for. Links are resolved, and a file is listed once under its first path."""
    top = Path(root)
    own = _git(top)
    if own is None:
        found = [(p, False) for p in walk(root, suffixes)]
    else:
        more = _git(top, "--others", "--exclude-standard") or []
        left_out = (_git(top, "--others", "--ignored", "--exclude-standard") or []) if with_ignored else []
        wanted = tuple(suffixes) if suffixes is not None else None
        found = [(p, i) for part, i in ((own + more, False), (left_out, True)) for p in part if wanted is None or p.endswith(wanted)]
    rows, seen = [], set()
    for path, ignored in sorted(set(found)):
        resolved = os.path.realpath(top / path)
        if resolved not in seen and os.path.isfile(resolved):
            seen.add(resolved)
            rows.append((path, resolved, ignored))
    return spark.createDataFrame(rows, "path string, resolved string, ignored boolean")


def links(spark: SparkSession, root: str) -> DataFrame:
    """path and target of each symbolic link."""
    rows = []
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n != ".git"]
        rows += [(os.path.relpath(p, root), os.path.realpath(p)) for n in sorted([*names, *files]) if os.path.islink(p := os.path.join(folder, n))]
    return spark.createDataFrame(rows, "path string, target string")


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """Paths that git tracks."""
    return spark.createDataFrame([(p,) for p in _git(Path(root)) or []], "path string")


def with_content(files: DataFrame) -> DataFrame:
    """A listing with its files' bytes; null where a file can't be read."""

    def load(parts):
        for part in parts:
            out = []
            for path in part["resolved"]:
                try:
                    with open(path, "rb") as f:
                        out.append(f.read())
                except OSError:
                    out.append(None)
            yield part.assign(content=pd.Series(out, index=part.index, dtype=object))

    return files.select("path", "resolved", "ignored").mapInPandas(load, FILES)


def decoded(files: DataFrame) -> DataFrame:
    """Files with content as text; null for bytes that aren't UTF-8."""
    return files.withColumn("content", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))


def language(path: Column) -> Column:
    """The language of a path: the first in order of precedence one of whose extensions it has; null for none."""
    chain = None
    for token, extensions, _, _ in LANGUAGES:
        held = F.lit(False)
        for e in extensions:
            held = held | path.endswith(e)
        chain = F.when(held, token) if chain is None else chain.when(held, token)
    return chain


def modules(files: DataFrame) -> DataFrame:
    """directory and module of each module file (path, content as text): the name it declares, else its directory."""
    name = F.element_at(F.split("path", "/"), -1)
    chain = None
    for file, pattern in MODULE_FILES.items():
        value = F.regexp_extract("content", pattern, 1) if pattern else F.lit("")
        chain = F.when(name == file, value) if chain is None else chain.when(name == file, value)
    directory = F.regexp_replace("path", "/?[^/]+$", "")
    found = files.where(name.isin(*MODULE_FILES)).select(directory.alias("directory"), chain.alias("module"))
    return found.select("directory", F.when(F.col("module") != "", F.col("module")).otherwise(F.col("directory")).alias("module"))


def to_reread(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose path and content a cached table (path, digest) doesn't hold."""
    now = listing.withColumn("digest", F.sha2("content", 256))
    return now.join(cached.select("path", "digest"), ["path", "digest"], "left_anti")

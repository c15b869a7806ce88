"""Effects outside tables, on the driver: small, in order, and safe to repeat."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame


def apply(rewrites: DataFrame, root: str) -> list[str]:
    """Write one flag's rewrites (path, before, after; after null: delete) into a checkout; the paths written. A file that is no longer what the rewrite was made from stops it before anything is written."""
    rows = sorted(rewrites.select("path", "before", "after").toLocalIterator(), key=lambda r: r.path)
    for r in rows:
        if (Path(root) / r.path).read_bytes() != r.before.encode():
            raise RuntimeError(f"{r.path} has changed")
    for r in rows:
        file = Path(root) / r.path
        if r.after is None:
            file.unlink()
        else:
            new = file.with_name(file.name + ".new")
            new.write_bytes(r.after.encode())
            os.replace(new, file)
    return [r.path for r in rows]


def commit(root: str, paths: Iterable[str], message: str, branch: str) -> str:
    """Commit these paths alone on a branch; the commit's id."""
    git = lambda *a: subprocess.run(["git", "-C", root, *a], check=True, capture_output=True, text=True).stdout.strip()
    git("checkout", "-q", "-B", branch)
    git("add", "--all", "--", *paths)
    git("commit", "-q", "-m", message, "--", *paths)
    return git("rev-parse", "HEAD")


def push(root: str, remote: str, branch: str, expected: str | None = None) -> bool:
    """Push a branch. With `expected`, replace the remote's branch only if it still is that commit; whether it went."""
    lease = [] if expected is None else [f"--force-with-lease={branch}:{expected}"]
    return subprocess.run(["git", "-C", root, "push", "-q", *lease, remote, f"HEAD:refs/heads/{branch}"], capture_output=True).returncode == 0


class Reporter:
    """Sends links from flags to requests; after a refusal for want of rights it sends no more."""

    def __init__(self, send: Callable[[str, str], str]):
        self.send, self.stopped = send, False

    def report(self, key: str, url: str | None) -> str:
        if not url:
            return "nothing"
        if self.stopped:
            return "stopped"
        try:
            outcome = self.send(key, url)
        except OSError as error:
            return f"failed: {error}"
        self.stopped = outcome == "forbidden"
        return outcome

"""Keys, branches and titles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The prefix of removal branches (a parameter of the functions below), the longest escaped key, and the patterns of keys.
BRANCH_PREFIX = "cleanup/remove-flag/"
LONGEST = 240
PLATFORM_KEY = r"^[a-z0-9]+([-_][a-z0-9]+)*$"
CODE_KEY = r"^[A-Za-z0-9_](?:[A-Za-z0-9_.:-]*[A-Za-z0-9_])?$"

_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def escape(key: str | None) -> str | None:
    """A key as a branch segment: bytes outside [A-Za-z0-9_-] as = and two upper-case hex digits. None for a blank or over-long one."""
    if key is None or not key.strip():
        return None
    out = "".join(chr(b) if b in _SAFE else f"={b:02X}" for b in key.encode())
    return out if len(out) <= LONGEST else None


def unescape(segment: str | None) -> str | None:
    """The key whose escaped form is exactly this segment, or None."""
    if not segment:
        return None
    raw, rest = bytearray(), segment.split("=")
    raw += rest[0].encode()
    for part in rest[1:]:
        if len(part) < 2 or any(c not in "0123456789ABCDEF" for c in part[:2]):
            return None
        raw.append(int(part[:2], 16))
        raw += part[2:].encode()
    try:
        key = raw.decode()
    except UnicodeDecodeError:
        return None
    return key if escape(key) == segment else None


@F.pandas_udf(StringType())
def _escape(keys: pd.Series) -> pd.Series:
    return keys.map(escape)


@F.pandas_udf(StringType())
def _unescape(segments: pd.Series) -> pd.Series:
    return segments.map(unescape)


def removal_branch(key: Column, prefix: str = BRANCH_PREFIX) -> Column:
    """The branch of a key, null where it has none. Keys of the safe alphabet stay in the JVM."""
    plain = key.rlike("^[A-Za-z0-9_-]+$") & (F.length(key) <= LONGEST)
    return F.concat(F.lit(prefix), F.when(plain, key).otherwise(_escape(key)))


def key_of_branch(branch: Column, prefix: str = BRANCH_PREFIX) -> Column:
    """The inverse of removal_branch: null for any branch that it could not have made."""
    return F.when(branch.startswith(prefix), _unescape(F.substring(branch, len(prefix) + 1, 1 << 20)))


def is_code_key(key: Column) -> Column:
    return key.rlike(CODE_KEY)


def is_platform_key(key: Column) -> Column:
    return key.rlike(PLATFORM_KEY)


def title(key: Column, treatment: Column) -> Column:
    return F.format_string("Remove flag %s (always %s)", key, F.when(treatment, "on").otherwise("off"))


def commit_message(key: Column, treatment: Column, reason: Column) -> Column:
    return F.concat(title(key, treatment), F.lit("\n\n"), F.coalesce(reason, F.lit("")))

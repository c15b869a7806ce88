"""Schemas of the core tables. Nothing is inferred: a value of a wrong type is an error, never coerced."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CANDIDATES = _struct(key=_S, reason=_S, treatment=_B, status=_S, blocked_by=T.ArrayType(_S), seq=_L)
FILES = _struct(path=_S, resolved=_S, ignored=_B, content=T.BinaryType())
DECLARATIONS = _struct(path=_S, name=_S, owner=_S, module=_S, key=_S, exported=_B)
REFERENCES = _struct(path=_S, module=_S, owner=_S, name=_S, removable=_B)
FINDINGS = _struct(flag=_S, path=_S, line=_I, kind=_S, reason=_S, text=_S)
REWRITES = _struct(flag=_S, path=_S, before=_S, after=_S, reason=_S)
RESULTS = _struct(
    key=_S, treatment=_B, status=_S, diff=_S, action=_S, pr_url=_S, unprocessed_files=T.ArrayType(_S),
    kept_comments=T.ArrayType(_struct(path=_S, line=_I, text=_S)), refused_files=T.ArrayType(_S),
    refusal_reasons=T.ArrayType(_struct(file=_S, reason=_S)), blocked_by=T.ArrayType(_S), prior_removal=_S, prior_removal_url=_S, seq=_L,
)
COMMENTS = _struct(pull=_L, author=_S, trusted=_B, created_at=T.TimestampType(), body=_S)
MERGED = _struct(branch=_S, base=_S, pull_request=_I, url=_S, merge_commit_sha=_S)
DEPLOYMENTS = _struct(event_id=_L, environment=_S, state=_S, sha=_S)

# Outcomes of a candidate.
ACTIONS = (
    "ignored", "not-selected", "blocked", "engine-error", "unsafe-rewrite", "dry-run", "already-handled",
    "duplicate", "unsafe-key", "no-changes", "pr-opened", "failed",
)

# Languages in order of precedence, with extensions and the spelling of true and false.
LANGUAGES = (
    ("blade", (".blade.php",), "true", "false"),
    ("ts", (".ts", ".mts", ".cts"), "true", "false"),
    ("tsx", (".tsx",), "true", "false"),
    ("js", (".js", ".jsx", ".mjs", ".cjs"), "true", "false"),
    ("java", (".java",), "true", "false"),
    ("go", (".go",), "true", "false"),
    ("python", (".py",), "True", "False"),
    ("kt", (".kt", ".kts"), "true", "false"),
    ("csharp", (".cs",), "true", "false"),
    ("php", (".php",), "true", "false"),
    ("ruby", (".rb", ".rake"), "true", "false"),
    ("erb", (".erb",), "true", "false"),
    ("dart", (".dart",), "true", "false"),
    ("swift", (".swift",), "true", "false"),
)

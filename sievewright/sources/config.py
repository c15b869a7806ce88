"""Run settings from the environment, checked before anything is read."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.keys import CODE_KEY, PLATFORM_KEY


class ConfigError(ValueError):
    """Settings that can't be used."""


# Shapes of accessors and of gates.
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*[?!]?$")
_PLACED = re.compile(r"^(?P<name>[^\[{]+)(?:\[(?P<index>\d+)\]|\{(?P<prop>[A-Za-z_]\w*)\})$")
_GATE = re.compile(r"^(?P<component>[A-Z]\w*(?:\.[A-Z]\w*)*)\[(?P<prop>[A-Za-z_]\w*)(?:\?(?P<show>\w+):(?P<otherwise>\w+))?\]$")


@dataclass(frozen=True)
class Accessor:
    """A function that reads a flag: the place or property of its key, and whether it returns the opposite."""

    name: str
    position: int = 0
    prop: str = ""
    negated: bool = False


@dataclass(frozen=True)
class Gate:
    """A component that shows its children by a flag."""

    component: str
    prop: str
    show: str = ""
    otherwise: str = ""


def items(value: str | None) -> list[str]:
    """Entries between commas and line breaks, trimmed, without repeats, in order."""
    return list(dict.fromkeys(x.strip() for x in re.split(r"[,\n]", value or "") if x.strip()))


def accessors(value: str | None) -> tuple[list[Accessor], list[Gate]]:
    """`name`, `name[1]`, `name{key}`, `!name` (the opposite), `+name` and `Gate[prop]` entries. One name with two meanings is an error."""
    found: dict[str, Accessor] = {}
    gates: list[Gate] = []
    for entry in items(value):
        negated, plain = entry.startswith("!"), entry.removeprefix("+").removeprefix("!")
        if not negated and (m := _GATE.match(plain)):
            gates.append(Gate(m["component"], m["prop"], m["show"] or "", m["otherwise"] or ""))
            continue
        m = _PLACED.match(plain)
        if m and negated:
            raise ConfigError(f"{entry!r}: an accessor that returns the opposite takes no place")
        name = m["name"] if m else plain
        if not _NAME.match(name):
            raise ConfigError(f"{entry!r} is no function name")
        new = Accessor(name, int(m["index"] or 0) if m else 0, (m["prop"] or "") if m else "", negated)
        if found.setdefault(name, new) != new:
            raise ConfigError(f"{name!r} is named with two meanings")
    return list(found.values()), gates


def aliases(value: str | None) -> dict[str, str]:
    """flag=code spellings. Each flag has one spelling, and each spelling belongs to one flag."""
    out: dict[str, str] = {}
    for entry in items(value):
        flag, _, code = (x.strip() for x in entry.partition("="))
        if not flag or not code:
            raise ConfigError(f"{entry!r} isn't flag=code")
        if not re.match(PLATFORM_KEY, flag):
            raise ConfigError(f"{flag!r} is no flag key")
        if not re.match(CODE_KEY, code):
            raise ConfigError(f"{code!r} can't be searched for")
        if flag in out:
            raise ConfigError(f"{flag!r} is named twice")
        if code in out.values():
            raise ConfigError(f"two flags have the spelling {code!r}")
        out[flag] = code
    for flag, code in out.items():
        if code in out and code != flag:
            raise ConfigError(f"the spelling {code!r} of {flag!r} is itself a flag")
    return out


@dataclass(frozen=True)
class Config:
    """Settings of a run."""

    url: str
    token: str = ""
    mode: str = "remove"
    staleness: str = "dead"
    directories: tuple[str, ...] = (".",)
    languages: tuple[str, ...] = ("ts", "tsx", "js")
    ignore: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    accessors: tuple[Accessor, ...] = ()
    gates: tuple[Gate, ...] = ()
    aliases: Mapping[str, str] = field(default_factory=dict)
    max_prs: int = 0
    dry_run: bool = False
    environment: str = "production"
    base: str = "main"
    side_effect_free: tuple[str, ...] = ()


MODES = ("remove", "archive-on-merge", "archive-sweep", "archive-on-deploy", "pr-command")


def from_env(env: Mapping[str, str], prefix: str = "SIEVEWRIGHT_") -> Config:
    """Settings from variables that begin with the prefix."""
    get = lambda k, d="": env.get(prefix + k, d).strip()
    mode = get("MODE", "remove")
    if mode not in MODES:
        raise ConfigError(f"{mode!r} is no mode: {', '.join(MODES)}")
    if not get("URL"):
        raise ConfigError(f"{prefix}URL is missing")
    if get("STALENESS", "dead") not in ("dead", "stale"):
        raise ConfigError(f"the staleness {get('STALENESS')!r} is neither dead nor stale")
    if get("DRY_RUN", "false").lower() not in ("true", "false"):
        raise ConfigError("DRY_RUN is neither true nor false")
    if not re.fullmatch(r"\d+", get("MAX_PRS", "0")):
        raise ConfigError("MAX_PRS is no number")
    reads, gates = accessors(get("ACCESSORS", "isEnabled"))
    return Config(
        get("URL"), get("TOKEN"), mode, get("STALENESS", "dead"), tuple(items(get("DIRECTORIES", "."))), tuple(items(get("LANGUAGES", "ts,tsx,js"))),
        tuple(items(get("IGNORE"))), tuple(items(get("FLAGS"))), tuple(reads), tuple(gates), aliases(get("KEY_ALIASES")), int(get("MAX_PRS", "0")),
        get("DRY_RUN", "false").lower() == "true", get("ENVIRONMENT", "production"), get("BASE", "main"), tuple(items(get("SIDE_EFFECT_FREE_CALLS"))),
    )


def argument_flags(path: str) -> dict[str, object]:
    """A language's engine settings from a TOML file; none where there is no file."""
    file = Path(path)
    return tomllib.loads(file.read_text(encoding="utf-8")) if file.exists() else {}


@dataclass(frozen=True)
class RunContext:
    """Where a run takes place."""

    forge: str
    ci: bool


def run_context(env: Mapping[str, str]) -> RunContext:
    for name, variable in (("github", "GITHUB_ACTIONS"), ("gitlab", "GITLAB_CI"), ("bitbucket", "BITBUCKET_BUILD_NUMBER")):
        if env.get(variable):
            return RunContext(name, True)
    return RunContext("none", bool(env.get("CI")))

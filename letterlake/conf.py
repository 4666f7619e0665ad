"""Settings of an archive from TOML, read on the driver."""

from __future__ import annotations

import os
import re
import subprocess
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A setting is missing, unknown or of the wrong type."""


@dataclass
class Job:
    """One mailbox to back up."""

    name: str
    server: str = ""
    username: str = ""
    password: str = ""
    port: int = 993
    folders: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    delete_after_export: bool = False
    exchange_journal: bool = False


_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expanded(value: str, environment: dict[str, str] | None = None) -> str:
    """``${NAME}`` and ``${NAME:-default}`` replaced; a name without value or default is an error."""
    known = os.environ if environment is None else environment

    def one(m: re.Match) -> str:
        if m[1] in known:
            return known[m[1]]
        if m[2] is None:
            raise ConfigError(f"{m[1]} is not set")
        return m[2]

    return _VARIABLE.sub(one, value)


def _resolved(table: dict[str, Any], allow_exec: bool) -> dict[str, Any]:
    """Values with variables expanded; ``x_cmd`` gives ``x`` the output of a command, if that is allowed."""
    out = {}
    for key, value in table.items():
        if key.endswith("_cmd"):
            if not allow_exec:
                raise ConfigError(f"{key}: commands are not allowed")
            done = subprocess.run(value, shell=isinstance(value, str), capture_output=True, text=True, check=False)
            if done.returncode:
                raise ConfigError(f"{key}: the command failed")
            key, value = key[:-4], done.stdout.strip()
        elif isinstance(value, str):
            value = expanded(value)
        elif isinstance(value, list):
            value = [expanded(v) if isinstance(v, str) else v for v in value]
        out[key] = value
    return out


def _fits(value: Any, hint: str) -> bool:
    if hint.startswith("list"):
        return isinstance(value, list) and all(isinstance(v, str) for v in value)
    # a truth value is no number, although Python counts it as one
    return type(value).__name__ == hint


def jobs(text: str, allow_exec: bool = False) -> list[Job]:
    """The jobs of a TOML text: one table each below ``job``."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    out, hints = [], {f.name: str(f.type) for f in fields(Job)}
    for name, table in data.get("job", {}).items():
        given = {"name": name, **_resolved(table, allow_exec)}
        for key, value in given.items():
            if key not in hints:
                raise ConfigError(f"{name}: unknown setting {key}")
            if not _fits(value, hints[key]):
                raise ConfigError(f"{name}: {key} must be {hints[key]}")
        job = Job(**given)
        if not job.server:
            raise ConfigError(f"{name}: server is missing")
        for pattern in job.exclude:
            try:
                re.compile(pattern)
            except re.error as e:
                raise ConfigError(f"{name}: {pattern}: {e}") from e
        out.append(job)
    return out


def load(path: str, allow_exec: bool = False) -> list[Job]:
    return jobs(Path(path).read_text(encoding="utf-8"), allow_exec)


def wanted_folders(names: list[str], job: Job) -> list[str]:
    """Folders of a server that a job backs up: those asked for, without those that an exclusion matches from their start."""
    return [n for n in names if (not job.folders or n in job.folders) and not any(re.match(p, n) for p in job.exclude)]

"""Where corpora and profiles lie: an explicit folder, else one under a home, else under the working folder."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Folders:
    corpus: str
    profiles: str


def folders(env: Mapping[str, str] | None = None, start: str | None = None) -> Folders:
    """SCRIVANO_CORPUS and SCRIVANO_PROFILES win over SCRIVANO_HOME; then the nearest folder upwards with a pyproject.toml,
    then the working folder."""
    env = os.environ if env is None else env
    here = Path(start or os.getcwd())
    root = env.get("SCRIVANO_HOME") or next((str(p) for p in (here, *here.parents) if (p / "pyproject.toml").exists()), str(here))
    return Folders(env.get("SCRIVANO_CORPUS") or f"{root}/corpus", env.get("SCRIVANO_PROFILES") or f"{root}/profiles")


def transcript_root(path: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The folder of transcripts: the given one, else that of the environment, else the usual place in the home folder."""
    env = os.environ if env is None else env
    return os.path.expanduser(path or (f"{env['CLAUDE_CONFIG_DIR']}/projects" if env.get("CLAUDE_CONFIG_DIR") else "~/.claude/projects"))

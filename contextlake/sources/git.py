"""Ignore files outside the tree that version control knows of: the user's global one and the repository's own. No process is started; all are small files read on the driver."""

from __future__ import annotations

import os
import re
from pathlib import Path

from contextlake.operators.rules import Layer


def _text(path: Path) -> str | None:
    try:
        return path.read_text(encoding="utf-8", errors="replace")
    except OSError:
        return None


def repository_folder(start: str) -> Path | None:
    """The .git folder of the nearest directory upwards that has one, or where its .git file points."""
    here = Path(start).resolve()
    for place in (here, *here.parents):
        at = place / ".git"
        if at.is_dir():
            return at
        if at.is_file() and (pointer := re.search(r"^gitdir:[ \t]*(.+)$", _text(at) or "", re.MULTILINE)):
            return place / pointer[1].strip()
    return None


def common_folder(folder: Path | None) -> Path | None:
    """Of a linked worktree the folder that all worktrees share."""
    named = (_text(folder / "commondir") or "").strip() if folder else ""
    return folder / named if folder and named else folder


def excludes_setting(config: str | None) -> str | None:
    """The last core.excludesFile of a configuration, in any spelling; quotes and comments taken off."""
    section, out = "", None
    for line in (config or "").split("\n"):
        line = line.strip()
        if head := re.match(r"\[\s*([^\]\"\s]+)", line):
            section = head[1].lower()
        elif section == "core" and (setting := re.match(r"excludesfile\s*=\s*(.*)$", line, re.IGNORECASE)):
            value = setting[1].strip()
            value = value[1:].split('"')[0] if value.startswith('"') else re.sub(r"\s+[#;].*$", "", value).strip()
            out = value or out
    return out


def global_excludes(folder: Path | None, environment: dict | None = None) -> Path | None:
    """The user's ignore file: of the first configuration that names one (none if that one cannot be read), else the default place."""
    environment = os.environ if environment is None else environment
    home = Path(environment.get("HOME", os.path.expanduser("~")))
    user = Path(environment.get("XDG_CONFIG_HOME") or home / ".config")
    for config in ([folder / "config"] if folder else []) + [home / ".gitconfig", user / "git" / "config"]:
        if named := excludes_setting(_text(config)):
            at = home / named[2:] if named[:2] in ("~/", "~\\") else home if named == "~" else Path(named).absolute()
            return at if _text(at) is not None else None
    default = user / "git" / "ignore"
    return default if _text(default) is not None else None


def exclude_layers(root: str, environment: dict | None = None) -> list[Layer]:
    """Layers of the global file and of info/exclude, in rising precedence; what does not exist gives none."""
    folder = common_folder(repository_folder(root))
    found = [("global-gitignore", global_excludes(folder, environment)), ("git-info-exclude", folder / "info" / "exclude" if folder else None)]
    return [Layer(kind, tuple(text.split("\n")), source=str(at)) for kind, at in found if at and (text := _text(at))]

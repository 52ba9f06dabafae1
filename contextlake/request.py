"""What is asked for: selection, budgets, contents; profiles and where each setting came from."""

from __future__ import annotations

import configparser
import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from contextlake import constants as C
from contextlake.functions.sizes import parse_size
from contextlake.operators.budgets import checked_budget
from contextlake.operators.order import SORT_KEYS


class ContextError(Exception):
    """Base of errors; exit_code is the process's."""

    exit_code = 1


class InvalidOption(ContextError, ValueError):
    exit_code = 2


class PolicyFailure(ContextError):
    exit_code = 3


class ProfileNotFound(InvalidOption):
    pass


class SecretsDetected(PolicyFailure):
    """findings say where and of which rule, never what."""

    def __init__(self, message: str, findings: list[dict]):
        super().__init__(message)
        self.findings = findings


class Interrupted(ContextError):
    exit_code = 130


#: options of which one at most can be asked for, and options that need another
CONFLICTS = (("only_tree", "line_numbers"), ("only_tree", "redact"), ("binary", "only_tree"))
REQUIRES = (("fail_on_secrets", "redact"), ("secret_oversize", "redact"), ("keep_oversized_first", "max_total_size"))


@dataclass(frozen=True)
class Budget:
    value: int | None
    source: str = "default"


@dataclass(frozen=True)
class Request:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    force_include: tuple[str, ...] = ()
    profile_include: tuple[str, ...] = ("**/*",)
    profile_exclude: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    scopes: tuple[str, ...] = ()
    max_depth: int | None = None
    include_hidden: bool = False  # accepted; nothing in discovery reads it
    tests: bool = True
    respect_gitignore: bool = True
    git_filter: str | None = None
    sort: str = "path"
    descending: bool = False
    max_file_size: int = C.MAX_FILE_SIZE
    size_gate: int | None = C.SIZE_GATE
    max_files: Budget = Budget(C.MAX_FILE_COUNT)
    max_total_size: Budget = Budget(C.MAX_TOTAL_SIZE)
    max_chars: Budget = Budget(None)
    keep_oversized_first: bool = False
    deduplicate: bool = False
    redact: str | None = None  # typed, generic or hash
    redact_inline: bool = True  # otherwise files with secrets are left out
    secret_oversize: str = "exclude"
    secret_max_bytes: int = C.SECRET_MAX_FILE_BYTES
    fail_on_secrets: bool = False
    dotfiles: bool = True  # configuration that tells how to run a project is forced in
    binary: str | None = None
    format: str = "xml"
    only_tree: bool = False
    line_numbers: bool = False
    fail_empty: bool = False
    fail_on_truncation: bool = False
    fail_on_unreadable: bool = False
    strict: bool = False

    def __post_init__(self):
        if self.sort not in SORT_KEYS:
            raise InvalidOption(f"unknown sort key {self.sort!r}")
        if self.git_filter not in (None, "modified", "staged", "changed"):
            raise InvalidOption(f"unknown change filter {self.git_filter!r}")
        if self.redact not in (None, "typed", "generic", "hash"):
            raise InvalidOption(f"unknown redaction {self.redact!r}")
        if self.secret_oversize not in ("exclude", "scan", "fail"):
            raise InvalidOption(f"unknown policy {self.secret_oversize!r}")
        if self.line_numbers and self.only_tree:
            raise InvalidOption("line numbers need contents")

    def forced_globs(self) -> tuple[str, ...]:
        return self.force_include + (C.FORCE_INCLUDE_DOTFILES if self.dotfiles else ())

    def exactness(self) -> dict[str, str]:
        """How far a plan, which reads no contents, agrees with a run."""
        return {"selection": "exact", "sizes": "exact", "characters": "estimated-from-bytes", "deduplication": "not-evaluated" if self.deduplicate else "exact", "secrets": "not-evaluated" if self.redact else "exact"}


_BUDGETS = {"max_files": True, "max_total_size": True, "max_chars": False}
PROFILE_KEYS = {"name", "include", "exclude", "forceInclude", "options", "transformers", "version", "description"}


@dataclass
class Profile:
    name: str = "default"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    force_include: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)

    def over(self, below: Profile) -> Profile:
        """This one laid over another: excludes and forced globs add up, includes replace, options merge."""
        return Profile(self.name, self.include or below.include, below.exclude + self.exclude, below.force_include + self.force_include, below.options | self.options)


def read_profile(path: str) -> Profile:
    """A JSON, YAML (if PyYAML is there) or INI profile; unknown keys other than x-... are errors."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(raw)
    elif path.endswith((".yml", ".yaml")):
        import yaml

        data = yaml.safe_load(raw) or {}
    else:
        ini = configparser.ConfigParser(allow_no_value=True, delimiters=("=",))
        ini.optionxform = str
        ini.read_string(raw)
        data = {k: list(ini[k]) for k in ("include", "exclude", "forceInclude") if k in ini} | ({"options": dict(ini["options"])} if "options" in ini else {}) | (dict(ini["profile"]) if "profile" in ini else {})
    if unknown := [k for k in data if k not in PROFILE_KEYS and not k.startswith("x-")]:
        raise InvalidOption(f"unknown profile keys: {', '.join(sorted(unknown))}")
    return Profile(data.get("name", Path(path).stem), list(data.get("include", [])), list(data.get("exclude", [])), list(data.get("forceInclude", [])), dict(data.get("options", {})))


def find_profile(root: str, name: str | None = None) -> str | None:
    """The automatic profile's file of a root, or a named one's; the first of the known endings that exists."""
    stem = f"{C.PROFILE_FILE}-{name}" if name else C.PROFILE_FILE
    places = [Path(root), *([Path(root, f"{C.PROFILE_FILE}s")] if name else [])]
    for place, base in [(places[0], stem), *((p, name) for p in places[1:])]:
        for ending in (".yml", ".yaml", ".json", ".ini", ""):
            if (place / f"{base}{ending}").is_file():
                return str(place / f"{base}{ending}")
    return None


def load_profile(root: str, name: str | None = None) -> Profile:
    """The automatic profile of a root, with the named one laid over it. A missing automatic one is no error, a missing named one is."""
    automatic, named = find_profile(root), find_profile(root, name) if name else None
    if name and not named:
        raise ProfileNotFound(f"profile not found: {name}")
    below = read_profile(automatic) if automatic else Profile()
    return read_profile(named).over(below) if named else below


def read_instructions(name: str, folders: tuple[str, ...] = ()) -> str:
    """A named text for the reader of a document: the first ``name.md`` or ``name.txt`` in the folders, else the packaged default."""
    for folder in folders:
        for ending in (".md", ".txt"):
            if (at := Path(folder, f"{name}{ending}")).is_file():
                return at.read_text(encoding="utf-8")
    if name == "default":
        return C.DEFAULT_INSTRUCTIONS
    raise InvalidOption(f"instructions not found: {name}")


def layered_options(paths: tuple[str, ...], options: dict | None = None) -> dict:
    """Options of JSON or YAML files, later over earlier, and the given ones over all; a key that no request has is an error."""
    known, out = {f.name for f in fields(Request)}, {}
    for path in paths:
        raw = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yml", ".yaml")):
            import yaml

            data = yaml.safe_load(raw) or {}
        else:
            data = json.loads(raw)
        if not isinstance(data, dict) or (unknown := [k for k in data if k not in known]):
            raise InvalidOption(f"{path}: {'not an object' if not isinstance(data, dict) else 'unknown options: ' + ', '.join(sorted(unknown))}")
        out |= data
    return out | (options or {})


def checked_together(options: dict) -> None:
    """Options that exclude each other, or that mean nothing alone, are an error."""
    given = {k for k, v in options.items() if v not in (None, False)}
    for a, b in CONFLICTS:
        if {a, b} <= given:
            raise InvalidOption(f"{a} and {b} cannot be combined")
    for a, b in REQUIRES:
        if a in given and b not in given:
            raise InvalidOption(f"{a} requires {b}")


def _format(value) -> str | None:
    """A profile's format if it is a known one; others are passed over."""
    name = {"md": "markdown"}.get(str(value).lower(), str(value).lower())
    return name if name in C.DOCUMENT_OVERHEAD else None


def build_request(options: dict | None = None, profile: Profile | None = None) -> Request:
    """Options win over the profile, the profile over defaults; each budget keeps where it came from."""
    options, profile = dict(options or {}), profile or Profile()
    known = {f.name for f in fields(Request)}
    if unknown := [k for k in (*options, *profile.options) if k not in known]:
        raise InvalidOption(f"unknown options: {', '.join(sorted(unknown))}")
    checked_together(options)
    preset = dict(profile.options)
    if "format" in preset and (chosen := _format(preset.pop("format"))):
        preset["format"] = chosen
    settings: dict = {}
    for source, values in (("profile", preset), ("option", options)):
        for key, value in values.items():
            if key in _BUDGETS:
                if isinstance(value, str) and key == "max_total_size":
                    value = parse_size(value)
                value = Budget(checked_budget(value, key, _BUDGETS[key]), source)
            settings[key] = tuple(value) if isinstance(value, list) else value
    request = replace(Request(), **settings)
    return replace(request, profile_include=tuple(profile.include) or request.profile_include, profile_exclude=request.profile_exclude + tuple(profile.exclude), force_include=request.force_include + tuple(profile.force_include), only_tree=request.only_tree or request.format == "tree")

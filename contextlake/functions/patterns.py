"""Ignore rules and globs as regular expressions for rlike, compiled once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SPECIAL = set(".^$+{}()|\\")


def _class(pattern: str, i: int) -> tuple[str, int] | None:
    """The character class that starts at i, and where it ends."""
    end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "^", "]") else i + 1)
    if end < 0:
        return None
    body = pattern[i + 1 : end]
    negated = body[:1] in ("!", "^")
    body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
    return f"[{'^/' if negated else ''}{body}]", end + 1


def _group(pattern: str, i: int, marks: str = "(|)") -> tuple[list[str], int] | None:
    """The alternatives of the group whose bracket opens at i, and where it ends; groups may hold groups and classes."""
    opening, between, closing = marks
    alternatives, start, depth = [], i + 1, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[" and (found := _class(pattern, i)):
            i = found[1] - 1
        elif pattern[i] == opening:
            depth += 1
        elif pattern[i] in (between, closing) and depth == 1:
            alternatives.append(pattern[start:i])
            start = i + 1
            if pattern[i] == closing:
                return alternatives, i + 1
        elif pattern[i] == closing:
            depth -= 1
        i += 1
    return None


def _range(pattern: str, i: int) -> tuple[str, int] | None:
    """The numbers or letters of {a..b} at i, and where it ends."""
    found = re.match(r"\{(?:(-?\d+)\.\.(-?\d+)|([A-Za-z])\.\.([A-Za-z]))\}", pattern[i:])
    if not found:
        return None
    low, high = (int(found[1]), int(found[2])) if found[1] else (ord(found[3]), ord(found[4]))
    values = range(min(low, high), max(low, high) + 1)
    return "(?:" + "|".join(str(v) if found[1] else chr(v) for v in values) + ")", i + found.end()


def _body(pattern: str, braces: bool) -> str:
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if braces and c in "@?*+!" and pattern[i + 1 : i + 2] == "(" and (found := _group(pattern, i + 1)):
            inner = "(?:" + "|".join(_body(a, braces) for a in found[0]) + ")"
            if c == "!":  # anything in the segment, but not what an alternative and the rest would be
                rest = _body(pattern[found[1] :], braces)
                return "".join(out) + f"(?!{inner}{rest}$)[^/]*?{rest}"
            out.append(inner + c.replace("@", ""))
            i = found[1]
            continue
        if braces and c == "{" and (span := _range(pattern, i)):
            out.append(span[0])
            i = span[1]
            continue
        if braces and c == "{" and "!(" in pattern[i:] and (found := _group(pattern, i, "{,}")):
            # what an exclusion looks ahead to goes on behind the braces, so each alternative is written out to the end
            return "".join(out) + "(?:" + "|".join(_body(a + pattern[found[1] :], braces) for a in found[0]) + ")"
        if pattern.startswith("**", i):
            j = i
            while pattern[j : j + 1] == "*":
                j += 1
            if (i == 0 or pattern[i - 1] == "/") and pattern[j : j + 1] == "/":
                out.append("(?:[^/]+/)*")
                i = j + 1
            elif (i == 0 or pattern[i - 1] == "/") and j == len(pattern):
                out.append(".+")
                i = j
            else:
                out.append("[^/]*")
                i = j
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (found := _class(pattern, i)):
            out.append(found[0])
            i = found[1]
            continue
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif braces and c == "{" and "}" in pattern[i:]:
            out.append("(?:")
            depth += 1
        elif depth and c == "}":
            out.append(")")
            depth -= 1
        elif depth and c == ",":
            out.append("|")
        else:
            out.append("\\" + c if c in _SPECIAL or c == "[" else c)
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class IgnoreRule:
    """A compiled line of an ignore file; regex is matched against paths relative to the file's directory."""

    pattern: str
    regex: str
    negated: bool
    directories_only: bool


def ignore_rule(line: str) -> IgnoreRule | None:
    """None for blank lines and comments."""
    text = line.rstrip("\r\n")
    text = re.sub(r"(?<!\\)[ \t]+$", "", text)
    if not text or text.startswith("#"):
        return None
    pattern, negated = text, text.startswith("!")
    text = text[1:] if negated else text
    text = text[1:] if text[:2] in ("\\#", "\\!") else text
    directories_only = text.endswith("/")
    text = text.rstrip("/") if directories_only else text
    anchored = "/" in text
    text = text.lstrip("/")
    if not text:
        return None
    regex = _body(text, braces=False)
    return IgnoreRule(pattern, f"^{regex}$" if anchored else f"^(?:.*/)?{regex}$", negated, directories_only)


def glob_regex(pattern: str, dot: bool = True) -> str:
    """A glob over whole paths, with braces, ranges {1..3}, groups @() ?() *() +() !() and ``**``; without dot, no segment that a wildcard starts may begin with a dot."""
    body = _body(pattern.removeprefix("./"), braces=True)
    if pattern.endswith("/**"):
        body = _body(pattern.removeprefix("./")[:-3], braces=True) + "(?:/.*)?"
    hidden = "" if dot or re.search(r"(^|/)\.", pattern) else r"(?!(?:.*/)?\.[^/])"
    return f"^{hidden}{body}$"


def include_lines(text: str) -> list[str]:
    """Globs of a force-include file: a bare name matches at any depth, a leading slash anchors."""
    out: list[str] = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            anchored, bare = line.startswith("/"), line.strip("/")
            out += [bare, f"{bare}/**"] if anchored or "/" in bare else [f"**/{bare}", f"**/{bare}/**"]
    return out

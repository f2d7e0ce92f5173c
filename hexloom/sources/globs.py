"""Globs of the walk and rules of ignore files, as patterns of the engine's regular expressions."""

from __future__ import annotations

import re

#: Bytes that a glob has at most.
MAX_GLOB_BYTES = 256


class GlobError(ValueError):
    """A glob that is too long or has an open bracket."""


def _members(s: str) -> str:
    """What stands between the brackets of a class."""
    negated, s = s[:1] in ("!", "^"), s[1:] if s[:1] in ("!", "^") else s
    return f"[{'^' if negated else ''}{''.join(c if c == '-' or c.isalnum() else re.escape(c) if not c.isspace() else c for c in s)}]"


def _translate(glob: str, one: str) -> str:
    """A glob as a pattern; one: what a single wildcard character may be."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c, rest = glob[i], glob[i:]
        start = i == 0
        if rest.startswith("**/") and (start or glob[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if rest == "**" and (start or glob[i - 1] == "/"):
            out.append(".+")
            i += 2
            continue
        if c == "*":
            out.append(f"{one}*")
        elif c == "?":
            out.append(one)
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise GlobError(f"{glob!r}: a class is open")
            out.append(_members(glob[i + 1 : end]))
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise GlobError(f"{glob!r}: a group is open")
    return "".join(out)


def glob_set(globs: list[str] | tuple[str, ...]) -> str | None:
    """One pattern for paths that match any of the globs, of which * and ? go over folders; None if there are none."""
    for g in globs:
        if len(g.encode()) > MAX_GLOB_BYTES:
            raise GlobError(f"{g[:40]!r}...: more than {MAX_GLOB_BYTES} bytes")
    return "(?s)^(?:" + "|".join(_translate(g, ".") for g in globs) + ")$" if globs else None


def ignore_rules(folder: str, text: str) -> list[tuple[str, bool, bool]]:
    """The rules of an ignore file in a folder, as (pattern of paths from the root, negated, folders only).

    Blank lines, comments and lines that are no glob are left out.
    """
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line[1:] if line.startswith("!") else line
        folders, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        anchored, line = "/" in line, line.lstrip("/")
        base = re.escape(folder) + "/" if folder else ""
        # braces are no groups in ignore files
        plain = re.sub(r"(?<!\\)([{}])", r"\\\1", line)
        try:
            out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{_translate(plain, '[^/]')}$", negated, folders))
        except GlobError:
            continue
    return out


def ignored(path: str, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    """Whether the last rule for a file, or for a folder above it, leaves it out. Rules: the most binding ones first."""
    parts = path.split("/")
    return any(_left_out("/".join(parts[:n]), n < len(parts), rules) for n in range(1, len(parts) + 1))


def _left_out(at: str, folder: bool, rules: list[tuple[re.Pattern, bool, bool]]) -> bool:
    return next((not negated for p, negated, folders in rules if (folder or not folders) and p.match(at)), False)

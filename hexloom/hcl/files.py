"""The functions that look at files, over the texts and paths that a workspace's scan has brought along.

Nothing is read from a disk here: expressions are evaluated in tasks, on any machine. Paths are relative to the root,
and those outside of it have no value, so that the call stays symbolic.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable

from hexloom.hcl import functions as fn

_HOLE = re.compile(r"\$\$\{|\$\{([^}]*)\}|\$\{")


def render_template(text: str, values: dict[str, object]) -> str:
    """A template with its plain names replaced by texts; `$${` stands for `${`."""

    def one(m: re.Match) -> str:
        if m[0] == "$${":
            return "${"
        name = (m[1] or "").strip()
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or not isinstance(values.get(name), str):
            raise fn.CallError(f"the template's {m[0]} has no text")
        return values[name]

    return _HOLE.sub(one, text)


def glob_pattern(pattern: str) -> re.Pattern:
    """A glob as a pattern: ** goes over folders, * and ? stay within one."""
    parts = re.split(r"(\*\*/?|\*|\?|\{[^{}]*\})", pattern)
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = [known[p] if p in known else "(?:" + "|".join(map(re.escape, p[1:-1].split(","))) + ")" if p.startswith("{") and p.endswith("}") else re.escape(p) for p in parts]
    return re.compile("".join(out), re.S)


def functions_over(texts: dict[str, str | None], complete: bool, root: str) -> dict[str, tuple[int, Callable]]:
    """file, fileexists, templatefile and fileset. texts: by path, None where only the path is known; complete: whether
    all paths under the root are in it."""

    def inside(path) -> str:
        if not isinstance(path, str) or "\0" in path:
            raise fn.CallError("a path is expected")
        full = posixpath.normpath(path if path.startswith("/") else posixpath.join(root, path))
        out = posixpath.relpath(full, root)
        if out.startswith(".."):
            raise fn.CallError(f"{path} lies outside of the root")
        return "" if out == "." else out

    def text(path) -> str:
        found = texts.get(inside(path))
        if found is None:
            raise fn.CallError(f"{path} has no text")
        return found

    def exists(path) -> bool:
        at = inside(path)
        if at in texts:
            return True
        if not complete:
            raise fn.CallError("not all paths are known")
        return any(x.startswith(at + "/") for x in texts) or at == ""

    def template(path, values) -> str:
        if not fn.is_map(values):
            raise fn.CallError("a map is expected")
        return render_template(text(path), {k: v for k, v in values["m"]})

    def listed(folder, pattern) -> list[str]:
        if not complete or not isinstance(pattern, str):
            raise fn.CallError("not all paths are known")
        at, match = inside(folder), glob_pattern(pattern)
        base = at + "/" if at else ""
        return sorted(x.removeprefix(base) for x in texts if x.startswith(base) and match.fullmatch(x.removeprefix(base)))

    return {"file": (1, text), "fileexists": (1, exists), "templatefile": (2, template), "fileset": (2, listed)}

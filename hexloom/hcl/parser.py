"""A parser for HCL text: blocks with bodies of expression nodes.

A node is a JSON-able list, its first item the kind: lit, sym, bin, un, tpl, arr, obj, call, cond, for. A map value
is {"m": [[key, value], ...]}, in source order, duplicates kept.
"""

from __future__ import annotations

import bisect
import re

_IDENT = re.compile(r"[A-Za-z_][\w-]*")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_SKIP = re.compile(r"(?:[ \t\r]|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_SKIP_LINES = re.compile(r"(?:[ \t\r\n]|#[^\n]*|//[^\n]*|/\*.*?\*/)*", re.S)
_HEREDOC = re.compile(r"<<(-?)([A-Za-z_][\w-]*)[ \t\r]*\n")
#: Binary operators by precedence, weakest first, and their names.
_LEVELS = [[("||", "Or")], [("&&", "And")], [("==", "Eq"), ("!=", "Ne")], [("<=", "Le"), (">=", "Ge"), ("<", "Lt"), (">", "Gt")], [("+", "Add"), ("-", "Sub")], [("*", "Mul"), ("/", "Div"), ("%", "Mod")]]
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}
#: What references are, by their beginnings.
_SYMBOLS = {"var.": "Var", "local.": "Local", "data.": "Data", "module.": "Module", "path.": "Path", "each.": "Iteration", "count.": "Iteration", "terraform.": "Terraform", "dependency.": "TerragruntDependency"}
MAX_DEPTH = 64


class HclError(ValueError):
    pass


def symbol(source: str) -> list:
    kind = next((k for p, k in _SYMBOLS.items() if source.startswith(p)), None)
    return ["sym", kind or ("Resource" if "." in source[1:] and source[0] != "." else "Other"), source]


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0
        self.lines = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    def where(self, at: int) -> tuple[int, int]:
        """Line and byte column, from 1."""
        k = bisect.bisect_right(self.lines, at) - 1
        return k + 1, len(self.text[self.lines[k] : at].encode()) + 1

    def fail(self, what: str):
        line, column = self.where(self.at)
        raise HclError(f"{what} at line {line}, column {column}")

    def skip(self, lines: bool = True) -> None:
        self.at = (_SKIP_LINES if lines else _SKIP).match(self.text, self.at).end()

    def take(self, s: str) -> bool:
        if self.text.startswith(s, self.at):
            self.at += len(s)
            return True
        return False

    def need(self, s: str) -> None:
        self.skip()
        if not self.take(s):
            self.fail(f"expected {s!r}")

    def ident(self) -> str | None:
        m = _IDENT.match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    # bodies

    def body(self, end: str = "") -> list[dict]:
        """Attributes {name, node} and blocks {name, labels, body}, each with its place."""
        out = []
        while True:
            self.skip()
            if self.at >= len(self.text):
                if end:
                    self.fail(f"expected {end!r}")
                return out
            if end and self.take(end):
                return out
            start, name = self.at, self.ident()
            if name is None:
                self.fail("expected a name")
            line, column = self.where(start)
            self.skip(lines=False)
            if self.text.startswith("=", self.at) and not self.text.startswith("==", self.at):
                self.at += 1
                out.append({"name": name, "node": self.expression(), "line": line, "column": column})
                continue
            labels = []
            while not self.take("{"):
                if self.text.startswith('"', self.at):
                    part = self.quoted()
                    labels.append(part[1] if part[0] == "lit" else "")
                else:
                    label = self.ident()
                    if label is None:
                        self.fail("expected a label or a block")
                    labels.append(label)
                self.skip(lines=False)
            out.append({"name": name, "labels": labels, "body": self.body("}"), "line": line, "column": column})

    # expressions

    def expression(self, lines: bool = False) -> list:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            self.fail("nested too deeply")
        node = self.binary(0, lines)
        self.skip(lines)
        if self.take("?"):
            self.skip()
            yes = self.expression(True)
            self.need(":")
            self.skip()
            node = ["cond", node, yes, self.expression(lines)]
        self.depth -= 1
        return node

    def binary(self, level: int, lines: bool) -> list:
        if level == len(_LEVELS):
            return self.unary(lines)
        node = self.binary(level + 1, lines)
        while True:
            self.skip(lines)
            for sign, name in _LEVELS[level]:
                if self.text.startswith(sign, self.at) and not (sign in "/" and self.text[self.at : self.at + 2] in ("//", "/*")):
                    self.at += len(sign)
                    self.skip()
                    node = ["bin", name, node, self.binary(level + 1, lines)]
                    break
            else:
                return node

    def unary(self, lines: bool) -> list:
        self.skip(lines)
        for sign, name in (("-", "Neg"), ("!", "Not")):
            if self.text.startswith(sign, self.at) and not self.text.startswith("!=", self.at):
                self.at += 1
                return ["un", name, self.unary(lines)]
        return self.postfix()

    def postfix(self) -> list:
        start = self.at
        node, root = self.primary()
        source, steps = root, False
        while True:
            if self.take("[*]"):
                source, steps = source + "[*]", True
            elif self.text.startswith("[", self.at):
                self.at += 1
                self.skip()
                begin = self.at
                inner = self.expression(True)
                shown = self._shown(inner, self.text[begin : self.at].strip())
                self.need("]")
                source, steps = f"{source}[{shown}]", True
            elif self.take(".*"):
                source, steps = source + ".*", True
            elif m := re.compile(r"\.([0-9]+)").match(self.text, self.at):
                self.at = m.end()
                source, steps = f"{source}[{m[1]}]", True
            elif (m := re.compile(r"\.([A-Za-z_][\w-]*)").match(self.text, self.at)) and not self.text.startswith("...", self.at):
                self.at = m.end()
                source, steps = f"{source}.{m[1]}", True
            else:
                break
        assert self.at > start
        return symbol(source) if steps else node

    @staticmethod
    def _shown(node: list, text: str) -> str:
        if node[0] == "lit":
            v = node[1]
            return f'"{v}"' if isinstance(v, str) else "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        return node[2] if node[0] == "sym" else f"{node[1]}(...)" if node[0] == "call" else "<expr>"

    def primary(self) -> tuple[list, str]:
        """A node, and how it is shown as the root of a reference."""
        t = self.text
        if self.take("("):
            self.skip()
            node = self.expression(True)
            self.need(")")
            return node, self._shown(node, "")
        if t.startswith('"', self.at):
            node = self.quoted()
            return node, self._shown(node, "")
        if m := _HEREDOC.match(t, self.at):
            return self.heredoc(m), "<expr>"
        if m := _NUMBER.match(t, self.at):
            self.at = m.end()
            if re.fullmatch("[0-9]+", m[0]):
                return ["lit", min(int(m[0]), 2**63 - 1)], m[0]
            return ["lit", float(m[0])], m[0]
        if self.take("["):
            return self.bracket(), "<expr>"
        if self.take("{"):
            return self.brace(), "<expr>"
        name = self.ident()
        if name is None:
            self.fail("expected an expression")
        while self.take("::"):
            name += "::" + (self.ident() or self.fail("expected a function"))
        if t.startswith("(", self.at):
            self.at += 1
            args = self.items(")")
            return ["call", name, args], f"{name}(...)"
        if name in ("true", "false", "null"):
            return ["lit", {"true": True, "false": False, "null": None}[name]], name
        return ["sym", "Other", name], name

    def items(self, end: str) -> list:
        out = []
        while True:
            self.skip()
            if self.take(end):
                return out
            out.append(self.expression(True))
            self.skip()
            self.take("...")
            self.skip()
            if not self.take(","):
                self.need(end)
                return out

    def _for(self) -> tuple | None:
        """The head of a for expression, if one begins here."""
        self.skip()
        if not re.compile(r"for[ \t\r\n]").match(self.text, self.at):
            return None
        self.at += 3
        binders = []
        while True:
            self.skip()
            binders.append(self.ident() or self.fail("expected a name"))
            self.skip()
            if not self.take(","):
                break
        if self.ident() != "in":
            self.fail("expected in")
        self.skip()
        collection = self.expression(True)
        self.need(":")
        self.skip()
        return binders, collection

    def _if(self):
        self.skip()
        if re.compile(r"if\b").match(self.text, self.at):
            self.at += 2
            self.skip()
            return self.expression(True)
        return None

    def bracket(self) -> list:
        if head := self._for():
            value = self.expression(True)
            cond = self._if()
            self.need("]")
            return ["for", head[0], head[1], None, value, cond, False]
        items = self.items("]")
        return ["lit", [x[1] for x in items]] if all(x[0] == "lit" for x in items) else ["arr", items]

    def brace(self) -> list:
        if head := self._for():
            key = self.expression(True)
            self.need("=>")
            self.skip()
            value = self.expression(True)
            self.skip()
            self.take("...")
            cond = self._if()
            self.need("}")
            return ["for", head[0], head[1], key, value, cond, True]
        entries = []
        while True:
            self.skip()
            if self.take("}"):
                break
            m = re.compile(r"([A-Za-z_][\w-]*)[ \t\r]*(?==[^=]|:)").match(self.text, self.at)
            if m:
                key, self.at = ["lit", m[1]], m.end()
            else:
                key = self.expression(True)
            self.skip()
            if not (self.take("=") or self.take(":")):
                self.fail("expected = or :")
            self.skip()
            entries.append([key, self.expression()])
            self.skip(lines=False)
            self.take(",")
        return collapse_object(entries)

    # templates

    def quoted(self) -> list:
        self.at += 1
        return collapse_template(self.template(lambda: self.take('"'), True))

    def template(self, done, escapes: bool) -> list:
        parts, plain = [], []

        def flush():
            if plain:
                parts.append(["lit", "".join(plain)])
                plain.clear()

        while not done():
            t, i = self.text, self.at
            if i >= len(t):
                self.fail("a string does not end")
            if t.startswith(("$${", "%%{"), i):
                plain.append(t[i + 1 : i + 3])
                self.at += 3
            elif t.startswith("${", i):
                flush()
                self.at += 2
                self.take("~")
                self.skip()
                parts.append(self.expression(True))
                self.skip()
                self.take("~")
                self.need("}")
            elif t.startswith("%{", i):
                flush()
                self.at = t.find("}", i) + 1 or self.fail("a directive does not end")
                parts.append(["sym", "Other", "<template-directive>"])
            elif escapes and t[i] == "\\":
                c = t[i + 1 : i + 2]
                if c in ("u", "U"):
                    n = 4 if c == "u" else 8
                    plain.append(chr(int(t[i + 2 : i + 2 + n], 16)))
                    self.at += 2 + n
                elif c in _ESCAPES:
                    plain.append(_ESCAPES[c])
                    self.at += 2
                else:
                    self.fail("unknown escape")
            elif escapes and t[i] == "\n":
                self.fail("a string does not end on its line")
            else:
                plain.append(t[i])
                self.at += 1
        flush()
        return parts

    def heredoc(self, m: re.Match) -> list:
        end = re.compile(r"^[ \t]*" + re.escape(m[2]) + r"[ \t\r]*$", re.M).search(self.text, m.end())
        if end is None:
            self.fail("a heredoc does not end")
        body = self.text[m.end() : end.start()]
        if m[1]:
            indents = [len(x) - len(x.lstrip(" \t")) for x in body.split("\n") if x.strip()]
            k = min(indents, default=0)
            body = "\n".join(x[min(k, len(x) - len(x.lstrip(" \t"))) :] for x in body.split("\n"))
        inner = Parser(body)
        inner.depth = self.depth
        parts = inner.template(lambda: inner.at >= len(inner.text), False)
        self.at = end.end()
        return collapse_template(parts)


def collapse_template(parts: list) -> list:
    if not parts:
        return ["lit", ""]
    return parts[0] if len(parts) == 1 and parts[0][0] == "lit" and isinstance(parts[0][1], str) else ["tpl", parts]


def collapse_object(entries: list) -> list:
    if all(k[0] == "lit" and isinstance(k[1], str) and v[0] == "lit" for k, v in entries):
        return ["lit", {"m": [[k[1], v[1]] for k, v in entries]}]
    return ["obj", entries]


def attributes(body: list[dict]) -> list:
    """[name, node] of a body; a nested block is an object, its labels under __labels__."""
    out = []
    for x in body:
        if "node" in x:
            out.append([x["name"], x["node"]])
            continue
        entries = [[["lit", k], v] for k, v in attributes(x["body"])]
        if x["labels"]:
            entries = [[["lit", "__labels__"], ["arr", [["lit", s] for s in x["labels"]]]], *entries]
        out.append([x["name"], collapse_object(entries) if not x["labels"] else ["obj", entries]])
    return out


def parse(text: str) -> list[dict]:
    return Parser(text.removeprefix("﻿")).body()

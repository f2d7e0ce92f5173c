"""Canonical JSON of nodes and values: sorted keys, no white space, shortest floats."""

from __future__ import annotations

import math


def number(f: float) -> str:
    """The shortest text that reads back as the same float: 1e16, 0.1, 1.0."""
    if not math.isfinite(f):
        return "null"
    text = repr(f)
    if "e" not in text:
        return text
    mantissa, exponent = text.split("e")
    return f"{mantissa.removesuffix('.0')}e{int(exponent)}"


_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quote(s: str) -> str:
    return '"' + "".join(_SHORT.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def _object(pairs: list[tuple[str, str]]) -> str:
    return "{" + ",".join(f"{quote(k)}:{v}" for k, v in sorted(pairs, key=lambda p: p[0].encode())) + "}"


def value(v) -> str:
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return number(v)
    if isinstance(v, str):
        return quote(v)
    if isinstance(v, dict):
        return _object([(k, value(x)) for k, x in v["m"]])
    return "[" + ",".join(map(value, v)) + "]"


def node(e: list) -> str:
    kind = e[0]
    if kind == "lit":
        return value(e[1])
    if kind == "sym":
        return f'{{"__kind__":{quote(e[1])},"__unresolved__":{quote(e[2])}}}'
    if kind == "call":
        return f'{{"__unresolved_func__":{quote(e[1])},"args":[{",".join(map(node, e[2]))}]}}'
    if kind == "bin":
        return f'{{"__binary_op__":"{e[1]}","lhs":{node(e[2])},"rhs":{node(e[3])}}}'
    if kind == "un":
        return f'{{"__unary_op__":"{e[1]}","operand":{node(e[2])}}}'
    if kind == "tpl":
        return f'{{"__template_concat__":[{",".join(map(node, e[1]))}]}}'
    if kind == "arr":
        return "[" + ",".join(map(node, e[1])) + "]"
    if kind == "obj":  # keys are rendered first, and their JSON text is the key
        return _object([(node(k), node(v)) for k, v in e[1]])
    if kind == "cond":
        return f'{{"__conditional__":{{"cond":{node(e[1])},"else":{node(e[3])},"then":{node(e[2])}}}}}'
    _, binders, collection, _, val, _, is_object = e
    return f'{{"__for__":{{"binders":[{",".join(map(quote, binders))}],"collection":{node(collection)},"object_form":{value(is_object)},"value":{node(val)}}}}}'


def attributes(pairs: list) -> str:
    return _object([(k, node(v)) for k, v in pairs])


def source(e: list | None) -> str:
    """The text of a count or for_each: scalars and references as they are, all else as JSON."""
    if e is None:
        return ""
    if e[0] == "sym":
        return e[2]
    if e[0] == "lit":
        v = e[1]
        if isinstance(v, str):
            return v
        if isinstance(v, bool | int) or (isinstance(v, float) and math.isfinite(v)):
            return value(v)
    return attributes([["", e]])

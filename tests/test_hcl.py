import json

import pytest

from hexloom.hcl import evaluate as ev
from hexloom.hcl import functions as fn
from hexloom.hcl import render
from hexloom.hcl.parser import HclError, attributes, parse


def reduced(text, **scope):
    return {k: render.node(ev.reduce(v, ev.Scope(**scope))) for k, v in attributes(parse(text))}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("7 / 2", "3"),
        ("-7 / 2", "-3"),
        ("-7 % 3", "2"),
        ("7.0 / 2", "3.5"),
        ("1 / 0", '{"__binary_op__":"Div","lhs":1,"rhs":0}'),
        ('"a" + "b"', '"ab"'),
        ("1 == 1.0", "true"),
        ("[1] == [1.0]", "false"),
        ('"a" < "b"', "true"),
        ("true && !false", "true"),
        ("true || var.x", '{"__binary_op__":"Or","lhs":true,"rhs":{"__kind__":"Var","__unresolved__":"var.x"}}'),
        ("9223372036854775807 + 1", '{"__binary_op__":"Add","lhs":9223372036854775807,"rhs":1}'),
        ("false ? 1 : 2", "2"),
        ('"${null}x${[1, "a"]}"', '"x[1, a]"'),
        ("tostring(null)", '"null"'),
        ("1e16", "1e16"),
        ("0.1", "0.1"),
        ('{ b = 1, a = { "c" = 2 } }', '{"a":{"c":2},"b":1}'),
        ("[for i, v in [10, 20] : v + i if v > 10]", "[21]"),
        ('{ for k, v in { a = 1 } : upper(k) => v }', '{"A":1}'),
        ("timestamp()", '{"__unresolved_func__":"timestamp","args":[]}'),
        ("lower(var.x)", '{"__unresolved_func__":"lower","args":[{"__kind__":"Var","__unresolved__":"var.x"}]}'),
        ("a.b[0].c", '{"__kind__":"Resource","__unresolved__":"a.b[0].c"}'),
        ("a.b[*].c", '{"__kind__":"Resource","__unresolved__":"a.b[*].c"}'),
        ("each.key", '{"__kind__":"Iteration","__unresolved__":"each.key"}'),
        ("{ (var.k) = 1, z = var.v }", '{"\\"z\\"":{"__kind__":"Var","__unresolved__":"var.v"},"{\\"__kind__\\":\\"Var\\",\\"__unresolved__\\":\\"var.k\\"}":1}'),
    ],
)
def test_reduction(text, expected):
    assert reduced(f"x = {text}")["x"] == expected


@pytest.mark.parametrize(
    ("call", "expected"),
    [
        ('format("%s-%d%%", "a", 2.9)', "a-2%"),
        ('trim("xxaxx", "x")', "a"),
        ('replace("aaa", "a", "b")', "bbb"),
        ('length({ a = 1 })', 1),
        ('keys({ b = 1, a = 2 })', ["a", "b"]),
        ('values({ b = 1, a = 2 })', [2, 1]),
        ('lookup({ a = 1 }, "z", 5)', 5),
        ('lookup({ a = 1 }, "z")', None),
        ('contains([1], 1.0)', False),
        ('flatten([[1, [2]], 3])', [1, 2, 3]),
        ('compact(["", "a", null])', ["a"]),
        ('tonumber("12")', 12),
        ('tobool("true")', True),
        ('toset([1, 1, 2])', [1, 2]),
        ('jsondecode("[1, {\\"a\\": null}]")', [1, {"m": [["a", None]]}]),
        ('base64decode(base64encode("é"))', "é"),
        ('formatdate("YYYY/MM/DD hh:mm", "2024-03-05T06:07:08Z")', "2024/03/05 06:07"),
        ('strcontains("hello", "ell")', True),
        ('merge({ a = 1, b = 2 }, { a = 3 })', {"m": [["a", 3], ["b", 2]]}),
        ('jsonencode({ b = [1.5], a = true })', '{"a":true,"b":[1.5]}'),
    ],
)
def test_functions(call, expected):
    (_, node), = attributes(parse(f"x = {call}"))
    out = ev.reduce(node, ev.Scope())
    assert out[0] == "lit" and fn.same(out[1], expected)


@pytest.mark.parametrize("call", ['tobool("yes")', 'tonumber(" 1")', 'format("%x", 1)', "upper(1)", 'base64decode("!")', "lower()"])
def test_errors_keep_the_call(call):
    (_, node), = attributes(parse(f"x = {call}"))
    assert ev.reduce(node, ev.Scope())[0] == "call"


def test_blocks_and_templates():
    text = 'r "a" "b" {\n  x = <<-EOT\n    hi ${v}\n      there\n    EOT\n  in "l" { y = 1 }\n  s = "$${no} %{if x}"\n}\n'
    (block,) = parse(text)
    assert block["labels"] == ["a", "b"] and (block["line"], block["column"]) == (1, 1)
    x, inner, s = (v for _, v in attributes(block["body"]))
    assert x == ["tpl", [["lit", "hi "], ["sym", "Other", "v"], ["lit", "\n  there\n"]]]
    assert inner == ["obj", [[["lit", "__labels__"], ["arr", [["lit", "l"]]]], [["lit", "y"], ["lit", 1]]]]
    assert s == ["tpl", [["lit", "${no} "], ["sym", "Other", "<template-directive>"]]]
    for bad in ("a = ", "a {", 'a = "x', "a = [1", "= 1", "a = " + "(" * 200):
        with pytest.raises(HclError):
            parse(bad)


def test_locals():
    nodes = dict(map(tuple, attributes(parse('a = "${local.b}!"\nb = local.c\nc = "x"\nd = var.none'))))
    out, cycle = ev.solve_locals(nodes, ev.Scope())
    assert out["a"] == ["lit", "x!"] and out["d"][0] == "sym" and not cycle
    assert ev.solve_locals(dict(map(tuple, attributes(parse("a = local.b\nb = local.a\nc = 1")))), ev.Scope())[1] == ["a", "b"]


def test_reducing_twice_changes_nothing_and_more_bindings_never_unresolve():
    text = 'a = "${var.x}-${var.y}"\nb = [for v in [1, var.x] : v]\nc = var.x == 1 ? var.y : 2'
    for _, node in attributes(parse(text)):
        once = ev.reduce(node, ev.Scope(var={"x": 1}))
        assert ev.reduce(once, ev.Scope(var={"x": 1})) == once
        assert ev.unresolved(ev.reduce(node, ev.Scope(var={"x": 1, "y": 2}))) <= ev.unresolved(once) <= ev.unresolved(node)


def test_numbers_round_trip():
    for f in (1e16, 0.1, 1.0, 1.5e-9, 123456789.25):
        assert json.loads(render.number(f)) == f

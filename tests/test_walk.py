"""What a walk reads: names that begin with an underscore, ignore files, globs, limits; and the steps that can be replaced."""

import re

import pytest

from hexloom import cli
from hexloom.hcl.cascade import Resolver
from hexloom.hcl.functions import Registry, call
from hexloom.plans.export import Folder
from hexloom.plans.workspace import Stages, evaluate_directory, read_workspace
from hexloom.sources.globs import GlobError, glob_set, ignore_rules, ignored
from hexloom.sources.workspace import MODULES, LimitExceeded, Tree, WalkOptions, files, root_config


@pytest.mark.parametrize("glob, yes, no", [
    ("modules/*", ["modules/a", "modules/a/b"], ["modules", "x/modules/a"]),
    ("modules/**", ["modules/a/b"], ["modules"]),
    ("**/modules/*", ["modules/a", "x/y/modules/a/b"], ["xmodules/a"]),
    ("a/**/z", ["a/z", "a/b/c/z"], ["az", "a/zz"]),
    ("*.{tf,hcl}", ["x/y.tf", "y.hcl"], ["y.tfx"]),
    ("[!a-c]?[.]", ["dx."], ["ax.", "d."]),
    (r"\*{x,y\,z}", ["*x", "*y,z"], ["ax", "*y"]),
])
def test_globs(spark, glob, yes, no):
    p = glob_set([glob])
    assert all(re.match(p, x) for x in yes) and not any(re.match(p, x) for x in no)
    found = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert {r.p for r in found.filter(found.p.rlike(p)).collect()} == set(yes)


def test_globs_that_are_none():
    for glob in ("x" * 257, "a{b", "[ab"):
        with pytest.raises(GlobError):
            glob_set([glob])
    assert glob_set([]) is None


def test_ignore_rules():
    text = "# note\n*.tfvars\n!keep.tfvars\n/top\nbuild/\nx/**/y\n\\#odd  \n[open\n"
    rules = [(re.compile(p, re.S), n, f) for p, n, f in reversed(ignore_rules("d", text))]
    gone = ["d/a.tfvars", "d/e/a.tfvars", "d/top", "d/top/a.tf", "d/e/build/a.tf", "d/x/y", "d/x/1/2/y/a.tf", "d/#odd"]
    kept = ["a.tfvars", "d/keep.tfvars", "d/e/top/a.tf", "d/e/build", "d/e/x/y"]
    assert [x for x in gone + kept if ignored(x, rules)] == gone


def test_walk(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    tree = {
        ".gitignore": "skip/\n*.tfvars\n", "a/.gitignore": "!own.tfvars\ngone.tf\n", "a/.ignore": "late.tf\n", "skip/main.tf": "x", "a/gone.tf": "x", "a/late.tf": "x", "b/gone.tf": "x",
        "a/own.tfvars": "x = 1", "a/x.tfvars": "x = 1", "_env/c.hcl": "x", "_env/_in/d.hcl": "x", "a/_b.tf": "x", "a/b/main.tf": "x", ".hidden/_x/e.tf": "x", "terraform/root.hcl": "x", "_drop/f.tf": "x",
    }
    for path, text in tree.items():
        folder.write_text(path, text)
    paths = lambda **o: sorted(r.path for r in files(Tree(spark, str(tmp_path), WalkOptions(**o))).collect())
    kept = ["_env/_in/d.hcl", "_env/c.hcl", "a/_b.tf", "a/b/main.tf", "a/own.tfvars", "b/gone.tf", "terraform/root.hcl"]
    assert paths(exclude=("_drop/**",)) == kept
    assert paths(exclude=("_drop/**",), ignore_files=False) == sorted([*kept, "a/gone.tf", "a/late.tf", "a/x.tfvars", "skip/main.tf"])
    assert paths(max_depth=2) == ["_drop/f.tf", *(p for p in kept if p.count("/") < 2)]
    assert root_config(files(Tree(spark, str(tmp_path)))) == "terraform/root.hcl"
    with pytest.raises(LimitExceeded):
        read_workspace(spark, str(tmp_path), walk=WalkOptions(max_files=7))
    assert cli.main(["parse", str(tmp_path), "--max-files", "7", "-o", str(tmp_path / "out")]) == cli.EXIT_LIMIT
    assert cli.main(["parse", str(tmp_path), "--exclude", "a{", "-o", str(tmp_path / "out")]) == cli.EXIT_USAGE


def test_registry_stages_and_diagnostics(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    folder.write_text("_common/env.hcl", 'locals {\n  zone = "far"\n}\nresource "t_x" "y" {}\n')
    folder.write_text("a/terragrunt.hcl", 'include "env" {\n  path = find_in_parent_folders("_common/env.hcl")\n}\n')
    folder.write_text("a/main.tf", 'resource "t_a" "x" {\n  v = twice("ab")\n  z = local.zone\n  u = upper("q")\n}\nmodule "m" {\n  source = "git::https://example.org/m.git"\n}\nmodule "n" {\n  source = "git::https://example.org/m.git"\n}\n')
    folder.write_text("b/main.tf", 'resource "t_b" "x" {}\ngenerate "g" {}\n')
    folder.write_text("lib/x/main.tf", 'terraform {\n  backend "gcs" {}\n}\n')
    folder.write_text("modules-tf12/v/main.tf", 'resource "t_m" "x" {}\n')

    def evaluate(rows, *args, **kw):
        return (x | ({"name": "renamed"} if x["address"] == "t_b.x" else {}) for x in evaluate_directory(rows, *args, **kw))

    registry = Registry().register("twice", lambda s: s * 2, 1).unregister("upper")
    assert "twice" in registry and "upper" not in registry and call("twice", ["x"], registry.functions()) == "xx"
    ws = read_workspace(spark, str(tmp_path), registry=registry, stages=Stages(evaluate=evaluate), walk=WalkOptions(modules=(*MODULES, "lib/*")))
    rows = {r.address: r for r in ws.resources.collect()}
    text = rows["t_a.x"].attributes_json
    assert '"abab"' in text and '"far"' in text and '"Q"' not in text and rows["t_b.x"].resource_name == "renamed" and "t_m.x" not in rows
    assert sorted(r.code for r in ws.diagnostics.collect()) == ["TF1120", "TF1205", "TG2101"]
    assert [(r.source_raw, r.file) for r in ws.external.collect()] == [("git::https://example.org/m.git", "a/main.tf")]


@pytest.mark.parametrize("text", ['remote_state {\n  backend = "s3"\n  config = { bucket = local.b }\n}\n', 'remote_state = {\n  backend = "s3"\n  config = { bucket = local.b }\n}\n'])
def test_remote_state(text):
    r = Resolver({"root.hcl": text + 'locals { b = "x" }\n', "c/terragrunt.hcl": 'include "r" { path = find_in_parent_folders("root.hcl") }\n'}, "c").resolve()
    assert r.remote_state == {"backend": "s3", "config": {"m": [["bucket", "x"]]}} and r.backend is None

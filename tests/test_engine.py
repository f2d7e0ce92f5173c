"""Cases of the engine that the trees of its queries (tested with the catalogue) do not hold."""

import pytest

from hexloom.hcl import evaluate as ev
from hexloom.hcl.cascade import Resolver
from hexloom.hcl.files import functions_over, glob_pattern, render_template
from hexloom.hcl.functions import CallError
from hexloom.operators.dedup import first_by, later_ones
from hexloom.plans import catalog, engine  # noqa: F401 - registers its queries
from hexloom.plans.export import Folder
from hexloom.plans.workspace import ProfilesMissing, read_workspace


def test_whole_numbers_are_compared_as_such():
    assert ev.binary("Eq", 2**53 + 1, 2**53) is False and ev.binary("Ne", 2**53 + 1, 2**53) is True
    assert ev.binary("Eq", 1, 1.0) is True and ev.binary("Eq", True, 1) is False


@pytest.mark.parametrize("kind", ["s3", "gcs", "azurerm"])
def test_kind_of_a_backend_block(kind):
    r = Resolver({"c/terragrunt.hcl": f'terraform {{\n  backend "{kind}" {{\n    region = "x"\n  }}\n}}\n'}, "c").resolve()
    assert r.backend == {"kind": kind, "region": "x"}


def test_file_functions():
    f = {k: v[1] for k, v in functions_over({"a/x.txt": "hi ${name} $${n}", "a/b/y.json": None, "z.txt": "z"}, True, "/root").items()}
    assert f["file"]("a/x.txt") == "hi ${name} $${n}" and f["file"]("/root/z.txt") == "z"
    assert f["templatefile"]("a/x.txt", {"m": [["name", "you"]]}) == "hi you ${n}"
    assert f["fileexists"]("a/b/y.json") and f["fileexists"]("a") and not f["fileexists"]("a/none")
    assert f["fileset"]("a", "**/*.json") == ["b/y.json"] and f["fileset"](".", "*.txt") == ["z.txt"]
    for call in (lambda: f["file"]("../etc/passwd"), lambda: f["file"]("a/b/y.json"), lambda: f["fileexists"]("../x"), lambda: f["templatefile"]("a/x.txt", {"m": []})):
        with pytest.raises(CallError):
            call()
    with pytest.raises(CallError):
        render_template("${a.b}", {"a": "x"})
    assert glob_pattern("{a,b}/?.tf").fullmatch("b/x.tf") and not glob_pattern("*.tf").fullmatch("a/x.tf")


def test_later_ones_are_what_first_by_leaves(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (None, "x"), (None, "y"), (2, "c")]
    df = spark.createDataFrame(rows, "k int, v string")
    left = sorted(map(tuple, later_ones(df, ["k"], ["v"]).collect()), key=repr)
    assert left == [(1, "a"), (1, "b"), (None, "y")]
    both = left + list(map(tuple, first_by(df, ["k"], ["v"]).collect()))
    assert sorted(both, key=repr) == sorted(rows, key=repr)


def test_strict_gate_files_and_limits(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    folder.write_text("a/main.tf", 'provider "aws" {\n  profile = "gone"\n}\nresource "t_a" "x" {\n  body = file("a/note.txt")\n  all = fileset("a", "*.txt")\n  home = get_env("HOME_DIR", "none")\n}\n')
    folder.write_text("a/note.txt", "noted")
    folder.write_text("b/main.tf", 'terraform {\n  backend "gcs" {\n    region = "eu"\n  }\n}\nresource "t_b" "y" {}\n')
    (tmp_path / "b" / "bad.tf").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "b" / "large.tf").write_bytes(b"#" * ((4 << 20) + 1))
    profiles = spark.createDataFrame([("p", "1" * 12, "n")], "profile string, account_id string, account_name string")
    with pytest.raises(ProfilesMissing, match="gone"):
        read_workspace(spark, str(tmp_path), profiles=profiles, strict_providers=True)
    ws = read_workspace(spark, str(tmp_path), profiles=profiles, env={"HOME_DIR": "/h"})
    assert sorted((r.code, r.file) for r in ws.diagnostics.collect()) == [("TF1103", "b/large.tf"), ("TF1202", "b/bad.tf"), ("TF1601", "")]
    rows = {r.address: r for r in ws.resources.collect()}
    assert '"noted"' in rows["t_a.x"].attributes_json and '["note.txt"]' in rows["t_a.x"].attributes_json and '"/h"' in rows["t_a.x"].attributes_json
    assert rows["t_b.y"].state_region == "eu"
    assert {r.component_path: r.state_backend_kind for r in ws.components.collect()} == {"a": "", "b": "gcs"}


def test_engine_queries_are_registered():
    assert {n for n in catalog.SQL if n.startswith("engine_")} >= {"engine_resources", "engine_cascade_deep", "engine_manifest", "engine_broken_trees"}

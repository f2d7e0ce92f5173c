import json
import textwrap

import pytest

from hexloom.plans.export import export, redact, verify
from hexloom.plans.workspace import read_workspace

TREE = {
    "app/main.tf": """
        provider "aws" {
          region  = "eu-west-1"
          profile = "prod"
        }
        provider "aws" {
          alias  = "far"
          region = "ap-1"
        }
        variable "name" { default = "web" }
        locals { full = "${var.name}-1" }
        resource "t_one" "a" {
          title      = local.full
          depends_on = [t_two.b, t_one.c]
          link       = t_two.b.id
        }
        resource "t_two" "b" { count = 2 }
        resource "t_one" "c" { for_each = { x = 1, y = 2 } }
        resource "t_one" "a" { title = "again" }
        module "m" {
          source = "../modules/m"
          size   = 3
          peer   = t_two.b.arn
          providers = { aws = aws.far }
        }
        output "o" { value = t_one.a.id }
        """,
    "modules/m/main.tf": """
        variable "size" {}
        variable "kept" { default = 1 }
        resource "t_box" "x" {
          count = var.size
          kept  = var.kept
          area  = "${var.size}-u"
          provider = aws
        }
        module "inner" {
          source = "../n"
          n      = var.size
        }
        """,
    "modules/n/main.tf": 'variable "n" {}\nresource "t_leaf" "y" { \n n = var.n \n provider = aws \n }\nmodule "back" { source = "../m" }\n',
    "root.hcl": """
        locals {
          zone           = "us-1"
          aws_region     = local.zone
          aws_account_id = "111122223333"
        }
        inputs = { label = "from-input" }
        generate "backend" {
          path      = "b.tf"
          if_exists = "overwrite"
          contents  = <<EOF
        terraform {
          backend "s3" {
            bucket  = "state"
            region  = "${local.zone}"
            profile = "prod"
          }
        }
        EOF
        }
        """,
    "wrapped/terragrunt.hcl": 'include "root" { path = find_in_parent_folders("root.hcl") }\ndependency "app" { config_path = "../app" }\n',
    "wrapped/main.tf": 'variable "label" { default = "own" }\nresource "t_w" "w" { label = "${var.label}/${local.zone}" }\n',
    "broken/main.tf": 'resource "t_bad" "z" {\n',
    ".terraform/skip.tf": 'resource "t_no" "z" {}\n',
}


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(textwrap.dedent(text))
    profiles = spark.createDataFrame([("prod", "111122223333", "main")], "profile string, account_id string, account_name string")
    return read_workspace(spark, str(root), profiles=profiles)


def test_resources(workspace):
    rows = {r.address: r for r in workspace.resources.collect()}
    assert {a for a, r in rows.items() if r.kind == "resource"} == {
        "t_one.a", "t_two.b[0]", "t_two.b[1]", 't_one.c["x"]', 't_one.c["y"]', "module.m.t_box.x[0]", "module.m.t_box.x[1]", "module.m.t_box.x[2]", "module.m.module.inner.t_leaf.y", "t_w.w",
    }
    assert json.loads(rows["t_one.a"].attributes_json)["title"] == "web-1"  # the first of two wins
    box = rows["module.m.t_box.x[0]"]
    assert json.loads(box.attributes_json) == {"kept": 1, "area": {"__template_concat__": [3, "-u"]}}  # substituted, not reduced again
    assert (box.module_path, box.component_path, box.count_expr) == ("m", "app", "")
    assert json.loads(rows["module.m.module.inner.t_leaf.y"].attributes_json) == {"n": 3}
    for a in ("module.m.t_box.x[0]", "module.m.module.inner.t_leaf.y"):
        assert (rows[a].provider_local, rows[a].region) == ("aws.far", "ap-1")
    one = rows["t_one.a"]
    assert (one.region, one.account_id, one.account_name) == ("eu-west-1", "111122223333", "main")
    assert rows["module.m"].provider_source == "../modules/m" and rows["var.name"].kind == "variable"


def test_wrapped_component(workspace):
    r = {r.address: r for r in workspace.resources.collect()}["t_w.w"]
    assert json.loads(r.attributes_json) == {"label": "from-input/us-1"}
    assert (r.region, r.account_id, r.account_name) == ("us-1", "111122223333", "main")
    c = {r.component_path: r for r in workspace.components.collect()}["wrapped"]
    assert (c.state_backend_kind, c.state_account_id, c.state_region, c.has_terragrunt) == ("s3", "111122223333", "us-1", True)


def test_edges(workspace):
    found = {(r.from_address, r.to_address, r.edge_kind, r.source_attr) for r in workspace.dependencies.collect()}
    assert found == {("t_one.a", "t_two.b", "explicit_depends_on", "depends_on"), ("t_one.a", "t_one.c", "explicit_depends_on", "depends_on"), ("t_one.a", "t_two.b", "attr_ref", "link"), ("module.m", "t_two.b", "module_input", "peer"), ("component.wrapped", "component.wrapped/../app", "terragrunt_dependency", "dependency")}


def test_summaries(workspace):
    rows = {r.component_path: r for r in workspace.components.collect()}
    app = rows["app"]
    assert (app.resource_count, app.module_count, app.provider_count, app.variable_count, app.local_count, app.output_count) == (9, 1, 2, 1, 1, 1)
    assert {"app", "broken", "wrapped"} <= set(rows) and rows["broken"].resource_count == 0
    assert {(r.source_raw, r.call_count) for r in workspace.modules.collect()} == {("../modules/m", 1), ("../n", 1), ("../m", 1), ("modules/m", 0), ("modules/n", 0)}
    # a module that calls itself through another, an address that is there twice, a file that does not parse
    assert sorted(r.code for r in workspace.diagnostics.collect()) == ["TF1203", "TF1504", "TF1506"]


def test_export_and_verify(workspace, tmp_path, spark):
    manifest = export(workspace, str(tmp_path), command_line="parse --token=abc x")
    assert verify(str(tmp_path)) == [] and "abc" not in manifest["command_line"]
    assert len(spark.read.parquet(f"file://{tmp_path}/resources.parquet").columns) == 24
    with pytest.raises(FileExistsError):
        export(workspace, str(tmp_path))
    with open(tmp_path / "modules.parquet", "ab") as f:
        f.write(b"x")
    assert verify(str(tmp_path)) == ["modules.parquet"]


def test_redaction():
    assert redact("a --password hunter2 b") == "a <redacted> <redacted> b"

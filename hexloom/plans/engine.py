"""Queries that run the whole engine: source trees made of the driver's tables are written to shared storage, read,
evaluated and inlined by read_workspace(), and what comes out is compared with SQL over the same tables.

A region is a folder, a nation a component; a tree has as many files as there are nations, and some more.
"""

from __future__ import annotations

import textwrap
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.plans.catalog import query
from hexloom.plans.export import Folder, export, verify
from hexloom.plans.workspace import Workspace, read_workspace
from hexloom.session import remove_at_exit, shared_dir, table
from hexloom.sources.workspace import Tree, WalkOptions, files

_MAIN = """
    terraform {{
      backend "{backend}" {{
        bucket = "state"
        region = "reg-{region}"
        profile = "p{nation}"
      }}
    }}
    provider "aws" {{
      region  = "reg-{region}"
      profile = "p{nation}"
    }}
    provider "aws" {{
      alias   = "far"
      region  = "far-{region}"
      profile = "x{region}"
    }}
    variable "size" {{ default = {size} }}
    locals {{
      base = "{name}"
      full = upper("${{local.base}}-${{var.size + 1}}")
      even = var.size % 2 == 0 ? "even" : "odd"
    }}
    resource "t_item" "i" {{
      count = var.size
      title = local.full
      even  = local.even
      list  = jsonencode([for x in range_of : x])
      link  = t_peer.p.id
    }}
    resource "t_peer" "p" {{
      for_each   = {{ b = 2, a = 1 }}
      provider   = aws.far
      depends_on = [t_item.i]
    }}
    data "t_look" "d" {{ provider = aws.none }}
    module "m" {{
      source = "../../modules/m{module}"
      k      = var.size
    }}
    output "o" {{ value = t_item.i }}
    """
_MODULE = """
    variable "k" {{}}
    resource "t_box" "x" {{
      count = var.k
      from  = var.k
    }}
    {calls}
    """


def _text(s: str) -> str:
    return textwrap.dedent(s)


def _tree(spark: SparkSession, files: dict[str, str]) -> str:
    """Writes a tree of files to shared storage; its root."""
    folder = Folder(spark, f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}")
    folder.make()
    remove_at_exit(spark, folder.uri)
    for name, text in files.items():
        folder.write_text(name, text)
    return folder.uri


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at any scale


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """Components of all nations, three modules of which two call another, and a module that lacks."""
    files = {}
    for r in _nations(spark, sf_dir):
        k = r.n_nationkey
        files[f"r{r.n_regionkey}/n{k}/main.tf"] = _text(_MAIN.format(backend="gcs" if k % 2 else "s3", region=r.n_regionkey, nation=k, name=r.n_name, size=k % 4, module=k % 4))
    for m, called in ((0, None), (1, "../m0"), (2, "../m1")):
        files[f"modules/m{m}/main.tf"] = _text(_MODULE.format(calls=f'module "in" {{\n  source = "{called}"\n  k = 2\n}}' if called else ""))
    n = table(spark, sf_dir, "nation")
    profiles = n.select(F.concat(F.lit("p"), "n_nationkey").alias("profile"), F.lpad(F.col("n_nationkey").cast("string"), 12, "0").alias("account_id"), F.col("n_name").alias("account_name"))
    return read_workspace(spark, _tree(spark, files), profiles=profiles)


def engine(sql: str):
    return query(sql)


#: What SQL says of the tree: n has a row for each component, inlined a row for each box of its modules.
_N = """n AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r, n_nationkey % 4 AS size, 'r' || n_regionkey || '/n' || n_nationkey AS component_path FROM nation),
boxes AS (SELECT k, component_path, 'module.m.t_box.x[' || unnest(range(size)) || ']' AS address FROM n WHERE k % 4 < 3
  UNION ALL SELECT k, component_path, 'module.m.module.in.t_box.x[' || unnest(range(2)) || ']' FROM n WHERE k % 4 IN (1, 2)
  UNION ALL SELECT k, component_path, 'module.m.module.in.module.in.t_box.x[' || unnest(range(2)) || ']' FROM n WHERE k % 4 = 2),
rows AS (SELECT component_path, k, 't_item.i[' || unnest(range(size)) || ']' AS address, 'resource' AS kind, 'near' AS provider FROM n
  UNION ALL SELECT component_path, k, 't_peer.p["' || unnest(['a', 'b']) || '"]', 'resource', 'far' FROM n
  UNION ALL SELECT component_path, k, 'data.t_look.d', 'data', 'none' FROM n
  UNION ALL SELECT component_path, k, address, 'resource', 'near' FROM boxes)"""


@engine(f"WITH {_N} SELECT component_path, address, kind, CASE provider WHEN 'near' THEN lpad(k::VARCHAR, 12, '0') ELSE '' END AS account_id, CASE provider WHEN 'near' THEN 'reg-' || n.r WHEN 'far' THEN 'far-' || n.r ELSE '' END AS region, CASE provider WHEN 'near' THEN n.name ELSE '' END AS account_name, lpad(k::VARCHAR, 12, '0') AS state_account_id, 'reg-' || n.r AS state_region FROM rows JOIN n USING (component_path, k)")
def engine_resources(spark, sf_dir):
    """Instances of count and for_each, inlined modules, providers by alias, accounts by profile, state backends."""
    r = workspace(spark, sf_dir).resources.filter("kind in ('resource', 'data')")
    return r.select("component_path", "address", "kind", "account_id", "region", "account_name", "state_account_id", "state_region")


@engine(f"""WITH {_N} SELECT component_path, address, upper(name || '-' || (size + 1)) AS title, CASE WHEN size % 2 = 0 THEN 'even' ELSE 'odd' END AS even, NULL::VARCHAR AS size FROM rows JOIN n USING (component_path, k) WHERE address LIKE 't_item%'
UNION ALL SELECT component_path, address, NULL, NULL, (CASE WHEN address LIKE 'module.m.t_box%' THEN size ELSE 2 END)::VARCHAR FROM boxes JOIN n USING (component_path, k)""")
def engine_attributes(spark, sf_dir):
    """Locals over locals and variables, templates, arithmetic, conditionals; inputs of calls in the bodies they inline."""
    r = workspace(spark, sf_dir).resources.filter("resource_type in ('t_item', 't_box')")
    field = lambda f: F.get_json_object("attributes_json", f"$.{f}")
    return r.select("component_path", "address", field("title").alias("title"), field("even").alias("even"), field("from").alias("size"))


@engine("""SELECT DISTINCT from_address, to_address, edge_kind FROM (
SELECT 't_peer.p["' || unnest(['a', 'b']) || '"]' AS from_address, 't_item.i' AS to_address, 'explicit_depends_on' AS edge_kind FROM nation
UNION ALL SELECT 't_item.i[' || unnest(range(n_nationkey % 4)) || ']', 't_peer.p', 'attr_ref' FROM nation)""")
def engine_edges(spark, sf_dir):
    """Explicit and inferred edges, once each."""
    return workspace(spark, sf_dir).dependencies.select("from_address", "to_address", "edge_kind")


@engine(f"""WITH {_N}, c AS (SELECT component_path, count(*) FILTER (WHERE kind = 'resource') AS resource_count, count(*) FILTER (WHERE kind = 'data') AS data_count FROM rows GROUP BY 1)
SELECT component_path, resource_count, data_count, 1::BIGINT AS module_count, 1::BIGINT AS output_count, 1::BIGINT AS variable_count, 3::BIGINT AS local_count, 2::BIGINT AS provider_count, CASE WHEN k % 2 = 1 THEN 'gcs' ELSE 's3' END AS state_backend_kind FROM n JOIN c USING (component_path)""")
def engine_components(spark, sf_dir):
    """Rows of each component by kind, and the kind of its state backend."""
    return workspace(spark, sf_dir).components.select("component_path", *(f"{k}_count" for k in ("resource", "data", "module", "output", "variable", "local", "provider")), "state_backend_kind")


@engine("""SELECT '../../modules/m' || (n_nationkey % 4) AS source_raw, count(*) AS call_count FROM nation GROUP BY 1
UNION ALL SELECT unnest(['../m0', '../m1']), 1 UNION ALL SELECT unnest(['modules/m0', 'modules/m1', 'modules/m2']), 0""")
def engine_modules(spark, sf_dir):
    """Called sources with their calls, and the modules that were walked."""
    return workspace(spark, sf_dir).modules.select("source_raw", "call_count")


@engine("""SELECT 'TF1503' AS code, count(*) AS n FROM nation WHERE n_nationkey % 4 = 3
UNION ALL SELECT 'TF1601', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'TF1602', count(*) FROM nation""")
def engine_diagnostics(spark, sf_dir):
    """Modules that lack, profiles without an account, providers that are not declared."""
    return workspace(spark, sf_dir).diagnostics.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_BROKEN = {
    "cycle": 'locals {{\n  a = local.b\n  b = "${{local.a}}{k}"\n}}\nresource "t_a" "x" {{}}\n',
    "self": 'resource "t_a" "x" {{}}\nmodule "up" {{\n  source = "../../modules/loop"\n}}\n',
    "twice": 'resource "t_a" "x" {{}}\nresource "t_a" "x" {{}}\n',
    "parse": 'resource "t_a" "x" {{\n',
    "outside": 'resource "t_a" "x" {{}}\nmodule "out" {{\n  source = "../../../out"\n}}\n',
    "many": 'resource "t_a" "x" {{\n  count = {k} + 2000\n}}\n',
    "label": 'resource "t_a" {{}}\nresource "t_a" "x" {{}}\n',
}
_CODES = {"cycle": "TF1401", "self": "TF1504", "twice": "TF1506", "parse": "TF1203", "outside": "TF1502", "many": "TF1505", "label": "TF1301"}


@engine("SELECT code, 'c/' || kind || n_nationkey AS component FROM nation, (VALUES " + ", ".join(f"('{k}', '{c}')" for k, c in _CODES.items()) + ") AS t(kind, code) WHERE n_regionkey = 2")
def engine_broken_trees(spark, sf_dir):
    """One fault in each component: a cycle of locals, a module that calls itself, an address twice, a syntax error, a
    module outside of the root, too many instances, a block without its labels."""
    files = {"modules/loop/main.tf": 'variable "v" {}\nmodule "again" {\n  source = "../loop"\n}\n'}
    for r in _nations(spark, sf_dir):
        if r.n_regionkey == 2:
            files |= {f"c/{kind}{r.n_nationkey}/main.tf": text.format(k=r.n_nationkey) for kind, text in _BROKEN.items()}
            files[f"c/cycle{r.n_nationkey}/z.tf"] = 'resource "t_b" "y" {}\n'
    found = read_workspace(spark, _tree(spark, files)).diagnostics
    # a call's chain names the component; all else is placed in its file
    place = F.when(F.col("code") == "TF1504", F.col("message")).otherwise(F.col("file"))
    return found.select("code", F.regexp_extract(place, "(c/[a-z0-9]+)", 1).alias("component"))


@engine("""SELECT unnest(['live/n' || n_nationkey || '/_own.tf', '_env/n' || n_nationkey || '.hcl']) AS path FROM nation
UNION ALL SELECT 'live/n' || n_nationkey || '/main.tf' FROM nation WHERE n_nationkey::VARCHAR NOT LIKE '1%'
UNION ALL SELECT 'live/n' || n_nationkey || '/s.tfvars' FROM nation WHERE n_nationkey % 2 = 0""")
def engine_walk(spark, sf_dir):
    """Files that a walk reads: names that begin with an underscore, ignore files and their exceptions, an exclude glob."""
    tree = {".gitignore": "skip/\n*.tfvars\n"}
    for r in _nations(spark, sf_dir):
        k = r.n_nationkey
        tree |= {f"live/n{k}/{name}": "x = 1\n" for name in ("main.tf", "_own.tf", "skip/x.tf", "s.tfvars", "note.txt")}
        tree[f"_env/n{k}.hcl"] = "x = 1\n"
        if k % 2 == 0:
            tree[f"live/n{k}/.gitignore"] = "!s.tfvars\n"
    return files(Tree(spark, _tree(spark, tree), WalkOptions(exclude=("live/n1*/main.tf",)))).select("path")


@engine("SELECT 'git::https://example.org/r' || n_regionkey || '.git' AS source_raw, min('c/n' || n_nationkey || '/main.tf') AS file FROM nation GROUP BY n_regionkey")
def engine_external_modules(spark, sf_dir):
    """Modules of other places, each where it is first called."""
    call = 'resource "t_a" "x" {{}}\nmodule "{m}" {{\n  source = "git::https://example.org/r{r}.git"\n}}\nmodule "in" {{\n  source = "../../modules/m"\n}}\n'
    tree = {f"c/n{r.n_nationkey}/main.tf": call.format(m=f"m{r.n_nationkey}", r=r.n_regionkey) for r in _nations(spark, sf_dir)}
    tree["modules/m/main.tf"] = 'resource "t_b" "y" {}\n'
    return read_workspace(spark, _tree(spark, tree)).external.select("source_raw", "file")


_ROOT = """
    locals {
      tags = { a = "root", b = { x = "root", y = "root" } }
      list = ["root"]
      only = "root"
    }
    inputs = { label = "from-root" }
    """
_CHILD = """
    include "root" {{
      path = find_in_parent_folders("root.hcl")
    }}
    include "own" {{
      path           = find_in_parent_folders("own.hcl")
      merge_strategy = "{strategy}"
    }}
    dependency "next" {{ config_path = "../n{next}" }}
    """
#: Merged over the root's locals by the strategy of its include.
_OWN_LOCALS = """
    locals {{
      tags = {{ a = "{name}", b = {{ x = "{name}" }} }}
      list = ["{name}"]
    }}
    """
_USE = 'variable "label" {}\nresource "t_item" "i" {\n  a = local.tags.a\n  x = local.tags.b.x\n  y = local.tags.b.y\n  list = jsonencode(local.list)\n  label = var.label\n  only = local.only\n}\n'


def _cascade(spark: SparkSession, sf_dir: str, strategy: str) -> Workspace:
    files = {"root.hcl": _text(_ROOT)}
    for r in _nations(spark, sf_dir):
        files[f"live/n{r.n_nationkey}/terragrunt.hcl"] = _text(_CHILD.format(strategy=strategy, name=r.n_name, next=(r.n_nationkey + 1) % 25))
        files[f"live/n{r.n_nationkey}/own.hcl"] = _text(_OWN_LOCALS.format(name=r.n_name))
        files[f"live/n{r.n_nationkey}/main.tf"] = _USE
    return read_workspace(spark, _tree(spark, files))


def _plain(column: str):
    """A literal attribute's text, null where it stayed symbolic."""
    value = F.get_json_object("attributes_json", f"$.{column}")
    return F.when(~value.contains("__unresolved__") & ~value.contains("__kind__"), value).alias(column)


def _merged(strategy: str, y: str, listed: str, only: str):
    sql = f"SELECT 'live/n' || n_nationkey AS component_path, n_name AS a, n_name AS x, {y} AS y, {listed} AS list, 'from-root' AS label, {only} AS only FROM nation"

    def run(spark, sf_dir):
        r = _cascade(spark, sf_dir, strategy).resources.filter("kind = 'resource'")
        return r.select("component_path", *map(_plain, ("a", "x", "y", "list", "label", "only")))

    run.__name__ = f"engine_cascade_{strategy}"
    run.__doc__ = f"An include chain merged by {strategy}."
    query(sql)(run)


_OWN, _BOTH = "'[\"' || n_name || '\"]'", "'[\"root\",\"' || n_name || '\"]'"
_merged("no_merge", "NULL::VARCHAR", _OWN, "NULL::VARCHAR")
_merged("shallow", "NULL::VARCHAR", _OWN, "'root'")
_merged("deep_map_only", "'root'", _OWN, "'root'")
_merged("deep", "'root'", _BOTH, "'root'")


@engine("SELECT 'component.live/n' || n_nationkey AS from_address, 'component.live/n' || n_nationkey || '/../n' || ((n_nationkey + 1) % 25) AS to_address, 'terragrunt_dependency' AS edge_kind FROM nation")
def engine_dependencies(spark, sf_dir):
    """Edges between wrapped components."""
    return _cascade(spark, sf_dir, "deep").dependencies.filter("edge_kind = 'terragrunt_dependency'").select("from_address", "to_address", "edge_kind")


@engine(f"WITH {_N} SELECT 'components.parquet' AS name, count(*) AS n_rows, true AS whole FROM nation UNION ALL SELECT 'modules.parquet', 9, true UNION ALL SELECT 'resources.parquet', (SELECT count(*) FROM rows) + 8 * (SELECT count(*) FROM n), true UNION ALL SELECT 'dependencies.parquet', 5, true")
def engine_manifest(spark, sf_dir):
    """The exported tables, as the manifest has them, verified and read again."""
    out = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    remove_at_exit(spark, out)
    manifest = export(workspace(spark, sf_dir), out)
    bad = set(verify(out, spark))
    rows = [(x["name"], spark.read.parquet(f"{out}/{x['name']}").count(), x["name"] not in bad) for x in manifest["files"]]
    return spark.createDataFrame(rows, "name string, n_rows long, whole boolean")

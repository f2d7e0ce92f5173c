"""From a source tree to the four tables.

Parsing and reducing run per directory in a Python island; modules are inlined by one join per level of calls, and
classification, first-wins, providers, edges and summaries are DataFrame operations.
"""

from __future__ import annotations

import json
import os
import posixpath
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import columns as C
from hexloom.hcl import evaluate as ev
from hexloom.hcl import render
from hexloom.hcl import functions as fn
from hexloom.hcl.cascade import Resolver, backend_of
from hexloom.hcl.files import functions_over
from hexloom.hcl.parser import HclError, attributes, parse
from hexloom.operators import edges as edge_ops
from hexloom.operators import providers as provider_ops
from hexloom.operators import summary
from hexloom.operators.dedup import first_by, later_ones
from hexloom.operators.expand import MAX_DEPTH, MAX_INSTANCES
from hexloom.operators.rows import map_groups, map_rows
from hexloom.session import stage
from hexloom.sources.workspace import LimitExceeded, Tree, WalkOptions, assets, directories, files, unread

PARSER_VERSION = "0.1.0"
ENTITY = (
    "dir string, kind string, address string, type string, name string, provider_local string, provider_alias string, source string, "
    "region string, profile string, count string, for_each string, providers string, body string, depends_on array<string>, file string, line int, column int, ord long"
)
_FIELDS = [f.split()[0] for f in ENTITY.split(", ")]
FINAL = (
    "component_path string, kind string, address string, type string, name string, provider_local string, provider_alias string, source string, region string, profile string, "
    "count_expr string, for_each_expr string, attributes_json string, unresolved int, refs array<struct<target:string,attr:string>>, depends_on array<string>, problem string, file string, line int, column int, ord long"
)


class ProfilesMissing(LookupError):
    """Raised by the strict gate: providers name profiles that the profile map lacks."""


@dataclass
class Workspace:
    resources: DataFrame
    dependencies: DataFrame
    components: DataFrame
    modules: DataFrame
    diagnostics: DataFrame
    external: DataFrame


def _entity(**x) -> dict:
    return dict.fromkeys(_FIELDS) | {"depends_on": []} | x


def _text(e: list | None) -> str | None:
    return e[1] if e and e[0] == "lit" and isinstance(e[1], str) else None


def _addresses(e: list) -> list[str]:
    if e[0] == "sym":
        return [e[2]]
    items = e[1] if e[0] == "arr" else [["lit", x] for x in e[1]] if e[0] == "lit" and isinstance(e[1], list) else []
    return [s for x in items for s in ([x[2]] if x[0] == "sym" else [x[1]] if isinstance(x[1], str) else [])]


def _provider(e: list) -> tuple[str | None, str | None]:
    s = e[2] if e[0] == "sym" else _text(e) or ""
    local, _, alias = s.partition(".")
    ok = local.replace("_", "").isalnum() and local.lower() == local and local not in ("var", "local", "data", "module", "path", "each", "count")
    return (local, alias or None) if ok else (None, None)


def _provider_map(e: list | None) -> dict[str, list]:
    """Of a call's `providers`: the provider (name, alias) that each of the module's names stands for."""
    pairs = ((k[1], _provider(v)) for k, v in e[1] if k[0] == "lit") if e and e[0] == "obj" else ()
    return {k: list(p) for k, p in pairs if p[0]}


def _wrapper(here: str, texts: dict[str, str], root: str, env: dict[str, str], registry: fn.Registry | None = None):
    """What a component's wrapper file and its include chain say, and the entities for it."""
    r = Resolver(texts, here, root, env, registry).resolve()
    found = [_entity(dir=here, kind="diagnostic", name=code, body=message, file="", ord=-1) for code, message in r.diagnostics]
    known = {k: r.locals.get(k) if isinstance(r.locals.get(k), str) else None for k in ("aws_region", "aws_account_id")}
    b = r.backend or {}
    found.append(_entity(dir=here, kind="wrapper", address=f"component.{here}", type=known["aws_region"], name=known["aws_account_id"], region=b.get("region"), profile=b.get("profile"), source=b.get("kind"), provider_local=b.get("role_arn"), body="[]", depends_on=[f"component.{x}" for x in r.dependencies.values()], file=posixpath.join(here, "terragrunt.hcl"), line=1, column=1, ord=0))
    return r, found


#: What belongs to wrapper files only.
_WRAPPER_ONLY = ("include", "generate", "dependency", "inputs")


def evaluate_directory(rows: list[dict], variables: dict[str, object], environment: str | None, wrappers: dict[str, str] | None = None, root: str = "/", env: dict[str, str] | None = None, assets: tuple[dict[str, str | None], bool] = ({}, False), registry: fn.Registry | None = None) -> Iterator[dict]:
    """The entities of one directory, reduced as far as it goes by itself."""
    here, blocks, ord_ = rows[0]["dir"], [], 0
    for r in sorted(rows, key=lambda r: r["path"]):
        if not r["name"].endswith(".tf"):
            continue
        try:
            parsed = parse(r["text"])
            blocks += [(x, r["path"]) for x in parsed if "body" in x]
            for x in parsed:
                if x["name"] in _WRAPPER_ONLY:
                    yield _entity(dir=here, kind="diagnostic", name="TF1205", body=f"{x['name']} is not expected in this kind of file", file=r["path"], line=x.get("line"), column=x.get("column"), ord=-1)
        except (HclError, RecursionError) as e:
            yield _entity(dir=here, kind="diagnostic", name="TF1203", body=str(e), file=r["path"], ord=-1)
    scope = ev.Scope(workspace=environment, functions=fn.FUNCTIONS | functions_over(*assets, root) | {"get_env": (1, lambda name, default="": (env or {}).get(name, default))})
    if registry is not None:
        scope.functions = registry.over(scope.functions)
    wrapped = None
    if any(r["name"] == "terragrunt.hcl" for r in rows if posixpath.dirname(r["path"]) == here):
        texts = wrappers if wrappers is not None else {r["path"]: r["text"] for r in rows if r["name"].endswith(".hcl")}
        wrapped, found = _wrapper(here, texts, root, env or {}, registry)
        yield from found
    nodes: dict[str, list] = {}
    for x, _ in blocks:
        if x["name"] == "variable" and x["labels"]:
            default = dict(map(tuple, attributes(x["body"]))).get("default")
            default = ev.reduce(default, ev.Scope()) if default else None
            if default and default[0] == "lit":
                scope.var.setdefault(x["labels"][0], default[1])
        elif x["name"] == "locals":
            nodes |= dict(map(tuple, attributes(x["body"])))
    if wrapped is not None:
        scope.var |= wrapped.inputs
        scope.local |= wrapped.locals
    scope.var |= variables
    nodes, cycle = ev.solve_locals(nodes, scope)
    scope.local |= {k: v[1] for k, v in nodes.items() if v[0] == "lit"}
    if cycle:
        yield _entity(dir=here, kind="diagnostic", name="TF1401", body="cycle in locals: " + ", ".join(cycle), file=next((p for x, p in blocks if x["name"] == "locals"), ""), ord=-1)
    if wrapped is None or not wrapped.backend:
        backend = backend_of([attributes(x["body"]) for x, _ in blocks if x["name"] == "terraform"], scope)
        if backend:
            yield _entity(dir=here, kind="backend", source=backend["kind"], region=backend.get("region"), profile=backend.get("profile"), provider_local=backend.get("role_arn"), ord=0)
    for x, path in blocks:
        ord_ += 1
        at = {"dir": here, "file": path, "line": x["line"], "column": x["column"], "ord": ord_}
        name, labels = x["name"], x["labels"]
        body = [[k, ev.reduce(v, scope)] for k, v in attributes(x["body"])]
        get = dict(map(tuple, body)).get
        rest = lambda *out, b=body: json.dumps([p for p in b if p[0] not in out])
        if len(labels) < {"resource": 2, "data": 2, "module": 1, "provider": 1, "variable": 1, "output": 1}.get(name, 0):
            yield _entity(dir=here, kind="diagnostic", name="TF1301", body=f"a {name} block lacks labels", file=path, line=x["line"], column=x["column"], ord=-1)
        loops = {k: json.dumps(get(k)) if get(k) else None for k in ("count", "for_each")}
        if name in ("resource", "data") and len(labels) >= 2:
            local, alias = _provider(get("provider")) if get("provider") else (None, None)
            address = ".".join([*(["data"] if name == "data" else []), *labels[:2]])
            raw = dict(map(tuple, attributes(x["body"]))).get("depends_on")
            yield _entity(**at, kind=name, address=address, type=labels[0], name=labels[1], provider_local=local, provider_alias=alias, body=rest("count", "for_each", "provider", "depends_on"), depends_on=_addresses(raw) if raw else [], **loops)
        elif name == "module" and labels:
            yield _entity(**at, kind="module", address=f"module.{labels[0]}", name=labels[0], source=_text(get("source")) or "", providers=json.dumps(_provider_map(get("providers"))), body=rest("count", "for_each", "providers", "source"), **loops)
        elif name == "provider" and labels:
            yield _entity(**at, kind="provider", address=f"provider.{labels[0]}" + (f".{_text(get('alias'))}" if _text(get("alias")) else ""), name=labels[0], provider_local=labels[0], provider_alias=_text(get("alias")), region=_text(get("region")), profile=_text(get("profile")), body=rest("alias"))
        elif name == "variable" and labels:
            yield _entity(**at, kind="variable", address=f"var.{labels[0]}", name=labels[0], body=rest())
        elif name == "output" and labels and get("value"):
            yield _entity(**at, kind="output", address=f"output.{labels[0]}", name=labels[0], body=rest())
        elif name == "locals":
            for k in dict.fromkeys(k for k, _ in body):
                yield _entity(**at, kind="local", address=f"local.{k}", name=k, body=json.dumps([["value", nodes[k]]]))


def _instances(count: list | None, for_each: list | None) -> list[str] | None:
    """Address suffixes; None for a template row."""
    if count and count[0] == "lit" and isinstance(count[1], int) and not isinstance(count[1], bool):
        return [f"[{i}]" for i in range(count[1])] if count[1] <= MAX_INSTANCES else None
    if for_each and for_each[0] == "lit":
        v = for_each[1]
        keys = [k for k, _ in v["m"]] if isinstance(v, dict) else v if isinstance(v, list) and all(isinstance(x, str) for x in v) else None
        if keys is not None and len(keys) <= MAX_INSTANCES:
            return [f'["{k.translate({34: None, 92: None})}"]' for k in dict.fromkeys(keys)]
    return None


def _load(s: str | None):
    return json.loads(s) if s else None


def _calls(r: dict) -> Iterator[dict]:
    """A call's instances: what is inlined, where, and with which inputs."""
    if not r["source"].startswith(("./", "../")):
        return
    outer = dict(map(tuple, json.loads(r["inputs"] or "[]")))
    inputs = [[k, ev.substitute(v, outer)] for k, v in json.loads(r["body"])]
    target = posixpath.normpath(posixpath.join(r["dir"] or ".", r["source"]))
    base = {"component_path": r["component_path"], "prefix": r["prefix"], "inputs": None, "given": None, "chain": r["chain"], "file": r["file"], "line": r["line"], "column": r["column"]}
    if target.startswith(".."):
        yield base | {"problem": "TF1502", "target": f"module {r['name']} lies outside of the root"}
        return
    if target in r["chain"]:
        yield base | {"problem": "TF1504", "target": f"module {r['name']} calls itself: {' -> '.join([*r['chain'], target])}"}
        return
    if _over(_load(r["count"]), _load(r["for_each"])):
        yield base | {"problem": "TF1505", "target": f"module {r['name']} has more than {MAX_INSTANCES} instances"}
    given = json.loads(r["given"] or "{}") | json.loads(r["providers"] or "{}")  # what is declared overrides what is inherited
    found = _instances(_load(r["count"]), _load(r["for_each"]))
    for suffix in [""] if found is None else found:
        yield base | {"prefix": f"{r['prefix']}module.{r['name']}{suffix}.", "target": target, "inputs": json.dumps(inputs), "given": json.dumps(given), "chain": [*r["chain"], target], "problem": None}


_CALL = "component_path string, prefix string, target string, inputs string, given string, chain array<string>, problem string, file string, line int, column int"


def _over(count: list | None, for_each: list | None) -> bool:
    """Whether a known number of instances is over the cap, so that one template row stands for them."""
    if count and count[0] == "lit" and isinstance(count[1], int) and not isinstance(count[1], bool):
        return count[1] > MAX_INSTANCES
    v = for_each[1] if for_each and for_each[0] == "lit" else None
    return (len(v["m"]) if isinstance(v, dict) else len(v) if isinstance(v, list) else 0) > MAX_INSTANCES


def _finish(r: dict) -> Iterator[dict]:
    """Substitution, instances, references and rendering of one entity under one prefix."""
    inputs = dict(map(tuple, json.loads(r["inputs"] or "[]")))
    body = [[k, ev.substitute(v, inputs) if inputs else v] for k, v in json.loads(r["body"])]
    count, for_each = (ev.substitute(x, inputs) if x else None for x in (_load(r["count"]), _load(r["for_each"])))
    out = {k: r[k] for k in ("component_path", "kind", "type", "name", "provider_local", "provider_alias", "source", "region", "profile", "depends_on", "file", "line", "column", "ord")}
    given = json.loads(r["given"] or "{}").get(r["provider_local"])
    if given:
        out["provider_local"], out["provider_alias"] = given
    linked = r["kind"] in ("resource", "data", "module")
    out["refs"] = [{"target": s, "attr": a} for k, v in body for kind, s, a in ev.references(v, (k,)) if kind in ("Resource", "Data", "Module")] if linked else []
    out["unresolved"] = sum(ev.unresolved(v) for _, v in body) if r["kind"] in ("resource", "data", "module", "output", "local") else 0
    out["attributes_json"] = render.attributes(body)
    suffixes = _instances(count, for_each) if r["kind"] in ("resource", "data") else None
    out["problem"] = "TF1505" if r["kind"] in ("resource", "data") and _over(count, for_each) else None
    for s in suffixes if suffixes is not None else [None]:
        yield out | {"address": r["prefix"] + r["address"] + (s or ""), "count_expr": render.source(count) if s is None else "", "for_each_expr": render.source(for_each) if s is None else ""}


#: Bytes of wrapper files that are sent to every task; beyond, a component gets those of its ancestors by a join.
WRAPPER_BYTES = 32 << 20


def _with_wrappers(known: DataFrame, found: DataFrame) -> tuple[DataFrame, dict[str, str] | None]:
    hcl = found.filter(F.col("name").endswith(".hcl"))
    if hcl.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= WRAPPER_BYTES:
        return known, {r.path: r.text for r in hcl.select("path", "text").collect()}
    wrapped = known.filter("name = 'terragrunt.hcl'").select(F.col("dir").alias("_d"))
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("_d", "/"))), lambda n: F.array_join(F.slice(F.split("_d", "/"), F.lit(1), n), "/"))
    above = wrapped.select("_d", F.explode(up).alias("dir")).filter("dir <> _d").join(hcl, "dir")
    return known.unionByName(above.select("path", F.col("_d").alias("dir"), "name", "size", "text")), None


@dataclass(frozen=True)
class Stages:
    """The steps that a caller may replace, each by one of the same arguments and columns."""

    files: Callable = files
    directories: Callable = directories
    evaluate: Callable = evaluate_directory


def read_workspace(spark: SparkSession, root: str, variables: dict[str, object] | None = None, environment: str | None = None, profiles: DataFrame | None = None, env: dict[str, str] | None = None, strict_providers: bool = False, walk: WalkOptions = WalkOptions(), registry: fn.Registry | None = None, stages: Stages = Stages()) -> Workspace:
    """The four tables of a source tree, and what went wrong. profiles: profile, account_id, account_name; env: what
    get_env() may see. strict_providers: raise ProfilesMissing if a provider names a profile that the map lacks.
    walk: which files are read; a tree of more files than it allows raises LimitExceeded. registry: the functions."""
    tree = Tree(spark, root, walk)
    found = stage(stages.files(tree))
    if found.count() > walk.max_files:
        raise LimitExceeded(f"more than {walk.max_files} files")
    kinds = stage(stages.directories(found, walk.modules).select("dir", F.col("kind").alias("dir_kind"), "has_terragrunt", "ambiguous"))
    known = found.join(kinds.filter("dir_kind in ('component', 'module')").select("dir"), "dir", "left_semi")
    known, wrappers = _with_wrappers(known, found)
    evaluate = partial(stages.evaluate, variables=variables or {}, environment=environment, wrappers=wrappers, root=os.path.abspath(root) if "://" not in root else "/", env=env or {}, assets=assets(tree, found), registry=registry)
    entities = stage(map_groups(known, "dir", evaluate, ENTITY))
    components = kinds.filter("dir_kind = 'component'").select(F.col("dir").alias("component_path"), "has_terragrunt")

    wrapped = entities.filter("kind = 'wrapper'")
    own = entities.filter("kind not in ('diagnostic', 'wrapper', 'backend')").join(components.select(F.col("component_path").alias("dir")), "dir", "left_semi")
    bound = own.select("*", F.col("dir").alias("component_path"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("inputs"), F.lit(None).cast("string").alias("given"), F.array("dir").alias("chain"))
    inner = entities.filter("kind in ('resource', 'data', 'module')")
    parts, level = [bound], stage(map_rows(bound.filter("kind = 'module'"), _calls, _CALL))
    bodies = kinds.filter("dir_kind in ('component', 'module')").select(F.col("dir").alias("target"))
    place = ("file", "line", "column")
    troubles = []
    for _ in range(MAX_DEPTH):
        if level.isEmpty():
            break
        troubles.append(level.filter("problem is not null").select(F.col("problem").alias("code"), F.col("target").alias("message"), *place))
        level = level.filter("problem is null").drop("problem")
        troubles.append(level.join(bodies, "target", "left_anti").select(F.lit("TF1503").alias("code"), F.concat(F.lit("there is no module at "), "target").alias("message"), *place))
        level = level.drop(*place)
        body = level.join(inner, level["target"] == inner["dir"])
        parts.append(body.filter("kind <> 'module'").select(*bound.columns))
        level = stage(map_rows(body.filter("kind = 'module'").select(*bound.columns), _calls, _CALL))
    troubles.append(level.select(F.coalesce("problem", F.lit("TF1501")).alias("code"), F.when(F.col("problem").isNull(), F.concat(F.lit("calls are nested too deep at "), "target")).otherwise(F.col("target")).alias("message"), *place))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rows = stage(map_rows(every, _finish, FINAL))
    troubles.append(rows.filter("problem is not null").select(F.col("problem").alias("code"), F.concat("address", F.lit(f" has more than {MAX_INSTANCES} instances")).alias("message"), *place))
    troubles.append(rows.filter(~C.valid_address("address")).select(F.lit("TF1507").alias("code"), F.concat(F.lit("no address: "), "address").alias("message"), *place))
    valid, keys, order = rows.filter(C.valid_address("address")).drop("problem"), ["component_path", "address"], ["ord", *place]
    troubles.append(later_ones(valid.select(*keys, *order), keys, order).select(F.lit("TF1506").alias("code"), F.concat("address", F.lit(" is there already")).alias("message"), *place))
    rows = stage(first_by(valid, keys, order))

    mapped = profiles is not None
    profiles = profiles.select("profile", "account_id", "account_name") if mapped else spark.range(0).select(F.lit("").alias("profile"), F.lit("").alias("account_id"), F.lit("").alias("account_name"))
    declared = rows.filter("kind = 'provider'")
    if mapped:
        missing = stage(provider_ops.missing_profiles(declared, profiles))
        if strict_providers and not missing.isEmpty():
            raise ProfilesMissing(", ".join(r[0] for r in missing.orderBy("profile").limit(20).collect()))
        troubles.append(missing.select(F.lit("TF1601").alias("code"), F.concat(F.lit("no account is known for profile "), "profile").alias("message"), F.lit("").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column")))
    alias = ["component_path", "provider_local", "provider_alias"]
    unknown = rows.filter("kind in ('resource', 'data') and provider_alias is not null").join(declared.select(*alias), alias, "left_anti").groupBy(*alias).agg(F.min(F.struct("ord", *place)).alias("first"))
    troubles.append(unknown.select(F.lit("TF1602").alias("code"), F.concat_ws(" ", "component_path", F.lit("has no provider"), F.concat_ws(".", "provider_local", "provider_alias")).alias("message"), *(F.col(f"first.{c}").alias(c) for c in place)))
    # a component's state is that of its wrapper's backend, or else of its own
    state = entities.filter("kind in ('wrapper', 'backend') and source is not null").select(F.col("dir").alias("component_path"), F.col("source").alias("state_backend_kind"), F.col("region").alias("state_region"), "profile", C.account_of_role("provider_local").alias("_role_account"))
    state = stage(state.join(profiles.select("profile", "account_id"), "profile", "left").select("component_path", "state_backend_kind", "state_region", F.coalesce("account_id", "_role_account").alias("state_account_id")))
    layered = wrapped.select(F.col("dir").alias("component_path"), F.col("type").alias("_region"), F.col("name").alias("_account"))
    named = provider_ops.account_names(profiles).select(F.col("account_id").alias("_account"), F.col("account_name").alias("_account_name"))
    resolved = _providers(rows, profiles).join(layered, "component_path", "left").join(named, "_account", "left")
    linked = F.col("kind").isin("resource", "data")
    for c, other in (("account_name", F.when(F.col("account_id").isNull(), F.col("_account_name"))), ("account_id", F.col("_account")), ("region", F.col("_region"))):
        resolved = resolved.withColumn(c, F.when(linked, F.coalesce(c, other)).otherwise(F.col(c)))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    resolved = resolved.join(state.select("component_path", "state_account_id", "state_region"), "component_path", "left")
    resources = resolved.select(
        F.lit(root).alias("workspace_root"), "component_path", C.module_path("address").alias("module_path"), "address", "kind", blank("type").alias("resource_type"), F.col("name").alias("resource_name"),
        F.concat_ws(".", "provider_local", "provider_alias").alias("provider_local"), blank("source").alias("provider_source"), blank("account_id").alias("account_id"), blank("account_name").alias("account_name"), blank("region").alias("region"),
        F.lit("").alias("environment"), "count_expr", "for_each_expr", "depends_on", "attributes_json", blank("state_account_id").alias("state_account_id"), blank("state_region").alias("state_region"), "file", "line", "column", F.lit(PARSER_VERSION).alias("parser_version"), F.current_timestamp().alias("parsed_at"),
    )
    counted = summary.component_summary(components.select("component_path"), rows.select("component_path", "kind"), rows.filter("false").select("component_path", F.lit("").alias("environment")))
    unresolved = rows.groupBy("component_path").agg(F.sum("unresolved").alias("unresolved_count"))
    component_rows = counted.join(components, "component_path").join(unresolved, "component_path", "left").withColumn("unresolved_count", F.coalesce("unresolved_count", F.lit(0)))
    component_rows = component_rows.join(state, "component_path", "left")
    component_rows = component_rows.select("component_path", F.lit("component").alias("kind"), *(c for c in component_rows.columns if c.endswith("_count") and c != "unresolved_count"), "environments_seen", "has_terragrunt", *(F.coalesce(c, F.lit("")).alias(c) for c in ("state_backend_kind", "state_account_id", "state_region")), "unresolved_count")
    calls = entities.filter("kind = 'module' and source <> ''").select(C.module_source_kind("source").alias("source_kind"), F.col("source").alias("source_raw"), *place)
    walked = kinds.filter("dir_kind = 'module'").select(F.lit("local").alias("source_kind"), F.col("dir").alias("source_raw"))
    diagnostics = entities.filter("kind = 'diagnostic'").select(F.col("name").alias("code"), F.col("body").alias("message"), *place)
    for x in troubles:
        diagnostics = diagnostics.unionByName(x)
    diagnostics = diagnostics.unionByName(unread(tree), allowMissingColumns=True)
    unsure = kinds.filter("ambiguous").select(F.lit("TF1120").alias("code"), F.lit("a component where modules are").alias("message"), F.col("dir").alias("file"))
    diagnostics = diagnostics.unionByName(unsure, allowMissingColumns=True).distinct()
    return Workspace(resources, _edges(rows, wrapped), component_rows, summary.modules_table(calls, walked), diagnostics, summary.external_modules(calls))


def _providers(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """A resource's provider is the one it names, or else the first without an alias, aws before others."""
    declared = rows.filter("kind = 'provider'").select("component_path", "provider_local", "provider_alias", "region", "profile", "ord")
    default = declared.filter("provider_alias is null").groupBy("component_path").agg(F.min(F.struct((F.col("provider_local") != "aws").alias("a"), "ord", "provider_local")).alias("d")).select("component_path", F.col("d.provider_local").alias("_default"))
    named = declared.select(F.concat_ws("\u0000", "component_path", "provider_local").alias("local_name"), F.col("provider_alias").alias("alias"), "ord", "profile", "region")
    own = rows.drop("region", "profile").filter("kind in ('resource', 'data')").join(default, "component_path", "left")
    own = own.withColumn("local_name", F.concat_ws("\u0000", "component_path", F.coalesce("provider_local", "_default"))).withColumn("alias", F.col("provider_alias"))
    out = provider_ops.resolve(own, named, profiles).drop("local_name", "alias", "_default")
    rest = rows.filter("kind not in ('resource', 'data')").join(profiles, "profile", "left")
    return out.unionByName(rest)


def _edges(rows: DataFrame, wrapped: DataFrame) -> DataFrame:
    """Explicit and inferred edges, once each, the first in source order."""
    at = ["component_path", "ord", "file", "line", "column"]
    explicit = rows.select("address", *at, F.posexplode("depends_on").alias("k", "target")).select("address", *at, "k", "target", F.lit("explicit_depends_on").alias("edge_kind"), F.lit("depends_on").alias("source_attr"))
    kind = F.when(F.col("kind") == "module", "module_input").otherwise("attr_ref")
    inferred = rows.select("address", *at, kind.alias("edge_kind"), F.posexplode("refs").alias("k", "r")).select("address", *at, (F.col("k") + 1_000_000).alias("k"), F.col("r.target").alias("target"), "edge_kind", F.col("r.attr").alias("source_attr"))
    both = explicit.unionByName(inferred).withColumn("to_address", C.resource_head("target")).filter("to_address is not null")
    between = wrapped.select("address", F.col("dir").alias("component_path"), "ord", "file", "line", "column", F.posexplode("depends_on").alias("k", "to_address")).select("address", *at, "k", "to_address", F.lit("terragrunt_dependency").alias("edge_kind"), F.lit("dependency").alias("source_attr"))
    both = both.drop("target").unionByName(between)
    return edge_ops.distinct_edges(both.withColumnRenamed("address", "from_address"), ["component_path", "ord", "k"]).select("from_address", "to_address", "edge_kind", "source_attr", "file", "line", "column")

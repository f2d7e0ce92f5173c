"""Source trees as DataFrames: files, and what each directory is."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.hcl.files import glob_pattern
from hexloom.session import ship
from hexloom.sources.globs import glob_set, ignore_rules, ignored

MAX_FILE_BYTES = 4 << 20
MAX_DEPTH = 16
MAX_FILES = 200_000
#: Bytes that ignore files, and files whose names begin with "_", may have together: the driver reads them.
DRIVER_BYTES = 32 << 20
#: What a walk leaves out, and which folders are modules.
EXCLUDED = ("**/.git", "**/.git/**", "**/.terraform", "**/.terraform/**", "**/.terragrunt-cache", "**/.terragrunt-cache/**")
MODULES = ("modules/*", "modules/**", "modules-tf12/*", "modules-tf12/**", "**/modules/*", "**/modules-tf12/*")
#: What makes a directory what it is.
PROBES = {
    "has_terraform": r"(?m)^\s*terraform\s*\{",
    "has_backend": r'(?m)^\s*backend\s+"[^"]+"\s*\{',
    "has_resource": r'(?m)^\s*resource\s+"[^"]+"\s+"[^"]+"\s*\{',
    "has_data": r'(?m)^\s*data\s+"[^"]+"\s+"[^"]+"\s*\{',
    "has_variable": r'(?m)^\s*variable\s+"[^"]+"\s*\{',
    "has_include": r'(?m)^\s*include(\s+"[^"]*")?\s*\{',
}


class LimitExceeded(RuntimeError):
    """A tree has more files, or more of what the driver has to read, than the walk's options allow."""


@dataclass(frozen=True)
class WalkOptions:
    """exclude and modules: globs of paths from the root, of which * and ? go over folders; exclude adds to EXCLUDED."""

    max_depth: int = MAX_DEPTH
    max_file_bytes: int = MAX_FILE_BYTES
    max_files: int = MAX_FILES
    exclude: tuple[str, ...] = ()
    modules: tuple[str, ...] = MODULES
    ignore_files: bool = True


class Tree:
    """A source tree's files, which the engine lists and reads in parallel.

    The engine's readers pass over names that begin with "_", so that folders of that kind are given to them by name, and
    such files, which have to be few, are read by the driver. Hidden names are left out, and what ignore files name.
    """

    def __init__(self, spark: SparkSession, root: str, options: WalkOptions = WalkOptions()):
        self.spark, self.options = spark, options
        self.base = root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root)
        self.plain = re.sub(r"^file:/+", "/", self.base)
        self.excluded = glob_set((*EXCLUDED, *options.exclude))
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._read_bytes = 0
        found = [x for d in range(options.max_depth) for x in self._matched("/*" * d + "/{_*,.gitignore,.ignore}")]
        self.folders = [p for p, folder, _ in found if folder]
        self._own = [(p, size) for p, folder, size in found if not folder and p.rsplit("/", 1)[-1].startswith("_")]
        rules = [self._rules(p) for p, folder, _ in found if not folder and p.rsplit("/", 1)[-1].startswith(".")] if options.ignore_files else []
        # .ignore before .gitignore, deeper folders before those above, later lines before earlier ones
        self.rules = [r for _, _, lines in sorted(rules, key=lambda x: x[:2]) for r in reversed(lines)]

    def _matched(self, glob: str) -> list[tuple[str, bool, int]]:
        """(path from the root, whether a folder, size) of what matches and does not stand in a hidden folder."""
        escaped = re.sub(r"([*?{}\[\]\\])", r"\\\1", self.base)
        out = []
        for x in self._fs.globStatus(self._path(escaped + glob)) or ():
            path = re.sub("^file:/+", "/", x.getPath().toString()).removeprefix(self.plain + "/")
            if not any(p.startswith(".") for p in path.split("/")[:-1]):
                out.append((path, x.isDirectory(), x.getLen()))
        return out

    def _read(self, path: str) -> bytes:
        at = self._path(f"{self.base}/{path}")
        self._read_bytes += self._fs.getFileStatus(at).getLen()
        if self._read_bytes > DRIVER_BYTES:
            raise LimitExceeded(f"ignore files and files named _* have more than {DRIVER_BYTES} bytes")
        stream = self._fs.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _rules(self, path: str) -> tuple[bool, int, list]:
        folder, _, name = path.rpartition("/")
        return name == ".gitignore", -len(path.split("/")), ignore_rules(folder, self._read(path).decode("utf-8", "replace"))

    def listed(self, pattern: str = "*.{tf,hcl,tfvars}") -> DataFrame:
        """path (relative), size and content of all files whose names match; content is read only where used."""
        df = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load([self.base, *(f"{self.base}/{p}" for p in self.folders)])
        rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(self.plain)}/", "")
        df = df.select(rel.alias("path"), F.col("length").alias("size"), "content")
        known = glob_pattern(pattern)
        own = [(p, size, bytearray(self._read(p)) if size <= self.options.max_file_bytes else None) for p, size in self._own if known.fullmatch(p.rsplit("/", 1)[-1])]
        if own:
            df = df.unionByName(self.spark.createDataFrame(own, "path string, size long, content binary"))
        df = df.filter(~F.col("path").rlike(r"(^|/)\.[^/]") & ~F.col("path").rlike(self.excluded))
        if self.rules:
            ship(self.spark)
            df = df.filter(_kept(self.rules)("path"))
        return df.filter(F.size(F.split("path", "/")) <= self.options.max_depth)


def _kept(rules: list[tuple[str, bool, bool]]):
    """Whether a path is kept by ignore rules; only paths go to Python."""

    @F.pandas_udf("boolean")
    def kept(paths: pd.Series) -> pd.Series:
        compiled = [(re.compile(p, re.S), negated, folders) for p, negated, folders in rules]
        return paths.map(lambda p: not ignored(p, compiled)).astype(bool)

    return kept


def files(tree: Tree) -> DataFrame:
    """path (relative), dir, name, size, text of all configuration files."""
    name = F.element_at(F.split("path", "/"), -1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    df = tree.listed().filter(F.col("size") <= tree.options.max_file_bytes)
    return df.select("path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), name.alias("name"), "size", text.alias("text")).filter("text is not null")


def unread(tree: Tree) -> DataFrame:
    """(code, message, file) of configuration files that files() leaves out: too large (TF1103), or not UTF-8 (TF1202)."""
    limit = tree.options.max_file_bytes
    large = tree.listed().filter(F.col("size") > limit).select(F.lit("TF1103").alias("code"), F.concat(F.col("size"), F.lit(f" bytes, more than {limit}")).alias("message"), F.col("path").alias("file"))
    other = tree.listed().filter((F.col("size") <= limit) & F.try_validate_utf8(F.col("content").cast("string")).isNull())
    return large.unionByName(other.select(F.lit("TF1202").alias("code"), F.lit("not UTF-8").alias("message"), F.col("path").alias("file")))


def root_config(found: DataFrame) -> str | None:
    """The path of the tree's root configuration, that of the root itself first."""
    there = {r.path for r in found.filter(F.col("path").isin("root.hcl", "terraform/root.hcl")).select("path").collect()}
    return next((p for p in ("root.hcl", "terraform/root.hcl") if p in there), None)


def directories(found: DataFrame, modules: tuple[str, ...] = MODULES) -> DataFrame:
    """dir, kind (component, module, environments, files), from the union of its files' signals, and whether a component
    is where the module globs are (ambiguous)."""
    flags = [F.bool_or(F.col("text").rlike(p)).alias(k) for k, p in PROBES.items()]
    d = found.groupBy("dir").agg(*flags, F.bool_or(F.col("name") == "terragrunt.hcl").alias("has_terragrunt"))
    named = F.col("dir").rlike(glob_set(modules)) if modules else F.lit(False)
    return d.withColumn("kind", kind(named)).withColumn("ambiguous", (F.col("kind") == "component") & named)


def kind(module: Column) -> Column:
    return (
        F.when(F.col("dir") == "environments", "environments")
        .when(F.expr("has_terragrunt and has_include"), "component")
        .when(F.expr("has_backend and has_terraform"), "component")
        .when(F.expr("has_resource or has_data") & ~module, "component")
        .when(module, "module")
        .when(F.expr("has_variable and not (has_resource or has_data or has_backend or has_terragrunt)"), "module")
        .otherwise("files")
    )


#: Bytes of texts, and of paths, that the file functions may bring to every task; beyond, their calls stay symbolic.
ASSET_BYTES = 32 << 20
_FILE_CALL = r'\b(?:file|templatefile|fileexists|fileset)\s*\('
_NAMED = r'\b(?:file|templatefile|fileexists)\s*\([^)]*?([A-Za-z0-9_.-]+)"'


def assets(tree: Tree, found: DataFrame) -> tuple[dict[str, str | None], bool]:
    """What the file functions may see: texts by path of the files that calls name, the paths of all others (None),
    and whether all paths are there. Nothing is listed unless some file calls one of these functions."""
    calls = found.filter(F.col("text").rlike(_FILE_CALL))
    if calls.isEmpty():
        return {}, False
    every = tree.listed("*")
    if every.agg(F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()[0] > ASSET_BYTES:
        return {}, False
    out: dict[str, str | None] = {r.path: None for r in every.select("path").collect()}
    names = calls.select(F.explode(F.regexp_extract_all("text", F.lit(_NAMED), 1)).alias("name")).distinct()
    named = every.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(names, "name", "left_semi").filter(F.col("size") <= tree.options.max_file_bytes)
    if named.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] <= ASSET_BYTES:
        out |= {r.path: r.text for r in named.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).collect()}
    return out, True

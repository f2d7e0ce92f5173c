"""The tables as single Parquet files with a hashed manifest, and its verification."""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.plans.workspace import PARSER_VERSION, Workspace
from hexloom.session import stage

SCHEMA_MAJOR, SCHEMA_MINOR = 0, 1
MANIFEST = "workspace.manifest.json"
#: Each table's order.
ORDER = {"resources": ["component_path", "module_path", "address"], "dependencies": ["from_address", "to_address", "edge_kind"], "components": ["component_path"], "modules": ["source_raw", "source_kind"]}


#: Rows in a file, about; a larger table is split by ranges of its order.
FILE_ROWS = 5_000_000


class Folder:
    """A folder of any file system that the engine can reach; all machines see it, if all see the file system."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, (uri if "://" in uri or uri.startswith("file:") else Path(uri).absolute().as_uri()).rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def move(self, old: str, new: str) -> None:
        """Rename, over what may be there."""
        if self.exists(new):
            self.delete(new)
        if not self.fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} cannot be renamed to {new} in {self.uri}")
        if self._path("").toUri().getScheme() == "file":
            # its checksum files would make readers fail on a changed file, which verify() is to tell
            Path(self._path(f".{new}.crc").toUri().getPath()).unlink(missing_ok=True)

    def write_text(self, name: str, text: str) -> None:
        out = self.fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
            out.hflush()
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.text(f"{self.uri}/{name}", wholetext=True).collect())

    def facts(self, names: list[str]) -> dict[str, tuple[int, str]]:
        """Size and SHA-256 of files, found by tasks where the files are."""
        there = [n for n in names if self.exists(n)]
        if not there:
            return {}
        files = self.spark.read.format("binaryFile").load([f"{self.uri}/{n}" for n in there])
        return {r[0].rsplit("/", 1)[1]: (r[1], r[2]) for r in files.select("path", "length", F.sha2("content", 256)).collect()}


def _write(df: DataFrame, name: str, out: Folder, compression: str, level: int) -> list[dict]:
    """The table's files, written aside and renamed when all are whole."""
    aside = f".{name}.{uuid.uuid4().hex}.partial"
    df = stage(df)
    n = max(1, -(-df.count() // FILE_ROWS))
    ordered = df.repartitionByRange(n, *ORDER[name]) if n > 1 else df.coalesce(1)
    ordered.sortWithinPartitions(*ORDER[name]).write.option("compression", compression).option("parquet.compression.codec.zstd.level", level).parquet(f"{out.uri}/{aside}")
    parts = [x for x in out.names(aside) if x.startswith("part-")]
    targets = [f"{name}.parquet" if len(parts) == 1 else f"{name}-{k:05}.parquet" for k in range(len(parts))]
    for part, target in zip(parts, targets):
        out.move(f"{aside}/{part}", target)
    out.delete(aside)
    facts = out.facts(targets)
    rows = [df.sparkSession.read.parquet(f"{out.uri}/{t}").count() for t in targets]
    return [{"name": t, "rows": k, "bytes": facts[t][0], "sha256": facts[t][1]} for t, k in zip(targets, rows)]


def export(ws: Workspace, out: str, overwrite: bool = False, compression: str = "zstd", command_line: str = "", tables: list[str] | None = None, level: int = 3) -> dict:
    """Write the tables (all four, or those named) and the manifest into a folder (a path, or a URI of a file system that
    all machines see); returns the manifest, which is written last."""
    if compression not in ("zstd", "snappy", "none"):
        raise ValueError(f"unknown compression {compression!r}")
    folder = Folder(ws.resources.sparkSession, out)
    folder.make()
    there = [x for x in folder.names("") if x == MANIFEST or x.endswith(".parquet") and x.removesuffix(".parquet").rpartition("-")[0] in ("", *ORDER) and (x.removesuffix(".parquet") in ORDER or "-" in x)]
    if there and not overwrite:
        raise FileExistsError(", ".join(there))
    for x in there:
        folder.delete(x)
    found = [x for n in tables or ORDER for x in _write(getattr(ws, n), n, folder, compression, level)]
    manifest = {"writer_version": PARSER_VERSION, "schema_major": SCHEMA_MAJOR, "schema_minor": SCHEMA_MINOR, "generated_at_ms": int(time.time() * 1000), "command_line": redact(command_line), "files": found}
    folder.write_text(MANIFEST + ".partial", json.dumps(manifest, indent=2))
    folder.move(MANIFEST + ".partial", MANIFEST)
    return manifest


def redact(line: str) -> str:
    """A command line without arguments that look like secrets, cut to 4 KiB."""
    out, hide = [], False
    for x in line.split():
        secret = any(s in x.lower() for s in ("token", "secret", "password"))
        out.append("<redacted>" if secret or hide else x)
        hide = secret and "=" not in x
    return " ".join(out)[:4096]


def verify(out: str, spark: SparkSession | None = None) -> list[str]:
    """The files whose size or hash is not what the manifest says."""
    folder = Folder(spark or SparkSession.builder.getOrCreate(), out)
    files = json.loads(folder.read_text(MANIFEST))["files"]
    facts = folder.facts([x["name"] for x in files])
    return [x["name"] for x in files if facts.get(x["name"]) != (x["bytes"], x["sha256"])]

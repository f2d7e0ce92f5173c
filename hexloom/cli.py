"""Command line: parse a tree into tables, verify them, show the schema or the version."""

from __future__ import annotations

import argparse
import json
import os
import sys

from hexloom import __version__

COLUMNS = "workspace_root component_path module_path address kind resource_type resource_name provider_local provider_source account_id account_name region environment count_expr for_each_expr depends_on attributes_json state_account_id state_region file line column parser_version parsed_at".split()


#: Diagnostics that are shown; all of them are in the workspace's table.
MOST_SHOWN = 200
#: What a run ends with.
EXIT_OTHER, EXIT_USAGE, EXIT_IO, EXIT_LIMIT, EXIT_PROVIDER, EXIT_EXPORT = 1, 2, 3, 4, 6, 7


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hexloom")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("parse", help="parse a tree into tables")
    a.add_argument("root")
    a.add_argument("-o", "--out", default="./hexloom-out")
    a.add_argument("--overwrite", action="store_true")
    a.add_argument("--parsed-at", metavar="TIME", help="the rows' parsed_at, for runs that can be repeated")
    a.add_argument("--compression", default="zstd", choices=["zstd", "snappy", "none"])
    a.add_argument("--zstd-level", type=int, default=3, choices=range(1, 23), metavar="1..22")
    a.add_argument("--tables", default="all", choices=["all", "resources"])
    a.add_argument("--environment")
    a.add_argument("--region", help="the region of resources that have none")
    a.add_argument("--var", action="append", default=[], metavar="NAME=VALUE")
    maps = a.add_mutually_exclusive_group()
    maps.add_argument("--profile-map", metavar="PATH", help="profiles and their accounts, as YAML")
    maps.add_argument("--aws-config", metavar="PATH", help="profiles, as an INI file")
    a.add_argument("--strict-providers", action="store_true")
    a.add_argument("--env-mode", default="strict", choices=["strict", "passthrough", "mock"], help="what get_env() sees: allowed names, all, or nothing")
    a.add_argument("--allow-env", action="append", default=[], metavar="NAME")
    a.add_argument("--exclude", action="append", default=[], metavar="GLOB", help="paths that are left out")
    a.add_argument("--module-glob", action="append", default=[], metavar="GLOB", help="folders that are modules, in place of the usual ones")
    a.add_argument("--max-files", type=int, metavar="N")
    a.add_argument("--no-ignore-files", action="store_true", help="read what .gitignore and .ignore leave out, too")
    sub.add_parser("verify", help="check the files of an export").add_argument("out")
    sub.add_parser("schema", help="the columns of the main table")
    sub.add_parser("version")
    return p


def environment_of(mode: str, allowed: list[str]) -> dict[str, str]:
    """What get_env() may see of this process's variables."""
    if mode == "mock":
        return {}
    return dict(os.environ) if mode == "passthrough" else {k: os.environ[k] for k in allowed if k in os.environ}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)  # ends with code 2 where arguments are wrong
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "schema":
        print(json.dumps({"schema_major": 0, "schema_minor": 1, "columns": COLUMNS}))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from hexloom.plans import export
    from hexloom.plans.workspace import ProfilesMissing, read_workspace
    from hexloom.sources.globs import GlobError
    from hexloom.sources.profiles import ProfileError, read_profiles
    from hexloom.sources.workspace import MAX_FILES, MODULES, LimitExceeded, WalkOptions

    spark = SparkSession.builder.appName("hexloom").getOrCreate()
    if args.command == "verify":
        bad = export.verify(args.out, spark)
        for x in bad:
            print(f"changed: {x}", file=sys.stderr)
        return EXIT_EXPORT if bad else 0
    if any("=" not in v for v in args.var):
        print("--var takes NAME=VALUE", file=sys.stderr)
        return EXIT_USAGE
    if "://" not in args.root and not os.path.isdir(args.root):
        print(f"not a folder: {args.root}", file=sys.stderr)
        return EXIT_IO
    try:
        path = args.profile_map or args.aws_config
        profiles = read_profiles(spark, path) if path else None
        walk = WalkOptions(max_files=MAX_FILES if args.max_files is None else args.max_files, exclude=tuple(args.exclude), modules=tuple(args.module_glob) or MODULES, ignore_files=not args.no_ignore_files)
        ws = read_workspace(spark, args.root, dict(v.partition("=")[::2] for v in args.var), args.environment, profiles, environment_of(args.env_mode, args.allow_env), args.strict_providers, walk)
        if args.region:
            ws.resources = ws.resources.withColumn("region", F.when((F.col("region") == "") & F.col("kind").isin("resource", "data"), args.region).otherwise(F.col("region")))
        if args.parsed_at:
            ws.resources = ws.resources.withColumn("parsed_at", F.lit(args.parsed_at).cast("timestamp"))
        tables = ["resources"] if args.tables == "resources" else None
        manifest = export.export(ws, args.out, args.overwrite, args.compression, " ".join(sys.argv), tables, args.zstd_level)
    except GlobError as e:
        print(f"glob {e}", file=sys.stderr)
        return EXIT_USAGE
    except LimitExceeded as e:
        print(e, file=sys.stderr)
        return EXIT_LIMIT
    except FileExistsError as e:
        print(f"already there: {e}", file=sys.stderr)
        return EXIT_IO
    except OSError as e:
        print(e, file=sys.stderr)
        return EXIT_IO
    except (ProfilesMissing, ProfileError) as e:
        print(f"profiles: {e}", file=sys.stderr)
        return EXIT_PROVIDER
    for r in ws.diagnostics.orderBy("code", "file", "line").limit(MOST_SHOWN).collect():
        print(f"{r.code} {r.file or '-'}:{r.line or '-'} {r.message}", file=sys.stderr)
    for x in manifest["files"]:
        print(f"{x['name']}: {x['rows']} rows, {x['bytes']} bytes")
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Profile maps: which account a credentials profile belongs to."""

from __future__ import annotations

import configparser
import re

from pyspark.sql import DataFrame, SparkSession

MAX_BYTES = 256 << 10
MAX_HOPS = 8
SCHEMA = "profile string, account_id string, account_name string, region string, role_arn string"
_ACCOUNT = re.compile(r"[0-9]{12}")
_REGION = re.compile(r"[a-z0-9-]{1,32}")
_ROLE = re.compile(r"arn:aws:iam::([0-9]{12}):role/")


class ProfileError(ValueError):
    pass


def _text(path: str) -> str:
    with open(path, "rb") as f:
        data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ProfileError(f"{path} is larger than {MAX_BYTES} bytes")
    return data.decode()


def parse_yaml(text: str) -> list[tuple]:
    """`profiles:` with a mapping for each name; only plain scalars, and only the four known fields."""
    out: dict[str, dict[str, str]] = {}
    name, inside, margin = None, False, None
    for n, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip() or line.strip() == "---":
            continue
        indent = len(line) - len(line.lstrip(" "))
        m = re.fullmatch(r"""\s*("[^"]*"|'[^']*'|[^:\s][^:]*):(?:\s+(.*))?""", line)
        if not m:
            raise ProfileError(f"line {n}: expected a key")
        key, value = m[1].strip("\"'"), (m[2] or "").strip().strip("\"'")
        if indent == 0:
            if key != "profiles" or value:
                raise ProfileError(f"line {n}: unknown field {key!r}")
            inside = True
        elif not inside:
            raise ProfileError(f"line {n}: not under profiles")
        elif margin is None or indent == margin:
            margin, name = indent, key
            if value or key in out:
                raise ProfileError(f"line {n}: profile {key!r} is not a mapping of its own")
            out[key] = {}
        elif indent > margin and name is not None:
            if key not in ("account_id", "account_name", "region", "role_arn"):
                raise ProfileError(f"line {n}: unknown field {key!r}")
            out[name][key] = value
        else:
            raise ProfileError(f"line {n}: wrong indentation")
    rows = []
    for name, x in out.items():
        if not _ACCOUNT.fullmatch(x.get("account_id", "")) or "account_name" not in x:
            raise ProfileError(f"profile {name!r} needs an account_id of 12 digits and an account_name")
        if "region" in x and not _REGION.fullmatch(x["region"]):
            raise ProfileError(f"profile {name!r} has no valid region")
        rows.append((name, x["account_id"], x["account_name"], x.get("region"), x.get("role_arn")))
    return rows


def parse_ini(text: str) -> list[tuple]:
    """[default] and [profile x] sections; an account comes from the profile or from those that it is based on."""
    ini = configparser.RawConfigParser(default_section="\0", strict=False, interpolation=None)
    ini.read_string(text)
    sections = {"default" if s == "default" else s.removeprefix("profile ").strip(): dict(ini[s]) for s in ini.sections() if s == "default" or s.startswith("profile ")}
    rows = []
    for name in sections:
        at, seen, account, region, role = name, [], None, None, None
        while at in sections and account is None:
            if at in seen or len(seen) > MAX_HOPS:
                raise ProfileError(f"the chain of profile {name!r} is too long")
            seen.append(at)
            x = sections[at]
            region = region or (x["region"] if _REGION.fullmatch(x.get("region", "")) else None)
            role = role or x.get("role_arn")
            m = _ROLE.match(x.get("role_arn", ""))
            account = x["sso_account_id"] if _ACCOUNT.fullmatch(x.get("sso_account_id", "")) else m[1] if m else None
            at = x.get("source_profile", "")
        if account:
            rows.append((name, account, name, region, role))
    return rows


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A profile map file (.yaml, .yml, or an INI file) as profile, account_id, account_name, region, role_arn."""
    text = _text(path)
    return spark.createDataFrame(parse_yaml(text) if path.endswith((".yaml", ".yml")) else parse_ini(text), SCHEMA)

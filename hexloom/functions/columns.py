"""The configuration language's scalar functions as Column expressions.

All of them are conf-independent: no reliance on ANSI mode, map-key policies, Base64 chunking or the session zone.
An argument that the language would reject gives null, where the evaluator keeps the call symbolic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# strings


def format_text(pattern: str, *args: ColumnOrName) -> Column:
    """%s and %v take anything, %d truncates numbers, %% is a percent sign; other verbs and missing arguments: null."""
    out, rest, left = [], pattern, list(args)
    while rest:
        head, sign, rest = rest.partition("%")
        if head:
            out.append(F.lit(head))
        if not sign:
            break
        verb, rest = rest[:1], rest[1:]
        if verb == "%":
            out.append(F.lit("%"))
        elif verb in ("s", "v", "d") and left:
            value = _c(left.pop(0))
            out.append((F.expr("try_cast(0 as bigint)") if value is None else value.cast("bigint") if verb == "d" else value).cast("string"))
        else:
            return F.lit(None).cast("string")
    return F.concat(F.lit(""), *out)


def lower(s: ColumnOrName) -> Column:
    return F.lower(_c(s))


def upper(s: ColumnOrName) -> Column:
    return F.upper(_c(s))


def trim(s: ColumnOrName, cutset: str) -> Column:
    return F.btrim(_c(s), F.lit(cutset))


def trim_space(s: ColumnOrName) -> Column:
    """Unicode white space off both ends; SQL's trim() only knows the blank."""
    space = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return F.regexp_replace(_c(s), f"^{space}|{space}$", "")


def replace_all(s: ColumnOrName, old: str, new: str) -> Column:
    """All literal occurrences; an empty `old` stands between all code points."""
    if old == "":
        return F.concat(F.lit(new), F.array_join(F.split(_c(s), ""), new), F.when(F.char_length(_c(s)) > 0, F.lit(new)).otherwise(F.lit("")))
    return F.replace(_c(s), F.lit(old), F.lit(new))


def str_contains(s: ColumnOrName, part: ColumnOrName) -> Column:
    return F.contains(_c(s), _c(part))


def text_length(s: ColumnOrName) -> Column:
    return F.char_length(_c(s)).cast("bigint")


# collections


def list_length(x: ColumnOrName) -> Column:
    return F.when(_c(x).isNotNull(), F.size(_c(x))).cast("bigint")


def keys(m: ColumnOrName) -> Column:
    return F.sort_array(F.map_keys(_c(m)))


def values(m: ColumnOrName) -> Column:
    """Values in the order of their keys."""
    return F.transform(keys(m), lambda k: F.element_at(_c(m), k))


def merge(first: ColumnOrName, *others: ColumnOrName) -> Column:
    """Later maps win; keys stay where they were first seen."""

    def two(a: Column, b: Column) -> Column:
        kept = F.transform_values(a, lambda k, v: F.when(F.map_contains_key(b, k), F.try_element_at(b, k)).otherwise(v))
        return F.map_concat(kept, F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)))

    out = _c(first)
    for m in others:
        out = two(out, _c(m))
    return out


def concat_lists(*lists: ColumnOrName) -> Column:
    return F.concat(*map(_c, lists))


def compact(x: ColumnOrName) -> Column:
    return F.filter(_c(x), lambda v: v.isNotNull() & (v != ""))


def lookup(m: ColumnOrName, key: ColumnOrName, default: ColumnOrName | None = None) -> Column:
    """A stored null is returned as it is; a missing key gives the default, or null."""
    missing = F.lit(None) if default is None else _c(default)
    return F.when(F.map_contains_key(_c(m), _c(key)), F.try_element_at(_c(m), _c(key))).otherwise(missing)


def contains(x: ColumnOrName, v: ColumnOrName) -> Column:
    return F.coalesce(F.array_contains(_c(x), _c(v)), F.lit(False))


def flatten(x: ColumnOrName, depth: int = 1) -> Column:
    """`depth` levels of nesting; a typed column has one depth, so all its levels are known."""
    out = _c(x)
    for _ in range(depth):
        out = F.flatten(out)
    return out


def to_set(x: ColumnOrName) -> Column:
    return F.array_distinct(_c(x))


# conversions


def to_number(s: ColumnOrName) -> Column:
    """A number's text as a double. Unlike a cast: no blanks, no suffixes."""
    return F.when(_c(s).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), _c(s).try_cast("double"))


def to_integer(s: ColumnOrName) -> Column:
    return F.when(_c(s).rlike(r"^[+-]?[0-9]+$"), _c(s).try_cast("bigint"))


def to_bool(s: ColumnOrName) -> Column:
    """Only true and false; a cast would also take yes, t and 1."""
    return F.when(_c(s) == "true", F.lit(True)).when(_c(s) == "false", F.lit(False))


def bool_text(b: ColumnOrName) -> Column:
    return F.when(_c(b).isNull(), "null").when(_c(b), "true").otherwise("false")


def list_text(x: ColumnOrName) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(_c(x), lambda v: F.coalesce(v.cast("string"), F.lit("null"))), ", "), F.lit("]"))


def json_encode(x: ColumnOrName) -> Column:
    return F.to_json(_c(x))


def json_field(s: ColumnOrName, path: str) -> Column:
    return F.get_json_object(_c(s), path)


def base64_encode(s: ColumnOrName) -> Column:
    return F.regexp_replace(F.base64(_c(s).cast("binary")), r"[\r\n]", "")


def base64_decode(s: ColumnOrName) -> Column:
    """Strict alphabet and padding; bytes that are no UTF-8 give null."""
    strict = _c(s).rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(strict, F.try_validate_utf8(F.try_to_binary(_c(s), F.lit("base64")).cast("string")))


def sha256(s: ColumnOrName) -> Column:
    return F.sha2(_c(s).cast("binary"), 256)


def sha512(s: ColumnOrName) -> Column:
    return F.sha2(_c(s).cast("binary"), 512)


#: The date tokens and their counterparts.
DATE_TOKENS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "hh": "HH", "mm": "mm", "ss": "ss"}


def format_date(spec: str, t: ColumnOrName) -> Column:
    """A timestamp (UTC) by tokens YYYY MM DD hh mm ss; all else verbatim."""
    out, i, plain = "", 0, ""
    while i < len(spec):
        token = next((k for k in DATE_TOKENS if spec.startswith(k, i)), None)
        if token is None:
            plain += spec[i].replace("'", "''")
            i += 1
            continue
        out += (f"'{plain}'" if plain else "") + DATE_TOKENS[token]
        plain, i = "", i + len(token)
    return F.date_format(_c(t), out + (f"'{plain}'" if plain else ""))


# operators


def add(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_add(_c(a), _c(b))


def subtract(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_subtract(_c(a), _c(b))


def multiply(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.try_multiply(_c(a), _c(b))


def divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Whole numbers truncate; by zero: null."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return F.when(b != 0, (a - F.try_mod(a, F.when(b != 0, b))) / F.when(b != 0, b)).cast("bigint")


def modulo(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Euclidean: never negative; by zero: null."""
    b = F.abs(_c(b))
    return F.when(b != 0, F.pmod(_c(a), F.when(b != 0, b)))


def negate(a: ColumnOrName) -> Column:
    return F.try_subtract(F.lit(0).cast("bigint"), _c(a))


def template(*parts: ColumnOrName) -> Column:
    """A string template: nulls are empty."""
    return F.concat(*(F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts))


# classifiers and addresses


def module_source_kind(s: ColumnOrName) -> Column:
    s = _c(s)
    return (
        F.when(s.startswith("./") | s.startswith("../"), "local")
        .when(s.startswith("git::") | s.startswith("git@") | s.contains(".git") | s.contains("github.com/"), "git")
        .when((F.length(s) - F.length(F.replace(s, F.lit("/"), F.lit(""))) >= 2) & ~s.startswith("/"), "registry")
        .otherwise("external")
    )


def file_kind(path: ColumnOrName) -> Column:
    name = F.element_at(F.split(_c(path), "/"), -1)
    ext = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))
    return F.when(name == "terragrunt.hcl", "terragrunt.hcl").when(ext.isin("tf", "tfvars", "hcl", "json"), ext)


def account_of_role(arn: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(_c(arn), r"^arn:aws:iam::([0-9]{12}):role/", 1), F.lit(""))


def valid_account(s: ColumnOrName) -> Column:
    return _c(s).rlike("^[0-9]{12}$")


def valid_region(s: ColumnOrName) -> Column:
    return _c(s).rlike("^[a-z0-9-]{1,32}$")


def valid_address(s: ColumnOrName) -> Column:
    """Charset, length, balanced brackets and even quotes."""
    s = _c(s)
    count = lambda ch: F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))
    return s.rlike(r'^[A-Za-z0-9_./\-\[\]"]+$') & (F.octet_length(s) <= 1024) & (count("[") == count("]")) & (F.pmod(count('"'), F.lit(2)) == 0)


def module_path(address: ColumnOrName) -> Column:
    """The names of the leading module.<name> pairs, joined by dots."""
    lead = F.regexp_extract(_c(address), r"^((?:module\.[^.]+\.)*)", 1)
    return F.array_join(F.regexp_extract_all(lead, F.lit(r"module\.([^.]+)\."), 1), ".")


def resource_part(address: ColumnOrName) -> Column:
    return F.regexp_replace(_c(address), r"^(?:module\.[^.]+\.)+", "")


def resource_head(ref: ColumnOrName) -> Column:
    """The address that a reference points at, or null: data.type.name, module.name or type.name."""
    s = _c(ref)
    found = F.regexp_extract(s, r"^(data\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\[[0-9]+\])?|module\.[A-Za-z0-9_-]+|[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\[[0-9]+\])?)", 1)
    return F.nullif(found, F.lit(""))


FUNCTIONS: Sequence[str] = [k for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")]

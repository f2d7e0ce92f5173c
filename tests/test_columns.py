import pytest
from pyspark.sql import functions as F

from hexloom.functions import columns as C


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: C.format_text("%s-%d%%", F.lit("a"), F.lit(2.9)), "a-2%"),
        (lambda: C.format_text("%x", F.lit(1)), None),
        (lambda: C.format_text("%s"), None),
        (lambda: C.trim_space(F.lit("  a b \n")), "a b"),
        (lambda: C.replace_all(F.lit("a.b"), ".", "-"), "a-b"),
        (lambda: C.to_bool(F.lit("yes")), None),
        (lambda: C.to_integer(F.lit(" 1")), None),
        (lambda: C.to_number(F.lit("1e3")), 1000.0),
        (lambda: C.divide(F.lit(-7), F.lit(2)), -3),
        (lambda: C.divide(F.lit(7), F.lit(0)), None),
        (lambda: C.modulo(F.lit(-7), F.lit(-3)), 2),
        (lambda: C.base64_encode(F.lit("x" * 90)), "eHh4" * 30),
        (lambda: C.base64_decode(F.lit("!!!!")), None),
        (lambda: C.lookup(F.create_map(F.lit("a"), F.lit("b")), F.lit("z")), None),
        (lambda: C.module_source_kind(F.lit("hashicorp/vpc/aws")), "registry"),
        (lambda: C.module_source_kind(F.lit("/abs/a/b")), "external"),
        (lambda: C.module_path(F.lit("module.a.module.b.t.n")), "a.b"),
        (lambda: C.resource_part(F.lit("module.a.module.b.t.n")), "t.n"),
        (lambda: C.resource_head(F.lit("data.t.n.id")), "data.t.n"),
        (lambda: C.valid_address(F.lit('t.n["a"]')), True),
        (lambda: C.valid_address(F.lit("t.n[0")), False),
        (lambda: C.account_of_role(F.lit("arn:aws:iam::123456789012:role/x")), "123456789012"),
        (lambda: C.file_kind(F.lit("a/b/terragrunt.hcl")), "terragrunt.hcl"),
        (lambda: C.file_kind(F.lit("a.b/c")), None),
    ],
)
def test_function(spark, column, expected):
    assert spark.range(1).select(column().alias("x")).first().x == expected


def test_arithmetic_overflow_is_null(spark):
    big = F.lit(2**63 - 1)
    assert spark.range(1).select(C.add(big, F.lit(1)).alias("x")).first().x is None

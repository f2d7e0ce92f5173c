import pytest

from hexloom.sources.profiles import ProfileError, parse_ini, parse_yaml, read_profiles

YAML = """
# accounts
profiles:
  prod:
    account_id: "123456789012"
    account_name: main
    region: eu-1
  dev:
    account_id: '210987654321'
    account_name: dev   # comment
"""


def test_yaml(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(YAML)
    rows = [tuple(r) for r in read_profiles(spark, str(tmp_path / "p.yaml")).collect()]
    assert rows == [("prod", "123456789012", "main", "eu-1", None), ("dev", "210987654321", "dev", None, None)]
    for bad in ("other: 1", "profiles:\n  a:\n    account_id: 1\n    account_name: x", YAML + "    color: red\n", "profiles:\n  a: 1"):
        with pytest.raises(ProfileError):
            parse_yaml(bad)


def test_ini():
    text = "[default]\nregion = us-1\nsso_account_id = 111111111111\n[profile a]\nsource_profile = b\nregion = eu-1\n[profile b]\nrole_arn = arn:aws:iam::222222222222:role/r\n[profile none]\nregion = x\n[other]\nx = 1\n"
    assert parse_ini(text) == [("default", "111111111111", "default", "us-1", None), ("a", "222222222222", "a", "eu-1", "arn:aws:iam::222222222222:role/r"), ("b", "222222222222", "b", None, "arn:aws:iam::222222222222:role/r")]
    with pytest.raises(ProfileError):
        parse_ini("[profile a]\nsource_profile = b\n[profile b]\nsource_profile = a\n")

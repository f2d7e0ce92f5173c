import json

import pytest

from hexloom import cli


def test_arguments(monkeypatch):
    a = cli.parser().parse_args(["parse", "x", "--var", "a=1", "--allow-env", "HOME", "--env-mode", "passthrough", "--zstd-level", "9"])
    assert (a.out, a.var, a.allow_env, a.env_mode, a.zstd_level, a.tables) == ("./hexloom-out", ["a=1"], ["HOME"], "passthrough", 9, "all")
    with pytest.raises(SystemExit) as e:
        cli.main(["parse", "x", "--profile-map", "a", "--aws-config", "b"])
    assert e.value.code == cli.EXIT_USAGE
    monkeypatch.setenv("SEEN", "1")
    assert cli.environment_of("strict", ["SEEN", "NOT_THERE"]) == {"SEEN": "1"}
    assert cli.environment_of("mock", ["SEEN"]) == {} and cli.environment_of("passthrough", [])["SEEN"] == "1"


def test_runs_and_their_codes(spark, tmp_path, capsys):
    tree, out = tmp_path / "tree", tmp_path / "out"
    (tree / "a").mkdir(parents=True)
    (tree / "a" / "main.tf").write_text('provider "aws" {\n  profile = "p"\n}\nvariable "v" {}\nresource "t_a" "x" {\n  v = var.v\n}\n')
    (tmp_path / "profiles.yaml").write_text('profiles:\n  other:\n    account_id: "111122223333"\n    account_name: n\n')
    parse = ["parse", str(tree), "-o", str(out), "--var", "v=seen", "--region", "eu-1", "--parsed-at", "2024-01-02T03:04:05Z"]
    assert cli.main(parse) == 0
    row = next(r for r in spark.read.parquet(f"{out}/resources.parquet").collect() if r.address == "t_a.x")
    assert row.region == "eu-1" and '"seen"' in row.attributes_json and row.parsed_at.isoformat().startswith("2024-01-0")
    assert cli.main(parse) == cli.EXIT_IO and cli.main([*parse, "--overwrite", "--tables", "resources"]) == 0
    assert [x["name"] for x in json.loads((out / "workspace.manifest.json").read_text())["files"]] == ["resources.parquet"]
    assert cli.main(["verify", str(out)]) == 0
    (out / "resources.parquet").write_bytes(b"other")
    assert cli.main(["verify", str(out)]) == cli.EXIT_EXPORT
    assert cli.main(["parse", str(tmp_path / "none")]) == cli.EXIT_IO
    assert cli.main([*parse, "--overwrite", "--profile-map", str(tmp_path / "profiles.yaml"), "--strict-providers"]) == cli.EXIT_PROVIDER
    assert cli.main(["parse", str(tree), "--var", "nothing"]) == cli.EXIT_USAGE

import pytest

from helpers import asset
from pricetide.__main__ import execute, parse


def test_stages_one_by_one(spark, tmp_path, land):
    land(tmp_path / "landing", "a", 1_704_067_200_000, [asset(), asset("b", "B", "2")])

    def do(stage, *options):
        return execute(spark, parse([stage, str(tmp_path), *options]))

    assert do("profile") == []
    assert do("bronze") == {"rows": 1, "quarantined": 0}
    assert do("silver", "--late", "admit")["rows_written"] == 2
    assert do("quality")["passed"]
    assert "volatility" in do("gold")
    written = do("gold-by-date")
    assert all(len(days) == 1 for days in written.values()) and len(written) == 4
    assert [r["row_count"] for r in do("profile")] == [1, 2, 2]
    assert {r["symbol"] for r in do("sample")} == {"A", "B"}
    assert do("export", "--out", str(tmp_path / "csv")) == {"exported": str(tmp_path / "csv")}
    # No JDBC driver answers to this address, so every table fails and is reported.
    with pytest.raises(RuntimeError, match="crypto_top_assets"):
        do("serve", "--url", "jdbc:none:", "--property", "user=u")


def test_bronze_by_folder(spark, tmp_path, land):
    land(tmp_path / "landing" / "arrived=2024-01-01", "a", 1_704_067_200_000, [asset()])
    args = parse(["bronze-by-folder", str(tmp_path)])
    assert [execute(spark, args)["rows"] for _ in range(2)] == [1, 0]

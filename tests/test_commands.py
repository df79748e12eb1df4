"""Commands over small tables."""

import pytest
from driftlake.__main__ import compare, main


def test_compare(spark, tmp_path):
    white, spot = b"\xff" * 4 * 400, bytearray(b"\xff" * 4 * 400)
    spot[:3] = b"\0\0\0"
    schema = "name string, width int, height int, one binary, two binary"
    for rows, worst in ([("same", 20, 20, white, white)], 0), ([("same", 20, 20, white, white), ("spot", 20, 20, white, bytes(spot))], 1):
        path = f"{tmp_path}/in{worst}"
        spark.createDataFrame(rows, schema).write.parquet(path)
        for method in ("pixels", "ssim", "gmsd"):
            out = f"{tmp_path}/{method}{worst}"
            code = main(["compare", path, out, "--method", method, "--key", "name"], spark)
            got = {r["name"]: r["differs"] for r in spark.read.parquet(out).collect()}
            assert got["same"] is False and code == max(got.values()) and (method == "ssim" or code == worst)
    assert {r["name"]: r["diff_count"] for r in compare(spark.read.parquet(f"{tmp_path}/in1"), key="name", threshold=1.0).collect()} == {"same": 0, "spot": 0}
    with pytest.raises(ValueError, match="method is one of"):
        compare(spark.read.parquet(f"{tmp_path}/in1"), "psnr")


def test_queries(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "discover" in capsys.readouterr().out.split()
    assert main(["run", "route_dedupe", "/root/testdata/sf0.001", f"{tmp_path}/out"], spark) == 0 and spark.read.parquet(f"{tmp_path}/out").count() > 0
    with pytest.raises(SystemExit):
        main(["run", "nothing", "x", "y"], spark)

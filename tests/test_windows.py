"""Windows with a halo: files that are opened, rows that fall in, columns with gaps."""

import os

import pytest

from fluvia.sources import windows as W


@pytest.fixture(scope="module")
def tiles(spark, tmp_path_factory):
    """A folder of 16 files, one for each square of 100 by 100."""
    folder = str(tmp_path_factory.mktemp("tiles") / "t")
    rows = [(k, float(k % 40 * 10), float(k // 40 * 10), float(k) if k % 40 < 10 or k % 7 else None) for k in range(1600)]
    df = spark.createDataFrame(rows, "id long, x double, y double, drainage double")
    for c in range(4):
        for r in range(4):
            df.where(f"floor(x / 100) = {c} and floor(y / 100) = {r}").coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def boxes(spark, *rows):
    return spark.createDataFrame(list(rows), "window string, x0 double, y0 double, x1 double, y1 double")


def test_only_files_that_meet_a_window_are_opened(spark, tiles):
    folder, rows = tiles
    bounds = W.file_bounds(spark, folder).cache()
    assert bounds.count() == 16 and bounds.agg({"n": "sum"}).first()[0] == 1600
    wanted = boxes(spark, ("a", 10.0, 10.0, 50.0, 50.0), ("b", 210.0, 310.0, 290.0, 380.0))
    for halo in (5.0, 25.0, 60.0, 1e4):
        met = lambda c, r: any(100 * c <= x1 + halo and 100 * c + 90 >= x0 - halo and 100 * r <= y1 + halo and 100 * r + 90 >= y0 - halo for _, x0, y0, x1, y1 in wanted.collect())
        files = sum(met(c, r) for c in range(4) for r in range(4))
        out = W.read_windows(spark, folder, bounds, wanted, "window", halo)
        assert len(out.inputFiles()) == files == len(W.files_met(bounds, wanted, halo))
        want = {(w, k, not (x0 <= x <= x1 and y0 <= y <= y1)) for w, x0, y0, x1, y1 in wanted.collect() for k, x, y, _ in rows if x0 - halo <= x <= x1 + halo and y0 - halo <= y <= y1 + halo}
        assert {(r.window, r.id, r.in_halo) for r in out.collect()} == want
    assert W.files_met(bounds, boxes(spark, ("c", 900.0, 900.0, 910.0, 910.0)), 5.0) == []
    assert W.read_windows(spark, folder, bounds, boxes(spark, ("c", 900.0, 900.0, 910.0, 910.0)), "window", 5.0).count() == 0
    assert W.files_met(bounds, wanted.limit(0), 5.0) == []
    # files that no window meets need not even be readable
    seen = {f.rpartition("/")[2] for f in W.files_met(bounds, wanted, 5.0)}
    for name in os.listdir(folder):
        if name.endswith(".parquet") and name not in seen:
            os.remove(os.path.join(folder, f".{name}.crc"))
            with open(os.path.join(folder, name), "wb") as file:
                file.write(b"broken")
    assert W.read_windows(spark, folder, bounds, wanted, "window", 5.0).count() == 97


def test_columns_count_only_where_complete(spark, tiles):
    _, rows = tiles
    df = spark.createDataFrame(rows, "id long, x double, y double, drainage double")
    out = W.rows_in(df, boxes(spark, ("full", 0.0, 0.0, 60.0, 60.0), ("gaps", 150.0, 150.0, 200.0, 200.0)), "window", 20.0)
    got = W.if_complete(out, "window", "drainage").groupBy("window").agg({"*": "count", "drainage": "count"}).collect()
    assert {r[0]: (r["count(1)"], r["count(drainage)"]) for r in got} == {"full": (81, 81), "gaps": (100, 0)}

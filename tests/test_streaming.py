from pyspark.sql import functions as F

from fluvia.sources.tables import view
from fluvia.streaming.station_days import station_days, write_days


def test_stream_equals_batch_for_closed_days(spark, tmp_path):
    rows = view(spark, "/root/testdata/sf0.001", "fx_stations").select("station", "ts", "dtw").orderBy("ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    write_days(station_days(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.station, r.day): (r.n, round(r.total, 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.station, r.day): (r.n, round(r.t, 6)) for r in rows.groupBy("station", F.to_date("ts").alias("day")).agg(F.count("dtw").alias("n"), F.sum("dtw").alias("t")).collect()}
    assert got and got.items() <= want.items()
    newest = max(day for _, day in want)
    assert all((newest - day).days <= 3 for _, day in set(want) - set(got))

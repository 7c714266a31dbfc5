"""A point cloud file gives back the times that were written, equal ones too."""

from __future__ import annotations

import duckdb

from beamgrid import registry


def test_points_ply_keeps_equal_times(spark, tmp_path):
    src, to = "/root/testdata/sf0.001/events.parquet", str(tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    c.execute(f"copy (select * replace (event_id * 3 + i as event_id) from '{src}', range(3) r(i) order by event_id limit 300) to '{to}' (format parquet)")
    c.execute(f"create view events as select * from '{to}'")
    df = registry.queries()["snk03_points_ply"](spark, str(tmp_path))
    want = c.execute(f"select ray_id, micros, alpha from ({registry.oracle_sql()['snk03_points_ply']}) order by ray_id").fetchall()
    assert [tuple(r) for r in df.select("ray_id", "micros", "alpha").orderBy("ray_id").collect()] == want

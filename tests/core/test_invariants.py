"""Algebraic properties, file round trips, and operators that SQL can't express."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from beamgrid import adapter, registry
from beamgrid.functions import geometry as g
from beamgrid.operators import clip, decimate, generate, graph, joins, merge, neighbours, order, project, voxel
from beamgrid.sources import las, ply, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rays(spark):
    return adapter.rays(spark, SF).cache()


def _sum(df):
    return df.agg(F.sum(g.ray_length())).first()[0]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("op", [lambda r: clip.split_plane(r, (3.0, 6.0, 1.5)), lambda r: clip.split_box(r, (8.0, 10.0, 2.0), (3.0, 4.0, 0.0)), lambda r: clip.split_capsule(r, (6.0, 6.0, 1.0), (12.0, 12.0, 5.0), 1.5)])
def test_splits_keep_every_metre(rays, op):
    parts = op(rays)
    assert _sum(parts) == pytest.approx(_sum(rays), rel=1e-9)
    assert parts.where("alpha > 0").count() == rays.where("alpha > 0").count()


def test_walk_keeps_every_metre(rays):
    assert voxel.walk(rays, 0.7).agg(F.sum("length")).first()[0] == pytest.approx(_sum(rays), rel=1e-9)


def test_motion_and_back(rays):
    m = g.rotation((10.0, 20.0, 30.0))
    back = project.transform(project.transform(rays, m), [list(c) for c in zip(*m, strict=True)])
    d = back.alias("a").join(rays.alias("b"), "ray_id").agg(F.max(F.abs(F.col("a.ex") - F.col("b.ex"))), F.max(F.abs(F.col("a.sz") - F.col("b.sz")))).first()
    assert max(d) < 1e-9
    assert project.rotate(rays, (0.0, 0.0, 0.0)).exceptAll(rays).count() == 0


def test_decimation_is_idempotent(rays):
    one = decimate.voxels(rays, 1.0)
    assert decimate.voxels(one, 1.0).exceptAll(one).count() == 0 and 0 < one.count() < rays.count()
    greedy = decimate.ray_space(rays, 1.0)
    assert 0 < greedy.count() <= rays.count()


def test_order_across_blocks(rays):
    x = order.numbered(rays, block=37).orderBy("ray_id").select("index").collect()
    assert [r[0] for r in x] == list(range(len(x)))
    y = order.with_previous(rays, ["time"], block=37).orderBy("ray_id").select("time", "last_time").collect()
    assert y[0].last_time is None and all(b.last_time == a.time for a, b in zip(y, y[1:]))


def test_similarity_with_itself(rays):
    d = neighbours.cloud_distances(rays, rays, 0.5)
    assert neighbours.similarity(d, 1e-9).first()[0] == 100.0


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)], "a long, b long")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_normals_are_of_length_one_and_face_the_sensor(rays):
    s = neighbours.surfels(rays, 8, 2.0).join(rays.select("ray_id", *[(F.col(f"s{a}") - F.col(f"e{a}")).alias(f"t{a}") for a in "xyz"]), "ray_id")
    bad = s.where((F.abs(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2 - 1) > 1e-9) | (F.col("nx") * F.col("tx") + F.col("ny") * F.col("ty") + F.col("nz") * F.col("tz") < -1e-9))
    assert s.count() > 0 and bad.count() == 0


def test_eigenvalues_agree_with_numpy(rays):
    own = rays.where("alpha > 0")
    x = neighbours.eigenvalues(neighbours.covariance(own, neighbours.nearest(own, own, 8, 2.0))).collect()
    for r in x[:200]:
        m = np.array([[r.cov_xx, r.cov_xy, r.cov_xz], [r.cov_xy, r.cov_yy, r.cov_yz], [r.cov_xz, r.cov_yz, r.cov_zz]])
        assert np.allclose(np.linalg.eigvalsh(m), [r.l0, r.l1, r.l2], atol=1e-6)


def test_merge_keeps_all_rays(rays):
    a, b = rays.where("ray_id % 2 = 0"), rays.where("ray_id % 2 = 1")
    out = merge.merge(a, b, "min", 1.0, 8, 2.0, 1.0)
    assert out.count() == rays.count() and {r[0] for r in out.select("part").distinct().collect()} <= {"fixed", "transient"}
    with pytest.raises(ValueError):
        merge.verdicts(out, "median", 1.0)


def test_trajectory_clamps_or_goes_on(spark, rays):
    t = adapter.trajectory(spark, SF)
    free, held = (joins.starts_from_trajectory(rays, t, e) for e in (True, False))
    assert free.count() == held.count() == rays.count()
    last = t.agg(F.max("time")).first()[0]
    assert free.where(F.col("time") > last).select("sz").distinct().count() > held.where(F.col("time") > last).select("sz").distinct().count()


def test_ply_round_trip(spark, rays, tmp_path):
    p = str(tmp_path / "a.ply")
    assert ply.write_rays(rays, p) == rays.count()
    back = ply.read_rays(spark, p, rows_per_partition=300)
    assert back.rdd.getNumPartitions() == -(-rays.count() // 300)
    a, b = (x.orderBy("time").select("sx", "sy", "sz", "ex", "ey", "ez", "time", "alpha").toPandas() for x in (rays, back))
    assert np.allclose(a, b, atol=1e-5, rtol=1e-12)
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nend_header\n")
    with pytest.raises(ValueError):
        ply.header(str(tmp_path / "b.ply"))


def test_mesh_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(5, 0.0, 0.0, 0.0), (7, 1.0, 0.0, 0.0), (9, 0.0, 1.0, 0.5)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 5, 7, 9)], "fid long, v0 long, v1 long, v2 long")
    ply.write_mesh(v, f, str(tmp_path / "m.ply"), flip=True)
    v2, f2 = ply.read_mesh(spark, str(tmp_path / "m.ply"))
    assert [tuple(r) for r in f2.collect()] == [(0, 0, 2, 1)] and v2.count() == 3


def test_las_round_trip(spark, rays, tmp_path):
    p = str(tmp_path / "a.las")
    las.write(rays, p)
    back = las.read(spark, p, max_intensity=255.0, rows_per_partition=400)
    a, b = (x.orderBy("time").select("ex", "ey", "ez", "time", "red", "green", "blue", "alpha").toPandas() for x in (rays, back))
    assert np.allclose(a, b, atol=1e-4, rtol=1e-12)


def test_tree_text(spark):
    lines = spark.createDataFrame([(0, "7,0,0,0,1,-1, 1,1,1,1,0"), (1, "8,0,0,0,2,-1")], "tree_id long, value string")
    got = text.parse_trees(lines, "height, x,y,z,radius,parent_id").orderBy("tree_id", "seg_id").collect()
    assert [(r.tree_id, r.seg_id, r.radius, r.parent_id, r.tree_attrs["height"]) for r in got] == [(0, 0, 1.0, -1, 7.0), (0, 1, 1.0, 0, 7.0), (1, 0, 2.0, -1, 8.0)]
    with pytest.raises(Exception, match="number of fields"):
        text.parse_trees(spark.createDataFrame([(0, "1,2,3")], "tree_id long, value string"), "x,y,z,radius").collect()


def test_generators_do_not_depend_on_partitions(spark):
    a, b = generate.room(spark, 3, 500), generate.room(spark, 3, 500).repartition(3)
    assert a.exceptAll(b).count() == 0 and a.exceptAll(generate.room(spark, 4, 500)).count() > 0
    assert generate.room(spark, 3, 500).where("alpha = 0").count() < 200


def test_load_and_row_map_check_what_they_get(rays):
    from pyspark.sql import functions as F

    from beamgrid import schema

    assert schema.loaded(rays).count() == rays.count()
    with pytest.raises(ValueError):
        schema.loaded(rays.limit(3))
    with pytest.raises(ValueError):
        schema.mapped(rays, {"ray_id": F.lit(1)})
    with pytest.raises(ValueError):
        schema.mapped(rays, {"intensity": F.lit(1)})
    assert schema.mapped(rays, {"red": F.lit(7)}).schema["red"].dataType.typeName() == "short"

"""TRK01, JON12, TRE01, REG02, GEN03: fits, paths and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from beamgrid import adapter
from beamgrid.adapter import duck
from beamgrid.operators import extract as ex
from beamgrid.operators import project
from beamgrid.registry import register

from .common import on_rays
from .trees import _TRUNKS, _trunks


def _forest(s, trees):
    return ex.scan_trees(ex.tree_segments(s, 1, trees), 60.0)


register("gen03_forest", lambda s, d: _forest(s, 6))
register("trk01_trunks", lambda s, d: ex.trunks(_forest(s, 1), 0.4, rounds=3, score=1.0))
register("jon12_trunks_without_overlaps", lambda s, d: ex.without_overlaps(_trunks(s, d)).select("trunk_id"), duck(f"{_TRUNKS} select trunk_id from tk a where not exists (select 1 from tk b where b.trunk_id <> a.trunk_id and (b.radius > a.radius or (b.radius = a.radius and b.trunk_id < a.trunk_id)) and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < b.radius * b.radius)", "rays", "segments"))
on_rays("tre01_paths_to_ground", lambda r: ex.paths_to_ground(r, 1.5, 0.5), None, "rays")


def _fine(s, d):
    r = adapter.rays(s, d).withColumn("ez", F.sin("ex") + F.cos(F.col("ey") / 2))
    moved = project.translate(r, (0.02, -0.03, 0.05))
    _, shift = ex.fine_align(r, moved, 8, 1.5, 4)
    return s.createDataFrame([(c, round(float(v), 2) + 0.0) for c, v in zip("xyz", shift)], "axis string, shift double")


register("reg02_fine_align", _fine)

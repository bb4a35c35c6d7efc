"""Queries against DuckDB on the smallest tables, and the plan gate."""

import math
import os
import re

import pytest

from maskframe.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
#: One or two of each family; the driver compares all of them.
NAMES = ["collate_padded", "unpad_roundtrip", "sample_violations", "crop_plan", "sanitize_by_area", "translate_draw", "k_cap", "warp_mask_nearest", "warp_rows_bilinear", "survivor_area", "merge_slots", "composite_depth_valid", "stuff_collapse", "reinhard_stats", "bank_draws", "predicate_walk", "check_overlap", "check_fresh", "paste_stats", "bench_quartiles", "coco_panoptic_segments", "rle_decode", "rle_decode_wide", "rle_compressed_wide", "polygon_area_wide", "warp_wide", "survivor_wide", "e2e_wide_masks", "e2e_wide_layers", "layer_image", "layer_panoptic", "layer_depth", "layer_normals", "bank_paste", "ks_distance", "invariant_summary", "hf_last_wins", "record_pack_unpack", "image_scan", "panoptic_scan", "bank_crops_cut", "bank_tar_shards", "bank_record_draws", "segmentation_files", "tiles_512", "tiles_layers", "audit_records", "preset_instance_512", "preset_panoptic", "source_mixture", "dense_composite", "jitter_layers", "jitter_instances", "model_format", "gallery", "bank_built", "sweep_grid", "synthetic_squares"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return str(v) if isinstance(v, (bool, str)) else round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_duckdb(spark, duck, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = lambda df: sorted([tuple(map(plain, r)) for r in df[cols].itertuples(index=False)], key=repr)
    assert rows(a) == rows(b)


#: Whole images are blended, pasted, encoded and decoded in numpy, as are polygons, counts and records; the draws' bounds and a range's ends are one row that every task gets.
PYTHON = {"multiband", "poisson", "polygon_area", "polygon_area_wide", "e2e_wide_layers", "residual_wide", "bank_paste", "rle_decode", "rle_decode_wide", "rle_compressed_wide", "segmentation_files", "image_scan", "panoptic_scan", "bank_crops_cut", "bank_tar_shards", "bank_record_draws", "tiles_512", "tiles_layers", "audit_records", "fault_injection", "source_mixture", "dense_composite", "jitter_layers", "jitter_instances", "model_format", "gallery", "bank_built", *(n for n in QUERIES if n.startswith(("layer_", "preset_")))}
ONE_ROW = {"bank_draws", "bank_draw_histogram", "stage_bank_batches", "ks_distance"}
#: Ranks of a report and weights of classes: one row a class or implementation.
FEW_ROWS = {"repeat_factor_weights", "bank_draws", "bank_draw_histogram", "stage_bank_batches", "throughput_rank"}


def partitioned(window: str) -> bool:
    """Whether a window of a plan has keys: its expressions are followed by them, and then by its order."""
    groups, depth, start = [], 0, 0
    for i, c in enumerate(window):
        if c == "[":
            start, depth = (i if not depth else start), depth + 1
        elif c == "]":
            depth -= 1
            if not depth:
                groups.append(window[start : i + 1])
    return len(groups) > 1 and not re.search(r" (ASC|DESC) NULLS", groups[1])


def test_windows_without_keys_are_told():
    assert partitioned("[row_number() windowspecdefinition(a#1, b#2 ASC NULLS FIRST) AS n#3], [a#1], [b#2 ASC NULLS FIRST]")
    assert not partitioned("[sum(x#1) windowspecdefinition(b#2 ASC NULLS FIRST) AS n#3], [b#2 ASC NULLS FIRST]") and not partitioned("[sum(x#1) AS n#3]")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"invariant_summary"}))
def test_plans_have_no_nested_loops_and_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    if name not in ONE_ROW:
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    if name not in FEW_ROWS:
        assert all(map(partitioned, re.findall(r"\bWindow (\[.*)", plan)))
    if name not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [1, 13])
def test_partitioning_changes_nothing(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    key = lambda: sorted(map(tuple, QUERIES["merge_slots"](spark, DATA).collect()))
    want = key()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        assert key() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["sample_id", "slot", "label", "before", "after"]

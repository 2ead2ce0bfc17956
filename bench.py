"""Headline timings. Prints one JSON line; reads BENCH_SF_DIR and BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a01_class_counts", "a02_color_counts", "a04_voxel_downsample", "a16_class_inlier_ratio", "a18_error_statistics", "a20_score_summary", "a23_psnr",
    "a27_scene_bound", "a28_voxel_fusion", "c05_mesh_culling", "c07_trajectory_evaluation", "c11_zero_crossings", "f04_median_error_mask",
    "j01_frame_association", "j03_same_class_nearest", "j07_mesh_gather", "p18_back_projection", "w03_compositing", "w04_inverse_cdf_sampling", "w05_gap_segments",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from posegrid.catalog import load
    from posegrid.session import local_session

    spark = local_session("posegrid-bench", cpus)
    queries = load()[0]
    names = [n for n in HEADLINE if n in queries]
    queries["a01_class_counts"](spark, sf_dir).count()  # JVM and file-system warm-up
    times = {}
    for n in names:
        t = time.time()
        queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
        print(n, times[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

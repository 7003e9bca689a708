"""Every query with a SQL twin gives the twin's rows at the smallest scale."""

import glob
import os

import pytest

import __spark_entry__ as entry
from scripts.check_queries import canon

FOLDER = "/root/testdata/sf0.001"
# One or two queries per area; all of them with ALL_QUERIES=1 (scripts/check_queries.py runs them too).
CORE = {
    "series_from_long", "encode_labels", "scale_global", "scale_minmax", "series_limits", "stratified_split", "split_by_index",
    "subseries", "paa", "sax_words_of_windows", "random_mask", "sax_bitmap", "prefix_stats", "window_correlation", "barycenter",
    "min_distance", "min_distance_ragged", "min_distance_block", "znorm_min_distance_pos", "corr_min_distance",
    "min_distance_segments", "distance_matrix", "ig_score", "ig_score_bucketed", "kruskal_score", "mood_median", "bhattacharyya",
    "distinguishing_power", "discover_sax", "wilcoxon", "compare_table", "mann_whitney", "read_predictions", "transform",
    "knn_join", "knn_join_ties", "knn_join_offset", "window_correlation_small", "min_distance_location_mixed", "sample_series", "init_random",
    "mutate_noise", "mutate_add", "mutate_remove", "mutate_mask", "cross_merge", "cross_random_merge", "cross_points", "cross_shapelet_points",
    "naive_bayes", "voting_soft", "voting_hard", "tournament", "accuracy", "generation_stats",
}
ORACLES = sorted(set(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else CORE)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["shapelet_id", "gain", "gap"] and df.count() > 0

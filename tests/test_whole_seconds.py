"""Times at a whole second: their text has no fraction."""

from datetime import datetime

from clientele.plans.registry import all_queries


def test_parse_ts_reads_a_time_without_fraction(spark, tmp_path):
    times = [datetime(2024, 1, 1, 0, 0, 54), datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1, 500000), None]
    spark.createDataFrame([(i, t, "view") for i, t in enumerate(times)], "event_id long, ts timestamp_ntz, event_type string"
                          ).write.parquet(f"{tmp_path}/events.parquet")
    rows = sorted(all_queries()["parse_ts"].run(spark, str(tmp_path)).collect())
    assert [r["parsed"] for r in rows] == times and [r["parsed_iso"] for r in rows] == times

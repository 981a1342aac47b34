from lumenfold.operators import metrics

COLUMNS = "clip_id string, platform string, captured_at timestamp_ntz, seq long, impressions long, views long, likes long"


def test_latest_per_platform_and_totals(spark):
    from datetime import datetime as d

    rows = [
        ("c", "youtube", d(2024, 1, 1), 1, 100, 50, 8),
        ("c", "youtube", d(2024, 1, 2), 2, 150, 80, 12),
        ("c", "tiktok", d(2024, 1, 1), 3, 200, 150, 20),
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    counters = ["impressions", "views", "likes"]
    latest = {r.platform: r.views for r in metrics.latest_per_platform(frame, counters).collect()}
    assert latest == {"youtube": 80, "tiktok": 150}
    total = metrics.totals_per_clip(frame, counters).first()
    assert (total.impressions, total.views, total.likes) == (350, 230, 32)


def test_clips_without_snapshots_get_zeros(spark):
    clips = spark.createDataFrame([("c",)], "clip_id string")
    row = metrics.totals_for_clips(clips, spark.createDataFrame([], COLUMNS), ["views"]).first()
    assert (row.platforms, row.views) == (0, 0)

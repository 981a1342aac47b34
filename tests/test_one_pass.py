"""Steps that large tables pass once, in parts that stay small."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

import __spark_entry__
from lumenfold.functions import text as T
from lumenfold.operators import catalog, timeline
from lumenfold.plans import views as V
from lumenfold.storage import VersionedTable
from lumenfold.streaming import delivery


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filled_kinds_parse_timelines_once(spark):
    texts = [(1, '{"tracks": [{"kind": "video", "items": [{"start": 0}, {"start": 1}]}, {"kind": "video", "items": [{}]}]}'), (2, '{"tracks": [{"kind": "sticker", "items": [{}]}]}'), (3, "{}")]
    made = timeline.fill_kinds(timeline.items(spark.createDataFrame(texts, "clip_id long, timeline string").withColumn("base_path", F.lit("b"))))
    before = plan(made)
    assert "Join" not in before and before.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, made.collect())) == [(1, "caption", 0), (1, "text-overlay", 0), (1, "video", 3), (2, "caption", 0), (2, "text-overlay", 0), (2, "video", 0)]


def test_clips_and_upserts_are_dealt_out_before_they_are_sorted(spark):
    """Nothing is sorted before a shuffle, whatever a file holds, and small parts aren't merged."""
    changes = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "a", 1)], "k long, t string, at long")
    for made in (V.lines(spark, SF_SMALL), catalog.upsert(spark.createDataFrame([(1, "a"), (3, "d")], "k long, t string"), changes, ["k"], "at")):
        text = plan(made)
        assert "REPARTITION_BY_NUM" in text and text.count("Exchange") == 1
        assert "Sort" not in text[text.index("Exchange") :]
    assert sorted(map(tuple, made.collect())) == [(1, "c"), (2, "a"), (3, "d")]


def test_requests_are_made_once(spark, tmp_path):
    """Also where a request has no text of its own, and where there is none at all."""
    made = spark.sparkContext.accumulator(0)

    def count(seq):
        made.add(1)
        return None if seq % 2 else seq

    rows = spark.range(40).selectExpr("id AS clip_id", "id AS version", "'old' AS timeline")
    edits = VersionedTable.create(spark, f"file://{tmp_path}/edits", rows, ["clip_id"], buckets=4)
    asked = spark.range(50).selectExpr("id AS clip_id", "id + 100 AS seq").withColumn("version", F.udf(count, "long")("seq")).withColumn("timeline", F.lit(None))
    found = delivery.save_edits(edits, asked)
    wanted = [(i, i + 100, *(("accepted", 1) if i >= 40 else ("conflict", i) if i % 2 == 0 else ("accepted", i + 1))) for i in range(50)]
    assert sorted(map(tuple, found.collect())) == wanted and made.value == 50
    assert sorted((r.clip_id, r.version) for r in edits.read().collect()) == [(w[0], w[3]) for w in wanted]
    assert delivery.save_edits(edits, asked.limit(0)).collect() == [] and edits.read().count() == 50
    assert not edits.files.names("requests")


@pytest.mark.parametrize("name, exchanges", [("l4_ranked_segments", 2), ("a4_segment_score", 1)])
def test_windows_are_cut_once_and_scored_where_they_lie(spark, name, exchanges):
    """Texts are dealt out once, and neither windows nor their words meet anything by a join; ranks need the scores by video."""
    text = plan(__spark_entry__.queries()[name](spark, SF_SMALL))
    assert text.count("MapInArrow") == 2 and "Join" not in text
    assert text.count("REPARTITION") == 1 and text.count("Exchange") == exchanges


def test_trends_are_found_in_any_case(spark):
    texts = spark.createDataFrame([(1, "How to win: TIPS and tips"), (2, ""), (3, None)], "id int, text string")
    assert [r.n for r in texts.select(T.trend_hits("text", ["how to", "tip", "win:", "lose"]).alias("n")).collect()] == [3, 0, 0]

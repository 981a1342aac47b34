"""Progress, log lines, reprompts, presets, project XML and caption layout on rows of their own."""

from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.operators import catalog, events, exports, layout


def test_progress_divides_by_the_jobs_chapters(spark):
    rows = [
        (1, 1, "ChaptersDetected", None), (1, 2, "ClipRendered", 0), (1, 3, "ChapterTranscribed", 1), (2, 4, "VideoDownloaded", None), (3, 5, "ClipRendered", 0), (3, 6, "JobCompleted", None),
        (4, 7, "ClipRendered", 0), (4, 8, "JobFailed", None), (5, 9, "ClipRendered", 0), (5, 10, "ClipRendered", 1), (1, 11, "ChapterClipExtracted", 1), (6, 12, "Odd", 3), (8, 13, "ClipRendered", 0),
    ]
    jobs = spark.createDataFrame([(1, 4), (2, 0), (3, 2), (4, 2), (5, 2), (6, None), (7, 3)], "job_id long, n_chapters int")
    found = {r.job_id: round(r.progress, 6) for r in events.progress(jobs, spark.createDataFrame(rows, "job_id long, seq long, type string, chapter_index int")).collect()}
    assert found == {1: round(0.25 + 0.7 * (1.0 + 0.2) / 4, 6), 2: 0.2, 3: 1.0, 4: 0.02, 5: 0.95, 6: 0.02, 7: 0.25}


def test_unknown_events_as_compact_json(spark):
    payload = '{ "b" : "x \\" : y ,  z",\n "a": [1, 2.50 ,true], "ü": {} }'
    frame = spark.createDataFrame([("New", payload, "10:00:00"), ("New", None, "10:00:01"), (None, "{}", "10:00:02")], "type string, payload string, stamp string")
    found = [r.line for r in frame.select(events.log_line("type", "payload", "stamp").alias("line")).collect()]
    assert found == ['[10:00:00] New — {"b":"x \\" : y ,  z","a":[1,2.50,true],"ü":{}}', "[10:00:01] New — {}", "[10:00:02] Unknown — {}"]


def test_reprompt(spark):
    jobs = spark.createDataFrame([(1, "completed", "p", {"render": "true", "theme": "dark", "target_length_min_seconds": "7"}), (2, "failed", None, None)], "job_id long, status string, prompt string, options map<string, string>")
    asked = [
        (1, "1-3m", 5, 6, "new"), (1, None, None, None, None), (1, None, None, 80, "x" * 2000), (1, "2m", None, None, None), (1, None, 90, 80, None), (1, None, -1, None, None), (1, None, 1, 3601, None),
        (1, None, None, None, "x" * 2001), (2, "", 0, 0, None), (9, "0-1m", None, None, None),
    ]
    found = catalog.reprompt(jobs, spark.createDataFrame(asked, "job_id long, length_range string, low int, high int, prompt string").coalesce(1)).collect()
    off = {k: "false" for k in ("transcription", "captions", "render", "reframe", "broll", "thumbnail")} | {"segment_proposer": "true"}
    by = {}
    for r in found:
        by.setdefault((r.job_id, r.error), []).append(r)
    good = sorted(by[1, None], key=lambda r: len(r.prompt))
    assert [r.prompt[:3] for r in good] == ["p", "new", "xxx"] and {r.status for r in good} == {"pending"}
    assert good[1].options == {"theme": "dark", "target_length_min_seconds": "60", "target_length_max_seconds": "180", **off}
    assert good[0].options == {"theme": "dark", "target_length_min_seconds": "7", **off} and good[2].options["target_length_max_seconds"] == "80"
    bad = {e for (_, e) in by if e}
    assert bad == {
        "unknown length range: 2m", "length_min_seconds must be <= length_max_seconds", "length_min_seconds must be between 0 and 3600", "length_max_seconds must be between 0 and 3600",
        "prompt must have at most 2000 characters", "job not found",
    }
    assert all(r.options["render"] == "true" and r.status == "completed" for (j, e), rows in by.items() if e and j == 1 for r in rows)
    assert by[2, None][0].options == {"target_length_min_seconds": "0", "target_length_max_seconds": "0", **off}


def test_presets_and_xml(spark):
    styles = spark.createDataFrame([("karaoke",), ("nope",), (None,)], "style string").select("style", F.inline(F.array(T.preset("style")))).collect()
    assert (styles[0].font_size, styles[0].highlight, styles[0].error) == (48, "#22d3ee", None) and styles[1].color is None and styles[1].error.startswith("unknown caption style: nope; must be one of boldpop, ") and "null" in styles[2].error
    clips = spark.createDataFrame([(1, 'A "b" & c', 1.0, 3.5, "/o/a&b.mp4"), (2, "", 5.0, 4.0, "/x.mp4"), (3, "t", 0.0, 1.0, None), (4, "t", 0.0, 1.0, "")], "clip_id long, title string, start double, end double, output_path string")
    for made in (exports.timeline_xml(clips).collect(), exports.sequence_xml(clips).collect()):
        assert [r.error for r in made] == [None, None, "clip 3 has no output_path; render first", "clip 4 has no output_path; render first"] and made[2].xml is None
        from xml.etree import ElementTree

        roots = [ElementTree.fromstring(r.xml) for r in made[:2]]
        assert 'A "b" & c' in {e.get("name") for e in roots[0].iter()} | {e.text for e in roots[0].iter("name")}
    times = [e.get("duration") for e in ElementTree.fromstring(exports.timeline_xml(clips).first().xml).iter() if e.get("duration")]
    assert times == ["2.5s"] * 3


def test_caption_layout(spark):
    glyphs = {"a": 10.0, "b": 4.0, " ": 3.0}
    rows = [(1, 1, "ab  b\n a?", 1, None), (1, 2, "  ", 0, None), (1, 3, "b", None, 301), (2, 1, None, 0, 5)]
    captions = spark.createDataFrame(rows, "vid long, index long, text string, active int, anchor int")
    found = {(r.vid, r["index"], r["at"]): (r.word, r.x, r.y, r.width, r.active) for r in layout.caption_layout(captions, glyphs, (100, 200), 21.0, missing=2.0).collect()}
    x = (100 - (14 + 4 + 12 + 6)) / 2
    assert found == {
        (1, 1, 0): ("ab", x, 139.0, 14.0, False), (1, 1, 1): ("b", x + 17, 139.0, 4.0, True), (1, 1, 2): ("a?", x + 24, 139.0, 12.0, False), (1, 3, 0): ("b", 48.0, 290.0, 4.0, False),
    }
    glyph_rows = spark.createDataFrame(list(glyphs.items()), "sign string, width double")
    assert layout.glyph_widths(glyph_rows) == glyphs

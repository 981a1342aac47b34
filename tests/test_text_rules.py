"""Rules on text, files and settings, case by case."""

import hashlib
import hmac
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenfold import sources
from lumenfold.functions import security, transitions
from lumenfold.functions import text as T
from lumenfold.operators import captions, exports, library


def one(spark, column, **values):
    frame = spark.range(1)
    for k, v in values.items():
        frame = frame.withColumn(k, F.lit(v))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, vocabulary, wanted",
    [
        ("AI rules", {"ai": "intelligence"}, "INTELLIGENCE rules"),
        ("Ai rules", {"ai": "intelligence"}, "Intelligence rules"),
        ("ai rules", {"ai": "Intelligence"}, "intelligence rules"),
        ("rainy day", {"ai": "X"}, "rainy day"),
        ("new york and york", {"york": "town", "new york": "city"}, "city and town"),
        ("ai", {}, "ai"),
        (None, {"ai": "x"}, None),
        ("a b", {"a": "b", "b": "c"}, "b c"),
    ],
)
def test_vocabulary(spark, text, vocabulary, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(T.replace_vocabulary("t", vocabulary).alias("x")).first().x == wanted


@pytest.mark.parametrize(
    "text, mode, custom, wanted",
    [
        ("This is fucking ridiculous", "default", (), "This is f****** ridiculous"),
        ("monday is the worst", "custom", ("monday",), "m***** is the worst"),
        ("shittake mushroom", "default", (), "shittake mushroom"),
        ("éshit shité shit_ Shit", "default", (), "éshit shité shit_ S***"),
        ("shit shit, shit", "off", (), "shit shit, shit"),
        ("shit shit", "default", (), "s*** s***"),
    ],
)
def test_bleep(spark, text, mode, custom, wanted):
    assert one(spark, T.bleep("t", mode, custom), t=text) == wanted


@pytest.mark.parametrize("text", ["", "abc", "naïve — 😀", "x" * 1000])
def test_signature_is_the_standard_one(spark, text):
    for key in (b"key", b"k" * 100):
        assert one(spark, security.hmac_sha256(key, "t"), t=text) == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def test_cross_fades(spark):
    rows = spark.createDataFrame([("zoom", 0.5, 3.0), ("fade", 0.0, 1.0), ("spin", 1.0, 1.0), (None, 1.0, 1.0), ("fade", None, 1.0)], "k string, d double, o double")
    made = [tuple(r) for r in rows.select(transitions.fade_fault("k", "d"), transitions.cross_fade("k", "d", "o")).collect()]
    assert made[0] == (None, "[0:v][1:v]xfade=transition=zoomin:duration=0.500:offset=3.000[v]")
    assert made[1:] == [("a fade takes time", None), ("no such fade: spin", None), ("no such fade: null", None), ("a fade takes time", None)]


def test_unknown_capability_is_an_error(spark):
    assert one(spark, T.capability("n"), n="reprompt") == "true"
    with pytest.raises(PySparkException, match="unknown capability: teleport"):
        one(spark, T.capability("n"), n="teleport")


def test_settings(spark):
    assert one(spark, T.score_weights("w"), w='{"hook": 0.5, "audio": 1}') == {"hook": 0.5, "audio": 1.0}
    assert one(spark, T.score_weights("w"), w="nonsense") is None
    assert one(spark, T.split_list("s"), s=" a, ,b ") == ["a", "b"]


def test_caption_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "one\ntwo", 0.0, 1.5), (1, 2, "three", 3661.25, 3662.0)], "vid long, index int, text string, start double, end double")
    for kind in ("srt", "vtt"):
        content = exports.caption_file(rows, kind).first().content
        (tmp_path / f"a.{kind}").write_text(content.replace("\n", "\r\n"))
        found = captions.read_captions(spark, str(tmp_path / f"a.{kind}"))
        assert [(r["index"], r.text, r.start, r.end) for r in found.orderBy("index").collect()] == [(1, "one\ntwo", 0.0, 1.5), (2, "three", 3661.25, 3662.0)]
    vtt = spark.createDataFrame([(1, "WEBVTT\n\nNOTE a\nb\n\n01:02.500 --> 01:03.000 align:left\nhi\n"), (2, ""), (3, None)], "vid long, content string")
    assert [tuple(r) for r in captions.parse_captions(vtt).collect()] == [(1, 1, 62.5, 63.0, "hi")]
    with pytest.raises(ValueError):
        captions.read_captions(spark, str(tmp_path / "a.txt"))


def test_metadata_without_chapters(spark):
    infos = [None, "{}", '{"chapters": null}', '{"chapters": []}', '{"chapters": [{"title": "a", "start_time": 1, "end_time": 2.5}]}']
    rows = spark.createDataFrame([(i, p, x) for i, x in enumerate(infos) for p in ("youtube", "facebook")], "vid long, platform string, info string")
    assert [tuple(r) for r in library.metadata_chapters(rows).collect()] == [(4, 0, "a", 1.0, 2.5)]


def test_first_phrase_wins(spark):
    names = ["ocean.mp4", "sunset_timelapse.mp4", "mountain.mp4", "dog.MP4", "mountain_dog.mov", "sunset.mp4"]
    files = spark.createDataFrame([(i, f"/b/{n}") for i, n in enumerate(names)], "seq long, path string")
    texts = spark.createDataFrame([(1, ["sunset", "mountain", "dog"]), (2, ["cat", "big dog"]), (3, ["cat"]), (4, []), (5, None)], "id long, phrases array<string>")
    found = {r.id: r.path for r in library.matching_footage(texts, files, "id").collect()}
    assert found == {1: "/b/sunset_timelapse.mp4", 2: "/b/dog.MP4"}


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "trends.json").write_text(json.dumps(["how to", "tips"]))
    assert sources.phrases(spark, str(tmp_path / "trends.json")) == ["how to", "tips"]

"""The caption data source: mixed folders, the rules of the column reader, round trips, failing tasks."""

import os
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import captions as columns
from lumenfold.operators import exports
from lumenfold.sources import captions

FOREIGN = {
    "a.srt": "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n00:01:00,000 --> 01:00:00,250 position:10%\r\n\r\n\r\n3\n00:00:03,5 --> 00:00:04,75\n<i>x</i>\n",
    "b.vtt": "WEBVTT - title\n\nNOTE nothing\nhere\n\nSTYLE\n::cue {}\n\nintro\n00:01.000 --> 00:02.000\nÜber --> alles\n \n00:03.000 --> 00:04.000\nlast",
    "sub/c.VTT": "﻿WEBVTT\n\n00:00.000 --> 00:00.001\nbom",
    "empty.srt": "",
    "_hidden/x.txt": "no",
    ".also.txt": "no",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FOREIGN.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/in/{name}"), exist_ok=True)
        with open(f"{tmp_path}/in/{name}", "w", newline="") as f:
            f.write(text)
    return f"{tmp_path}/in"


def rows(frame):
    return sorted((os.path.basename(r.path), r["index"], r.start, r.end, r.text) for r in frame.collect())


def test_reads_mixed_folders(spark, folder):
    found = rows(captions.read_files(spark, folder))
    assert [r[:4] for r in found] == [("a.srt", 1, 1.0, 2.5), ("a.srt", 2, 60.0, 3600.25), ("a.srt", 3, 3.5, 4.75), ("b.vtt", 1, 1.0, 2.0), ("b.vtt", 2, 3.0, 4.0), ("c.VTT", 1, 0.0, 0.001)]
    assert found[0][4] == "Hello\nthere" and found[1][4] == "" and found[3][4] == "Über --> alles" and found[5][4] == "bom"
    by_column = columns.parse_captions(spark.createDataFrame([(n, t) for n, t in FOREIGN.items() if n in ("a.srt", "b.vtt", "empty.srt")], "path string, content string"), "path")
    assert [r for r in found if r[0] != "c.VTT"] == sorted((r.path, r["index"], r.start, r.end, r.text) for r in by_column.collect())
    small = spark.read.format("captions").option("partitionBytes", 10).load(folder)
    assert small.rdd.getNumPartitions() == 4 and rows(small) == found
    assert rows(captions.read_files(spark, f"file://{folder}/b.vtt")) == [r for r in found if r[0] == "b.vtt"]


def test_other_suffixes_are_an_error(spark, folder):
    open(f"{folder}/notes.txt", "w").close()
    with pytest.raises(Exception, match="notes.txt"):
        captions.read_files(spark, folder).count()
    with pytest.raises(Exception, match="missing"):
        captions.read_files(spark, f"{folder}/missing").count()


@pytest.mark.parametrize("kind", ["srt", "vtt"])
def test_writes_the_files_that_columns_make(spark, tmp_path, kind):
    made = [(v, i, i * 61.25, i * 61.25 + 0.999, f"line {i} of {v}\nsecond") for v in range(7) for i in range(1, 1 + (v % 4))]
    frame = spark.createDataFrame(made, "vid int, index int, start double, end double, text string").repartition(5)
    path = f"{tmp_path}/out"
    captions.save_captions(frame, path, kind)
    wanted = {f"{r.vid}.{kind}": r.content for r in exports.caption_file(frame, kind).collect()}
    assert {n: open(f"{path}/{n}").read() for n in os.listdir(path)} == wanted
    assert [(n.split(".")[0], *rest) for n, *rest in rows(captions.read_files(spark, path))] == [(str(v), *rest) for v, *rest in made]
    captions.save_captions(frame.where("vid = 1").withColumn("vid", F.lit(70)), path, kind)
    assert len(os.listdir(path)) == len(wanted) + 1


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    frame = spark.range(40).selectExpr("cast(id AS string) AS vid", "1 AS index", "cast(id AS double) AS start", "id + 1.0D AS end", "CASE WHEN id = 37 THEN raise_error('stopped') ELSE 'x' END AS text")
    path = f"{tmp_path}/out"
    captions.save_captions(frame.where("id < 3"), path)
    with pytest.raises(Exception, match="stopped"):
        captions.save_captions(frame.where("id > 2"), path)
    assert sorted(os.listdir(path)) == ["0.srt", "1.srt", "2.srt"]
    apart = spark.createDataFrame([("a", 1, 0.0, 1.0, "x"), ("b", 1, 0.0, 1.0, "x"), ("a", 2, 0.0, 1.0, "x")], "name string, index int, start double, end double, text string")
    with pytest.raises(Exception, match="come together"):
        apart.coalesce(1).write.format("captions").mode("append").save(path)
    assert sorted(os.listdir(path)) == ["0.srt", "1.srt", "2.srt"]


def test_the_driver_is_told_of_folders_and_not_of_files(tmp_path, monkeypatch):
    """What tasks report and what is planned stay as small however many files there are."""
    writer = captions.CaptionWriter({"path": f"{tmp_path}/out", "kind": "vtt", "spread": "true"}, False)
    names = [f"a-long-name-of-a-video-{i}" for i in range(3000) for _ in range(2)]
    batch = pa.RecordBatch.from_pydict({"name": names, "index": [1, 2] * 3000, "start": [0.0, 1.0] * 3000, "end": [1.0, 2.0] * 3000, "text": ["x"] * 6000})
    told = writer.write(iter([batch.slice(0, 2501), batch.slice(2501)]))
    assert len(told.parts) <= captions.FOLDERS and len(pickle.dumps(told)) < 10 * captions.FOLDERS
    writer.commit([told, None])
    assert len(os.listdir(f"{tmp_path}/out")) == len(told.parts) and all(len(n) == captions.DIGITS for n in os.listdir(f"{tmp_path}/out"))
    reader = captions.CaptionReader({"path": f"{tmp_path}/out"}, None)
    parts = reader.partitions()
    assert len(parts) == 1 and not parts[0].paths and len(parts[0].spans) == len(told.parts)
    assert len(set(reader._paths(captions.fs.LocalFileSystem(), parts[0]))) == 3000
    small = captions.CaptionReader({"path": f"{tmp_path}/out", "partitionBytes": "1000"}, None)
    found = [p for part in small.partitions() for p in small._paths(captions.fs.LocalFileSystem(), part)]
    assert len(found) == len(set(found)) == 3000 and len(small.partitions()) > 100
    monkeypatch.setattr(captions, "MOST_LISTED", 2)
    assert sorted(p for part in small.partitions() for p in small._paths(captions.fs.LocalFileSystem(), part)) == sorted(found)


def test_spread_files_are_read_like_others(spark, tmp_path):
    path = f"{tmp_path}/out"
    made = [(f"v{v}", i, i * 1.5, i + 1.25, f"line {i}") for v in range(50) for i in range(1, 2 + v % 3)]
    frame = spark.createDataFrame(made, "vid string, index int, start double, end double, text string").repartition(3)
    captions.save_captions(frame.where("vid < 'v3'"), path, "srt", spread=True)
    captions.save_captions(frame.where("vid >= 'v3'"), path, "srt", spread=True)
    assert not [n for n in os.listdir(path) if not os.path.isdir(f"{path}/{n}")]
    assert [(n.split(".")[0], *rest) for n, *rest in rows(captions.read_files(spark, path))] == sorted(made)
    twice = spark.range(0, 2, 1, 2).selectExpr("'v1' AS name", "1 AS index", "0.0D AS start", "1.0D AS end", "'x' AS text")
    for spread in (True, False):
        with pytest.raises(Exception, match="two tasks"):
            twice.write.format("captions").option("spread", spread).mode("append").save(path)
    assert len(rows(captions.read_files(spark, path))) == len(made)
    twice.limit(1).write.format("captions").mode("overwrite").save(path)
    assert [r[:2] for r in rows(captions.read_files(spark, path))] == [("v1.srt", 1)]


@pytest.mark.parametrize("kind", ["srt", "vtt"])
def test_listed_captions_make_the_same_files(spark, tmp_path, kind):
    made = [(v, i, i * 61.25, i * 61.25 + 0.999, f"line {i} of {v}") for v in range(7) for i in range(1, 1 + (v % 4))]
    frame = spark.createDataFrame(made, "vid int, index int, start double, end double, text string")
    listed = frame.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("index", "text", "start", "end"))).alias("captions"))
    none = spark.createDataFrame([(8, []), (9, None)], "vid int, captions array<struct<index int, text string, start double, end double>>")
    captions.save_captions(frame, f"{tmp_path}/rows", kind)
    captions.save_captions(listed.union(none), f"{tmp_path}/lists", kind)
    for dealt, by in (("apart", "vid"), ("dealt", captions.part_of("vid"))):
        captions.save_captions(listed.repartition(3, by), f"{tmp_path}/{dealt}", kind, dealt=True)
    files = [{n: open(f"{tmp_path}/{d}/{n}").read() for n in os.listdir(f"{tmp_path}/{d}")} for d in ("rows", "lists", "apart", "dealt")]
    assert files[0] == files[1] == files[2] == files[3] and len(files[0]) == 5
    with pytest.raises(Exception, match="come together"):
        captions.save_captions(listed.union(listed), f"{tmp_path}/twice", kind)

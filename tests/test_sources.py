import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab import schemas
from postlab.session import shared_dir, work_path
from postlab.sources import readers, sinks

SMALL = T.StructType([T.StructField("post_id", T.LongType()), T.StructField("content", T.StringType()),
                      T.StructField("location", T.StringType())])


def test_folder_scan(spark, tmp_path):
    head = "post_id,content,location\n"
    (tmp_path / "a.csv").write_text("﻿" + head + '1,"two\nlines, ""quoted""",Paris\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + "2,plain,\n", encoding="utf-8")
    (tmp_path / "My Posts With Location 3.csv").write_text(head + "9,result,X\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("x")
    rows = sorted(tuple(r) for r in readers.scan_posts_csv(spark, str(tmp_path), SMALL).collect())
    assert rows == [(1, 'two\nlines, "quoted"', "Paris"), (2, "plain", None)]


def test_bad_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text('post_id,content,location\n1,"a, ""b""\nc",P\n2,b\n3,c,Q,extra\n4,d,R,\n4,d,R,,\n5,NA,None\nx,e,S\n')
    rows = sorted((r.post_id or -1, r.content, r.location) for r in
                  readers.scan_skip_bad_rows(spark, str(tmp_path), SMALL).collect())
    assert rows == [(-1, "e", "S"), (1, 'a, "b"\nc', "P"), (2, "b", None), (5, None, None)]


def test_text_files_of_unknown_encoding(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("né".encode())
    (tmp_path / "l.txt").write_bytes("né".encode("latin-1"))
    assert [r.text for r in readers.read_text_files(spark, str(tmp_path)).collect()] == ["né", "né"]


def test_csv_round_trip_keeps_text(spark, tmp_path):
    texts = ['a "quoted" one', "line\nbreak\r\nand more", "back\\slash", "comma, semi;", "  padded  ", "日本", '"', '""', "\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, content string")
    sinks.sink_csv_bom(df, str(tmp_path / "out"))
    back = readers.scan_single_csv(spark, str(tmp_path / "out"), df.schema)
    assert {r.post_id: r.content for r in back.collect()} == dict(enumerate(texts))
    first = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert first.startswith("﻿post_id".encode()) or first.startswith('"﻿post_id"'.encode())


def test_search_hits(spark, tmp_path):
    hit = {"uri": "at://x/y/abc", "author": {"handle": "me.de"}, "record": {"text": "hello"}, "like_count": 3,
           "search_term": "AI", "term_idx": 0, "pos": 1}
    (tmp_path / "h.json").write_text(json.dumps(hit) + "\n")
    row = readers.ingest_search_hits(readers.read_search_hits(spark, str(tmp_path))).first()
    assert (row.post_id, row.display_name, row.created_at, row.like_count, row.repost_count) == ("abc", "", "", 3, 0)


def test_tweets(spark, tmp_path):
    lines = [{"id": "1", "text": "a", "geo": {"coordinates": {"coordinates": [1.0, 2.0]}}, "public_metrics": {"like_count": 4}},
             {"id": "2", "text": "b", "geo": {"place_id": "p"}}, {"id": "3", "text": "c", "geo": {"place_id": "q"}}, {"id": "4", "text": "d"}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    places = spark.createDataFrame([("p", "Full", "US", ([0.0, 10.0, 2.0, 20.0],), 0)], schemas.PLACE)
    got = {r.id: (r.latitude, r.longitude, r.location_type, r.place_name) for r in
           readers.ingest_tweets(readers.read_tweets(spark, str(tmp_path)), places).collect()}
    assert got == {"1": (2.0, 1.0, "coordinates", ""), "2": (15.0, 1.0, "place_center", "Full")}


def test_metrics_and_best_model(spark, tmp_path):
    folder = str(tmp_path / "m")
    assert readers.read_best_model(spark, folder + "/metrics.json").first()[0] == "roberta_twitter"
    df = spark.createDataFrame([("vader", 0.5, 0.6, 0.7, 0.5, 10), ("naive_bayes", 0.5, 0.6, 0.1, 0.5, 10)], schemas.METRICS)
    sinks.sink_metrics(df, folder)
    assert readers.read_best_model(spark, folder + "/metrics.json").first()[0] == "vader", "the first of a tie"
    record = json.loads(next((tmp_path / "m" / "metrics.json").glob("part-*.json")).read_text())
    assert record["results"]["vader"]["f1_score"] == 0.6 and record["best_model"] == "vader"


def test_compute_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("t", 1)], "text string, extra int")

    path = str(tmp_path / "p")
    assert sinks.compute_if_absent(spark, path, compute).columns == ["text"]
    assert sinks.compute_if_absent(spark, path, compute).count() == 1 and len(calls) == 1


def test_work_paths_live_in_the_shared_folder(spark):
    assert work_path(spark, "x").startswith(shared_dir(spark)) and work_path(spark, "x") != work_path(spark, "x")


def test_excluded_files_are_pruned_from_the_listing(spark, tmp_path):
    for name in ("a.csv", "posts with location.csv"):
        (tmp_path / name).write_text("post_id,content,location\n1,a,b\n")
    df = readers.scan_posts_csv(spark, str(tmp_path), SMALL)
    assert df.count() == 1 and df.rdd.getNumPartitions() == 1
    assert df.select(F.input_file_name()).distinct().count() == 1

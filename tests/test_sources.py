"""Readers, writers, evaluation of wide tables, and streams."""

from __future__ import annotations

import json

import pytest

from patraka.operators import evaluation, ingest, spelling
from patraka.sources import tables
from patraka.streaming import transcripts


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('recording_id,duration,user_id,note\n7,3.5,u,"a ""b"", c"\n8,,,\n', encoding="utf-8")
    got = tables.manifest(spark, str(tmp_path / "m.csv")).orderBy("recording_id").collect()
    assert [(r.recording_id, r.duration, r.rec_url_gcp, r.note) for r in got] == [("7", 3.5, None, 'a "b", c'), ("8", None, None, None)]


def test_transcript_files_to_segments(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "7_transcription.json").write_text(json.dumps([{"text": "x", "start": 0, "end": 2}], indent=1))
    (tmp_path / "8.json").write_text("{")
    got = tables.transcript_files(spark, str(tmp_path)).withColumn("segments", ingest.segments(__import__("pyspark").sql.functions.col("raw")))
    assert {r.recording_id: len(r.segments) for r in got.collect()} == {"7": 1, "8": 0}


def test_ranks_follow_the_file(spark, tmp_path):
    words = [f"w{i * 7919 % 5000}" for i in range(5000)]
    words[3] = ""
    (tmp_path / "w.csv").write_text("word,n\n" + "".join(f"{w},{i}\n" for i, w in enumerate(words)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = tables.ranked_words(spark, str(tmp_path / "w.csv")).orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.rank for r in got] == list(range(1, 5001))
    assert [r.word for r in got] == [w or "nan" for w in words]


HEADER = "segment_url_link,Human, Model H,Model i,\n"


def test_wide_table_evaluation(spark, tmp_path):
    (tmp_path / "q.csv").write_text(HEADER + 'u1,A x y,A x q y,A x y,\nu2,"A\nb",A b,,\n', encoding="utf-8")
    wide = tables.model_outputs(spark, str(tmp_path / "q.csv"))
    assert wide.columns[:3] == ["segment_idx", "segment_url_link", "Human"]
    detail = evaluation.evaluate(wide)
    got = {(r.segment_idx, r.model): (r.standard_wer, r.lattice_wer, r.ref_length) for r in detail.collect()}
    assert got[0, "Model i"] == (0.0, 0.25, 3)
    assert got[0, "Model H"] == (pytest.approx(1 / 3), 0.0, 3)
    assert got[1, "Model H"] == (0.0, 0.0, 2)
    assert len(got) == 6 and len(evaluation.evaluate(wide, drop_empty=True).collect()) == 3
    assert {r.lattice_wer for r in evaluation.evaluate(wide, epsilon_bins=True, drop_empty=True).collect()} == {0.0}
    said = {r.model: r.improvement_pct for r in evaluation.summary(detail).collect()}
    assert said["Model H"] == 100.0 and said["Model i"] == pytest.approx(-25.0)


def test_micro_and_macro_rates_differ(spark):
    df = spark.createDataFrame([(["a"], ["b"]), (["a", "b", "c"], ["a", "b", "c"])], "r array<string>, h array<string>")
    row = evaluation.corpus_wer(df, "r", "h").first()
    assert (row.n, row.wer_micro, row.wer_macro) == (2, 0.25, 0.5)


def test_listing_and_sinks(spark, tmp_path):
    for name in ("b/2.wav", "a/1.wav", "a/x.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"1234")
    got = tables.recordings(spark, str(tmp_path / "in")).collect()
    assert [(r.recording_id, r.path[-5:], r.length) for r in got] == [("a", "1.wav", 4), ("b", "2.wav", 4)]
    df = spark.createDataFrame([(1, 'a "b"', ["x"]), (2, None, None)], "i long, s string, l array<string>")
    tables.write_csv(df, str(tmp_path / "out"))
    assert sorted((r.i, r.s, r.l) for r in tables.read_csv(spark, str(tmp_path / "out"), "i long, s string, l string").collect()) == [(1, 'a "b"', '["x"]'), (2, None, None)]
    assert tables.export_csv(df.select("i", "s"), str(tmp_path / "one.csv"), bom=True) == 2
    assert (tmp_path / "one.csv").read_bytes().startswith(b"\xef\xbb\xbfi,s\r\n")


def test_non_empty(spark):
    assert tables.non_empty(spark.createDataFrame([("a",), (" ?! ",), (None,)], "text string")).count() == 1


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "दो किताबें", "दो किताब"), ("2024-01-01 00:02:00", "मोबाइल में", "मोबाइल में"), ("2024-01-01 00:15:00", "a", "b")]
    spark.createDataFrame(rows, "t string, ref string, hyp string").selectExpr("cast(t as timestamp) as t", "ref", "hyp").write.parquet(str(tmp_path / "in"))

    def drained(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    stream = spark.readStream.schema("t timestamp, ref string, hyp string").parquet(str(tmp_path / "in"))
    got = drained(transcripts.cleaned(stream, "ref").select("ref", "tagged"), "cleaned", "append")
    assert {r.ref: r.tagged for r in got} == {"दो किताबें": "2 किताबें", "मोबाइल में": "[EN]मोबाइल[/EN] में", "a": "[EN]a[/EN]"}
    got = drained(transcripts.classified(stream, "ref").select("ref", "layer"), "classified", "append")
    assert {r.ref: r.layer for r in got}["a"] == "mixed_script"
    got = drained(transcripts.error_rates(stream, "t", "ref", "hyp"), "rates", "complete")
    assert sorted((r.window.start.minute, r.n, r.wer_micro) for r in got) == [(0, 2, 0.25), (10, 1, 1.0)]


def test_check_csv_and_cache(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,word\n1,घर\n2,xyzहां\n3,\n4,007\n", encoding="utf-8")
    row = spelling.check_csv(spark, str(tmp_path / "w.csv"), str(tmp_path / "out")).first()
    assert (row.total_words, row.correct_spelling, row.incorrect_spelling, row.correct_pct) == (4, 1, 3, 25.0)
    got = {r.word: (r.classification, r.layer) for r in tables.read_csv(spark, str(tmp_path / "out"), text=True).collect()}
    assert got == {"घर": ("correct", "dictionary"), "xyzहां": ("incorrect", "mixed_script"), "nan": ("incorrect", "mixed_script"), "007": ("incorrect", "mixed_content")}
    calls = spark.sparkContext.accumulator(0)

    def seen(it):
        for batch in it:
            calls.add(1)
            yield batch

    df = spark.range(3).mapInArrow(seen, "id long")
    first = sorted(r.id for r in tables.cached(df, str(tmp_path / "cache")).collect())
    before = calls.value
    assert sorted(r.id for r in tables.cached(df, str(tmp_path / "cache")).collect()) == first == [0, 1, 2]
    assert calls.value == before > 0

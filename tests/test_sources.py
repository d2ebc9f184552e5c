from __future__ import annotations

import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from tonewright.functions import scalars as S
from tonewright.operators import intervals, windows
from tonewright.sources import readers, sinks
from tonewright.streaming import windows as streams


def write_wav(path, width, frames, channels=2, rate=8000):
    top = (1 << (8 * width - 1)) - 1
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        out = b""
        for row in frames:
            for v in row[:channels]:
                x = int(round(v * top))
                out += struct.pack("B", x + 128) if width == 1 else (x & ((1 << 8 * width) - 1)).to_bytes(width, "little")
        w.writeframes(out)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_widths(spark, tmp_path, width):
    frames = [(0.5, -0.5), (0.25, 0.25), (-1.0, 1.0), (0.0, 0.0)]
    write_wav(tmp_path / "a.wav", width, frames)
    row = readers.read_wav(spark, str(tmp_path)).first()
    assert (row["sample_rate"], row["channels"], row["sample_width"], row["total_frames"], row["status"]) == (8000, 2, width, 4, "ok")
    assert row["left"] == pytest.approx([f[0] for f in frames], abs=0.02)
    assert row["right"] == pytest.approx([f[1] for f in frames], abs=0.02)


def test_wav_mono_diagnostics_and_bad_file(spark, tmp_path):
    write_wav(tmp_path / "m.wav", 2, [(0.5,), (-0.5,)], channels=1)
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    chunks = readers.read_wav(spark, str(tmp_path))
    assert sorted(r["status"][:10] for r in chunks.collect()) == ["ok", "unreadable"]
    d = readers.channel_diagnostics(chunks).first()
    assert d["identical"] and d["near_zero_side"]


def test_packets(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"detections": [{"label": "Lead_Vocal", "score": "0.9", "time_range": [1, 2]}, {"nothing": 1}], "tracks": [{"family": "bass", "confidence": 0.3}]}), encoding="utf-8")
    (tmp_path / "b.json").write_text("[1, 2]")
    (tmp_path / "c.json").write_text("{broken")
    found = readers.detections(readers.read_packets(spark, str(tmp_path)))
    (tmp_path / "top").mkdir()
    (tmp_path / "top" / "b.json").write_text(json.dumps({"instrument": "Piano", "events": [{"label": "bass"}, {"label": "drums", "score": 7}]}, indent=2), encoding="utf-8")
    own = readers.detections(readers.read_packets(spark, str(tmp_path / "top")))
    assert sorted((r["family"], r["confidence"]) for r in own.collect()) == [("bass", 1.0), ("drums", 1.0), ("piano", 1.0)]
    assert sorted((r["family"], r["confidence"], r["start_s"]) for r in found.collect()) == [("bass", 0.3, None), ("lead vocal", 0.9, 1.0)]
    assert [(r["family"], r["tier"]) for r in readers.retained(found).collect()] == [("lead vocal", "strong")]


def test_lines_notes_lyrics_stems(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.read_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "n.csv").write_text("start_time_s,end_time_s,pitch_midi,amplitude\n0.5,1.0,60,0.7\nx,2,61,\n")
    assert sorted((r["pitch"], r["start_s"]) for r in readers.read_notes(spark, str(tmp_path / "n.csv")).collect()) == [(60.0, 0.5), (61.0, None)]
    (tmp_path / "l.txt").write_text("one\n  \ntwo\n")
    assert readers.lyric_lines(spark, str(tmp_path / "l.txt")).first()["lines"] == 2
    (tmp_path / "s").mkdir()
    for n in ("song_vocals.wav", "song-bass.flac", "song.txt", "plain.wav"):
        (tmp_path / "s" / n).write_bytes(b"x")
    assert sorted(r["family"] for r in readers.stems(spark, str(tmp_path / "s")).collect()) == ["bass_like", "voice_like"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "track int, i int, v string")
    path = sinks.write_layer(df, str(tmp_path), " My layer/1 ")
    assert path.endswith("/My_layer_1") and spark.read.parquet(path).count() == 3
    reports = {r["track"]: r["report"] for r in sinks.markdown_lines(df, "track", "i", ["i", "v"]).collect()}
    assert reports[1].splitlines()[2:] == ["| 1 | a |", "| 2 | b |"] and reports[2].splitlines()[2:] == ["| 1 |  |"]


def test_scalars(spark):
    row = spark.range(1).select(
        S.parse_clock(F.lit("1:02:03.5")).alias("a"), S.parse_clock(F.lit("12s")).alias("b"), S.parse_clock(F.lit("x")).alias("c"), S.first_nonempty(F.lit(" "), F.lit(None), F.lit("z ")).alias("d"),
        S.file_name(F.lit("///")).alias("e"), S.band(F.lit(None).cast("double"), S.SUPPORT_BANDS).alias("f"), S.norm_signed(F.lit(-0.5)).alias("g"), S.comparative_band(F.lit(0.2)).alias("h"), S.trend(F.lit(-1.0), 0.1).alias("i"),
        S.overlap_ratio(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(5.0)).alias("j"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g, row.h, row.i, row.j) == (3723.5, 12.0, None, "z", "audio", None, 0.25, "higher", "falling", 0.5)


def test_split_long_and_islands(spark):
    df = spark.createDataFrame([("t", 0.0, 100.0), ("t", 100.0, 130.0)], "track string, a double, b double")
    parts = windows.split_long(df, "track", "a", "b", 45.0).orderBy("part_start").collect()
    assert [round(p["part_end"] - p["part_start"], 3) for p in parts] == [33.333, 33.333, 33.333, 30.0]
    runs = spark.createDataFrame([(1, i, x) for i, x in enumerate([1, 1, 0, 1, 0, 0, 1])], "track int, i int, x int")
    assert sorted(r["island"] for r in windows.islands(runs, F.col("x") == 1, "track", "i").collect()) == [1, 1, 2, 3]


def test_overlap_join_gives_each_pair_once(spark):
    l = spark.createDataFrame([(1, 1, 0.0, 1000.0)], "k int, l int, a0 double, b0 double")
    r = spark.createDataFrame([(1, i, float(i * 10), float(i * 10 + 25)) for i in range(50)], "k int, r int, a1 double, b1 double")
    assert intervals.overlap_join(l, r, ["k"], ("a0", "b0"), ("a1", "b1"), 7.0).count() == 50


def test_streams_agree_with_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    source = tmp_path / "in"
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    q = streams.rolling_activity(stream, "ts", "user_id", "value", late="60 days").writeStream.outputMode("update").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    batch = windows.rolling(events, "ts", "3 days", "1 day").groupBy("user_id", "start").count()
    last = spark.sql("select user_id, start, max(n) as n from rolled group by user_id, start")
    assert sorted((r[0], r[1], r[2]) for r in last.collect()) == sorted((r[0], r[1], r[2]) for r in batch.collect())
    q = streams.sessions(stream, "ts", "user_id", gap="6 hours", late="60 days").writeStream.outputMode("append").format("memory").queryName("sess").start()
    q.processAllAvailable()
    q.stop()
    q = streams.relative_contrast(stream.select("user_id", "event_id", "value"), "user_id", "event_id", "value").writeStream.outputMode("append").format("memory").queryName("contrast").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from contrast").first()[0] == events.count()


def test_calibration_profiles_and_optional_packets(spark, tmp_path):
    profile = {
        "segment_overrides": {"segment_01": {"dominant_object": " voice ", "texture_keywords": ["a", " ", "b"]}, "segment_02": {"human_note": ""}, "segment_03": "text"},
        "segment_fallback_notes": {"segment_01": {"important_hearing": "low"}},
        "macro_sections": [{"start_seconds": 0, "end_seconds": "10.5", "focus": "f", "keywords": ["x", "y"]}, {"start_seconds": "soon", "end_seconds": 3}, {"end_seconds": 4, "note": "n"}],
        "section_aliases": {"verse_like": ["V", "W"], "intro_like": " I ", "empty": "", "none": []},
    }
    (tmp_path / "p.json").write_text(json.dumps(profile), encoding="utf-8")
    packets = readers.read_optional(spark, str(tmp_path / "p.json"))
    got = {r["segment_id"]: tuple(r)[2:] for r in readers.calibration(packets, "segment_overrides").collect()}
    assert got == {"segment_01": ("voice", None, "a, b", None), "segment_02": (None,) * 4, "segment_03": (None,) * 4}
    assert [tuple(r)[1:] for r in readers.calibration(packets, "segment_fallback_notes").collect()] == [("segment_01", None, "low", None, None)]
    assert sorted(tuple(r)[1:] for r in readers.macro_sections(packets).collect()) == [(0, 0.0, 10.5, "f", None, "x, y"), (2, 0.0, 4.0, None, "n", None)]
    assert {r["label"]: r["alias"] for r in readers.section_aliases(packets).collect()} == {"verse_like": "V", "intro_like": "I"}
    missing = readers.read_optional(spark, str(tmp_path / "no such folder"))
    assert missing.count() == 0 and readers.calibration(missing, "segment_overrides").count() == 0 and readers.macro_sections(missing).count() == 0


def test_context_files_and_lyric_anchors(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.json").write_text('{"b": [1, 2]}', encoding="utf-8")
    (tmp_path / "c" / "b.txt").write_text("\n  " + "x" * 30 + " \n", encoding="utf-8")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["body"], r["shortened"]) for r in readers.context_files(spark, str(tmp_path / "c"), 25).collect()}
    assert got == {"a.json": ("json", '{"b":[1,2]}', False), "b.txt": ("text", "x" * 25, True)}
    (tmp_path / "l.json").write_text(json.dumps({"lines": [{"from": 1, "to": 2.5, "line_id": "L1", "text": "secret"}, 3], "events": [{"time_range": [4, 5], "role": "hook"}, {"label": " "}]}), encoding="utf-8")
    out = readers.lyric_anchors(readers.read_packets(spark, str(tmp_path / "l.json")))
    assert sorted((tuple(r)[1:] for r in out.collect()), key=str) == [(1.0, 2.5, "L1", "lyric timing anchor"), (4.0, 5.0, "lyric_anchor", "hook"), (None, None, "lyric_anchor", "lyric timing anchor")]
    assert "secret" not in str(out.collect())

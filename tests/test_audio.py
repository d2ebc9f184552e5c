"""Audio through frames, spectra and tempo to segments, against numpy and numbers worked out by hand."""

from __future__ import annotations

import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import audio
from tonewright.sources import readers


def write_tone(path, seconds, rate=8000):
    t = np.arange(int(seconds * rate)) / rate
    x = np.stack([0.5 * np.sin(2 * np.pi * 440 * t), 0.25 * np.sin(2 * np.pi * 440 * t)], 1)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return (x * 32767).astype("<i2").astype(np.float32) / 32768


def test_features_of_a_file_over_two_chunks(spark, tmp_path):
    x = write_tone(tmp_path / "a.wav", 31.03)
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    rows = audio.audio_features(readers.read_wav(spark, str(tmp_path))).orderBy("frame_idx").collect()
    size, hop = 744, 800
    count = math.ceil((len(x) - size) / hop) + 1
    assert [r["frame_idx"] for r in rows] == [i for i in range(count) if i * hop < len(x)]
    for i in (0, 1, 299, 300, 301, count - 1):
        part = x[i * hop : i * hop + size]
        r = rows[i]
        assert r["t"] == pytest.approx((i * hop + len(part) / 2) / 8000)
        assert r["rms"] == pytest.approx(np.sqrt((part**2).mean()), rel=1e-4)
        assert r["peak"] == pytest.approx(np.abs(part).max(), rel=1e-5)
        mean = np.zeros(size, np.float32)
        mean[: len(part)] = part.mean(1)
        power = np.abs(np.fft.rfft(mean * np.hanning(size))) ** 2
        f = np.fft.rfftfreq(size, 1 / 8000)
        assert r["centroid"] == pytest.approx((f * power).sum() / power.sum(), rel=1e-3)
        assert r["balance"] == pytest.approx(-0.6, abs=0.01)
    assert rows[0]["flux"] == 0


def test_short_and_empty_files(spark, tmp_path):
    write_tone(tmp_path / "short.wav", 0.01)
    write_tone(tmp_path / "none.wav", 0)
    rows = audio.audio_features(readers.read_wav(spark, str(tmp_path))).collect()
    assert [(r["frame_idx"], r["frame_size"]) for r in rows] == [(0, 744)]


def pulses(period, n=200):
    return [(0.0 if i % period else 1.0) for i in range(n)]


def test_tempo_folds_a_fast_pulse(spark):
    """A pulse each 7 frames of 0.05 s is 171.4 a minute; its double period is 85.7, which is near 86."""
    values = [("fast", i, v) for i, v in enumerate(pulses(7))] + [("calm", i, v) for i, v in enumerate(pulses(12))] + [("flat", i, 0.0) for i in range(40)] + [("brief", i, float(i == 3)) for i in range(9)]
    df = spark.createDataFrame(values, "track string, i int, flux double").withColumn("rms", F.lit(0.0))
    out = {r["track"]: r for r in audio.refined_tempo(audio.onset_envelope(df, "flux", "rms", "track", "i"), "track", "i", 0.05, 50, 200).collect()}
    assert out["fast"]["raw_bpm"] == pytest.approx(60 / 0.35) and out["fast"]["bpm"] == 86 and out["fast"]["folded"]
    assert out["calm"]["bpm"] == 100 and not out["calm"]["folded"] and out["calm"]["confidence"] == pytest.approx(1)
    assert out["calm"]["first_beat"] == 0
    assert out["flat"]["bpm"] is None and out["flat"]["confidence"] == 0
    assert out["brief"]["bpm"] is None and out["brief"]["confidence"] == 0


def grid(spark, frames, marks, least=8.0, most=45.0):
    f = spark.createDataFrame([("a", float(t), float(v)) for t, v in frames], "track string, t double, novelty double")
    m = spark.createDataFrame([("a", k, float(t)) for k, t in marks], "track string, kind string, t double")
    return [(r["start_s"], r["end_s"]) for r in audio.split_and_snap(f, m, least, most).orderBy("segment").collect()]


def test_long_stretches_are_cut_where_frames_change(spark):
    frames = [(t, {5: 9, 30: 3, 70: 5}.get(t, 0)) for t in range(100)]
    assert grid(spark, frames, [("boundary", 0), ("boundary", 100)]) == [(0, 30), (30, 70), (70, 100)]


def test_cuts_without_frames_are_in_the_middle(spark):
    assert grid(spark, [(0, 0)], [("boundary", 0), ("boundary", 100)]) == [(0, 25), (25, 50), (50, 75), (75, 100)]


def test_boundaries_move_to_near_bars(spark):
    bars = [("bar", t) for t in (0, 19, 21.5, 31)]
    marks = [("boundary", t) for t in (0, 20, 28, 60)] + bars
    assert grid(spark, [(0, 0)], marks) == [(0, 19), (19, 28), (28, 60)]
    # No bar is within 1.6 s of 12, and 60 s is not too long.
    assert grid(spark, [(0, 0)], [("boundary", t) for t in (0, 12, 72)] + [("bar", 41), ("bar", 45)], most=60.0) == [(0, 12), (12, 72)]


def test_grid_covers_each_track(spark, small):
    from tonewright.plans import audio as plans

    rows = plans.w05_segment_grid(spark, small).orderBy("track", "segment").collect()
    assert rows and all(r["end_s"] > r["start_s"] for r in rows)
    assert all(b["start_s"] == (a["end_s"] if a["track"] == b["track"] else 0) for a, b in zip(rows, rows[1:], strict=False))


def test_preview_is_linspace(spark):
    for n in (1, 19, 20, 21, 50, 333):
        df = spark.range(n).select(F.col("id").alias("i"))
        found = sorted(r["i"] for r in df.where(audio.in_preview("i", F.lit(n), 20)).collect())
        assert found == (list(range(n)) if n <= 20 else sorted({j * (n - 1) // 19 for j in range(20)}))


def test_note_items_and_fields(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.json").write_text("﻿" + json.dumps({"events": [{"pitch": 60}, 3], "detections": [{"pitch": 1}]}), encoding="utf-8")
    (notes / "b.json").write_text(json.dumps([{"pitch": 61}, "x"]))
    (notes / "c.json").write_text(json.dumps({"pitch": 62}))
    (notes / "d.json").write_text("{broken")
    rows = readers.read_note_items(spark, str(notes)).select(F.try_variant_get("item", "$.pitch", "int").alias("p")).collect()
    assert sorted(r["p"] for r in rows) == [60, 61, 62]
    fields = tmp_path / "fields"
    fields.mkdir()
    (fields / "a.txt").write_text("DURATION=12\nFINGERPRINT= AQ=A \nDURATION=13\nnothing\n")
    (fields / "b.txt").write_text('{"duration": 3, "name": "x"}')
    (fields / "c.txt").write_text("[1]")
    found = {r["path"][-5:]: r["fields"] for r in readers.read_fields(spark, str(fields)).collect()}
    assert found == {"a.txt": {"DURATION": "13", "FINGERPRINT": "AQ=A"}, "b.txt": {"duration": "3", "name": "x"}, "c.txt": {}}

"""Events beside windows, change words, gates of streams, and what nested answers and packets tell, against plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tonewright.operators import context as C


def test_local_events_by_brute_force(spark):
    rng = random.Random(4)
    windows = [(t, i, i * 0.7, i * 0.7 + rng.choice([0.3, 2.0, 5.5])) for t in range(2) for i in range(30)]
    events = [(rng.randrange(3), a := rng.randrange(200) / 10, a + rng.choice([0.1, 1.0, 12.0]), f"e_{k:03d}") for k in range(80)]
    got = {(r["track"], r["segment"]): (r["n"], r["events"]) for r in C.local_events(spark.createDataFrame(windows, "track int, segment int, start_s double, end_s double").repartition(3), spark.createDataFrame(events, "track int, start_s double, end_s double, event_id string"), 4).collect()}
    for t, i, a, b in windows:
        met = sorted((s, n) for u, s, e, n in events if u == t and s < b and a < e)
        assert got[t, i] == (len(met), ",".join(n for _, n in met[:4]))


def test_changes(spark):
    df = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.59), (0, 2, 0.51), (0, 3, 0.4), (1, 7, 0.1)], "track int, segment int, x double")
    assert [r["x_change"] for r in C.changes(df, ["x"]).orderBy("track", "segment").collect()] == ["none", "increases", "stable", "decreases", "none"]


def test_gates(spark):
    rows = [(0, "focused"), (0, "focused"), (0, "bright"), (0, "voice_like_or_lead_like"), (1, "focused"), (1, "warm"), (2, "no such name")]
    got = {(r["track"], r["stream"]): (r["passed"], r["targets"], r["before"]) for r in C.gated_streams(spark.createDataFrame(rows, "track int, name string")).collect()}
    assert len(got) == 18
    assert got[0, "center_mid_lead"] == (True, "bright,focused,voice_like_or_lead_like", "bright,focused,voice_like_or_lead_like")
    assert got[1, "center_low_sustain"] == (False, "stream_level_ome_required", "focused,warm")
    assert got[2, "wide_diffuse_texture"] == (False, "stream_level_ome_required", "")


def test_identities(spark):
    answers = {
        1: {"title": " T ", "artist": "", "artist_name": "N", "year": 1999, "score": 0.5, "results": [{"title": "no"}]},
        2: {"results": [{"score": 0.9, "title": "outer", "recordings": [{"title": "inner", "artists": [{"name": "A"}, {"name": "B"}], "releases": [{"title": "L", "date": "2001"}]}]}]},
        3: {"results": [{"title": "outer", "artist": "best", "recordings": []}], "album": "own"},
        4: {"results": [], "album": "own"},
        5: {"results": "none"},
        6: [1],
    }
    rows = [(k, json.dumps(v)) for k, v in answers.items()] + [(7, "broken{"), (8, None)]
    got = {r["k"]: tuple(r[n] for n in (*C.DIRECT, "direct")) for r in C.identities(spark.createDataFrame(rows, "k int, j string"), "j").collect()}
    none = (None, None, None, None, None, True)
    assert got == {
        1: ("T", "N", None, "1999", "0.5", True),
        2: ("inner", "A", "L", "2001", "0.9", False),
        3: ("outer", "best", None, None, None, False),
        4: (None, None, "own", None, None, True),
        5: none, 6: none, 7: none, 8: none,
    }


def test_notes_tags_and_fingerprints(spark):
    notes = [{"onset": "1.25", "duration": 2, "note": 60, "instrument": "Lead-Vocal x"}, {"start": 3, "end_time": 4.5, "pitch": "61.5", "probability": 0.25, "amplitude": 0.1}, {"pitch": 50}, {"velocity": 3}, {"end": 2}, 7, None, {"start": "soon"}]
    df = spark.createDataFrame([(i, json.dumps(n)) for i, n in enumerate(notes)], "k int, j string").select("k", F.try_parse_json("j").alias("n"))
    got = {r["k"]: tuple(r)[1:] for r in C.normal_notes(df, "k", "n", 0.6, "adapter").collect()}
    assert got == {0: ("lead_vocal_x", 1.25, 3.25, 60.0, None, 0.6), 1: ("adapter", 3.0, 4.5, 61.5, 0.1, 0.25), 2: ("adapter", 0.0, 0.0, 50.0, None, 0.6), 4: ("adapter", 0.0, 2.0, None, None, 0.6)}
    packets = {
        1: {"format": {"tags": {"TITLE": "one", "Album Artist": "AA"}}, "tags": {"title": "two", "Track": "t"}, "streams": [3, {"tags": {"Title": "three"}}], "fingerprint": "abc", "duration": 12},
        2: {"tags": {"title": "  ", "track": "t", "year": 1999}, "FINGERPRINT": ""},
        3: {"streams": "none"},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in packets.items()] + [(4, None)], "k int, j string").withColumn("v", F.try_parse_json("j"))
    got = {r["k"]: r for r in C.metadata_tags(df, "k", "v").withColumn("z", C.fingerprint(F.col("v"))).collect()}
    assert (got[1]["title"], got[1]["album_artist"]) == ("three", "AA") and tuple(got[1]["z"]) == ("attached_fingerprint", "12", 3)
    assert (got[2]["title"], got[2]["date"], got[2]["year"]) == ("t", "1999", "1999") and tuple(got[2]["z"]) == ("attached_without_fingerprint_field", None, 0)
    assert got[3]["title"] is None and tuple(got[4]["z"]) == ("not_attached", None, 0)


@pytest.mark.parametrize(
    ("text", "safe", "claimed"),
    [("The Source Truth and STEM TRUTH", "The source certainty and stem certainty", True), ("confirmed instruments", "settled instruments", True), ("original  track", "original  track", False), (None, "", False), ("source truthsource truth", "source certaintysource certainty", True)],
)
def test_safe_texts(spark, text, safe, claimed):
    r = spark.createDataFrame([(text,)], "t string").select(C.safe_text(F.col("t")).alias("s"), C.holds_claims(F.col("t")).alias("c")).first()
    assert (r["s"], r["c"]) == (safe, claimed)


def test_stem_confidence(spark):
    df = spark.createDataFrame([("vocals", 0.5), ("drum", 0.9), ("other", 0.7), ("other", 0.4), ("piano", 0.7)], "s string, d double")
    assert [r[0] for r in df.select(C.stem_confidence(F.col("s"), F.col("d"))).collect()] == [0.82, 0.9, 0.62, 0.4, 0.7]

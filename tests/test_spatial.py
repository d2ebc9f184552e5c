"""The spatial frame bank on frames of which the answer is known, and its segments and packets against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import spatial

SIZE, RATE = 128, 16000.0


def frames_of(spark, rows):
    """rows: (track, frame_idx, left, right)."""
    df = spark.createDataFrame([(k, i, i * 0.1, [float(x) for x in a], [float(x) for x in b]) for k, i, a, b in rows], "track string, frame_idx int, t double, l array<float>, r array<float>")
    return spatial.frame_bank(df.repartition(3), F.col("l"), F.col("r"), SIZE, RATE)


def test_mono_antiphase_silence_and_wide(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 4, SIZE))
    rows = [("mono", i, x[i], x[i]) for i in range(4)] + [("anti", i, x[i], -x[i]) for i in range(4)] + [("silent", i, x[i] * 0, x[i] * 0) for i in range(4)]
    rows += [("wide", i, x[i], y[i]) for i in range(4)] + [("short", 0, x[0][:50], x[0][:50]), ("empty", 0, [], [])]
    got = {(r["track"], r["frame_idx"]): r for r in frames_of(spark, rows).collect()}
    assert len(got) == len(rows)
    for i in range(4):
        mono, anti, silent, wide = (got[k, i] for k in ("mono", "anti", "silent", "wide"))
        assert [mono[c] for c in ("side_ratio", "correlation", "phase", "primary_share", "ambient_share")] == pytest.approx([0, 1, 0, 1, 0], abs=1e-6)
        assert [anti[c] for c in ("side_ratio", "correlation", "phase", "primary_share", "ambient_share")] == pytest.approx([1, 0, 1, 0, 1], abs=1e-6)
        assert [silent[c] for c in ("level", "side_ratio", "correlation", "phase", "mid_ratio", "mid_corr")] == pytest.approx([0, 0, 0.5, 0, 0, 0], abs=1e-6)
        assert mono["mid_corr"] == pytest.approx(1, abs=1e-6) and anti["high_corr"] == pytest.approx(-1, abs=1e-6)
        assert abs(wide["mid_corr"]) < 0.9 and 0.1 < wide["phase"] < 0.9 and 0.2 < wide["side_ratio"] < 0.8
        assert silent["residual_unassigned"] >= 0 and all(0 <= got[k, i][s] <= 1 for k in ("mono", "anti", "silent", "wide") for s in spatial.STREAMS)
    assert got["mono", 0]["focus"] > got["wide", 0]["focus"] > got["anti", 0]["focus"] and got["mono", 0]["diffuse"] < got["wide", 0]["diffuse"] < got["anti", 0]["diffuse"]
    assert got["empty", 0]["level"] == 0 and got["short", 0]["correlation"] == pytest.approx(1)


@pytest.mark.parametrize("stretch", [4096, 3])
def test_bank_against_numpy(spark, monkeypatch, stretch):
    monkeypatch.setattr(spatial, "STRETCH", stretch)
    rng = np.random.default_rng(5)
    left, right = rng.normal(size=(2, 11, 100))
    got = frames_of(spark, [("a", i, left[i], right[i]) for i in range(11)]).orderBy("frame_idx").collect()
    window, at = np.hanning(SIZE), np.fft.rfftfreq(SIZE, 1 / RATE)
    before, flux = None, []
    for i, r in enumerate(got):
        a, b = (np.fft.rfft(np.r_[x[i].astype(np.float32).astype(float), np.zeros(28)] * window) for x in (left, right))
        cross, mono = a * np.conj(b), np.abs(a + b) / 2
        mask = (at >= 1000) & (at < 4000)
        assert r["presence_corr"] == pytest.approx(cross[mask].real.sum() / np.sqrt((np.abs(a[mask]) ** 2).sum() * (np.abs(b[mask]) ** 2).sum()))
        assert r["presence_phase"] == pytest.approx((np.abs(np.angle(cross[mask])) / np.pi * np.abs(cross[mask])).sum() / np.abs(cross[mask]).sum())
        assert r["presence_ratio"] == pytest.approx((mono[mask] ** 2).sum() / (mono**2).sum())
        assert r["correlation"] == pytest.approx((np.corrcoef(left[i], right[i])[0, 1] + 1) / 2, abs=1e-6)
        flux.append(0.0 if before is None else np.sqrt((np.maximum(mono - before, 0) ** 2).mean()))
        before = mono
    assert [r["flux"] for r in got] == pytest.approx(flux)
    spread = (np.array(flux) - min(flux)) / (max(flux) - min(flux))
    assert [r["flux_level"] for r in got] == pytest.approx(spread)
    for r in got:
        parts = [r["n_mid"], r["n_presence"], r["focus"], 0.7 * r["harmonicity"] + 0.3 * r["sustain"], r["primary_share"]]
        assert r["center_mid_lead"] == pytest.approx(np.clip(np.mean(parts), 0, 1))
        rest = [r[c] for c in ("focus", "n_low_impact", "n_low_sustain", "n_mid", "side_ratio", "diffuse", "transient", "sustain")]
        assert r["residual_unassigned"] == pytest.approx((1 - max(rest)) * np.mean(rest))


def test_segments_without_frames_and_packets(spark):
    """Segments between frames take the nearest one, the earlier of two; those behind the end take the last."""
    rng = np.random.default_rng(8)
    bank = frames_of(spark, [("a", i, rng.normal(size=SIZE), rng.normal(size=SIZE)) for i in range(40)])
    rows = bank.orderBy("t").collect()
    spans = [(0, 0.0, 1.0), (1, 1.0, 3.95), (2, 1.01, 1.05), (3, 1.11, 1.17), (4, 9.0, 9.5), (5, 1.12, 1.18)]
    segments = spark.createDataFrame([("a", *x) for x in spans], "track string, segment int, start_s double, end_s double")
    supports = spatial.segment_supports(bank, segments).cache()
    got = {(r["segment"], r["stream"]): (r["mean"], r["highest"]) for r in supports.collect()}
    assert len(got) == len(spans) * 6
    for k, a, b in spans:
        inside = [r for r in rows if a <= r["t"] < b] or [min(rows, key=lambda r: (round(abs(r["t"] - (a + b) / 2), 9), r["t"]))]
        for s in spatial.STREAMS:
            assert got[k, s] == pytest.approx((np.mean([r[s] for r in inside]), max(r[s] for r in inside)))
    packets = {r["stream"]: r for r in spatial.stream_packets(bank, supports).collect()}
    for s, p in packets.items():
        weight = np.maximum([r[s] for r in rows], 0.05)
        assert p["w_focus"] == pytest.approx((np.array([r["focus"] for r in rows]) * weight).sum() / weight.sum())
        assert p["coverage"] == pytest.approx(np.mean([got[k, s][0] >= 0.38 for k, *_ in spans]))
        assert p["strongest"] == ",".join(str(k) for k, *_ in sorted(spans, key=lambda x: (-round(got[x[0], s][0], 9), x[0])))
    assert set(packets) == set(spatial.STREAMS)

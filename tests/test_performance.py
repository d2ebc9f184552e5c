"""The recognition gate, folding and behaviour matches against plain Python, in any order and partitioning."""

from __future__ import annotations

import random

import pytest

from tonewright.operators import evidence as E
from tonewright.operators import performance as P

FAMILIES = list(E.FAMILIES)


def cases(seed):
    rng = random.Random(seed)
    candidates, known = [], []
    for track in range(6):
        names = rng.sample(FAMILIES, rng.choice([1, 5, 17]))
        candidates += [(track, n, i + 1, rng.choice(["weak", "medium", "strong"]), rng.random()) for i, n in enumerate(names)]
        known += [(track, n) for n in rng.sample(FAMILIES, rng.choice([0, 3]))] * 2
    return candidates, known


def brute_gate(candidates, known):
    """{(track, family, folded): (candidate, claim)} and {(track, family): (folded_into, gives)}, by a walk in the candidates' order."""
    cards, shut = {}, {}
    for track in {c[0] for c in candidates}:
        folded = {}
        for _, family, _, claim, _ in sorted((c for c in candidates if c[0] == track), key=lambda c: c[2]):
            if family in P.FALLBACK and (track, family) not in known:
                shut[track, family] = (P.FALLBACK[family], P.FALLBACK[family] not in folded)
                folded.setdefault(P.FALLBACK[family], family)
            else:
                cards[track, family, False] = (family, claim)
        cards |= {(track, into, True): (family, "functional_fallback") for into, family in folded.items()}
    return cards, shut


@pytest.mark.parametrize("seed", range(3))
def test_gate_and_matches(spark, seed):
    candidates, known = cases(seed)
    expected, shut = brute_gate(candidates, set(known))
    rng = random.Random(seed)
    for parts in (1, 7):
        rng.shuffle(candidates)
        df = spark.createDataFrame(candidates, "track int, family string, rank int, claim string, active_mean double").repartition(parts)
        cards = P.gated(df, spark.createDataFrame(known, "track int, family string")).cache()
        got = {(r["track"], r["family"], r["folded"]): (r["candidate"], r["claim"]) for r in cards.collect()}
        assert got == expected
        assert {(r["track"], r["family"]): (r["folded_into"], r["gives"]) for r in P.suppressed(df, cards).collect()} == shut
        assert all(r["status"] == ("allowed_by_external_strong_recognition" if r["family"] in P.FALLBACK else "functional_performance_allowed") for r in cards.collect())
    behaviour = [(t, f, c, E.FAMILIES[f][0], rng.choice(["persistent", "recurrent", "intermittent", "local_fragment"]), rng.choice(["local_burst", "gradual_entry"]), k) for k, (t, f, _, c, _) in enumerate(candidates)]
    near = {"persistent": 3, "recurrent": 2, "intermittent": 2}
    found = P.behaviour_matches(cards, spark.createDataFrame(behaviour, "track int, behaviour string, claim string, family_group string, continuity_kind string, entry string, place int").repartition(3)).cache()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in found.orderBy("rank").collect():
        got.setdefault((r["track"], r["family"], r["folded"]), []).append((r["behaviour"], r["by"]))
    first = {(r["track"], r["family"], r["folded"]): r["behaviour"] for r in P.primary_behaviour(found).collect()}
    told, best = {}, {}
    for (track, family, folded), (candidate, _) in expected.items():
        wanted = {family, candidate} | {f for f, into in P.FALLBACK.items() if into == family}
        mine = sorted((b for b in behaviour if b[0] == track and b[1] in wanted), key=lambda b: (-P.CLAIM[b[2]], -near.get(b[4], 1 if b[5] == "local_burst" else 0), b[6]))[:8]
        if mine:
            told[track, family, folded] = [(b[1], 0 if b[1] == candidate else 1) for b in mine]
            pool = [b for b in mine if b[3] == E.FUNCTIONAL] or mine
            best[track, family, folded] = max(pool, key=lambda b: (P.CLAIM[b[2]], b[4] == "persistent", -mine.index(b)))[1]
    assert got == told and first == best


def test_modes(spark):
    said = {w: False for w in P.WORDS}
    rows = [(f, *(said | dict.fromkeys(words, True)).values()) for f, words in (("voice_like_foreground_line", ["dense", "release"]), ("piano_like_percussive_harmonic_layer", ["falling"]), ("harmonic_bed_layer", []), ("bass_like_low_body_layer", ["bass"]))]
    df = spark.createDataFrame(rows, "family string, " + ", ".join(f"said_{w} boolean" for w in P.WORDS))
    got = {r["family"]: r["m"] for r in df.selectExpr("family", f"{P.modes_sql('said')} AS m").collect()}
    assert got == {
        "voice_like_foreground_line": "dense_pulsed_phrase;floating_release_phrase;reciting_flow",
        "piano_like_percussive_harmonic_layer": "key_struck_chordal_support;vocal_coupled_melody",
        "harmonic_bed_layer": "sustained_harmonic_field;foreground_coupling",
        "bass_like_low_body_layer": "moving_bassline;grounding_low_body",
    }

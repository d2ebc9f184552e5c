"""Nested packets of any depth, precedence by field, lookups in a list's order, and layers that replace themselves."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tonewright.operators import packets
from tonewright.sources import sinks


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([None, 1, "text", True, 2.5])
    if rng.random() < 0.35:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    out = {rng.choice(["a", "b", "a/b", "~", "x.y", ""]): nested(rng, depth - 1) for _ in range(rng.randrange(4))}
    if rng.random() < 0.6:
        out["term"] = rng.choice(["low", "high", "wide", "", 3, None, ["list"], {"term": "inner"}])
    if rng.random() < 0.5:
        out["qualitative_value"] = rng.choice(["dominant", "moderate", "no such word", None, 4])
    return out


def walked(value, path=""):
    """Every object with its JSON pointer."""
    if isinstance(value, dict):
        yield path, value
        for k, v in value.items():
            yield from walked(v, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked(v, f"{path}/{i}")


def test_objects_terms_and_entries(spark):
    rng = random.Random(2)
    values = {i: nested(rng, rng.randrange(9)) for i in range(60)}
    deep = {"term": "deep"}
    for _ in range(40):
        deep = {"in": [deep]}
    values |= {100: deep, 101: {"a/b": {"term": "z"}, "a": {"b": {"term": "z"}}}}
    rows = [(i, i % 3, json.dumps(v)) for i, v in values.items()] + [(200, 0, "broken{"), (201, 0, None), (202, 0, "")]
    df = spark.createDataFrame(rows, "key int, path int, value string").repartition(4)
    found = packets.objects(packets.parsed(df, "value", "v"), "key", "v").cache()
    every = {(i, p): o for i, v in values.items() for p, o in walked(v)}
    assert sorted((r["key"], r["path"]) for r in found.select("key", "path").collect()) == sorted(every)
    assert {(r["key"], r["path"], r["term"]) for r in packets.terms(found).select("key", "path", "term").collect()} == {(*k, o["term"]) for k, o in every.items() if isinstance(o.get("term"), str)}
    counts = {}
    for (i, _), o in every.items():
        if isinstance(o.get("term"), str):
            counts.setdefault(i % 3, {}).setdefault(o["term"], 0)
            counts[i % 3][o["term"]] += 1
    got = {}
    for r in packets.term_counts(found.withColumn("g", F.col("key") % 3), "g", 3).orderBy("rank").collect():
        got.setdefault(r["g"], []).append((r["term"], r["n"]))
    assert got == {g: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3] for g, c in counts.items()}
    weights = {"dominant": 0.85, "moderate": 0.35}
    told = {}
    for (i, _), o in every.items():
        if "qualitative_value" in o:
            told.setdefault(i, []).append(weights.get(o["qualitative_value"], 0.2))
    assert {r["key"]: r["score"] for r in packets.entry_score(found, "key", weights).collect()} == pytest.approx({i: sum(x) / len(x) for i, x in told.items()})


def test_no_packets(spark):
    df = spark.createDataFrame([(1, None)], "id int, j string")
    assert packets.objects(packets.parsed(df, "j"), "id").count() == 0


def test_precedence_by_field(spark):
    keys = spark.createDataFrame([(0, i) for i in range(5)], "track int, segment int")
    high = spark.createDataFrame([(0, 0, "A", None), (0, 1, " ", "note"), (0, 1, None, "note"), (9, 9, "no", "no")], "track int, segment int, focus string, note string")
    middle = spark.createDataFrame([(0, 0, "B"), (0, 1, " b \n"), (0, 2, "c"), (0, 2, "a")], "track int, segment int, focus string")
    low = spark.createDataFrame([(0, s, "macro", "low", "k") for s in range(4)], "track int, segment int, focus string, note string, words string")
    out = packets.preferred(keys, [("high", high), ("middle", middle), ("low", low)], ["track", "segment"], ["focus", "note", "words"])
    got = {r["segment"]: [(r[f], r[f"{f}_from"]) for f in ("focus", "note", "words")] for r in out.collect()}
    assert got == {
        0: [("A", "high"), ("low", "low"), ("k", "low")],
        1: [("b", "middle"), ("note", "high"), ("k", "low")],
        2: [("a", "middle"), ("low", "low"), ("k", "low")],
        3: [("macro", "low"), ("low", "low"), ("k", "low")],
        4: [("", None), ("", None), ("", None)],
    }


def test_spans_by_middle(spark):
    segments = spark.createDataFrame([(0, 0, 0.0, 2.0), (0, 1, 2.0, 4.0), (0, 2, 9.0, 9.5), (1, 0, 0.0, 2.0)], "track int, segment int, start_s double, end_s double")
    spans = spark.createDataFrame([(0, 2, 0.0, 9.0, "late"), (0, 1, 1.0, 3.0, "first"), (0, 3, 9.2, 9.25, "before"), (0, 4, 5.0, 5.0, "none")], "track int, place int, from_s double, to_s double, focus string")
    assert {(r["track"], r["segment"]): r["focus"] for r in packets.by_middle(segments, spans).collect()} == {(0, 0): "first", (0, 1): "late"}


def test_lookups_keep_order_and_repeats(spark):
    lists = spark.createDataFrame([(1, ["b", "no", "a", "b", None]), (2, []), (3, None), (4, ["no"])], "id int, names array<string>").repartition(3)
    index = spark.createDataFrame([("a", "Term A", 1), ("b", "Term B", 2), ("b", "Term C", 0), ("c", None, 3)], "name string, term string, n int")
    df = packets.looked_up(lists, ["id"], "names", index, "name", ["term", "n"]).withColumn("said", packets.phrase(F.col("found"), "term", 2))
    got = {r["id"]: ([tuple(x) for x in r["found"]], r["said"]) for r in df.collect()}
    none = "professional term anchor unavailable"
    assert got == {1: ([("b", "Term B", 2), ("a", "Term A", 1), ("b", "Term B", 2)], "Term B; Term A"), 2: ([], none), 3: ([], none), 4: ([], none)}


def test_layers_replace_themselves(spark, tmp_path):
    import os

    folder = str(tmp_path / "layers")
    one = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    two = spark.createDataFrame([(3, "c")], "k int, v string")
    first = sinks.upsert_layer(one, folder, "x")
    sinks.upsert_layer(two, folder, "y")
    files = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}
    assert sinks.upsert_layer(one.repartition(3).select("v", "k"), folder, "x") == first  # the same rows in another order change nothing
    assert files == {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}
    broken = one.select("k", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert_layer(broken, folder, "x")
    assert sorted(map(tuple, sinks.read_layer(spark, folder, "x").select("k", "v").collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    # a version that was written but never named is not seen
    two.write.parquet(f"{folder}/x/versions/left-over")
    assert sinks.read_layer(spark, folder, "x").count() == 3
    assert sinks.upsert_layer(two, folder, "x") != first and sinks.read_layer(spark, folder, "x").count() == 1
    assert sinks.upsert_layer(one, folder, "x") == first and sinks.read_layer(spark, folder, "x").count() == 3
    assert sinks.read_layers(spark, folder, ["x", "y", "z"]).groupBy("layer").count().orderBy("layer").collect() == [("x", 3), ("y", 1)]
    assert sinks.read_layer(spark, folder, "z") is None

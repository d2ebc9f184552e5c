"""The pipeline's rows, stage by stage, against plain Python."""

from __future__ import annotations

import numpy as np

from tests.llm.test_operators import brute_groups, brute_hits


def test_stages_and_run(spark, small, tmp_path):
    import corpus_pipeline
    from tonewright.llm import toxicity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {"": {r["doc_id"]: r["text"] for r in docs.collect()}}
    before, columns = "", docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns[: len(columns)] == columns
        was, now = kept[before], kept[name]
        assert all(was[d] == t for d, t in now.items())
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
            ids = list(was)
            scores = model.scores([(was[d] or "").encode() for d in ids])
            assert set(now) == {d for d, s in zip(ids, scores, strict=True) if s < 0.3}
        elif name == "exact_dedup":
            last = {}
            for d, t in was.items():
                last[t or ""] = max(d, last.get(t or "", d))
            assert set(now) == set(last.values())
        elif name == "ngram_jaccard_join":
            assert set(now) == {d for d, (_, c) in brute_groups(was, 5, 80).items() if c == d}
        elif name == "decontamination":
            items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
            assert set(now) == {d for d, t in was.items() if brute_hits(t, items)[1] == 0}
        elif name == "bpe":
            assert now == was
            assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(np.frombuffer(r["ids_le"], "<u4")) for r in docs.collect())
        before = name
    assert sorted(map(str, corpus_pipeline.run(spark, small).collect())) == sorted(map(str, docs.collect()))


#: Names that a stage adds or uses inside, all of which may be columns of documents.
CLASHES = "_row _score score n_words n_hit item_ids spans _spans _items _item_ids n_tokens ids_le decoded _thinned_0 _thinned_0_x _thinned_row component_id n_shingles kept keep_id text_sha256 group_size _text _id h H_ n label toxic held_out".split()


def test_odd_rows(spark, tmp_path, monkeypatch):
    """Nulls, empty texts, repeated ids and rows, and extra columns go through all stages with their values; no text that nobody else holds is lost."""
    import corpus_pipeline
    from tonewright.llm import decontaminate

    monkeypatch.setattr(decontaminate.find, "__defaults__", (*decontaminate.find.__defaults__[:-1], 40))  # several blocks of items
    plain = " ".join(f"w{i}" for i in range(30))
    item = " ".join(f"q{i}" for i in range(12))
    other = " ".join(f"v{i}" for i in range(12))
    rows = [(1, "only here"), (1, "same text"), (5, "same text"), (None, "null one"), (None, "null two"), (7, None), (8, ""), (9, plain), (10, plain + " end"), (11, "x " + item), (12, "k " * 20_000), (13, other)]
    rows = [(*r, *[f"{c}{i}" for c in CLASHES]) for i, r in enumerate([*rows, rows[0]])]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", item), ("c", other)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", *CLASHES, "n_tokens_", "ids_le_", "decoded_"]
    got = {(str(r["doc_id"]), r["text"] or ""): r for r in out.collect()}
    expected = [(1, "only here"), (5, "same text"), (None, "null one"), (None, "null two"), (8, ""), (9, plain), (12, "k " * 20_000)]
    assert sorted(got) == sorted((str(d), t) for d, t in expected) and out.count() == len(expected)
    for r in got.values():
        assert tuple(r)[:-3] in rows
        assert r["decoded_"] == (r["text"] or "") and r["n_tokens_"] == len(r["ids_le_"]) // 4
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

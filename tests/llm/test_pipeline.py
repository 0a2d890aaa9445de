"""The pipeline's stages on the smallest tables, each against what it was given."""

import corpus_pipeline as cp
from tessella.llm import quality, textvec
from tessella.session import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, kept = [n for n, _ in cp.STAGES], {}
    for name, stage in cp.STAGES:
        out = cp.materialize(stage(spark, docs, SF), name)
        kept[name] = [r.asDict() for r in out.collect()]
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = out
    rows = [r.asDict() for r in table(spark, SF, "documents").collect()]
    good = {r["doc_id"] for r in kept["quality_rules"]}
    for r in rows:
        s = quality.text_stats((r["text"] or "").encode())
        if quality.base_failed(s[0], s[4]):
            assert r["doc_id"] not in good
    sets = [textvec.shingles((r["text"] or "").encode(), 5) for r in kept["near_dedup"]]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a) + len(b) - len(set(a.tolist()) | set(b.tolist()))
            assert 100 * both < 80 * (len(a) + len(b) - both)
    assert {r["doc_id"] for r in kept["mix_sources"]} <= {r["doc_id"] for r in kept["decontaminate"]}
    assert len(kept["shard"]) == len(kept["mix_sources"])
    assert cp.run(spark, SF).count() == len(kept["shard"])


def test_edge_cases(spark, tmp_path):
    """Nulls in every column, empty, long and repeated rows, clashing columns; and an empty table."""
    good = [r for r in table(spark, SF, "documents").collect() if r["text"] and len(r["text"]) > 500][:30]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1) for r in good]
    rows += [rows[0], (None, good[1]["text"] + " and more", None, None, None, None, None), (10**9, None, "en", "s", 0, "x", 1), (10**9 + 1, "", "en", None, 0, "x", 1), (10**9 + 2, good[2]["text"], None, None, None, "y", None), (10**9 + 3, " ".join(f"{w}{i}" for i, w in enumerate(" ".join(r["text"] for r in good).split() * 3)), "en", "s", 0, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, __key int"
    docs = spark.createDataFrame(rows, schema)
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, SF), name)
        if name == "quality_rules":
            assert not docs.filter("text is null or text = ''").count()
        if name == "near_dedup":
            ids = [r[0] for r in docs.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and not {good[2]["doc_id"], 10**9 + 2} <= set(ids)
    assert docs.columns[:7] == [f.name for f in spark.createDataFrame([], schema).schema] and docs.count()
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0

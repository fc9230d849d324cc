"""The pipeline's stages against plain versions, on a small table."""

import corpus_pipeline
from tallybox.llm import near_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = docs
    model = toxicity.fit(docs, labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == docs.columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (seen, out))
        assert after.items() <= before.items()
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
            assert set(after) == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
        if name == "exact_dedup":
            key = lambda t: "".join(t.split())
            assert len({key(t) for t in before.values()}) == len(after)
        if name == "near_dedup":
            groups = near_dedup.brute_groups(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        if name == "mixing":
            assert out.count() >= len(after)
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen.collect()}
    n = seen.count()
    assert sum(r["piece"] == 0 for r in packed) == n


def test_run_has_the_packing_columns(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

"""The whole pipeline against a plain version of its stages."""

import pytest

import corpus_pipeline
from corpus_guard.llm.toxicity import THRESHOLD, score
from test_dedup import LOWER, WORD, brute_components, corpus


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_against_plain_stages(spark, tmp_path, labelled):
    rows = [(i, t) for i, t in corpus(60) if i is not None and i < 900] + [(2000 + i, f"you idiot number {i} are a moron and " + " ".join(f"z{i}{j}" for j in range(20))) for i in range(40)] + [(901, ""), (902, None), (903, " \n ")]
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i >= 2000)) for i, _ in rows if labelled], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    scores = {r.doc_id: r.score for r in score(docs, labels).collect()}
    kept = [(i, t) for i, t in rows if scores[i] < THRESHOLD]
    assert all(i < 2000 for i, _ in kept) == labelled
    best = {}
    for i, t in kept:
        key = (t or "").translate(LOWER)
        best[key] = max(best.get(key, (i, t)), (i, t), key=lambda x: x[0])
    kept = sorted(best.values(), key=lambda x: x[0])
    sets, roots, _ = brute_components(kept)
    kept = [(i, t) for (i, t), s, root in zip(kept, sets, roots) if not s or i == root]
    want = {i: len(WORD.findall(t or "")) + 1 for i, t in kept}
    got, bins = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        bins.setdefault(r.bin_id, [r.bin_capacity, 0])[1] += r.n_tokens
    assert got == want and all(held <= size for size, held in bins.values())


def test_packing_follows_the_slots_that_mixing_wrote(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 50, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs, None)
    assert mixed.columns == [*docs.columns, "mix_slot"] and mixed.count() == 40
    other = mixed.withColumn("mix_slot", mixed.doc_id * 3)
    assert {r.doc_id: r.mix_slot for r in stages["packing"](spark, other, None).collect()} == {i: i * 3 for i in range(40)}

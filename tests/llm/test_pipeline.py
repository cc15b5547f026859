"""The pipeline's stages, each against brute force on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from scoreloom.llm.jaccard import keep_one_per_component
from scoreloom.llm.toxicity import fit_model, toxicity_scores
from tests.llm.test_pairs import brute_components, shingle_set
from tests.llm.test_rows import unpacked
from tests.llm.test_tables import slow_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        rows = {r.doc_id: r for r in before.collect()}
        if name != "token_packing":
            assert docs.columns == columns
            kept = [r.doc_id for r in docs.collect()]
        if name == "toxicity":
            model = fit_model(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert sorted(kept) == sorted(r.doc_id for r in toxicity_scores(before, model).where("predicted = 0").collect())
        elif name == "ngram_jaccard_join":
            found = brute_components([(i, r.text) for i, r in rows.items()], 5, 4, 5)
            assert sorted(kept) == sorted({root for _, root in found.values()})
        elif name == "benchmark_decontamination":
            items = [shingle_set(r.text.lower(), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            sets = {i: shingle_set(r.text.lower(), 5) for i, r in rows.items()}
            assert sorted(kept) == sorted(i for i, s in sets.items() if not any(5 * len(s & q) >= 4 * len(q) for q in items))
        elif name == "source_mixing":
            size = {i: len((r.text or "").split()) for i, r in rows.items()}
            per = {}
            for i, r in rows.items():
                per[r.source] = per.get(r.source, 0) + size[i]
            for source, target in slow_targets(per).items():
                mine = [i for i in kept if rows[i].source == source]
                assert abs(sum(size[i] for i in mine) - target) <= max(size[i] for i, r in rows.items() if r.source == source)
            assert max(kept.count(i) for i in set(kept)) <= 2
        else:
            found = unpacked(docs.collect(), 2048)
            assert set(found) == set(rows)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_read_what_was_written(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs.inputFiles())
        return docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    assert corpus_pipeline.run(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert "/llm/one-" in seen[1][0] and "/llm/two-" in seen[2][0]


def test_repeated_id_keeps_the_smallest_text_hash(make):
    rows = [(i, f"some words that only text {i} {j} has {i * 7 + j}") for i in range(20) for j in range(4)]
    want = {r.doc_id: r.text for r in make(rows).selectExpr("doc_id", "text", "xxhash64(text) h").groupBy("doc_id").agg(F.min_by("text", "h").alias("text")).collect()}
    kept = keep_one_per_component(make(rows).repartition(3)).select("doc_id", "text").collect()
    assert len(kept) == 20 and {r.doc_id: r.text for r in kept} == want

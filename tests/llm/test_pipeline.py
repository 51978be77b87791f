import corpus_pipeline
from kiln.llm import jaccard, language, packing, quality_rules, secrets


def test_stages_take_effect(spark, documents, labels, awkward, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == names
        kept[name] = docs, after
        docs = after
    before, after = kept["quality rules"]
    ok = quality_rules.score(before, quality_rules.train(before, labels)).where("kept")
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in ok.collect()}
    before, after = kept["language ID"]
    ok = language.predict(before, language.train(before)).where("NOT rejected")
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in ok.collect()}
    before, after = kept["n-gram Jaccard join"]
    assert {r["doc_id"] for r in after.collect()} == {r["component_id"] for r in jaccard.link_components(before).collect()}
    before, after = kept["secret scans"]
    vocab = corpus_pipeline.bpe.vocabulary("byte_bpe_50k.tiktoken")
    assert before.count() == after.count() and secrets.scan(after, vocab).where("spans <> ''").count() == 0
    before, after = kept["best-fit packing"]
    assert after.columns == packing.pack(before, corpus_pipeline.bpe.vocabulary("byte_bpe_50k.json")).columns
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()}
    assert corpus_pipeline.run(spark, sf).count() == after.count()


def test_stages_on_awkward_and_empty_rows(spark, awkward, nothing):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (awkward.select(names), nothing.select(names)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert out.count() >= 0 and (k == 4 or out.columns == names)


def test_registered():
    import __spark_entry__ as entry
    queries = entry.queries()
    assert {n for n in queries if n.startswith("op") and n[2].isdigit()} == {
        "op1_bpe_roundtrip", "op2_secret_scan", "op3_pu_quality", "op4_quality_rules", "op5_token_counts", "op6_document_fingerprints",
        "op7_token_matrix", "op8_jaccard_join", "op9_language_id", "op10_best_fit_packing", "op11_exact_dedup", "op12_conversation_repair",
        "op13_lexical_search"}
    assert queries["pipeline"] is corpus_pipeline.run

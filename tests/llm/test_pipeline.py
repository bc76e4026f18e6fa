import corpus_pipeline as pipeline


def test_stages_keep_what_they_should(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[0][1].upper(), "en", "s0", 1), (101, rows[1][1] + " end", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        docs = pipeline.written(stage(spark, docs, str(tmp_path)), name)
        seen[name] = [r["doc_id"] for r in docs.collect()]
        assert name == "byte_bpe" or docs.columns == columns
    assert len(seen["toxicity"]) == 42
    assert set(seen["exact_dedup"]) == set(range(1, 40)) | {100, 101}  # 100 has the larger id of the two equal texts
    assert len(seen["simhash_near_dedup"]) in (40, 41) and len(set(seen["simhash_near_dedup"])) == len(seen["simhash_near_dedup"])
    assert sorted(seen["byte_bpe"]) == sorted(seen["mixing"])
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen["mixing"])

import corpus_pipeline as pipeline

CLASHING = ["score", "digest", "keep_id", "loc_file", "loc_row", "fingerprint", "fp", "root", "component_id", "size", "copies", "copy", "mix_plan"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LABELS = "doc_id long, quality int, toxic int"
EXTRA = tuple(f"own {c}" for c in CLASHING)


def through(spark, rows, labels, folder):
    """Rows of each stage by its name, every stage but the last with the columns of documents."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        columns = docs.columns
        docs = pipeline.written(stage(spark, docs, str(folder)), name)
        assert name == "byte_bpe" or docs.columns == columns
        seen[name] = docs.collect()
    return seen


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    long = " ".join(f"l{i}" for i in range(30_000))
    texts = [None, "", " \t\n", long, "one two three four five six seven"]
    rows = [(i, t, "en", s, None, *EXTRA) for i, (t, s) in enumerate(zip(texts, ["a", "a", "b", None, "b"], strict=True))]
    rows += [rows[4], rows[4], (None, "no id at all here", None, None, None, *EXTRA), (9, texts[4].upper(), "en", "a", 1, *[None] * len(CLASHING))]
    seen = through(spark, rows, [(i, 1, 0) for i in range(9)] + [(None, 1, 1)], tmp_path)
    assert len(seen["toxicity"]) == len(rows)  # nothing to learn from: no label is toxic
    kept = seen["exact_dedup"]
    # Null and empty texts are one group, and so are the four copies of the last text: the largest doc_id stays.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 2), (False, 3), (False, 9), (True, 0)]
    near = seen["simhash_near_dedup"]
    # Texts without words have fingerprint zero and link: the smaller id of 1 and 2 stays.
    assert {r["doc_id"] for r in near} == {None, 1, 3, 9} and len(near) == 4
    assert all([r[c] for c in CLASHING] == list(EXTRA) for r in near if r["doc_id"] != 9)
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in near}
    assert len(seen["byte_bpe"]) == len(seen["mixing"]) > 0


def test_empty_tables(spark, tmp_path):
    assert through(spark, [], [], tmp_path) == {name: [] for name, _ in pipeline.STAGES}

"""Each stage of the pipeline keeps what it should and the columns of documents."""

import random

import corpus_pipeline


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeiklmnorstu") for _ in range(r.randint(3, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    plain = [(i, words(i, 60), "en", "s", 0) for i in range(60)]
    docs = [(a, b, c, d, len(b)) for a, b, c, d, _ in plain]
    docs += [(100 + i, words(500 + i, 40) + " zonk", "en", "s", 50) for i in range(30)]
    docs += [(200, docs[0][1], "en", "s", 1), (201, docs[1][1] + " extra", "en", "s", 1), (202, "so " + bench + " then", "en", "s", 1), (203, "note token = 0123456789abcdef0123456789 end of it", "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        if k < 4:
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        table = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r["doc_id"] for r in table.select("doc_id").distinct().collect()})
    clean = set(range(60)) | {203, None}
    assert seen[0] == clean | {200, 201, 202}
    assert seen[1] == clean | {202} and seen[2] == clean and seen[3] == clean and seen[4] == clean
    assert "[SECRET]" in spark.read.parquet(f"{tmp_path}/out3").filter("doc_id = 203").first()["text"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(clean)

import re

import corpus_pipeline
from ebbtide.llm import bm25_index, language_tree
from tests.llm.test_dart_minhash import brute as near_classes
from tests.llm.test_mixing import expected_targets


def test_pipeline_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    told = language_tree.op8_language(spark, small).collect()
    left = {r["doc_id"] for r in told if r["lang_pred"] != "und" and r["score"] >= language_tree.LEAST}
    best = {}
    for k in left:
        text = rows[k]["text"]
        normal = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[normal] = min(best.get(normal, (0, 1 << 60)), (-len(text), k))
    left = {k for _, k in best.values()}
    left = {k for k, c, _ in near_classes([(k, rows[k]["text"]) for k in sorted(left)]) if k == c}
    bench = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {k for k in left if not any(b in rows[k]["text"] for b in bench)}
    targets, _ = expected_targets([(k, rows[k]["text"], rows[k]["source"]) for k in left])

    got = corpus_pipeline.run(spark, small)
    assert got.columns == [*docs.columns, "mix_size", "mix_target", "mix_taken"]
    out = got.collect()
    assert {r["doc_id"] for r in out} <= left and len({r["doc_id"] for r in out}) == len(out)
    taken = dict.fromkeys(targets, 0)
    for r in out:
        assert r["text"] == rows[r["doc_id"]]["text"] and r["mix_taken"] in (r["mix_size"], 2 * r["mix_size"])
        assert abs(r["mix_target"] - targets[r["source"]]) < 1e-3
        taken[r["source"]] += r["mix_taken"]
    longest = max(len(rows[k]["text"].split()) for k in left)
    assert all(abs(taken[s] - targets[s]) <= longest for s in targets)


def test_stages_keep_clean_documents_and_columns(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = docs.selectExpr("*", "'v' AS score").limit(60).unionByName(
        spark.createDataFrame([(None, None, None, None, None, None)], schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, small)
        assert out.columns == extra.columns and 0 < out.count() <= 61
        assert stage(spark, extra.limit(0), small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, extra, small).count() > 0
    assert bm25_index.decontaminate(extra, spark.read.parquet(f"{small}/benchmark.parquet")).count() > 0

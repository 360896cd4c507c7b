import corpus_pipeline
from scarpline.llm import packing


def test_stages_keep_columns_and_make_their_decisions(spark):
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, base).collect(), docs.schema)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.7 * kept[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, base).collect()
    encode = packing.encoder().ids
    want = {r["doc_id"]: len(encode(r["text"])) + 1 for r in docs.collect()}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, base).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)

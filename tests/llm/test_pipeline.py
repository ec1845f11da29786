"""Each stage of the pipeline against what its operator says, on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from terracol.llm import line_dedup, mixing, simhash
from terracol.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    from terracol.llm.queries import piece_model

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        results[name] = (docs, written(stage(spark, docs, SF)))
        docs = results[name][1]
    before, after = results["quality_classifier"]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) > 0.97 * sum(labels.values())
    assert after.columns == before.columns and after.count() < before.count()
    before, after = results["line_dedup"]
    assert after.count() == before.count() and after.columns == before.columns
    again = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(before, host="source", ratio=0.05, min_line_pages=5, copies_once=True).collect()}
    assert all(again[r["doc_id"]] == r["text"] and len(r["text"]) == r["n_chars"] for r in after.collect())
    before, after = results["near_dedup"]
    classes = simhash.near_duplicates(before).collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["component_id"] for r in classes})
    before, after = results["source_mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(before).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(copies)
    before, after = results["sentencepiece_codec"]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = Counter((r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest(), len(sp.encode(r["text"]))) for r in before.collect())
    assert Counter((r["doc_id"], hashlib.md5(r["decoded"].encode()).hexdigest(), r["n_tokens"]) for r in after.collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == after.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark):
    """Nulls in every column, blanks, repeats, an empty table and columns of the operators' own names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "some text here", "en", None, 14), (None, "some text here", "en", None, 14), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (5, "other words\nfoot", None, "t", None)]
    clash = [(*r, "k", "s", 1, "f", 2.5, "c") for r in rows]
    for docs in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(clash, SCHEMA + ", key string, size string, target int, fp string, rate double, _text_hash string"), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            found = out.collect()
            assert name == "sentencepiece_codec" or out.columns == docs.columns
            if "key" in out.columns:
                assert {tuple(r)[5:] for r in found} == {("k", "s", 1, "f", 2.5, "c")}
            if not docs.columns or docs.isEmpty():
                assert not found
            if name == "line_dedup":
                assert len(found) == docs.count() and {r["text"] for r in found} == {r["text"] for r in docs.collect()}
            if name == "near_dedup" and found:
                assert sorted((r["doc_id"] or 0) for r in found) == [0, 1, 4, 5]
            if name == "sentencepiece_codec":
                assert Counter(r["decoded"] for r in found) == Counter(r["text"] or "" for r in docs.collect())

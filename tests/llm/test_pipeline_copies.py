"""Groups of copies through line dedup and near-dedup: their text stays once."""

import corpus_pipeline


def test_a_copy_group_keeps_its_text_once(spark):
    copied = "\n".join(f"copied line {i} with words of its own {i * 7}" for i in range(6))
    twice = "\n".join(f"twice line {i} and other words {i * 11}" for i in range(6))
    own = lambda s, i: f"shared footer of {s}\n" + " ".join(f"{s}{i}x{j}" for j in range(30))
    texts = [("a", copied)] * 40 + [("a", own("a", i)) for i in range(60)]  # 40 % of the source are copies
    texts += [("b", twice)] * 2 + [("b", own("b", i)) for i in range(28)]  # two copies are over 5 % of a small source
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (s, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.line_deduplication(spark, docs, "")
    assert lines.count() == len(texts) and not lines.where("text = '' OR text LIKE '%footer%'").count()
    kept = [r["text"] for r in corpus_pipeline.near_dedup(spark, lines, "").collect()]
    assert kept.count(copied) == 1 and kept.count(twice) == 1 and len(kept) == 90

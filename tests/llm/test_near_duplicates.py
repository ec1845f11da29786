"""The near-dedup stage against brute-force Jaccard similarity of five-word shingle sets."""

import random

import corpus_pipeline
from terracol.llm import shingle_sets, simhash


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(texts):
    """The smallest id reachable over pairs of Jaccard similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    low = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] | sets[b])
            if b < a and low[a] != low[b] and (len(sets[a] & sets[b]) >= 0.8 * both):
                x, y = sorted((low[a], low[b]))
                low = {i: x if c == y else c for i, c in low.items()}
    return low


def corpus():
    """Texts, copies with up to 8 words changed, and chains whose ends are less alike than their links."""
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts = [None, "", " \n ", "one two", "One  two", "one"]
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(60, 250))]
        texts.append(" ".join(base))
        for _ in range(7):
            copy = list(base)
            for _ in range(rnd.randint(0, 8)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for _ in range(3):
        chain = [word() for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(chain))
            chain = chain[9:] + [word() for _ in range(9)]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    return {i: texts[k] for i, k in enumerate(order)}


def test_stage_keeps_one_of_each_jaccard_group(spark, monkeypatch):
    texts = corpus()
    want = groups(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(set(want.values())) < len(set(texts.values())) - 40
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == want
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    monkeypatch.setattr(shingle_sets, "CELL_ROWS", 3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_inside_a_cell_match_brute_force():
    import numpy as np

    rnd = random.Random(9)
    for _ in range(30):
        sets = [np.array(sorted(rnd.sample(range(24), rnd.randint(15, 22))), np.int64) for _ in range(25)]
        nodes, group = np.arange(25) + 100, np.array([rnd.randrange(18) for _ in range(25)])
        links = shingle_sets._links(nodes, group, sets, 0.8)
        alike = {(i, j) for i in range(25) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
        assert all((max(a, b) - 100, min(a, b) - 100) in alike for a, b in links)

        def joined(pairs, group=group):
            low = group.copy()
            for a, b in pairs:
                low[low == low[a]] = low[b]
            return [[x == y for y in low] for x in low]

        assert joined([(a - 100, b - 100) for a, b in links]) == joined(alike)


def test_simhash_links_a_pair_that_no_minhash_cell_holds(spark):
    """12 words and two more: 8 of 10 shingles in common, no cell in common, SimHashes 3 bits apart."""
    import numpy as np

    whole = "w35246 w502342 w282874 w328607 w376157 w907851 w976321 w174331 w231022 w39500 w713843 w942395 w649205 w416550"
    part = whole.rsplit(" ", 2)[0]
    sets = [np.unique(shingle_sets.shingle_hashes(t.encode(), 5)) for t in (whole, part)]
    assert [len(x) for x in sets] == [10, 8] and len(np.intersect1d(*sets)) == 8
    assert not set(shingle_sets.set_cells(sets[0])) & set(shingle_sets.set_cells(sets[1]))
    assert (shingle_sets.majority_bits(sets[0]) ^ shingle_sets.majority_bits(sets[1])).bit_count() == 3
    docs = spark.createDataFrame([(1, whole), (2, part), (3, "other words of a third text")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs, simhash.near_duplicates, words=5, jaccard=0.8).collect()) == [1, 3]


def test_only_rows_in_question_are_moved(spark):
    """Of 4,000 texts of which 20 go, some 20 are sent to a join; the others pass beside it."""
    from pyspark.sql import functions as F

    from terracol.llm.common import by_row_bits, row_bits

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    gone = docs.where("doc_id % 200 = 7").select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("text_hash"))
    h = F.xxhash64("doc_id", F.xxhash64(F.col("text").cast("binary")))
    table = row_bits(gone.select(F.xxhash64("doc_id", "text_hash").alias("h")))
    hit, free = (by_row_bits(docs, h, table, how) for how in ("left_semi", "left_anti"))
    assert hit.where("doc_id % 200 = 7").count() == 20 and hit.count() < 600 and hit.count() + free.count() == 4000
    assert simhash._rows_of(docs, gone, "text", "left_anti").where("doc_id % 200 <> 7").count() == 3980
    assert simhash._rows_of(docs, gone, "text").count() == 20
    assert simhash._rows_of(docs, gone.limit(0), "text", "left_anti").count() == 4000

"""The dealt operators against brute force on small tables with nulls, blanks, ties, repeats and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terracol.llm import fingerprints, hidden_markov, line_dedup, mixing, piece_codec, quality, simhash, substring_dedup, token_counts, topk
from terracol.llm.queries import piece_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, ids string, row string, b string"


def rows():
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeé字") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage = say(120), say(60)
    texts = [None, "", "   \n\t ", "one", "two words", base, base, base + " x", say(5000), "a " * 100, "A b a B " * 30, "no\x1cbreak here too", "x" * 3000]
    texts += [say(10) + " " + passage + " " + say(15) for _ in range(6)] + [" ".join(w if i != 7 else "zz" for i, w in enumerate(base.split())) for _ in range(2)] + [say(40) + "\nsame line\n" + say(5) for _ in range(12)]
    out = [(i * 3, t, "en", None if i % 7 == 6 else f"s{i % 3}", len(t or ""), "x", "y", "z", "r", "b") for i, t in enumerate(texts)]
    return [*out, out[5], (None, "orphan " + base, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def by_row(df):
    return Counter(tuple(r) for r in df.collect())


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = Counter((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 4096) for r in rows())
    assert by_row(token_counts.token_count_report(docs, piece_model())) == want
    small = token_counts.count_tokens(docs, piece_model(), batch_bytes=50, long_chars=16)
    assert {(r["text"], r["n_tokens"]) for r in small.collect()} == {(r[1], len(sp.encode(r[1] or ""))) for r in rows()}
    assert token_counts.token_count_report(none, piece_model()).count() == 0


def test_token_counts_of_json_vocabulary(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {(r["text"], r["n_tokens"]) for r in token_counts.count_tokens(docs.fillna({"text": ""}), path).collect()}
    assert got == {(r[1] or "", len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()}


def test_piece_codec(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((r[0], len(i), sha(",".join(map(str, i))), sha(sp.decode(i))) for r in rows() for i in [sp.encode(r[1] or "")])
    assert by_row(piece_codec.piece_report(docs, piece_model())) == want
    assert piece_codec.piece_report(none, piece_model()).count() == 0
    back = piece_codec.decode(piece_codec.encode(docs, piece_model()), piece_model())
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())


@pytest.mark.parametrize("seed", range(3))
def test_piece_codec_odd_texts(seed):
    import sentencepiece

    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=piece_model()), random.Random(seed)
    c = piece_codec.PieceCodec(piece_model(), cache_units=50)
    for _ in range(800):
        t = "".join(rnd.choice(" ▁\nab<>éö字漢😀tha.,0123=-_") for _ in range(rnd.randint(0, 60)))
        assert c.encode(t).tolist() == sp.encode(t)
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(300) for _ in range(rnd.randint(0, 9))]
        assert c.decode(ids) == sp.decode(ids)


def brute_lines(table, ratio, least, once):
    key = lambda h, t: (h, t or "") if once else None
    pages, seen, lines = Counter(), set(), Counter()
    for _, h, t in table:
        if h is None or (once and key(h, t) in seen):
            continue
        seen.add(key(h, t))
        pages[h] += 1
        lines.update({(h, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    out = Counter()
    for i, h, t in table:
        parts = (t or "").split("\n")
        gone = [bool(x.strip(" ")) and h is not None and lines[h, x.strip(" ")] >= least and lines[h, x.strip(" ")] > ratio * pages[h] for x in parts]
        out[i, h, None if t is None else "\n".join(x for x, g in zip(parts, gone, strict=True) if not g), sum(gone) if t is not None else 0] += 1
    return out


@pytest.mark.parametrize("ratio,least,once,small", [(0.3, 2, False, True), (0.3, 1, False, False), (0.1, 3, True, False), (0.0, 2, True, True), (1.0, 1, False, True)])
def test_line_dedup(spark, none, monkeypatch, ratio, least, once, small):
    if not small:
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    rnd = random.Random(6)
    data = [(i, "h1", f"own {i}\nboiler \n\nrare{i % 6}") for i in range(12)] + [(20, "h2", "boiler"), (21, None, "boiler"), (22, "h1", None), (23, "h1", ""), (3, "h1", "own 3\nboiler \n\nrare3")]
    data += [(100 + i, rnd.choice(["h3", "h4", "H4", None]), rnd.choice([None, "", "\n".join(rnd.choice(["l1", "l2 ", " l3", "", "l4\tx", f"u{i}"]) for _ in range(rnd.randint(1, 9)))])) for i in range(60)]
    data += [(900, "h5", "\n".join(["long line"] * 3000 + [f"x{i}" for i in range(3000)])), (901, "h5", "long line")]
    pages = spark.createDataFrame([(*r, 1, "q", "h", "l", "k") for r in data], "page_id long, host string, text string, pages int, line string, _host string, _lines string, _kept string")
    got = line_dedup.drop_boilerplate(pages, ratio=ratio, min_line_pages=least, copies_once=once, dropped="n")
    assert by_row(got.select("page_id", "host", "text", "n")) == brute_lines(data, ratio, least, once)
    plain = line_dedup.drop_boilerplate(pages, ratio=ratio, min_line_pages=least, copies_once=once)
    assert plain.columns == pages.columns and {tuple(r)[3:] for r in plain.collect()} == {(1, "q", "h", "l", "k")}
    assert line_dedup.drop_boilerplate(pages.limit(0)).count() == 0


def test_prefix_hashes():
    rnd = random.Random(1)
    a, b = ("".join(rnd.choice("ab") for _ in range(400)) for _ in range(2))
    ha, hb = fingerprints.PrefixHash.of(a), fingerprints.PrefixHash.of(b)
    for _ in range(300):
        i, j, n = rnd.randrange(380), rnd.randrange(380), rnd.randint(1, 20)
        assert ha.equal(i, hb, j, n) == (a[i : i + n] == b[j : j + n])
        want = next((k for k in range(400) if i + k >= 400 or j + k >= 400 or a[i + k] != b[j + k]), 400)
        assert ha.common_extension(i, hb, j) == want
    tail = ha.with_tail(300, hb.codes[:50])
    assert all((x == y).all() for x, y in zip(tail.prefixes, fingerprints.PrefixHash.of(a[:300] + b[:50]).prefixes, strict=True))


def plain_prints(text):
    """Class minima of the hashes of all 8-character spans, each hash computed from its characters alone."""
    mask = (1 << 64) - 1
    spans = [text[i : i + 8] for i in range(len(text) - 7)] if len(text) >= 8 else [text] if text else []
    least = {}
    for span in spans:
        h = [sum((ord(c) + 1) * pow(b, k, p) for k, c in enumerate(span)) % p for b, p in zip(fingerprints.BASES, fingerprints.MODULI, strict=True)]
        x = (((h[0] << 31) | h[1]) + (len(span) if len(text) < 8 else 0)) * 0x9E3779B97F4A7C15 & mask
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 32
        least[x >> 58] = min(least.get(x >> 58, mask), x & (1 << 58) - 1)
    return [(least[k] >> 16) % 0xFFFF if k in least else 0xFFFF for k in range(64)]


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != (0xFFFF, 0xFFFF)]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprints(docs, none):
    order = sorted(rows(), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    texts = [r[1] or "" for r in order]
    want, as_text = Counter(), lambda f: "".join(f"{x:04x}" for x in f)
    for k, r in enumerate(order):
        t, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain_prints(t), plain_prints(edited), plain_prints(after)
        common = next((i for i, (x, y) in enumerate(zip(t, edited, strict=False)) if x != y), min(len(t), len(edited)))
        want[r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), as_text(a), as_text(b), plain_likeness(a, b), plain_likeness(a, c), common] += 1
    assert by_row(fingerprints.fingerprint_with_next(docs)) == want
    assert fingerprints.fingerprint_with_next(none).count() == 0
    assert fingerprints.fingerprint_with_next(docs.where("doc_id = 24")).first()["near_next"] == 1.0


def plain_simhash(t):
    w = WORD.findall(lower(t or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(s))


def components(nodes, links):
    seen, out = {}, {}
    for n in sorted(nodes):
        if n not in seen:
            todo, seen[n] = [n], n
            while todo:
                for m in links[todo.pop()]:
                    if m not in seen:
                        seen[m] = n
                        todo.append(m)
    return seen | out


def test_simhash(docs, none):
    f = {plain_simhash(r[1]) for r in rows()}
    links = {a: [b for b in f if (a ^ b).bit_count() <= 4] for a in f}
    comp = components(f, links)
    low = defaultdict(list)
    for r in rows():
        if r[0] is not None:
            low[comp[plain_simhash(r[1])]].append(r[0])
    want = Counter((r[0], f"{plain_simhash(r[1]):016x}", min(low[comp[plain_simhash(r[1])]], default=None)) for r in rows())
    assert by_row(simhash.simhash_report(docs)) == want
    assert simhash.simhash_report(none).count() == 0
    first = {}
    for i, t, *_ in rows():
        key = (i is None, i or 0, text_hash(t))
        first[comp[plain_simhash(t)]] = min(first.get(comp[plain_simhash(t)], key), key)
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, text_hash(r["text"])) for r in one.collect()) == sorted(first.values())


def test_keep_one_of_null_and_repeated_ids(spark):
    rnd = random.Random(4)
    a, b, c, d = (" ".join(f"{k}{rnd.randrange(10**6)}" for _ in range(80)) for k in "abcd")
    table = [(1, a, 1), (1, b, 2), (None, a, 3), (None, c, 4), (None, c, 5), (7, d, 6), (7, d, 7), (8, d, 8), (None, d + " x", 9)]
    docs = spark.createDataFrame(table, "doc_id long, text string, _text_hash int").repartition(3)
    for by, how in ((simhash.simhash_duplicates, {}), (simhash.near_duplicates, {"words": 5, "jaccard": 0.8})):
        kept = simhash.keep_one(docs, by, **how)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (0, c), (7, d)])


def test_components_leave_one_table(spark):
    from pathlib import Path

    from terracol.llm.common import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: {p.name for p in folder.glob("terracol-*")}
    before = held()
    nodes = spark.range(40).toDF("node")
    edges = nodes.where("node % 20 < 19").select(F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    found = {r["node"]: r["component"] for r in simhash.connected_components(nodes, edges).collect()}
    assert found == {n: n // 20 * 20 for n in range(40)}
    assert len(held() - before) == 1
    assert len(simhash.connected_components(nodes, edges.limit(0)).where("node = component").collect()) == 40
    assert len(held() - before) == 1


def test_manhattan_bound():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 63, (500, 2), dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, (500, 2), dtype=np.uint64)
    for a, b in x.tolist():
        b = a ^ (1 << (b % 64)) ^ (1 << (b // 64 % 64))
        counts = [[(v >> 2 * i & 1) + (v >> 2 * i + 1 & 1) for i in range(32)] for v in (a, b)]
        want = sum(abs(i - j) for i, j in zip(*counts, strict=True))
        assert want <= (a ^ b).bit_count()
        for bits in (want - 1, want):
            moved, _ = simhash._links(np.array([a, b], np.uint64).view(np.int64), np.zeros(2, np.int64), max(bits, 0))
            assert len(moved) == int((a ^ b).bit_count() <= max(bits, 0))


def test_grid_blocks_follow_the_count():
    assert [simhash.grid_blocks(n) for n in (10, 10**5, 10**7, 10**9)] == sorted(simhash.grid_blocks(n) for n in (10, 10**5, 10**7, 10**9))
    for n in (10**6, 10**8, 10**9):
        b = simhash.grid_blocks(n)
        assert n * 0.375 ** (32 * (b - 4) / b) * len(simhash._masks(b)) < 10**5 * (n / 10**6) ** 0.5


@pytest.mark.parametrize("blocks", [6, 7, 9])
def test_simhash_links_in_large_cells(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "CELL_ROWS", 8)
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(6)]
    f = {b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 7))) for b in base for _ in range(60)}
    signed = {x - (1 << 64) if x >> 63 else x for x in f}
    nodes = spark.createDataFrame([(x,) for x in signed], "node long").selectExpr("node", "node AS fp")
    got = {r["node"]: r["component"] for r in simhash.connected_components(nodes, simhash.link_fingerprints(nodes, blocks=blocks)).collect()}
    links = {a: [b for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= 4] for a in signed}
    assert got == components(signed, links)


def test_mixing(docs, none):
    size = lambda t: len(WORD.findall(t or ""))
    per = Counter()
    for r in rows():
        per[r[3]] += size(r[1])
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, open_, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), {}
    left = sum(per.values())
    while open_:  # share out again until no source is over its cap
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * per[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s] = 3.0 * per[s]
            left -= target[s]
            open_.remove(s)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["source_size"] == per[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["copies"] in (floor(r["rate"]), floor(r["rate"]) + 1) and r["copies"] <= 3
        assert r["source_size"] or r["copies"] == 0
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got)
    assert by_row(mixing.mix_report(docs)) == by_row(mixing.mix_report(docs.repartition(7)))
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_mix_keeps_the_columns_it_was_given(spark, monkeypatch, small):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 100 if small else 0)
    table = [(i, f"s{i % 3}" if i % 4 else None, "w " * (i % 9), f"size{i}", f"_source{i}", i * 10, -i, 0.5, i) for i in range(60)]
    docs = spark.createDataFrame(table, "doc_id long, source string, text string, size string, _source string, target int, copies int, rate double, source_size long")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy"] and by_row(out.drop("copy")) == Counter({t: copies[t[0]] for t in table if copies[t[0]]})


@pytest.mark.parametrize("n,seed", [(50, 1), (50, 2), (3, 3), (1500, 17)])
def test_mixing_hits_targets(spark, n, seed):
    """A source's taken words miss its target by one document's words at most (two, where a bin holds two)."""
    rnd = random.Random(seed)
    many = spark.createDataFrame([(i, f"s{i % 8}", "w " * int(rnd.lognormvariate(3, 1) + 1)) for i in range(8 * n)], "doc_id long, source string, text string")
    plan = mixing.mix_plan(many, seed=seed).selectExpr("source", "target", "size", "size * copies AS taken")
    for r in plan.groupBy("source").agg({"target": "max", "taken": "sum", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"] * (1 if n <= 50 else 2) + 1e-6


def test_mixing_draws_by_the_fraction(spark):
    """Over many seeds a document is drawn once more as often as the rate's fraction says."""
    docs = spark.createDataFrame([(i, f"s{i % 2}", "w " * (5 + 5 * (i % 3))) for i in range(60)], "doc_id long, source string, text string").cache()
    drawn = Counter()
    for seed in range(8):
        for r in mixing.mix_plan(docs, seed=seed).collect():
            drawn[r["source"], "n"] += 1
            drawn[r["source"], "more"] += r["copies"] - int(r["rate"])
            drawn[r["source"], "f"] = r["rate"] - int(r["rate"])
    for s in ("s0", "s1"):
        assert abs(drawn[s, "more"] / drawn[s, "n"] - drawn[s, "f"]) < 0.08


def brute_top(f, queries, k):
    want = Counter()
    for q in queries:
        long = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
        best = sorted((-long(sum(a * b for a, b in zip(f[q], f[c], strict=True))), c) for c in f if c != q and len(f[c]) == len(f[q]))[:k]
        want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(best))
    return want


@pytest.mark.parametrize("block,at_a_time", [(8192, 1 << 16), (7, 3)])
def test_topk(spark, monkeypatch, block, at_a_time):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", block)
    monkeypatch.setattr(topk, "BLOCKS_AT_A_TIME", at_a_time)
    rnd = np.random.default_rng(4)
    v = {i: [float(x) for x in rnd.normal(size=6).round(2)] for i in range(0, 400, 2)}
    v[50], v[2], v[4], v[6], v[8] = v[0], v[10], None, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] + v[12][1:]
    v[14] = [float("inf")] + v[12][1:]
    df = spark.createDataFrame([(k, x, 1) for k, x in v.items()], "vec_id long, embedding array<float>, score int")
    f = {k: [floor(256 * float(np.float32(y))) for y in x] for k, x in v.items() if x and all(y is not None and np.isfinite(y) for y in x)}
    assert by_row(topk.top_k_report(df)) == brute_top(f, [k for k in f if k % 50 == 0], 5)
    assert topk.top_k_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e7, 1e10, 1e17])
def test_topk_of_wide_and_mixed_vectors(spark, monkeypatch, scale):
    """Scores past 2^53, 2^62 and a long; vectors of other lengths, empty ones, all equal ones."""
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 10)
    rnd = np.random.default_rng(7)
    f = {i: [int(x) for x in (rnd.normal(size=(i % 3) * 2) * scale)] for i in range(60)}
    f |= {i: [3, 4] for i in range(60, 75)}
    df = spark.createDataFrame(list(f.items()), "vec_id long, vector array<long>")
    got = topk.exact_top_k(df.where("vec_id % 2 = 0"), df, 4)
    assert by_row(got) == brute_top(f, [i for i in f if i % 2 == 0], 4)


def test_topk_of_repeated_and_null_ids(spark, monkeypatch):
    """A query's own row is one row: others that share its id are candidates, and so are rows without an id."""
    few = spark.createDataFrame([(50, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = by_row(topk.top_k_report(few))
    want = {(50, 1, 50, 2 * 65536): 2, (50, 2, 1, 32768): 1, (50, 2, 1, 65536): 1}
    assert got == Counter(want)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 7)
    rnd = np.random.default_rng(8)
    rows = [(None if i % 5 == 0 else int(i % 60), [float(x) for x in rnd.integers(-3, 4, 3)]) for i in range(150)]
    want = Counter()
    for i, (q, v) in enumerate(rows):
        if q is not None and q % 50 == 0:
            best = sorted((-sum(256 * 256 * int(a) * int(b) for a, b in zip(v, w, strict=True)), c is None, c or 0, c) for j, (c, w) in enumerate(rows) if j != i)[:5]
            want.update((q, n + 1, c, -s) for n, (s, _, _, c) in enumerate(best))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert by_row(topk.top_k_report(df.repartition(3))) == want


def test_topk_skips_blocks_of_far_clusters(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    rnd = np.random.default_rng(9)
    centre = rnd.normal(size=(12, 8))
    centre = (centre / np.linalg.norm(centre, axis=1)[:, None] * 4000).round()
    f = {i: [int(x) for x in centre[i % 12] + rnd.integers(-20, 20, 8)] for i in range(1200)}
    df = spark.createDataFrame(list(f.items()), "vec_id long, vector array<long>")
    searched = []
    plain = topk._blocks_to_search
    monkeypatch.setattr(topk, "_blocks_to_search", lambda q, b: searched.append((q.count() * b.count(), plain(q, b).count())) or plain(q, b))
    got = topk.exact_top_k(df.where("vec_id % 10 = 0"), df, 5)
    assert by_row(got) == brute_top(f, [i for i in f if i % 10 == 0], 5)
    assert searched[0][1] < 0.2 * searched[0][0]


def plain_forward_backward(seqs, m):
    """Log probability, and expected starts, steps and emissions, from unscaled forward and backward tables."""
    size, k = m.emit.shape
    logs, start, steps, emits = [], np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
    for s in seqs:
        n = len(s)
        f, b, scale = np.zeros((n, k)), np.ones((n, k)), np.zeros(n)
        for t in range(n):
            f[t] = (m.start if t == 0 else f[t - 1] @ m.step) * m.emit[s[t]]
            scale[t] = f[t].sum()
            f[t] /= scale[t]
        for t in range(n - 2, -1, -1):
            b[t] = m.step @ (m.emit[s[t + 1]] * b[t + 1]) / scale[t + 1]
        logs.append(np.log(scale).sum())
        start += f[0] * b[0]
        for t in range(n):
            emits[s[t]] += f[t] * b[t]
            if t:
                steps += f[t - 1][:, None] * m.step * (m.emit[s[t]] * b[t])[None] / scale[t]
    return np.array(logs), start, steps, emits


def test_hidden_markov_exact():
    rng, k, size = np.random.default_rng(0), 3, 40
    m = hidden_markov.maximise(rng.random(k), rng.random((k, k)) * 20, rng.random((size, k)) ** 4 * 9, np.full(size, 1 / size))
    seqs = [rng.integers(0, size, n) for n in (1, 5, 64, 65, 300, 1, 129)]
    c = hidden_markov.Chunks(seqs)
    want = plain_forward_backward(seqs, m)
    assert np.allclose(c.log_probabilities(m), want[0])
    assert all(np.allclose(a, b) for a, b in zip(c.counts(m, size), want[1:], strict=True))


def test_hidden_markov_trains_over_partitions(spark, none):
    """Two rounds over partitions equal two rounds of the plain recursion, from the same start."""
    rng, k = np.random.default_rng(3), 3
    index = {f"w{i}".encode(): i for i in range(20)}
    seqs = [rng.integers(0, 20 + hidden_markov.CLASSES, n) for n in (3, 70, 150, 1, 33, 64)]
    flat = np.bincount(np.concatenate(seqs), minlength=20 + hidden_markov.CLASSES)
    vocab = hidden_markov.Vocabulary(index, flat[:20], flat[20:], np.ones(hidden_markov.CLASSES, np.int64), int(flat.sum()), 20)
    m = hidden_markov.first_model(vocab.unigram, k)
    for _ in range(2):
        m = hidden_markov.maximise(*plain_forward_backward(seqs, m)[1:], vocab.unigram)
    coded = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(seqs)], "doc_id long, symbols array<int>").repartition(3)
    got = hidden_markov.train(coded, vocab, k, shares=0, rounds=2)
    assert np.allclose(got.start, m.start) and np.allclose(got.step, m.step) and np.allclose(got.emit, m.emit)
    shared = coded.withColumn("share", F.when(F.size("symbols") > 60, 1).otherwise(3))
    m, kept = hidden_markov.first_model(vocab.unigram, k), None
    for i in (1, 3):  # shares 0 and 2 hold nothing and change nothing
        found = plain_forward_backward([x for x in seqs if (len(x) > 60) == (i == 1)], m)[1:]
        scale = vocab.tokens / found[2].sum()
        kept = [scale * x for x in found] if kept is None else [(i + 2) ** -0.6 * scale * x + (1 - (i + 2) ** -0.6) * y for x, y in zip(found, kept, strict=True)]
        m = hidden_markov.maximise(*kept, vocab.unigram)
    m = hidden_markov.maximise(*plain_forward_backward(seqs, m)[1:], vocab.unigram)
    got = hidden_markov.train(shared, vocab, k, shares=4, rounds=1)
    assert np.allclose(got.emit, m.emit) and np.allclose(got.step, m.step) and np.allclose(got.start, m.start)
    unchanged = hidden_markov.train(shared.limit(0), vocab, k, shares=4, rounds=1)
    assert np.allclose(unchanged.emit, hidden_markov.first_model(vocab.unigram, k).emit)


def test_hidden_markov_batches_of_one_token_texts():
    """A batch is closed by the places of its padded chunks, so texts of one token fill it 64 times as fast."""
    one = [np.zeros(1, np.int32)] * 20_000
    sizes = [len(g) for g in hidden_markov._groups(iter(one))]
    assert sum(sizes) == 20_000 and max(sizes) * hidden_markov.CHUNK <= hidden_markov.BATCH_PLACES + hidden_markov.CHUNK
    assert [len(g) for g in hidden_markov._groups(iter([np.zeros(1 << 20, np.int32)] * 2))] == [1, 1]


def test_hidden_markov_score_is_the_models(spark, monkeypatch):
    """score is the forward probability of a text's symbols times the share of each rare word in its class."""
    kept = {}
    plain = hidden_markov.train
    monkeypatch.setattr(hidden_markov, "train", lambda coded, vocab: kept.update(vocab=vocab, model=plain(coded, vocab)) or kept["model"])
    monkeypatch.setattr(hidden_markov, "SYMBOLS", 12)
    rnd = random.Random(2)
    table = [(i, " ".join(f"W{min(int(rnd.expovariate(0.08)), 60)}" for _ in range(rnd.randint(0, 90)))) for i in range(40)]
    got = {r["doc_id"]: r["score"] for r in hidden_markov.score_documents(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    v, m = kept["vocab"], kept["model"]
    assert abs(m.emit.sum(axis=0) - 1).max() < 1e-9 and len(v.index) <= 12
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in table if not held(i) for w in [*lower(t).split(), ""])
    for i, t in table:
        words = [w.encode() for w in [*lower(t).split(), ""]]
        rare = [w for w in words if w not in v.index]
        s = np.array([v.index[w] if w in v.index else len(v.index) + hidden_markov._class(w) for w in words])
        log = plain_forward_backward([s], m)[0][0] / np.log(10)
        for w in rare:
            k = hidden_markov._class(w)
            inside = [n for x, n in c.items() if x.encode() not in v.index and hidden_markov._class(x.encode()) == k]
            log += log10((c[w.decode()] + 0.5) / (sum(inside) + 0.5 * (len(inside) + 1)))
        assert abs(got[i] - log) < 1e-6


@pytest.mark.parametrize("symbols", [1 << 18, 40])
def test_hidden_markov_scores(docs, none, monkeypatch, symbols):
    monkeypatch.setattr(hidden_markov, "SYMBOLS", symbols)
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
    tokens = [(r[0], [*WORD.findall(lower(r[1] or "")), ""]) for r in rows()]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    got = hidden_markov.score_documents(docs).collect()
    want = Counter((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for i, t in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hidden_markov.score_documents(none).count() == 0


def test_hidden_markov_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = hidden_markov.score_documents(docs).where("NOT held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert r[0] > r[1]


def text_hash(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_repeats(table, window=20):
    """Rows of one id and text are one document; of one id and other texts, documents ordered by the text's hash."""
    seen, out = {}, []
    table = [((i if i is not None else (1 << 63) - 1, text_hash(t)), i, WORD.findall(t or "")) for i, t, *_ in table]
    for key, _, w in table:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = min(seen.get(k, (key, i)), (key, i))
    for key, i, w in table:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] < (key, j):
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bits,remembered", [(1 << 26, 100_000), (64, 0), (64, 5)])
def test_substring_dedup(docs, none, monkeypatch, bits, remembered):
    monkeypatch.setattr(substring_dedup, "FILTER_BITS", bits)
    monkeypatch.setattr(substring_dedup, "REMEMBERED", remembered)
    assert by_row(substring_dedup.repeat_report(docs)) == brute_repeats(rows())
    assert substring_dedup.repeat_report(none).count() == 0


def test_substring_dedup_shared_and_null_ids(spark):
    """Null ids, one id with texts of other lengths, repeated rows, periodic texts, very long words that differ."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage, own, tail = [word() for _ in range(30)], [word() for _ in range(40)], [word() for _ in range(19)]
    thue = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    table = [(1, " ".join(passage)), (2, " ".join(passage)), (2, " ".join(own)), (2, " ".join([word(), *passage, *own[:25]])), (2, " ".join(own))]
    table += [(None, " ".join([*own, word()])), (None, " ".join(passage[:25])), (None, " ".join(passage[:25])), (None, None), (None, "")]
    table += [(7, " ".join([thue, *tail])), (8, " ".join([thue.translate(str.maketrans("ab", "ba")), *tail]))]
    table += [(9, " ".join("abc"[i % 3] for i in range(100))), (10, " ".join("abc"[i % 3] for i in range(1, 60))), (11, "  ".join([thue, *tail]) + "\n")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in table], "doc_id long, text string, th int, later string").repartition(4)
    got = by_row(substring_dedup.repeat_report(docs))
    assert got == brute_repeats(table) and (8, 20, 0, hashlib.sha256(table[11][1].encode()).hexdigest()) in got


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_random(spark, seed):
    """Texts of few words, so that windows repeat at many places and overlap."""
    rnd = random.Random(seed)
    pool = [[rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(rnd.randint(5, 60))] for _ in range(8)]
    table = [(rnd.choice([None, *range(12)]), " ".join(x for _ in range(rnd.randint(0, 4)) for x in rnd.choice(pool))) for _ in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert by_row(substring_dedup.repeat_report(docs)) == brute_repeats(table)


def test_word_hashes_differ():
    words = [b"a" * n for n in range(1, 40)] + [bytes([i]) for i in range(33, 120)] + [b"ab", b"ba", b"x" * (1 << 20) + b"xy", b"x" * (1 << 20) + b"yx"]
    h = substring_dedup._word_hashes(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert len(set(h.tolist())) == len(set(words))


def drawn(table, labels, share):
    """The draw by plain counting: sums of log ratios, Gumbel noise from the row's hash, the k largest keys."""
    from math import log

    kinds = {i: 0 if q != 1 else -1 if t == 1 else 1 for i, q, t in labels if i is not None and q is not None}
    raw, target = Counter(), Counter()
    grams = lambda t: quality.features((t or "").encode()).tolist()
    for i, t in table:
        raw.update(grams(t))
        if kinds.get(i) == 1:
            target.update(grams(t))
    part = sum(target.values()) / sum(raw.values())
    out = []
    for i, t in table:
        own = Counter(grams(t)) if kinds.get(i) == 1 else Counter()
        weight = sum(log(target[g] - own[g] + 8) - log(max((raw[g] - own[g]) * part, 0) + 8) for g in grams(t))
        h = xxhash.xxh64_intdigest((quality.SEED).to_bytes(4, "little"), xxhash.xxh64_intdigest((i or 0).to_bytes(8, "little", signed=True), 42))
        out.append((weight - log(-log(((h >> 11) + 0.5) / 2.0**53)), weight, i))
    if share is None:
        s = sum(v != 0 for v in kinds.values()) / len(kinds)
        share = s + 1.645 * (s * (1 - s) / len(kinds)) ** 0.5
    return sorted(out, key=lambda r: -r[0])[: round(share * len(table))], out


@pytest.mark.parametrize("share", [None, 0.3, 0.85])
def test_quality_draw(spark, share):
    rnd = random.Random(5)
    word = lambda w: rnd.choice(["the", "and", "of", "house", "tree", "river", "is", "was"]) + ("" if rnd.random() < w else "*")
    table = [(i, " ".join(word(0.9 if i < 200 else 0.4) for _ in range(rnd.randint(1, 40)))) for i in range(300)] + [(300, None), (301, "")]
    labels = [(i, int(i < 200), int(i % 9 == 0)) for i in range(0, 300, 3)] + [(None, 1, 0), (5, None, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), share=share).collect()
    want, scored = drawn(table, labels, share)
    assert sorted(r["doc_id"] for r in got) == sorted(i for _, _, i in want)
    weights = {i: (k, w) for k, w, i in scored}
    assert all(np.allclose((r["key"], r["log_weight"]), weights[r["doc_id"]]) for r in got)
    by_weight = sorted(scored, key=lambda r: -r[1])[: len(want)]
    assert share is None or {i for _, _, i in by_weight} != {i for _, _, i in want}  # the noise decides near the last place


def test_quality(spark, none):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "and", "of", "house", "tree", "river", "is", "was"])
    good = [(i, " ".join(word() for _ in range(80))) for i in range(0, 200)]
    bad = [(i, " ".join(word() + "***" for _ in range(80))) for i in range(200, 260)]
    docs = spark.createDataFrame([(*r, f"k{r[0]}", 1.5) for r in [*good, *bad, good[0], (300, None), (301, ""), (None, good[1][1])]], "doc_id long, text string, key string, log_weight double")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 260, 3)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels, share=204 / 264)
    assert kept.columns == docs.columns and set(by_row(kept)) <= set(by_row(docs))  # key and log_weight stay the user's
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 2 and sum(i is not None and 200 <= i < 260 for i in ids) <= 2 and len([i for i in ids if i is not None and i < 200]) >= 197
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_kth_key(spark):
    values = [random.Random(6).choice([1.0, 2.0, random.Random(i).random()]) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 100, 499, 500, 900):
        assert quality.kth_key(df, k, fan=4) == sorted(values, reverse=True)[min(k, 500) - 1]

"""Fill-in-the-middle, the n-gram join and spelling variants against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from terracol.llm import fill_in_middle, fragment_join, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, output string, N long, form string, node long, word string, near string, key long"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def by_row(df):
    return Counter(tuple(r) for r in df.collect())


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", "q", 3) for i, t in texts], SCHEMA).repartition(parts)


# --- fill in the middle -----------------------------------------------------------------------------------------
def odd_texts():
    rnd = random.Random(4)
    mixed = lambda n: "".join(rnd.choice(["ab", "Zé", " ", "字", "\U0001f600", "x1", "\n", "<", "P>", "ß"]) for _ in range(n))
    texts = [None, "", "a", "é", "\U0001f600\U0001f600", "abc", "has <P> in it", "<S>", "ends <M>", "< P>", "a" * 70_000, mixed(30_000), "éé", "\x00 \x00"]
    texts = [(i, t) for i, t in enumerate(texts)] + [(100 + i, mixed(rnd.randint(1, 60))) for i in range(150)]
    return [*texts, texts[9], (None, "no id é字"), (None, None), (-5, "negative id"), (1 << 60, "large id")]


def middle_by_hand(i, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (i, n, form, len(p), len(m), sha(out), sha(text))


def test_fill_in_middle(spark):
    docs = table(spark, odd_texts())
    want = Counter(middle_by_hand(*r) for r in odd_texts())
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert by_row(fill_in_middle.middle_report(docs)) == want
    made = fill_in_middle.fill_in_middle(docs)
    assert made.count() == docs.count() and {"key", "node", "text"} <= set(made.columns)
    back = made.select("text", fill_in_middle.restored().alias("again"), "output", "form")
    assert all(r["again"] == (r["text"] or "") for r in back.collect())
    assert fill_in_middle.middle_report(table(spark, [], 1)).count() == 0
    other = {r["form"] for r in fill_in_middle.fill_in_middle(docs, seed=7, plain_share=0, spm_share=100).where("length(text) >= 70000").collect()}
    assert other == {"spm"}


@pytest.mark.parametrize("text", ["", "plain ascii", "é", "aé字\U0001f600b", "字" * 50 + "a" * 50 + "\U0001f600" * 3])
def test_cuts_convert_both_ways(text):
    import numpy as np

    raw = text.encode()
    index = fill_in_middle.CutIndex(np.frombuffer(raw, np.uint8))
    cuts = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.to_bytes(range(len(text) + 1)).tolist() == cuts
    assert index.to_chars(cuts).tolist() == list(range(len(text) + 1))
    assert len(index.at) == sum(c >= "\x80" for c in text)  # the index holds multibyte characters alone


# --- n-gram Jaccard join ----------------------------------------------------------------------------------------
def grams(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = [grams(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            low[find(i)].append(d)
    return Counter((d, len(s), (min(low[find(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(texts, sets, strict=True)))


def near_texts(seed=1, families=6):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeÉé字") for _ in range(rnd.randint(1, 5))) for _ in range(400)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = say(60)
    texts = [None, "", " \n ", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e f", "A B C D E", "x " * 300, "y z " * 20, " ".join(say(6000))]
    for _ in range(families):
        base = say(rnd.randint(20, 150))
        for k in range(12):
            w = list(base)
            for _ in range(k // 2):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(" ".join(w))
        chain = list(base)  # each near the one before, the ends far apart
        for _ in range(10):
            chain = chain[max(1, len(chain) // 14) :] + say(max(1, len(chain) // 14))
            texts.append("  ".join(chain).upper())
    texts += [" ".join(say(rnd.randint(5, 40)) + passage + say(rnd.randint(0, 12))) for _ in range(25)]
    rows = [(3 * i + 50, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return [*rows, rows[3], (rows[4][0], "another text under one id"), (None, rows[5][1]), (None, "alone without an id here and there"), (None, None), (7, rows[8][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_fragment_join(spark, seed, monkeypatch):
    texts = near_texts(seed)
    got = by_row(fragment_join.jaccard_report(table(spark, texts)))
    assert got == components(texts)
    if seed == 1:  # small batches, lists and stars give the same rows
        for name, value in (("BATCH_GRAMS", 300), ("OFTEN", 1), ("LIST_ROWS", 3), ("STAR_ROWS", 2)):
            monkeypatch.setattr(fragment_join, name, value)
        lists = fragment_join.star_pairs
        assert by_row(fragment_join.jaccard_report(table(spark, texts, 2))) == got
        assert lists is fragment_join.star_pairs
        assert fragment_join.jaccard_report(table(spark, [], 1)).count() == 0
        assert by_row(fragment_join.jaccard_report(table(spark, [(1, None), (1, "")], 1))) == {(1, 0, 1): 2}


def test_fragment_join_needs_cross_pairs(spark):
    """Sets beside which the least of their list links with none, but which link with each other."""
    rnd = random.Random(9)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(8):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(20)]
        texts += [" ".join(common + own + [f"t{rnd.randrange(10**6)}"] * k) for k in (0, 1, 2)]
    texts = list(enumerate(texts, 10))
    assert by_row(fragment_join.jaccard_report(table(spark, texts))) == components(texts)


# --- spelling variants ------------------------------------------------------------------------------------------
def spelled(texts, spoil=199, least=5, ratio=5):
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % spoil == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in beside.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n[w], len(beside[w]), n.get(form.get(w))) for w in n)


def spelling_texts():
    rnd = random.Random(6)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(60)]
    out = []
    for i in range(120):
        said = []
        for _ in range(60):
            w = rnd.choice(stems[: rnd.choice((5, 20, 60))])
            k = rnd.randrange(len(w))
            w = rnd.choice([w, w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("aÉ×") + w[k + 1 :]])
            said.append(w)
        out.append((i, rnd.choice([" ", "-", "1", "\n", "Ā"]).join(said)))
    long = "abcdefgh" * 400
    out.append((1000, "ûlongchain " * 200 + "ûlongchaix " * 35 + "ûlomgchaix " * 6))
    return [*out, out[3], (None, out[4][1]), (None, None), (7, ""), (8, " \t"), (9, (long + " ") * 6 + (long[:-1] + " ") * 30 + "short words only a b c " * 50)]


def test_spelling_variants(spark):
    texts = spelling_texts()
    want = spelled(texts)
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] != x[2] and x[1] for x in want)
    assert by_row(spelling.variant_report(table(spark, texts))) == want
    assert spelling.variant_report(table(spark, [(1, None), (2, "few")], 1)).count() == 0
    few = spelling.variant_forms(spelling.vocabulary(table(spark, texts), spoil=199), part_words=2)  # parts dealt out by place
    assert by_row(few) == want


def test_spoiled_runs_are_judged_as_read():
    runs = spelling.runs_of(b"abcdef abcdef ABCDE \xc3\x89tude x", 5, 1)
    want = Counter()
    for r in ["abcdef", "abcdef", "abcde", "Étude", "x"]:
        h = zlib.crc32(f"5:{r}".encode())
        want[r[: h % len(r)] + r[h % len(r) + 1 :]] += 1
    assert runs == want
    assert spelling.runs_of("Été×ÉTÉ".encode(), 1, None) == {"Été×ÉtÉ": 1}


def test_words_shorter_than_two(spark):
    words = ["a", "b", "ab", "é", "abc"]
    pairs = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"))
    assert {(r["word"], r["near"]) for r in pairs.collect()} == {("a", "b"), ("b", "a"), ("a", "é"), ("é", "a"), ("b", "é"), ("é", "b"), ("a", "ab"), ("ab", "a"), ("b", "ab"), ("ab", "b"), ("ab", "abc"), ("abc", "ab")}

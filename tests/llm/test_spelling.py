import random
import re
import zlib
from collections import Counter, defaultdict

from millrace.llm.spelling import corpus_words, near_pairs, op11_pivotal_variants, pivots, variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows, every=199):
    """By the words of the contract, with near words by deleting one code point from each."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if every and h % every == 0 else low] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    holes = defaultdict(set)
    for w in n:
        holes[w].add(w)
        for k in range(len(w)):
            holes[w[:k] + w[k + 1 :]].add(w)
    beside = {w: set() for w in n}
    for group in holes.values():
        for a in group:
            beside[a] |= {b for b in group if near(a, b)}
    form = {w: min(s, key=lambda b: (-n[b], b)) for w, s in beside.items() if s}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(beside[w]), n.get(form.get(w))) for w in n}


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    assert result(op11_pivotal_variants(spark, "/root/testdata/sf0.001")) == want
    assert sum(r[1] is not None for r in want) > 10


def test_dense_words_of_few_letters(spark):
    """Every word has many near words, repeated bigrams, and pivots that tie."""
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([6, 6, 7, 8, 9]))) for _ in range(1500)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "é" * 40, "é" * 41}
    rows = spark.createDataFrame([(w, rng.randint(5, 900)) for w in sorted(words)], "word string, n long")
    got = {(r.a, r.b) for r in near_pairs(rows).collect()}
    listed = sorted(words)
    assert got == {(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if near(a, b)} and ("aaaaaa", "aaaaaaa") in got


def test_pivots_are_the_rarest_two_that_do_not_overlap():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(6, 12)))
        rank = {a + b: r for r, (a, b) in enumerate(rng.sample([(a, b) for a in "abcd" for b in "abcd"], 16))}
        places, (a, b) = pivots(word, rank)
        cost = {k: rank[word[k : k + 2]] for k in places}
        assert b - a >= 2 and len(places) >= 3
        assert cost[a] + cost[b] == min(cost[i] + cost[j] for i in places for j in places if j - i >= 2)


def test_chains_of_forms(spark):
    chain = [("abcdefg", 5), ("abcdefgh", 25), ("abcdefghi", 125), ("abcdefghij", 625), ("abcdefghijk", 3125), ("abcdefghijkl", 3126 * 5), ("zzzzzz", 7), ("yyyyyyy", 9), ("yyyyyyx", 9), ("yyyyyyw", 45), ("yyyyyyv", 45)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert [got[w][1] for w, _ in chain[:6]] == ["abcdefghijkl"] * 6
    assert got["abcdefghijkl"] == (None, "abcdefghijkl", 1, None) and got["abcdefghijk"][3] == 15630
    assert got["zzzzzz"] == (None, "zzzzzz", 0, None)
    assert got["yyyyyyy"] == ("yyyyyyv", "yyyyyyv", 3, 45)


def test_odd_rows(spark, docs):
    text = "Äpfelchen ÄPFELCHEN Strasse strasse-strasse STRASSE1strasse strassen " * 3
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "Strasse×x 東京strasse𝒳strasse"), (5, "longest" * 3000 + " " + "ordinary " * 20_000), (6, "x" * 5)]
    assert result(variants(corpus_words(docs(rows)))) == brute(rows)
    assert result(variants(corpus_words(docs(rows), every=2))) == brute(rows, 2)
    assert result(variants(corpus_words(docs(rows), every=0))) == brute(rows, 0)
    nothing = variants(corpus_words(docs([])))
    assert nothing.count() == 0 and nothing.columns == ["word", "form", "root", "n", "n_near", "form_n"]

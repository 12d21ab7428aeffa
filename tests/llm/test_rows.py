"""Operators on documents one by one: quality rules, language, packing, BPE, toxicity."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import bpe, language, packing, quality, toxicity
from millrace.llm.arrays import Words, utf8

P = pytest.importorskip("public_tokenizers")
ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "one two"), (5, "one two"), (5, "one two"), (6, "é漢字 \x1c x\x0by"), (7, "x" * 300_000)]


def brute_quality(text):
    words = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(words)
    three = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    cover = set()
    for i in range(n - 2):
        if three[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    longest, size = 0, 1
    while size <= n:
        c = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        if max(c.values()) < 2:
            break
        longest, size = size, size + 1
    long = Counter(tuple(words[i : i + 16]) for i in range(n - 15))
    covered = {k for i in range(n - 15) if long[tuple(words[i : i + 16])] > 1 for k in range(i, i + 16)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    failed = n < 50 or 100 * len(cover) > 50 * n
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(covered), longest, failed, not failed and len(covered) <= 0.3 * n and longest <= 50)


def test_quality_against_brute_force(spark, docs):
    rng = random.Random(4)
    rows = list(ODD)
    for k in range(60):
        vocabulary = [rng.choice("abcdé%") * rng.randint(1, 3) for _ in range(rng.choice([2, 5, 400]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if k % 3 == 0:
            words += words[: rng.randint(0, 60)]
        rows.append((100 + k, "".join(w + rng.choice([" ", "\n", "  ", "\n\n"]) for w in words)))
    got = defaultdict(list)
    for r in quality.quality_report(docs(rows)).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    for doc_id, text in rows:
        assert brute_quality(text) in got[doc_id], doc_id
    assert sum(map(len, got.values())) == len(rows)


def test_quality_filter_keeps_columns(spark, docs):
    clean = " ".join(f"w{i}" for i in range(80))
    table = docs([*ODD, (20, clean), (21, clean + " " + clean), (None, clean)])
    kept = quality.quality_filter(table)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["20", "None"]
    assert quality.quality_report(docs([])).count() == 0 and quality.quality_filter(docs([])).count() == 0


def sample_languages(n=60):
    rng = random.Random(1)
    words = {"aa": ["thing", "other", "weather", "hand"], "bb": ["ungebein", "schaft", "keit", "über"]}
    return [(i, " ".join(rng.choice(words[x]) for _ in range(40)), x) for i in range(n) for x in [("aa", "bb")[i % 2]]]


def brute_kneser_ney(texts, order):
    """p(last character | those before) of an n-gram in every language, by the recursion on plain counts."""
    counts = {}
    for lang in {x for _, x in texts}:
        top = Counter()
        for text, x in texts:
            for word in text.lower().split() if x == lang else []:
                padded = " " * (order - 1) + word + " "
                top.update(padded[k : k + order] for k in range(len(padded) - order + 1))
        counts[lang] = {order: top}
        for k in range(order - 1, 0, -1):
            counts[lang][k] = Counter(g[1:] for g in counts[lang][k + 1])
    alphabet = 1 + len({g for c in counts.values() for g in c[1]})

    def p(lang, gram):
        k = len(gram)
        below = p(lang, gram[1:]) if k > 1 else 1 / alphabet
        table = counts[lang][k]
        n1, n2 = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
        total, types = sum(v for g, v in table.items() if g[:-1] == gram[:-1]), sum(g[:-1] == gram[:-1] for g in table)
        return (max(table[gram] - d, 0) + d * types * below) / total if total else below

    return p, sorted(counts)


def test_kneser_ney_against_brute_force(spark, docs):
    texts = [("the weather there", "aa"), ("other things", "aa"), ("there Éther", "aa"), ("ungebein schaft über", "bb"), ("keit keit", "bb"), ("quixotic", "cc")]
    table = docs([(k, t, x) for k, (t, x) in enumerate(texts)] + [(50, "thunder übel zzz", None), (51, None, "dd")])
    tallied = language.tally(table, order=3, block_bytes=40)
    assert tallied.blocks > 2
    model = language.Model(tallied)
    p, langs = brute_kneser_ney(texts, 3)
    assert model.langs == [*langs, "dd"]
    got = {r["gram"]: r["p"] for r in model.probabilities(tallied.rows.select("gram").distinct()).collect()}
    assert " th" in got and "übe" in got and "zzz" in got
    for gram, values in got.items():
        assert values[:3] == pytest.approx([p(x, gram) for x in langs], rel=1e-9, abs=1e-12), gram
    # all that can follow a context, known or not, shares the whole probability
    chars = sorted({g for t, _ in texts for g in t.lower() if g != " "} | {" "})
    follow = spark.createDataFrame([("th" + c,) for c in [*chars, "~"]], "gram string")
    sums = np.array([r["p"] for r in model.probabilities(follow).collect()]).sum(axis=0)
    assert sums[:3] == pytest.approx([1, 1, 1], rel=1e-9)


def test_language_predicts_and_rejects(spark, docs):
    clean = [*sample_languages(2000), (100_000, "quixotic jumble of quorum " * 3, "cc")]
    odd = [(200_000, None), (200_001, "12 34 %"), (200_002, "ЖЩЪ ЫЭЮ ЯЖЩ ЪЫЭ " * 30), (200_003, "the weather"), (200_003, "the weather"), (None, "hand thing"), (200_004, ""), (200_005, "weather hand " * 20_000)]
    rows = clean + odd
    got = defaultdict(list)
    for r in language.identify(docs(rows), block_bytes=200_000).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["rejected"]))
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0][0] == x for i, _, x in clean)
    assert sum(got[i][0][1] for i, _, _ in clean) <= 0.005 * len(clean)
    assert got[200_000] == got[200_001] == got[200_004] == [("und", True)] and got[200_002][0][1]
    assert [x for x, _ in got[200_003]] == ["aa", "aa"] and got[200_005] == [("aa", False)]
    table = docs(rows)
    kept = language.language_filter(table, block_bytes=200_000)
    assert kept.columns == table.columns
    left = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert not {200_000, 200_001, 200_002, 200_004} & set(left) and left[200_003] in (0, 2) and left[200_005] == 1
    assert language.identify(docs([])).count() == 0 and language.language_filter(docs([])).count() == 0
    unlabelled = docs([(1, "no language"), (2, None)])
    assert language.identify(unlabelled).first()["lang_pred"] == "und" and language.language_filter(unlabelled).count() == 2


def test_noise_is_rejected_and_clean_text_kept(spark, docs):
    rng = random.Random(3)
    vocabulary = {x: ["".join(rng.choice(c) for _ in range(rng.randint(2, 9))) for _ in range(300)] for x, c in (("aa", "etaoinshrdl"), ("bb", "enirsatdhulcgäö"))}
    rows = [(k, " ".join(rng.choice(vocabulary[x]) for _ in range(rng.randint(20, 120))), x) for k in range(3000) for x in [("aa", "bb")[k % 2]]]
    noise = [(10_000 + k, " ".join("".join(rng.choice("zxqjkvw0123456789etaoin") for _ in range(6)) for _ in range(40))) for k in range(200)]
    found = {r["doc_id"]: r["rejected"] for r in language.identify(docs(rows + noise)).collect()}
    assert sum(found[k] for k, *_ in noise) >= 195
    assert sum(found[k] for k, *_ in rows) <= 0.01 * len(rows)


def test_packing_round_trip_and_least_cost(spark, docs):
    from tokenizers import Tokenizer

    vocabulary = packing.op9_vocabulary()
    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.encode_special_tokens = True
    rng = random.Random(3)
    rows = [*ODD[:7], (8, "It's DON'T, we'll é <|endoftext|> KK a.b,c. ½ １２")]
    rows += [(100 + k, " ".join(rng.choice(["Alpha", "beta,", "gamma.", "12", "don't", "ende!"]) for _ in range(rng.randint(1, 900)))) for k in range(40)]
    pieces = packing.pack(docs(rows), vocabulary, block_tokens=20_000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert all(r["doc_tokens"] == len(ids) for r in own)
        assert all(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in own)
        assert sum(r["length"] for r in own) == len(ids) * sum(d == doc_id for d, _ in rows)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(docs([]), vocabulary).count() == 0


def test_best_cuts_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(50):
        place = np.append(0, np.cumsum(rng.integers(1, 6, 12)))
        penalty = rng.integers(0, 4, 13)
        best = [0.0] + [1e9] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + 10 - (place[j] - place[i]) + penalty[j] for i in range(j) if place[j] - place[i] <= 10)
        cuts = packing.best_cuts(place, penalty, 10)
        at = np.searchsorted(place, cuts)
        cost = sum(10 - (place[b] - place[a]) + penalty[b] for a, b in zip(at[:-1], at[1:], strict=True))
        assert cuts[0] == 0 and cuts[-1] == place[-1] and cost == best[-1]


def test_bpe_equals_library_and_comes_back(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [*ODD[:7], (8, "  a  b\n\n c\t d 's é漢字 　x <|endoftext|> 😀"), (9, "a" * 5000 + " x \r\n"), *[(k, f"row {k} of many, {k * 7919}") for k in range(20, 60)]]
    got = defaultdict(list)
    for r in bpe.encode(docs(rows), path, P.PATTERN, block_bytes=300).collect():
        got[r["doc_id"]].append(r)
    for doc_id, text in rows:
        ids = whole.encode_ordinary(text or "")
        assert all(r["n_tokens"] == len(r["ids"]) for r in got[doc_id])
        assert any(r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for r in got[doc_id])
        assert any(r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() for r in got[doc_id])
    assert sum(map(len, got.values())) == len(rows)
    assert bpe.encode(docs([]), path, P.PATTERN).count() == 0


def test_toxicity_gradient():
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["aa", "bb", "idiot", "cc", "dd"]) for _ in range(rng.randint(3, 60))) for _ in range(12)]
    t = toxicity.Tokens(*utf8(pa.array(texts)))
    net = toxicity.Network(2)
    base = {k: v.astype(np.float64) for k, v in net.p.items()}
    which, label = np.arange(len(t.doc)), (t.doc % 2).astype(float)

    def loss():
        z = net.forward(net.inputs(t).astype(np.float64), *t.windows(which))
        return np.mean(np.log1p(np.exp(-z)) * label + np.log1p(np.exp(z)) * (1 - label))

    for name, at in (("Wf", (3, 4)), ("Ub", (2, 5)), ("A", (3, 3)), ("v", (2,)), ("w", (7,)), ("bf", (3,)), ("word", (int(t.row[0]), 2)), ("gram", (int(t.gram[3]), 1))):
        net.p = {k: v.copy() for k, v in base.items()}
        net.seen = {k: np.full(v.shape, 1e12) for k, v in base.items()}
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        down = loss()
        net.p[name][at] += 1e-3
        before = net.p[name][at]
        net.step(t, which, label, 1.0)
        assert abs((up - down) / 2e-3 - (before - net.p[name][at]) * 1e6) < 1e-5, name


def test_toxicity_learns_held_out(spark, docs):
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    for k in range(400):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if k % 3 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["vilewort", "vileding", "vilekram"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 3 == 0)))
    truth = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.train(docs([*rows, *ODD]), truth.where("doc_id < 300"), sample=100)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs(rows), net).collect()}
    right = sum((scored[k] >= 0.3) == bool(y) for k, y in labels[300:])
    assert right >= 95
    odd = toxicity.score(docs(ODD), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(docs([]), net).count() == 0
    assert toxicity.train(docs(rows), truth.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs(rows), None).collect()} == {0.0}


def test_words_match_bytes_split():
    texts = ["a b", "", " x\x0b\x0cy ", "é\x1cz \n", None, "end"]
    w = Words(*utf8(pa.array(texts)))
    data = w.buf.tobytes()
    got = [[data[w.start[k] : w.end[k]] for k in range(w.word_offs[i], w.word_offs[i + 1])] for i in range(len(texts))]
    assert got == [(t or "").encode().split() for t in texts]


def scalar_logit(p, rows, grams):
    """One window by the equations of the network, a number at a time: rows and lists of rows of the inputs of its words."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    x = [np.concatenate([p["word"][r].astype(float), np.mean([p["gram"][g] for g in gs], axis=0)]) for r, gs in zip(rows, grams, strict=True)]
    n, h = len(x), toxicity.HIDDEN
    states = np.zeros((n, 2 * h))
    for k, d in enumerate("fb"):
        before = np.zeros(h)
        for s in range(n) if d == "f" else range(n - 1, -1, -1):
            a, b = x[s] @ p[f"W{d}"] + p[f"b{d}"], before @ p[f"U{d}"]
            z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
            before = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * before
            states[s, k * h : (k + 1) * h] = before
    e = np.array([np.tanh(s @ p["A"]) @ p["v"] for s in states])
    a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return float(a @ states @ p["w"] + p["c"][0])


def test_toxicity_against_brute_force(spark, docs):
    """Every window of every text, word by word; the highest gives the score."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["élan"]
    texts = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 5, 31, 32, 33, 48, 49, 100])]
    net = toxicity.Network(5)
    net.scale, net.shift = 1.5, -0.2
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(texts), net).collect()}
    for k, text in texts:
        t = toxicity.Tokens(*utf8(pa.array([text])))
        words = t.which.tolist()
        grams = {w: t.gram[t.owner == w].tolist() for w in set(words)}
        size = len(words)
        starts = sorted({min(s, max(size - toxicity.WINDOW, 0)) for s in range(0, max(size - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE)})
        best = max(scalar_logit(net.p, t.row[words[s : s + toxicity.WINDOW]], [grams[w] for w in words[s : s + toxicity.WINDOW]]) for s in starts)
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(1.5 * best - 0.2))), abs=1e-5), k
        covered = {w for s in starts for w in range(s, min(s + toxicity.WINDOW, size))}
        assert covered == set(range(size))


def test_quality_holds_little_at_once():
    """A worker's memory is that of its largest run of texts, not of its batch."""
    import random
    import tracemalloc

    r = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    column = pa.array([" ".join(r.choices(words, k=1000)) for _ in range(1500)])
    tracemalloc.start()
    n = sum(j - i for i, j, _ in quality._reports(column, 50, 50, 16, 0.3, 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 and peak < 60e6

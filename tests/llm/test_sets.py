"""Operators on whole tables: near duplicates, substrings, neighbours, shards, chats, the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import chat, components, neardup, neighbours, sharding, substrings

ODD = [(1, None), (2, ""), (3, "  \n\t "), (None, "one two"), (5, "one two"), (5, "one two"), (6, "x" * 100_000)]


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(rng):
    """Texts with exact copies, near copies in chains, and clean ones; and the classes by brute force."""
    texts = [words(rng, 120) for _ in range(12)]
    for k in range(6):
        base = texts[k]
        for _ in range(rng.randint(1, 6)):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[], ["new"], ["new", other[at]]])
            texts.append(other)
            if rng.random() < 0.5:
                base = other
    rng.shuffle(texts)
    return [(10 + k, " ".join(t)) for k, t in enumerate(texts)]


def classes(rows):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").split()
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])
        sets.setdefault(doc_id, set()).update((g, n) for g, c in seen.items() for n in range(c))
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, docs, seed):
    rows = planted(random.Random(seed))
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(rows)).collect()}
    assert got == classes(rows)


def sketched(texts):
    from millrace.llm.arrays import words_of

    import pyarrow as pa

    _, _, w = next(iter(words_of(pa.array(texts))))
    value, cuts = neardup.labelled(w.hash, w.word_offs, 5)
    return neardup.sketches(value, cuts, 1, 1), neardup.signature(value, cuts, 160)


def chain(seed):
    """A hub, light variants of it, a text about 0.85 from the hub, and one about 0.85 from that and 0.7 from the hub."""
    rng = random.Random(seed)
    hub = words(rng, 400)

    def changed(text, places):
        other = list(text)
        for at in places:
            other[at] = f"new{at}"
        return other

    light = [changed(hub, [rng.randrange(400)]) for _ in range(8)]
    middle = changed(hub, range(5, 200, 27))
    far = changed(middle, range(210, 400, 26))
    return [" ".join(t) for t in (hub, *light, middle, far)]


def test_members_of_one_leader_meet_later_leaders(spark, docs):
    for seed in range(500):
        texts = chain(seed)
        bands, least = sketched(texts)
        alike = (least[[0, 0, -2]] == least[[-2, -1, -1]]).mean(axis=1)
        if len(set(bands[:, 0])) == 1 and alike[0] >= 0.73 and alike[1] < 0.7 and alike[2] >= 0.73:
            break
    rows = list(enumerate(texts))
    assert set(classes(rows).values()) == {0}
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(rows), repeats=1, keep=1).collect()}
    assert got == classes(rows)


def test_no_task_holds_a_large_bucket(spark, docs, monkeypatch):
    """Unlike texts with one sketch, and a few copies of some of them."""
    for seed in range(20):
        rng = random.Random(seed)
        passage = words(rng, 60)
        texts = [passage + words(rng, 60) for _ in range(300)]
        texts += [t[:115] for t in texts[:100]]
        rows = list(enumerate(" ".join(t) for t in texts))
        bands = sketched([t for _, t in rows])[0][:, 0].tolist()
        common = Counter(bands).most_common(1)[0][0]
        rows = [r for r, b in zip(rows, bands, strict=True) if b == common]
        if len(rows) > 150:
            break
    groups = neardup._groups

    def small_groups(batches):
        for t in groups(batches):
            assert t.num_rows <= 64, t.num_rows
            yield t

    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "_groups", small_groups)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(rows), repeats=1, keep=1).collect()}
    assert got == classes(rows) and len(set(got.values())) < len(rows)


def families(rng, n):
    """Two families of n texts each, about 0.95 alike inside and 0.76 across: many pairs that look alike, no link between them."""
    one = words(rng, 800)
    two = list(one)
    for k in range(22):
        two[k * 36 + 9] = f"other{k}"

    def member(text):
        other = list(text)
        for at in rng.sample(range(790), 2):
            other[at] = words(rng, 1)[0]
        return " ".join(other)

    return [(k, member(two if k % 2 else one)) for k in range(2 * n)]


def test_unlinked_families_lay_down_few_pairs(spark, docs, monkeypatch):
    rows = families(random.Random(5), 150)
    held = []
    inner = neardup.staged

    def counting(df):
        table = inner(df)
        if table.columns == ["a", "b", "parts", "slot_a", "slot_b"]:
            held.append(table.count())
        return table

    monkeypatch.setattr(neardup, "staged", counting)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(rows)).collect()}
    assert got == {k: k % 2 for k, _ in rows}
    assert 0 < sum(held) < 3_000  # 22,500 pairs lie between the families


@pytest.mark.parametrize("weight", [300, 2_000_000])
def test_classes_joined_in_tiles_of_shingles(spark, docs, monkeypatch, weight):
    """Without the links between the nearest of two classes, those of the tiles join all that belong together."""
    import pyarrow as pa

    def alone(batches):
        for t in neardup._groups(batches):
            ids, bucket, parts = (t.column(c).combine_chunks() for c in ("doc_id", "bucket", "parts"))
            # the second text is tried with the first, since a bucket in which nothing is led counts as compared
            leader = pa.array([ids[0].as_py() if x == 1 else v for x, v in enumerate(ids.to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([bucket, leader, ids, parts], ["bucket", "leader", "doc_id", "parts"])

    def none(batches):
        yield from (b for b in batches if b.num_rows < 0)

    rng = random.Random(weight)
    rows = [(k, t) for k, (_, t) in enumerate(planted(rng) + planted(rng))] + [(1000 + k, t) for k, t in enumerate(chain(3))]
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "WEIGHT", weight)
    monkeypatch.setattr(neardup, "_rest", lambda *_: none)
    monkeypatch.setattr(neardup, "_lead", lambda *_: alone)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(rows)).collect()}
    assert got == classes(rows)


def test_joining_links_span_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 100).astype(np.uint64)
    texts = [np.concatenate([base[: 100 - k], rng.integers(0, 2**63, k).astype(np.uint64)]) for k in (0, 2, 4, 30, 60)] + [np.concatenate([base[50:], base[:50]])]
    ids, part = np.arange(6) + 10, np.array([10, 11, 11, 13, 14, 15])
    links = neardup.joining(ids, np.zeros(6, np.int8), part, texts, 0.8)
    assert [(a, b) for a, b, _ in links] == [(10, 11)]
    assert neardup.joining(ids, np.array([1, 1, 1, 2, 2, 2]), part, texts, 0.8) == []
    assert len(neardup.joining(ids, np.array([1, 2, 2, 2, 2, 2]), part, texts, 0.8)) == 1


def test_near_duplicates_odd_rows(spark, docs):
    rng = random.Random(9)
    base = " ".join(words(rng, 60))
    rows = [*ODD, (8, base), (9, base.replace(" ", "  ")), (9, base), (4, "one two")]
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in neardup.near_duplicates(docs(rows)).collect())
    assert got == sorted([("1", "1"), ("2", "2"), ("3", "3"), ("None", "None"), ("5", "4"), ("5", "4"), ("6", "6"), ("8", "8"), ("9", "8"), ("9", "8"), ("4", "4")])
    table = docs(rows)
    kept = neardup.keep_one(table)
    assert kept.columns == table.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "None"]
    assert neardup.near_duplicates(docs([])).count() == 0


def test_alignment_keeps_order():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 200, dtype=np.uint64)
    assert neardup.aligned_similarity(a, a, 0.8) == 1.0
    assert neardup.aligned_similarity(a, np.concatenate([a[100:], a[:100]]), 0.8) < 0.8
    assert abs(neardup.aligned_similarity(a, a[:180], 0.8) - 0.9) < 1e-9


def brute_cut(rows, size):
    first = {}
    split = [(d, (t or "").split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = {k for i in range(len(w) - size + 1) if d is not None and first[tuple(w[i : i + size])] < d for k in range(i, i + size)}
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("size", [6, 9])
def test_substrings_against_brute_force(spark, docs, size):
    rng = random.Random(size)
    shared = [words(rng, rng.randint(size - 1, 40)) for _ in range(6)]
    rows = list(ODD)
    for k in range(40):
        body = words(rng, rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(shared)
        rows.append((20 + rng.randint(0, 35), " ".join(body)))
    rows += [(70, " ".join(shared[0] + shared[1])), (71, " ".join(shared[0] + shared[1]))]
    table = docs(rows)
    got = substrings.substring_dedup(table, size).collect()
    want = brute_cut(rows, size)
    import hashlib

    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((str(d), n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in want)
    assert all((r["longest_level"] or 0) >= size for r in got if r["n_removed"] and r["n_removed"] < r["n_words"])
    cut = substrings.without_repeats(table, size)
    assert cut.columns == table.columns
    left = Counter((str(d), k) for d, _, g, k in want if g and k)
    assert sum(left.values()) + sum(1 for _, _, g, _ in want if not g) == cut.count()
    assert substrings.substring_dedup(docs([]), size).count() == 0


def test_longest_level_doubles(spark, docs):
    rng = random.Random(3)
    common = words(rng, 90)
    rows = [(1, " ".join(words(rng, 5) + common)), (2, " ".join(common + words(rng, 5))), (3, " ".join(words(rng, 50)))]
    got = {r["doc_id"]: r["longest_level"] for r in substrings.substring_dedup(docs(rows), 10).collect()}
    assert got == {1: 80, 2: 80, 3: None}


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = neighbours.hilbert_keys(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_best_gives_ties_to_smaller_ids():
    rep = np.random.default_rng(3).permutation(500)
    score = np.zeros((2, 500))
    score[0, 7], score[1, :] = 1.0, np.arange(500) % 2
    row, col = neighbours._best(score, 5, rep)
    assert set(rep[col[row == 0]]) == {rep[7], *np.sort(np.delete(rep, 7))[:4]}
    assert set(rep[col[row == 1]]) == set(np.sort(rep[1::2])[:5])


def test_nearest_is_exact_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((300, 8)).round(2)
    m[40:90] = m[40]
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(m)]
    odd = [(1000, None), (1005, [0.0] * 8), (1010, [1.0, None] + [0.0] * 6), (1015, [float("nan")] + [1.0] * 7), (1020, [float("inf")] + [1.0] * 7), (1025, [1.0, 2.0]), (None, [1.0] * 8), (1030, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + odd + [rows[5]]], "vec_id long, embedding array<double>, rep string")
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 5 == 0, k=10, window=16, block=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    points = {**dict(enumerate(m)), 1025: np.array([1.0, 2.0] + [0.0] * 6)}  # a shorter vector ends in zeros
    for q in [*range(0, 300, 5), 1025]:
        scores = [(sum(a * b for a, b in zip(points[q], v, strict=True)), i) for i, v in points.items() if i != q]
        want[q] = sorted(((round(-s, 9), i) for s, i in scores))[:10]
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i, _ in got[q]] == [i for _, i in want[q]] and [n for n, _, _ in got[q]] == list(range(1, 11))
    near = neighbours.nearest(table, F.col("vec_id") % 5 == 0, k=10, window=16, exact=False).collect()
    found = sum((r["vec_id"] in {i for _, i in want[r["query_id"]]}) for r in near)
    assert found >= 0.6 * sum(map(len, want.values()))  # windows alone, on vectors without clusters
    few = neighbours.nearest(table.where("vec_id < 4"), F.col("vec_id") == 0, k=10)
    assert few.count() == 3
    assert neighbours.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_shards_follow_the_mixture(spark, docs):
    rng = random.Random(8)
    rows = [(k % 700, f"text {k % 50}", "en", rng.choice(["a", "a", "a", "b", None])) for k in range(1003)] + [(None, None, None, "c")]
    got = sharding.interleaved_shards(docs(rows), 7).collect()
    slots = defaultdict(list)
    mixture = Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        mixture[r["source"], r["shard"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len(got) == 1004 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for source in ("a", "b", None):
        per = [mixture[source, k] for k in range(7)]
        assert max(per) - min(per) <= 2
    again = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleaved_shards(docs(rows), 7).collect()}
    assert again == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got}
    assert sharding.interleaved_shards(docs([]), 7).count() == 0
    assert {r["shard"] for r in sharding.interleaved_shards(docs([(1, "a"), (2, "b")]), 16).collect()} <= set(range(16))


def test_shards_against_brute_force(spark, docs):
    rng = random.Random(9)
    rows = [(rng.choice([k, k % 40, None]), rng.choice([None, "", f"text {k % 90}", "é" * (k % 30)]), None, rng.choice(["a"] * 6 + ["b", None, f"page {k}"])) for k in range(900)]
    table = docs(rows)
    facts = table.selectExpr("doc_id", "coalesce(concat('=', source), '') as stratum", "cast(octet_length(coalesce(text, '')) + 1 as long) as size", "crc32(cast(coalesce(text, '') as binary)) as crc")
    facts = facts.selectExpr("*", f"pmod(xxhash64(17, doc_id, crc), {sharding.UNIT}L) as u", f"pmod(xxhash64(17, stratum), {sharding.UNIT}L) / {sharding.UNIT}L as offset").collect()
    null_first = lambda x: (x is not None, x or 0)
    sources = defaultdict(list)
    for r in facts:
        sources[r["stratum"]].append(r)
    order = []
    for of in sources.values():
        of.sort(key=lambda r: (r["u"], null_first(r["doc_id"]), r["crc"], r["size"]))
        order += [((k + r["offset"]) / len(of), r["stratum"], r["u"], null_first(r["doc_id"]), r["crc"], r["size"], r) for k, r in enumerate(of)]
    order.sort(key=lambda x: x[:6])
    cuts = [-(-s * len(order) // 7) for s in range(8)]
    want = Counter((order[k][-1]["doc_id"], order[k][-1]["size"], order[k][-1]["crc"], s, k - cuts[s]) for s in range(7) for k in range(cuts[s], cuts[s + 1]))
    assert want == Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleaved_shards(table, 7).collect())


PIECES = ["\\", "<", "|", "s>", "/s>", "[", "INST]", "/INST]", "n", "\n", "a", "<|end|>", "<|turn|>", "l", "b"]


def test_chat_escapes_come_back():
    rng = random.Random(1)
    for _ in range(5000):
        turns = [("".join(rng.choices(PIECES, k=rng.randint(0, 5))), "".join(rng.choices(PIECES, k=rng.randint(0, 8)))) for _ in range(3)]
        text, spans = chat.format_turns(turns, frozenset([turns[1][0]]))
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[s["start"] : s["stop"]]) for s in spans] == [t for r, t in turns if r == turns[1][0] and t]
        assert text.count("<|turn|>") == 3 and "[INST]" not in text


def test_reply_trees_rank_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 0.9), (1, 3, 1, "assistant", "bad", 0.1), (1, 4, 3, "user", "more", 0.2), (1, 4, 3, "user", "more", 0.2)]
    rows += [(2, 1, 9, None, None, None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 5, 2, "user", "tail", 1.0), (None, 1, None, "user", "x", 0.0)]
    rows += [(4, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", f"t{k}", 0.0) for k in range(40)]
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["branch"]): (r["leaf_id"], chat.parse_turns(r["formatted"])) for r in chat.format_trees(nodes, branches=2).collect()}
    assert got[1, 1] == (2, [("user", "q"), ("assistant", "good")])
    assert got[1, 2] == (4, [("user", "q"), ("assistant", "bad"), ("user", "more")])
    assert got[2, 1] == (1, [("", "")]) and got[4, 1][0] == 39 and [t for _, t in got[4, 1][1]] == [f"t{k}" for k in range(40)]
    assert set(got) == {(1, 1), (1, 2), (2, 1), (4, 1)}
    assert chat.format_trees(nodes.limit(0)).count() == 0


def test_chat_plans_do_not_grow_with_depth(spark, monkeypatch):
    joins = []

    def counted(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return df

    staged, add = chat.staged, chat.Rounds.add
    monkeypatch.setattr(chat, "staged", lambda df: staged(counted(df)))
    monkeypatch.setattr(chat.Rounds, "add", lambda self, df: add(self, counted(df)))
    most = []
    for depth in (8, 64, 512):
        joins.clear()
        nodes = spark.range(depth).selectExpr("1L as tree_id", "id as node_id", "if(id > 0, id - 1, null) as parent_id", "'user' as role", "cast(id as string) as text", "0D as score")
        made = counted(chat.format_trees(nodes)).collect()
        assert len(made) == 1 and [t for _, t in chat.parse_turns(made[0]["formatted"])] == [str(k) for k in range(depth)]
        most.append((max(joins), joins[-1]))
    assert most[0] == most[1] == most[2] and most[0][0] <= 3


def brute_branches(rows, branches):
    """Chosen branches of trees by walking up from every leaf."""
    nodes = {(t, n): (p, s or 0.0) for t, n, p, s in rows}
    parents = {(t, p) for (t, _), (p, _) in nodes.items() if (t, p) in nodes}
    found = defaultdict(list)
    for t, n in nodes:
        if (t, n) in parents:
            continue
        path, at = [], n
        while (t, at) in nodes and at not in path:
            path.append(at)
            at = nodes[t, at][0]
        if (t, at) not in nodes:
            found[t].append((-sum(nodes[t, x][1] for x in path) / len(path), n, path[::-1]))
    return {(t, k + 1): (leaf, path) for t, v in found.items() for k, (_, leaf, path) in enumerate(sorted(v)[:branches])}


def test_reply_trees_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(t, n, rng.choice([None, *range(max(0, n - 6), n)]) if n else None, rng.randint(0, 16) / 16) for t in range(12) for n in range(60)]
    rows += [(50, n, 0 if n else None, rng.randint(0, 4) / 4) for n in range(500)]  # many answers to one row
    rows += [(51, n, n + 1 if n < 9 else 4, 0.5) for n in range(10)]  # a tail into a loop
    nodes = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, score double").selectExpr("*", "'user' as role", "cast(node_id as string) as text")
    got = {(r["tree_id"], r["branch"]): (r["leaf_id"], [int(t) for _, t in chat.parse_turns(r["formatted"])]) for r in chat.format_trees(nodes, branches=3).collect()}
    assert got == brute_branches(rows, 3)


def test_conversations_with_odd_rows(spark):
    """Null ids and turns, empty and very long texts, ties, repeated rows, and columns named like those inside."""
    rows = [(1, 2, "user", "b"), (1, None, "user", "first"), (1, 2, "user", "b"), (1, 1, None, None), (None, 1, "user", "lost"), (2, 1, "assistant", ""), (3, 1, "assistant", "word " * 60_000), (4, 1, "user", "z"), (4, 1, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "9L as tree_id", "9L as node_id", "9L as parent_id", "'x' as score", "1 as branch", "1 as up", "true as root")
    made = {r["tree_id"]: (chat.parse_turns(r["formatted"]), r["formatted"], r["loss"]) for r in chat.format_trees(chat.linear_trees(table)).collect()}
    assert {k: v[0] for k, v in made.items()} == {1: [("user", "first"), ("", ""), ("user", "b"), ("user", "b")], 2: [("assistant", "")], 3: [("assistant", "word " * 60_000)], 4: [("assistant", "y"), ("user", "z")]}
    assert [made[3][1][s["start"] : s["stop"]] for s in made[3][2]] == ["word " * 60_000] and made[2][2] == []
    assert chat.read_back(chat.format_trees(chat.linear_trees(table.limit(0)))).count() == 0


def test_pipeline_keeps_clean_documents(spark, docs, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    vocabulary = words(rng, 400)
    clean = [(k, " ".join(rng.choice(vocabulary) for _ in range(120)) + ".", "en", "s") for k in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    rows = [*clean, (100, clean[3][1], "en", "s"), (101, clean[4][1] + " extra", "en", "s"), (102, "again and " * 80, "en", "s"), (103, "few words", "en", "s"), (104, None, None, None)]
    rows += [(110, clean[5][1][:200] + " " + passage + " " + " ".join(rng.choice(vocabulary) for _ in range(70)), "en", "s"), (111, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(90)), "en", "s")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = {r["doc_id"] for r in table.select("doc_id").collect()}
    whole = set(range(40)) | {100, 101, 110, 111}
    assert ids["quality"] == whole == ids["language"]
    assert ids["near_duplicates"] == whole - {100, 101} == ids["substrings"]
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert passage in texts[110] and passage not in texts[111] and all(texts[k] == clean[k][1] for k in range(40))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids["substrings"]


def test_pipeline_takes_odd_tables(spark, docs, tmp_path):
    """An empty table, and one without languages with null and repeated ids, ties, empty texts and clashing columns."""
    import corpus_pipeline

    rng = random.Random(11)
    text = " ".join(f"{rng.choice(words(rng, 1))}{k}" for k in range(90))
    other = " ".join(f"{rng.choice(words(rng, 1))}x{k}" for k in range(4000))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, other), (3, other), (4, None), (5, ""), (6, " ")]
    for name, table in (("empty", docs([])), ("odd", docs(rows))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        packed = corpus_pipeline.run(spark, folder).collect()
        if name == "empty":
            assert packed == []
            continue
        ids = [r["doc_id"] for r in packed]
        assert set(ids) == {1, 3, None} and all(r["length"] > 0 for r in packed)


def test_substrings_of_long_texts(spark, docs):
    """Thousands of words, and a passage that repeats far inside both, against the windows of the texts."""
    rng = random.Random(13)
    passage = words(rng, 120)
    one, two = words(rng, 9000), words(rng, 7000)
    one[4000:4000], two[6500:6500] = passage, passage
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(two))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substrings.substring_dedup(docs(rows), max_level=50).collect()}
    assert got == {1: (9120, 0), 2: (7120, 120), 3: (7120, 7120)}


@pytest.mark.parametrize(("size", "base", "levels"), [(9, 3, [3, 5, 9]), (7, 2, [2, 4, 7]), (50, 25, [25, 50])])
def test_substrings_climb_to_their_size(spark, docs, monkeypatch, size, base, levels):
    """The windows that are removed come from joins of shorter ones, level by level, and equal those of brute force."""
    import hashlib

    steps, join = [], substrings._widened
    monkeypatch.setattr(substrings, "_widened", lambda rows, a, b: steps.append((a, b)) or join(rows, a, b))
    rng = random.Random(size)
    shared = [words(rng, n) for n in (size - 1, size, size + 1, 2 * size + 3)]
    rows = [(k, " ".join(words(rng, 4) + shared[k % 4] + words(rng, 3) + shared[(k + 1 + k // 4) % 4] * (1 + k % 2))) for k in range(16)]
    rows += [(99, rows[3][1]), (5, " ".join(shared[3])), (None, rows[0][1]), (98, None)]
    got = substrings.substring_dedup(docs(rows), size, max_level=size, keep_text=False, base=base).collect()
    want = [(str(d), n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute_cut(rows, size)]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    assert steps == list(zip(levels[:-1], levels[1:])) and substrings.ladder(size, base) == levels

"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrays import Words, chunks, mix, prefix, ranges, utf8
from millrace.llm.language import remainder
from millrace.llm.staging import bounded_batches

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, WIDTH, HIDDEN, ATTEND = 1 << 15, 1 << 14, 8, 8, 8
SCORED = "doc_id long, score double"

# punctuation parts words here
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


class Tokens:
    """Distinct words of a run of texts with the rows of their word and character inputs, and all windows."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        w = Words(PLAIN[buf], offs)
        kinds, first, self.which = np.unique(w.hash, return_index=True, return_inverse=True)
        self.row = (kinds % np.uint64(WORD_ROWS)).astype(np.int64)
        data, at = w.texts(first)
        size = np.diff(at) + 2
        cut = np.append(0, np.cumsum(size))
        padded = np.full(cut[-1], 0x20, np.uint8)
        padded[np.arange(len(data)) + np.repeat(cut[:-1] - at[:-1] + 1, np.diff(at))] = data
        p = prefix(mix(padded.astype(np.uint64)))
        grams, owner = [], []
        for k in (3, 5):
            n = np.maximum(size - k + 1, 0)
            which = np.repeat(np.arange(len(first)), n)
            start = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + cut[:-1][which]
            grams.append((ranges(p, start, start + k) % np.uint64(GRAM_ROWS)).astype(np.int64))
            owner.append(which)
        order = np.argsort(np.concatenate(owner), kind="stable")
        self.gram, self.owner = np.concatenate(grams)[order], np.concatenate(owner)[order]
        self.n_grams = np.maximum(np.bincount(self.owner, minlength=len(first)), 1)
        n_words = np.diff(w.word_offs)
        count = np.where(n_words > 0, np.maximum(-(-(n_words - WINDOW) // STRIDE), 0) + 1, 0)
        self.doc = np.repeat(np.arange(len(n_words)), count)
        nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(nth * STRIDE, np.maximum(n_words[self.doc] - WINDOW, 0))
        self.start, self.length = start + w.word_offs[self.doc], np.minimum(n_words[self.doc], WINDOW)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (steps, windows), one past the last where a short text ends, and which are words."""
        step = np.arange(WINDOW)[:, None]
        inside = step < self.length[which]
        at = np.minimum(self.start[which] + step, max(len(self.which) - 1, 0))
        return np.where(inside, self.which[at], len(self.row)), inside


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Embeddings of hashed words and the mean of hashed character n-grams, a GRU in either direction, attention."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *size, scale: (rng.standard_normal(size) * scale).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, WIDTH, scale=0.1), "gram": draw(GRAM_ROWS, WIDTH, scale=0.3)}
        for d in "fb":
            self.p |= {f"W{d}": draw(2 * WIDTH, 3 * HIDDEN, scale=0.3), f"U{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, ATTEND, scale=0.3), "v": draw(ATTEND, scale=0.5), "w": draw(2 * HIDDEN, scale=0.5), "c": np.zeros(1, np.float32)}
        self.seen = {k: np.full(x.shape, 1e-9 if k in ("word", "gram") else 1e-5, np.float32) for k, x in self.p.items()}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, t: Tokens) -> np.ndarray:
        """One row a distinct word, and a row of zeros for places past the end."""
        x = np.zeros((len(t.row) + 1, 2 * WIDTH), np.float32)
        if len(t.row):
            x[:-1, :WIDTH] = self.p["word"][t.row]
            has = np.bincount(t.owner, minlength=len(t.row)) > 0
            first = np.searchsorted(t.owner, np.flatnonzero(has))
            x[:-1, WIDTH:][has] = np.add.reduceat(self.p["gram"][t.gram], first, axis=0) / t.n_grams[has, None] if len(t.gram) else 0
        return x

    def _run(self, gates: np.ndarray, words: np.ndarray, d: str, keep: bool):
        """Hidden states (steps, windows, HIDDEN) in text order; what the backward pass needs, if kept."""
        u, n = self.p[f"U{d}"], words.shape[1]
        h, out, saved = np.zeros((n, HIDDEN), np.float32), np.empty((WINDOW, n, HIDDEN), np.float32), []
        for s in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, y = gates[words[s]], h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + y[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * y[:, 2 * HIDDEN :])
            if keep:
                saved.append((s, h, z, r, y[:, 2 * HIDDEN :], new))
            h = new + z * (h - new)
            out[s] = h
        return out, saved

    def forward(self, x: np.ndarray, words: np.ndarray, inside: np.ndarray, keep: bool = False):
        states, saved = [], {}
        for d in "fb":
            out, saved[d] = self._run(x @ self.p[f"W{d}"] + self.p[f"b{d}"], words, d, keep)
            states.append(out)
        h = np.concatenate(states, axis=2)
        act = np.tanh(h @ self.p["A"])
        e = np.where(inside, act @ self.p["v"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        logit = pooled @ self.p["w"] + self.p["c"]
        return (logit, (h, act, a, pooled, saved)) if keep else logit

    def step(self, t: Tokens, which: np.ndarray, label: np.ndarray, rate: float) -> None:
        """One step of adaptive gradient descent on the logistic loss of the chosen windows."""
        x = self.inputs(t)
        words, inside = t.windows(which)
        logit, (h, act, a, pooled, saved) = self.forward(x, words, inside, keep=True)
        g = {}
        d_logit = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
        g["w"], g["c"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * self.p["w"]
        d_a = (h * d_pooled).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        d_act = d_e[:, :, None] * self.p["v"] * (1 - act * act)
        g["v"] = (act * d_e[:, :, None]).sum(axis=(0, 1))
        g["A"] = h.reshape(-1, 2 * HIDDEN).T @ d_act.reshape(-1, ATTEND)
        d_h = a[:, :, None] * d_pooled + d_act @ self.p["A"].T
        d_x = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            back = np.zeros((words.shape[1], HIDDEN), np.float32)
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            g[f"U{d}"] = np.zeros_like(u)
            for s, before, z, r, yn, new in reversed(saved[d]):
                out = back + d_h[s][:, k * HIDDEN : (k + 1) * HIDDEN]
                d_new = out * (1 - z) * (1 - new * new)
                d_z = out * (before - new) * z * (1 - z)
                d_r = d_new * yn * r * (1 - r)
                inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"U{d}"] += before.T @ inner
                back = out * z + inner @ u.T
                np.add.at(d_gates, words[s], np.concatenate([d_z, d_r, d_new], axis=1))
            g[f"W{d}"], g[f"b{d}"] = x.T @ d_gates, d_gates.sum(axis=0)
            d_x += d_gates @ self.p[f"W{d}"].T
        for name, grad in g.items():
            self.seen[name] += grad * grad
            self.p[name] -= rate * grad / np.sqrt(self.seen[name])
        used = np.unique(words)
        used = used[used < len(t.row)]
        self._rows("word", t.row[used], d_x[used, :WIDTH], rate)
        mask = np.zeros(len(t.row), bool)
        mask[used] = True
        at = mask[t.owner]
        self._rows("gram", t.gram[at], d_x[t.owner[at], WIDTH:] / t.n_grams[t.owner[at], None], rate)

    def _rows(self, name: str, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        kinds, back = np.unique(rows, return_inverse=True)
        total = np.zeros((len(kinds), WIDTH), np.float32)
        np.add.at(total, back, grad)
        self.seen[name][kinds] += total * total
        self.p[name][kinds] -= rate * total / np.sqrt(self.seen[name][kinds])

    def logits(self, t: Tokens, block: int = 8192) -> np.ndarray:
        """Of every window."""
        x, out = self.inputs(t), np.empty(len(t.doc), np.float32)
        for i in range(0, len(out), block):
            which = np.arange(i, min(i + block, len(out)))
            out[which] = self.forward(x, *t.windows(which))
        return out

    def documents(self, t: Tokens, n: int) -> np.ndarray:
        """The largest logit of each of n texts; minus infinity without words."""
        out = np.full(n, -np.inf)
        np.maximum.at(out, t.doc, self.logits(t))
        return out

    def score(self, logit: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(logit), _sigmoid(self.scale * np.where(np.isfinite(logit), logit, 0) + self.shift), 0.0)


def fit(texts: list[str], labels: np.ndarray, share: float, seed: int = 1, batch: int = 256) -> Network:
    """A network learned from whole labelled texts.

    First all windows of a text carry its label; then, with what was learned, only the highest windows of each
    text and a like number at random of the others with label 0 are learned again. The highest logit of a text
    is calibrated by logistic regression, corrected to the given share of label 1.
    """
    rng, net = np.random.default_rng(seed), Network(seed)
    buf, offs = utf8(pc.utf8_lower(pa.array(texts, pa.large_string())))
    parts = [(i, j, Tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])) for i, j in chunks(offs, 1 << 18)]

    def learn(chosen: list[np.ndarray], rate: float) -> None:
        for k in rng.permutation(len(parts)):
            i, _, t = parts[k]
            which = rng.permutation(chosen[k])
            for a in range(0, len(which), batch):
                some = which[a : a + batch]
                net.step(t, some, labels[i + t.doc[some]].astype(np.float32), rate)

    learn([np.arange(len(t.doc)) for _, _, t in parts], 0.05)
    for rate in (0.05, 0.03, 0.02):
        chosen = []
        for i, _, t in parts:
            order = np.lexsort((-net.logits(t), t.doc))
            nth = np.arange(len(order)) - np.searchsorted(t.doc[order], t.doc[order])
            extra = (labels[i + t.doc[order]] == 0) & (rng.random(len(order)) < 0.1)
            chosen.append(order[(nth < 2) | extra])
        learn(chosen, rate)
    top = np.concatenate([net.documents(t, j - i) for i, j, t in parts])
    ok = np.isfinite(top)
    x, y = top[ok], labels[ok].astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -1, 1)
    own = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    net.scale, net.shift = float(a), float(b + np.log(share / (1 - share)) - np.log(own / (1 - own)))
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = 1200) -> Network | None:
    """Fits a network on at most `sample` labelled documents of each label, those of least hash of their id.

    labels has doc_id and toxic (0 or 1); other rows of it, and documents without text, are passed over. This is
    the one bounded sample: it is brought to the driver, whatever the size of the tables. None unless both labels occur.
    """
    rows = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    count = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if set(count) != {0, 1}:
        return None
    order = F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")
    some = rows.where("toxic = 0").orderBy(*order).limit(sample).unionByName(rows.where("toxic = 1").orderBy(*order).limit(sample))
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(F.broadcast(some), "doc_id").where("text is not null").select("doc_id", "text", "toxic").collect()
    found.sort(key=lambda r: (r["doc_id"], r["text"]))
    label = np.array([r["toxic"] for r in found])
    if set(label.tolist()) != {0, 1}:
        return None
    return fit([r["text"] for r in found], label, count[1] / (count[0] + count[1]))


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per document: doc_id and score, from the highest of all its overlapping windows.

    Every text is read whole, in windows of WINDOW words at every STRIDE words. Null and empty texts and those without a
    word score 0, and so does every text if there is no network. Null and repeated ids keep their rows; an
    empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            buf, offs = utf8(pc.utf8_lower(batch.column(1)))
            for i, j in chunks(offs, 1 << 20):
                found = np.zeros(j - i)
                if net is not None:
                    t = Tokens(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    found = net.score(net.documents(t, j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, pa.float64())], ["doc_id", "score"])

    return bounded_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCORED)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    net = train(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

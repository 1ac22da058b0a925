"""Toxicity: a bidirectional gated recurrent network with attention pooling over windows of words."""

import pickle
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm.common import cut, held_out, learning_rows, text_key
from sidelines.llm.text import ALNUM, Words, parts

#: A fit uses at most about so many labelled texts of each class, whole, and so many bytes of them.
MOST_TEXTS, MOST_BYTES = 1500, 4 << 20
#: Texts whose byte grams are counted at once.
TEXTS_AT_ONCE = 16
WINDOW, STRIDE = 24, 12
GRAMS = (3, 4)
_WIDTH, _HIDDEN = 8, 8


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of overlapping windows of each text (the last one ends with it), and the text of each."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[doc] + np.minimum(j * STRIDE, np.maximum(n[doc] - WINDOW, 0)), doc


def _grams(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte grams of each word with a mark at both ends, and how many each word has."""
    wide = length + 2
    at = np.cumsum(wide) - wide
    flat = np.full(int(wide.sum()), 1, np.uint64)
    flat[np.arange(int(length.sum())) + np.repeat(2 * np.arange(len(length)) + 1, length)] = data[np.arange(int(length.sum())) + np.repeat(start - np.cumsum(length) + length, length)]
    word = np.repeat(np.arange(len(length)), wide)
    left = at[word] + wide[word] - np.arange(len(flat))
    flat = np.concatenate([flat, np.zeros(max(GRAMS), np.uint64)])
    value, owner = [], []
    for n in GRAMS:
        place = np.flatnonzero(left >= n)
        key = np.full(len(place), n, np.uint64)
        for k in range(n):
            key = key << np.uint64(8) | flat[place + k]
        value.append(key)
        owner.append(word[place])
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return value[order], np.bincount(owner, minlength=len(length))


def _lookup(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 + place in known (sorted), 0 if it isn't there."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at + 1, 0)


class Text:
    """Texts as ids of their different words, with each such word's id in the vocabulary and those of its grams."""

    def __init__(self, column: pa.Array):
        w = Words(column, ALNUM, lower=True)
        self.first = w.first
        self.hashes, one, self.ids = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.grams, self.n_grams = _grams(w.data, w.start[one], w.length[one])

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words of each window (len(hashes) where it has no more), which are there, and its text."""
        start, doc = _windows(self.first)
        place = start[:, None] + np.arange(WINDOW)[None, :]
        there = place < self.first[doc + 1][:, None]
        ids = self.ids.astype(np.int32)[np.where(there, place, 0)] if len(self.ids) else np.int32(0)
        return np.where(there, ids, np.int32(len(self.hashes))), there, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1 if len(shape) < 2 else 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.words, self.grams = words, grams
        self.p = {"word": 0.1 * normal(len(words) + 1, _WIDTH), "gram": 0.1 * normal(len(grams) + 1, _WIDTH), "v": normal(2 * _HIDDEN), "w": normal(2 * _HIDDEN), "c": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": normal(2 * _WIDTH, 3 * _HIDDEN), f"h{side}": normal(_HIDDEN, 3 * _HIDDEN), f"s{side}": np.zeros(3 * _HIDDEN, np.float32)}
        self.p["word"][0] = self.p["gram"][0] = 0
        self.slope, self.shift, self.floor = 1.0, 0.0, -5.0

    def inputs(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each different word's vector: its own and the mean of its grams'; a last row of zeros for where no word is."""
        word, gram = _lookup(self.words, text.hashes), _lookup(self.grams, text.grams)
        n = text.n_grams
        mean = np.zeros((len(n), _WIDTH), np.float32)
        if len(n):
            for d in range(_WIDTH):
                mean[:, d] = np.add.reduceat(self.p["gram"][:, d][gram], np.cumsum(n) - n)
            mean /= np.sqrt(n)[:, None]
        x = np.zeros((len(n) + 1, 2 * _WIDTH), np.float32)
        x[:-1, :_WIDTH], x[:-1, _WIDTH:] = self.p["word"][word], mean
        return x, word, gram, n

    def forward(self, tables: dict[str, np.ndarray], ids: np.ndarray, there: np.ndarray, keep: bool = False):
        h, n, states = _HIDDEN, len(ids), {}
        out = np.empty((ids.shape[1], n, 2 * h), np.float32)
        for side, steps in (("f", range(ids.shape[1])), ("b", range(ids.shape[1] - 1, -1, -1))):
            s, u = np.zeros((n, h), np.float32), self.p[f"h{side}"]
            kept = []
            for t in steps:
                x, y = tables[side][ids[:, t]], s @ u
                zr = _sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
                new = np.where(there[:, t, None], c + z * (s - c), s)
                if keep:
                    kept.append((t, s, z, r, c, y[:, 2 * h :]))
                s = new
                (out[t, :, :h] if side == "f" else out[t, :, h:])[...] = s
            states[side] = kept
        score = np.where(there.T, out @ self.p["v"], -1e9)
        a = np.exp(score - score.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", a, out)
        logit = pooled @ self.p["w"] + self.p["c"][0]
        return (logit, out, a, pooled, states) if keep else logit

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {side: x @ self.p[f"x{side}"] + self.p[f"s{side}"] for side in "fb"}

    def logits(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Of all windows, and the text of each."""
        ids, there, doc = text.blocks()
        tables = self.tables(self.inputs(text)[0])
        return np.concatenate([self.forward(tables, ids[i : i + 4096], there[i : i + 4096]) for i in range(0, len(ids), 4096)]) if len(ids) else np.zeros(0, np.float32), doc

    def highest(self, text: Text) -> np.ndarray:
        """Each text's highest window; the floor if it has none."""
        logit, doc = self.logits(text)
        out = np.full(len(text.first) - 1, -np.inf)
        np.maximum.at(out, doc, logit)
        return np.where(np.isfinite(out), out, self.floor)

    def score(self, text: Text) -> np.ndarray:
        return _sigmoid(np.clip(self.slope * self.highest(text) + self.shift, -30, 30))

    def gradients(self, x, ids, there, y, weight) -> tuple[dict[str, np.ndarray], np.ndarray]:
        h, p = _HIDDEN, self.p
        tables = self.tables(x)
        logit, out, a, pooled, states = self.forward(tables, ids, there, keep=True)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g = {"w": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["w"][None, :]
        da = np.einsum("nk,tnk->tn", dp, out)
        ds = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", ds, out)
        dout = a[:, :, None] * dp[None] + ds[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        for side, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, carry = p[f"h{side}"], np.zeros((len(y), h), np.float32)
            table = np.zeros((len(x), 3 * h), np.float32)
            gu = np.zeros_like(u)
            for t, s, z, r, c, yn in reversed(states[side]):
                total = carry + dout[t, :, part]
                live = there[:, t, None]
                dh = np.where(live, total, 0)
                dz, dc = dh * (s - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
                dr = dc * yn * r * (1 - r)
                gx = np.concatenate([dz, dr, dc], axis=1)
                gy = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(table, ids[:, t], gx)
                gu += s.T @ gy
                carry = dh * z + gy @ u.T + np.where(live, 0, total)
            g[f"h{side}"], g[f"s{side}"], g[f"x{side}"] = gu, table.sum(axis=0), x.T @ table
            dx += table @ p[f"x{side}"].T
        return g, dx


def train(texts: list[str | None], labels: np.ndarray, rounds: int = 8, least: int = 5, seed: int = 11) -> Network:
    """Learns from whole texts with one label each: in each round the windows with the highest scores, and random ones
    of the texts labelled 0, pass the error back. First vectors of words and grams hold how much more often they occur
    in texts labelled 1."""
    text = Text(pa.array(texts, pa.string()))
    y = labels.astype(np.float32)
    doc = np.repeat(np.arange(len(texts)), np.diff(text.first))
    pairs = np.unique(doc * np.int64(len(text.hashes) + 1) + text.ids)
    of, word = pairs // (len(text.hashes) + 1), pairs % (len(text.hashes) + 1)
    gram_names, gram_of = np.unique(text.grams, return_inverse=True)
    held = np.bincount(word, minlength=len(text.hashes))
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))

    def odds(one: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.clip(np.log((one + 0.5) / (count - one + 0.5)) - base, -3, 3) * (count / (count + 5))

    ones = np.bincount(word, weights=y[of], minlength=len(text.hashes))
    vocabulary = np.flatnonzero(held >= least)
    g_held, g_ones = np.zeros(len(gram_names)), np.zeros(len(gram_names))
    last = np.cumsum(text.n_grams)
    for a, b in pairwise(np.searchsorted(of, np.arange(0, len(texts) + TEXTS_AT_ONCE, TEXTS_AT_ONCE)).tolist()):
        n = text.n_grams[word[a:b]]
        places = np.repeat(last[word[a:b]] - np.cumsum(n), n) + np.arange(int(n.sum()))
        both = np.unique(np.repeat(of[a:b], n) * np.int64(len(gram_names) + 1) + gram_of[places])
        g_doc, g = both // (len(gram_names) + 1), both % (len(gram_names) + 1)
        g_held += np.bincount(g, minlength=len(gram_names))
        g_ones += np.bincount(g, weights=y[g_doc], minlength=len(gram_names))
    grams = np.flatnonzero(g_held >= 2 * least)
    pad = np.array([np.iinfo(np.int64).max], np.uint64)
    net = Network(np.concatenate([text.hashes[vocabulary], pad]) if not len(vocabulary) else text.hashes[vocabulary], gram_names[grams] if len(grams) else pad, seed)
    net.p["word"][1 : len(vocabulary) + 1, 0] = odds(ones[vocabulary], held[vocabulary])
    net.p["gram"][1 : len(grams) + 1, 0] = odds(g_ones[grams], g_held[grams])
    ids, there, window_doc = text.blocks()
    if not len(ids) or not 0 < y.sum() < len(y):
        net.slope, net.shift = 0.0, float(np.clip(base, -5, 5)) if len(y) else 0.0
        return net
    rng = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    guess = (net.p["word"][_lookup(net.words, text.hashes), 0]).astype(np.float32)
    for turn in range(rounds):
        if turn:
            logit, _ = net.logits(text)
        else:
            logit = np.append(guess, 0)[ids].max(axis=1)
        rank = np.lexsort([-logit, window_doc])
        place = np.arange(len(rank)) - np.searchsorted(window_doc[rank], window_doc[rank])
        top = rank[place < np.where(y[window_doc[rank]] > 0, 1, 2)]
        clean = np.flatnonzero(y[window_doc] == 0)
        chosen = np.concatenate([top, rng.choice(clean, min(len(clean), 2 * len(texts)), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), 256):
            part = chosen[i : i + 256]
            names, local = np.unique(ids[part], return_inverse=True)
            x, word_at, gram_at, n = net.inputs(text) if i == 0 else (x, word_at, gram_at, n)
            own = names[names < len(text.hashes)]
            ends = np.cumsum(text.n_grams)
            count = text.n_grams[own]
            flat = np.repeat(ends[own] - count, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            rows = np.zeros((len(names), 2 * _WIDTH), np.float32)
            rows[: len(own), :_WIDTH] = net.p["word"][word_at[own]]
            gsum = np.zeros((len(own), _WIDTH), np.float32)
            np.add.at(gsum, np.repeat(np.arange(len(own)), count), net.p["gram"][gram_at[flat]])
            rows[: len(own), _WIDTH:] = gsum / np.sqrt(count)[:, None]
            grads, dx = net.gradients(rows, local.reshape(ids[part].shape), there[part], y[window_doc[part]], 1.0)
            grads["word"], grads["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            np.add.at(grads["word"], word_at[own], dx[: len(own), :_WIDTH])
            np.add.at(grads["gram"], gram_at[flat], np.repeat(dx[: len(own), _WIDTH:] / np.sqrt(count)[:, None], count, axis=0))
            grads["word"][0] = grads["gram"][0] = 0
            step += 1
            for k, grad in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                net.p[k] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    best = net.highest(text)
    net.floor = float(best[y == 0].min())
    mean, spread = best.mean(), best.std() + 1e-6
    a, b, z = 1.0, 0.0, (best - mean) / spread
    for _ in range(400):
        p = _sigmoid(a * z + b)
        a, b = a - 1.0 * (((p - y) * z).mean() + 0.002 * a), b - 1.0 * (p - y).mean()
    net.slope, net.shift = float(a / spread), float(b - a * mean / spread)
    return net


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS, most_bytes: int = MOST_BYTES) -> Network:
    """Trains on whole texts of each class outside the held-out fold: of about `most` labelled ids chosen by a hash, those
    that come first by it and fit in `most_bytes` together. Of an id's texts it takes the one with the least key. One task
    trains on this bounded sample; the driver sees ids, sizes and the network."""
    rows = learning_rows(labels, "toxic", 1 << 62)
    counts = dict(rows.groupBy("label").count().collect())
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000))
    share = F.when(F.col("label") == 1, min(1.0, most / max(1, counts.get(1, 0)))).otherwise(min(1.0, most / max(1, counts.get(0, 0))))
    sample = rows.where(chosen < share * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    found = cut(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("key", "text")).alias("t")).select("doc_id", "label", "t.text"), "sample")
    sizes = found.select("doc_id", "label", F.octet_length("text").alias("size"), F.xxhash64("doc_id", F.lit(13)).alias("rank")).toPandas().sort_values(["rank", "doc_id"])
    taken, room = [], {0: most_bytes, 1: most_bytes}
    for doc_id, label, size in zip(sizes["doc_id"].tolist(), sizes["label"].tolist(), sizes["size"].tolist(), strict=True):
        if size <= room[label]:
            room[label] -= size
            taken.append((doc_id,))
    if not taken:
        return train([], np.zeros(0, int))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        net = train([text for _, _, text in rows], np.array([label for _, label, _ in rows], int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["network"])

    rows = found.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id", "left_semi")
    return pickle.loads(rows.select("doc_id", "label", "text").coalesce(1).mapInArrow(run, "network binary").first()[0])


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS) -> DataFrame:
    """(doc_id, held_out, score) of each row of docs(doc_id, text), a text's score being that of its worst window.

    Every text is cut into overlapping windows of WINDOW words, all of which are scored; texts without words (empty or
    null) get the score of the cleanest one seen in training. Inputs are words and byte grams of the text alone. Rows
    with a null doc_id are scored and count as held out; without labels of both classes all scores are equal.
    """
    net = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(Text(batch.column(1))).astype(float))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")

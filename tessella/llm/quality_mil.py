"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: the mean of learned vectors of its
hashed words and a few counts of its characters go through a tanh layer. Gated attention
(tanh times sigmoid) weighs the passages, with weights learned from document labels alone, and
the weighted sum of the passages gives the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: Words to a passage, buckets of hashed words, sizes of word vectors, passage codes and attention.
PASSAGE, BUCKETS, WORD_SIZE, CODE, GATE = 64, 1 << 13, 12, 24, 12
#: Documents in the sample of labelled rows to learn from, at most.
MOST_ROWS = 3000
#: Characters of a text to split into words at once, and of texts to score at once; passages to encode at once.
PIECE, TOGETHER, BLOCK = 1 << 18, 1 << 22, 1 << 14
FOLDS = 5
THRESHOLD = 0.3
SYMBOLS = frozenset("#*$%&|<>{}[]\\^~_=+@")
N_COUNTS = 10


@dataclass
class Reader:
    """Turns a text into passages: bucket numbers of all words, where passages start, and counts of each."""

    memory: int = 100_000
    shapes: dict[str, tuple] = field(default_factory=dict)

    def shape(self, word: str) -> tuple:
        """Bucket and character counts of a word: upper, digits, symbols, exclamations, other marks, length."""
        upper = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        letters = sum(map(str.isalpha, word))
        symbols = sum(map(SYMBOLS.__contains__, word))
        loud = word.count("!")
        got = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS, upper, digits, symbols, loud, len(word) - letters - digits - symbols - loud, len(word))
        if len(self.shapes) >= self.memory:
            self.shapes.clear()
        if len(word) <= 64:
            self.shapes[word] = got
        return got

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Long texts are read piece by piece, so only numbers are held for all of one: two bytes a word."""
        seen, last, parts = np.zeros(BUCKETS, dtype=bool), -1, []
        for words in pieces(text):
            shapes = self.shapes
            each = np.array([shapes.get(w) or self.shape(w) for w in words], dtype=np.int64)
            starts, ids = np.arange(0, len(words), PASSAGE), each[:, 0]
            sizes = np.diff(np.append(starts, len(words)))
            sums = np.add.reduceat(each[:, 1:], starts, axis=0)
            chars = np.maximum(sums[:, 5], 1)[:, None]
            same = ids == np.append(last, ids[:-1])
            kinds = [len(set(words[a : a + PASSAGE])) for a in starts.tolist()]
            first = np.zeros(len(words))  # words whose bucket is new in the document
            new, at = np.unique(ids, return_index=True)
            first[at[~seen[new]]] = 1
            seen[new], last = True, ids[-1]
            counts = np.column_stack([sums[:, :5] / chars, sums[:, 5] / sizes / 10, np.add.reduceat(same.astype(float), starts) / sizes, np.array(kinds) / sizes, np.add.reduceat(first, starts) / sizes, np.log1p(sizes) / 4])
            parts.append((ids.astype(np.uint16), counts.astype(np.float32)))
        if not parts:
            return bag(np.zeros(0, np.uint16), np.zeros((1, N_COUNTS), np.float32))
        return bag(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def bag(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A read text: bucket numbers, starts of its passages (one empty one without words) and counts of each."""
    return ids, np.arange(0, max(len(ids), 1), PASSAGE), counts


def pieces(text: str) -> Iterator[list[str]]:
    """The words of a text, about PIECE characters at a time; all lists but the last hold whole passages."""
    at, rest = 0, []
    while at < len(text):
        cut = _SPACE(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        words = rest + text[at:end].split()
        n = len(words) if end == len(text) else len(words) // PASSAGE * PASSAGE
        if n:
            yield words[:n]
        at, rest = end, words[n:]


_SPACE = re.compile(r"\s").search


class Model:
    """Parameters and their training; without labels of both kinds it scores every text alike."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        of = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": (rng.standard_normal((BUCKETS, WORD_SIZE)) * 0.05).astype(np.float32), "W": of(WORD_SIZE + N_COUNTS, CODE), "b": np.zeros(CODE, np.float32), "V": of(CODE, GATE), "U": of(CODE, GATE), "w": of(GATE, 1)[:, 0], "c": of(CODE, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(N_COUNTS, np.float32), np.ones(N_COUNTS, np.float32)
        self.constant: float | None = None

    def encode(self, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        """Inputs of the passages of any number of documents laid end to end."""
        p = self.p
        if len(ids):
            sizes = np.diff(np.append(starts, len(ids)))
            safe = np.minimum(starts, len(ids) - 1)  # an empty passage's sum is cleared below
            bags = np.add.reduceat(p["E"][ids], safe, axis=0)
            bags[sizes == 0] = 0
            bags /= np.maximum(sizes, 1)[:, None]
        else:
            bags = np.zeros((len(starts), WORD_SIZE), np.float32)
        x = np.concatenate([bags, (counts - self.mean) / self.scale], axis=1)
        h = np.tanh(x @ p["W"] + p["b"])
        return x, h

    def attend(self, h: np.ndarray, docs: np.ndarray):
        """Gate values, attention weights and document vectors; ``docs`` has the first passage of each document."""
        p = self.p
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        of = np.repeat(np.arange(len(docs)), np.diff(np.append(docs, len(h))))
        a = np.exp(e - np.maximum.reduceat(e, docs)[of])
        a /= np.add.reduceat(a, docs)[of]
        return t, s, a, of, np.add.reduceat(a[:, None] * h, docs, axis=0)

    def score(self, bags: list) -> np.ndarray:
        """Scores of read texts, 0 to 1."""
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant or 0.0)
        ids, starts, counts, docs = laid(bags)
        h = []
        for at in range(0, len(starts), BLOCK):
            own = starts[at : at + BLOCK]
            end = starts[at + BLOCK] if at + BLOCK < len(starts) else len(ids)
            h.append(self.encode(ids[own[0] : end], own - own[0], counts[at : at + BLOCK])[1])
        *_, z = self.attend(np.concatenate(h), docs)
        return 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["d"]).astype(np.float64)))

    def fit(self, bags: list, labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.004, decay: float = 1e-4, seed: int = 6) -> Model:
        """Adam on the log loss of document labels (0 or 1), in a seeded order."""
        labels = np.asarray(labels, dtype=np.float32)
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        every = np.concatenate([b[2] for b in bags])
        self.mean, self.scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, p = 0, self.p
        epochs = max(epochs, -(-600 * batch // len(bags)))  # at least 600 steps on small samples
        for _ in range(min(epochs, 200)):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                _, g = self.gradients([bags[i] for i in pick], labels[pick])
                step += 1
                for k, (of, grad) in g.items():  # of word vectors, those of the batch alone move
                    grad = grad.astype(np.float32) + decay * p[k][of]
                    m[k][of] += 0.1 * (grad - m[k][of])
                    v2[k][of] += 0.001 * (grad * grad - v2[k][of])
                    p[k][of] -= rate * (m[k][of] / (1 - 0.9**step)) / (np.sqrt(v2[k][of] / (1 - 0.999**step)) + 1e-8)
        return self

    def gradients(self, bags: list, y: np.ndarray) -> tuple[float, dict]:
        """Mean log loss and, for each parameter, which rows it has a gradient for and that gradient."""
        p = self.p
        ids, starts, counts, docs = laid(bags)
        x, h = self.encode(ids, starts, counts)
        t, s, a, of, z = self.attend(h, docs)
        logit = z @ p["c"] + p["d"]
        loss = float((np.logaddexp(0, logit) - y * logit).mean())
        dout = (1 / (1 + np.exp(-logit)) - y) / len(y)
        g = {"c": z.T @ dout, "d": dout.sum(keepdims=True)}
        dz = dout[:, None] * p["c"][None, :]
        dh = a[:, None] * dz[of]
        da = (h * dz[of]).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, docs)[of])
        g["w"] = (t * s).T @ de
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh += dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - h * h)
        g["W"], g["b"] = x.T @ dx, dx.sum(axis=0)
        out = {k: (slice(None), v) for k, v in g.items()}
        if len(ids):
            sizes = np.diff(np.append(starts, len(ids)))
            db = (dx @ p["W"].T)[:, :WORD_SIZE] / np.maximum(sizes, 1)[:, None]
            order = np.argsort(ids, kind="stable")
            words, at = np.unique(ids[order], return_index=True)
            out["E"] = (words, np.add.reduceat(db[np.repeat(np.arange(len(sizes)), sizes)[order]], at, axis=0))
        return loss, out


def laid(bags: list):
    """Read texts laid end to end: word buckets, passage starts, counts and first passages."""
    ids = np.concatenate([b[0] for b in bags])
    words = np.cumsum([0] + [len(b[0]) for b in bags[:-1]])
    starts = np.concatenate([b[1] + w for b, w in zip(bags, words, strict=True)])
    docs = np.cumsum([0] + [len(b[1]) for b in bags[:-1]])
    return ids, starts, np.concatenate([b[2] for b in bags]), docs


def fold(key: str = "doc_id"):
    """CRC-32 of the key as text, modulo the number of folds; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> DataFrame:
    """The labelled documents to learn from (key_, text, label), ``most_rows`` at most, drawn by a hash of their keys.

    Rows of fold 0, or without a label of 0 or 1, are never among them; texts of all lengths are. A
    key with several labels has the lower one, one with several texts the first by order; null
    keys fit no label.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key_")).agg(F.min(label).cast("int").alias("label"))
    rows = docs.where(fold(key) != 0).select(F.col(key).alias("key_"), common.text_or_empty(text).alias("text"))
    # keys are drawn first, so that only drawn texts are gathered
    drawn = rows.select("key_").distinct().join(known, "key_").orderBy(F.xxhash64("key_"), "key_").limit(most_rows)
    return rows.join(F.broadcast(drawn), "key_").groupBy("key_").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fit on the bounded sample, on the driver; texts are turned into numbers before they are sent there."""
    common.ship(docs.sparkSession)

    def numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common.let_go()
        reader = Reader()
        for frame in frames:
            read = [reader.read(t) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key_"].astype(str), "label": frame["label"], "ids": [r[0].tobytes() for r in read], "counts": [r[2].tobytes() for r in read]})

    rows = sample(docs, labels, key, text, label, most_rows).mapInPandas(numbers, "key string, label int, ids binary, counts binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r.key.encode()), r.key))
    bags = [bag(np.frombuffer(r.ids, np.uint16), np.frombuffer(r.counts, np.float32).reshape(-1, N_COUNTS)) for r in rows]
    return Model().fit(bags, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; a null or empty text is one empty passage.

    Only the text is an input. A column of that name is replaced, others are kept.
    """
    spark = common.ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # parameters of fixed size

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.let_go()
        reader, own = Reader(), shared.value
        for texts in batches:
            out, held, chars = [], [], 0
            for t in texts:
                held.append(reader.read(t))
                chars += len(t)
                if len(held) == 64 or chars >= TOGETHER:
                    out.append(own.score(held))
                    held, chars = [], 0
            out.append(own.score(held))
            yield pd.Series(np.round(np.concatenate(out), 6))

    return docs.withColumn(column, scores(common.text_or_empty(text)))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, **limits) -> DataFrame:
    """``docs`` with held_out, score and predicted, learned from ``labels`` of rows that aren't held out.

    Columns of these names are replaced. An empty table gives no rows; without labels of both
    kinds the score is their mean (0.5 without any).
    """
    model = train(docs, labels, key, text, label, **limits)
    out = score(docs, model, text).withColumn("held_out", fold(key) == 0)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

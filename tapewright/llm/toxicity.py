"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logit, linear in hashed words and word beginnings; a document is toxic
if any sentence is: P = 1 - product of (1 - p), the noisy-or. Weights are trained from document labels alone, by full-batch
Adam on a sample of at most SAMPLE labelled rows; the sentences' own scores then say where the text offends.

Sentences end at . ! ? or a line feed; a sentence has at least one word. Null and empty texts and texts without words have no
sentences and score 0. Without labelled rows of both kinds every text scores 0. Rows are scored each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import LOWERED, U64, Roller, code_points, held_out, labelled, mixed, runs, slices, table, text_batches, text_of, utf8

SAMPLE = 8000
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6)  # bytes
LIFT = 4
STEPS, RATE, DECAY = 200, 0.1, 1e-5

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
LONG = 1 << 20  # bytes
_STOP = np.zeros(256, np.int64)
_STOP[[0x21, 0x2E, 0x3F, 0x0A]] = 1


class Bags:
    """Sentences of the rows of a text column: features of their words, where they lie, and the row of each."""

    def __init__(self, column: pa.Array):
        raw, offsets = utf8(column)
        self.raw, self.offsets = raw, offsets
        low = LOWERED[raw]
        s, e = runs(_WORD[low], offsets)
        row = np.searchsorted(offsets, s, "right") - 1
        key = np.concatenate([[0], np.cumsum(_STOP[raw])])[s] + row
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(s) else np.zeros(0, np.int64)
        self.first = first  # of the words of each sentence
        self.row = row[first]
        self.start = s[first]
        self.end = e[np.concatenate([first[1:], [len(s)]]) - 1] if len(s) else s
        roll = Roller(low, 7)
        features = [roll.of(s, e)]
        for n in BEGINNINGS:
            features.append(np.where(e - s > n, roll.of(s, np.minimum(s + n, e)) ^ mixed(np.full(len(s), n, U64)), U64(0)))
        self.features = np.stack([np.where(f == 0, 0, 1 + (f % U64(BUCKETS - 1)).astype(np.int32)) for f in features]).astype(np.int32)

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0)
        return bias + np.add.reduceat(weights[self.features].sum(axis=0, dtype=np.float64), self.first)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def loss_gradient(z: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the log-likelihood of the documents' labels under noisy-or of their sentences' logits z, and its gradient in z."""
    s = np.bincount(row, _softplus(z), minlength=len(y))  # minus the logarithm of the probability that no sentence is
    some = np.maximum(-np.expm1(-s), 1e-9)
    loss = np.where(y == 1, -np.log(some), s).sum()
    return float(loss), _sigmoid(z) * np.where(y == 1, -np.exp(-s) / some, 1.0)[row]


def fit(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the buckets (bucket 0 is none) and the bias.

    A bucket takes part if enough documents have it and it is at least LIFT times as frequent among toxic ones.
    """
    w, n = np.zeros(BUCKETS, np.float32), len(y)
    if len(set(y.tolist())) < 2:
        return w, -1e3
    sizes = np.cumsum([0, *(len(t.encode()) for t in texts)])
    df = np.zeros((2, BUCKETS), np.int32)
    parts = []
    for x, z in slices(sizes):
        bags = Bags(pa.array(texts[x:z], pa.large_string()))
        word_row = np.repeat(bags.row, np.diff(np.concatenate([bags.first, [bags.features.shape[1]]])))
        pairs = np.unique(word_row * BUCKETS + bags.features)
        for label in (0, 1):
            df[label] += np.bincount(pairs[y[x + pairs // BUCKETS] == label] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        parts.append((x, bags.features, bags.first, bags.row))
    rate = (df + 0.5) / (np.bincount(y, minlength=2)[:, None] + 1)
    chosen = (df.sum(axis=0) >= max(3, n // 1000)) & (rate[1] >= LIFT * rate[0])
    chosen[0] = False
    used = np.flatnonzero(chosen)
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    row, sentence, feature, base = [], [], [], 0
    for x, f, first, of in parts:
        where, word = np.nonzero(chosen[f])
        feature.append(place[f[where, word]])
        sentence.append(base + np.searchsorted(first, word, "right") - 1)
        row.append(of + x)
        base += len(first)
    row, sentence, feature = map(np.concatenate, (row, sentence, feature))
    v = np.log(rate[1] / rate[0])[used] * 0.5
    m, s, b, mb, sb = np.zeros(len(used)), np.zeros(len(used)), -5.0, 0.0, 0.0
    for t in range(1, STEPS + 1):
        g = loss_gradient(b + np.bincount(sentence, v[feature], minlength=base), row, y)[1]
        gb = g.sum() / n
        gv = np.bincount(feature, g[sentence], minlength=len(used)) / n + DECAY * v
        m, s = 0.9 * m + 0.1 * gv, 0.99 * s + 0.01 * gv * gv
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        v -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    w[used] = v
    return w, float(b)


def score_texts(texts: list[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    bags = Bags(pa.array(texts, pa.large_string()))
    return _noisy_or(bags.logits(*model), bags.row, len(texts))


def _noisy_or(z: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.clip(-np.expm1(-np.bincount(row, _softplus(z), minlength=rows)), 0, 1) if len(z) else np.zeros(rows)


def _parts(column: pa.Array) -> Iterator[tuple[pa.Array, int]]:
    """A column of texts as it is, or a single long text in parts that end with sentences, and the code points before each."""
    raw, offsets = utf8(column)
    if len(column) > 1 or len(raw) <= 2 * LONG:
        yield column, 0
        return
    stops = np.flatnonzero(_STOP.astype(bool)[raw]) + 1
    a, points = 0, 0
    while a < len(raw):
        i = int(np.searchsorted(stops, min(a + LONG, len(raw)), "left"))
        b = int(stops[i]) if i < len(stops) else len(raw)
        part = raw[a:b]
        yield pa.array([part.tobytes().decode()], pa.large_string()), points
        points += int(((part & 0xC0) != 0x80).sum())
        a = b


def _scored(sent, at_least: float):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for b in text_batches(batches, text_of):
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            none = np.zeros(b.num_rows)  # minus the logarithm of the probability that no sentence is
            for part, before in _parts(text_of(b)):
                bags = Bags(part)
                z = bags.logits(weights, bias)
                none += np.bincount(bags.row, _softplus(z), minlength=b.num_rows)
                if len(bad := np.flatnonzero(_sigmoid(z) >= at_least)):
                    points = code_points(bags.raw)
                    for i in bad.tolist():
                        base = points[bags.offsets[bags.row[i]]] - before
                        found[bags.row[i]].append({"start": int(points[bags.start[i]] - base), "end": int(points[bags.end[i]] - base), "score": float(_sigmoid(z[i]))})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(-np.expm1(-none), 0, 1)), pa.array(found, kind)], ["doc", "score", "offending"])

    return run


def scored(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """doc (all columns of docs), score, and offending: code-point spans of sentences that score at_least."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, "toxic", SAMPLE)))
    some = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return some.mapInArrow(_scored(sent, at_least), f"doc {some.schema['doc'].dataType.simpleString()}, score double, offending array<struct<start: bigint, end: bigint, score: double>>")


def clean(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """The rows of docs that score less than reject, with their columns."""
    return scored(docs, labels).where(F.col("score") < reject).select("doc.*")


QUERY = "op8_toxicity"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    doc_id = F.col("doc.doc_id")
    return scored(docs, labels).select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")

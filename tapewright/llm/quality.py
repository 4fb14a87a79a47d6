"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shape statistics (case, symbols, separators, repeated words, length) of the line
and of the lines before and after it, each cut into bins; neighbouring labels have transition weights. Labels of documents
are the labels of their lines in training (the chain is fit by its conditional likelihood, on a sample of at most SAMPLE
labelled rows). A document's raw score is the mean of its lines' marginals (forward-backward), weighted by their length; a
logistic curve fit on the same sample turns it into the score.

Blank lines are no lines. Null and empty texts and texts of blank lines have the score of a raw mean of one half. Without
labelled rows of both kinds every score is 0.5. Rows are scored each by itself; a line may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import LOWERED, U64, held_out, labelled, mixed, runs, slices, table, text_batches, text_of, utf8, word_hashes

SAMPLE = 6000
BINS = 10
STEPS, RATE, DECAY = 60, 0.2, 1e-3
CHUNK = 1 << 20  # bytes of lines that are worked through together; a longer line is alone
LONG_CHAIN = 2048  # lines; both ways give the same marginals


def _mask(*codes: int) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(codes)] = True
    return m


_KINDS = {
    "upper": _mask(*range(0x41, 0x5B)), "lower": _mask(*range(0x61, 0x7B)), "digit": _mask(*range(0x30, 0x3A)), "wide": _mask(*range(0x80, 0x100)),
    "bang": _mask(0x21), "bar": _mask(0x7C), "sign": _mask(*b"#$%&*@^~_=<>{}[]\\/+"), "stop": _mask(*b".,;:?"), "quote": _mask(*b"\"'()-"),
}
_BLANK = _mask(0x20, *range(0x09, 0x0E))
_LINE = ~_mask(0x0A)
N_OWN = len(_KINDS) + 6


def _statistics(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the lines at s to e are not blank, and all statistics of those but the one that compares lines."""
    raw, s, e = raw[s[0] : e[-1]], s - s[0], e - s[0]
    filled = np.concatenate([np.zeros(1, np.int32), np.cumsum(~_BLANK[raw], dtype=np.int32)])
    keep = filled[e] > filled[s]
    s, e = s[keep], e[keep]
    if not len(s):
        return keep, np.zeros((0, N_OWN - 1))
    n = filled[e] - filled[s]
    own = []
    for mask in _KINDS.values():
        c = np.concatenate([np.zeros(1, np.int32), np.cumsum(mask[raw], dtype=np.int32)])
        own.append((c[e] - c[s]) / n)
    ws, we = runs(~_BLANK[raw], np.unique(np.concatenate([[0], s, e, [len(raw)]])))
    a, b = np.searchsorted(ws, s), np.searchsorted(ws, e)
    words = np.maximum(b - a, 1)
    line = np.repeat(np.arange(len(s)), b - a)
    mine = word_hashes(LOWERED[raw], ws, we, 11)[np.arange(len(line)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
    again = np.concatenate([[0], np.cumsum(np.concatenate([[False], (mine[1:] == mine[:-1]) & (line[1:] == line[:-1])]))])
    begin = np.concatenate([[0], np.cumsum(b - a)])
    own.append((again[begin[1:]] - again[begin[:-1]]) / words)
    own.append(np.bincount(np.unique(line.astype(U64) << U64(40) | (mixed(mine) >> U64(24))).astype(U64) >> U64(40), minlength=len(s)) / words)
    own.append(np.log1p(n))
    own.append(np.log1p(words))
    own.append(n / words)
    return keep, np.stack(own, axis=1)


class Lines:
    """The lines of the rows of a text column, with their statistics."""

    def __init__(self, column: pa.Array):
        raw, offsets = utf8(column)
        self.rows = len(column)
        s, e = runs(_LINE[raw], offsets)
        parts = [_statistics(raw, s[a:b], e[a:b]) for a, b in slices(np.concatenate([s[:1], e]), CHUNK)]
        keep = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, bool)
        s, e = s[keep], e[keep]
        self.row = np.searchsorted(offsets, s, "right") - 1
        self.length = (e - s).astype(np.float64)
        self.own = np.column_stack([np.concatenate([x for _, x in parts]), self._shared(raw, s, e)]) if len(s) else np.zeros((0, N_OWN))

    def _shared(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """How many lines of the same row have the same text, as a logarithm."""
        if not len(s):
            return np.zeros(0)
        key = word_hashes(raw, s, e, 13) ^ mixed(self.row.astype(U64))
        _, index, count = np.unique(key, return_inverse=True, return_counts=True)
        return np.log(count[index])

    def features(self, edges: np.ndarray) -> np.ndarray:
        """Indices of the bins of each line, the line before and the line after (or none)."""
        n = len(self.own)
        binned = np.stack([np.searchsorted(edges[j], self.own[:, j], "right") for j in range(N_OWN)], axis=1) if n else np.zeros((0, N_OWN), int)
        none = np.full((1, N_OWN), BINS)
        before = np.concatenate([none, binned[:-1]]) if n else binned
        after = np.concatenate([binned[1:], none]) if n else binned
        first = np.concatenate([[True], self.row[1:] != self.row[:-1]]) if n else np.zeros(0, bool)
        before[first] = BINS
        after[np.concatenate([first[1:], [True]]) if n else first] = BINS
        all3 = np.concatenate([binned, before, after], axis=1)
        return all3 + np.arange(3 * N_OWN) * (BINS + 1)


N_FEATURES = 3 * N_OWN * (BINS + 1)


def _chains(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first line and the number of lines of each row that has any, the longest first."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(row)]]))
    order = np.argsort(-count, kind="stable")
    return first[order], count[order]


def forward_backward(unary: np.ndarray, trans: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(good) of each line, and the expected counts of the four transitions.

    unary: log-weight of good against bad; trans[i, j]: log-weight of label j after label i. All chains advance together.
    """
    n = len(unary)
    a, scale = np.zeros((n, 2)), np.exp(trans - trans.max())
    w = np.stack([np.ones(n), np.exp(np.clip(unary, -30, 30))], axis=1)
    w /= w.sum(axis=1, keepdims=True)
    first, count = _chains(row)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    most = int(count[0])
    if most > LONG_CHAIN:
        return _scanned(w, scale, row)
    alive = np.searchsorted(-count, -np.arange(most), "left")  # chains with more than t lines
    for t in range(most):
        i = first[: alive[t]] + t
        x = w[i] if t == 0 else (a[i - 1] @ scale) * w[i]
        a[i] = x / x.sum(axis=1, keepdims=True)
    back = np.ones((n, 2))
    expected = np.zeros((2, 2))
    for t in range(most - 2, -1, -1):
        i = first[: alive[t + 1]] + t
        follow = w[i + 1] * back[i + 1]
        x = follow @ scale.T
        both = a[i][:, :, None] * scale * follow[:, None, :]
        expected += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back[i] = x / x.sum(axis=1, keepdims=True)
    m = a * back
    return m[:, 1] / m.sum(axis=1), expected


def _scanned(w: np.ndarray, scale: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """forward_backward by scans of 2 x 2 matrices in log2(lines) rounds: for long chains, where a step for each line is slow."""
    starts = np.concatenate([[True], row[1:] != row[:-1]])
    step = scale[None] * w[:, None, :]  # [i, j]: from label i of the line before to label j of this one
    a = _prefix_products(np.where(starts[:, None, None], w[:, None, :], step))[:, 0, :]  # what begins a chain forgets the past
    ends = np.concatenate([starts[1:], [True]])
    follow = np.concatenate([w[1:], np.ones((1, 2))])
    back = np.where(ends[:, None, None], 1.0, scale[None] * follow[:, None, :])  # [i, j]: label i here, j on the next line
    back = _prefix_products(np.swapaxes(back, 1, 2)[::-1])[::-1][:, 0, :]
    m = a * back
    inner = np.flatnonzero(~ends)
    both = a[inner][:, :, None] * scale * (w[inner + 1] * back[inner + 1])[:, None, :]
    expected = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return m[:, 1] / m.sum(axis=1), expected


def _prefix_products(x: np.ndarray) -> np.ndarray:
    """x[0] @ ... @ x[t] for each t, each scaled to sum 1: the first rows of products whose chain began with equal rows."""
    x = x / x.sum(axis=(1, 2), keepdims=True)
    size = 1
    while size < len(x):
        y = x[:-size] @ x[size:]
        x = np.concatenate([x[:size], y / y.sum(axis=(1, 2), keepdims=True)])
        size *= 2
    return x


def _raw_scores(marginals: np.ndarray, lines: Lines) -> np.ndarray:
    weight = np.bincount(lines.row, lines.length, minlength=lines.rows)
    total = np.bincount(lines.row, lines.length * marginals, minlength=lines.rows)
    return np.where(weight > 0, total / np.maximum(weight, 1e-9), 0.5)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Chain:
    """Fitted weights: bin edges, unary weights, transitions, and the logistic curve of the raw score."""

    def __init__(self):
        self.edges = np.zeros((N_OWN, BINS - 1))
        self.v, self.trans, self.curve = np.zeros(N_FEATURES), np.zeros((2, 2)), (0.0, 0.0)

    def raw(self, lines: Lines) -> np.ndarray:
        unary = self.v[lines.features(self.edges)].sum(axis=1)
        return _raw_scores(forward_backward(unary, self.trans, lines.row)[0], lines)

    def score(self, lines: Lines) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * _logit(self.raw(lines)) + b)))


def fit(texts: list[str], y: np.ndarray) -> Chain:
    out = Chain()
    if len(set(y.tolist())) < 2:
        return out
    sizes = np.cumsum([0, *(len(t.encode()) for t in texts)])
    parts = [Lines(pa.array(texts[a:b], pa.large_string())) for a, b in slices(sizes)]
    starts = [a for a, _ in slices(sizes)]
    own = np.concatenate([p.own for p in parts])
    for j in range(N_OWN):
        out.edges[j] = np.quantile(own[:, j], np.linspace(0, 1, BINS + 1)[1:-1])
    f = np.concatenate([p.features(out.edges) for p in parts])
    row = np.concatenate([p.row + a for p, a in zip(parts, starts, strict=True)])
    label = y[row]
    same = row[1:] == row[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    n = len(y)
    lines_of = np.bincount(row, minlength=n)
    weight = (1 / np.maximum(lines_of, 1))[row]  # a document counts once, however many lines it has
    observed = np.bincount(f.ravel(), np.repeat(label * weight, f.shape[1]), minlength=N_FEATURES)
    m, s = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for t in range(1, STEPS + 1):
        p, expected = forward_backward(out.v[f].sum(axis=1), out.trans, row)
        g = np.bincount(f.ravel(), np.repeat(p * weight, f.shape[1]), minlength=N_FEATURES) - observed
        gt = (expected - seen) / max(1, len(row)) * n
        g = np.concatenate([g, gt.ravel()]) / n + DECAY * np.concatenate([out.v, out.trans.ravel()])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        d = RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        out.v -= d[:N_FEATURES]
        out.trans -= d[N_FEATURES:].reshape(2, 2)
    raw = np.concatenate([out.raw(p) for p in parts])
    x, a, b = _logit(raw), 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number
        p = 1 / (1 + np.exp(-(a * x + b)))
        q = np.maximum(p * (1 - p), 1e-9)
        g0, g1 = ((p - y) * x).sum() + 0.1 * a, (p - y).sum()
        h00, h01, h11 = (q * x * x).sum() + 0.1, (q * x).sum(), q.sum() + 1e-6
        det = h00 * h11 - h01 * h01
        a, b = a - 0.5 * (h11 * g0 - h01 * g1) / det, b - 0.5 * (h00 * g1 - h01 * g0) / det
    out.curve = (max(a, 1e-3), b)
    return out


def score_texts(texts: list[str], model: Chain) -> np.ndarray:
    return model.score(Lines(pa.array(texts, pa.large_string())))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, text_of):
            lines = Lines(text_of(b))
            score = sent.value.score(lines)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(np.bincount(lines.row, minlength=b.num_rows), pa.int64())], ["doc", "score", "n_lines"])

    return run


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc (all columns of docs), score, n_lines."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, "quality", SAMPLE)))
    some = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    return some.mapInArrow(_scored(sent), f"doc {some.schema['doc'].dataType.simpleString()}, score double, n_lines bigint")


QUERY = "op1_quality"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    doc_id = F.col("doc.doc_id")
    return scored(docs, labels).select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")

"""Conditional random field and multiple-instance learning against enumeration and finite differences; long texts."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import bpe, jaccard, quality, toxicity
from tapewright.llm.common import word_hashes


def enumerated(unary, trans):
    """Marginals and expected transitions of one chain, by all its labelings."""
    n = len(unary)
    total, good, seen = 0.0, np.zeros(n), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(u for u, x in zip(unary, labels) if x) + sum(trans[a, b] for a, b in itertools.pairwise(labels)))
        total += weight
        good += weight * np.array(labels)
        for a, b in itertools.pairwise(labels):
            seen[a, b] += weight
    return good / total, seen / total


@pytest.mark.parametrize("long_chain", [2048, 0])
def test_forward_backward_by_enumeration(monkeypatch, long_chain):
    monkeypatch.setattr(quality, "LONG_CHAIN", long_chain)
    rng = np.random.default_rng(3)
    sizes = [1, 8, 3, 1, 5, 7, 2]
    row = np.repeat(np.arange(len(sizes)), sizes)
    unary, trans = rng.normal(0, 2, len(row)), rng.normal(0, 1, (2, 2))
    got, expected = quality.forward_backward(unary, trans, row)
    each = [enumerated(unary[row == i], trans) for i in range(len(sizes))]
    assert np.allclose(got, np.concatenate([m for m, _ in each]))
    assert np.allclose(expected, sum(e for _, e in each))


def test_both_ways_on_a_long_chain(monkeypatch):
    rng = np.random.default_rng(4)
    row = np.repeat([0, 1, 2], [3000, 1, 50])
    unary, trans = rng.normal(0, 8, len(row)), rng.normal(0, 2, (2, 2))
    scanned = quality.forward_backward(unary, trans, row)
    monkeypatch.setattr(quality, "LONG_CHAIN", 1 << 40)
    stepped = quality.forward_backward(unary, trans, row)
    assert np.allclose(scanned[0], stepped[0]) and np.allclose(scanned[1], stepped[1])


def test_gradient_of_the_chain():
    """Expected less observed counts are the gradient of minus the log-likelihood."""
    rng = np.random.default_rng(5)
    unary, trans, labels = rng.normal(0, 1, 6), rng.normal(0, 1, (2, 2)), (1, 0, 0, 1, 1, 0)

    def loss(u, t):
        score = lambda x: sum(v for v, y in zip(u, x) if y) + sum(t[a, b] for a, b in itertools.pairwise(x))
        return np.log(sum(np.exp(score(x)) for x in itertools.product((0, 1), repeat=6))) - score(labels)

    m, expected = quality.forward_backward(unary, trans, np.zeros(6, int))
    seen = np.zeros((2, 2))
    for a, b in itertools.pairwise(labels):
        seen[a, b] += 1
    for i in range(6):
        d = np.eye(6)[i] * 1e-5
        assert (loss(unary + d, trans) - loss(unary - d, trans)) / 2e-5 == pytest.approx(m[i] - labels[i], abs=1e-6)
    for i, j in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[i, j] = 1e-5
        assert (loss(unary, trans + d) - loss(unary, trans - d)) / 2e-5 == pytest.approx((expected - seen)[i, j], abs=1e-6)


def test_document_scores_weigh_lines_by_length():
    lines = quality.Lines(pa.array(["ab\n\nabcdef\n", None, " \n ", "x"]))
    got = quality._raw_scores(np.array([0.2, 0.8, 0.4]), lines)
    assert np.allclose(got, [(2 * 0.2 + 6 * 0.8) / 8, 0.5, 0.5, 0.4])


def test_noisy_or_and_its_gradient():
    rng = np.random.default_rng(6)
    row, y = np.array([0, 0, 1, 3, 3, 3]), np.array([1, 0, 0, 1])
    z = rng.normal(-1, 1, 6)
    p = 1 / (1 + np.exp(-z))
    want = [1 - np.prod(1 - p[row == i]) for i in range(4)]
    assert np.allclose(toxicity._noisy_or(z, row, 4), want)
    loss, g = toxicity.loss_gradient(z, row, y)
    assert loss == pytest.approx(-sum(np.log(w) if t else np.log(1 - w) for w, t in zip(want, y)))
    for i in range(6):
        d = np.eye(6)[i] * 1e-5
        assert (toxicity.loss_gradient(z + d, row, y)[0] - toxicity.loss_gradient(z - d, row, y)[0]) / 2e-5 == pytest.approx(g[i], abs=1e-6)


def test_ties_and_repeated_rows_score_alike():
    texts = ["One fine day.\nIt rained.", "BUY!! NOW!!\n| a | b |"] * 40
    model = quality.fit(texts, np.array([1, 0] * 40))
    s = quality.score_texts([*texts, *texts[:2]], model)
    assert len(set(s[::2].tolist())) == len(set(s[1::2].tolist())) == 1 and s[0] > 0.5 > s[1]


def test_word_hashes_do_not_depend_on_how_words_are_worked_through(monkeypatch):
    from tapewright.llm import common

    raw = np.random.default_rng(7).integers(97, 101, 3000, np.uint8)
    starts = np.array([0, 1, 60, 300, 2000])
    ends = np.array([1, 50, 130, 1900, 3000])
    whole = word_hashes(raw, starts, ends)
    monkeypatch.setattr(common, "CHUNK", 100)
    assert whole.tolist() == word_hashes(raw, starts, ends).tolist() and len(set(whole.tolist())) == 5


LONG = ("The river ran past the old mill. " * 40 + "\n") * 38000  # 50 MB


def peak(f):
    tracemalloc.start()
    f()
    out = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out / len(LONG)


def test_memory_of_very_long_texts():
    """Bytes held at once for each byte of one text of 50 MB."""
    column = pa.array([LONG], pa.large_string())
    assert peak(lambda: quality.Lines(column)) < 16
    assert peak(lambda: jaccard.shingle_sets(column, 5)) < 16

    class Sent:
        value = (np.zeros(toxicity.BUCKETS, np.float32), -5.0)

    b = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([column], ["text"])], ["doc"])
    assert peak(lambda: list(toxicity._scored(Sent, 0.5)(iter([b])))) < 8
    assert sum(map(len, bpe.stretches(LONG))) == len(LONG) and max(map(len, bpe.stretches(LONG))) < 3 * bpe.LONG


def test_long_texts_in_parts_are_as_whole_ones(monkeypatch):
    rng = np.random.default_rng(8)
    words = ["it's", "né", "x1 22", "\n\n  \t", "...", "we'll", " ", "日本 語", "a.b?"]
    text = " ".join(words[i] for i in rng.integers(0, len(words), 600))
    with open(bpe.vocabulary_path(), "rb") as f:
        raw = f.read()
    batch = pa.RecordBatch.from_pydict({"text": [text], "doc_id": [1]})
    whole = next(bpe.encoded(iter([batch]), raw))
    sent = type("Sent", (), {"value": (rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), -2.0)})
    docs = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array([text], pa.large_string())], ["text"])], ["doc"])
    scored = next(toxicity._scored(sent, 0.5)(iter([docs])))
    monkeypatch.setattr(bpe, "LONG", 40)
    monkeypatch.setattr(toxicity, "LONG", 60)
    assert len(list(bpe.stretches(text))) > 20
    parts = next(bpe.encoded(iter([batch]), raw))
    assert parts.to_pydict() == whole.to_pydict()
    again = next(toxicity._scored(sent, 0.5)(iter([docs]))).to_pylist()[0]
    assert again["score"] == pytest.approx(scored.to_pylist()[0]["score"])
    assert [(x["start"], x["end"]) for x in again["offending"]] == [(x["start"], x["end"]) for x in scored.to_pylist()[0]["offending"]]

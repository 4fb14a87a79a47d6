import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tapewright.llm import repeats
from tapewright.llm.common import kept


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]]) if t else b""
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choices("abcdé \n", k=n))

    passages = [noise(rng.choice([150, 190, 199, 200, 201, 230, 420])) for _ in range(12)]
    out = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [noise(rng.randrange(250)), rng.choice(passages)[rng.randrange(3) :]]
        out.append((i, "".join(parts)))
    out += [(500, None), (501, ""), (502, "x" * 900), (503, "ab" * 300), (503, out[7][1]), (504, out[7][1]), (None, noise(400) * 2), (505, "x" * 199)]
    return out


def test_like_brute_force(spark, monkeypatch):
    for seed, many in ((1, 512), (2, 3), (3, 1)):
        monkeypatch.setattr(repeats, "SHARED_BY_MANY", many)
        r = rows(seed)
        got = repeats.digests(spark.createDataFrame(r, "doc_id long, text string")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute(r), key=str)


def test_pieces_of_long_texts(monkeypatch):
    rng = np.random.default_rng(4)
    raw = bytes(rng.integers(97, 101, 30000, np.uint8)).decode()
    b = pa.RecordBatch.from_pydict({"place": [1], "text": [raw]})
    whole = sorted(np.concatenate([np.asarray(x.column(0)) for x in repeats._hashes(iter([b.select([1])]))]).tolist())
    monkeypatch.setattr(repeats, "PIECE", 1000)
    parts = sorted(np.concatenate([np.asarray(x.column(0)) for x in repeats._hashes(iter([b.select([1])]))]).tolist())
    assert set(whole) <= set(parts)


def test_empty(spark):
    assert repeats.digests(spark.createDataFrame([], "doc_id long, text string, place string")).count() == 0


def test_keep_first(spark, monkeypatch):
    """Of all places of a 200-byte string one stays: what is left holds each string of the input once or in parts."""
    for many in (512, 1):
        monkeypatch.setattr(repeats, "SHARED_BY_MANY", many)
        r = rows(6)
        docs = spark.createDataFrame(r, "doc_id long, text string").coalesce(1)
        docs = kept(docs, "docs")
        got = repeats.removed(docs).select("doc.*", "left", "n_removed").collect()
        order = [t or "" for t in docs.toPandas().text]  # one file: places are in its order
        seen, want = set(), Counter()
        for t in (x.encode() for x in order):
            gone = np.zeros(len(t), bool)
            for i in range(len(t) - 199):
                if t[i : i + 200] in seen:
                    gone[i : i + 200] = True
                seen.add(t[i : i + 200])
            want[(t, bytes(np.frombuffer(t, np.uint8)[~gone]))] += 1
        assert Counter(((x.text or "").encode(), bytes(x.left)) for x in got) == want
        assert any(x.n_removed for x in got)


def test_factor_arrays():
    """The longest previous factor of every place against comparison with all others."""
    rng = np.random.default_rng(5)
    for depth, letters, n in ((16, 2, 300), (40, 3, 260), (200, 1, 450), (8, 4, 120)):
        raw = rng.integers(97, 97 + letters, n, np.uint8)
        at = np.arange(n - depth + 1)
        position = rng.permutation(len(at)) // 2  # some places are the same text
        raw = raw if letters == 1 else np.concatenate([raw[: n // 2], raw[: n - n // 2]])
        factor, source = repeats.longest_previous(repeats.Suffixes(raw, depth), at, position)
        full, again = repeats.longest_previous(repeats.Suffixes(raw, depth), at, position, False)

        def common(i, j):
            d = np.flatnonzero(raw[i : i + depth] != raw[j : j + depth])
            return int(d[0]) if len(d) else depth

        for i in at.tolist():
            assert factor[i] == max((common(i, j) for j in at.tolist() if position[j] < position[i]), default=0)
        assert (full == np.where(factor == depth, depth, 0)).all() and (source == again).all()
        # A source has a later copy; of copies, one at each position is a source or has a previous factor.
        copies = [{position[j] for j in at.tolist() if common(i, j) == depth} for i in at.tolist()]
        assert all(max(copies[i]) > position[i] for i in np.flatnonzero(source).tolist())
        known = {position[i] for i in at.tolist() if source[i] or factor[i] == depth}
        assert known == {position[i] for i in at.tolist() if len(copies[i]) > 1}


def test_nearest_smaller():
    rng = np.random.default_rng(1)
    for p in (rng.integers(0, 9, 200), np.arange(50), np.arange(50)[::-1], np.zeros(30, int)):
        want = [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(len(p))]
        assert repeats.nearest_smaller(p).tolist() == want


def test_strings_that_polynomial_hashes_confuse(spark):
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    y = x.translate(str.maketrans("ab", "ba"))
    r = [(1, x[:256]), (2, y[:256]), (3, "q" + x[100:400]), (4, "r" + y[100:400])]
    got = repeats.digests(spark.createDataFrame(r, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(r))
    raw = np.frombuffer((x + y).encode() * 3, np.uint8)
    h = repeats.string_hashes(raw, 100)
    assert len(set(h.tolist())) == len({raw[i : i + 100].tobytes() for i in range(len(h))})


def test_ends_of_tasks():
    """Neighbours in one task, over batches of any size."""
    rng = np.random.default_rng(2)
    k = np.sort(rng.integers(0, 30, 60))
    t = pa.RecordBatch.from_pydict({"k1": k, "k2": k % 3, "class": np.arange(60), "off": np.arange(60, dtype=np.int32)})
    for step in (1, 7, 60):
        got = pa.Table.from_batches(list(repeats._neighbours(iter([t.slice(i, step) for i in range(0, 60, step)])))).to_pylist()
        found = {r["class"]: (r["earlier"], r["later"]) for r in got if r["earlier"] or r["later"]}
        n = Counter(k.tolist())
        assert set(found) == {i for i in range(60) if n[k[i]] > 1}
        assert all(found[i] == (i > 0 and k[i - 1] == k[i], i < 59 and k[i + 1] == k[i]) for i in found)
        assert [r["class"] for r in got if r["edge"]] == [0, 59]

import hashlib
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tapewright.llm import passages
from tapewright.llm.common import kept

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def plain(rows, size):
    """Windows as tuples of words in a dictionary."""
    words = [SPLIT.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((key, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs, *shape):
    return sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in passages.removed(docs, False, passages.Shape(*shape)).collect()), key=str)


def corpus(seed, size, n):
    """Copies, copies with edits, shared passages, periodic texts, passages that branch at both ends."""
    rng = random.Random(seed)
    word = lambda: rng.choice(("a", "b", "é", "ß漢", "long-ish", "x.", "🙂")) + str(rng.randrange(40))
    stock = [[word() for _ in range(rng.randrange(size - 2, 4 * size))] for _ in range(6)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            part = list(rng.choice(stock)) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(2 * size))]
            if rng.random() < 0.4 and part:
                part[rng.randrange(len(part))] = word()
            if rng.random() < 0.3:
                part = part[rng.randrange(len(part) + 1) :]
            w += part
        texts.append(rng.choice((" ", "\n", " \t ")).join(w))
    texts += ["", None, " \x0b ", "same " * (size * 3), "same " * (size + 1), "p q r " * size, "q r p " * size, "same " * (size - 1)]
    texts += ["\xa0".join(["no", "break"]) + " " + "z " * 5, *texts[:3], *texts[:1]]
    return [(None if k % 13 == 6 else k // 2, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("size", "gram", "block"), [(35, 12, 64), (8, 3, 5), (5, 2, 3)])
def test_like_plain(spark, size, gram, block):
    rows = corpus(size, size, 90)
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, gram, block)
    assert got == plain(rows, size)
    assert sum(r[2] > 0 for r in got) > 20 and any(0 < r[2] < r[1] for r in got)


def test_sql_states_the_same(spark):
    rows = corpus(1, 35, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(passages.SQL).fetchall(), key=str) == plain(rows, 35)


def test_small_inputs(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, "p"), (1, text, 6, "q"), (None, "short", 7, None)], "doc_id long, text string, n_words long, place string")
    rows = sorted(passages.removed(docs).collect(), key=lambda r: r.doc.n_words)
    assert [(r.doc.n_words, r.doc.place, r.n_words, r.n_removed, r.left) for r in rows] == [(5, "p", 40, 40, ""), (6, "q", 40, 40, ""), (7, None, 1, 0, "short")]
    assert passages.removed(docs.limit(0)).count() == 0
    assert passages.removed(docs.where("n_words > 5")).where("n_removed > 0").count() == 0


def test_paths_are_compacted(spark):
    """A passage of 900 words in three documents, in a fourth up to its middle, and a cycle: paths do not end but where the graph branches."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    rows = [(i, f"start{i} " + " ".join(words) + f" end{i}") for i in range(3)] + [(4, "start4 " + " ".join(words[:450]) + " end4"), (5, "p q r " * 40)]
    graph = passages.Graph(kept(spark.createDataFrame(rows, "doc_id long, text string"), "docs"))
    found = sorted((r.n_words, r.n_documents) for r in graph.passages().collect())
    assert len([f for f in found if f[0] > 60]) <= 4
    assert max(f[0] for f in found) > 430 and sum(f[0] for f in found if f[1] >= 3) >= 800
    assert graph.spans().where("m > 400").count() >= 3


def test_chains_and_cycles(spark):
    rng = random.Random(4)
    links = [(i, i + 1, 3) for i in range(100)] + [(1000 + i, 1000 + (i + 1) % 37, 2) for i in range(37)] + [(2000, 2000, 9), (3000, 3001, 1), (3000, 3002, 1), (3001, 3005, 1), (3002, 3005, 1)]
    rng.shuffle(links)
    got = {r.node: (r.path, r.at) for r in passages.compacted(kept(spark.createDataFrame(links, "a long, b long, m long"), "links")).collect()}
    want = {i: (0, 3 * i) for i in range(101)} | {1000 + i: (1000, 2 * i) for i in range(37)} | {2000: (2000, 0)}
    assert got == want


def test_pieces_that_differ_from_their_source_stay():
    """A digest that collided would be found out by the words."""
    piece = lambda word, source: {"word": word, "n": len(source.split()), "source": source}
    kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int32()), ("source", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a  b c\td é"]), pa.array([[piece(0, "a b"), piece(2, "x d"), piece(4, "é")]], kind)], ["doc", "text", "pieces"])
    (out,) = passages._cut(True)(iter([batch]))
    assert (out.column(2).to_pylist(), out.column(4).to_pylist()) == ([3], ["c d"])

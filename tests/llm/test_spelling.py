import random
import re
import zlib
from collections import Counter

import pytest

from tapewright.llm import spelling
from tapewright.llm.common import kept

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counted(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    out, form = [], {}
    for w, n in words.items():
        near = [v for v in words if is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out.append([w, form[w], None, n, len(near), words[form[w]] if form[w] else None])
    for row in out:
        last = row[0]
        while form[last]:
            last = form[last]
        row[2] = last
    return sorted(map(tuple, out))


def edited(w, rng, alphabet):
    i = rng.randrange(len(w) + 1)
    return rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]))


@pytest.mark.parametrize("most", [64, 7, 9, 12])
def test_like_all_pairs(spark, monkeypatch, most):
    """Words near each other in many ways, above and below the length at which the trie ends."""
    monkeypatch.setattr(spelling, "LONG", most)
    rng = random.Random(most)
    words = {"".join(rng.choices("abé", k=rng.randrange(7, 13))) for _ in range(120)} | {"a" * k for k in range(7, 14)}
    words |= {e for w in list(words) for e in (edited(w, rng, "abcÿ÷") for _ in range(3)) if len(e) >= 7}
    counts = {w: rng.choice((2, 2, 3, 20, 200, 2000)) for w in words}
    df = kept(spark.createDataFrame(list(counts.items()), "word string, n long"), "given")
    got = sorted(map(tuple, spelling.grouped(df).collect()), key=lambda r: r[0])
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got] == plain(counts)
    assert len([r for r in got if r[1]]) > 20 and len({r[2] for r in got if r[2] != r[1]}) > 1


def test_documents_like_plain(spark):
    rng = random.Random(2)
    base = ["Straßenbahn", "información", "THEREFORE", "ÀÉÎõüÿ×÷ab", "neighbour", "neighbor", "colouring", "coloring", "x" * 300, "y" * 299 + "z"]
    rows = []
    for k in range(400):
        text = rng.choice((" ", "-", "1", "\n", "ĀĀ")).join(rng.choices(base, weights=[9, 9, 9, 3, 30, 2, 40, 3, 2, 2], k=rng.randrange(60)))
        rows.append((None if k % 17 == 3 else k // 2, text))
    rows += [(1, None), (1, ""), (2, "neighbour " * 30000), (-5, "Ã" * 10), (-5, "Ã" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.variants(docs.selectExpr("*", "text as word", "1 as n"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain(counted(rows))


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, "lonelyword lonelyword")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, spelling.variants(docs).collect())) == plain(counted(rows))


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    assert {r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()} == {"w40"}

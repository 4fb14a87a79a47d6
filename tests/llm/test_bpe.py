import random

import numpy as np
import pytest

from tapewright.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def raw():
    return open(bpe.vocabulary_path(), "rb").read()


@pytest.fixture(scope="module")
def library(raw):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.merger(raw).ranks, special_tokens={})


def ids(texts, raw):
    get = bpe.merger(raw).__getitem__
    return [np.frombuffer(b"".join(map(get, p)), "<u4").tolist() for p, _ in bpe.pieces_of(texts)]


def test_like_the_library(raw, library):
    rng = random.Random(5)
    alphabet = list("aabst're vell'  \n\t 　\x1c1234²Ⅷé漢字🙂.,!?-'''_\x00") + ["'s", "'ll", "'d", " '", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(4000)]
    texts += ["", " ", "\n", "a" * 5000, "é" * 900, " " * 700 + "x", "!" * 1000, "ab" * 700 + "12" * 300, "'"]
    assert ids(texts, raw) == [library.encode_ordinary(t) for t in texts]
    assert all(bpe.decoded(np.array(i), raw) == t.encode() for t, i in zip(texts, ids(texts, raw)))


def test_query_rows(spark, tmp_path, raw, library):
    import hashlib

    rows = [(1, "It's a test"), (2, None), (3, ""), (3, "ab  c"), (None, "x" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = sorted(map(tuple, bpe.digests(df, bpe.vocabulary_path()).collect()), key=str)
    want = []
    for d, t in rows:
        i = library.encode_ordinary(t or "")
        want.append((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    out = bpe.encode(df.selectExpr("*", "'k' as ids", "1 as extra"), bpe.vocabulary_path())
    assert out.columns == ["doc_id", "extra", "ids", "offsets"]
    assert out.count() == 5 and bpe.encode(df.limit(0), bpe.vocabulary_path()).count() == 0

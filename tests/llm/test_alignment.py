import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tapewright.llm import alignment, bpe

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(rows, libraries):
    """Every row by the libraries themselves: ends as sets, links from all pairs of byte ranges of a group."""
    a, b = libraries
    of = alignment._byte_of()
    found, counts = [], Counter()
    for key, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_x = [bytes(map(of.__getitem__, a.id_to_token(i))) for i in x]
            bytes_y = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
            if b"".join(bytes_x) == b"".join(bytes_y) == (" " + text).encode():
                n = len(x), len(y)
                ends = []
                for parts in (bytes_x, bytes_y):
                    total, e = 0, []
                    for p in parts:
                        total += len(p)
                        e.append(total)
                    ends.append(e)
                i = j = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
                    groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
                    links += [(x[u], y[v]) for u in range(i, p) for v in range(j, q) if ends[0][u] > ends[1][v] - len(bytes_y[v]) and ends[1][v] > ends[0][u] - len(bytes_x[u])]
                    i, j = p, q
        counts.update(links)
        found.append((key, n, groups, links))
    best = defaultdict(int)
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    out = []
    for key, n, groups, links in found:
        text = ";".join(groups)
        out.append((key, *n, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return sorted(out, key=str)


def hostile(n, seed):
    rng = random.Random(seed)
    alphabet = list("aabst're vell'  \n\t 　\x1c\x001234²Ⅷé漢字🙂.,!?-'_▁ﬁé") + ["'s", "'ll", " '", "don't", "<|endoftext|>", "<s>", "<unk>", "<0x41>", " the", " information", "ation", "  ", "\r\n"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(n)]


def test_like_all_pairs(spark, libraries):
    prose = ["The quick brown fox doesn't jump over 12345 lazy dogs; información sobre el año.", "It's over. " * 30, "unbelievablyLongIdentifierWithoutBlanks_" * 20, "x" * 3000, " " * 500 + "a", "a b " * 400]
    texts = [None, "", " ", "\n", *prose, *prose[:2], *hostile(150, 3)]
    rows = [(None if k % 11 == 5 else k // 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.align(docs, *alignment.files(), groups=True, block=500)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    want = plain(rows, libraries)
    assert sorted(((r.doc.doc_id, *(r[k] for k in names)) for r in got.collect()), key=str) == want
    assert any(w[1] for w in want) and sum(not w[1] for w in want) > 3


def test_small_inputs(spark):
    docs = spark.createDataFrame([(1, "a text", 7, "p", 0)], "doc_id long, text string, n_a long, pairs string, block int")
    out = alignment.align(docs, *alignment.files()).collect()
    assert [(r.doc.n_a, r.doc.pairs, r.doc.block, r.n_groups, r.groups) for r in out] == [(7, "p", 0, 2, None)]
    assert alignment.align(docs.limit(0), *alignment.files()).count() == 0


def test_long_runs_are_skipped():
    """A one-to-one stretch costs a few comparisons of slices, not one for each token."""

    class Seen(list):
        n = 0

        def __getitem__(self, k):
            Seen.n += 1
            return super().__getitem__(k)

    n = 1 << 16
    groups = alignment.Groups()
    a, b = groups.add((Seen(range(1, n + 1)), list(range(1, n + 1))), ([1] * n, [2] * n), (["0", "1"], ["0", "1", "2"]))
    assert groups.n == n == len(a) == len(b) and Seen.n < 80


def test_a_text_of_megabytes_in_parts(libraries):
    aligner = alignment.Aligner(*alignment.files())
    text = "Die Straße führt over the hills, and 1024 words aren't enough. " * 40000
    n_a, n_b, n_groups, _, _, pairs = aligner.of(text, False)
    assert (n_a, n_b) == (len(libraries[0].encode(" " + text, add_special_tokens=False).ids), len(libraries[1].encode(text)))
    assert len(pairs) == n_a + n_b - n_groups and len(text) > 2 * bpe.LONG


def test_runs_take_no_memory_or_step_of_their_own():
    """Between irregular groups tokens are written out in one go: ids of a run are never looked at one by one."""

    class Once(list):
        n = 0

        def __getitem__(self, k):
            Once.n += 1
            return super().__getitem__(k)

    n = 1 << 14
    names = [str(k) for k in range(10)]
    ids = Once([3] * n + [4, 5]), Once([6] * n + [7])
    groups = alignment.Groups(text=True)
    a, b = groups.add(([*range(1, n + 3)], [*range(1, n + 1), n + 2]), ids, (names, names))
    assert Once.n == 0 and groups.n == n + 1 and "".join(groups.text) == "3|6;" * n + "4,5|7"
    assert Counter(zip(a.tolist(), b.tolist(), strict=True)) == {(3, 6): n, (4, 7): 1, (5, 7): 1}
    groups.add(([1], [1]), ([1], [2]), (names, names))
    assert "".join(groups.text).endswith("4,5|7;1|2") and groups.digest.hexdigest() == hashlib.sha256("".join(groups.text).encode()).hexdigest()

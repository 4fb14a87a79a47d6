"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables, and columns whose names clash with its own."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import chat, decontaminate, exact_dedup, quality, toxicity, warc
from tapewright.llm.common import held_out

DOCS = "doc_id long, text string, lang string, doc string, place string, score double, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, None, "x", None, None, "y") for d, t in rows], DOCS)


ROWS = [(1, "Same Text"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (None, "SAME TEXT"), (5, "É"), (6, "é"), (7, "word " * 40000), (8, "only this")]


def test_exact_dedup(spark):
    got = exact_dedup.decisions(docs(spark, ROWS)).collect()
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for r in got:
        same = [d for d, t in ROWS if hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((d for d in same if d is not None), default=None)
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({norm(t) for _, t in ROWS})
    left = exact_dedup.deduplicated(docs(spark, ROWS))
    assert left.columns == [c.split(" ")[0] for c in DOCS.split(", ")]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [2, 4, 5, 6, 7, 8]))
    assert exact_dedup.decisions(docs(spark, [])).count() == 0 and exact_dedup.deduplicated(docs(spark, [])).count() == 0


def test_exact_dedup_filter_of_the_least_size(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 64)  # full: every row shuffles, the result is the same
    rows = [(i, f"t{i % 60}") for i in range(200)]
    monkeypatch.setattr(exact_dedup, "ranges_for", lambda n: 1)
    got = exact_dedup.decisions(docs(spark, rows)).collect()
    assert all(r.keep_id == max(i for i, t in rows if t == f"t{r.doc_id % 60}") for r in got) and sum(r.kept for r in got) == 60


@pytest.mark.parametrize("most,ranges", [(1 << 28, 1), (1 << 9, 7)])
def test_exact_dedup_by_ranges(spark, monkeypatch, most, ranges):
    monkeypatch.setattr(exact_dedup, "MOST_BITS", most)
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 64)
    rows = [(i, f"t{i % 60}" if i < 120 else f"single {i}") for i in range(200)]
    assert exact_dedup.ranges_for(len(rows)) == ranges
    got = exact_dedup.decisions(docs(spark, rows)).collect()
    assert len(got) == 200 and sum(r.kept for r in got) == 140
    assert all(r.keep_id == (60 + r.doc_id % 60 if r.doc_id < 120 else r.doc_id) and r.group_size == (2 if r.doc_id < 120 else 1) for r in got)
    assert sorted(r.doc_id for r in exact_dedup.deduplicated(docs(spark, rows)).collect()) == list(range(60, 200))


ITEMS = [(1, "a b c d e f g h i j k l m"), (2, "x Y z"), (3, None), (4, ""), (5, "..."), (6, "b c d e f g h i j k"), (None, "x y z"), (7, "p p p p p p p p p p p p")]


def brute(rows, items):
    import re

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH_WORDS", 7)
    rows = ROWS + [(20, "q A b, c d e f g h i j k l r x y z"), (21, "a b c d e f g h i"), (22, "x-y-z!"), (23, "p " * 50), (24, "0 a b c d e f g h i j k l m n x y z x y z " * 3), (20, None)]
    items = spark.createDataFrame([(i, t, "c") for i, t in ITEMS], "item_id long, text string, words string")
    got = decontaminate.contamination(docs(spark, rows), items).drop("place").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, ITEMS), key=str)
    left = decontaminate.clean(docs(spark, rows), items)
    assert left.count() == sum(not r[-1] for r in brute(rows, ITEMS)) and left.columns[3] == "doc"
    none = items.limit(0)
    assert decontaminate.contamination(docs(spark, rows), none).where("contaminated").count() == 0
    assert decontaminate.contamination(docs(spark, []), items).count() == 0


def test_toxicity_and_quality(spark):
    good, bad = "The river ran past the old mill. Nothing else moved there.", "You are a vile zork. Go away."
    junk = "BUY!! NOW!! " * 30 + "\n" + "a | b | c | d | e | f | g | h\n" * 5
    rows = [(i, (bad if i % 3 == 0 else good) + f" It was day {i}.") for i in range(300)] + [(400 + i, junk if i % 2 else good * 3) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "..."), (None, bad), (903, "word " * 50000), (903, bad)]
    labels = spark.createDataFrame([(i, int(i >= 400 and i % 2 == 0 or i < 400), int(i < 400 and i % 3 == 0), "z") for i in range(300)] + [(400 + i, int(i % 2 == 0), 0, "z") for i in range(200)] + [(None, 1, 1, ""), (5000, None, None, "")], "doc_id long, quality int, toxic int, text string")
    t = {(r.doc.doc_id, r.doc.text): r for r in toxicity.scored(docs(spark, rows), labels).collect()}
    assert all((t[i, x].score >= 0.5) == (i % 3 == 0) for i, x in rows[:300])
    assert t[900, None].score == t[901, ""].score == t[902, "..."].score == 0
    span = t[3, rows[3][1]].offending[0]
    assert "zork" in rows[3][1][span.start : span.end]
    kept = toxicity.clean(docs(spark, rows), labels)
    assert kept.columns == [c.split(" ")[0] for c in DOCS.split(", ")] and kept.where(F.col("text").contains("zork")).count() == 0
    q = {(r.doc.doc_id, r.doc.text): r.score for r in quality.scored(docs(spark, rows), labels).collect()}
    assert all((q[i, x] >= 0.5) == (i % 2 == 0) for i, x in rows[300:500])
    assert q[900, None] == q[901, ""] and 0 <= q[901, ""] <= 1
    for m, col in ((toxicity, "toxic"), (quality, "quality")):
        assert m.scored(docs(spark, []), labels).count() == 0
        assert {r.score for r in m.scored(docs(spark, rows[:3]), labels.limit(0)).collect()} <= {0.0, 0.5}


def test_held_out(spark):
    ids = spark.createDataFrame([(i,) for i in [0, 1, 2, 77, 10**12, -5]] + [(None,)], "i long")
    for r in ids.select("i", held_out(F.col("i")).alias("h")).collect():
        assert r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 5 == 0)


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 40)
    rows = [(1, 0, "system", "be <turn x>\n good"), (1, 1, "user", None), (1, 2, "assistant", "\\### </turn>\n ok é🙂"), (1, 2, "assistant", "b"), (2, 0, None, ""), (None, 0, "a>b\n", "x" * 500), (3, 5, "assistant", ""), (3, 5, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.as_parts(F.col("text")))
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    for c in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine).encode()).hexdigest()
        loss = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_chat_parts(spark):
    row = [(1, 0, "user", [("text", "see <here>", None, None), ("image", None, "s3://a.png", 2), ("document", None, "b.pdf", 3), ("text", "and", None, None)]), (1, 1, "assistant", [("audio", None, "c.wav", None), ("text", "fine", None, None)])]
    r = chat.formatted(spark.createDataFrame(row, f"conv_id long, turn long, role string, parts {chat.PARTS}")).collect()
    text = "".join(x.formatted for x in r)
    assert text == "<turn user>\nsee \\<here><image 1><document 2>and</turn>\n<turn assistant>\n<audio 3>fine</turn>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for x in r for a in x.attachments] == [(1, "image", "s3://a.png", 512), (2, "document", "b.pdf", 1536), (3, "audio", "c.wav", 25)]
    assert [r[0].formatted[s.start : s.end] for s in r[0].loss] == ["fine"]
    assert list(chat.turns(text)) == [("user", "see <here>and"), ("assistant", "fine")]
    with pytest.raises(ValueError):
        list(chat.turns("<turn user>\nhi <turn x>"))


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    big = "é" * 600
    rows = [(i, f"http://www.h{i % 3}.example.com:8080/p?q={i % 5}", big if i % 4 == 0 else f"page {i}\r\n\r\n") for i in range(40)] + [(50, None, None), (51, "", ""), (52, "http://h/\n", big), (None, "::bad::[", "x" * 1200), (53, "u", "x" * 1200), (53, "u", "x" * 1200)]
    rows.append((60, "http://long.example/", "<p>é</p>\n" * 400_000))  # over 3 MB
    pages = spark.createDataFrame([(*r, "c", "k", "a") for r in rows], "page_id long, url string, html string, payload string, key string, archive string")
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, folder)
    files = warc.build_index(manifest, f"{folder}/index")
    got = warc.read_records(warc.lookup(manifest.select("key").distinct(), f"{folder}/index", files), folder).collect()
    assert len(got) == len(rows)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        top = max((q for q, _, x in rows if q is not None and (x or "").encode() == raw), default=None)
        again = len(raw) >= 1000 and sum((x or "").encode() == raw for _, _, x in rows) > 1 and p != top
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    one = spark.createDataFrame([(warc.surt(rows[7][1]),), ("none,such)/",)], "key string")
    found = warc.lookup(one, f"{folder}/index", files).collect()
    assert sorted(r.page_id for r in found) == [i for i, u, _ in rows[:40] if warc.surt(u) == warc.surt(rows[7][1])]
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.build_index(empty, f"file://{tmp_path}/e/index") == []


def test_surt():
    assert warc.surt("HTTP://www.Example.COM/A b?x") == "com,example)/a%20b?x"
    assert warc.surt(None) == ")/"


def reference_pipeline(rows, labels, benchmark):
    """The five stages in plain Python, each on all rows and pairs; only the fitted model of the first is shared."""
    import tiktoken
    from tapewright.llm import bpe

    rows_known = sorted((t, q) for d, t in rows for e, q in labels if d == e and zlib.crc32(str(d).encode()) % 5)
    score = toxicity.score_texts([t or "" for _, t in rows], toxicity.fit([t or "" for t, _ in rows_known], np.array([q for _, q in rows_known])))
    docs = [r for r, s in zip(rows, score) if s < 0.5]
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [(d, t) for d, t in docs if d == max(e for e, u in docs if lower(u) == lower(t))]
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    docs = [(d, t) for (d, t), g in zip(docs, group) if d == min(e for (e, _), h in zip(docs, group) if h == g)]
    docs = [r for r, x in zip(docs, brute(docs, benchmark)) if not x[-1]]
    with open(bpe.vocabulary_path(), "rb") as f:
        ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    import public_tokenizers

    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in docs:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        out.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 6)))
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (2, base.upper()), (3, base + " extra"), (4, "clean text of its own"), (5, None), (6, ""), (7, "a b c d e f g h i j k"), (8, "You vile zork. Leave."), (9, "Nothing at all here")]
    for i in range(60):  # copies, near copies, and texts with a passage of the benchmark
        w = [word() for _ in range(60)]
        rows += [(100 + 10 * i, " ".join(w)), (101 + 10 * i, " ".join(w).upper()), (102 + 10 * i, " ".join(w[: -(i % 9) or None]))]
        if i % 5 == 0:
            rows += [(103 + 10 * i, " ".join(w[:20]) + " A b c d e f g h i j " + " ".join(w[30:])), (104 + 10 * i, " ".join(w) + ". You vile zork.")]
    train = [(1000 + i, ("You vile zork. " if i % 3 == 0 else "A calm day. ") + f"number {i}") for i in range(200)]
    labels = [(1000 + i, int(i % 3 == 0)) for i in range(200)]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows + train], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, q) for d, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "A B C D E F G H I J")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "byte_bpe"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == sorted(reference_pipeline(rows + train, labels, [(1, "A B C D E F G H I J")]))
    mine = {r[0] for r in got}
    assert {2, 4, 6, 9} <= mine and not mine & {1, 3, 5, 7, 8}


def test_words_of_arrays():
    w = decontaminate.Words(*__import__("tapewright.llm.common", fromlist=["utf8"]).utf8(pa.array(["Ab c", None, "d", ""])))
    assert w.bounds.tolist() == [0, 2, 2, 3, 3] and w.text(0, 2) == "ab c" and len(np.unique(w.hashes)) == 3

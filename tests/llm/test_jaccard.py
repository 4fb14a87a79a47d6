import random
import re
import time
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapewright.llm import common, jaccard
from tapewright.sources import scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, t):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(i)
    least = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in group.items()}
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 6)))
    base = [word() for _ in range(150)]
    out = []
    for i in range(160):  # near copies around the threshold
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 2])] = [word() for _ in range(rng.choice([0, 1, 1, 2]))]
        out.append((i, " ".join(w)))
    passage = " ".join(word() for _ in range(40))
    out += [(1000 + i, " ".join(word() for _ in range(60)) + " " + passage) for i in range(60)]
    out += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, out[5][1].upper()), (2006, out[5][1]), (None, out[7][1]), (2007, "la " * 400), (2008, "la " * 500)]
    return out


@pytest.mark.parametrize("seed,k,t,members", [(1, 3, 90, 64), (2, 3, 90, 4), (3, 5, 80, 4), (4, 3, 90, 1)])
def test_like_brute_force(spark, monkeypatch, seed, k, t, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    r = rows(seed)
    got = jaccard.near_groups(spark.createDataFrame(r, "doc_id long, text string"), k, t).drop("place", "stays").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(r, k, t), key=str)


def test_one_of_each_group_stays(spark):
    r = rows(1)
    df = spark.createDataFrame([(*x, "v") for x in r], "doc_id long, text string, place string")
    kept = jaccard.deduplicated(df, 3, 90)
    assert kept.columns == df.columns
    groups = {g for _, n, g in brute(r, 3, 90) if n}
    empty = sum(1 for _, n, _ in brute(r, 3, 90) if not n)
    assert kept.count() == len(groups) + empty
    assert jaccard.near_groups(df.limit(0), 3, 90).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(4096), thue_morse(4096, "b", "a")
    many = [thue_morse(1024, "u ", "v "), thue_morse(1024, "v ", "u ")]  # the same as sequences of words
    r = [(1, x), (2, y), (3, f"x {x} z"), (4, f"x {y} z"), (5, many[0]), (6, many[1]), (7, f"x y {x} z w"), (8, f"x y {y} z w")]
    got = jaccard.near_groups(spark.createDataFrame(r, "doc_id long, text string"), 3, 90).drop("place", "stays").collect()
    assert sorted(map(tuple, got)) == sorted(brute(r, 3, 90))


def test_clusters_that_share_a_template(spark, monkeypatch):
    """Two groups of near copies of one template, a passage that unrelated texts share, and texts that hold the template."""
    monkeypatch.setattr(jaccard, "MEMBERS", 3)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    template = [word() for _ in range(120)]
    ends = [[word() for _ in range(40)] for _ in range(2)]
    out = []
    for i in range(50):
        for g in (0, 1):
            w = template + ends[g]
            w = list(w)
            w[rng.randrange(len(w))] = word()
            out.append((len(out), " ".join(w)))
    out += [(500 + i, " ".join([word() for _ in range(20)] + template[:30] + [word() for _ in range(rng.choice([5, 60]))])) for i in range(30)]
    out += [(600 + i, " ".join(template + [word() for _ in range(200)])) for i in range(5)] + [(700, " ".join(template[:100]))]
    got = jaccard.near_groups(spark.createDataFrame(out, "doc_id long, text string"), 3, 90).drop("place", "stays").collect()
    assert sorted(map(tuple, got)) == sorted(brute(out, 3, 90))


def test_components(spark):
    from tapewright.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_each_pair_once(spark):
    rows = [(1, 2, 0), (2, 1, 0), (2, 1, 1), (3, 4, 0), (5, 4, 0), (6, 7, 1), (7, 6, 1)]
    got = sorted(map(tuple, jaccard._once(spark.createDataFrame(rows, "a long, b long, wide int")).collect()))
    assert got == [(2, 1, 1), (3, 4, 0), (5, 4, 0), (6, 7, 3)]


def test_prefixes_of_unrelated_texts_share_nothing(spark, monkeypatch):
    """A sketch of shingles that is as full as at many GB: texts of common words that each hold some words of their own."""
    monkeypatch.setattr(jaccard, "COUNTERS", 1 << 13)
    rng = random.Random(4)
    common_words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(20)]
    docs = [(i, " ".join(f"w{i}x{j}" if j % 12 == 5 else rng.choice(common_words) for j in range(60))) for i in range(800)]
    join = jaccard.Join(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90)
    met = join.signed.select("class", F.explode("prefix").alias("h")).groupBy("h").count().where("count > 1")
    assert met.count() == 0
    assert join.roots().count() == 0


def test_tables_that_nothing_reads_again_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_placed", [])
    docs = common.kept(spark.createDataFrame(rows(1), "doc_id long, text string"), "docs")
    got = jaccard.near_groups(docs, 3, 90)
    there = sorted(Path(p).name.rsplit("-", 1)[0] for p in scratch._placed if Path(p.removeprefix("file://")).exists())
    assert len(there) == len(scratch._placed) <= 16
    assert not {"prefixes", "buckets", "shared", "candidates", "pairs", "stars", "open_members", "signs", "differences", "links"} & set(there)
    assert got.count() == docs.count()


def test_what_a_write_shuffled_is_deleted(spark):
    files = lambda: sum(x.getName().startswith("shuffle_") for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before, df = files(), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert common.kept_alone(df, "x").count() == 7
    until = time.time() + 10
    while files() > before + 10 and time.time() < until:
        time.sleep(0.2)
    first = files()
    common.kept(df, "x")
    assert first < files()
    assert spark.conf.get(common.CLEAN_UP, None) is None


def test_shingles_of_one_class_are_not_grouped(spark, monkeypatch):
    """What one class alone has is filtered out before rows of prefixes are shuffled."""
    seen = {}
    write = jaccard.kept_alone
    monkeypatch.setattr(jaccard, "possibly", lambda df, held, key, f=jaccard.possibly: seen.setdefault(len(seen), f(df, held, key)))
    monkeypatch.setattr(jaccard, "kept_alone", lambda df, name, *a: seen.__setitem__("met", (df.count(), seen[0].count())) or write(df, name, *a) if name == "buckets" else write(df, name, *a))
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(60)] + [(100 + i, " ".join(f"v{j}" for j in range(50)) + f" u{i}") for i in range(3)]
    got = jaccard.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()
    assert sorted(r.component_id for r in got if r.doc_id >= 100) == [100] * 3
    assert 0 < seen["met"][0] <= seen["met"][1] < 40  # of 60 * 6 rows of texts that share nothing


def test_the_stage_of_the_pipeline_leaves_no_tables_behind(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_placed", [])
    docs = common.kept(spark.createDataFrame(rows(1), "doc_id long, text string"), "docs")
    assert jaccard.deduplicated(docs, 3, 90).count() < docs.count()
    there = {Path(p).name.rsplit("-", 1)[0] for p in scratch._placed}
    assert not {"sets", "classes", "class_components"} & there

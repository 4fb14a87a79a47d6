"""Personal data by boosted trees over proposed spans; DataFrame functions only.

1. Generators of high recall propose spans of five kinds, which may overlap: the base patterns, and looser forms - numbers
   grouped like a phone without a plus, mail addresses with a written-out at sign, and long runs of letters and digits, which
   may be secrets. They run inside zones - runs of the characters that such spans are made of - so each text is passed over a
   few times however many patterns there are.
2. Each proposal has format features (digits, groups, signs, mixture of letters and digits) and context features (words and
   characters around it). No feature is a check.
3. There are no labels of personal data, so checks that the trees do not see label the proposals: Luhn's sum of a card, the
   octets of an address, the length of a phone with a plus and the numbering rule of one without, the last label of a mail
   address. A secret is right where it is assigned to a name such as token or password and wrong where letters and digits
   hardly mix; others of that kind have no label and play no part in fitting. Gradient-boosted trees are fit on one half of
   all labelled proposals, equal ones as one row with their count as weight, and become one SQL expression.
4. On the other half each kind gets the lowest threshold at which PRECISION or more of the proposals that are no base span are
   right; a kind without such proposals takes all of its proposals for that.
5. Base spans whose checks pass always stay; of the rest, proposals over the threshold that overlap no span are added. So
   a secret is found by its form also where nothing names it, and a number that fails its check is not added.

Null and empty texts have no spans. Rows with equal doc_id are treated each by itself. Positions are code points, end
exclusive. Without proposals of both labels nothing is added to the base spans.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import kept, table

PRECISION = 0.99
TREES, DEPTH = 10, 3
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
MIXED = 4  # changes between letters and digits in what may be a secret
ENOUGH = 20  # proposals that are no base span, for a threshold of their own

# The base patterns, with possessive repeats and start conditions that keep their matches and avoid rescanning.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms.
LOCAL = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
WRITTEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"
NAMED = r"(?:token|secret|passw(?:or)?d|passwort|pwd|key|credential|auth)[\"']?\s*[:=]+\s*[\"'`]?$"
# Zones: every match of a pattern lies within one.
NUMBERS = r"[+(0-9][\x20().0-9+-]*+"
MAILS = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9._%+@-]*+"

CONTEXT = {"says_mail": "mail|contact|write", "says_phone": "phone|tel|call|fax|mobil", "says_card": "card|visa|credit|pay|account", "says_host": r"\bip\b|host|server|address"}
FEATURES = [
    "is_email", "is_ip", "is_card", "is_phone", "chars", "digits", "blanks", "hyphens", "dots", "brackets", "at_sign", "groups",
    "letters", "capitals", "hex_only", "switches", "vowels", "digit_before", "letter_before", "digit_after", "letter_after", *CONTEXT,
]


def _split(text: Column, pattern: str) -> Column:
    """(gap before, match) for each match in order, and the gap behind the last one with a null match."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def _count(c: Column, signs: str) -> Column:
    return F.length(c) - F.length(F.translate(c, signs, ""))


def zones(docs: DataFrame) -> DataFrame:
    """rid, doc_id, zone kind, place, text and start of each zone; every document keeps at least one row."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<gap: string, match: string>>")
    has_written = F.lower(text).rlike(r"at\x20?[\])]")
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        _split(text, NUMBERS).alias("n"), F.when(F.contains(text, F.lit("@")), _split(text, MAILS)).otherwise(none).alias("m"), F.when(has_written, _split(text, WRITTEN)).otherwise(none).alias("w"),
        _split(text, SECRET).alias("s"),
    )

    def parts(kind: str, c: str) -> Column:
        return F.transform(c, lambda x, i: F.struct(F.lit(kind).alias("zone"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.substring(x["gap"], -32, 32).alias("before"), F.substring(F.coalesce(F.get(c, i + 1)["gap"], F.lit("")), 1, 16).alias("after"), x["match"].alias("text")))

    rows = found.select("rid", "doc_id", F.explode(F.concat(*(parts(x, x) for x in "nmws"))).alias("z")).select("rid", "doc_id", "z.*")
    past = Window.partitionBy("rid", "zone").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.length("text"), F.lit(0))).over(past), F.lit(0)) + F.col("gap")
    # The last gap of the numbers has no match: it stands for the document.
    return rows.withColumn("start", start).where(F.col("text").isNull() & (F.col("zone") == "n") | F.col("zone").isin("m", "w") & F.col("text").isNotNull() | (F.col("zone") == "s") & F.col("text").rlike("[A-Za-z]") | (F.col("zone") == "n") & (_count(F.col("text"), "0123456789") >= 4))


def _luhn(digits: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return F.length(digits).between(13, 19) & (F.when(F.length(digits).between(13, 19), total % 10).otherwise(1) == 0)


def proposals(docs: DataFrame) -> DataFrame:
    """rid, doc_id, kind, base, valid, weak, start, end and the features; a row with a null kind for each document.

    valid: a base span whose check passes. weak: what the checks say of it, the label of the trees; null if they say nothing."""
    z = zones(docs)

    def of(kind: str, base: bool, pattern: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), _split(F.col("text"), pattern).alias("found"))

    whole = F.array(F.struct(F.lit("").alias("gap"), F.col("text").alias("match")))
    by_zone = (
        F.when(F.col("text").isNull(), F.array().cast("array<struct<kind: string, base: boolean, found: array<struct<gap: string, match: string>>>>"))
        .when(F.col("zone") == "n", F.array(of("ip", True, IP), of("card", True, CARD), of("phone", True, PHONE), of("phone", False, LOCAL)))
        .when(F.col("zone") == "m", F.array(of("email", True, EMAIL)))
        .otherwise(F.array(F.struct(F.when(F.col("zone") == "w", "email").otherwise("secret").alias("kind"), F.lit(False).alias("base"), whole.alias("found"))))
    )
    rows = z.select("rid", "doc_id", "zone", "i", "start", "before", "after", "text", F.explode_outer(by_zone).alias("k")).select("*", "k.kind", "k.base", F.posexplode_outer("k.found").alias("j", "f")).drop("k")
    past = Window.partitionBy("rid", "zone", "i", "kind", "base").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    gap, match = F.length("f.gap"), F.col("f.match")
    at = F.coalesce(F.sum(gap + F.coalesce(F.length(match), F.lit(0))).over(past), F.lit(0)) + gap
    rows = rows.select("rid", "doc_id", "kind", "base", "before", "after", (F.col("start") + at).cast("long").alias("start"), F.col("f.gap").alias("gap"), match.alias("match"), "text", at.alias("at")).where(F.col("kind").isNull() | F.col("match").isNotNull())
    rows = rows.select("rid", "doc_id", "kind", "base", "start", (F.col("start") + F.length("match")).alias("end"), "match",
        F.lower(F.concat("before", F.expr("substring(text, 1, at)"))).alias("before"), F.concat(F.expr("substring(text, at + length(match) + 1, 16)"), "after").alias("after"))
    m = F.col("match")
    digits = F.regexp_replace(m, "[^0-9]", "")
    rows = rows.withColumn("d", digits)
    short = F.regexp_replace(F.col("match"), r"(?<![0-9])0+(?=[0-9])", "")
    octets = F.forall(F.split(short, r"\."), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    n = F.length("d")
    last, first = F.substring("before", -1, 1), F.substring("after", 1, 1)
    kind = F.col("kind")
    short_m = F.substring(m, 1, 200)
    f = {
        "is_email": kind == "email", "is_ip": kind == "ip", "is_card": kind == "card", "is_phone": kind == "phone",
        "chars": F.least(F.length(m), F.lit(200)), "digits": F.when(kind == "phone", 0).otherwise(F.least(n, F.lit(40))), "blanks": F.least(_count(m, " "), F.lit(20)), "hyphens": F.least(_count(m, "-"), F.lit(20)), "dots": F.least(_count(m, "."), F.lit(20)),
        "brackets": F.least(_count(m, "()[]"), F.lit(20)), "at_sign": F.contains(m, F.lit("@")), "groups": F.when(F.length(m) < 200, F.size(F.split(m, "[^0-9]+"))).otherwise(20),
        "letters": F.length(F.regexp_replace(short_m, "[^A-Za-z]", "")) / F.length(short_m), "capitals": F.length(F.regexp_replace(short_m, "[^A-Z]", "")) / F.length(short_m),
        "hex_only": m.rlike("^[0-9A-Fa-f]+$"), "switches": F.least(F.regexp_count(short_m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")), F.lit(40)), "vowels": F.length(F.regexp_replace(short_m, "[^AEIOUaeiou]", "")) / F.length(short_m),
        "digit_before": last.rlike("[0-9]"), "letter_before": last.rlike(r"\p{L}"), "digit_after": first.rlike("[0-9]"), "letter_after": first.rlike(r"\p{L}"),
        **{k: F.col("before").rlike(v) for k, v in CONTEXT.items()},
    }
    card, phone = _luhn(F.col("d")), n.between(9, 15)
    local = F.col("d").rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    ends_well = F.substring_index(m, ".", -1).rlike("^[A-Za-z]{2,}$")
    weak = F.when(kind == "email", ends_well).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", F.when(F.col("base"), phone).otherwise(local))
    weak = F.when(kind != "secret", F.coalesce(weak, F.lit(False))).when(F.col("before").rlike(NAMED), True).when(f["switches"] < MIXED, False)
    valid = F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", card).otherwise((kind == "phone") & phone)
    return rows.select(
        "rid", "doc_id", "kind", "base", "start", "end", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in f.items()),
        weak.alias("weak"), (F.col("base") & F.coalesce(valid, F.lit(False))).alias("valid"),
    )


def _tree_sql(lines: list[str], at: int = 0) -> tuple[str, int]:
    """A tree's printed form -> a nested CASE expression, and the next line."""
    if (p := re.search(r"Predict: (\S+)", lines[at])) is not None:
        return f"cast({p[1]} as double)", at + 1
    feature, value = re.search(r"If \(feature (\d+) <= (\S+)\)", lines[at]).groups()
    yes, at = _tree_sql(lines, at + 1)
    no, at = _tree_sql(lines, at + 1)
    return f"CASE WHEN {FEATURES[int(feature)]} <= {value} THEN {yes} ELSE {no} END", at


def fitted(labelled: DataFrame) -> tuple[str, dict[str, float]] | None:
    """The trees as SQL for the probability, and the threshold of each kind; None if a label is lacking. labelled is read a few times."""
    labelled = labelled.withColumn("fold", F.xxhash64("rid", "start", "kind") % 2 == 0).withColumn("label", F.col("weak").cast("double"))
    counts = {(r.fold, r.label): r.n for r in labelled.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    if not all(counts.get((True, x)) for x in (0.0, 1.0)):
        return None
    alike = kept(labelled.where("fold").groupBy("label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight")), "alike")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(alike).select("v", "label", "weight")
    model = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, checkpointInterval=-1, seed=7).fit(vectors)
    terms = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        terms.append(f"{weight} * {_tree_sql(tree.toDebugString.strip().splitlines()[1:])[0]}")
    score = f"1 / (1 + exp(-2 * ({' + '.join(terms)})))"
    bins = labelled.where("not fold").select("kind", "valid", "label", F.expr(f"cast(floor(100 * ({score})) as int)").alias("bin")).groupBy("kind", "valid", "bin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    found: dict[str, list] = {}
    for r in bins.collect():  # 1010 rows at most
        found.setdefault(r.kind, []).append(r)
    thresholds = {}
    for kind, all_ in found.items():
        loose = [r for r in all_ if not r.valid]
        rows = loose if sum(r.n for r in loose) >= ENOUGH else all_
        good = n = 0
        for b in sorted({r.bin for r in rows}, reverse=True):
            good, n = good + sum(r.good for r in rows if r.bin == b), n + sum(r.n for r in rows if r.bin == b)
            if good >= PRECISION * n and b >= 50:
                thresholds[kind] = b / 100
    return score, thresholds


def spans(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, counts and digest of the base spans, all spans, and how many the trees added."""
    found = kept(proposals(docs.select("doc_id", "text")), "proposals")
    model = fitted(found.where("weak is not null"))
    extra = F.lit(False)
    if model:
        score, thresholds = model
        limit = F.create_map(*(x for k in ALL_KINDS for x in (F.lit(k), F.lit(thresholds.get(k, 2.0)))))[F.col("kind")]
        extra = ~F.col("valid") & (F.expr(score) >= limit)
    rows = found.select("rid", "doc_id", "kind", "start", "end", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce(extra, F.lit(False)).alias("extra")).where("kind is null or valid or extra")
    by_place = Window.partitionBy("rid").orderBy("start", F.desc("end"), "kind")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(F.desc("start"), "end", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    free = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(F.col("valid"), F.col("start"))).over(behind), F.col("end")) >= F.col("end"))
    rows = rows.withColumn("free", free).where("kind is null or valid or free")
    order = F.create_map(*(x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))))[F.col("kind")]
    span = F.struct(order.alias("order"), "start", "end", "kind", "valid")
    per = rows.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all"))

    def shown(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("all", lambda s: s["valid"] & (s["kind"] == kind))).cast("long")

    base = F.filter("all", lambda s: s["valid"])
    return per.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("all")).alias("spans"),
        F.size("all").cast("long").alias("n_spans"), F.size(F.filter("all", lambda s: ~s["valid"])).cast("long").alias("n_added"),
    )


QUERY = "op5_pii"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))

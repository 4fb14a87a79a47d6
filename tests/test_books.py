import datetime as dt
import random

from tapewright.operators import sequence

T0 = dt.datetime(2024, 1, 1)
FRAMES = "epoch int, sid long, arrival long, kind string, ticker string, side string, price_cents int, qty long, seq long, ts timestamp_ntz"


def random_frames(seed, n=1500):
    rng, seq, out = random.Random(seed), {0: 0, 1: 0}, []
    for i in range(n):
        sid = rng.randrange(2)
        roll = rng.random()
        seq[sid] += 3 if roll < 0.02 else (-1 if roll < 0.05 else 1)
        kind = rng.choices(["snapshot", "delta", "control"], [2, 17, 1])[0]
        out.append((1, sid, i, kind, f"M{sid}{rng.randrange(3)}", rng.choice(["yes", "no"]), rng.randrange(40, 44), rng.randrange(-3, 6) if kind == "delta" else rng.randrange(0, 9), seq[sid], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)))
    return out


def replay(frames):
    """Message by message."""
    top, books, classes, labels, valid = {}, {}, [], [], []
    for _, sid, arrival, kind, m, side, price, qty, seq, _ in frames:
        last = top.get(sid)
        c = "First" if last is None else "Ok" if seq == last + 1 else "Stale" if seq <= last else "Gap"
        top[sid] = seq if last is None else max(last, seq)
        classes.append((arrival, c))
        if c == "Gap" and kind != "snapshot":
            for k, b in books.items():
                if k[0] == sid:
                    b["valid"] = False
        b = books.get((sid, m))
        if kind == "snapshot":
            books[sid, m] = {"valid": True, "levels": {(side, price): qty} if qty > 0 else {}}
            labels.append((arrival, "snapshot"))
        elif kind == "delta":
            if c == "Stale":
                labels.append((arrival, "stale"))
            elif c == "Gap":
                labels.append((arrival, "gap"))
            elif b is None:
                labels.append((arrival, "no_book"))
            elif not b["valid"]:
                labels.append((arrival, "waiting"))
            else:
                size = b["levels"].get((side, price), 0) + qty
                if size < 0:
                    b["valid"] = False
                    labels.append((arrival, "negative"))
                else:
                    labels.append((arrival, "applied"))
                    b["levels"][side, price] = size
                    if not size:
                        del b["levels"][side, price]
        valid.append((arrival, {k for k, v in books.items() if v["valid"]}))
    return classes, labels, books


def test_like_a_replay(spark):
    for seed in (1, 2):
        rows = random_frames(seed)
        f = spark.createDataFrame(rows, FRAMES).repartition(5).cache()
        classes, labels, books = replay(rows)
        assert sorted((r.arrival, r.seq_class) for r in sequence.classified(f).collect()) == classes
        assert sorted((r.arrival, r.label) for r in sequence.labelled(f).collect()) == labels
        got = {}
        for r in sequence.levels(f).collect():
            got.setdefault((r.sid, r.ticker), {"valid": r.valid, "levels": {}})["levels"][r.side, r.price_cents] = r["size"]
        assert got == {k: v for k, v in books.items() if v["levels"]}
        ends = {(r.sid, r.ticker): r.reason for r in sequence.validity(f).collect() if r.end is None}
        assert set(ends) == {k for k, v in books.items() if v["valid"]}


def test_top_of_book(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 1, "snapshot", "M", "yes", 40, 5, 1, t), (1, 0, 2, "delta", "M", "yes", 42, 3, 2, t), (1, 0, 3, "delta", "M", "no", 55, 2, 3, t), (1, 0, 4, "delta", "M", "yes", 46, 2, 4, t), (1, 0, 5, "delta", "M", "yes", 46, -2, 5, t)]
    got = sequence.top_of_book(spark.createDataFrame(rows, FRAMES)).orderBy("arrival").collect()
    assert [(r.best_yes, r.yes_ask, r.crossed) for r in got] == [(40, None, False), (42, None, False), (42, 45, False), (46, 45, True), (42, 45, False)]


def test_checksum_of_replays(spark):
    f = spark.createDataFrame(random_frames(3), FRAMES)
    a, b = (sorted(map(tuple, sequence.checksums(x).collect())) for x in (f, f.repartition(7)))
    assert a == b and a


def test_books_of_bits_like_books_of_levels(spark):
    """Best prices, top depths and retreats over prices from 0 to 99, against dictionaries stepped through message by message."""
    rng = random.Random(11)
    rows, seq = [], 0
    for i in range(900):
        seq += 1 if rng.random() < 0.99 else 3
        kind = "snapshot" if rng.random() < 0.05 else "delta"
        rows.append((i, 1, rng.randrange(2), f"M{rng.randrange(2)}", kind, rng.choice(("yes", "no")), rng.choice((0, 1, 30, 62, 63, 64, 65, 80, 98, 99)), rng.choice((3, 3, 3, 3, 3, 6, 3, 3, -3)) if kind == "delta" else 3, 0, T0))
    for sid in (0, 1):  # numbers of their own
        for n, i in enumerate([i for i, r in enumerate(rows) if r[2] == sid]):
            rows[i] = (*rows[i][:8], n + 1 + (3 if n > 300 else 0), T0)
    frames = spark.createDataFrame(rows, "arrival long, epoch int, sid long, ticker string, kind string, side string, price_cents int, qty long, seq long, ts timestamp_ntz")
    used = sequence.labelled(frames).where("label in ('snapshot', 'applied')").select("sid", "ticker", "segment", "arrival", "side", "price_cents", "d").orderBy("arrival").collect()
    k, back, books, past, want = 3, 4, {}, {}, {}
    for r in used:
        key = (r.sid, r.ticker, r.segment)
        book = books.setdefault(key, {"yes": {}, "no": {}})
        size = book[r.side].get(r.price_cents, 0) + r.d
        book[r.side].pop(r.price_cents, None)
        if size > 0:
            book[r.side][r.price_cents] = size
        tops = {s: sorted(b.items(), reverse=True)[:k] for s, b in book.items()}
        depth = {s: sum(x[1] for x in t) for s, t in tops.items()}
        was = past.setdefault(key, [])
        moved = None
        if was:
            then, then_depth = was[max(0, len(was) - back)]
            moved = (depth["yes"] - then_depth["yes"], depth["no"] - then_depth["no"], *(sum(book[s].get(p, 0) < x for p, x in then[s]) for s in ("yes", "no")))
        was.append((tops, depth))
        want[r.arrival] = (max(book["yes"], default=None), max(book["no"], default=None), depth["yes"], depth["no"], moved)
    top = {r.arrival: (r.best_yes, r.best_no) for r in sequence.top_of_book(frames).collect()}
    assert top == {a: w[:2] for a, w in want.items()}
    assert {r.arrival: (r.yes_depth, r.no_depth) for r in sequence.top_depths(frames, k).collect()} == {a: w[2:4] for a, w in want.items()}
    moves = {r.arrival: (r.yes_change, r.no_change, r.yes_lost, r.no_lost) for r in sequence.retreats(frames, k, back).collect()}
    assert moves == {a: w[4] for a, w in want.items() if w[4]}
    assert len(want) > 250 and any(m[2] + m[3] > 0 for m in moves.values())
    plan = sequence.retreats(frames, k, back)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEval" not in plan

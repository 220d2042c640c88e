"""The leaderboard feed against a plain replay, and the ladder against sorting."""

import glob
import random
import zlib
from datetime import datetime, timedelta

from threadloom.llm import ladder


def test_ladder_is_the_sorted_head():
    rnd = random.Random(4)
    own = ladder.Ladder(10)
    for step in range(3000):
        own.add(rnd.randrange(60), float(rnd.choice([1, -1, 5, 5, 300, -200, 10**12, -(10**12)])))
        if step % 50 == 0:
            again = ladder.Ladder(10)
            for band in own.bands:
                if own.bands[band]:
                    again.load(band, *own.stored(band))
            want = sorted(((-r, i) for i, r in own.revenue.items() if r > 0))[:10]
            assert list(own.top().items()) == [(i, -r) for r, i in want] == list(again.top().items()) and again.revenue == own.revenue


def replay(events, size, late):
    revenue, boards, out, latest = {}, {}, [], None
    for b in sorted({e[5] for e in events}):
        own = [e for e in events if e[5] == b]
        for day in sorted({e[3] for e in own}):
            touched = set()
            for board, item, s, a, amount, _ in own:
                if a == day and board is not None and item is not None and not (latest is not None and s + late < latest):
                    of = revenue.setdefault(board, {})
                    of[item] = of.get(item, 0) + (amount or 0)
                    touched.add(board)
            for board in touched:
                best = sorted((-r, i) for i, r in revenue[board].items() if r > 0)[:size]
                new, old = {i: k + 1 for k, (_, i) in enumerate(best)}, boards.get(board, {})
                for i in new.keys() | old.keys():
                    if new.get(i) != old.get(i):
                        out.append((board, day, i, b, "enter" if i not in old else "exit" if i not in new else "move", old.get(i), new.get(i), int(revenue[board][i])))
                boards[board] = new
        latest = max([e[2] for e in own] + ([latest] if latest is not None else []))
    return sorted(out)


EVENT = "board int, item_id long, day long, arrival_day long, batch int, amount double"


def test_feed_equals_a_replay(spark):
    rnd = random.Random(5)
    events = []
    for _ in range(1200):
        s = 100 + rnd.randrange(30)
        a = s + rnd.choice([0, 1, 5, 20])
        events.append((rnd.choice([1, 2, 2, 2, -3, None]), rnd.choice([None, *range(12), 2**60]), s, a, rnd.choice([None, 100.0, 250.0, -100.0, 999.0, 0.0]), min(3, 1 + (a - 100) // 17)))
    events += [(2, 7, 101, 150, 10.0**9, 3), (2, 8, 140, 150, 50.0, 3), (9, 1, 120, 149, -5.0, 3)]
    df = spark.createDataFrame([(b, i, s, a, n, x) for b, i, s, a, x, n in events], EVENT).repartition(3)
    got = ladder.change_feed(df, batches=3, size=4, shards=3).collect()
    want = replay(events, 4, 8)
    assert sorted(tuple(r) for r in got) == want and {r[4] for r in want} == {"enter", "exit", "move"}


def test_no_state_store_stays_open(spark):
    local = spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    stores = lambda: set(glob.glob(f"{local}/StateStoreId*"))  # noqa: E731  a store's own folder goes when it is closed
    before = stores()
    events = [(1, i, 100 + 10 * b, 100 + 10 * b, b, 100.0) for b in (1, 2, 3) for i in range(20)]
    assert ladder.change_feed(spark.createDataFrame(events, EVENT), batches=3, shards=3).count() and stores() == before


def test_no_events(spark):
    assert ladder.change_feed(spark.createDataFrame([], EVENT), batches=2).collect() == []


def test_events_of_sale_lines(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(n)
    line = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"
    rows = [(1, 1, 10, 5, 2, 1.005, 0.0, "kept", day(0)), (1, 2, 10, 5, 2, None, 0.0, "returned", day(0)), (None, None, 11, 5, 3, None, 0.0, None, None), (2, 1, 99, 5, 1, 1.0, 0.0, "kept", day(1)), (3, 1, None, None, 1, 1.0, 0.0, "kept", day(2)), (4, 1, 10, 6, None, None, 0.0, "kept", day(3))]
    vendors = spark.createDataFrame([(5, "v", 3, 1.0), (5, "v", 2, 1.0), (6, "n", None, 1.0), (None, "x", 1, 1.0)], "vendor_id long, name string, nation_id int, balance double")
    items = spark.createDataFrame([(10, "i", 2.5), (10, "i", 2.0), (11, "j", None), (None, "x", 1.0)], "item_id long, name string, price double")
    got = {(r.item_id, r.amount): r for r in ladder.sale_events(spark.createDataFrame(rows, line), vendors, items).collect()}
    assert len(got) == 6
    h = lambda *x: zlib.crc32(",".join("" if v is None else str(v) for v in x).encode())
    one = got[(10, 100.0)]  # 100 * 1.005 is below 100.5 in doubles
    assert (one.board, one.day, one.arrival_day - one.day) == (2, 19723, h(1, 10, 5, 1) % 7 + (20 if h(1, 10, 5, 1) % 5 == 0 else 0))
    assert got[(10, -400.0)].board == 2 and got[(11, None)].day == 19723 + h(None, 11, 5, None) % 150 and got[(11, None)].board == 2
    assert got[(99, 100.0)].board is None and got[(None, 100.0)].board is None and got[(10, None)].board is None

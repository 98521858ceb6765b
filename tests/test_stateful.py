"""Streams of several batches with late events, against what the watermark admits."""

import os
from datetime import datetime, timedelta

import pytest

from brightloom.streaming import stateful

START = datetime(2024, 1, 1, 12)


@pytest.fixture
def streamed(spark, tmp_path):
    """A stream of one batch for each list of (id, key, minute); a minute may be None."""
    made = []

    def make(batches):
        path = tmp_path / f"in{len(made)}"
        made.append(path)
        path.mkdir()
        for i, rows in enumerate(batches):
            part = tmp_path / f"part{len(made)}-{i}"
            rows = [(e, k, None if m is None else START + timedelta(minutes=m)) for e, k, m in rows]
            spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz").coalesce(1).write.parquet(str(part))
            file = next(part.glob("*.parquet"))
            os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
            file.rename(path / f"{i}.parquet")
        return stateful.opened(spark, str(path), 1)

    return make


def minute(t):
    return None if t is None else int((t - START).total_seconds() // 60)


def test_sessions_with_late_events(streamed):
    batches = [
        [(1, "u", 0), (2, "u", 10), (3, "u", 100), (4, "v", 95), (5, None, 50), (6, "w", None)],
        [(7, "u", 130), (8, "u", 70)],  # 70 is late but admitted
        [(10, "u", 300), (11, "u", 350), (9, "u", 20)],  # 20 is behind 40, the watermark of the batch before
        [(12, "u", 325)],  # makes one session of two open ones
        [(13, "u", 600)],
    ]
    out = stateful.ended(stateful.sessions(streamed(batches), "k")).collect()
    got = sorted(((r.k or "", minute(r.first), minute(r.last), r.n) for r in out))
    assert got == [("", 50, 50, 1), ("u", 0, 10, 2), ("u", 70, 130, 3), ("u", 300, 350, 3), ("v", 95, 95, 1)]


def test_one_batch_or_many_give_the_same_sessions(streamed):
    rows = [(i, "ab"[i % 2], i * i % 97 * 20 + i) for i in range(60)]
    rows.sort(key=lambda r: r[2])
    of = lambda batches: sorted(tuple(r) for r in stateful.ended(stateful.sessions(streamed(batches), "k")).collect())
    one = of([rows])
    assert one == of([rows[:20], rows[20:25], rows[25:]]) and len(one) > 5


def test_repeats_that_come_late(streamed):
    batches = [
        [(1, "a", 0), (2, "a", 30), (3, "a", 61), (4, "b", 10), (5, None, 10), (6, None, 20)],
        [(7, "a", 70), (8, "a", 62), (9, "b", 5), (10, "b", 200)],
        [(11, "a", 150), (13, "b", 190), (14, "a", 255)],  # 190 repeats 200
        [(15, "a", 400), (16, "a", 210), (17, "a", 430), (12, "b", 100)],  # 100 is behind 140
    ]
    out = stateful.ended(stateful.without_repeats(streamed(batches), ["k"])).collect()
    assert sorted(r.id for r in out) == [1, 3, 4, 5, 10, 11, 14, 15]


def test_pairs_within_an_hour(streamed):
    left = [[(1, "a", 0), (2, "a", 10), (3, None, 5)], [(4, "a", 200)], [(5, "a", 20)]]
    right = [[(1, "a", 60), (2, "b", 61), (3, None, 6)], [(4, "a", 70), (5, "a", 71)], [(6, "a", 260), (7, "a", 199)]]
    out = stateful.ended(stateful.interval_pairs(streamed(left), streamed(right), "k")).collect()
    assert sorted((r.l.id, r.r.id) for r in out) == [(1, 1), (2, 1), (2, 4), (4, 6), (5, 1), (5, 4), (5, 5)]


def test_state_goes_with_the_stream(spark, streamed):
    df = stateful.ended(stateful.without_repeats(streamed([[(1, "a", 0)]]), ["k"]))
    at = df.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/out/", 1)[0]
    assert os.path.isdir(f"{at}/out") and not os.path.exists(f"{at}/state")
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("slots", [1, 3])
def test_keys_that_share_a_slot(streamed, monkeypatch, slots):
    """Groups of the state are slots, not keys: few calls of the state server, whatever the keys."""
    monkeypatch.setattr(stateful, "SLOTS", slots)
    rows = [(i, None if i % 13 == 5 else f"k{i % 12}", i * i % 89 * 15 + i) for i in range(120)]
    rows.sort(key=lambda r: r[2])
    batches = [rows[:50], rows[50:60], rows[60:]]
    times = {}
    for e, k, m in rows:
        times.setdefault(k, []).append((m, e))
    last, runs, firsts = rows[-1][2], [], []
    for k, found in times.items():
        start = kept = None
        for (m, e), later in zip(found, [*found[1:], None], strict=True):
            start = (m, 1) if start is None else (start[0], start[1] + 1)
            if later is None or later[0] - m > 30:
                runs += [(k, start[0], m, start[1])] if m + 30 <= last - 60 else []
                start = None
            if kept is None or m - kept > 60:
                kept = m
                firsts.append(e)
    out = stateful.sessions(streamed(batches), "k")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "slot#" in plan[plan.index("TransformWithState") :].split("\n")[0]
    got = [(r.k, minute(r.first), minute(r.last), r.n) for r in stateful.ended(out).collect()]
    assert sorted(got, key=repr) == sorted(runs, key=repr) and len(runs) > 12
    got = [r.id for r in stateful.ended(stateful.without_repeats(streamed(batches), ["k"])).collect()]
    assert sorted(got) == sorted(firsts) and len(firsts) < 120

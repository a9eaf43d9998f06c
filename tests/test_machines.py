"""Streams in several batches give what one batch gives, and what plain loops give."""

import hashlib
import random
import time

import pandas as pd
import pytest

from quirefold.streaming import machines

EVENTS = [(i, random.Random(i).randrange(6), random.Random(i * 7).choice(["click", "purchase", "signup"])) for i in range(120)]


def stream(spark, tmp_path, rows, schema, batches):
    """A stream over files of consecutive rows, one file a batch."""
    step = -(-len(rows) // batches)
    for b in range(batches):
        spark.createDataFrame(rows[b * step : (b + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def queue_by_hand():
    held, out = {}, []
    for i, u, kind in EVENTS:
        q = held.setdefault(u % 2, set())
        if kind != "purchase":
            out.append((u % 2, i, u, "UPDATED" if u in q else "ADDED", len(q | {u})))
            q.add(u)
        else:
            out.append((u % 2, i, u, "REMOVED" if u in q else "ABSENT", len(q - {u})))
            q.discard(u)
    return out


def archives_by_hand(most):
    opened, out = {}, []
    for i, u, kind in EVENTS:
        mine = opened.setdefault(u % 3, [])
        if kind == "click":
            mine.append([i, False])
            out.append((u % 3, i, len(mine), "OPENED", mine[-most - 1][0] if len(mine) > most else None))
        elif mine and not mine[-1][1]:
            mine[-1][1] = True
            out.append((u % 3, i, len(mine), "FINISHED", None))
        else:
            out.append((u % 3, i, len(mine), "IGNORED", None))
    return out


def reviews_by_hand():
    held, out = {}, []
    for i, u, kind in EVENTS:
        if kind == "click":
            out.append((u, i, held.get(u, "PENDING"), "IGNORED"))
        else:
            outcome = "DECIDED" if u not in held else "REPEATED" if held[u] == kind else "REFUSED"
            out.append((u, i, held.setdefault(u, kind), outcome))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_machines_over_batches(spark, tmp_path, batches):
    got = lambda s, key, m: sorted(tuple(r) for r in machines.run(s, key, m).collect())
    q = stream(spark, tmp_path / "q", [(u % 2, i, u, k != "purchase") for i, u, k in EVENTS], "queue long, seq long, item long, registers boolean", batches)
    assert got(q, "queue", machines.Queue()) == sorted(queue_by_hand())
    a = stream(spark, tmp_path / "a", [(u % 3, i, k == "click") for i, u, k in EVENTS], "owner long, seq long, opens boolean", batches)
    assert got(a, "owner", machines.Archives(4)) == sorted(archives_by_hand(4))
    r = stream(spark, tmp_path / "r", [(u, i, k) for i, u, k in EVENTS], "item long, seq long, decision string", batches)
    assert got(r, "item", machines.Reviews(["purchase", "signup"])) == sorted(reviews_by_hand())


def history_by_hand(rows):
    sha = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    cases, out = {}, []
    for case, seq, base, payload in sorted(rows, key=lambda r: r[1]):
        versions = cases.setdefault(case, [])
        chain = ""
        for v in versions:
            chain = sha(chain, v)
        if versions and payload == versions[-1]:
            out.append((case, seq, len(versions), "REPLAY", chain, None, len(versions) - 1))
        elif base == (sha(versions[-1]) if versions else ""):
            out.append((case, seq, len(versions) + 1, "ACCEPTED", sha(chain, payload), versions[-1] if versions else None, len(versions)))
            versions.append(payload)
        else:
            out.append((case, seq, len(versions), "CONFLICT", chain, None, max(0, len(versions) - 1)))
    return out


def key(row):
    return tuple(map(str, row))


@pytest.mark.parametrize("batches", [1, 3])
def test_history_over_batches(spark, tmp_path, batches):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    r = random.Random(4)
    rows = [(r.randrange(3), i, r.choice(["", sha("a"), sha("b"), sha("c")]), r.choice("abc")) for i in range(90)]
    s = stream(spark, tmp_path, rows, "case_id long, seq long, base_hash string, payload string", batches)
    got = [tuple(x) for x in machines.run(s, "case_id", machines.History()).collect()]
    assert sorted(got, key=key) == sorted(history_by_hand(rows), key=key)
    assert {x[3] for x in got} == {"ACCEPTED", "REPLAY", "CONFLICT"} and any(x[5] for x in got)


def test_history_with_a_time_to_live(spark, tmp_path):
    """A stream that goes on: a case that is forgotten only after an hour is remembered in its next batch."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(1, 0, "", "a"), (1, 1, sha("a"), "b"), (1, 2, sha("b"), "c"), (2, 3, "x", "d")]
    s = stream(spark, tmp_path, rows, "case_id long, seq long, base_hash string, payload string", 2)
    with machines.rocksdb(spark):
        query = machines.machine(s, "case_id", machines.History(ttl=3_600_000), ttl=True).writeStream.format("memory").queryName("history").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        end = time.time() + 90
        while spark.table("history").count() < len(rows) and time.time() < end:
            time.sleep(1)
        assert sorted(map(tuple, spark.table("history").collect()), key=key) == sorted(history_by_hand(rows), key=key)
    finally:
        query.stop()


def test_history_query(spark):
    from quirefold.plans import registry, state

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in state.correction_events(registry.table(spark, sf, "events")).collect()]
    got = [tuple(x) for x in registry.QUERIES["stream_history"](spark, sf).collect()]
    assert sorted(got, key=key) == sorted(history_by_hand(rows), key=key) and any(x[5] for x in got)


def test_queue_asks_its_state_once_an_item(monkeypatch):
    class Held:
        def __init__(self, held=None):
            self.held, self.calls = held or {}, 0

        def called(self, fn):
            self.calls += 1
            return fn()

        exists = lambda self: self.called(lambda: () in self.held)
        get = lambda self: self.called(lambda: self.held[()])
        update = lambda self, x: self.called(lambda: self.held.update({(): x}))
        containsKey = lambda self, k: self.called(lambda: k in self.held)  # noqa: E731, N815
        updateValue = lambda self, k, x: self.called(lambda: self.held.update({k: x}))  # noqa: E731, N815
        removeKey = lambda self, k: self.called(lambda: self.held.pop(k))  # noqa: E731, N815

    monkeypatch.setattr(machines, "FRAME", 7)
    queue = machines.Queue()
    queue.size, queue.items = Held(), Held()
    mine = [(i, u, kind != "purchase") for i, u, kind in EVENTS if u % 2 == 0]
    out = []
    for part in (mine[:30], mine[30:]):
        rows = pd.DataFrame([(0, i, u, r) for i, u, r in reversed(part)], columns=["queue", "seq", "item", "registers"])
        before = queue.size.calls + queue.items.calls
        frames = list(queue.handleInputRows((0,), iter([rows]), None))
        assert all(len(f) <= 7 for f in frames) and queue.size.calls + queue.items.calls - before <= 3 + 2 * 3
        out += [tuple(r) for f in frames for r in f.itertuples(index=False)]
    assert out == [r for r in queue_by_hand() if r[0] == 0]
    last = {u: i for i, u, r in mine if r}
    gone = {u for u in last if next(r for _, x, r in reversed(mine) if x == u) is False}
    assert queue.items.held == {(u,): (i,) for u, i in last.items() if u not in gone}

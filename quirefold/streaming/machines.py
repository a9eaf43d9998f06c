"""State machines over a stream of events: reviews, pending queues, archives, and corrections with their history.

Each key's events apply in order of seq within a batch, and batches in turn, so any split of the events into batches gives the same
rows. State is held by key in RocksDB: a value, a list or a map, of which a task sees the keys of its batch alone.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirefold.streaming.replay import collected

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Archives that an owner keeps, and the rows of a frame that goes out (fixed values).
KEPT, FRAME = 500, 10_000


class Machine(StatefulProcessor):
    """Applies the rows of a key one by one, in order of seq; step gives the output row of each, without the key.

    begin and finish frame a key's batch: what a step reads and writes of the state once a row may be held between them, as every call of the state goes to the JVM.
    """

    columns: str

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        columns, out = [c.split()[0] for c in self.columns.split(", ")], []
        self.begin()
        for r in batch.itertuples(index=False):
            out.append((key[0], r.seq, *self.step(r)))
            if len(out) == FRAME:
                yield pd.DataFrame(out, columns=columns)
                out = []
        self.finish()
        yield pd.DataFrame(out, columns=columns)

    def begin(self) -> None:
        pass

    def finish(self) -> None:
        pass

    def step(self, row) -> tuple:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Reviews(Machine):
    """PENDING until the first final decision, which stands: rows (item, seq, decision) give DECIDED once, then REPEATED or REFUSED, or IGNORED for what is no decision."""

    columns = "item long, seq long, state string, outcome string"

    def __init__(self, final: list[str]):
        self.final = final

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def step(self, row) -> tuple:
        held = self.state.get()[0] if self.state.exists() else "PENDING"
        if row.decision not in self.final:
            return held, "IGNORED"
        if held != "PENDING":
            return held, "REPEATED" if row.decision == held else "REFUSED"
        self.state.update((row.decision,))
        return row.decision, "DECIDED"


class Queue(Machine):
    """A queue's pending items: rows (queue, seq, item, registers) give ADDED or UPDATED, REMOVED or ABSENT, and how many are pending then."""

    columns = "queue long, seq long, item long, outcome string, pending long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item long", "seq long")
        self.size = handle.getValueState("size", "n long")

    def begin(self) -> None:
        self.n = self.first = self.size.get()[0] if self.size.exists() else 0
        self.was: dict[int, bool] = {}
        self.now: dict[int, int | None] = {}

    def step(self, row) -> tuple:
        item = row.item
        if item not in self.now:
            # An empty queue holds no item, so none is asked for.
            self.was[item] = self.first > 0 and self.items.containsKey((item,))
            self.now[item] = -1 if self.was[item] else None
        there = self.now[item] is not None
        if row.registers:
            self.now[item] = row.seq
            self.n, outcome = self.n + (not there), "UPDATED" if there else "ADDED"
        elif there:
            self.now[item] = None
            self.n, outcome = self.n - 1, "REMOVED"
        else:
            outcome = "ABSENT"
        return item, outcome, self.n

    def finish(self) -> None:
        for item, seq in self.now.items():
            if seq is not None:
                self.items.updateValue((item,), (seq,))
            elif self.was[item]:
                self.items.removeKey((item,))
        self.size.update((self.n,))


class Archives(Machine):
    """An owner's newest archives: rows (owner, seq, opens) open one or finish the newest if it is open; the one that falls out of the newest `most` is evicted.

    Gives OPENED, FINISHED or IGNORED, the archive's number, and the seq of an evicted one.
    """

    columns = "owner long, seq long, archive long, outcome string, evicted long"

    def __init__(self, most: int = KEPT):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "archive long", "opened long, finished long")
        self.last = handle.getValueState("last", "archive long")

    def step(self, row) -> tuple:
        last = self.last.get()[0] if self.last.exists() else 0
        if row.opens:
            last += 1
            self.kept.updateValue((last,), (row.seq, -1))
            self.last.update((last,))
            old = (last - self.most,)
            evicted = self.kept.getValue(old)[0] if self.kept.containsKey(old) else None
            if evicted is not None:
                self.kept.removeKey(old)
            return last, "OPENED", evicted
        if last and self.kept.getValue((last,))[1] < 0:
            self.kept.updateValue((last,), (self.kept.getValue((last,))[0], row.seq))
            return last, "FINISHED", None
        return last, "IGNORED", None


class History(Machine):
    """Corrections of a case that must name the hash of what they correct: rows (case_id, seq, base_hash, payload).

    The first needs an empty base. An accepted one archives what it replaces, which comes out, and its hash goes on a chain over all
    versions; an exact replay of the present one changes nothing; any other is a conflict. With ttl (milliseconds) a case that
    rests so long is forgotten, as its store allows.
    """

    columns = "case_id long, seq long, version long, outcome string, chain string, replaced string, archived long"

    def __init__(self, ttl: int | None = None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "version long, payload string, chain string", self.ttl)
        self.old = handle.getListState("old", "payload string", self.ttl)

    def step(self, row) -> tuple:
        digest = lambda *x: hashlib.sha256("\n".join(x).encode()).hexdigest()
        version, payload, chain = self.current.get() if self.current.exists() else (0, None, "")
        archived = sum(1 for _ in self.old.get()) if self.old.exists() else 0
        if version and row.payload == payload:
            return version, "REPLAY", chain, None, archived
        if row.base_hash != (digest(payload) if version else ""):
            return version, "CONFLICT", chain, None, archived
        if version:
            self.old.appendValue((payload,))
        chain = digest(chain, row.payload)
        self.current.update((version + 1, row.payload, chain))
        return version + 1, "ACCEPTED", chain, payload, archived + bool(version)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that these machines need, for the streams started within; the session's own comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def machine(stream: DataFrame, key: str, processor: Machine, ttl: bool = False) -> DataFrame:
    """The processor's rows over a stream (key, seq, ...)."""
    return stream.groupBy(key).transformWithStateInPandas(processor, processor.columns, "Append", "ProcessingTime" if ttl else "None")


def run(stream: DataFrame, key: str, processor: Machine) -> DataFrame:
    """The processor's rows over all that a stream has, as a table. Processors with a time to live run in streams that go on, as theirs never end."""
    with rocksdb(stream.sparkSession):
        return collected(machine(stream, key, processor), "append")

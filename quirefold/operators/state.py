"""Batch twins of the stateful operators: idempotent processing, queues, cursors, logs, access, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def once(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each idempotency key."""
    first = F.min_by(F.struct(*rows.columns), F.col(order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("_r")).select("_r.*")


def key_conflicts(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Idempotency keys that came with different contents."""
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").drop("a", "b")


def pending(events: DataFrame, key: str, order: str, resolved: Column) -> DataFrame:
    """The last row of each key, unless it resolves the key."""
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.col(order))
    return events.groupBy(key).agg(last.alias("_r")).select(key, "_r.*").where(~resolved)


def since(events: DataFrame, seq: str, cursors: DataFrame, key: str) -> DataFrame:
    """(key, visible, next_cursor): rows of the key after its cursor. The cursor moves to the newest row of all, seen or not."""
    newest = events.agg(F.max(seq).alias("next_cursor"))
    shown = events.join(cursors, key).where(F.col(seq) > F.col("cursor")).groupBy(key).agg(F.count("*").alias("visible"))
    return cursors.select(key).join(shown, key, "left").crossJoin(newest).select(key, F.coalesce("visible", F.lit(0)).alias("visible"), "next_cursor")


def timeline(events: DataFrame, key: str, order: str, column: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda r: r[column])
    return events.groupBy(key).agg(rows.alias("timeline"))


def latest(left: DataFrame, events: DataFrame, key: str, order: str, wanted: Column, value: str) -> DataFrame:
    """Left rows with the value of the key's last wanted event; null without one."""
    last = events.where(wanted).groupBy(key).agg(F.max_by(value, order).alias(f"last_{value}"))
    return left.join(last, key, "left")


def tree(parents: DataFrame, children: DataFrame, parent: str, key: str, name: str) -> DataFrame:
    """(parent, children): each parent with its children's names in order; an empty array without any."""
    got = children.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"))
    return parents.join(got, F.col(parent) == F.col(key), "left").select(parent, F.coalesce("names", F.array().cast("array<string>")).alias("children"))


def allowed(rows: DataFrame, grants: DataFrame, user: str, owner: str) -> DataFrame:
    """(user, visible): how many rows each user may see. A user without grants may see all, else the owners granted."""
    per = rows.groupBy(owner).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    got = grants.where(F.col(owner).isNotNull()).join(per, owner, "left").groupBy(user).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    users = grants.select(user).distinct()
    return users.join(got, user, "left").crossJoin(total).select(user, F.coalesce("n", "total").alias("visible"))


def fan_out(events: DataFrame, kind: str, roles: dict[str, list[str]], users: DataFrame, user: str, role: str) -> DataFrame:
    """(user, notifications): how many events reach each user by role. Kinds are counted first, so events never meet users one by one."""
    counts = events.groupBy(kind).agg(F.count("*").alias("n"))
    to = F.element_at(F.create_map(*(x for k, v in roles.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col(kind))
    by_role = counts.select(F.explode(to).alias("_role"), "n").groupBy("_role").agg(F.sum("n").alias("n"))
    return users.join(F.broadcast(by_role), F.col(role) == F.col("_role"), "left").select(user, F.coalesce("n", F.lit(0)).alias("notifications"))


def reuploads(events: DataFrame, key: str, again: Column, most: int) -> DataFrame:
    """(key, reuploads, case_version, exhausted)."""
    return events.groupBy(key).agg(F.count_if(again).alias("reuploads")).withColumns({"case_version": F.col("reuploads") + 1, "exhausted": F.col("reuploads") >= most})


def transitions(events: DataFrame, key: str, order: str, column: str, start: str, final: list[str]) -> DataFrame:
    """(key, state, at): PENDING items become the first final state that comes, once."""
    first = F.min(F.when(F.col(column).isin(final), F.struct(F.col(order).alias("at"), F.col(column).alias("state"))))
    return events.groupBy(key).agg(first.alias("f")).select(key, F.coalesce("f.state", F.lit(start)).alias("state"), F.col("f.at").alias("at"))


def lags(events: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """Adds seconds since the key's row before."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(order))
    return events.withColumn("seconds", F.bround((F.unix_micros(at) - F.unix_micros(before)) / 1e6, 3))


def unassigned(children: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """Children whose key names no parent."""
    return children.join(parents.select(F.col(parent).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def appended(log: DataFrame, events: DataFrame, order: list[str], seq: str = "seq") -> DataFrame:
    """Events numbered on behind the log's last number, in their own order: every number is greater than all before it."""
    from quirefold.operators.governance import running

    last = log.agg(F.coalesce(F.max(seq), F.lit(0)).alias("_last"))
    rows = running(events.withColumn("_all", F.lit(0)), "_all", order, F.lit(1)).crossJoin(F.broadcast(last))  # one row
    return rows.withColumn(seq, F.col("_last") + F.col("before") + 1).drop("_all", "_last", "before")


def archive(events: DataFrame, key: str, order: str, opened: Column, finished: Column, most: int = 500) -> DataFrame:
    """(key, opened_at, finished_at, status): the newest archives; a finish before any opening opens nothing."""
    first = F.min(F.when(opened, F.col(order)))
    out = events.groupBy(key).agg(first.alias("opened_at"), F.max(F.when(finished, F.col(order))).alias("_end")).where("opened_at IS NOT NULL")
    end = F.when(F.col("_end") > F.col("opened_at"), F.col("_end"))
    out = out.select(key, "opened_at", end.alias("finished_at"), F.when(end.isNotNull(), "FINAL").otherwise("OPEN").alias("status"))
    return out.orderBy(F.desc("opened_at"), key).limit(most)


def marked_read(notes: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Notifications with unread, whether nobody marked them."""
    return notes.join(reads.select(*keys).distinct().withColumn("_r", F.lit(True)), keys, "left").withColumn("unread", F.col("_r").isNull()).drop("_r")

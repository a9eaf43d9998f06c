"""Queries over the event log and the star schema's ownership: queues, cursors, access, notifications, replayed streams."""

from pyspark.sql import functions as F

from quirefold.operators import governance, state
from quirefold.plans.registry import query, table
from quirefold.streaming import machines, replay


def events(spark, sf_dir):
    # The table's times have no zone; they are read as UTC whatever the session's zone.
    return table(spark, sf_dir, "events").select("event_id", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z"))).alias("ts"), "user_id", "event_type", "value", "props")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def idempotent_once(spark, sf_dir):
    return state.once(events(spark, sf_dir), ["user_id", "event_type"], "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT user_id, props, count(*) AS rows FROM events GROUP BY ALL HAVING min(event_type) <> max(event_type)")
def key_conflicts(spark, sf_dir):
    return state.key_conflicts(events(spark, sf_dir), ["user_id", "props"], F.col("event_type"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'purchase'")
def pending_queue(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return state.pending(e, "user_id", "event_id", F.col("event_type") == "purchase")


@query("WITH c AS (SELECT user_id, min(event_id) + (user_id * 7) AS cursor FROM events GROUP BY user_id) SELECT c.user_id, count(e.event_id) AS visible, (SELECT max(event_id) FROM events) AS next_cursor FROM c LEFT JOIN events e ON e.user_id = c.user_id AND e.event_id > c.cursor GROUP BY c.user_id")
def event_cursor(spark, sf_dir):
    e = events(spark, sf_dir)
    cursors = e.groupBy("user_id").agg((F.min("event_id") + F.col("user_id") * 7).alias("cursor"))
    return state.since(e, "event_id", cursors, "user_id")


@query("SELECT user_id, md5(string_agg(event_type, '>' ORDER BY event_id)) AS path_md5, count(*) AS steps FROM events GROUP BY user_id")
def timelines(spark, sf_dir):
    rows = state.timeline(events(spark, sf_dir), "user_id", "event_id", "event_type")
    return rows.select("user_id", F.md5(F.array_join("timeline", ">")).alias("path_md5"), F.size("timeline").cast("long").alias("steps"))


@query("SELECT c_custkey AS user_id, l.v AS last_value FROM customer LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id) l ON c_custkey = l.user_id")
def latest_decision(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return state.latest(users, events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "purchase", "value")


@query("SELECT r_regionkey, coalesce(array_to_string(list_sort(list(n_name) FILTER (n_name IS NOT NULL)), ','), '') AS children FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def org_tree(spark, sf_dir):
    rows = state.tree(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey", "n_name")
    return rows.select("r_regionkey", F.array_join("children", ",").alias("children"))


@query("WITH g AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_nationkey END AS nation FROM supplier), p AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1) SELECT s_suppkey, CASE WHEN count(nation) = 0 THEN (SELECT count(*) FROM customer) ELSE coalesce(sum(n), 0) END::BIGINT AS visible FROM g LEFT JOIN p USING (nation) GROUP BY s_suppkey")
def access_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    grants = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 5000, F.col("s_nationkey")).alias("nation"))
    return state.allowed(rows, grants, "s_suppkey", "nation")


ROLES = {"purchase": ["BUILDING", "MACHINERY"], "error": ["HOUSEHOLD"], "signup": ["BUILDING", "FURNITURE"]}


@query("WITH r(k, role) AS (VALUES ('purchase', 'BUILDING'), ('purchase', 'MACHINERY'), ('error', 'HOUSEHOLD'), ('signup', 'BUILDING'), ('signup', 'FURNITURE')), n AS (SELECT role, count(*) AS n FROM events JOIN r ON event_type = k GROUP BY role) SELECT c_custkey, coalesce(n, 0) AS notifications FROM customer LEFT JOIN n ON c_mktsegment = role")
def notify_fanout(spark, sf_dir):
    return state.fan_out(events(spark, sf_dir), "event_type", ROLES, table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS reuploads, count(*) FILTER (event_type = 'error') + 1 AS case_version, count(*) FILTER (event_type = 'error') >= 20 AS exhausted FROM events GROUP BY user_id")
def reupload_counter(spark, sf_dir):
    return state.reuploads(events(spark, sf_dir), "user_id", F.col("event_type") == "error", 20)


@query("SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (event_type IN ('purchase', 'signup')), 'PENDING') AS state, min(event_id) FILTER (event_type IN ('purchase', 'signup')) AS at FROM events GROUP BY user_id")
def review_states(spark, sf_dir):
    return state.transitions(events(spark, sf_dir), "user_id", "event_id", "event_type", "PENDING", ["purchase", "signup"])


@query("SELECT event_id, round_even((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id)) / 1e6, 3) AS seconds FROM events")
def event_gaps(spark, sf_dir):
    return state.lags(events(spark, sf_dir), "user_id", "event_id", "ts").select("event_id", "seconds")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS events, round_even(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_daily_totals(spark, sf_dir):
    out = replay.daily_totals(replay.read(spark, sf_dir, "events"), late=None)
    return replay.collected(out, "complete").select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "events", F.bround("total", 2).alias("total"))


@query("SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL")
def stream_once(spark, sf_dir):
    out = replay.once(replay.read(spark, sf_dir, "events"), ["user_id", "event_type"])
    return replay.collected(out, "append").select("user_id", "event_type", F.lit(True).alias("seen"))


@query("SELECT o_orderkey, o_orderpriority || '-' || lpad(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::VARCHAR, 4, '0') AS case_id FROM orders")
def inventory_number(spark, sf_dir):
    return governance.number_cases(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "case_id")


LEAVES = "SELECT source, doc_id AS k, sha256(coalesce(text, '')) AS h, 1 AS n FROM documents"
_level = lambda of: f"SELECT source, k >> 12 AS k, sha256(string_agg(h, chr(10) ORDER BY k, h)) AS h, sum(n) AS n FROM ({of}) GROUP BY source, k >> 12"


@query(f"SELECT source, sum(n)::BIGINT AS rows, 'sha256:' || sha256(string_agg(h, chr(10) ORDER BY k, h)) AS digest FROM ({_level(_level(_level(LEAVES)))}) GROUP BY source")
def dataset_digest(spark, sf_dir):
    return governance.dataset_digest(table(spark, sf_dir, "documents"), ["source"], "doc_id", F.coalesce("text", F.lit("")))


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS splits, count(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def split_leak(spark, sf_dir):
    return governance.split_leaks(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "source", F.col("text"))


@query("SELECT doc_id, lang AS stratum, rn::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= CASE lang WHEN 'en' THEN 85 WHEN 'fr' THEN 10 WHEN 'de' THEN 5 ELSE 0 END")
def stratified_sample(spark, sf_dir):
    return governance.stratified_sample(table(spark, sf_dir, "documents"), F.col("lang"), "doc_id", {"en": 85, "fr": 10, "de": 5}).select("doc_id", "stratum", "place")


@query(
    """WITH d AS (SELECT l_orderkey AS k, l_linenumber AS f, min(l_returnflag) AS value, 'PENDING' AS status FROM lineitem GROUP BY ALL),
p AS (SELECT k, f, 'R' AS pv, CASE WHEN k % 3 = 0 OR f % 2 = 0 THEN 'CONFIRMED' ELSE 'SKIPPED' END AS ps FROM d WHERE k % 3 = 0 OR f % 3 <> 0)
SELECT k, f, coalesce(pv, value) AS value, coalesce(ps, status) AS status, bool_and(coalesce(ps, status) = 'CONFIRMED') OVER (PARTITION BY k) AS case_confirmed FROM d LEFT JOIN p USING (k, f)"""
)
def carry_forward(spark, sf_dir):
    draft = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("f")).agg(F.min("l_returnflag").alias("value")).withColumn("status", F.lit("PENDING"))
    prior = draft.where("k % 3 = 0 OR f % 3 <> 0").select("k", "f", F.lit("R").alias("value"), F.when((F.col("k") % 3 == 0) | (F.col("f") % 2 == 0), "CONFIRMED").otherwise("SKIPPED").alias("status"))
    return governance.carry_forward(draft, prior, ["k", "f"])


@query(
    """WITH s AS (SELECT l_suppkey AS supplier, count(*) FILTER (l_discount < 0.02) AS missing, count(*) FILTER (l_discount < 0.02 AND l_tax < 0.07) AS decided FROM lineitem GROUP BY CUBE (l_suppkey))
SELECT *, CASE WHEN missing = 0 THEN 'NO_MISSING' WHEN decided = missing THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM s"""
)
def coverage_review(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_discount") < 0.02).alias("missing"), (F.col("l_tax") < 0.07).alias("decided"))
    return governance.coverage(rows, "supplier")


@query(
    """WITH f AS (SELECT o_orderpriority AS category, unnest(['DATE', 'NUMBER', 'TEXT']) AS data_type, unnest([CASE WHEN o_orderdate < '1999-01-01' THEN 'NORMALIZED' ELSE 'INVALID' END, CASE WHEN o_totalprice > 100000 THEN 'NORMALIZED' ELSE 'UNCHANGED' END, 'UNCHANGED']) AS normalization_status FROM orders)
SELECT category, data_type, normalization_status, count(*) AS fields FROM f GROUP BY CUBE (category, data_type, normalization_status)"""
)
def typed_projection(spark, sf_dir):
    cells = F.array(
        F.struct(F.lit("DATE").alias("data_type"), F.when(F.col("o_orderdate") < "1999-01-01", "NORMALIZED").otherwise("INVALID").alias("normalization_status")),
        F.struct(F.lit("NUMBER").alias("data_type"), F.when(F.col("o_totalprice") > 100000, "NORMALIZED").otherwise("UNCHANGED").alias("normalization_status")),
        F.struct(F.lit("TEXT").alias("data_type"), F.lit("UNCHANGED").alias("normalization_status")),
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.explode(cells).alias("c")).select("category", "c.*")
    return governance.typed_projection(rows, ["category"])


def _events(spark, sf_dir, *columns):
    return replay.read(spark, sf_dir, "events").select(*columns)


@query(
    """WITH e AS (SELECT user_id AS item, event_id AS seq, event_type AS d, event_type IN ('purchase', 'signup') AS fin FROM events),
f AS (SELECT item, min(seq) FILTER (fin) AS first_at, min_by(d, seq) FILTER (fin) AS state FROM e GROUP BY item)
SELECT item, seq, CASE WHEN seq >= first_at THEN state ELSE 'PENDING' END AS state, CASE WHEN NOT fin THEN 'IGNORED' WHEN seq = first_at THEN 'DECIDED' WHEN d = state THEN 'REPEATED' ELSE 'REFUSED' END AS outcome FROM e JOIN f USING (item)"""
)
def stream_reviews(spark, sf_dir):
    events = _events(spark, sf_dir, F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.col("event_type").alias("decision"))
    return machines.run(events, "item", machines.Reviews(["purchase", "signup"]))


@query(
    """WITH e AS (SELECT user_id % 8 AS queue, event_id AS seq, user_id AS item, event_type <> 'purchase' AS reg FROM events), l AS (SELECT *, coalesce(lag(reg) OVER (PARTITION BY item ORDER BY seq), false) AS there FROM e)
SELECT queue, seq, item, CASE WHEN reg THEN CASE WHEN there THEN 'UPDATED' ELSE 'ADDED' END WHEN there THEN 'REMOVED' ELSE 'ABSENT' END AS outcome,
 sum(CASE WHEN reg AND NOT there THEN 1 WHEN there AND NOT reg THEN -1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY seq)::BIGINT AS pending FROM l"""
)
def stream_queue(spark, sf_dir):
    events = _events(spark, sf_dir, (F.col("user_id") % 8).alias("queue"), F.col("event_id").alias("seq"), F.col("user_id").alias("item"), (F.col("event_type") != "purchase").alias("registers"))
    return machines.run(events, "queue", machines.Queue())


@query(
    """WITH e AS (SELECT user_id % 16 AS owner, event_id AS seq, event_type = 'click' AS opens FROM events WHERE event_type IN ('click', 'purchase')),
l AS (SELECT *, sum(opens::INT) OVER w AS n, coalesce(lag(opens) OVER w, false) AS was FROM e WINDOW w AS (PARTITION BY owner ORDER BY seq)),
o AS (SELECT owner, seq, lag(seq, 20) OVER (PARTITION BY owner ORDER BY seq) AS evicted FROM e WHERE opens)
SELECT owner, seq, n::BIGINT AS archive, CASE WHEN opens THEN 'OPENED' WHEN was THEN 'FINISHED' ELSE 'IGNORED' END AS outcome, evicted FROM l LEFT JOIN o USING (owner, seq)"""
)
def stream_archives(spark, sf_dir):
    events = replay.read(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')").select((F.col("user_id") % 16).alias("owner"), F.col("event_id").alias("seq"), (F.col("event_type") == "click").alias("opens"))
    return machines.run(events, "owner", machines.Archives(20))


def correction_events(events):
    """Corrections of a user's case: the base of most is what the user's type of event before would have left, of some it is stale."""
    kinds = F.array(*map(F.lit, ["click", "purchase", "signup", "view", ""]))
    base = F.element_at(kinds, (F.col("event_id") % 5).cast("int") + 1)
    return events.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.when(base != "", F.sha2(base, 256)).otherwise("").alias("base_hash"), F.col("event_type").alias("payload"))


@query()
def stream_history(spark, sf_dir):
    return machines.run(correction_events(replay.read(spark, sf_dir, "events")), "case_id", machines.History())


@query(
    """WITH k AS (SELECT source, unnest([{'kind': 'content', 'key': sha256(text)}, {'kind': 'lineage', 'key': CASE WHEN n_chars % 5 = 0 THEN 'L' || n_chars % 50 END}]) AS k FROM documents WHERE source IS NOT NULL)
SELECT k.kind AS kind, k.key AS key, count(DISTINCT source) AS splits, count(*) AS rows FROM k WHERE k.key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source) > 1"""
)
def split_overlaps(spark, sf_dir):
    lineage = F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("L"), (F.col("n_chars") % 50).cast("string")))
    return governance.split_overlaps(table(spark, sf_dir, "documents").where("source IS NOT NULL"), "source", F.col("text"), lineage)

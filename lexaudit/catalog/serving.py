"""Serving rules and sources over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as I
from ..streaming import serving as S
from .base import query, table

_STEPS = "e AS (SELECT user_id, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(
    f"""WITH RECURSIVE {_STEPS}, r AS (SELECT user_id, t, event_id, k, 1 AS n, t + 21600000000 AS reset FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.t, e.event_id, e.k, CASE WHEN r.reset < e.t THEN 1 ELSE r.n + 1 END, CASE WHEN r.reset < e.t THEN e.t + 21600000000 ELSE r.reset END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, n::INT AS n, n <= 2 AS accepted FROM r"""
)
def rate_limit(spark, d):
    return S.rate_limit(table(spark, d, "events"), 2, 6 * 3600).select("user_id", "event_id", "n", "accepted")


@query(
    f"""WITH RECURSIVE {_STEPS}, r AS (SELECT user_id, t, event_id, k, 1 AS session, t + 86400000000 AS stop FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.t, e.event_id, e.k, CASE WHEN r.stop < e.t THEN r.session + 1 ELSE r.session END, CASE WHEN r.stop < e.t THEN e.t + 86400000000 ELSE r.stop END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, session::INT AS session FROM r"""
)
def session_ttl(spark, d):
    return S.session_ttl(table(spark, d, "events"), 86400).select("user_id", "event_id", "session")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS hit FROM events")
def cache_first_seen(spark, d):
    return S.first_seen(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "hit")


@query("SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN -40000 ELSE 64000 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS tokens, count_if(event_type <> 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS requests FROM events")
def ledger_running(spark, d):
    """Running totals where every reservation is admitted: purchases stand for settlements that give 40,000 tokens back."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = F.col("event_type") == "purchase"
    return table(spark, d, "events").select(
        "user_id", "event_id", F.sum(F.when(back, -40000).otherwise(64000)).over(w).alias("tokens"), F.count_if(~back).over(w).alias("requests")
    )


@query(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'purchase' AS back, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, value FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM (SELECT user_id, event_id, back, CASE WHEN back THEN prev ELSE event_id END AS rid, (floor(value) * 100)::BIGINT AS used FROM e) WHERE rid IS NOT NULL),
r AS (SELECT user_id, NULL::BIGINT AS seq, 0::BIGINT AS k, NULL::BOOLEAN AS accepted, 0::BIGINT AS n, 0::BIGINT AS tok, []::BIGINT[] AS pending FROM o GROUP BY user_id UNION ALL
SELECT user_id, seq, k, ok, CASE WHEN ok AND NOT back THEN n + 1 ELSE n END, CASE WHEN NOT ok THEN tok WHEN back THEN tok - 64000 + used ELSE tok + 64000 END, CASE WHEN NOT ok THEN pending WHEN back THEN list_filter(pending, lambda x: x <> rid) ELSE list_append(pending, rid) END
FROM (SELECT o.user_id, o.event_id AS seq, o.k, o.back, o.rid, o.used, r.n, r.tok, r.pending, CASE WHEN o.back THEN list_contains(r.pending, o.rid) AND o.used BETWEEN 0 AND 64000 ELSE r.n + 1 <= 30 AND r.tok + 64000 <= 1000000 END AS ok FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT user_id::VARCHAR AS ledger, seq, accepted, n AS requests, tok AS tokens, round(tok * (0.042 / 1e6), 9) AS usd FROM r WHERE seq IS NOT NULL"""
)
def ledger_admission(spark, d):
    """Admission under caps, decided in order; tokens bind before their price does."""
    e = table(spark, d, "events")
    back = F.col("event_type") == "purchase"
    ops = e.select(
        F.col("user_id").cast("string").alias("ledger"), F.col("event_id").alias("seq"), F.when(back, "settle").otherwise("reserve").alias("op"),
        F.when(back, F.lag("event_id").over(_by_user())).otherwise(F.col("event_id")).alias("reservation"), F.when(back, F.floor("value") * 100).cast("long").alias("used"),
    )
    return S.ledger(ops.filter("reservation is not null"), 1.0, 30, 1_000_000).select("ledger", "seq", "accepted", "requests", "tokens", F.round("usd", 9).alias("usd"))


def _by_user():
    from pyspark.sql.window import Window

    return Window.partitionBy("user_id").orderBy("event_id")


@query("""WITH m AS (SELECT event_type, epoch_us(ts) AS t, 1 AS m FROM events UNION ALL SELECT event_type, epoch_us(ts) + (value * 60000000)::BIGINT, -1 FROM events),
o AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, m) AS open FROM (SELECT event_type, t, m, sum(m) AS d FROM m GROUP BY ALL)) SELECT event_type, max(open)::BIGINT AS peak FROM o GROUP BY event_type""")
def concurrency_peak(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_type", t.alias("start"), (t + F.round(F.col("value") * 60000000).cast("long")).alias("end"))
    return S.concurrency_peak(e, "event_type", "start", "end")


_SERVER = "e AS (SELECT event_type, user_id, event_id, epoch_us(ts) AS t, epoch_us(ts) + round(value * 60000000)::BIGINT AS stop, 1 + event_id % 8 AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)"


@query(
    f"""WITH RECURSIVE {_SERVER}, r AS (SELECT event_type, NULL::BIGINT AS event_id, 0::BIGINT AS k, NULL::BOOLEAN AS accepted, []::BIGINT[] AS live FROM events GROUP BY event_type UNION ALL
SELECT event_type, event_id, k, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, t + 21600000000) ELSE live END FROM (SELECT e.event_type, e.event_id, e.k, e.t, list_filter(r.live, lambda x: x >= e.t) AS live FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1))
SELECT event_type, event_id, accepted, len(live)::INT AS live FROM r WHERE event_id IS NOT NULL"""
)
def session_capacity(spark, d):
    """Each event opens a session on the server that its type names: three at most, of six hours each."""
    return S.session_capacity(table(spark, d, "events"), "event_type", 3, 6 * 3600).select("event_type", "event_id", "accepted", "live")


@query(
    f"""WITH RECURSIVE {_SERVER}, r AS (SELECT event_type, NULL::BIGINT AS event_id, 0::BIGINT AS k, NULL::VARCHAR AS answer, []::BIGINT[] AS ends, []::STRUCT(u BIGINT, n BIGINT)[] AS taken FROM events GROUP BY event_type UNION ALL
SELECT event_type, event_id, k, answer, CASE WHEN answer = 'accepted' THEN list_append(ends, stop) ELSE ends END, CASE WHEN answer = 'accepted' THEN list_append(taken, {{'u': user_id::BIGINT, 'n': n::BIGINT}}) ELSE taken END
FROM (SELECT *, CASE WHEN len(ends) >= 2 THEN 'busy' WHEN n + coalesce(list_sum(list_transform(list_filter(taken, lambda x: x.u = user_id), lambda x: x.n)), 0) > 20 THEN 'limit' ELSE 'accepted' END AS answer
FROM (SELECT e.event_type, e.event_id, e.k, e.user_id, e.n, e.stop, list_filter(r.ends, lambda x: x > e.t) AS ends, r.taken FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)))
SELECT event_type, event_id, answer FROM r WHERE event_id IS NOT NULL"""
)
def score_admission(spark, d):
    """Scoring requests on the server that the type names: two at a time, twenty new sentences for each session."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").select("event_type", t.alias("start"), "event_id", (t + F.round(F.col("value") * 60000000).cast("long")).alias("end"), F.col("user_id").alias("session"), (1 + F.col("event_id") % 8).alias("n"))
    return S.score_admission(e, "event_type", 2, 20).select("event_type", "event_id", "answer")


_BURST = """b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS burst FROM (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 14400000000, TRUE)::INT AS n FROM events))"""


def _bursts(spark, d):
    return S.debounced(table(spark, d, "events"), "user_id", "ts", "event_id", 4 * 3600)


@query(f"WITH {_BURST} SELECT user_id, burst, count(*) AS n FROM b GROUP BY ALL")
def debounce_sessions(spark, d):
    return _bursts(spark, d).groupBy("user_id", "burst").agg(F.count("*").alias("n"))


@query(f"WITH {_BURST} SELECT user_id, event_id, burst, ceil(row_number() OVER (PARTITION BY user_id, burst ORDER BY ts, event_id) / 2.0)::INT AS batch FROM b")
def micro_batches(spark, d):
    return S.micro_batches(_bursts(spark, d), ["user_id", "burst"], ["ts", "event_id"], 2).select("user_id", "event_id", "burst", "batch")


@query(f"WITH {_BURST} SELECT user_id, burst, min(value) FILTER (WHERE event_type <> 'error') AS first_ms, CASE WHEN bool_and(event_type <> 'error') THEN max(value) END AS complete_ms, CASE WHEN bool_and(event_type = 'view') THEN 'hit' ELSE 'miss' END AS cache, count_if(event_type = 'error')::BIGINT AS wasted FROM b GROUP BY ALL")
def viewport_observations(spark, d):
    ok = F.col("event_type") != "error"
    g = _bursts(spark, d).groupBy("user_id", "burst")
    return g.agg(
        F.min(F.when(ok, F.col("value"))).alias("first_ms"), F.when(F.bool_and(ok), F.max("value")).alias("complete_ms"),
        F.when(F.bool_and(F.col("event_type") == "view"), "hit").otherwise("miss").alias("cache"), F.count_if(~ok).alias("wasted"),
    )


@query("SELECT event_id, event_type = first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS allowed FROM events")
def first_declaration(spark, d):
    return S.first_declaration(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "allowed")


# --- sources -------------------------------------------------------------------------------------------------
@query("SELECT event_id, NOT json_valid(line) AS malformed, CASE WHEN json_valid(line) THEN json_extract(line, '$.k')::BIGINT END AS k FROM (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN props[1:3] ELSE props END AS line FROM events)")
def jsonl_parse_audit(spark, d):
    """Every fiftieth line is broken on purpose."""
    broken = F.when(F.col("event_id") % 50 == 7, F.left("props", F.lit(3))).otherwise(F.col("props"))
    a = I.audit_jsonl(table(spark, d, "events").select("event_id", broken.alias("line")), F.col("line"), "k long")
    return a.select("event_id", "malformed", F.when(~F.col("malformed"), F.col("record.k")).alias("k"))


@query("SELECT event_id, 2 AS n_items, event_type AS first FROM events")
def parse_list_cells(spark, d):
    """Odd rows hold Python literals, even rows JSON."""
    cell = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("['"), "event_type", F.lit("', 'x']"))).otherwise(F.concat(F.lit('["'), "event_type", F.lit('", "x"]')))
    parsed = table(spark, d, "events").select("event_id", I.parse_list_column(cell).alias("items"))
    return parsed.select("event_id", F.size("items").alias("n_items"), F.col("items")[0].alias("first"))


@query()
def file_checksum_join(spark, d):
    """Checksums of two table files against sidecar rows made from them, one with another revision."""
    files = I.file_checksums(spark, f"{d}/nation.parquet").unionByName(I.file_checksums(spark, f"{d}/region.parquet"))
    side = files.select("path", "sha256", F.when(F.col("path").contains("nation"), "r1").otherwise("r0").alias("revision"))
    return I.verified(files, side, "r1").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256", "ok")

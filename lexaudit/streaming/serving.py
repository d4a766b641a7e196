"""Serving rules over event tables: rate limits, sessions, caches, the budget ledger, concurrency, batching.

Order-dependent rules run as a fold over rows that are dealt by key and sorted
inside their partitions, with the state of one key at a time; no key's rows are
gathered.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

USD_PER_TOKEN, RESERVED_TOKENS, MAX_USD = 0.042 / 1e6, 64_000, 25.0


def fold(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple]) -> DataFrame:
    """Rows (key, order columns..., outputs) of a sequential rule. step(state, row) returns (state, outputs)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for p in parts:
            out = []
            for row in p.itertuples(index=False):
                if row[0] != last:
                    last, state = row[0], start()
                state, made = step(state, row)
                out.append((*row, *made))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    dealt = df.select(key, *order, *[c for c in df.columns if c not in (key, *order)])
    return dealt.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rate_limit(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, t, event_id, n, accepted): windows begin with a key's first event after the last window; t in whole microseconds."""

    def step(state, row):
        n, reset = state
        n, reset = (1, row[1] + seconds * 1_000_000) if reset is None or reset < row[1] else (n + 1, reset)
        return (n, reset), (n, n <= limit)

    e = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return fold(e, "user_id", ["t", "event_id"], "user_id long, t long, event_id long, n int, accepted boolean", lambda: (0, None), step)


def session_ttl(events: DataFrame, seconds: int) -> DataFrame:
    """(user_id, t, event_id, session): a session ends a fixed time after it began, however often it is used."""

    def step(state, row):
        k, end = state
        k, end = (k + 1, row[1] + seconds * 1_000_000) if end is None or end < row[1] else (k, end)
        return (k, end), (k,)

    e = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return fold(e, "user_id", ["t", "event_id"], "user_id long, t long, event_id long, session int", lambda: (0, None), step)


def ledger(events: DataFrame, usd: float, requests: int, tokens: int) -> DataFrame:
    """(ledger, seq, op, reservation, used, accepted, requests, tokens, usd) of reserve and settle events, one state for each ledger.

    A reservation takes a request, its tokens and their price if all stay under their caps; settling gives the unused part back once.
    """
    if not 0 < usd <= MAX_USD or requests <= 0 or tokens <= 0:
        raise ValueError("limits must be positive, and at most 25 USD")

    def step(state, row):
        n, tok, pending = state
        _, _, op, rid, used = row
        ok = False
        if op == "reserve":
            ok = n + 1 <= requests and tok + RESERVED_TOKENS <= tokens and (tok + RESERVED_TOKENS) * USD_PER_TOKEN <= usd
            if ok:
                n, tok = n + 1, tok + RESERVED_TOKENS
                pending.add(rid)
        elif rid in pending and 0 <= used <= RESERVED_TOKENS:
            ok = True
            pending.discard(rid)
            tok -= RESERVED_TOKENS - used
        return (n, tok, pending), (ok, n, tok, tok * USD_PER_TOKEN)

    schema = "ledger string, seq long, op string, reservation long, used long, accepted boolean, requests long, tokens long, usd double"
    return fold(events.select("ledger", "seq", "op", "reservation", "used"), "ledger", ["seq"], schema, lambda: (0, 0, set()), step)


def session_capacity(events: DataFrame, server: str, capacity: int, seconds: int) -> DataFrame:
    """(server, t, event_id, accepted, live): a session is opened if fewer than ``capacity`` are live on the server; those that have expired are forgotten first."""

    def step(live, row):
        while live and live[0] < row[1]:  # all last equally long, so the first opened is the first to go
            live.popleft()
        ok = len(live) < capacity
        if ok:
            live.append(row[1] + seconds * 1_000_000)
        return live, (ok, len(live))

    e = events.select(server, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return fold(e, server, ["t", "event_id"], f"{server} string, t long, event_id long, accepted boolean, live int", deque, step)


def score_admission(requests: DataFrame, server: str, active: int, new: int) -> DataFrame:
    """(server, start, event_id, end, session, n, answer): busy while ``active`` requests run on the server, limit when a session would pass ``new`` sentences, else accepted.

    requests: server, start and end in microseconds, event_id, session, n (sentences that are not in the session's cache).
    The state is the running requests and one counter for each session of a server.
    """

    def step(state, row):
        ends, taken = state
        _, start, _, end, session, n = row
        while ends and ends[0] <= start:
            heapq.heappop(ends)
        if len(ends) >= active:
            return state, ("busy",)
        if taken.get(session, 0) + n > new:
            return state, ("limit",)
        heapq.heappush(ends, end)
        taken[session] = taken.get(session, 0) + n
        return state, ("accepted",)

    schema = f"{server} string, start long, event_id long, end long, session long, n long, answer string"
    return fold(requests.select(server, "start", "event_id", "end", "session", "n"), server, ["start", "event_id"], schema, lambda: ([], {}), step)


def first_seen(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with ``hit``: whether the key was seen before."""
    return events.withColumn("hit", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def concurrency_peak(events: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, peak): the most intervals [start, end) that are open at once; a close counts before an open at the same time."""
    moves = events.select(by, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("m")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("m")))).alias("x")).select(by, "x.*")
    moves = moves.groupBy(by, "t", "m").agg(F.sum("m").alias("d"))
    open_now = F.sum("d").over(Window.partitionBy(by).orderBy("t", "m").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return moves.withColumn("open", open_now).groupBy(by).agg(F.max("open").alias("peak"))


def debounced(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Rows with ``burst``: a new one begins after a pause of over the gap."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce(t - F.lag(t).over(w) > int(gap_seconds * 1e6), F.lit(True)).cast("int")
    return events.withColumn("__new", new).withColumn("burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def micro_batches(events: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """Rows with ``batch`` from 1: runs of ``size`` rows."""
    return events.withColumn("batch", F.ceil(F.row_number().over(Window.partitionBy(*key).orderBy(*order)) / size).cast("int"))


def first_declaration(events: DataFrame, key: str, order: list[str], declared: str) -> DataFrame:
    """Rows with ``allowed``: the first declaration of a key, and later ones that are the same."""
    first = events.groupBy(key).agg(F.min_by(declared, F.struct(*order)).alias("__first"))
    return events.join(first, key).withColumn("allowed", F.col(declared).eqNullSafe(F.col("__first"))).drop("__first")

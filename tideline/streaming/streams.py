"""Streaming forms of ingest, segmentation, sessions and focus sums."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEGMENTS = "file string, match_no long, zone string, start_ms long, end_ms long, complete boolean"
STATE = "match_no long, zone string, start_ms long, last_ms long"


def _segments(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    no, zone, start, last = state.get if state.exists else (0, None, None, None)
    out = []
    if state.hasTimedOut:
        if zone is not None:
            out.append((key[0], no, zone, start, last, False))
        state.remove()
    else:
        rows = pd.concat(list(batches)).sort_values("seq")
        for event, at, arg in zip(rows["event"], rows["ts_ms"], rows["zone"], strict=True):
            at = int(at)
            if event == "ARENA_MATCH_START":
                if zone is not None:
                    out.append((key[0], no, zone, start, last, False))
                no, zone, start = no + 1, arg, at
            elif zone is not None and event in ("ARENA_MATCH_END", "ZONE_CHANGE"):
                out.append((key[0], no, zone, start, at, event == "ARENA_MATCH_END"))
                zone = None
            last = at
        state.update((no, zone, start, last))
        state.setTimeoutDuration(30 * 60_000)
    yield pd.DataFrame(out, columns=["file", "match_no", "zone", "start_ms", "end_ms", "complete"])


def segment_matches(lines: DataFrame) -> DataFrame:
    """Matches of a stream of parsed lines (file, seq, ts_ms, event, zone: the first field): each closes at its end
    line, at a change of zone or at the next start; one that stays open for half an hour without a line is given out
    as incomplete. Lines of a file must come in order of their batches."""
    return lines.groupBy("file").applyInPandasWithState(_segments, SEGMENTS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def sliding_damage(hits: DataFrame, late: str = "10 seconds", window: str = "5 seconds", step: str = "500 milliseconds") -> DataFrame:
    """Damage by attacker and target in sliding windows of a stream (ts, attacker, target, amount). Windows hold their
    start and not their end, whereas the batch form holds both."""
    return hits.withWatermark("ts", late).groupBy(F.window("ts", window, step), "attacker", "target").agg(F.sum("amount").alias("amount"))


FOCUS = "attacker string, tick_ms long, target string"
FOCUS_STATE = "hits string, tick long, target string"


def _best_target(hits: list, tick: int, window_ms: int, before: str | None) -> str | None:
    """The target of most damage in the closed window before a tick; the one before stays unless it is exceeded."""
    sums: dict[str, list] = {}
    for at, target, amount in hits:
        if tick - window_ms <= at <= tick:
            own = sums.setdefault(target, [0, at])
            own[0], own[1] = own[0] + amount, min(own[1], at)
    most = max((v[0] for v in sums.values()), default=0)
    if most <= 0:
        return None
    if before in sums and sums[before][0] >= most:
        return before
    return min((v[1], k) for k, v in sums.items() if v[0] == most)[1]


def focus_changes(hits: DataFrame, late: str = "10 seconds", window_ms: int = 5000, step_ms: int = 500) -> DataFrame:
    """Changes of each attacker's dominant target (null: none) in a stream of hits (ts, attacker, target, amount): attacker,
    tick_ms, target, as ``sequences.focus`` has it on a grid of whole steps. A tick is decided when the watermark has
    passed it; the state is the hits of one window and those not yet decided, and goes when the window is empty."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        listed, tick, target = state.get if state.exists else ("[]", None, None)
        held = json.loads(listed)
        for rows in batches:
            at = rows["ts"].astype("datetime64[ms]").astype("int64")
            held += [[int(t), str(g), int(a)] for t, g, a in zip(at, rows["target"], rows["amount"], strict=True)]
        held.sort()
        passed, out = state.getCurrentWatermarkMs(), []
        if held and tick is None:
            tick = -(-held[0][0] // step_ms) * step_ms
        while tick is not None and tick <= passed:
            if not held and target is None:
                tick = None
                break
            best = _best_target(held, tick, window_ms, target)
            if best != target:
                out.append((key[0], tick, best))
                target = best
            tick += step_ms
            held = [h for h in held if h[0] >= tick - window_ms]
            if target is None and held and held[0][0] > tick:
                tick = -(-held[0][0] // step_ms) * step_ms
        if tick is None or (not held and target is None):
            state.remove()
        else:
            state.update((json.dumps(held), tick, target))
            state.setTimeoutTimestamp(max(tick, passed + 1))
        yield pd.DataFrame(out, columns=["attacker", "tick_ms", "target"])

    return hits.withWatermark("ts", late).groupBy("attacker").applyInPandasWithState(run, FOCUS, FOCUS_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def grid_counts(positions: DataFrame, cell: float = 2.0) -> DataFrame:
    """Visits by zone and cell of a stream of positions (zone, x, y), as running totals: the state is one number for
    each cell that was ever visited, however many positions there are. Write it in the mode complete or update."""
    return positions.groupBy("zone", F.floor(F.col("x") / cell).alias("col"), F.floor(F.col("y") / cell).alias("row")).agg(F.count(F.lit(1)).alias("n"))


def sessions(matches: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a stream of matches (ts, character, duration_sec, result): the gap is from one match's end to the
    next one's start, each match holding its session open for its duration and the gap."""
    hold = F.concat((F.coalesce("duration_sec", F.lit(0)) + _seconds(gap)).cast("string"), F.lit(" seconds"))
    grouped = matches.withWatermark("ts", late).groupBy(F.session_window("ts", hold), "character")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result") == "win").alias("wins"), F.count_if(F.col("result") == "loss").alias("losses")).select("character", F.col("session_window.start").alias("start"), "n", "wins", "losses")


def _seconds(gap: str) -> int:
    n, unit = gap.split()
    return int(n) * {"s": 1, "m": 60, "h": 3600, "d": 86_400}[unit[0]]


def upsert_stream(rows: DataFrame, store, name: str, checkpoint: str):
    """A query that upserts every batch of a stream into a store's table by its whole key, so the rows of a match may come
    in several batches; batches that are repeated after a failure give the same table."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(name, batch.dropDuplicates(store.KEYS[name]))

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

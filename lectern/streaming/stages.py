"""Streaming forms: the rate limiter as keyed state, and the stage event feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.trace import MOST_REQUESTS, STAGES, WINDOW_SECONDS, server_sent

EVENT = "request_id string, seq long, stage string, status string, detail string, verdict string, token string"


def rate_limit(requests: DataFrame, window: int = WINDOW_SECONDS, most: int = MOST_REQUESTS, idle: int = 3600) -> DataFrame:
    """A stream of (key, seconds, id) with accepted. The state of a key is its accepted times within the window, `most` at most;
    it goes when no request has come for `idle` seconds, which is longer than rows are late. A request without a time is accepted and leaves no trace.

    Rows of a key are taken in the order of (seconds, id) within a micro-batch; batches are taken in arrival order.
    Spark runs batches without rows for a processing-time timeout, without end: with the trigger availableNow set
    spark.sql.streaming.noDataMicroBatches.enabled to false; states then go in the next batch that has rows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["seconds", "id"])
        accepted = []
        for t in rows["seconds"]:
            if pd.isna(t):
                accepted.append(True)
                continue
            log = [x for x in log if t - x <= window]
            accepted.append(len(log) < most)
            if accepted[-1]:
                log.append(t)
        state.update((log,))
        state.setTimeoutDuration(max(idle, window) * 1000)
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "accepted": accepted})

    return requests.groupBy("key").applyInPandasWithState(step, "key long, id long, accepted boolean", "log array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


TRACE = "request_id long, n_events long, last_stage string, active_index long, failed boolean, finished boolean, failed_stage string, silent boolean"


#: Groups that the requests of a stream are dealt to by a hash: a call of Python is for a group, not for a request.
GROUPS = 1024


def traces(events: DataFrame, late: str = "10 minutes", settle: int = 60, idle: int = 3600, groups: int = GROUPS) -> DataFrame:
    """A trace of each request of a stream of (request_id, seq, ts, stage, status, is_token), as reduce_traces and failure_stage give it.

    An error or compose/done ends a request, whatever the order in which its events come: it is reduced when the watermark
    (`late` behind the newest ts) has passed its newest event by `settle` seconds, or by `idle` seconds if no end has come,
    and is then silent, failed at the stage after its last one that was done. The state of a request is its events up to its
    end, without tokens; once reduced it is a mark that later events are dropped by, which goes after another `idle` seconds.
    The states of the requests of a group are one row.
    Rows without a ts or a request_id are dropped, and a trace that has token events alone isn't one.
    """

    def reduced(rows: list[tuple]) -> dict | None:
        rows = sorted(rows)
        if not rows:
            return None
        seq, stage, status = rows[-1]
        bad = [r for r in rows if r[2] == "error"]
        ended = status == "error" or (stage, status) == ("compose", "done")
        done = [r[1] for r in rows if r[2] == "done" and (not bad or r[0] < bad[0][0])]
        good = len(rows) - len(bad)
        names = list(STAGES)
        after = (names[min(names.index(done[-1]) + 1, len(names) - 1)] if done[-1] in names else names[0]) if done else names[0]
        return {"n_events": good, "last_stage": stage, "active_index": good - 1, "failed": bool(bad), "finished": any(r[1:] == ("compose", "done") for r in rows), "failed_stage": after if bad or not ended else None, "silent": not ended}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, newest, due, over, of, seqs, names, statuses = state.get if state.exists else [[]] * 8
        held = {i: [n, d, o, []] for i, n, d, o in zip(ids, newest, due, over, strict=True)}  # newest ts, when it is due, whether it is over, events
        for i, *row in zip(of, seqs, names, statuses, strict=True):
            held[i][3].append(tuple(row))
        watermark, met = state.getCurrentWatermarkMs(), set()
        for frame in () if state.hasTimedOut else frames:
            at, token = frame["ts"].astype("datetime64[ms]").astype("int64"), frame["is_token"].fillna(False).astype(bool)
            met.update(frame["request_id"].tolist())
            for i, t, dropped, *row in zip(frame["request_id"].tolist(), at.tolist(), token.tolist(), frame["seq"].tolist(), frame["stage"].tolist(), frame["status"].tolist(), strict=True):
                one = held.get(i) or held.setdefault(i, [0, 0, False, []])
                if t > one[0]:
                    one[0] = t
                if not dropped and not one[2]:
                    one[3].append(tuple(row))
        for i in met:
            one = held[i]
            ends = [r[0] for r in one[3] if r[2] == "error" or r[1:] == ("compose", "done")]
            if ends:
                first = min(ends)
                one[3] = [r for r in one[3] if r[0] <= first]
            one[1] = max(one[0] + (settle if ends else idle) * 1000, watermark + 1)
        found = []
        for i in [i for i, one in held.items() if one[1] < watermark]:
            _, _, was_over, rows = held[i]
            if was_over:
                del held[i]
                continue
            if (trace := reduced(rows)) is not None:
                found.append({"request_id": i, **trace})
            held[i][1:] = [watermark + idle * 1000, True, []]
        if held:
            events_of = [(i, *row) for i, one in held.items() for row in one[3]]
            state.update((list(held), *([one[k] for one in held.values()] for k in range(3)), *([e[k] for e in events_of] for k in range(4))))
            state.setTimeoutTimestamp(max(min(one[1] for one in held.values()), watermark, 1))
        else:
            state.remove()
        if found:
            yield pd.DataFrame(found)

    kept = events.where("ts is not null and request_id is not null").select("request_id", "seq", "ts", "stage", "status", "is_token").withWatermark("ts", late)
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64("request_id"), F.lit(groups)))
    held = "ids array<long>, newest array<long>, due array<long>, over array<boolean>, of array<long>, seqs array<long>, stages array<string>, statuses array<string>"
    return dealt.groupBy("_group").applyInPandasWithState(step, TRACE, held, "append", GroupStateTimeout.EventTimeTimeout)


def stage_events(records: DataFrame) -> DataFrame:
    """The events that records (request_id, seq, kind, stage, status, detail, token) of replies stand for: a token is compose
    that is active, an error is its stage's with its detail, an event stays as it is, and done, which ends a request, is none."""
    kind = F.col("kind")
    stage = F.when(kind == "token", "compose").otherwise(F.col("stage"))
    status = F.when(kind == "token", "active").when(kind == "error", "error").otherwise(F.col("status"))
    return records.where(kind.isin("event", "token", "error")).select("request_id", "seq", stage.alias("stage"), status.alias("status"), F.when(kind != "token", F.col("detail")).alias("detail"), F.when(kind == "token", F.col("token")).alias("token"))


def feed(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Server-sent lines of a stream of events as text files."""
    lines = events.select(server_sent(F.struct(*(c for c in events.columns if c not in ("request_id", "seq")))).alias("value"))
    return lines.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)

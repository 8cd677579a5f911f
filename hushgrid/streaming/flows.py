"""Structured Streaming: retention, ledgers, timelines, request metrics, windows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def retention(jobs: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """job_id, destroyed_at, receipt: each job destroyed once, when the event time passes created_at + ttl_s.

    jobs: job_id, created_at, ttl_s. A second row of a job neither moves its deadline nor destroys it again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (job,) = key
        if state.hasTimedOut:
            deadline, done = state.get
            state.update((deadline, True))
            at = pd.Timestamp(deadline, unit="ms")
            yield pd.DataFrame({"job_id": [job], "destroyed_at": [at], "receipt": [hashlib.sha256(f"{job}|{deadline}".encode()).hexdigest()]})
            return
        first = None
        for b in batches:
            ends = b["created_at"].astype("datetime64[ms]").astype("int64") + b["ttl_s"] * 1000
            first = int(ends.min()) if first is None else min(first, int(ends.min()))
        if not state.exists and first is not None:
            state.update((first, False))
            state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))

    kept = jobs.withWatermark("created_at", lateness)
    return kept.groupBy("job_id").applyInPandasWithState(step, "job_id string, destroyed_at timestamp, receipt string", "deadline long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def ledger(events: DataFrame) -> DataFrame:
    """Each job's events as links of a hash chain; its state is the last number and hash.

    Events of one trigger are taken in order of time. One older than what is already chained cannot take its place
    any more: it is chained as it comes, with ``late`` true, so nothing that happened is missing from the ledger.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, prev, last = state.get if state.exists else (0, "0" * 64, -(1 << 62))
        rows = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_type"]).itertuples():
            at = r.ts.value // 1000
            late = at < last
            number, last = number + 1, max(at, last)
            body = json.dumps({"details": r.details, "event_type": r.event_type, "prev_hash": prev, "sequence": number, "ts": at}, sort_keys=True, separators=(",", ":"))
            own = hashlib.sha256(body.encode()).hexdigest()
            rows.append((key[0], number, r.event_type, r.ts, r.details, prev, own, late))
            prev = own
        state.update((number, prev, last))
        yield pd.DataFrame(rows, columns=["job_id", "sequence", "event_type", "ts", "details", "prev_hash", "event_hash", "late"])

    return events.groupBy("job_id").applyInPandasWithState(step, "job_id string, sequence long, event_type string, ts timestamp, details string, prev_hash string, event_hash string, late boolean", "number long, prev string, last long", "append", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "10 minutes", step: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    return e.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select(F.col("window.start").alias("start"), "n", "peak")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(mentions: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """One row of each (entity_type, normalized) while the watermark lasts."""
    return mentions.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["entity_type", "normalized"])


def sampled_frames(frames: DataFrame, fps: float, cap: int = 120) -> DataFrame:
    """Two frames a second and the last; more than ``cap`` are thinned evenly. frames: video_id, frame_index, n_frames."""
    stride = max(1, round(fps / 2))
    step = F.greatest(F.lit(stride), F.ceil(F.col("n_frames") / (cap - 1)).cast("int"))
    return frames.filter((F.col("frame_index") % step == 0) | (F.col("frame_index") == F.col("n_frames") - 1))


LIFE = {"CREATED": ("UPLOADED", "DESTROYED", "FAILED"), "UPLOADED": ("ANALYSED", "HUMAN_REVIEW_REQUIRED", "DESTROYED", "FAILED"), "ANALYSED": ("TRANSFORMED", "DESTROYED", "FAILED"), "HUMAN_REVIEW_REQUIRED": ("ANALYSED", "DESTROYED", "FAILED"), "TRANSFORMED": ("VERIFIED_SAFE", "RELEASE_BLOCKED", "DESTROYED", "FAILED"), "VERIFIED_SAFE": ("TRANSFORMED", "DESTROYED"), "RELEASE_BLOCKED": ("TRANSFORMED", "DESTROYED"), "FAILED": ("DESTROYED",), "DESTROYED": ()}


def bad_transitions(history: DataFrame) -> DataFrame:
    """Steps of a job (job_id, ts, state) that its life does not allow."""
    prev = F.lag("state").over(Window.partitionBy("job_id").orderBy("ts"))
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for kv in LIFE.items() for x in kv])
    marked = history.withColumn("prev", prev)
    return marked.filter(F.col("prev").isNotNull() & ~F.array_contains(F.element_at(allowed, F.col("prev")), F.col("state")))


def expired(events: DataFrame, job: str, ttl_s: int, grace_s: int = 0) -> DataFrame:
    """job_id, deadline: jobs whose time has run out, in batch; now is the last event's time less ``grace_s``. events: job, ts."""
    now = events.agg((F.unix_timestamp(F.max("ts")) - grace_s).alias("now"))  # one row
    jobs = events.groupBy(F.col(job).alias("job_id")).agg((F.unix_timestamp(F.min("ts")) + ttl_s).alias("deadline"))
    return jobs.crossJoin(F.broadcast(now)).filter("deadline <= now").drop("now")


def novel_frames(frames: DataFrame, video: str, order: list[str], signal: str, least: float) -> DataFrame:
    """Frames whose ``signal`` differs from both neighbours by ``least``; the first and last of a video have one neighbour only and are left out."""
    w = Window.partitionBy(video).orderBy(*order)
    step = lambda other: F.abs(F.col(signal) - other.over(w))
    return frames.withColumn("_a", step(F.lag(signal))).withColumn("_b", step(F.lead(signal))).filter((F.col("_a") >= least) & (F.col("_b") >= least)).drop("_a", "_b")

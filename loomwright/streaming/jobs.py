"""The queue of indexing jobs and the limits of rates, over events: in batch by windows, live by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwright.sources.tables import written

STALE_SECONDS, MAX_ATTEMPTS, MESSAGE_CHARS = 600, 3, 500


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def job_states(events: DataFrame, key: str, ts: str, order: str, kind: str, value: str, message: str | None = None) -> DataFrame:
    """(key, status, attempts, progress, first_ts, last_ts) of each job after all its events, and with a column of messages the last
    failure's, cut to MESSAGE_CHARS.

    Events of kind "queued", "claimed", "progress", "failed", "released" or "succeeded"; progress keeps the last value that was told.
    A release takes back an attempt.
    """
    after = {"queued": "queued", "claimed": "running", "progress": "running", "failed": "failed", "released": "queued", "succeeded": "succeeded"}
    status = F.create_map(*[F.lit(x) for pair in after.items() for x in pair])[F.col(kind)]
    last = lambda c: F.max_by(c, F.struct(ts, order))
    told = F.when(F.col(kind) == "progress", F.col(value))
    said = [] if message is None else [F.max_by(F.substring(F.col(message), 1, MESSAGE_CHARS), F.when(F.col(kind) == "failed", F.struct(ts, order))).alias("message")]
    return events.groupBy(key).agg(
        last(status).alias("status"),
        F.greatest(F.sum(F.when(F.col(kind) == "claimed", 1).when(F.col(kind) == "released", -1).otherwise(0)), F.lit(0)).alias("attempts"),
        F.max_by(told, F.when(told.isNotNull(), F.struct(ts, order))).alias("progress"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *said,
    )


def claim_order(jobs: DataFrame, status: str = "queued") -> DataFrame:
    """Queued jobs by the order in which workers claim them: the oldest first, then the lower id.

    Jobs are numbered within ranges of (first_ts, key); a range begins where the ones before it end, by a running sum over the ranges alone. The ranges
    are written once: numbers and sums come from the same ones, whatever is planned or computed again."""
    queued = jobs.filter(F.col("status") == status).select("key", "first_ts")
    ranged = written(queued.repartitionByRange("first_ts", "key").withColumn("range", F.spark_partition_id()), "claims")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("first_ts", "key"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.withColumn("inside", inside).join(F.broadcast(offsets), "range").select((F.col("before") + F.col("inside")).cast("int").alias("turn"), "key", "first_ts")


def claim(jobs: DataFrame, workers: int) -> DataFrame:
    """jobs after each of some workers claimed one: the first queued ones run, with one attempt more and no progress. Made by one writer."""
    chosen = jobs.filter(F.col("status") == "queued").orderBy("first_ts", "key").limit(workers).select("key", F.lit(True).alias("taken"))
    out = jobs.join(F.broadcast(chosen), "key", "left")  # no more rows than workers
    new = {"status": F.when(F.col("taken"), "running").otherwise(F.col("status")), "attempts": F.col("attempts") + F.when(F.col("taken"), 1).otherwise(0), "progress": F.when(F.col("taken").isNull(), F.col("progress"))}
    return out.withColumns(new).drop("taken")


def claimed(jobs: DataFrame, repositories: DataFrame) -> DataFrame:
    """Running jobs (key, repo_id, attempts) with owner and name of their repositories (repo_id, owner, name)."""
    return jobs.filter(F.col("status") == "running").join(repositories, "repo_id").select("key", "repo_id", "owner", "name", "attempts")


def claim_next(jobs: DataFrame) -> DataFrame:
    """The one job to claim."""
    return jobs.filter(F.col("status") == "queued").orderBy("first_ts", "key").limit(1)


def requeue_stale(jobs: DataFrame, now: Column, stale_seconds: int = STALE_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """jobs with running ones that have been silent for too long queued again, or failed after too many attempts."""
    stale = (F.col("status") == "running") & (F.col("last_ts") < now - F.make_interval(secs=F.lit(stale_seconds)))
    status = F.when(stale & (F.col("attempts") >= max_attempts), "failed").when(stale, "queued").otherwise(F.col("status"))
    return jobs.withColumns({"stale": stale, "status": status})


def requeue_counts(jobs: DataFrame) -> DataFrame:
    """(requeued, failed) of requeue_stale(): what it did with silent jobs."""
    return jobs.agg(F.count_if(F.col("stale") & (F.col("status") == "queued")).alias("requeued"), F.count_if(F.col("stale") & (F.col("status") == "failed")).alias("failed"))


_LIVE = "key long, status string, attempts long, progress double, first_ts timestamp, last_ts timestamp, stale boolean"
#: Of a job: the status and when it was told (microseconds, id), claims less releases, the progress and when it was told, the first and the last event.
_HELD = "status string, status_at long, status_id long, claims long, progress double, progress_at long, progress_id long, first long, last long"


def live_jobs(events: DataFrame, key: str, ts: str, order: str, kind: str, value: str, stale_seconds: int = STALE_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """job_states of a stream of events, in update mode: a row (key, status, attempts, progress, first_ts, last_ts, stale) whenever a job changes.

    Each running job has a timer. One that nothing is heard of for stale_seconds is queued again, or fails after too many attempts, by the timer alone; its
    row is stale. Events may come in any order: the latest by (ts, order) decides. Jobs without a key are one job."""
    told = events.select(F.col(key).cast("long").alias("key"), _micros(ts).alias("at"), F.col(order).cast("long").alias("id"), F.col(kind).alias("kind"), F.col(value).cast("double").alias("value"))
    after = {"queued": "queued", "claimed": "running", "progress": "running", "failed": "failed", "released": "queued", "succeeded": "succeeded"}
    names = [x.split()[0] for x in _HELD.split(", ")]

    def row(who: object, held: dict, stale: bool) -> pd.DataFrame:
        stamp = lambda micros: pd.Timestamp(micros, unit="us")
        return pd.DataFrame({"key": pd.array([who], "Int64"), "status": [held["status"]], "attempts": [max(held["claims"], 0)], "progress": [held["progress"]], "first_ts": [stamp(held["first"])], "last_ts": [stamp(held["last"])], "stale": [stale]})

    def follow(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = who[0] is None or pd.isna(who[0])
        held = dict(zip(names, state.get, strict=True)) if state.exists else dict.fromkeys(names)
        if state.hasTimedOut:
            held["status"] = "failed" if max(held["claims"], 0) >= max_attempts else "queued"
            state.update(tuple(held[c] for c in names))
            yield row(None if none else int(who[0]), held, True)
            return
        held["claims"] = held["claims"] or 0
        for part in parts:
            for at, n, what, number in zip(part["at"].tolist(), part["id"].tolist(), part["kind"], part["value"].tolist(), strict=True):
                if held["status_at"] is None or (at, n) >= (held["status_at"], held["status_id"]):
                    held |= {"status": after.get(what), "status_at": at, "status_id": n}
                held["claims"] += (what == "claimed") - (what == "released")
                if what == "progress" and number == number and (held["progress_at"] is None or (at, n) >= (held["progress_at"], held["progress_id"])):
                    held |= {"progress": number, "progress_at": at, "progress_id": n}
                held |= {"first": at if held["first"] is None else min(at, held["first"]), "last": at if held["last"] is None else max(at, held["last"])}
        state.update(tuple(held[c] for c in names))
        if held["status"] == "running":
            state.setTimeoutDuration(stale_seconds * 1_000)
        yield row(None if none else int(who[0]), held, False)

    return told.groupBy("key").applyInPandasWithState(follow, _LIVE, _HELD, "update", GroupStateTimeout.ProcessingTimeTimeout)


def in_trailing(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """events with in_window: how many of the key's events lie in the seconds up to each, itself and those of its instant included; an event exactly that old no longer counts.

    Time is cut into slots of that many seconds, and a slot sees the one before it as well: a key with many events fills many tasks."""
    span = seconds * 1_000_000
    slot = F.floor(_micros(ts) / span)
    seen = F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))))
    rows = events.withColumn("_at", seen)
    window = Window.partitionBy(key, "_at.slot").orderBy(_micros(ts)).rangeBetween(-(span - 1), 0)
    return rows.withColumn("in_window", F.count("*").over(window)).filter("_at.own").drop("_at")


def token_bucket(events: DataFrame, key: str, ts: str, order: str, per_minute: int) -> DataFrame:
    """(key, order, allowed): a bucket of per_minute tokens for each key, refilled steadily, one token a request. Requests without a key share a bucket.

    A task passes over its keys' requests in order and carries the open bucket alone."""
    # A null would turn the keys of a batch into floats.
    wanted = events.select(F.coalesce(F.col(key), F.lit(0)).alias("key"), F.col(key).isNull().alias("none"), _micros(ts).alias("at"), F.col(order).alias("id"))

    def spend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, {}
        for part in parts:
            for who, requests in part.groupby(["key", "none"], sort=False):
                if who != now:
                    now, state = who, {}
                yield pd.DataFrame({"key": requests["key"], "none": requests["none"], "id": requests["id"], "allowed": _spend(requests, per_minute, state)})

    dealt = wanted.repartition("key", "none").sortWithinPartitions("key", "none", "at", "id")
    out = dealt.mapInPandas(spend, "key long, none boolean, id long, allowed boolean")
    return out.select(F.when(~F.col("none"), F.col("key")).alias("key"), "id", "allowed")


def _spend(requests: pd.DataFrame, per_minute: int, state: dict) -> list[bool]:
    """state: micro-tokens and the time they were counted at; whole numbers, so that the result does not depend on how requests are cut into batches."""
    full, out = per_minute * 60_000_000, []
    tokens, last = state.get("tokens", full), state.get("last")
    for at in requests["at"]:
        at = int(at)
        if last is not None:
            tokens = min(full, tokens + max(0, at - last) * per_minute)
        last = at if last is None else max(last, at)
        out.append(tokens >= 60_000_000)
        tokens -= 60_000_000 * out[-1]
    state |= {"tokens": tokens, "last": last}
    return out


def token_bucket_stream(events: DataFrame, key: str, ts: str, order: str, per_minute: int, idle_minutes: int | None = None) -> DataFrame:
    """token_bucket over a stream. With idle_minutes, for a stream that never ends, a key's bucket, full again by then, is forgotten (a drained stream would wait for that)."""
    wanted = events.select(F.col(key).alias("key"), _micros(ts).alias("at"), F.col(order).alias("id"))

    def spend(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(("tokens", "last"), state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(parts)).sort_values(["at", "id"])
        allowed = _spend(rows, per_minute, held)
        state.update((held["tokens"], held["last"]))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60_000)
        yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "allowed": allowed})

    return wanted.groupBy("key").applyInPandasWithState(spend, "key long, id long, allowed boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)


def counts_stream(events: DataFrame, ts: str, kind: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of tumbling windows; events later than the watermark are left out of a stream."""
    counted = events.withWatermark(ts, late) if events.isStreaming else events
    return counted.groupBy(F.window(ts, every), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col(kind).alias("kind"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what a stream has now to Parquet, and stops; a later call goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

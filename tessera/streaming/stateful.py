"""Structured Streaming: deduplication, leases, turns and event-sourced state machines.

Each operator is a stream transformation; `run_once` drains a file source through it, as a test or a
catch-up job would, with the availableNow trigger and a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.validation import STATE_EDGES


def run_once(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], path: str, mode: str = "append") -> DataFrame:
    """Streams the parquet files under `source` through `work` into a table at `path`, and reads it."""
    stream = work(spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source))
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def once_each(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Drops events whose key has come before, within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def lease_claims(stream: DataFrame, resource: str, holder: str, ts: str, event: str, ttl_s: float) -> DataFrame:
    """Claims of leases, in event order: `claimed`, `reclaimed` from a holder whose lease is not younger
    than the TTL (strictly), `already_owned`; a release counts only from the holder. Answers go out a part at a time: of a resource's
    rows of one micro-batch, a task holds the columns alone."""
    out = f"{resource} long, {holder} string, {ts} timestamp, {event} long, outcome string"

    def claim(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, since = state.get if state.exists else (None, 0.0)
        f = sorted_columns(frames, [ts, event], [holder])
        for part in parts(f):
            outcomes = []
            for h, now in zip(part[holder], seconds(part[ts]), strict=True):
                if owner is not None and now - since < ttl_s and owner != h:
                    outcomes.append("already_owned")
                else:
                    outcomes.append("claimed" if owner is None else "renewed" if owner == h else "reclaimed")
                    owner, since = h, now
            part = part.assign(outcome=outcomes)
            part.insert(0, resource, key[0])
            yield part[[resource, holder, ts, event, "outcome"]]
        state.update((owner, since))

    return stream.groupBy(resource).applyInPandasWithState(claim, out, "owner string, since double", "append", GroupStateTimeout.NoTimeout)


#: Rows of one part of a key's answers.
PART = 50_000


def sorted_columns(frames: Iterator[pd.DataFrame], by: list[str], names: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in event order: these columns alone, names as categories."""
    got = []
    for f in frames:
        got.append(f[[*by, *names]].astype(dict.fromkeys(names, "category")))
    kinds = {n: pd.api.types.union_categoricals([f[n] for f in got]).categories for n in names}
    for k, f in enumerate(got):
        got[k] = f.assign(**{n: f[n].cat.set_categories(kinds[n]) for n in names})
    whole = pd.concat(got, ignore_index=True)
    got.clear()
    return whole.sort_values(by, ignore_index=True)


def parts(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for k in range(0, len(f), PART):
        part = f.iloc[k : k + PART]
        names = [c for c in part.columns if isinstance(part[c].dtype, pd.CategoricalDtype)]
        yield part.assign(**{c: part[c].astype(object).where(part[c].notna(), None) for c in names})


def seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("datetime64[us]").astype("int64") / 1e6).tolist()


def sorted_frames(frames: Iterator[pd.DataFrame], by: list[str]) -> list[pd.DataFrame]:
    """A key's rows of one micro-batch in event order."""
    got = list(frames)
    return [pd.concat(got).sort_values(by)] if got else []


def turn_acceptance(stream: DataFrame, user: str, message: str, ts: str, quota: int, ttl_s: float, horizon_s: float = 7 * 86400.0) -> DataFrame:
    """replay (the message id was accepted within the horizon), rested (today's count has reached the quota), busy
    (a lease younger than the TTL), accepted. The order of the checks is part of the result. A turn completes, and
    gives its lease back, after the TTL. Of each user only the ids accepted within the horizon are kept."""
    out = f"{user} long, {message} long, {ts} timestamp, outcome string"

    def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, count, lease, seen, at = state.get if state.exists else ("", 0, 0.0, [], [])
        known, rows, now = dict(zip(seen, at, strict=True)), [], 0.0
        for f in sorted_frames(frames, [ts, message]):
            for m, t in zip(f[message], f[ts], strict=True):
                now, today = t.timestamp(), str(t.date())
                used = count if day == today else 0
                if m in known and now - known[m] < horizon_s:
                    outcome = "replay"
                elif used >= quota:
                    outcome = "rested"
                elif lease and now - lease < ttl_s:
                    outcome = "busy"
                else:
                    outcome, lease, day, count = "accepted", now, today, used + 1
                    known[m] = now
                rows.append((key[0], m, t, outcome))
        kept = sorted((m, t) for m, t in known.items() if now - t < horizon_s)
        state.update((day, count, lease, [m for m, _ in kept], [t for _, t in kept]))
        yield pd.DataFrame(rows, columns=[user, message, ts, "outcome"])

    return stream.groupBy(user).applyInPandasWithState(accept, out, "day string, count long, lease double, seen array<long>, at array<double>", "append", GroupStateTimeout.NoTimeout)


def fold_states(stream: DataFrame, entity: str, to: str, ts: str, event: str, start: str = "queued") -> DataFrame:
    """Applies requested transitions in event order: each with the state before, and whether it was allowed."""
    out = f"{entity} long, {event} long, {ts} timestamp, before string, {to} string, allowed boolean"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now,) = state.get if state.exists else (start,)
        rows = []
        for f in sorted_frames(frames, [ts, event]):
            for e, t, want in zip(f[event], f[ts], f[to], strict=True):
                ok = want in STATE_EDGES[now]
                rows.append((key[0], e, t, now, want, ok))
                now = want if ok else now
        state.update((now,))
        yield pd.DataFrame(rows, columns=[entity, event, ts, "before", to, "allowed"])

    return stream.groupBy(entity).applyInPandasWithState(fold, out, "state string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, kind: str, width: str, delay: str) -> DataFrame:
    """Counts by event-time window and kind, final once the watermark has passed."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def fenced_writes(stream: DataFrame, entity: str, holder: str, to: str, ts: str, event: str, ttl_s: float, end: tuple[str, ...] = ("ready", "failed"), buckets: int = 64) -> DataFrame:
    """Transitions that only the holder of a lease may write: `claimed` or `reclaimed` (a lease that is not younger than the TTL
    is anyone's) at `processing`; `written` by the holder, and an end state gives the lease back; `fenced` for all others;
    `terminal` after an end state. In event order; the state is one holder, one time and one status for each entity. Entities are dealt over so
    many buckets, whose states lie side by side, so that a call costs a bucket and not an entity: their number should grow with the entities."""
    out = f"{entity} long, {event} long, outcome string"

    def write(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {e: (o, s, w) for e, *(o, s, w) in zip(*state.get, strict=True)} if state.exists else {}
        for f in sorted_frames(frames, [ts, event]):
            outcomes = []
            for who, h, now, want in zip(f[entity].tolist(), f[holder], seconds(f[ts]), f[to], strict=True):
                who = None if who != who else who
                owner, since, status = known.get(who, (None, 0.0, "queued"))
                held = owner is not None and now - since < ttl_s
                if status in end:
                    outcome = "terminal"
                elif want == "processing" and not held:
                    outcome, owner, since, status = "claimed" if owner is None else "reclaimed", h, now, "processing"
                elif held and owner == h:
                    outcome, since, status = "written", now, want
                    owner = None if want in end else owner
                else:
                    outcome = "fenced"
                known[who] = (owner, since, status)
                outcomes.append(outcome)
            yield f[[entity, event]].assign(outcome=outcomes).astype({entity: "Int64"})
        state.update(([*known], *map(list, zip(*known.values(), strict=True))))

    # rows without an entity are a bucket of their own: pandas would make the others' longs doubles
    keyed = stream.withColumn("bucket_", F.when(F.col(entity).isNotNull(), F.pmod(F.xxhash64(entity), F.lit(buckets))).otherwise(-1))
    held = "entity array<long>, owner array<string>, since array<double>, status array<string>"
    return keyed.groupBy("bucket_").applyInPandasWithState(write, out, held, "append", GroupStateTimeout.NoTimeout)


def spend_admission(stream: DataFrame, user: str, cost: str, ts: str, event: str, budget: float) -> DataFrame:
    """opening (a user's first request of a day, always admitted and counted), admitted while the day's spend with this request
    stays within the budget, else over_budget (not counted). State: one day and one sum for each user."""
    out = f"{user} long, {event} long, outcome string, spent double"

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, spent = state.get if state.exists else ("", 0.0)
        rows = []
        for f in sorted_frames(frames, [ts, event]):
            for c, t, e in zip(f[cost], f[ts], f[event], strict=True):
                today = str(t.date())
                first = day != today
                day, spent = today, 0.0 if first else spent
                ok = first or spent + c <= budget
                spent += c if ok else 0.0
                rows.append((key[0], e, "opening" if first else "admitted" if ok else "over_budget", spent))
        state.update((day, spent))
        yield pd.DataFrame(rows, columns=[user, event, "outcome", "spent"])

    return stream.groupBy(user).applyInPandasWithState(admit, out, "day string, spent double", "append", GroupStateTimeout.NoTimeout)


"""Keyed state machines in event time, with timers: outcomes do not depend on the order in which rows arrive.

Keys are dealt over buckets. A bucket's rows wait in its state until the watermark has passed them; then each key's are folded in the order of
event time, and timers that come due between two rows ring between them. So any order of files within the
watermark's delay gives the same outcome. Rows later than the delay are left out by Spark, which counts them in the
query's progress. State ends with what it stands for: a key without a holder, pending mint, open stream
or document keeps none.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.validation import STATE_EDGES

#: Rows that a fold gives: time in microseconds, event (None: a timer's), outcome, and who or what it is about.
Given = tuple[int, int | None, str, str | None]


@dataclass(frozen=True)
class Fold:
    """step(state, at, event, fields) and ring(state, at) change the state (a dictionary, empty at first) and return what they give;
    state["due"], if there, is the time at which ring is called. An empty state is forgotten."""

    fields: tuple[str, ...]
    step: Callable[[dict, int, int, tuple], list[Given]]
    ring: Callable[[dict, int], list[Given]]


def _bucket(fold: Fold, event: str) -> Callable:
    """The keys of one bucket in a micro-batch. Rows come by columns and wait as they came: a chunk is opened when the watermark has passed its first row."""

    def folded(state: dict, rows: list[tuple], now: int, given: list[Given]) -> None:
        for at, row, fields in rows:
            while (due := state.get("due")) is not None and due <= at:
                given += fold.ring(state, due)
            given += fold.step(state, at, row, fields)
        while (due := state.get("due")) is not None and due <= now:
            given += fold.ring(state, due)

    def chunk(names: list, at: np.ndarray, events: np.ndarray, fields: list[list]) -> tuple[int, bytes]:
        return int(at.min()), pickle.dumps((names, at.tobytes(), events.tobytes(), fields), 5)

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() * 1000
        waiting, held, due = state.get if state.exists else (None, None, None)
        chunks = pickle.loads(waiting) if waiting else []
        chunks += [chunk(f["key_"].tolist(), f["us_"].to_numpy("int64"), f[event].to_numpy("int64"), [f[c].tolist() for c in fold.fields]) for f in frames if len(f)]
        keys, given, rest = [], [], [c for c in chunks if c[0] > now]
        if len(rest) < len(chunks) or (due is not None and due <= now):
            names, at, events, fields = [], [], [], [[] for _ in fold.fields]
            for _, packed in (c for c in chunks if c[0] <= now):
                own, us, ids, values = pickle.loads(packed)
                names += own
                at.append(np.frombuffer(us, "int64"))
                events.append(np.frombuffer(ids, "int64"))
                for whole, part in zip(fields, values, strict=True):
                    whole += part
            states = json.loads(held) if held else {}
            ready: dict[str, list] = {k: [] for k, s in states.items() if s.get("due") is not None and s["due"] <= now}
            if names:
                us, ids = np.concatenate(at), np.concatenate(events)
                order = np.lexsort((ids, us))
                passed = int(np.searchsorted(us, now, "right", sorter=order))
                left, order = order[passed:].tolist(), order[:passed]
                if left:
                    rest.append(chunk([names[i] for i in left], us[left], ids[left], [[f[i] for i in left] for f in fields]))
                us, ids, values = us[order], ids[order], list(zip(*fields, strict=True)) if fields else [()] * len(names)
                for i, t, e in zip(order.tolist(), us.tolist(), ids.tolist(), strict=True):
                    ready.setdefault(names[i], []).append((t, e, values[i]))
                if ((us[1:] == us[:-1]) & (ids[1:] == ids[:-1])).any():  # the order of arrival must not decide
                    for rows in ready.values():
                        rows.sort(key=lambda r: (*r[:2], json.dumps(r[2])))
            for k, rows in ready.items():
                own = states.get(k, {})
                folded(own, rows, now, given)
                keys += [k] * (len(given) - len(keys))
                if own:
                    states[k] = own
                else:
                    states.pop(k, None)
            held = json.dumps(states) if states else None
            due = min((s["due"] for s in states.values() if s.get("due") is not None), default=None)
        if rest or held:
            state.update((pickle.dumps(rest, 5) if rest else None, held, due))
            later = [first for first, _ in rest] + ([] if due is None else [due])
            if later:
                state.setTimeoutTimestamp(max((min(later) - 1) // 1000, now // 1000 + 1))
        elif state.exists:
            state.remove()
        if given:
            at, events, outcome, about = zip(*given, strict=True)
            # whole numbers with a null of their own: Spark puts a batch's frames and its states side by side and fills up with nulls
            yield pd.DataFrame({"key_": pd.Series(keys, dtype=object), "us_": pd.array(at, dtype="Int64"), "event": pd.array(events, dtype="Int64"), "outcome": pd.Series(outcome, dtype=object), "about": pd.Series(about, dtype=object)})

    return work


def in_event_time(stream: DataFrame, key: list[str], ts: str, event: str, delay: str, fold: Fold, buckets: int = 64) -> DataFrame:
    """(key.., at, event, outcome, about): the fold over each key's rows in the order (ts, event). Rows with a null in ts
    or event are left out; nulls in the key are a key, in the fields values. Keys are dealt over so many buckets by their hash; a task holds what
    waits and the states of one bucket, so their number should grow with the keys that are open at a time."""
    whole = stream.select(*key).schema
    form = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    text = F.to_json(F.struct(*key), form)
    rows = stream.select(F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket_"), text.alias("key_"), ts, F.unix_micros(ts).alias("us_"), F.col(event).cast("long").alias(event), *[c for c in fold.fields if c not in (ts, event)])
    rows = rows.where(F.col(ts).isNotNull() & F.col(event).isNotNull()).withWatermark(ts, delay)
    out = rows.groupBy("bucket_").applyInPandasWithState(_bucket(fold, event), "key_ string, us_ long, event long, outcome string, about string", "waiting binary, held string, due long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("key_", F.from_json("key_", whole, form)).select("key_.*", F.timestamp_micros("us_").alias("at"), "event", "outcome", "about")


def leases(ttl_s: float, holder: str = "holder", action: str = "action") -> Fold:
    """Actions `claim` and `release`: claimed, renewed (by the holder), already_owned; released, not_held; and `expired`, about the
    holder, when the lease has become as old as the TTL. A worker that shuts down releases what it holds; a lease whose worker just ends expires."""
    ttl = round(ttl_s * 1e6)

    def step(state: dict, at: int, event: int, fields: tuple) -> list[Given]:
        who, what = fields
        owner = state.get("owner")
        if what == "release":
            if owner is None or owner != who:
                return [(at, event, "not_held", who)]
            state.clear()
            return [(at, event, "released", who)]
        if owner is not None and owner != who:
            return [(at, event, "already_owned", who)]
        state.update(owner=who, due=at + ttl)
        return [(at, event, "renewed" if owner == who else "claimed", who)]

    def ring(state: dict, at: int) -> list[Given]:
        who = state["owner"]
        state.clear()
        return [(at, None, "expired", who)]

    return Fold((holder, action), step, ring)


def upload_claims(mint_ttl_s: float, user: str = "user", action: str = "action", paths: str = "paths", force: str = "force") -> Fold:
    """Claims of bundles and the minting of their sessions, which ends later than the claim. A `request` is foreign (another
    user's bundle), replay (its set of paths has stored sessions, and no new ones are forced), claimed, or remint; the last two await
    their mint, and a newer request replaces an older one's. `minted` is stored if one is awaited, else stale. A mint that has not come
    within the TTL is `lapsed`: the bundle stays its owner's, and the next request mints again."""
    ttl = round(mint_ttl_s * 1e6)

    def step(state: dict, at: int, event: int, fields: tuple) -> list[Given]:
        who, what, asked, forced = fields
        if what == "minted":
            if "pending" not in state:
                return [(at, event, "stale", who)]
            state["stored"] = state.pop("pending")
            state.pop("due")
            return [(at, event, "stored", state["owner"])]
        if "owner" in state and state["owner"] != who:
            return [(at, event, "foreign", who)]
        if "stored" in state and state["stored"] == asked and not forced:
            return [(at, event, "replay", who)]
        outcome = "remint" if "owner" in state else "claimed"
        state.update(owner=who, pending=asked, due=at + ttl)
        return [(at, event, outcome, who)]

    def ring(state: dict, at: int) -> list[Given]:
        del state["pending"], state["due"]
        return [(at, None, "lapsed", state["owner"])]

    return Fold((user, action, paths, force), step, ring)


def pings(silence_s: float, deadline_s: float, kind: str = "kind", done: str = "done") -> Fold:
    """A stream of blocks, with a `ping` whenever it has been silent for so long. A `done` block ends it; one that reaches its
    deadline without is `closed`. The next block opens a new one; a done block without an open stream is given alone."""
    silence, deadline = round(silence_s * 1e6), round(deadline_s * 1e6)

    def step(state: dict, at: int, event: int, fields: tuple) -> list[Given]:
        if fields[0] == done:
            state.clear()
        else:
            until = state.get("until", at + deadline)
            state.update(until=until, due=min(at + silence, until))
        return [(at, event, "done" if fields[0] == done else "block", fields[0])]

    def ring(state: dict, at: int) -> list[Given]:
        if at >= state["until"]:
            state.clear()
            return [(at, None, "closed", None)]
        state["due"] = min(at + silence, state["until"])
        return [(at, None, "ping", None)]

    return Fold((kind,), step, ring)


def documents(keep_s: float, to: str = "target", patch: str = "patch", start: str = "queued") -> Fold:
    """Status documents: `updated` (about the patched field's value as it then is; a null patch leaves it), or refused where the status
    has no such edge. A failure sets the document's end so much later, a return to the start takes it back, others leave it; at
    its end the document is `removed`."""
    keep = round(keep_s * 1e6)

    def step(state: dict, at: int, event: int, fields: tuple) -> list[Given]:
        want, value = fields
        if want not in STATE_EDGES[state.get("status", start)]:
            return [(at, event, "refused", state.get("patch"))]
        state["status"] = want
        if value is not None:
            state["patch"] = value
        if want == start:
            state.pop("due", None)
        elif want.startswith("failed"):
            state["due"] = at + keep
        return [(at, event, "updated", state.get("patch"))]

    def ring(state: dict, at: int) -> list[Given]:
        last = state.get("patch")
        state.clear()
        return [(at, None, "removed", last)]

    return Fold((to, patch), step, ring)


@dataclass(frozen=True)
class Tracking:
    """What decides in `tracks`; see there."""

    unsure: float = 0.3
    starting: float = 0.5
    same_iou: float = 0.1
    same_contained: float = 0.5
    other_contained: float = 0.6
    merge_iou: float = 0.3
    merge_contained: float = 0.6
    other_merge_iou: float = 0.6
    confirmed_hits: int = 3
    tentative_misses: int = 3
    confirmed_misses: int = 8
    least_hit_ratio: float = 0.25
    most: int = 60


def _volume(b: list[float]) -> float:
    return max(b[3] - b[0], 0.0) * max(b[4] - b[1], 0.0) * max(b[5] - b[2], 0.0)


def _overlap(a: list[float], b: list[float]) -> tuple[float, float]:
    """Intersection over union of two boxes, and over the smaller one; 0 where neither has a volume."""
    if a[3] <= b[0] or b[3] <= a[0] or a[4] <= b[1] or b[4] <= a[1] or a[5] <= b[2] or b[5] <= a[2]:  # most pairs
        return 0.0, 0.0
    both = _volume([max(x, y) for x, y in zip(a[:3], b[:3], strict=True)] + [min(x, y) for x, y in zip(a[3:], b[3:], strict=True)])
    va, vb = _volume(a), _volume(b)
    return (both / (va + vb - both), both / min(va, vb)) if both > 0 else (0.0, 0.0)


def _match(sightings: list[dict], held: list[dict], p: Tracking) -> dict[int, int]:
    """Sighting -> track, the best pairs first, each side once; ties go to the earlier sighting, then the older track."""
    pairs = []
    for i, s in enumerate(sightings):
        for j, t in enumerate(held):
            iou, part = _overlap(s["box"], t["box"])
            if s["label"] == t["label"]:
                if iou >= p.same_iou or part >= p.same_contained:
                    pairs.append((-1 - max(iou, 0.8 * part), i, j))
            elif part >= p.other_contained:
                pairs.append((-part, i, j))
    found: dict[int, int] = {}
    taken: set[int] = set()
    for _, i, j in sorted(pairs):
        if i not in found and j not in taken:
            found[i] = j
            taken.add(j)
    return found


def _absorb(t: dict, box: list[float], hits: int) -> None:
    """The mean of all boxes that the track has taken in."""
    n = t["hits"] + hits
    t["box"] = [(x * t["hits"] + y * hits) / n for x, y in zip(t["box"], box, strict=True)]
    t["hits"] = n


def _merge(held: list[dict], p: Tracking) -> list[tuple[int, int]]:
    """Merges what has come to be one object into the track of more hits (the older of two equal ones): (gone, kept)."""
    out, i = [], 0
    while i < len(held):
        j = i + 1
        while j < len(held):
            a, b = held[i], held[j]
            iou, part = _overlap(a["box"], b["box"])
            one = iou >= p.merge_iou or part >= p.merge_contained if a["label"] == b["label"] else iou >= p.other_merge_iou and b["id"] not in a["apart"]
            if not one:
                j += 1
                continue
            kept, gone = (a, b) if a["hits"] >= b["hits"] else (b, a)
            _absorb(kept, gone["box"], gone["hits"])
            kept.update(score=max(a["score"], b["score"]), seen=max(a["seen"], b["seen"]), misses=min(a["misses"], b["misses"]), apart=sorted({*a["apart"], *b["apart"]} - {a["id"], b["id"]}))
            out.append((gone["id"], kept["id"]))
            held[i] = kept
            del held[j]
            for t in held:
                if gone["id"] in t["apart"]:
                    t["apart"] = sorted({*t["apart"], kept["id"]} - {gone["id"], t["id"]})
        i += 1
    return out


def tracks(silence_s: float, box: tuple[str, ...] = ("x0", "y0", "z0", "x1", "y1", "z1"), label: str = "label", score: str = "score", cut: str = "cut", view: tuple[str, ...] = ("vx0", "vx1"), rules: Tracking | None = None) -> Fold:
    """Sightings of a capture, taken frame by frame (a frame: all rows of one time), become tracks of objects. box: least and greatest
    corner; cut: the box touches the edge of the image; view: a range of x in which the frame sees.

    A frame's sightings and the tracks are matched one to one, by overlap and label. A sighting is `joined` to its track; else it is
    `unsure` (a score below `unsure`, or below `starting` where its centre lies in a track), `cut_off`, or `started` a track of its own. A
    track whose centre the frame sees and that has no sighting there is missed. Tracks that were missed too often are `pruned`, beyond
    `most` the least sure and stalest `dropped`, and those that have come to be one object `merged` (about: the one that is gone, then
    the one that is kept). about: the track, numbered from 1 in its capture. After so much silence the capture ends, and each track
    is `ended`. So state holds `most` tracks and one frame. A null label, score or corner, a corner that is not finite or a box turned inside
    out is a sighting of nothing: the frame counts, the row gives `empty`. A frame none of whose rows has a view sees everything; a null cut is none."""
    silence, p = round(silence_s * 1e6), rules or Tracking()

    def step(state: dict, at: int, event: int, fields: tuple) -> list[Given]:
        corners, (kind, sure, edge), seen = fields[: len(box)], fields[len(box) : len(box) + 3], fields[len(box) + 3 :]
        state.setdefault("frame", []).append({"event": event, "box": list(corners), "label": kind, "score": sure, "cut": bool(edge), "view": list(seen)})
        state.update(at=at, due=at + 1)
        return []

    def frame(state: dict) -> list[Given]:
        at, rows = state["at"], state.pop("frame")
        held, given, together = state.setdefault("tracks", []), [], []
        sightings = []
        for r in rows:
            b = r["box"]
            whole = r["label"] is not None and all(v is not None and math.isfinite(v) for v in [r["score"], *b]) and all(x <= y for x, y in zip(b[:3], b[3:], strict=True))
            sightings.append(r) if whole else given.append((at, r["event"], "empty", None))
        found, old = _match(sightings, held, p), len(held)
        for i, s in enumerate(sightings):
            if i in found:
                t = held[found[i]]
                _absorb(t, s["box"], 1)
                t.update(score=max(t["score"], s["score"]), seen=at)
                together.append(t["id"])
                given.append((at, s["event"], "joined", str(t["id"])))
                continue
            centre = [(x + y) / 2 for x, y in zip(s["box"][:3], s["box"][3:], strict=True)]
            inside = any(all(lo <= c <= hi for lo, c, hi in zip(t["box"][:3], centre, t["box"][3:], strict=True)) for t in held)
            if s["score"] < p.unsure or (not s["cut"] and s["score"] < p.starting and inside):
                given.append((at, s["event"], "unsure", None))
            elif s["cut"]:
                given.append((at, s["event"], "cut_off", None))
            else:
                state["last"] = state.get("last", 0) + 1
                held.append({"id": state["last"], "box": s["box"], "label": s["label"], "score": s["score"], "hits": 1, "misses": 0, "seen": at, "apart": []})
                together.append(state["last"])
                given.append((at, s["event"], "started", str(state["last"])))
        for t in held:
            if t["id"] in together:
                t["apart"] = sorted({*t["apart"], *together} - {t["id"]})
        views = [r["view"] for r in rows if len(r["view"]) == 2 and all(v is not None and v == v for v in r["view"])]
        for t in held[:old]:
            middle = (t["box"][0] + t["box"][3]) / 2
            if t["id"] not in together and (not views or any(lo <= middle <= hi for lo, hi in views)):
                t["misses"] += 1

        def lost(t: dict) -> bool:
            if t["hits"] < p.confirmed_hits:
                return t["misses"] >= p.tentative_misses
            return t["misses"] >= p.confirmed_misses and t["hits"] < p.least_hit_ratio * (t["hits"] + t["misses"])

        gone = {t["id"]: "pruned" for t in held if lost(t)}
        rest = sorted((t for t in held if t["id"] not in gone), key=lambda t: (2 * (t["hits"] >= p.confirmed_hits) + (t["score"] >= p.starting), t["seen"], t["id"]))
        gone |= {t["id"]: "dropped" for t in rest[: max(len(rest) - p.most, 0)]}
        given += [(at, None, what, str(k)) for k, what in sorted(gone.items())]
        held[:] = [t for t in held if t["id"] not in gone]
        for t in held:
            t["apart"] = [k for k in t["apart"] if k not in gone]
        given += [(at, None, "merged", f"{a} {b}") for a, b in _merge(held, p)]
        state["due"] = at + silence
        return given

    def ring(state: dict, at: int) -> list[Given]:
        if "frame" in state:
            return frame(state)
        out = [(at, None, "ended", str(t["id"])) for t in state["tracks"]]
        state.clear()
        return out

    return Fold((*box, label, score, cut, *view), step, ring)


#: The nouns of what can be announced: fixed values.
NOUNS = {
    "storage": "a cabinet", "refrigerator": "a refrigerator", "stove": "a stove", "bed": "a bed", "sink": "a sink", "toilet": "a toilet", "bathtub": "a bathtub",
    "oven": "an oven", "dishwasher": "a dishwasher", "table": "a table", "sofa": "a sofa", "chair": "a chair", "fireplace": "a fireplace",
}


def announcements(forget_s: float, kind: str = "kind", confidence: str = "confidence") -> Fold:
    """The first sight of a piece is `announced` (the key: capture and piece), about the line to say: its noun if the confidence is not
    low (null: low) and the kind is known, else that it is something new. Later sights are `seen`; after so long without one it is `forgotten`."""
    forget = round(forget_s * 1e6)

    def step(state: dict, at: int, event: int, fields: tuple) -> list[Given]:
        what, sure = fields
        new = not state
        state["due"] = at + forget
        if not new:
            return [(at, event, "seen", None)]
        noun = NOUNS.get(what) if sure not in (None, "low") else None
        return [(at, event, "announced", f"{noun[0].upper()}{noun[1:]}" if noun else "Something new")]

    def ring(state: dict, at: int) -> list[Given]:
        state.clear()
        return [(at, None, "forgotten", None)]

    return Fold((kind, confidence), step, ring)


def run_in_batches(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], path: str, files: int = 2, tasks: int | None = None) -> DataFrame:
    """Streams the parquet files under `source`, so many a micro-batch and in the order in which they were written, through `work`
    into a table at `path`, and reads it. The RocksDB state store, which keeps what waits out of the executors' heaps, is set for this query. Each task of a micro-batch
    opens and saves a state store of its own, however few keys it has: tasks bounds their number (none: as the session deals)."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if tasks is not None:
        own["spark.sql.shuffle.partitions"] = str(min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        stream = work(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source))
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}/_checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(stream.schema).parquet(path)

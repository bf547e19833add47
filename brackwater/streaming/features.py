"""Behavioural features of entities over hopping windows on a stream: state with timers and eviction.

The state of an entity is the events of its open windows and the number of the next window. Once the watermark has passed a
window's end, the window is complete: its features are put out, and events that no later window holds are dropped. An
entity that falls silent is woken by a timer at the end of its next window, and forgotten when it has no events left.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brackwater.operators.features import BIN_S, FEATURES, LENGTH_S, STEP_S

FIELDS = {"us": "long", "seq": "long", "event_type": "string", "action": "string", "status": "string", "lat": "double", "lon": "double", "dest_port": "long", "bytes_sent": "long", "bytes_received": "long", "query": "string", "privilege_change": "string"}
_AT = {name: i for i, name in enumerate(FIELDS)}
OUTPUT = "entity string, win long, win_start long, event_count long, " + ", ".join(f"{f} double" for f in FEATURES)
_STATE = "events array<struct<" + ", ".join(f"{n}: {t}" for n, t in FIELDS.items()) + ">>, next long"


def _kilometres(a: tuple, b: tuple) -> float:
    p, q = (math.radians(x[_AT["lat"]]) for x in (a, b))
    dl = math.radians(b[_AT["lon"]] - a[_AT["lon"]])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
    return 6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _bits(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def window_values(events: Sequence[tuple], open_hour: int = 9, close_hour: int = 17) -> list[float]:
    """The ten features of one window's events (tuples of FIELDS), as `operators.features` defines them."""
    events = sorted(events, key=lambda e: (e[0], e[1]))
    of = lambda e, name: e[_AT[name]]
    kind = lambda name: [e for e in events if of(e, "event_type") == name]
    logins = [of(e, "status") for e in kind("auth") if of(e, "action") == "login"]
    placed = [e for e in kind("auth") if of(e, "lat") is not None and of(e, "lon") is not None]
    speeds = [_kilometres(a, b) / ((b[0] - a[0]) / 3.6e9) for a, b in zip(placed, placed[1:], strict=False) if b[0] > a[0]]
    network = kind("network")
    names = [_bits(of(e, "query")) for e in kind("dns") if of(e, "query") is not None]
    sent, received = (sum(of(e, f"bytes_{c}") or 0 for e in network) for c in ("sent", "received"))
    hours = [e[0] // 3_600_000_000 % 24 for e in events]
    bins = list(Counter((e[0] - events[0][0]) // (BIN_S * 1_000_000) for e in events).values())
    mean = sum(bins) / len(bins)
    long_enough = events[-1][0] - events[0][0] >= BIN_S * 1_000_000
    return [
        logins.count("failure") / len(logins) if logins else 0.0,
        float(logins.count("success")),
        max(speeds, default=0.0),
        0.0,
        len({of(e, "dest_port") for e in network} - {None}) / 3600.0,
        sum(names) / len(names) if names else 0.0,
        sent / received if received else float(sent),
        float(sum(of(e, "privilege_change") == "user_to_admin" for e in kind("endpoint"))),
        sum(h < open_hour or h >= close_hour for h in hours) / len(hours),
        sum((n - mean) ** 2 for n in bins) / len(bins) if long_enough else 0.0,
    ]


def feature_stream(events: DataFrame, anchor_us: int, delay: str = "15 minutes", length_s: int = LENGTH_S, step_s: int = STEP_S) -> DataFrame:
    """entity, win, win_start, event_count and the ten features of every window whose end the watermark has passed. Windows are
    numbered from `anchor_us` (the batch form starts at the first event); events before it, without an entity or later than
    `delay`, are left out. events: entity, event_time and FIELDS."""
    length, step = length_s * 1_000_000, step_s * 1_000_000

    def first_window(us: int) -> int:
        return max(0, (us - anchor_us - length) // step + 1)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, following = [], 0
        if state.exists:
            kept, following = state.get
            held = [tuple(e) for e in kept]
        if not state.hasTimedOut:
            for pdf in batches:
                cells = pdf[list(FIELDS)].astype(object)
                held += [tuple(r) for r in cells.where(cells.notna(), None).itertuples(index=False)]
        done = state.getCurrentWatermarkMs() * 1000
        rows = []
        while held:
            following = max(following, first_window(min(e[0] for e in held)))
            begin = anchor_us + following * step
            if begin + length > done:
                break
            inside = [e for e in held if begin <= e[0] < begin + length]
            if inside:
                rows.append((key[0], following, begin, len(inside), *window_values(inside)))
            following += 1
            held = [e for e in held if e[0] >= begin + step]  # evicted: in no later window
        if held:
            whole = lambda v, t: None if v is None else int(v) if t == "long" else float(v) if t == "double" else v
            state.update(([tuple(whole(v, t) for v, t in zip(e, FIELDS.values(), strict=True)) for e in held], following))
            state.setTimeoutTimestamp((anchor_us + following * step + length) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["entity", "win", "win_start", "event_count", *FEATURES])

    good = events.filter(F.col("entity").isNotNull() & (F.col("us") >= anchor_us)).withWatermark("event_time", delay)
    return good.groupBy("entity").applyInPandasWithState(run, OUTPUT, _STATE, "append", "EventTimeTimeout")

"""Behavioural features of entities over hopping windows.

Windows start at the first event and step on; an event goes to the windows whose numbers arithmetic gives it (at most
length / step of them), so no event meets a window it is not in. All features then come from one shuffle on
(entity, window): the analytic functions and both aggregations below use the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.functions.network import generalize_ip, is_ipv4
from brackwater.functions.scalars import entropy_bits, floor_div, haversine_km, laplace_noise, pseudonymize, round_timestamp

LENGTH_S, STEP_S, BIN_S = 3600, 900, 300
FEATURES = ("failed_login_ratio", "login_frequency", "geo_velocity", "session_duration_anomaly", "port_scan_index", "dns_query_entropy", "data_exfil_ratio", "privilege_escalation_score", "off_hours_ratio", "connection_burstiness")


def entity_of(user: Column, ip: Column) -> Column:
    """The user if there is one, else the source address; null if neither."""
    blank = lambda c: F.when(c != "", c)
    return F.coalesce(blank(user), blank(ip))


def in_windows(events: DataFrame, length_s: int = LENGTH_S, step_s: int = STEP_S) -> DataFrame:
    """One row per event and window: `win` is the window's number, `win_start` its start in microseconds (`us`: the event's).

    The two ends of the data are one row and joined by broadcast; windows that end after the last event do not exist.
    """
    length, step = length_s * 1_000_000, step_s * 1_000_000
    ends = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    t = F.col("us") - F.col("lo")
    first = F.greatest(F.lit(0).cast("long"), floor_div(t - length, step) + 1)
    last = F.least(floor_div(t, step), floor_div(F.col("hi") - F.col("lo") - length, step))
    rows = events.join(F.broadcast(ends)).withColumn("win", F.explode(F.when(first <= last, F.sequence(first, last))))
    return rows.withColumn("win_start", F.col("lo") + F.col("win") * step).drop("lo", "hi")


def window_features(events: DataFrame, which: Sequence[str] = FEATURES, open_hour: int = 9, close_hour: int = 17) -> DataFrame:
    """entity, win, win_start, event_count and the features asked for. events: entity, us, seq, event_type and the
    detail columns; rows without an entity are dropped. Empty tables give none; ties in time are ordered by seq.

    One shuffle, on (entity, window): the window functions, the sums by five-minute bin and the sums over bins all keep its
    partitioning. A busy entity is spread over its windows. Without geo_velocity and connection_burstiness there are no
    window functions, and rows are added up before the shuffle.
    """
    e = events.filter("entity IS NOT NULL")
    if "dns_query_entropy" in which:  # once an event, not once a window
        e = e.withColumn("bits", F.when((F.col("event_type") == "dns") & F.col("query").isNotNull(), entropy_bits(F.col("query"))))
    e = in_windows(e)
    keys = ("entity", "win", "win_start")
    kind = F.col("event_type")
    login = (kind == "auth") & (F.col("action") == "login")
    placed = (kind == "auth") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    hour = F.hour(F.timestamp_micros("us"))
    one = lambda c: F.count(F.when(c, F.lit(1)))
    extra: dict[str, Column] = {}
    if "geo_velocity" in which:
        before = Window.partitionBy(*keys).orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, -1)
        last = F.last(F.when(placed, F.struct("us", "lat", "lon")), ignorenulls=True).over(before)
        gap = (F.col("us") - last["us"]) / 3.6e9
        extra["speed"] = F.when(placed & (gap > 0), haversine_km(last["lat"], last["lon"], F.col("lat"), F.col("lon")) / gap)
    if "connection_burstiness" in which:
        extra["bin"] = floor_div(F.col("us") - F.min("us").over(Window.partitionBy(*keys)), BIN_S * 1_000_000)
    e = e.withColumns(extra)
    # name -> what is gathered from rows, and how the parts of a window (its bins) are put together
    total = lambda n: F.sum(n).alias(n)
    parts: dict[str, tuple[Column, Column]] = {"event_count": (F.count("*"), total("event_count"))}
    needs = {
        "failed_login_ratio": {"failed": (one(login & (F.col("status") == "failure")), total("failed")), "logins": (one(login), total("logins"))},
        "login_frequency": {"logged_in": (one(login & (F.col("status") == "success")), total("logged_in"))},
        "geo_velocity": {"fastest": (F.max("speed") if "speed" in extra else F.lit(None), F.max("fastest").alias("fastest"))},
        "port_scan_index": {"ports": (F.collect_set(F.when(kind == "network", F.col("dest_port"))), F.size(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("ports"))},
        "dns_query_entropy": {"bits": (F.sum("bits") if "dns_query_entropy" in which else F.lit(None), total("bits")), "names": (F.count("bits") if "dns_query_entropy" in which else F.lit(0), total("names"))},
        "data_exfil_ratio": {c: (F.coalesce(F.sum(F.when(kind == "network", F.col(f"bytes_{c}"))), F.lit(0)), total(c)) for c in ("sent", "received")},
        "privilege_escalation_score": {"raised": (one((kind == "endpoint") & (F.col("privilege_change") == "user_to_admin")), total("raised"))},
        "off_hours_ratio": {"off_hours": (one((hour < open_hour) | (hour >= close_hour)), total("off_hours"))},
        "connection_burstiness": {"first": (F.min("us"), F.min("first").alias("first")), "last": (F.max("us"), F.max("last").alias("last")), "spread": (F.count("*"), F.var_pop("spread").alias("spread"))},
    }
    for f in which:
        parts |= needs.get(f, {})
    by_bin = e.groupBy(*keys, *(["bin"] if "bin" in extra else [])).agg(*[c.alias(n) for n, (c, _) in parts.items()])
    g = by_bin.groupBy(*keys).agg(*[c for _, c in parts.values()])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    made = {
        "failed_login_ratio": lambda: ratio("failed", "logins"),
        "login_frequency": lambda: F.col("logged_in").cast("double"),
        "geo_velocity": lambda: F.coalesce("fastest", F.lit(0.0)),
        "session_duration_anomaly": lambda: F.lit(0.0),
        "port_scan_index": lambda: F.col("ports") / 3600.0,
        "dns_query_entropy": lambda: ratio("bits", "names"),
        "data_exfil_ratio": lambda: F.when(F.col("received") == 0, F.col("sent").cast("double")).otherwise(F.col("sent") / F.col("received")),
        "privilege_escalation_score": lambda: F.col("raised").cast("double"),
        "off_hours_ratio": lambda: ratio("off_hours", "event_count"),
        "connection_burstiness": lambda: F.when(F.col("last") - F.col("first") < BIN_S * 1_000_000, 0.0).otherwise(F.col("spread")),
    }
    return g.select(*keys, "event_count", *[made[f]().alias(f) for f in FEATURES if f in which])


def private_features(features: DataFrame, salt: str, epsilon: float = 0.5, minutes: int = 60, seed: int | None = 7, clip: bool = False) -> DataFrame:
    """The released table: hashed entity, rounded window start, noisy login ratio, generalised address (IPv4 entities only)."""
    noisy = laplace_noise(F.col("failed_login_ratio"), 0.01, epsilon, seed, (0.0, 1.0) if clip else None)
    start = round_timestamp(F.timestamp_micros("win_start"), minutes)
    return features.select(
        pseudonymize(F.col("entity"), salt).alias("entity_id"),
        F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"),
        "event_count",
        noisy.alias("failed_login_ratio"),
        *[f for f in FEATURES if f != "failed_login_ratio"],
        F.when(is_ipv4(F.col("entity")), generalize_ip(F.col("entity"))).alias("generalized_ip"),
    )

"""Synthetic inputs on spark.range: raw logs, security events, reference features and flows. All are seeded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pick(u: Column, options: list[tuple[str, float]]) -> Column:
    out, edge = None, 0.0
    for name, share in options[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(options[-1][0]) if out is not None else F.lit(options[-1][0])


def _u(seed: int, k: int) -> Column:
    """A number in [0, 1) fixed by the row's id: the same however the rows are split."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)


def raw_logs(spark: SparkSession, n: int, seed: int = 42, malformed: float = 0.005, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """line_number and line: the three formats in turn, a share of malformed lines, rarely 2 TB or -100 bytes."""
    df = spark.range(n)
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.col("id"))
    iso, stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    octet = lambda k: F.floor(_u(seed, k) * 254 + 1).cast("string")
    size = F.when(_u(seed, 9) < 0.001, F.lit(2 << 40)).when(_u(seed, 9) < 0.002, F.lit(-100)).otherwise(F.floor(_u(seed, 8) * 100_000)).cast("string")
    fire = F.concat_ws(",", iso, F.concat(F.lit("192.168.1."), octet(1)), F.concat(F.lit("10.0.0."), octet(2)), _pick(_u(seed, 3), [("443", 0.5), ("80", 0.3), ("22", 0.2)]), _pick(_u(seed, 4), [("ALLOW", 0.8), ("DENY", 0.2)]), size)
    auth = F.concat_ws(" ", stamp, _pick(_u(seed, 1), [("alice", 0.4), ("bob", 0.3), ("carol", 0.3)]), _pick(_u(seed, 2), [("corporate-vpn", 0.5), ("web", 0.5)]), _pick(_u(seed, 3), [("SUCCESS", 0.85), ("FAILURE", 0.15)]), F.concat(F.lit("203.0.113."), octet(4)))
    dns = F.concat(F.lit("query_time="), iso, F.lit("|client=192.168.2."), octet(1), F.lit("|domain=host"), octet(2), F.lit(".example.com|type=A|response="), _pick(_u(seed, 3), [("93.184.216.34", 0.9), ("NXDOMAIN", 0.1)]))
    line = F.when(F.col("id") % 3 == 0, fire).when(F.col("id") % 3 == 1, auth).otherwise(dns)
    return df.select((F.col("id") + 1).alias("line_number"), F.when(_u(seed, 7) < malformed, F.lit("CORRUPT|||,,")).otherwise(line).alias("line"))


def security_events(spark: SparkSession, n: int, seed: int = 42, users: int = 20, start: str = "2026-01-01 00:00:00") -> DataFrame:
    """seq, entity, us and details in the shape of operators.features, with planted attacks: brute force, impossible
    travel, a port scan, exfiltration, generated domain names and privilege escalation (the last seven percent of rows)."""
    df = spark.range(n)
    base = F.unix_micros(F.lit(start).cast("timestamp"))
    planted = F.col("id") >= int(n * 0.93)
    attack = F.when(planted, (F.col("id") % 6).cast("int"))
    kind = F.when(attack.isin(0, 1), "auth").when(attack.isin(2, 3), "network").when(attack == 4, "dns").when(attack == 5, "endpoint").otherwise(_pick(_u(seed, 1), [("auth", 0.3), ("network", 0.3), ("dns", 0.25), ("endpoint", 0.15)]))
    us = base + F.when(planted, F.lit(40_000_000_000).cast("long") + F.col("id") * 2_000_000).otherwise(F.floor(_u(seed, 2) * 86_400e6))
    is_ = lambda k: F.col("event_type") == k
    user = F.when(planted, F.concat(F.lit("attacker"), attack.cast("string"))).otherwise(F.concat(F.lit("user"), F.floor(_u(seed, 3) * users).cast("string")))
    df = df.select(F.col("id").alias("seq"), "id", user.alias("entity"), us.alias("us"), kind.alias("event_type"), attack.alias("attack"))
    far = (F.col("attack") == 1) & (F.floor(F.col("id") / 6) % 2 == 1)
    return df.select(
        "seq",
        "entity",
        "us",
        "event_type",
        F.when(is_("auth"), "login").alias("action"),
        F.when(is_("auth"), F.when(F.col("attack") == 0, "failure").otherwise(_pick(_u(seed, 4), [("success", 0.9), ("failure", 0.1)]))).alias("status"),
        F.when(is_("auth"), F.when(far, 51.5).otherwise(40.7)).alias("lat"),
        F.when(is_("auth"), F.when(far, -0.1).otherwise(-74.0)).alias("lon"),
        F.when(is_("network"), F.when(F.col("attack") == 2, F.col("id") % 1000).otherwise(443)).alias("dest_port"),
        F.when(is_("network"), F.when(F.col("attack") == 3, 500_000_000).otherwise(F.floor(_u(seed, 5) * 10_000))).cast("long").alias("bytes_sent"),
        F.when(is_("network"), F.floor(_u(seed, 6) * 10_000 + 1)).alias("bytes_received"),
        F.when(is_("dns"), F.when(F.col("attack") == 4, F.concat(F.substring(F.sha1(F.col("id").cast("string").cast("binary")), 1, 24), F.lit(".net"))).otherwise("www.example.com")).alias("query"),
        F.when(F.col("attack") == 5, "user_to_admin").alias("privilege_change"),
    )


def reference_features(spark: SparkSession, n: int = 300, seed: int = 42) -> DataFrame:
    """Clipped normal features to compare current ones with."""
    clip = lambda k, m, s, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.randn(seed + k) * s + m))
    return spark.range(n).select(
        F.concat(F.lit("ref"), F.col("id").cast("string")).alias("entity_id"),
        clip(1, 0.1, 0.05, 0.0, 1.0).alias("failed_login_ratio"),
        clip(2, 3.0, 1.0, 0.0, 100.0).alias("login_frequency"),
        clip(3, 50.0, 30.0, 0.0, 200000.0).alias("geo_velocity"),
        clip(4, 0.002, 0.001, 0.0, 1.0).alias("port_scan_index"),
        clip(5, 3.0, 0.4, 0.0, 8.0).alias("dns_query_entropy"),
        clip(6, 1.0, 0.5, 0.0, 1e6).alias("data_exfil_ratio"),
        clip(7, 0.3, 0.2, 0.0, 1.0).alias("off_hours_ratio"),
        clip(8, 1.0, 0.5, 0.0, 1000.0).alias("connection_burstiness"),
    )


def flows(spark: SparkSession, n: int, seed: int = 42, anomalous: float = 0.1) -> DataFrame:
    """Network flows: durations are exponential, packets near-Poisson (rounded normals), a share with label 1 far larger."""
    df = spark.range(n).withColumn("label", (F.rand(seed) < anomalous).cast("int"))
    odd = F.col("label") == 1
    poisson = lambda k, a, b: F.greatest(F.lit(0), F.round(F.when(odd, F.randn(seed + k) * b**0.5 + b + 50).otherwise(F.randn(seed + k) * a**0.5 + a))).cast("long")
    dur = F.when(odd, -5.0 * F.log(1 - F.rand(seed + 1)) + 1).otherwise(-0.5 * F.log(1 - F.rand(seed + 2)))
    df = df.withColumns({"dur": dur, "spkts": poisson(3, 10, 150), "dpkts": poisson(4, 12, 200)})
    df = df.withColumns({"sbytes": F.col("spkts") * 80, "dbytes": F.col("dpkts") * 120})
    return df.withColumn("rate", (F.col("spkts") + F.col("dpkts")) / F.greatest(F.lit(1e-3), F.col("dur")))

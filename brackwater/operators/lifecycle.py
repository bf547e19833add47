"""The indicator store: upsert, expiry, pruning, key figures and blocklist exports. Every step takes its time as an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.functions.network import is_ipv4
from brackwater.operators.ranks import row_numbers
from brackwater.operators.scoring import Client, confidence, enrich_indicators, offline_client

# Days an indicator lives, by type.
TTL_DAYS = {"ipv4": 30, "domain": 60, "url": 30, "hash": 180}
HISTORY = "array<struct<timestamp: timestamp, action: string, risk_score: int, confidence: int, note: string>>"


def ttl_days(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TTL_DAYS.items() for x in kv])
    return F.coalesce(table[kind], F.lit(30))


def _entry(now: Column, action: str, risk: Column, conf: Column, note: str) -> Column:
    return F.struct(now.alias("timestamp"), F.lit(action).alias("action"), risk.cast("int").alias("risk_score"), conf.cast("int").alias("confidence"), F.lit(note).alias("note"))


def upsert(store: DataFrame, enriched: DataFrame, now: Column, keep_revoked: bool = False) -> DataFrame:
    """The store after adding enriched indicators (indicator, type, risk_score, risk_tier, tags, sources, enrichment).

    New ones are created active; known ones get a new last_seen and expiration, the union of tags and sources, the new
    enrichment, and become active again (revoked ones too, unless `keep_revoked`). One full outer join on the indicator;
    if an indicator comes several times in `enriched`, the row with the largest risk score stands for it.
    """
    best = F.max_by(F.struct("type", "risk_score", "risk_tier", "tags", "sources", "enrichment"), F.struct("risk_score", F.hash("tags")))
    new = enriched.groupBy("indicator").agg(best.alias("n")).withColumnRenamed("indicator", "new_indicator")
    j = store.join(new, store.indicator == new.new_indicator, "full_outer")
    n, touched, known = F.col("n"), F.col("n").isNotNull(), F.col("indicator").isNotNull()
    none = F.array().cast("array<string>")
    union = lambda c: F.array_sort(F.array_union(F.coalesce(F.col(c), none), F.coalesce(n[c], none)))
    sources = F.when(touched, union("sources")).otherwise(F.col("sources"))
    e = n["enrichment"]
    conf = confidence(union("sources"), e["virustotal"], e["abuseipdb"], e["alienvault_otx"], now, F.lit(True), now)["total_confidence"].cast("int")
    kind = F.when(known, F.col("type")).otherwise(n["type"])
    status = F.when(~touched | (F.lit(keep_revoked) & (F.col("status") == "revoked")), F.col("status")).otherwise("active")
    pick = lambda c: F.when(touched, n[c]).otherwise(F.col(c))
    history = F.when(touched, F.when(known, F.array_append(F.coalesce("history", F.array().cast(HISTORY)), _entry(now, "updated", n["risk_score"], conf, "enriched again"))).otherwise(F.array(_entry(now, "created", n["risk_score"], conf, "first seen")))).otherwise(F.col("history"))
    return j.select(
        F.coalesce("indicator", "new_indicator").alias("indicator"),
        kind.alias("type"),
        F.when(known, F.col("first_seen")).otherwise(now).alias("first_seen"),
        F.when(touched, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(touched, F.timestamp_add("DAY", ttl_days(kind), now)).otherwise(F.col("expiration")).alias("expiration"),
        F.when(touched, conf).otherwise(F.col("confidence")).alias("confidence"),
        pick("risk_score").cast("int").alias("risk_score"),
        pick("risk_tier").alias("risk_tier"),
        status.alias("status"),
        sources.alias("sources"),
        F.when(touched, union("tags")).otherwise(F.col("tags")).alias("tags"),
        F.when(touched, e).otherwise(F.col("enrichment_data")).alias("enrichment_data"),
        history.cast(HISTORY).alias("history"),
    )


def refresh_active(store: DataFrame, now: Column, client: Client = offline_client, lanes: int = 1) -> DataFrame:
    """The store after asking the feeds again about its active indicators."""
    return upsert(store, enrich_indicators(store.filter("status = 'active'").select("indicator"), client, lanes=lanes), now)


def ingest(store: DataFrame, listed: DataFrame, now: Column, client: Client = offline_client, lanes: int = 1) -> DataFrame:
    """The store after enriching and adding a list of indicators (see sources.indicators)."""
    return upsert(store, enrich_indicators(listed.select("indicator"), client, lanes=lanes), now)


def prunable(now: Column, days: int) -> Column:
    """Rows already expired whose last sight is more than `days` whole days ago."""
    whole = F.floor((F.unix_micros(now) - F.unix_micros("last_seen")) / 86_400_000_000)
    return F.coalesce((F.col("status") == "expired") & (whole > days), F.lit(False))


def expire(store: DataFrame, now: Column, prune_days: int | None = None) -> DataFrame:
    """Active rows past their expiration become expired, with an entry in their history; rows that were expired before
    this run are pruned by `prune_days`. A row without an expiration stays as it is."""
    df = store.filter(~prunable(now, prune_days)) if prune_days is not None else store
    due = F.coalesce((F.col("status") == "active") & (now > F.col("expiration")), F.lit(False))
    cols = {"status": F.when(due, "expired").otherwise(F.col("status"))}
    if "history" in df.columns:
        cols["history"] = F.when(due, F.array_append(F.coalesce("history", F.array().cast(HISTORY)), _entry(now, "expired", F.col("risk_score"), F.col("confidence"), "time to live passed"))).otherwise(F.col("history"))
    return df.withColumns(cols)


def key_figures(store: DataFrame) -> DataFrame:
    """One row of counts by status, tier and type, and of active ones with a confidence of 70 or more."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    status, tier, kind = F.col("status"), F.col("risk_tier"), F.col("type")
    tiers, kinds = ("CRITICAL", "HIGH", "SUSPICIOUS"), ("ipv4", "domain", "url", "hash")
    return store.agg(
        F.count("*").alias("total"),
        *[n(status == s).alias(s) for s in ("active", "expired", "revoked")],
        *[n(tier == t).alias(t.lower()) for t in tiers],
        n(~F.coalesce(tier, F.lit("")).isin(*tiers)).alias("clean"),
        *[n(kind == k).alias(f"type_{k}") for k in kinds],
        n(~F.coalesce(kind, F.lit("")).isin(*kinds)).alias("type_other"),
        n((status == "active") & (F.col("confidence") >= 70)).alias("high_confidence"),
    )


def candidates(store: DataFrame, min_risk: int = 50, min_confidence: int = 50) -> DataFrame:
    """Active indicators at or above both bounds."""
    return store.filter((F.col("status") == "active") & (F.col("risk_score") >= min_risk) & (F.col("confidence") >= min_confidence))


def _order() -> list[Column]:
    return [F.desc("risk_score"), F.asc("seq"), F.asc("indicator")]


def blocklist_ip(found: DataFrame) -> DataFrame:
    """seq, risk_score, line of each IPv4 candidate; write them ordered by (risk_score desc, seq)."""
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 3), ",")
    line = F.format_string("%s/32  # Risk: %d, Conf: %d, Tags: [%s]", "indicator", "risk_score", "confidence", tags)
    return found.filter("type = 'ipv4'").select("seq", "indicator", "risk_score", line.alias("line"))


def numbered(found: DataFrame, start: int = 1_000_001) -> DataFrame:
    """Candidates with `sid`: start plus the rank over all of them, (risk_score desc, seq, indicator), from range partitions: no risk
    score is one task."""
    return row_numbers(found, *_order(), name="sid").withColumn("sid", F.col("sid") + F.lit(start - 1))


def suricata_rules(found: DataFrame, start: int = 1_000_001) -> DataFrame:
    """sid and rule line of IPv4 and domain candidates; ids count over all candidates, so other types leave gaps."""
    ip = F.format_string('drop ip %s any -> any any (msg:"Malicious IP [%s]"; reference:url,virustotal.com; classtype:trojan-activity; sid:%d; rev:1;)', "indicator", "indicator", "sid")
    name = F.format_string('drop dns any any -> any any (msg:"Malicious DNS query [%s]"; dns.query; content:"%s"; nocase; sid:%d; rev:1;)', "indicator", "indicator", "sid")
    return numbered(found, start).filter("type IN ('ipv4', 'domain')").select("sid", "indicator", F.when(F.col("type") == "ipv4", ip).otherwise(name).alias("line"))


def blocklist_table(found: DataFrame) -> DataFrame:
    return found.select("seq", "indicator", "type", "risk_score", "confidence", "status", "expiration", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ";").alias("tags"))


# The environments a configuration may name.
ENVIRONMENTS = ("prod", "staging", "dev")


def is_cidr(c: Column) -> Column:
    """Whether c is an IPv4 network: an address, a slash and 0 to 32."""
    return F.coalesce(is_ipv4(F.substring_index(c, "/", 1)) & c.rlike("^[^/]*/([0-9]|[12][0-9]|3[0-2])$"), F.lit(False))


def config_rules(settings: DataFrame) -> DataFrame:
    """Adds a verdict for each of region, environment, vpc_cidr, public_cidr, private_cidr, ssh_cidr (anything but the whole
    Internet) and bucket; null fails."""
    fits = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return settings.withColumns({
        "region_ok": fits("region", "^[a-z]{2}-[a-z]+-[0-9]$"),
        "environment_ok": F.coalesce(F.col("environment").isin(*ENVIRONMENTS), F.lit(False)),
        **{f"{c}_ok": is_cidr(F.col(c)) for c in ("vpc_cidr", "public_cidr", "private_cidr")},
        "ssh_cidr_ok": F.coalesce(F.col("ssh_cidr") != "0.0.0.0/0", F.lit(False)),
        "bucket_ok": fits("bucket", "^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$"),
    })


def compliance(controls: DataFrame) -> DataFrame:
    """host, passed, score: ten points for each control with rc 0 whose output holds or equals what is asked (null: nothing)."""
    fine = (F.col("rc") == 0) & F.coalesce(F.col("stdout").contains(F.col("must_contain")), F.col("must_contain").isNull()) & F.coalesce(F.col("stdout") == F.col("must_equal"), F.col("must_equal").isNull())
    return controls.groupBy("host").agg(F.count_if(F.coalesce(fine, F.lit(False))).alias("passed")).withColumn("score", F.col("passed") * 10)

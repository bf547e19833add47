"""Threat indicators: feed payload parsing, risk and confidence scores, enrichment with a cache."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.functions.network import indicator_type
from brackwater.functions.scalars import half_even
from brackwater.sources import cache_log

VIRUSTOTAL = "struct<status: string, malicious: long, suspicious: long, harmless: long, undetected: long, total_engines: long, reputation: long, tags: array<string>, owner: string>"
ABUSEIPDB = "struct<status: string, score: long, total_reports: long, is_whitelisted: boolean, country: string, isp: string, usage_type: string, domain: string, last_reported_at: string>"
OTX = "struct<status: string, pulse_count: long, pulses_analyzed: long, tags: array<string>, adversaries: array<string>, malware_families: array<string>>"
ENRICHMENT = f"struct<virustotal: {VIRUSTOTAL}, abuseipdb: {ABUSEIPDB}, alienvault_otx: {OTX}>"
# Weights by indicator type (engines, abuse reports, pulses), tag words and tier bounds.
WEIGHTS = {"ipv4": (0.35, 0.45, 0.20), "domain": (0.70, 0.0, 0.30), "hash": (0.75, 0.0, 0.25), "url": (0.70, 0.0, 0.30)}
CRITICAL_WORDS = ("malware", "ransomware", "c2", "botnet", "exploit", "trojan", "phishing")
TIERS = (("CRITICAL", 75), ("HIGH", 50), ("SUSPICIOUS", 20))


def tier_of(score: Column, tiers: tuple[tuple[str, int], ...] = TIERS) -> Column:
    out = None
    for name, least in tiers:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("CLEAN")


def critical_tags(tags: Column) -> Column:
    return F.coalesce(F.size(F.filter(tags, lambda t: F.lower(t).rlike("|".join(CRITICAL_WORDS)))), F.lit(0))


def risk_subscores(kind: Column, vt: Column, abuse: Column, otx: Column, weights: Mapping[str, tuple[float, float, float]] = WEIGHTS) -> tuple[Column, Column, Column, Column]:
    """The three parts (0 to 100) and the weighted, clamped whole, unrounded. Feeds that did not succeed count 0."""
    ok = lambda c: F.coalesce(c["status"] == "success", F.lit(False))
    n = lambda c, f: F.coalesce(c[f], F.lit(0)).cast("double")
    bad = n(vt, "malicious")
    s_vt = F.when(ok(vt), F.least(F.lit(100.0), bad * 14 + n(vt, "suspicious") * 4)).otherwise(0.0)
    white = ok(abuse) & F.coalesce(abuse["is_whitelisted"], F.lit(False))
    s_ab = F.when(ok(abuse) & ~(white & (bad == 0)), n(abuse, "score")).otherwise(0.0)
    s_otx = F.when(ok(otx), F.least(F.lit(100.0), n(otx, "pulse_count") * 12 + critical_tags(otx["tags"]) * 6)).otherwise(0.0)
    known = F.when(kind.isin(*weights), kind).otherwise("url")
    table = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.array(*[F.lit(float(v)) for v in w]))])
    w = table[known]
    whole = w[0] * s_vt + w[1] * s_ab + w[2] * s_otx
    whole = F.when(white & (bad == 0) & (n(otx, "pulse_count") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), whole)))
    return s_vt, s_ab, s_otx, whole


def risk_score(kind: Column, vt: Column, abuse: Column, otx: Column, weights: Mapping[str, tuple[float, float, float]] = WEIGHTS) -> Column:
    """Whole score, halves to even."""
    return half_even(F.round(risk_subscores(kind, vt, abuse, otx, weights)[3], 9)).cast("int")


def confidence(sources: Column, vt: Column, abuse: Column, otx: Column, last_seen: Column, has_last_seen: Column, now: dt.datetime | Column) -> Column:
    """struct of diversity_points, stability_points, recency_points, total_confidence.

    last_seen: timestamp, null if missing or unparseable; has_last_seen tells the two apart (25 and 15 points).
    """
    ok = lambda c: F.coalesce(c["status"] == "success", F.lit(False))
    n = lambda c, f: F.when(ok(c), F.coalesce(c[f], F.lit(0))).otherwise(0)
    count = F.coalesce(F.size(sources), F.lit(0))
    diversity = F.when(count >= 3, 35).when(count == 2, 25).when(count == 1, 10).otherwise(0)
    bad, score, pulses = n(vt, "malicious"), n(abuse, "score"), n(otx, "pulse_count")
    white = ok(abuse) & F.coalesce(abuse["is_whitelisted"], F.lit(False))
    engines = F.when((bad >= 3) & (score >= 40), 25).when((bad > 0) | (score > 30), 12).otherwise(0)
    stability = F.when(white & (bad == 0) & (pulses == 0), 35).otherwise(F.least(F.lit(40), engines + F.when(pulses >= 3, 15).when(pulses > 0, 8).otherwise(0)))
    clock = now if isinstance(now, Column) else F.lit(now)
    days = (F.unix_micros(clock) - F.unix_micros(last_seen)) / 86_400e6
    recency = F.when(~has_last_seen, 25).when(last_seen.isNull(), 15).when(days <= 7, 25).when(days <= 30, F.greatest(F.lit(0), half_even(25 - (days - 7)).cast("int"))).otherwise(0)
    total = F.greatest(F.lit(0), F.least(F.lit(100), diversity + stability + recency))
    return F.struct(diversity.alias("diversity_points"), stability.alias("stability_points"), recency.alias("recency_points"), total.alias("total_confidence"))


def parse_feeds(raw: DataFrame) -> DataFrame:
    """indicator, type and `enrichment` from three JSON payload columns (virustotal, abuseipdb, alienvault_otx)."""
    parsed = [F.from_json(c, kind).alias(c) for c, kind in (("virustotal", VIRUSTOTAL), ("abuseipdb", ABUSEIPDB), ("alienvault_otx", OTX))]
    return raw.select("indicator", "type", F.struct(*parsed).alias("enrichment"))


_ANSWERS = {
    "virustotal": "struct<data: struct<attributes: struct<last_analysis_stats: map<string, long>, reputation: long, tags: array<string>, as_owner: string, network: string>>>",
    "abuseipdb": "struct<data: struct<abuseConfidenceScore: long, totalReports: long, isWhitelisted: boolean, countryCode: string, isp: string, usageType: string, domain: string, lastReportedAt: string>>",
    "alienvault_otx": "struct<pulse_info: struct<count: long, pulses: array<struct<tags: array<string>, adversary: string, malware_families: array<string>>>>>",
}
# How much of an answer is kept.
VT_TAGS, OTX_PULSES, OTX_TAGS, OTX_NAMES = 5, 15, 10, 5


def _virustotal(a: Column) -> dict[str, Column]:
    attributes = a["data"]["attributes"]
    stats = attributes["last_analysis_stats"]
    n = lambda name: F.coalesce(F.try_element_at(stats, F.lit(name)), F.lit(0).cast("long"))
    engines = F.coalesce(F.aggregate(F.map_values(stats), F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0))), F.lit(0).cast("long"))
    return {
        **{c: n(c) for c in ("malicious", "suspicious", "harmless", "undetected")},
        "total_engines": engines,
        "reputation": F.coalesce(attributes["reputation"], F.lit(0).cast("long")),
        "tags": F.slice(F.coalesce(attributes["tags"], F.array().cast("array<string>")), 1, VT_TAGS),
        "owner": F.coalesce(attributes["as_owner"], attributes["network"], F.lit("N/A")),
    }


def _abuseipdb(a: Column) -> dict[str, Column]:
    d = a["data"]
    named = {"country": "countryCode", "isp": "isp", "usage_type": "usageType", "domain": "domain"}
    return {
        "score": F.coalesce(d["abuseConfidenceScore"], F.lit(0).cast("long")),
        "total_reports": F.coalesce(d["totalReports"], F.lit(0).cast("long")),
        "is_whitelisted": F.coalesce(d["isWhitelisted"], F.lit(False)),
        **{k: F.coalesce(d[v], F.lit("N/A")) for k, v in named.items()},
        "last_reported_at": d["lastReportedAt"],
    }


def _alienvault_otx(a: Column) -> dict[str, Column]:
    info = a["pulse_info"]
    none = F.array().cast("array<string>")
    pulses = F.coalesce(info["pulses"], F.array().cast("array<struct<tags: array<string>, adversary: string, malware_families: array<string>>>"))
    first = F.slice(pulses, 1, OTX_PULSES)
    few = lambda values, most: F.slice(F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull()))), 1, most)
    lists = lambda field: F.flatten(F.transform(first, lambda p: F.coalesce(p[field], none)))
    return {
        "pulse_count": F.coalesce(info["count"], F.lit(0).cast("long")),
        "pulses_analyzed": F.size(pulses).cast("long"),
        "tags": few(F.transform(lists("tags"), lambda t: F.lower(t)), OTX_TAGS),
        "adversaries": few(F.transform(first, lambda p: F.nullif(p["adversary"], F.lit(""))), OTX_NAMES),
        "malware_families": few(lists("malware_families"), OTX_NAMES),
    }


FEEDS = {"virustotal": (_virustotal, VIRUSTOTAL), "abuseipdb": (_abuseipdb, ABUSEIPDB), "alienvault_otx": (_alienvault_otx, OTX)}


def _from_answer(feed: str) -> Column:
    """The struct of one feed from its JSON column and its HTTP code."""
    fields, kind = FEEDS[feed]
    answer = F.from_json(feed, _ANSWERS[feed])
    code = F.col(f"{feed}_code")
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json(feed)).rlike("^OBJECT"), F.lit(False))
    good = (code == 200) & object_
    status = F.when(good, "success").when(F.lit(feed != "abuseipdb") & (code == 404), "not_found").otherwise("error")
    if feed == "abuseipdb":
        status = F.when(F.col("type") != "ipv4", "n_a").otherwise(status)
    found = F.struct(status.alias("status"), *[c.alias(n) for n, c in fields(answer).items()]).cast(kind)
    empty = F.from_json(F.lit("{}"), _ANSWERS[feed])
    nothing = F.struct(status.alias("status"), *[c.alias(n) for n, c in fields(empty).items()]).cast(kind)
    alone = F.from_json(F.concat(F.lit('{"status": "'), status, F.lit('"}')), kind)
    return F.when(status == "success", found).when(status == "not_found", nothing).otherwise(alone)


def from_answers(raw: DataFrame) -> DataFrame:
    """indicator, type and `enrichment` from what the feeds answer: for each feed a JSON column and its HTTP code (`<feed>_code`).

    200 with a JSON object is a success; 404 is `not_found` with counts of 0 (for the abuse feed an error, as are all other
    codes and texts that are no JSON object). The abuse feed knows IPv4 addresses alone: for other types it is `n_a`.
    """
    return raw.select("indicator", "type", F.struct(*[_from_answer(feed).alias(feed) for feed in FEEDS]).alias("enrichment"))


def parse_answers(raw: DataFrame) -> DataFrame:
    """The same for the rows of `query_feeds`: answers that came with a code are read as the feed's own, others as payloads."""
    parsed = [F.when(F.col(f"{feed}_code").isNull(), F.from_json(feed, kind)).otherwise(_from_answer(feed)).alias(feed) for feed, (_, kind) in FEEDS.items()]
    return raw.select("indicator", "type", F.struct(*parsed).alias("enrichment"))


def updated_cache(cache: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """The cache with fresh entries: of each indicator the row fetched now if there is one, else the one it had."""
    new = fetched.withColumn("cached_at", now)
    both = cache.select(*new.columns).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy("indicator").agg(F.max_by(F.struct(*new.columns), F.struct("_new", "cached_at")).alias("best"))
    return best.select("best.*")


#: What a feed answers: its HTTP code and text; or a payload in the form of `parse_feeds`.
Answer = tuple[int, str | None] | str | None
#: Asks all feeds about an indicator of a type.
Client = Callable[[str, str], Mapping[str, Answer]]


def offline_client(indicator: str, kind: str) -> Mapping[str, Answer]:
    """Answers for no indicator; the default, so that nothing here reaches a network unasked."""
    return dict.fromkeys(FEEDS, (0, None))


class TooManyRequests(Exception):
    """A feed asks to wait `seconds`."""

    def __init__(self, seconds: float):
        super().__init__(f"retry after {seconds} s")
        self.seconds = seconds


def with_retries(client: Client, attempts: int = 3, pause_s: float = 2.0) -> Client:
    """The client called again after TooManyRequests or a code 429 (when it says, or after `pause_s`), and after timeouts (pauses grow
    by `pause_s`); any other error, and the last one, becomes an error payload. Of several feeds only those that answered
    429 are taken from the next call."""

    def call(indicator: str, kind: str) -> Mapping[str, Answer]:
        import time

        got: dict[str, Answer] = {}
        busy = lambda a: isinstance(a, tuple) and a[0] == 429
        for n in range(1, attempts + 1):
            wait = pause_s
            try:
                got = dict(client(indicator, kind)) | {f: a for f, a in got.items() if not busy(a)}
                if not any(map(busy, got.values())):
                    return got
            except TooManyRequests as e:
                wait = e.seconds
            except TimeoutError:
                wait = pause_s * n
            except Exception:
                break
            if n < attempts:
                time.sleep(wait)
        return {f: got.get(f, '{"status": "error"}') for f in FEEDS}

    return call


def query_feeds(indicators: DataFrame, client: Client = offline_client, min_interval_s: float = 0.0, lanes: int = 1) -> DataFrame:
    """Text and HTTP code of the three feeds' answers by indicator, a call for each distinct one.

    `lanes` partitions call at once and share one rate: together they make a call in `min_interval_s` seconds at most, as each
    waits `lanes` times as long between its own and begins at its own part of the interval.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        from pyspark import TaskContext

        due = time.monotonic() + TaskContext.get().partitionId() % lanes * min_interval_s
        for batch in batches:
            rows = []
            for ind, kind in zip(batch["indicator"], batch["type"], strict=True):
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + min_interval_s * lanes
                answers = client(ind, kind)
                parts = [a if isinstance(a, tuple) else (None, a) for a in (answers.get(f) for f in FEEDS)]
                rows.append((ind, kind, *[x for code, text in parts for x in (text, code)]))
            out = pd.DataFrame(rows, columns=["indicator", "type", *[x for f in FEEDS for x in (f, f"{f}_code")]])
            yield out.astype({f"{f}_code": "Int32" for f in FEEDS})

    typed = indicators.select("indicator").filter("indicator IS NOT NULL").distinct().withColumn("type", indicator_type(F.col("indicator"))).repartition(lanes, "indicator")
    return typed.mapInPandas(run, "indicator string, type string, " + ", ".join(f"{f} string, {f}_code int" for f in FEEDS))


def fresh(cached_at: Column, now: Column, ttl_hours: float = 24.0) -> Column:
    """Whether a cache entry still counts; one without a good stamp does not."""
    return F.coalesce((F.unix_micros(now) - F.unix_micros(cached_at)) <= int(ttl_hours * 3_600_000_000), F.lit(False))


def with_cache(indicators: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = 24.0) -> tuple[DataFrame, DataFrame]:
    """Hits (indicator, the cache's columns, from_cache) and misses (indicators to ask for). cache: indicator, cached_at, ..."""
    good = cache.filter(fresh(F.col("cached_at"), now, ttl_hours))
    return indicators.select("indicator").join(good, "indicator").withColumn("from_cache", F.lit(True)), indicators.join(good.select("indicator"), "indicator", "left_anti")


def enrich(payloads: DataFrame, weights: Mapping[str, tuple[float, float, float]] = WEIGHTS) -> DataFrame:
    """Adds risk_score, risk_tier, tags (lower case, sorted, at most ten) and sources (feeds that succeeded)."""
    e = F.col("enrichment")
    vt, abuse, otx = e["virustotal"], e["abuseipdb"], e["alienvault_otx"]
    none = F.array().cast("array<string>")
    tags = F.array_union(F.coalesce(vt["tags"], none), F.coalesce(otx["tags"], none))
    named = F.array(*[F.when(F.coalesce(e[f]["status"] == "success", F.lit(False)), F.lit(f)) for f in ("abuseipdb", "alienvault_otx", "virustotal")])
    out = payloads.withColumn("risk_score", risk_score(F.col("type"), vt, abuse, otx, weights))
    return out.withColumns({
        "risk_tier": tier_of(F.col("risk_score")),
        "tags": F.slice(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.lower(t)))), 1, 10),
        "sources": F.filter(named, lambda x: x.isNotNull()),
    })


def enrich_indicators(indicators: DataFrame, client: Client = offline_client, min_interval_s: float = 0.0, lanes: int = 1) -> DataFrame:
    """From a column of indicators to scored rows: ask, parse, score."""
    return enrich(parse_answers(query_feeds(indicators, client, min_interval_s, lanes)))


def enrich_cached(indicators: DataFrame, root: str, now: Column, client: Client = offline_client, ttl_hours: float = 24.0, min_interval_s: float = 0.0, lanes: int = 1) -> DataFrame:
    """Scored rows with `from_cache`: fresh ones from the cache log at `root`, the others asked for once and appended to it."""
    spark = indicators.sparkSession
    cache = cache_log.read(spark, root, f"indicator string, type string, enrichment {ENRICHMENT}, cached_at timestamp")
    asked = indicators.filter("indicator IS NOT NULL").select("indicator").distinct()
    hits, misses = with_cache(asked, cache, now, ttl_hours)
    new = cache_log.append(parse_answers(query_feeds(misses, client, min_interval_s, lanes)).withColumn("cached_at", now), root)
    rows = hits.select("indicator", "type", "enrichment", "from_cache").unionByName(new.select("indicator", "type", "enrichment", F.lit(False).alias("from_cache")))
    return enrich(rows)


def flat(enriched: DataFrame) -> DataFrame:
    """The table form: N/A where a feed did not succeed, tags joined by semicolons."""
    e = F.col("enrichment")
    cell = lambda feed, field: F.when(F.coalesce(e[feed]["status"] == "success", F.lit(False)), e[feed][field].cast("string")).otherwise("N/A")
    return enriched.select("indicator", "type", "risk_score", "risk_tier", cell("virustotal", "malicious").alias("vt_malicious"), cell("abuseipdb", "score").alias("abuse_score"), cell("alienvault_otx", "pulse_count").alias("otx_pulses"), F.array_join(F.slice("tags", 1, 5), ";").alias("tags"))

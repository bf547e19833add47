"""Queries over indicators, scores, the indicator store and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brackwater.functions import network
from brackwater.operators import lifecycle, scoring
from brackwater.plans import adapters as ad
from brackwater.plans.registry import query
from brackwater.session import shared_dir, table
from brackwater.sources import cache_log

_TYPE = f"""CASE WHEN regexp_matches(s, '{ad.V4}') THEN 'ipv4' WHEN regexp_matches(s, '^([a-fA-F0-9]{{32}}|[a-fA-F0-9]{{40}}|[a-fA-F0-9]{{64}})$') THEN 'hash'
  WHEN regexp_matches(s, '(?i)^https?://') OR (strpos(s, '/') > 0 AND strpos(s, '.') > 0 AND strpos(s, '.') < strpos(s, '/')) THEN 'url'
  WHEN regexp_matches(s, '{network.FQDN}') THEN 'domain' ELSE 'unknown' END"""
query("ioc_detect_type", f"WITH {ad.INDICATORS} SELECT seq, {_TYPE} AS type FROM (SELECT seq, trim(indicator) AS s FROM indicators)")(
    lambda spark, d: ad.indicators(spark, d).select("seq", network.indicator_type(F.col("indicator")).alias("type")))
query("ioc_dedupe", f"WITH {ad.INDICATORS} SELECT indicator, min(seq) AS first_seq FROM indicators GROUP BY 1")(
    lambda spark, d: ad.indicators(spark, d).groupBy("indicator").agg(F.min("seq").alias("first_seq")))

_CACHED = "cache AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS indicator, max(ts) AS cached_at FROM events GROUP BY 1), asked AS (SELECT 'u' || CAST(c_custkey % 400 AS VARCHAR) AS indicator FROM customer GROUP BY 1)"
_WHEN = "2024-01-31 12:00:00"


@query("cache_ttl", f"WITH {_CACHED} SELECT a.indicator, c.indicator IS NOT NULL AS from_cache FROM asked a LEFT JOIN cache c ON a.indicator = c.indicator AND c.cached_at >= TIMESTAMP '{_WHEN}' - INTERVAL 24 HOUR")
def cache_ttl(spark, d):
    e = table(spark, d, "events")
    cache = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("indicator")).agg(F.max("ts").cast("timestamp").alias("cached_at"))
    asked = table(spark, d, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 400).cast("string")).alias("indicator")).distinct()
    hits, misses = scoring.with_cache(asked, cache, F.lit(_WHEN).cast("timestamp"))
    return hits.select("indicator", "from_cache").unionByName(misses.withColumn("from_cache", F.lit(False)))


_W = "CASE type WHEN 'ipv4' THEN {0} WHEN 'hash' THEN {1} ELSE {2} END"
_RISK = f"""{ad.FEEDS},
parts AS (SELECT *, CAST(CASE WHEN vt_ok THEN least(100.0, m * 14.0 + s * 4.0) ELSE 0.0 END AS DOUBLE) AS s_vt, CASE WHEN ab_ok AND NOT (white AND m = 0) THEN CAST(score AS DOUBLE) ELSE 0.0 END AS s_ab,
  CAST(CASE WHEN otx_ok THEN least(100.0, pulses * 12.0 + crit * 6.0) ELSE 0.0 END AS DOUBLE) AS s_otx FROM feeds),
whole AS (SELECT *, CASE WHEN ab_ok AND white AND m = 0 AND pulses = 0 THEN 0.0 ELSE {_W.format(0.35, 0.75, 0.7)}::DOUBLE * s_vt + {_W.format(0.45, '0.0', '0.0')}::DOUBLE * s_ab + {_W.format(0.2, 0.25, 0.3)}::DOUBLE * s_otx END AS w FROM parts),
risked AS (SELECT *, CAST(round_even(round(least(100.0, greatest(0.0, w)), 9), 0) AS INTEGER) AS risk_score FROM whole)"""


@query("risk_score", f"WITH {_RISK} SELECT indicator, type, round(s_vt, 1) AS s_vt, round(s_ab, 1) AS s_ab, round(s_otx, 1) AS s_otx, risk_score, CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS tier FROM risked")
def risk_score(spark, d):
    f = ad.feeds(spark, d)
    args = (F.col("type"), F.col("vt"), F.col("abuse"), F.col("otx"))
    a, b, c, _ = scoring.risk_subscores(*args)
    out = f.select("indicator", "type", F.round(a, 1).alias("s_vt"), F.round(b, 1).alias("s_ab"), F.round(c, 1).alias("s_otx"), scoring.risk_score(*args).alias("risk_score"))
    return out.withColumn("tier", scoring.tier_of(F.col("risk_score")))


@query("confidence", f"""WITH {ad.FEEDS}, z AS (SELECT indicator, CASE WHEN n_sources >= 3 THEN 35 WHEN n_sources = 2 THEN 25 WHEN n_sources = 1 THEN 10 ELSE 0 END AS dv,
    CASE WHEN vt_ok THEN m ELSE 0 END AS m, CASE WHEN ab_ok THEN score ELSE 0 END AS sc, ab_ok AND white AS wh, CASE WHEN otx_ok THEN pulses ELSE 0 END AS p, age_days FROM feeds),
y AS (SELECT indicator, dv AS diversity_points, CASE WHEN wh AND m = 0 AND p = 0 THEN 35 ELSE least(40, CASE WHEN m >= 3 AND sc >= 40 THEN 25 WHEN m > 0 OR sc > 30 THEN 12 ELSE 0 END + CASE WHEN p >= 3 THEN 15 WHEN p > 0 THEN 8 ELSE 0 END) END AS stability_points,
    CASE WHEN age_days = 44 THEN 25 WHEN age_days = 43 THEN 15 WHEN age_days + 0.5 <= 7 THEN 25 WHEN age_days + 0.5 <= 30 THEN greatest(0, CAST(round_even(25 - (age_days + 0.5 - 7), 0) AS INTEGER)) ELSE 0 END AS recency_points FROM z)
SELECT indicator, CAST(diversity_points AS INTEGER) AS diversity_points, CAST(stability_points AS INTEGER) AS stability_points, CAST(recency_points AS INTEGER) AS recency_points, CAST(least(100, greatest(0, diversity_points + stability_points + recency_points)) AS INTEGER) AS total_confidence FROM y""")
def confidence(spark, d):
    f = ad.feeds(spark, d)
    now = F.lit(ad.NOW).cast("timestamp")
    age = F.col("age_days")
    seen = F.when(age < 43, F.timestamp_micros(F.unix_micros(now) - age * 86_400_000_000 - 43_200_000_000))
    c = scoring.confidence(F.col("sources"), F.col("vt"), F.col("abuse"), F.col("otx"), seen, age != 44, now)
    return f.select("indicator", c.alias("c")).select("indicator", "c.*")


_AT = "1998-06-01 00:00:00"


@query("ioc_upsert", f"""WITH {ad.IOCS}, fresh AS (SELECT 'i' || CAST(o_orderkey * 3 AS VARCHAR) AS indicator, CASE WHEN o_orderkey % 2 = 0 THEN 'ipv4' ELSE 'hash' END AS type, CAST(o_orderkey % 101 AS INTEGER) AS risk_score FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 = 1)
SELECT coalesce(s.indicator, f.indicator) AS indicator, coalesce(s.type, f.type) AS type, CASE WHEN f.indicator IS NOT NULL THEN 'active' ELSE s.status END AS status, coalesce(f.risk_score, s.risk_score) AS risk_score,
  strftime(coalesce(s.first_seen, TIMESTAMP '{_AT}'), '%Y-%m-%d') AS first_seen, strftime(CASE WHEN f.indicator IS NOT NULL THEN TIMESTAMP '{_AT}' ELSE s.last_seen END, '%Y-%m-%d') AS last_seen,
  strftime(CASE WHEN f.indicator IS NOT NULL THEN TIMESTAMP '{_AT}' + CAST(CASE coalesce(s.type, f.type) WHEN 'domain' THEN 60 WHEN 'hash' THEN 180 ELSE 30 END AS INTEGER) * INTERVAL 1 DAY ELSE s.expiration END, '%Y-%m-%d') AS expiration
FROM iocs s FULL JOIN fresh f ON s.indicator = f.indicator""")
def ioc_upsert(spark, d):
    none = F.array().cast("array<string>")
    kind = scoring.ENRICHMENT
    store = ad.iocs(spark, d).withColumn("sources", none).withColumn("enrichment_data", F.lit(None).cast(kind)).withColumn("history", F.array().cast(lifecycle.HISTORY)).drop("seq")
    k = F.col("o_orderkey")
    fresh = table(spark, d, "orders").filter((k % 2 == 0) | (k % 7 == 1)).select(F.concat(F.lit("i"), (k * 3).cast("string")).alias("indicator"), F.when(k % 2 == 0, "ipv4").otherwise("hash").alias("type"), (k % 101).cast("int").alias("risk_score"), F.lit("CLEAN").alias("risk_tier"), F.array(F.lit("new")).alias("tags"), F.array(F.lit("virustotal")).alias("sources"), F.lit(None).cast(kind).alias("enrichment"))
    out = lifecycle.upsert(store, fresh, F.lit(_AT).cast("timestamp"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("indicator", "type", "status", "risk_score", day("first_seen"), day("last_seen"), day("expiration"))


_NEXT = f"CASE WHEN status = 'active' AND TIMESTAMP '{_AT}' > expiration THEN 'expired' ELSE status END"
_PRUNED = f"NOT (status = 'expired' AND floor((epoch(TIMESTAMP '{_AT}') - epoch(last_seen)) / 86400) > 365)"
_when = lambda: F.lit(_AT).cast("timestamp")
query("ioc_expire", f"WITH {ad.IOCS} SELECT indicator, {_NEXT} AS status FROM iocs")(lambda spark, d: lifecycle.expire(ad.iocs(spark, d), _when()).select("indicator", "status"))
query("ioc_prune", f"WITH {ad.IOCS} SELECT {_NEXT} AS status, count(*) AS n FROM iocs WHERE {_PRUNED} GROUP BY 1")(lambda spark, d: lifecycle.expire(ad.iocs(spark, d), _when(), 365).groupBy("status").agg(F.count("*").alias("n")))

_BEST = "status = 'active' AND risk_score >= 50 AND confidence >= 50"
query("blocklist", f"WITH {ad.IOCS} SELECT seq, indicator, risk_score, indicator || '/32  # Risk: ' || risk_score || ', Conf: ' || confidence || ', Tags: [t1,t' || (seq % 9) || ']' AS line FROM iocs WHERE {_BEST} AND type = 'ipv4'")(
    lambda spark, d: lifecycle.blocklist_ip(lifecycle.candidates(ad.iocs(spark, d))))
query("blocklist_csv", f"WITH {ad.IOCS} SELECT seq, indicator, type, risk_score, confidence, status, strftime(expiration, '%Y-%m-%d') AS expiration, 't1;t' || (seq % 9) AS tags FROM iocs WHERE {_BEST}")(
    lambda spark, d: lifecycle.blocklist_table(lifecycle.candidates(ad.iocs(spark, d))).withColumn("expiration", F.date_format("expiration", "yyyy-MM-dd")))
query("suricata_sid", f"""WITH {ad.IOCS}, r AS (SELECT *, 1000000 + row_number() OVER (ORDER BY risk_score DESC, seq, indicator) AS sid FROM iocs WHERE {_BEST})
SELECT sid, indicator, CASE type WHEN 'ipv4' THEN 'drop ip ' || indicator || ' any -> any any (msg:"Malicious IP [' || indicator || ']"; reference:url,virustotal.com; classtype:trojan-activity; sid:' || sid || '; rev:1;)'
  ELSE 'drop dns any any -> any any (msg:"Malicious DNS query [' || indicator || ']"; dns.query; content:"' || indicator || '"; nocase; sid:' || sid || '; rev:1;)' END AS line FROM r WHERE type IN ('ipv4', 'domain')""")(
    lambda spark, d: lifecycle.suricata_rules(lifecycle.candidates(ad.iocs(spark, d))))
query("kpi", f"""WITH {ad.IOCS} SELECT count(*) AS total, count_if(status = 'active') AS active, count_if(status = 'expired') AS expired, count_if(status = 'revoked') AS revoked,
  count_if(risk_score >= 75) AS critical, count_if(risk_score BETWEEN 50 AND 74) AS high, count_if(risk_score BETWEEN 20 AND 49) AS suspicious, count_if(risk_score < 20) AS clean,
  count_if(type = 'ipv4') AS type_ipv4, count_if(type = 'domain') AS type_domain, count_if(type = 'url') AS type_url, count_if(type = 'hash') AS type_hash, count_if(type = 'other') AS type_other,
  count_if(status = 'active' AND confidence >= 70) AS high_confidence FROM iocs""")(lambda spark, d: lifecycle.key_figures(ad.iocs(spark, d)))
query("top_risk", f"WITH {ad.IOCS} SELECT indicator, risk_score, confidence FROM iocs ORDER BY risk_score DESC, confidence DESC, seq LIMIT 10")(
    lambda spark, d: ad.iocs(spark, d).orderBy(F.desc("risk_score"), F.desc("confidence"), "seq").limit(10).select("indicator", "risk_score", "confidence"))


@query("compliance", """WITH c AS (SELECT c_custkey // 10 AS host, c_custkey % 10 AS control, c_custkey % 3 AS rc, CASE WHEN c_custkey % 4 = 0 THEN 'Status: active' ELSE 'Status: inactive' END AS stdout FROM customer)
SELECT host, CAST(count_if(rc = 0 AND (control <> 5 OR contains(stdout, 'Status: active')) AND (control <> 7 OR stdout = 'Status: active')) AS BIGINT) AS passed,
  CAST(count_if(rc = 0 AND (control <> 5 OR contains(stdout, 'Status: active')) AND (control <> 7 OR stdout = 'Status: active')) * 10 AS BIGINT) AS score FROM c GROUP BY host""")
def compliance(spark, d):
    k = F.col("c_custkey")
    control = k % 10
    c = table(spark, d, "customer").select(F.floor(k / 10).alias("host"), (k % 3).alias("rc"), F.when(k % 4 == 0, "Status: active").otherwise("Status: inactive").alias("stdout"), F.when(control == 5, "Status: active").alias("must_contain"), F.when(control == 7, "Status: active").alias("must_equal"))
    return lifecycle.compliance(c)


_SSH = "CASE WHEN s_suppkey % 5 = 0 THEN '0.0.0.0/0' WHEN s_suppkey % 5 = 1 THEN NULL ELSE '10.' || (s_suppkey % 300) || '.0.0/' || (s_suppkey % 40) END"
_V4_CIDR = f"regexp_matches({_SSH}, '{ad.V4[:-1]}/([0-9]|[12][0-9]|3[0-2])$')"


@query("config_rules", f"""SELECT s_suppkey, regexp_matches('us-east-' || (s_suppkey % 12), '^[a-z]{{2}}-[a-z]+-[0-9]$') AS region_ok, (CASE s_suppkey % 4 WHEN 0 THEN 'dev' WHEN 1 THEN 'prod' WHEN 2 THEN 'staging' ELSE 'qa' END) IN ('dev', 'staging', 'prod') AS environment_ok,
  coalesce({_V4_CIDR}, false) AS vpc_cidr_ok, coalesce({_V4_CIDR}, false) AS public_cidr_ok, s_suppkey % 2 = 0 AS private_cidr_ok, coalesce({_SSH} <> '0.0.0.0/0', false) AS ssh_cidr_ok,
  regexp_matches(lower(replace(s_name, '#', '-')), '^[a-z0-9][a-z0-9.-]{{1,61}}[a-z0-9]$') AS bucket_ok FROM supplier""")
def config_rules(spark, d):
    k, s = F.col("s_suppkey"), lambda c: c.cast("string")
    cidr = F.when(k % 5 == 0, "0.0.0.0/0").when(k % 5 == 1, F.lit(None)).otherwise(F.concat(F.lit("10."), s(k % 300), F.lit(".0.0/"), s(k % 40)))
    settings = table(spark, d, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("us-east-"), s(k % 12)).alias("region"),
        F.when(k % 4 == 0, "dev").when(k % 4 == 1, "prod").when(k % 4 == 2, "staging").otherwise("qa").alias("environment"),
        *[cidr.alias(c) for c in ("vpc_cidr", "public_cidr", "ssh_cidr")],
        F.when(k % 2 == 0, "10.0.2.0/24").otherwise("10.0.2.0").alias("private_cidr"),
        F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("bucket"),
    )
    return lifecycle.config_rules(settings).select("s_suppkey", *[f"{c}_ok" for c in ("region", "environment", "vpc_cidr", "public_cidr", "private_cidr", "ssh_cidr", "bucket")])


@query("tag_merge", """WITH t AS (SELECT o_custkey, list_sort(list_distinct(flatten(list([lower(o_orderpriority), lower(o_orderstatus), 'x' || (o_orderkey % 3)])))) AS a FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(a[1:5], ';') AS tags FROM t""")
def tag_merge(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.explode(F.array(F.lower("o_orderpriority"), F.lower("o_orderstatus"), F.concat(F.lit("x"), (F.col("o_orderkey") % 3).cast("string")))).alias("tag"))
    return o.groupBy("o_custkey").agg(F.array_join(F.slice(F.array_sort(F.collect_set("tag")), 1, 5), ";").alias("tags"))


_N = "(length(indicator) % 9)"


@query("enrich_offline", f"""WITH {ad.INDICATORS}, i AS (SELECT DISTINCT indicator, {_TYPE} AS type FROM (SELECT indicator, trim(indicator) AS s FROM indicators)),
n AS (SELECT *, {_N} AS n FROM i),
w AS (SELECT *, least(100.0, n * 14.0 + 4) AS vt, least(100.0, (n % 4) * 12.0 + 6) AS otx, CASE type WHEN 'ipv4' THEN 0.35 WHEN 'hash' THEN 0.75 ELSE 0.7 END AS a, CASE type WHEN 'ipv4' THEN 0.2 WHEN 'hash' THEN 0.25 ELSE 0.3 END AS b FROM n),
r AS (SELECT *, CAST(round_even(round(CAST(a AS DOUBLE) * vt + CAST(b AS DOUBLE) * otx, 9), 0) AS INTEGER) AS risk_score FROM w)
SELECT indicator, type, risk_score, CASE WHEN risk_score >= 75 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 20 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS risk_tier,
  CAST(n AS VARCHAR) AS vt_malicious, 'N/A' AS abuse_score, CAST(n % 4 AS VARCHAR) AS otx_pulses, 'botnet;c2;x' || n AS tags FROM r""")
def enrich_offline(spark, d):
    """Feed calls through the client interface, the feeds' own answers parsed, scored and flattened (a made-up client; nothing leaves
    the machine)."""

    def client(indicator: str, kind: str) -> dict[str, tuple[int, str]]:
        n = len(indicator) % 9
        vt = f'{{"data": {{"attributes": {{"last_analysis_stats": {{"malicious": {n}, "suspicious": 1}}, "tags": ["C2", "x{n}"]}}}}}}'
        otx = f'{{"pulse_info": {{"count": {n % 4}, "pulses": [{{"tags": ["botnet"]}}]}}}}'
        return {"virustotal": (200, vt), "abuseipdb": (503, "busy"), "alienvault_otx": (200, otx)}

    return scoring.flat(scoring.enrich_indicators(ad.indicators(spark, d), client, lanes=4))


@query("feed_answers", """WITH k AS (SELECT o_orderkey AS k, o_orderkey % 7 AS m FROM orders)
SELECT 'i' || k AS indicator, CASE WHEN m = 0 THEN 'success' WHEN m = 1 THEN 'not_found' ELSE CASE WHEN m = 2 THEN 'error' ELSE 'success' END END AS vt_status,
  CASE WHEN m = 1 THEN 0 WHEN m <> 2 THEN k % 5 END AS malicious, CASE WHEN m = 1 THEN 0 WHEN m <> 2 THEN k % 5 + 60 END AS total_engines, CASE WHEN m = 1 THEN '' WHEN m <> 2 THEN 'a,b,c,d,e' END AS vt_tags, CASE WHEN m = 1 THEN 'N/A' WHEN m <> 2 THEN 'AS' || k % 3 END AS owner,
  CASE WHEN k % 2 = 1 THEN 'n_a' WHEN m = 1 THEN 'error' WHEN m = 2 THEN 'error' ELSE 'success' END AS abuse_status, CASE WHEN k % 2 = 0 AND m NOT IN (1, 2) THEN k % 101 END AS abuse_score, CASE WHEN k % 2 = 0 AND m NOT IN (1, 2) THEN 'N/A' END AS isp,
  CASE WHEN m = 1 THEN 'not_found' WHEN m = 2 THEN 'error' ELSE 'success' END AS otx_status, CASE WHEN m = 1 THEN 0 WHEN m <> 2 THEN 20 END AS pulses_analyzed,
  CASE WHEN m = 1 THEN '' WHEN m <> 2 THEN 'both,t00,t01,t02,t03,t04,t05,t06,t07,t08' END AS otx_tags, CASE WHEN m = 1 THEN '' WHEN m <> 2 THEN 'adv0,adv1,adv2' END AS adversaries, CASE WHEN m = 1 THEN '' WHEN m <> 2 THEN 'f00,f01,f02,f03,f04' END AS families FROM k""")
def feed_answers(spark, d):
    """Raw answers of the three feeds, with more pulses, tags and names than are kept, and error codes."""
    k = F.col("o_orderkey")
    m, s = k % 7, lambda c: c.cast("string")
    stats = F.format_string('{"data": {"attributes": {"last_analysis_stats": {"malicious": %d, "harmless": 60}, "tags": ["a", "b", "c", "d", "e", "f"], "as_owner": "AS%d"}}}', k % 5, k % 3)
    abuse = F.format_string('{"data": {"abuseConfidenceScore": %d, "countryCode": "DE"}}', k % 101)
    pulses = ", ".join(f'{{"tags": ["T{i:02d}", "Both"], "adversary": "{f"adv{i % 3}" if i % 4 else ""}", "malware_families": ["f{i:02d}"]}}' for i in range(20))
    otx = F.lit(f'{{"pulse_info": {{"count": 40, "pulses": [{pulses}]}}}}')
    code = F.when(m == 1, 404).when(m == 2, 500).otherwise(200)
    raw = table(spark, d, "orders").select(F.concat(F.lit("i"), s(k)).alias("indicator"), F.when(k % 2 == 0, "ipv4").otherwise("domain").alias("type"), stats.alias("virustotal"), code.alias("virustotal_code"), abuse.alias("abuseipdb"), code.alias("abuseipdb_code"), otx.alias("alienvault_otx"), code.alias("alienvault_otx_code"))
    e = F.col("enrichment")
    listed = lambda feed, field: F.when(e[feed][field].isNotNull(), F.array_join(e[feed][field], ","))
    return scoring.from_answers(raw).select(
        "indicator", e["virustotal"]["status"].alias("vt_status"), e["virustotal"]["malicious"].alias("malicious"), e["virustotal"]["total_engines"].alias("total_engines"), listed("virustotal", "tags").alias("vt_tags"), e["virustotal"]["owner"].alias("owner"),
        e["abuseipdb"]["status"].alias("abuse_status"), e["abuseipdb"]["score"].alias("abuse_score"), e["abuseipdb"]["isp"].alias("isp"),
        e["alienvault_otx"]["status"].alias("otx_status"), e["alienvault_otx"]["pulses_analyzed"].alias("pulses_analyzed"), listed("alienvault_otx", "tags").alias("otx_tags"), listed("alienvault_otx", "adversaries").alias("adversaries"), listed("alienvault_otx", "malware_families").alias("families"),
    )


@query("cache_update", """WITH cache AS (SELECT user_id AS u, max(ts) AS cached_at, 0 AS payload FROM events WHERE user_id % 2 = 0 GROUP BY 1), fetched AS (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 3 = 0)
SELECT coalesce(c.u, f.u) AS indicator, CASE WHEN f.u IS NOT NULL THEN 1 ELSE 0 END AS payload, strftime(CASE WHEN f.u IS NOT NULL THEN TIMESTAMP '2020-01-01' ELSE c.cached_at END, '%Y-%m-%d %H:%M:%S') AS cached_at FROM cache c FULL JOIN fetched f ON c.u = f.u""")
def cache_update(spark, d):
    u = F.col("user_id")
    e = table(spark, d, "events")
    cache = e.filter(u % 2 == 0).groupBy(u.alias("indicator")).agg(F.max("ts").cast("timestamp").alias("cached_at"), F.lit(0).alias("payload"))
    fetched = e.filter(u % 3 == 0).select(u.alias("indicator"), F.lit(1).alias("payload")).distinct()
    out = scoring.updated_cache(cache, fetched, F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return out.select("indicator", "payload", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at"))


@query("cache_log", """WITH e AS (SELECT 'u' || user_id AS indicator, event_id AS payload, ts AS cached_at, event_id % 3 AS part FROM events)
SELECT indicator, max_by(payload, (cached_at, part, payload)) AS payload, strftime(max(cached_at), '%Y-%m-%d %H:%M:%S') AS cached_at FROM e GROUP BY 1""")
def cache_log_read(spark, d):
    """All events as cache entries, appended to a log in three deltas with a compaction between, and the log read back."""
    root = f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    kind = "indicator string, payload long, cached_at timestamp"
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("indicator"), F.col("event_id").alias("payload"), F.col("ts").cast("timestamp").alias("cached_at"))
    for part in range(3):
        one = e.filter(F.col("payload") % 3 == part).groupBy("indicator").agg(F.max_by("payload", F.struct("cached_at", "payload")).alias("payload"), F.max("cached_at").alias("cached_at"))
        cache_log.append(one, root)
        if part == 1:
            cache_log.compact(spark, root, kind)
    return cache_log.read(spark, root, kind).select("indicator", "payload", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at"))

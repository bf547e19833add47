"""Parsing, rules, windows, stores, models, sinks and streams on small frames."""

import base64
import datetime as dt
import ipaddress
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brackwater.functions import network, scalars
from brackwater.operators import dataset_quality, documents, exploration, features, isolation, learning, lifecycle, metrics, record_quality, scoring
from brackwater.plans import registry
from brackwater.sources import cache_log, generators, indicators, logs, reports, tables, writers
from brackwater.streaming import live

NOW = dt.datetime(2026, 7, 20, tzinfo=dt.timezone.utc)

LINES = [
    "2026-03-02T08:15:00Z,192.168.7.21,10.4.0.9,8443,ALLOW,5120",
    "2026-07-18T14:30:01Z,2001:db8::1,10.0.0.50,443,deny,-5",
    "2026-07-18T14:30:01Z,192.168.1.300,10.0.0.50,443,ALLOW,1",
    "2026-07-18T14:30:01Z,192.168.1.3,10.0.0.50,abc,ALLOW,1",
    "2026-07-18T14:30:01Z,192.168.1.3,10.0.0.50,70000,ALLOW,1",
    "2026-03-02 08:16:00 mira_ops branch-vpn SUCCESS 192.168.7.21 extra",
    "2026-03-02 08:16:00 mira SUCCESS 192.168.7.21",
    "query_time=2026-03-02T08:17:00Z|client=192.168.7.21|domain=host.example|type=A|response=198.51.100.7",
    "query_time=2026-07-18T16:32:00+02:00|client=192.168.1.100|client=1.2.3.4|domain=a=b|type=TXT|zzz=1",
    "query_time=2026-07-18T14:32:00Z|client=x|domain=a|type=A",
    "",
    "   ",
    None,
    "nothing at all",
]


@pytest.fixture(scope="module")
def parsed(spark):
    return logs.parse_lines(spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_number long, line string")).collect()


def test_parse(parsed):
    code = [r.error_code for r in parsed]
    assert code == [None, None, "source_ip", "port", "port", None, "unknown_format", None, None, "source_ip", *["unknown_format"] * 4]
    assert (parsed[0].timestamp, parsed[0].status, parsed[0].bytes) == ("2026-03-02T08:15:00Z", "success", 5120)
    assert (parsed[1].source_ip, parsed[1].action, parsed[1].bytes) == ("2001:db8::1", "DENY", -5)
    assert (parsed[5].user, parsed[5].timestamp) == ("mira_ops", "2026-03-02T08:16:00Z")
    assert parsed[7].dns_query.asDict() == {"domain": "host.example", "type": "A", "response": "198.51.100.7"}
    assert (parsed[8].source_ip, parsed[8].timestamp, parsed[8].action, parsed[8].status, parsed[8].dns_query.domain) == ("1.2.3.4", "2026-07-18T14:32:00Z", "QUERY", "unknown", "a=b")


def test_files_and_events(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(x for x in LINES if x is not None) + "\n")
    (tmp_path / "b.log").write_text(LINES[0] + "\n")
    lines = logs.read_lines(spark, [f"{tmp_path}/a.log", f"{tmp_path}/b.log"])
    rows = logs.parse_lines(lines)
    events, bad = logs.events_of(rows), logs.quarantine_of(rows)
    assert events.count() + bad.count() == lines.count() == 12
    assert events.select("event_id").distinct().count() == events.count()
    writers.write_jsonl(events.drop("line_number"), f"{tmp_path}/out")
    assert logs.read_normalized(spark, f"{tmp_path}/out").count() == 6
    assert '"user":null' in (next((tmp_path / "out").glob("part*")).read_text())


def test_many_files_in_one_scan(spark, tmp_path):
    (tmp_path / "with space").mkdir()
    for name, text in (("with space/a b.log", "one\n\ntwo\n"), ("x.log", "three\n"), ("with space/c%20d.log", "four\n")):
        (tmp_path / name).write_text(text)
    got = logs.read_lines(spark, [f"{tmp_path}/x.log", f"{tmp_path}/with space", f"{tmp_path}/x.log"]).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, "three"), (1, 1, "four"), (1, 1, "one"), (1, 3, "two"), (2, 1, "three")]
    with pytest.raises(Exception, match="none.log"):
        logs.read_lines(spark, [f"{tmp_path}/x.log", f"{tmp_path}/none.log"])


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 10 else "" for i in range(1, 3001)]
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / f"in/{name}.log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = logs.numbered_lines(spark, f"{tmp_path}/in").collect()
        assert spark.read.text(f"{tmp_path}/in").rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in "ab":
        assert sorted((r.line_number, r.line) for r in got if r.file_path.endswith(f"{name}.log")) == list(enumerate(lines, 1))


def test_csv_and_store(spark, tmp_path):
    (tmp_path / "t.csv").write_text('b,a,c\n1.5,x,1\nNA,"y, ""z""",2\nbad,,3\n')
    got = tables.read_table(spark, f"{tmp_path}/t.csv", "a string, b double, d int").collect()
    assert [tuple(r) for r in got] == [("x", 1.5, None), ('y, "z"', None, None), (None, None, None)]
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/t.csv", "a string", required=("z",))
    assert writers.read_store(spark, f"{tmp_path}/none", "indicator string").count() == 0
    with pytest.raises(FileNotFoundError):
        writers.read_store(spark, f"{tmp_path}/none")
    store = spark.createDataFrame([("a", "active"), ("b", "active"), ("c", "revoked")], "indicator string, status string")
    writers.write_store(store, f"{tmp_path}/s", "1")
    about = writers.store_metadata(spark, f"{tmp_path}/s")
    assert (about.version, about.total_records, about.active_records, about.expired_records, about.revoked_records) == ("1", 3, 2, 0, 1)
    (tmp_path / "q.csv").write_text('note,indicator\n"a, b",1.1.1.1\n"say ""c""",evil.com\n')
    assert [r.indicator for r in indicators.read_indicators(spark, f"{tmp_path}/q.csv").orderBy("seq").collect()] == ["1.1.1.1", "evil.com"]
    assert indicators.load_settings("min_risk: 60", environ={"BRACKWATER_MIN_RISK": "70", "BRACKWATER_TTL_HOURS": "2"}) == indicators.load_settings(override={"min_risk": 70, "ttl_hours": 2.0})


def test_iso_forms_as_python_reads_them(spark):
    day, clock, zone = ("2026-03-04", "20260304", "2026-02-30", "2026-3-4"), ("", "T10", " 10:11", "T1011", "T10:11:12", "T101112", "T10:11:12.1", "T10:11:12,123456789", "T10:11:12.", "T10:11:60", "T24:00"), ("", "Z", "+02:00", "-0330", "+05", "+5")
    forms = [d + c + z for d in day for c in clock for z in zone if c or not z]
    got = {r.s: r.t for r in spark.createDataFrame([(s,) for s in forms], "s string").select("s", F.date_format(scalars.to_instant(F.col("s")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).collect()}
    for s in forms:
        try:
            want = dt.datetime.fromisoformat(s)
            want = (want if want.tzinfo else want.replace(tzinfo=dt.timezone.utc)).astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        except ValueError:
            want = None
        assert got[s] == want, s


def test_folds_and_checks(spark):
    df = generators.flows(spark, 900).cache()
    n = {(r.label, r.fold): r["count"] for r in learning.stratified_folds(df, "label", 4, part_rows=100).groupBy("label", "fold").count().collect()}
    for y in (0, 1):
        of = [v for (k, _), v in n.items() if k == y]
        assert len(of) == 4 and max(of) - min(of) <= 9
    cv = {r.metric: r["mean"] for r in learning.cross_validate(df, "logistic", ["spkts", "dur"], folds=3).collect()}
    assert set(cv) == set(learning.CV_METRICS) and min(cv.values()) > 0.8
    r = learning.production_check(learning.train_classifier(df, "logistic", ["spkts", "dur"]), df).first()
    assert r.inference_time_ms > 0 and r.model_size_mb > 0 and r.robustness_f1 > 0.8
    base = isolation.evasion_base(df.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": (F.col("id") % 2).cast("int")}), "label")
    assert base.count() == df.filter("id % 2 = 1 AND label = 1").count()


def test_folds_are_exact_over_parts(spark):
    df = spark.range(1003).selectExpr("id", "CASE WHEN id < 3 THEN 'few' WHEN id < 1000 THEN 'many' END AS label")
    for folds in (1, 5):
        rows = learning.stratified_folds(df, "label", folds, part_rows=50).collect()
        assert len(rows) == 1000 and len({r.id for r in rows}) == 1000
        for label, n in (("few", 3), ("many", 997)):
            got = [sum(r.label == label and r.fold == f for r in rows) for f in range(folds)]
            assert got == [n // folds + (f < n % folds) for f in range(folds)]
    assert len({r.fold for r in rows if 500 <= r.id < 520}) > 1


def test_long_url_ids_have_no_line_breaks(spark):
    url = "https://host.example/" + "a~" * 90
    assert spark.createDataFrame([(url,)], "u string").select(scalars.url_id(F.col("u"))).first()[0] == base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")


def test_feed_answers_odd(spark):
    kind = "indicator string, type string, virustotal string, virustotal_code int, abuseipdb string, abuseipdb_code int, alienvault_otx string, alienvault_otx_code int"
    rows = [("a", "ipv4", None, 200, "[1]", 200, "x", 200), ("b", "url", "{}", 200, "{}", 200, "{}", 200), ("c", "ipv4", None, None, "{}", 404, None, 404)]
    got = [r.enrichment for r in scoring.from_answers(spark.createDataFrame(rows, kind)).collect()]
    assert [(e.virustotal.status, e.abuseipdb.status, e.alienvault_otx.status) for e in got] == [("error", "error", "error"), ("success", "n_a", "success"), ("error", "error", "not_found")]
    assert got[1].virustotal.total_engines == 0 and got[1].virustotal.owner == "N/A" and got[1].alienvault_otx.tags == [] and got[0].virustotal.tags is None


def test_security_events(spark, tmp_path):
    good = {"event_id": "e1", "timestamp": "2026-07-18T14:30:00Z", "event_type": "auth", "source_ip": "1.1.1.1", "details": {"action": "login", "geo_location": {"lat": 1.0, "lon": 2.0}}}
    (tmp_path / "e.jsonl").write_text("\n".join([json.dumps(good), "{bad", json.dumps(good | {"timestamp": "18.7."}), ""]))
    ok, bad = logs.read_security_events(spark, f"{tmp_path}/e.jsonl")
    assert [r.user_id for r in ok.collect()] == [""] and bad.count() == 2


IPS = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "", None, "10.1.2.3", "172.31.0.1", "172.32.0.1", "198.51.100.12", "203.0.113.88", "127.0.0.1", "8.8.8.8", "2001:db8::1", "2606:4700::1111", "fe80::1", ":", "240.0.0.1", "169.254.1.1", "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2:3:4:5:6:7:8", "1:2:3", "1::2::3", "12345::", ":::", "::1.2.3.4", "64:ff9b:1::5", "64:ff9b::5", "fc00::1", "fdff::", "fec0::1", "febf::1", "100::1", "100:0:0:1::", "2001:1ff::", "2001:200::", "::g", "fe80::1%eth0", "::256.1.1.1", "1.2.3.4::"]


def test_ips(spark):
    got = spark.createDataFrame([(x,) for x in IPS], "ip string").select("ip", network.is_valid_ip(F.col("ip")).alias("v"), network.is_private_ip(F.col("ip")).alias("p"), network.generalize_ip(F.col("ip")).alias("g")).collect()
    for r in got:
        try:
            a = ipaddress.ip_address(r.ip or "")
        except ValueError:
            a = None
        assert bool(r.v) == (a is not None) and bool(r.p) == (a is not None and a.is_private), r
    assert got[0].g == "1.2.3.0" and got[3].g == "1.2.3"


def test_scalars(spark):
    r = spark.range(1).select(
        scalars.entropy_bits(F.lit("google.com")).alias("e"), scalars.entropy_bits(F.lit("")).alias("z"), scalars.entropy_bits(F.lit("a.\U0001f600\n")).alias("four"), scalars.half_even(F.lit(2.5)).alias("h"), scalars.url_id(F.lit("http://a.b/?")).alias("u"),
        scalars.haversine_km(F.lit(40.7), F.lit(-74.0), F.lit(51.5), F.lit(-0.1)).alias("km"), scalars.pseudonymize(F.lit(""), "s").alias("blank"),
    ).first()
    assert abs(r.e - 2.6464393446710157) < 1e-9 and r.z == 0 and r.four == 2 and r.h == 2 and r.u == "aHR0cDovL2EuYi8_" and 5550 < r.km < 5590 and r.blank == ""
    noise = np.array([x[0] for x in spark.range(20000).select(scalars.laplace_noise(F.lit(0.5), 0.01, 0.5, seed=1)).collect()]) - 0.5
    assert abs(noise.mean()) < 0.001 and abs(np.abs(noise).mean() - 0.02) < 0.001


def event(line, **k):
    base = {"line_number": line, "event_id": f"e{line}", "timestamp": "2026-07-18T14:30:00Z", "source_ip": f"8.8.8.{line}", "target_ip": None, "action": "ALLOW", "status": "success", "log_type": "firewall", "bytes": None, "original_line": "x"}
    return base | k


SCHEMA = "line_number long, event_id string, timestamp string, source_ip string, target_ip string, action string, status string, log_type string, bytes long, original_line string"


def rules(spark, *rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((r.line_number, r.rule) for r in record_quality.issues(df, NOW).collect()), record_quality.summary(df, record_quality.issues(df, NOW)).first()


def test_record_rules(spark):
    found, s = rules(
        spark, event(1, event_id=None), event(2, source_ip="999.9.9.9"), event(3, source_ip="10.0.0.1", log_type="dns"), event(4, timestamp="2099-01-01T00:00:00Z"), event(5, timestamp="2020-01-01T00:00:00Z"),
        event(6, event_id="e5"), event(7, action="DENY"), event(8, bytes=2 << 40), event(9, bytes=-500), event(10, source_ip="9.9.9.9"), event(11, source_ip="9.9.9.9", timestamp="2026-07-18T14:30:00.500Z"), event(12, timestamp="x"), event(13, target_ip="h"),
    )
    assert found == [(1, "missing"), (2, "source_ip"), (3, "private_ip"), (4, "future"), (5, "archived"), (6, "duplicate"), (7, "deny_success"), (8, "huge_bytes"), (9, "negative_bytes"), (11, "rapid"), (12, "bad_time"), (13, "target_ip")]
    assert (s.total_records, s.error_count, s.warning_count, s.valid_records) == (13, 7, 5, 6)
    assert s.by_check["Check 2: IP Validation"].status == "ERROR"
    found, s = rules(spark, event(1), event(2))
    assert found == [] and s.valid_records == 2 and {v.status for v in s.by_check.values()} == {"PASS"}


def test_record_rules_in_blocks(spark):
    rows = [event(i, event_id=["same", f"e{i}", "", None][i % 4], source_ip=["9.9.9.9", "x", "10.0.0.1"][i % 3], timestamp=[f"2026-07-18T14:30:{i // 4 % 60:02}.{i % 4}00Z", "", "late", None][i % 7 % 4], bytes=-i, log_type="dns") for i in range(-20, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = record_quality.issues(df, NOW)
    want = record_quality.summary(df, whole).first()
    seen, last, before = [], {}, {}
    for r in rows:
        if r["event_id"]:
            before[r["event_id"]] = before.get(r["event_id"], -1) + 1
            seen += [(r["line_number"], "duplicate")] * (before[r["event_id"]] > 0)
        if (r["timestamp"] or "").startswith("2026"):
            at = dt.datetime.fromisoformat(r["timestamp"])
            gap = at - last.get(r["source_ip"], NOW)
            seen += [(r["line_number"], "rapid")] * (dt.timedelta(0) <= gap < dt.timedelta(seconds=1))
            last[r["source_ip"]] = at
    assert sorted((r.line_number, r.rule) for r in whole.filter("rule IN ('duplicate', 'rapid')").collect()) == sorted(seen)
    for lines in (1, 3, 1000):
        assert record_quality.quick_summary(df, NOW, lines=lines).first() == want
        assert sorted(record_quality.rapid_issues(df, lines).collect()) == sorted(whole.filter("rule = 'rapid'").collect())
        assert sorted(record_quality.duplicate_issues(df, lines).collect()) == sorted(whole.filter("rule = 'duplicate'").collect())
    assert record_quality.quick_summary(df.limit(0), NOW).first() == record_quality.summary(df.limit(0), record_quality.issues(df.limit(0), NOW)).first()


def brute_windows(rows):
    lo, hi = min(r[2] for r in rows), max(r[2] for r in rows)
    out, k = {}, 0
    while lo + 900e6 * k + 3600e6 <= hi:
        for _, e, us in rows:
            if lo + 900e6 * k <= us < lo + 900e6 * k + 3600e6:
                out[e, k] = out.get((e, k), 0) + 1
        k += 1
    return out


def test_windows_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"u{i % 3}", int(t)) for i, t in enumerate(rng.integers(0, 20_000_000_000, 200))]
    df = spark.createDataFrame(rows, "seq long, entity string, us long")
    got = {(r.entity, r.win): r["count"] for r in features.in_windows(df).groupBy("entity", "win").count().collect()}
    assert got == brute_windows(rows)


def test_generated_attacks_show(spark):
    e = generators.security_events(spark, 3000)
    f = {(r.entity, r.win): r for r in features.window_features(e).collect()}
    top = lambda entity, c: max(r[c] for (x, _), r in f.items() if x == entity)
    assert top("attacker0", "failed_login_ratio") == 1.0 and top("attacker1", "geo_velocity") > 10_000 and top("attacker2", "port_scan_index") > 0.005
    assert top("attacker3", "data_exfil_ratio") > 1000 and top("attacker4", "dns_query_entropy") > 3.5 and top("attacker5", "privilege_escalation_score") >= 10
    out = features.private_features(features.window_features(e), "salt", clip=True).toPandas()
    assert out.entity_id.str.len().eq(64).all() and out.failed_login_ratio.between(0, 1).all() and out.generalized_ip.isna().all()


def test_generated_logs_parse(spark):
    df = logs.parse_lines(generators.raw_logs(spark, 6000))
    bad = df.filter("error_code IS NOT NULL").count()
    assert 5 <= bad <= 80 and generators.raw_logs(spark, 50).collect() == generators.raw_logs(spark, 6000).filter("line_number <= 50").orderBy("line_number").collect()


def test_dataset_checks(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, 2.0, float("nan")), (2, 2.0, 3.0), (3, -1.0, 4.0)], "k int, failed_login_ratio double, geo_velocity double")
    missing = {r.column: (r.affected, r.status) for r in dataset_quality.check_missing(df).collect()}
    assert missing == {"k": (0, "PASS"), "failed_login_ratio": (0, "PASS"), "geo_velocity": (2, "FAIL")}
    assert {r.column: r.affected for r in dataset_quality.check_ranges(df).collect()} == {"failed_login_ratio": 3, "geo_velocity": 0}
    assert {r.check_name: r.affected for r in dataset_quality.check_duplicates(df, ["k"]).collect()} == {"duplicate_rows": 0, "duplicate_keys": 1}
    assert [r.status for r in dataset_quality.check_schema(df, ["k", "z"]).collect()] == ["FAIL", "WARN"]


def test_drift(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 400), np.round(rng.normal(0.3, 1.2, 300), 1)
    fa, fb = (spark.createDataFrame([(float(v),) for v in x], "v double") for x in (a, b))
    h = [np.histogram(x, 10)[0] / len(x) for x in (a, b)]
    e, c = (np.where(x == 0, 1e-4, x) for x in h)
    assert abs(dataset_quality.psi(fa, fb, "v").first().psi - ((c - e) * np.log(c / e)).sum()) < 1e-9
    grid = np.concatenate([a, b])
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert abs(dataset_quality.ks_statistic(fa, fb, "v").first().ks_stat - d) < 1e-12
    assert dataset_quality.ks_p_value(0.0, 10, 10) == 1.0 and dataset_quality.ks_p_value(0.9, 100, 100) < 1e-6
    same = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert dataset_quality.psi(same, same, "v").first().psi == 0 and dataset_quality.psi(same.limit(0), same, "v").first().psi == 0


def test_auc_and_precision(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert abs(metrics.roc_auc(df, "y", "s").first()[0] - auc) < 1e-12
    ap, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        r = (pos >= t).mean()
        ap, before = ap + (r - before) * (y[s >= t] == 1).mean(), r
    assert abs(metrics.average_precision(df, "y", "s").first()[0] - ap) < 1e-12
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0] is None


def test_indicator_types_and_files(spark, tmp_path):
    cases = {"1.2.3.4": "ipv4", "d41d8cd98f00b204e9800998ecf8427e": "hash", "HTTP://x": "url", "a.b/c": "url", "1.2.3.0/24": "url", "sub.example.co.uk": "domain", "2001:db8::1": "unknown", "localhost": "unknown"}
    df = spark.createDataFrame(list(cases.items()), "i string, t string")
    assert {r.i: r.k for r in df.select("i", network.indicator_type(F.col("i")).alias("k")).collect()} == cases
    (tmp_path / "x.csv").write_text("note,IOC\na,1.1.1.1\n# c\nb,evil.com\nc,1.1.1.1\n")
    (tmp_path / "y.csv").write_text("1.2.3.4,x\nevil.org,y\n")
    (tmp_path / "z.txt").write_text("# c\nevil.com\n\n1.1.1.1\nevil.com\n")
    read = lambda n: [r.indicator for r in indicators.read_indicators(spark, f"{tmp_path}/{n}").orderBy("seq").collect()]
    assert read("x.csv") == ["1.1.1.1", "evil.com"] and read("y.csv") == ["1.2.3.4", "evil.org"] and read("z.txt") == ["evil.com", "1.1.1.1"]
    assert indicators.load_settings("min_risk: 60").min_risk == 60
    with pytest.raises(ValueError):
        indicators.load_settings("api_key: x")


def payloads(spark, m=0, s=0, score=0, white=False, pulses=0, tags=(), kind="ipv4", vt="success", ab="success", otx="success"):
    row = ("i", kind, json.dumps({"status": vt, "malicious": m, "suspicious": s}), json.dumps({"status": ab, "score": score, "is_whitelisted": white}), json.dumps({"status": otx, "pulse_count": pulses, "tags": list(tags)}))
    return scoring.parse_feeds(spark.createDataFrame([row], "indicator string, type string, virustotal string, abuseipdb string, alienvault_otx string"))


@pytest.mark.parametrize(("given", "score", "tier"), [
    ({"m": 20, "score": 100, "pulses": 10}, 100, "CRITICAL"),
    ({"white": True, "score": 80}, 0, "CLEAN"),
    ({"m": 1, "white": True, "score": 50}, 27, "SUSPICIOUS"),
    ({"kind": "domain", "m": 5, "pulses": 1, "tags": ["C2 server", "x"]}, 54, "HIGH"),
    ({"kind": "hash", "m": 2, "vt": "error", "pulses": 2}, 6, "CLEAN"),
])
def test_risk(spark, given, score, tier):
    r = scoring.enrich(payloads(spark, **given)).first()
    assert (r.risk_score, r.risk_tier) == (score, tier)


def test_store(spark, tmp_path):
    t0, t1 = (F.lit(x).cast("timestamp") for x in ("2026-01-01 00:00:00", "2026-03-15 00:00:00"))
    new = scoring.enrich(payloads(spark, m=10, score=90, pulses=4, tags=["Botnet"]))
    empty = spark.createDataFrame([], f"indicator string, type string, first_seen timestamp, last_seen timestamp, expiration timestamp, confidence int, risk_score int, risk_tier string, status string, sources array<string>, tags array<string>, enrichment_data {scoring.ENRICHMENT}, history {lifecycle.HISTORY}")
    store = lifecycle.upsert(empty, new, t0)
    r = store.first()
    assert (r.status, r.confidence, r.tags, len(r.history), (r.expiration - r.first_seen).days) == ("active", 100, ["botnet"], 1, 30)
    writers.write_store(store, f"{tmp_path}/store", "v1")
    once = lifecycle.expire(writers.read_store(spark, f"{tmp_path}/store"), t1, 30)
    assert once.first().status == "expired" and once.collect() == lifecycle.expire(once, t1).collect()
    assert lifecycle.expire(once, t1, 30).count() == 0
    again = lifecycle.upsert(once, new, t1).first()
    assert (again.status, len(again.history), again.first_seen) == ("active", 3, r.first_seen)
    revoked = store.withColumn("status", F.lit("revoked"))
    assert lifecycle.upsert(revoked, new, t1, keep_revoked=True).first().status == "revoked"
    found = lifecycle.candidates(store.withColumn("seq", F.lit(1)))
    writers.write_lines(lifecycle.blocklist_ip(found), f"{tmp_path}/list", [F.desc("risk_score"), "seq"], ["# header"])
    assert (next((tmp_path / "list").glob("part*"))).read_text() == "# header\ni/32  # Risk: 86, Conf: 100, Tags: [botnet]\n"


def test_clients_and_ingest(spark, tmp_path):
    calls = []

    def flaky(indicator, kind):
        calls.append(indicator)
        if len(calls) == 1:
            raise scoring.TooManyRequests(0)
        if len(calls) == 2:
            raise TimeoutError
        if indicator == "bad":
            raise ValueError
        return {"virustotal": "{}", "abuseipdb": "{}", "alienvault_otx": "{}"}

    once = scoring.with_retries(flaky, pause_s=0)
    assert once("x", "ipv4")["virustotal"] == "{}" and len(calls) == 3 and "error" in once("bad", "url")["virustotal"]
    (tmp_path / "list.txt").write_text("9.9.9.9\nevil.com\n")
    empty = spark.createDataFrame([], f"indicator string, type string, first_seen timestamp, last_seen timestamp, expiration timestamp, confidence int, risk_score int, risk_tier string, status string, sources array<string>, tags array<string>, enrichment_data {scoring.ENRICHMENT}, history {lifecycle.HISTORY}")
    t0 = F.lit("2026-01-01 00:00:00").cast("timestamp")
    store = lifecycle.ingest(empty, indicators.read_indicators(spark, f"{tmp_path}/list.txt"), t0)
    assert {r.indicator: (r.type, r.risk_score, r.confidence) for r in store.collect()} == {"9.9.9.9": ("ipv4", 0, 25), "evil.com": ("domain", 0, 25)}
    again = lifecycle.refresh_active(store, t0, lambda i, k: {"virustotal": '{"status": "success", "malicious": 9}'})
    assert {r.risk_tier for r in again.collect()} == {"SUSPICIOUS", "HIGH"}


def test_raw_answers_on_the_path(spark, tmp_path):
    now = lambda day: F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp")
    asked = tmp_path / "asked"

    def client(indicator, kind):
        with asked.open("a") as f:
            f.write(indicator + "\n")
        if indicator == "odd.com":
            return {"virustotal": (404, None), "abuseipdb": (200, "[]"), "alienvault_otx": (500, "no")}
        return {"virustotal": (200, '{"data": {"attributes": {"last_analysis_stats": {"malicious": 4, "harmless": 60}}}}'), "abuseipdb": (200, '{"data": {"abuseConfidenceScore": 80}}'), "alienvault_otx": '{"status": "success", "pulse_count": 2}'}

    some = spark.createDataFrame([("9.9.9.9",), ("odd.com",), ("9.9.9.9",), (None,)], "indicator string")
    root = f"{tmp_path}/cache"
    first = {r.indicator: r for r in scoring.enrich_cached(some, root, now(1), client).collect()}
    assert len(first) == 2 and not any(r.from_cache for r in first.values()) and sorted(asked.read_text().split()) == ["9.9.9.9", "odd.com"]
    e = first["9.9.9.9"].enrichment
    assert (e.virustotal.malicious, e.virustotal.total_engines, e.abuseipdb.score, e.alienvault_otx.pulse_count) == (4, 64, 80, 2)
    odd = first["odd.com"].enrichment
    assert (odd.virustotal.status, odd.abuseipdb.status, odd.alienvault_otx.status, first["odd.com"].risk_score) == ("not_found", "n_a", "error", 0)
    again = scoring.enrich_cached(some.unionByName(spark.createDataFrame([("new.org",)], "indicator string")), root, now(1), client)
    assert {r.indicator: r.from_cache for r in again.collect()} == {"9.9.9.9": True, "odd.com": True, "new.org": False}
    assert len(asked.read_text().split()) == 3
    late = {r.indicator: r for r in scoring.enrich_cached(some, root, now(9), client).collect()}
    assert not any(r.from_cache for r in late.values()) and late["9.9.9.9"].risk_score == first["9.9.9.9"].risk_score
    busy = iter([{"virustotal": (429, None), "abuseipdb": (200, "{}")}, {"virustotal": (200, "{}"), "abuseipdb": (500, "late")}])
    assert scoring.with_retries(lambda i, k: next(busy), pause_s=0)("x", "ipv4") == {"virustotal": (200, "{}"), "abuseipdb": (200, "{}")}


def test_lanes_share_one_rate(spark, tmp_path):
    def client(indicator, kind):
        (tmp_path / indicator).write_text(str(dt.datetime.now().timestamp()))
        return {}

    few = spark.createDataFrame([(f"h{i}",) for i in range(12)], "indicator string")
    assert scoring.query_feeds(few, client, min_interval_s=0.1, lanes=3).filter("virustotal IS NULL AND virustotal_code IS NULL").count() == 12
    times = sorted(float(p.read_text()) for p in tmp_path.iterdir())
    assert times[-1] - times[0] > 0.7


def test_cache_log_after_a_broken_write(spark, tmp_path):
    root, kind = f"{tmp_path}/log", "indicator string, v int, cached_at timestamp"
    at = lambda *rows: spark.createDataFrame([(k, v, dt.datetime(2026, 1, d)) for k, v, d in rows], kind)
    got = lambda: {r.indicator: r.v for r in cache_log.read(spark, root, kind).collect()}
    assert got() == {} and cache_log.compact(spark, root, kind) == 0
    cache_log.append(at(("a", 1, 1), ("b", 1, 5)), root)
    cache_log.append(at(("a", 2, 3), ("b", 2, 4), ("c", 2, 1)), root)
    want = {"a": 2, "b": 1, "c": 2}
    assert got() == want
    at(("a", 9, 9)).write.parquet(f"{root}/entries/3-unnamed")  # a writer that died before its line
    unfinished = tmp_path / "log/log/_temporary/0/_temporary/attempt_0"
    unfinished.mkdir(parents=True)
    (unfinished / "part-0.json").write_text('{"version": 3, "path": "nowhere"')
    assert got() == want
    assert cache_log.compact(spark, root, kind) == 3 and got() == want
    cache_log.append(at(("a", 3, 3), ("d", 3, 1)), root)
    assert got() == {"a": 3, "b": 1, "c": 2, "d": 3}  # of equal times the later delta
    assert cache_log.compact(spark, root, kind) == 5 and got() == {"a": 3, "b": 1, "c": 2, "d": 3}


def test_saved_models(spark, tmp_path):
    df = generators.flows(spark, 400)
    cols = ["spkts", "dur"]
    fitted, log = learning.train_best(df, cols, f"{tmp_path}/best", kinds=("logistic", "boosted_trees"), n_iter=1, folds=2)
    again, about = learning.load_classifier(spark, f"{tmp_path}/best")
    assert about["features"] == cols and about["about"]["folds"] == 2
    same = lambda m: [(r.id, r.predicted) for r in learning.probabilities(m, df).orderBy("id").collect()]
    assert same(fitted) == same(again)
    rows = log.collect()
    assert [r.kind for r in rows if r.best] == [max(rows, key=lambda r: r.f1).kind] and spark.read.option("header", True).csv(f"{tmp_path}/best/training_log").count() == 2
    with pytest.raises(Exception, match="nothing"):
        learning.load_classifier(spark, f"{tmp_path}/nothing")
    sweep = isolation.tune_saved(df, cols, "label", [-0.1, 0.0], f"{tmp_path}/forest", trees=20)
    forest = isolation.load(spark, f"{tmp_path}/forest")
    assert sweep.collect() == isolation.tune_saved(df, cols, "label", [-0.1, 0.0], f"{tmp_path}/forest", trees=3).collect() and len(forest.roots) == 20
    both, once = isolation.fit(df, cols, trees=20), isolation.fit_predict(df, cols, trees=20)
    assert (both.roots == once[0].roots).all() and abs(both.offset - once[0].offset) < 1e-12
    assert once[1].select("id", "anomaly_score", "is_anomaly").orderBy("id").collect() == isolation.predict(df, both).select("id", "anomaly_score", "is_anomaly").orderBy("id").collect()


def test_suricata_gaps(spark):
    rows = [(i, f"x{i}", k, r, 60, "active") for i, (k, r) in enumerate([("hash", 90), ("ipv4", 90), ("domain", 70), ("url", 95), ("ipv4", 10)])]
    df = spark.createDataFrame(rows, "seq long, indicator string, type string, risk_score int, confidence int, status string")
    assert sorted((r.indicator, r.sid) for r in lifecycle.suricata_rules(lifecycle.candidates(df)).collect()) == [("x1", 1000003), ("x2", 1000004)]


SCHEMA_TEXT = """{"title": "t", "type": "object", "required": ["head", "list"], "properties": {
  "head": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "format": "uuid"}, "n": {"type": "number", "minimum": 0}}},
  "list": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "string", "enum": ["a", "b"]}, "tags": {"type": "array", "items": {"type": "string"}}}}}}}"""


def test_documents(spark, tmp_path):
    (tmp_path / "schema.json").write_text(SCHEMA_TEXT)
    rules = documents.load_schema(spark, f"{tmp_path}/schema.json")
    assert [r.path for r in rules] == ["head", "head.id", "head.n", "list", "list[]", "list[].k", "list[].tags", "list[].tags[]"]
    good = {"head": {"id": "1", "n": 0}, "list": [{"k": "a"}, {"k": "b", "tags": ["x"]}], "more": 1}
    cases = {
        json.dumps(good): [],
        json.dumps(good | {"head": 5}): ["head: type"],
        json.dumps(good | {"head": {"n": -1}}): ["head.id: required", "head.n: range"],
        json.dumps(good | {"head": {"id": None}}): ["head.id: type"],
        json.dumps(good | {"list": [{"k": "c", "tags": ["x", 1]}]}): ["list: items", "list[].k: enum", "list[].tags[]: type"],
        json.dumps(good | {"list": [{"k": "a"}, {}, 3]}): ["list[]: type", "list[].k: required"],
        "{}": ["head: required", "list: required"],
        "[1]": ["json"],
        "": ["json"],
    }
    df = spark.createDataFrame([*((t,) for t in cases), (None,)], "json string")
    got = [r.violations for r in documents.validate(df, rules=rules).collect()]
    assert got == [*cases.values(), ["json"]]
    assert documents.validate(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(documents.rules_of({"type": "object", "properties": {"a": {"type": "string", "pattern": "x"}}}))
    with pytest.raises(ValueError):
        list(documents.rules_of({"type": "object", "required": ["a"]}))


def test_isolation_ranks_planted_outliers(spark, tmp_path):
    df = generators.flows(spark, 3000)
    cols = ["dur", "spkts", "dpkts", "sbytes", "dbytes", "rate"]
    forest = isolation.fit(df, cols, trees=50)
    scored = isolation.predict(df, forest)
    r = scored.agg(F.avg("is_anomaly"), F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0.07 < r[0] < 0.13 and -1 < r[1] < r[2] < 1
    assert metrics.roc_auc(scored.withColumn("s", -F.col("anomaly_score")), "label", "s").first()[0] > 0.95
    forest.save(spark, f"{tmp_path}/forest")
    again = isolation.load(spark, f"{tmp_path}/forest")
    assert isolation.predict(df, again).agg(F.avg("is_anomaly")).first()[0] == r[0]
    sweep = isolation.tune(df, forest, "label", [-0.2, 0.0, 0.1])
    assert metrics.best_threshold(sweep).first().threshold == 0.0
    scale = learning.fit_scale(df, cols)
    assert isolation.scaling_attack(df, cols, 2.0, scale).count() == isolation.noise_attack(df, cols, 0.1, scale).count() == 3000


def test_models(spark):
    df = generators.flows(spark, 600).withColumn("proto", F.when(F.col("id") % 2 == 0, "tcp").otherwise("udp"))
    cols = ["dur", "spkts", "rate"]
    for kind, more in (("random_forest", {"numTrees": 10}), ("boosted_trees", {"maxIter": 5}), ("logistic", {})):
        fitted = learning.train_classifier(df, kind, cols, ["proto"], **more)
        got = metrics.rates(metrics.confusion(learning.probabilities(fitted, df), F.col("label"), F.col("predicted"))).first()
        assert got.f1 > 0.9
    n = df.groupBy("label").count().collect()
    want = max(r["count"] for r in n) - min(r["count"] for r in n)
    made = learning.smote(df, cols, "label")
    assert 0.8 * want < made.count() < 1.2 * want and made.agg(F.min("spkts")).first()[0] > 100


def test_smote_neighbours_stay_near_at_every_size(spark):
    off = []
    for n in (1200, 12000):
        x = F.col("id") / F.lit(float(n))
        df = spark.range(n).select(x.alias("a"), (x * x).alias("b"), F.lit(1).alias("label")).unionByName(spark.range(2 * n).select(F.lit(9.0).alias("a"), F.lit(9.0).alias("b"), F.lit(0).alias("label")))
        made = learning.smote(df, ["a", "b"], "label", block_rows=100).toPandas()
        at = made["a"].to_numpy() * n
        assert abs(len(made) / n - 1) < 0.1 and (np.abs(at - np.round(at)) < 1e-6).mean() < 0.01
        off.append(float(((made["b"] - made["a"] ** 2).abs() * n * n).median()))
    assert max(off) < 1.5 * min(off)


def test_near_rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 3))
    near = learning.near_rows(x, 5)
    assert near.shape == (1500, 5) and (near != np.arange(1500)[:, None]).all() and all(len(set(r)) == 5 for r in near.tolist())
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    best = np.sort(d, 1)[:, :5]
    got = np.sort(np.take_along_axis(d, near, 1), 1)
    assert (got[:, 0] == best[:, 0]).mean() > 0.6 and np.median(got[:, 4] / best[:, 4]) < 1.6
    whole = learning.near_rows(x, 5, leaf=1500)
    assert np.allclose(np.sort(np.take_along_axis(d, whole, 1), 1), best)
    assert learning.near_rows(x[:1], 5).shape == (1, 0) and learning.near_rows(x[:3], 5).shape == (3, 2)
    same = np.zeros((1000, 2))
    assert learning.near_rows(same, 4).shape == (1000, 4)
    same[::2] = np.nan
    assert np.isfinite(same[learning.near_rows(same, 1)[1::2, 0]]).all()


def test_smote_copies_fill_no_single_partition(spark):
    few = spark.range(6000).select(F.when(F.col("id") < 4000, 1.0).otherwise(F.col("id") / 100.0).alias("a"), F.lit(1).alias("label"))
    df = few.unionByName(spark.range(9000).select(F.lit(50.0).alias("a"), F.lit(0).alias("label")))
    made = learning.smote(df, ["a"], "label", block_rows=100)
    assert abs(made.count() - 3000) < 300 and made.agg(F.min("a"), F.max("a")).first()[0] == 1.0
    ranged = few.withColumn("_tie", F.rand(1)).repartitionByRange(4, "a", "_tie").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 2500
    assert learning.smote(df.filter("label = 0"), ["a"], "label").count() == 0


def test_forest_draws_rows_whatever_their_values(spark, monkeypatch):
    seen = []
    grow = isolation.grow
    monkeypatch.setattr(isolation, "grow", lambda x, *a: seen.append(x) or grow(x, *a))
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("a"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(4)).alias("b"))
    isolation.fit(df, ["a", "b"], trees=50)
    assert len(seen[0]) == 50 * 256 and abs((seen[0] == 0.5).all(1).mean() - 1 / 3) < 0.03
    assert isolation.draw_rows(df.limit(70), 100, 1).count() == 70


def test_search_and_importance(spark):
    df = generators.flows(spark, 400)
    best, scores = learning.search(df, "logistic", ["spkts", "dur"], n_iter=2, folds=3)
    assert len(scores) == 2 and max(s for _, s in scores) > 0.8
    imp = {r.column: r.importance for r in learning.permutation_importance(best, df, ["spkts", "dur"], ["id"]).collect()}
    assert imp["spkts"] >= imp["dur"]
    assert imp == {r.column: r.importance for r in learning.permutation_importance(best, df.repartition(7), ["spkts", "dur"], ["id"]).collect()}


def test_importance_in_one_pass(spark, monkeypatch):
    df = generators.flows(spark, 400).select("id", "spkts", "dur", "label")
    fitted = learning.train_classifier(df, "logistic", ["spkts", "dur"])
    marked = df.withColumns({f"m{n}": F.xxhash64("id", F.lit(n)) for n in (43, 44, 45)}).toPandas()
    want, right = {}, lambda d: learning.probabilities(fitted, spark.createDataFrame(d)).filter("predicted = label").count() / len(marked)
    for i, c in enumerate(["spkts", "dur"]):
        moved = marked.sort_values("m43").reset_index(drop=True)
        moved[c] = marked.sort_values(f"m{44 + i}")[c].to_numpy()
        want[c] = right(marked) - right(moved)
    passes, probabilities = [], learning.probabilities
    monkeypatch.setattr(learning, "probabilities", lambda *a: passes.append(1) or probabilities(*a))
    got = {r.column: r.importance for r in learning.permutation_importance(fitted, df, ["spkts", "dur"], ["id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want) and max(want.values()) > 0.02
    assert len(passes) == 1


def test_split_is_exact(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    got = {(r.label, r.split): r["count"] for r in exploration.stratified_split(df, "label", F.xxhash64("id")).groupBy("label", "split").count().collect()}
    assert got == {(0, 0): 630, (0, 1): 135, (0, 2): 135, (1, 0): 70, (1, 1): 15, (1, 2): 15}


def test_percentiles(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=501).round(1).tolist(), [7.0] * 900 + rng.random(50).tolist() + [None] * 9, [1.0, 2.0], [4.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        want = np.percentile([v for v in values if v is not None], [0, 25, 50, 75, 99, 100])
        assert np.allclose(exploration.percentiles(df, "v", (0, 0.25, 0.5, 0.75, 0.99, 1)).first().q, want)
    assert exploration.percentiles(df.limit(0), "v", (0.5,)).first().q == [None]
    df = spark.range(1000).withColumn("label", F.col("id") % 10 == 0)
    keyed = lambda **k: sorted(exploration.stratified_split(df, "label", F.xxhash64("id"), **k).select("id", "split").collect())
    assert keyed() == keyed(part_rows=30) == keyed(part_rows=30, most_broadcast=3)


def test_reports(spark):
    df = spark.createDataFrame([event(1, source_ip="x")], SCHEMA)
    found = record_quality.issues(df, NOW)
    s = record_quality.summary(df, found)
    assert json.loads(writers.summary_json(s))["error_count"] == 1
    assert "Check 2" in writers.console_report(s, record_quality.top_recommendations(found))
    assert "<table>" in writers.html_report("r", {"issues": found}) and "entropy" in writers.data_dictionary()
    drift = spark.createDataFrame([("f", 0.5, "Significant")], "feature string, psi double, status string")
    assert "Retrain" in writers.drift_markdown(drift)


def test_reports_with_content(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, None), ("b", 2, 0.5)], "entity_id string, window_start int, failed_login_ratio double")
    checks = dataset_quality.all_checks(df, ["entity_id", "window_start", "failed_login_ratio", "geo_velocity"], ["entity_id", "window_start"])
    got = {r.check_name: (r.status, r.affected, r.total) for r in checks.collect()}
    assert got["missing_columns"] == ("FAIL", 1, 3) and got["missing: failed_login_ratio"] == ("FAIL", 1, 3) and got["range: failed_login_ratio"] == ("FAIL", 1, 3) and got["duplicate_keys"] == ("FAIL", 1, 3) and got["extra_columns"][0] == "PASS"
    text = reports.quality_report(checks)
    assert text.index("missing_columns") < text.index("extra_columns") and "<b>4</b>FAIL" in text and "unit and the source" in text and text.count("<tr>") == len(got) + 1
    rates = metrics.rates(spark.createDataFrame([(5, 1, 2, 4)], "tn long, fp long, fn long, tp long"))
    scored = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "y int, s double")
    text = reports.evaluation_report("Model <1>", rates, metrics.threshold_sweep(scored, "y", "s", [0.3, 0.5]), spark.createDataFrame([("x", 0.5), ("z", 0.7)], "feature string, mean_abs double"), spark.createDataFrame([("web", 1, 2)], "category string, false_positives long, false_negatives long"))
    assert "Model &lt;1&gt;" in text and "<b>0.750</b>accuracy" in text and "<td>5</td><td>1</td>" in text and "Best F1 at 0.3" in text and text.index(">z<") < text.index(">x<") and ">web<" in text
    rows = [("1.1.1.1", "ipv4", "active", "HIGH", 60, 80), ("x.org", "domain", "active", "CRITICAL", 90, 50), ("y", "odd", "expired", None, 10, 90), ("<z>", "url", "active", "strange", 70, 99)]
    store = spark.createDataFrame(rows, "indicator string, type string, status string, risk_tier string, risk_score int, confidence int")
    n = reports.store_figures(store)
    assert n["all"] == {"all": 4, "confident": 2} and n["status"] == {"active": 3, "expired": 1, "revoked": 0} and n["tier"] == {"CRITICAL": 1, "HIGH": 1, "SUSPICIOUS": 0, "CLEAN": 1} and n["type"]["other"] == 1
    text = reports.executive_report(store)
    assert "&lt;z&gt;" in text and "<z>" not in text and text.index("x.org") < text.index("&lt;z&gt;") < text.index("1.1.1.1") and "expired</div>" in text
    assert reports.store_lines(store).splitlines()[1] == "status: active 3, expired 1, revoked 0"
    assert reports.text_table(store.orderBy("indicator"), ["indicator", "type"]).splitlines()[2].split() == ["1.1.1.1", "ipv4"]
    writers.write_enrichment(scoring.enrich_indicators(store), f"{tmp_path}/enriched")
    back = [json.loads(x) for p in (tmp_path / "enriched").glob("part*") for x in p.read_text().splitlines()]
    assert len(back) == 4 and all(set(r["enrichment"]) == set(scoring.FEEDS) and "owner" in r["enrichment"]["virustotal"] for r in back)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"2026-07-18 14:{i // 60:02d}:{i % 60:02d} u h FAILURE 9.9.9.9" for i in range(0, 120, 30)] + ["2026-07-18T14:30:00Z,192.168.7.21,10.4.0.9,8443,ALLOW,5120", "junk", "2026-07-18T20:30:00Z,192.168.7.21,10.0.0.50,443,ALLOW,15234"]
    (tmp_path / "in/a.log").write_text("\n".join(lines))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    stream = live.parsed_stream(live.read_log_stream(spark, f"{tmp_path}/in"))
    good = stream.filter("error_code IS NULL")
    assert run(stream, "all_lines").count() == 7
    assert run(live.issue_stream(good.withColumn("event_id", F.lit("x")), NOW), "issues").count() == 0
    counts = run(live.window_counts(good), "counts", "complete")
    assert counts.filter("source_ip = '9.9.9.9'").agg(F.max("failures")).first()[0] == 4
    (tmp_path / "in/b.log").write_text("\n".join(["2026-07-18 14:00:00 u h FAILURE 7.7.7.7"] * 2))
    assert run(live.rapid_stream(good), "rapid").count() == 1
    assert run(live.without_duplicates(good.withColumn("event_id", F.sha2("original_line", 256))), "once").count() == 7
    assert math.isfinite(spark.range(1).count())


def test_document_rules_in_nested_arrays(spark):
    R = documents.Rule
    rules = (R("a", "array"), R("a[]", "array", min_items=1), R("a[][]", "object"), R("a[][].b", "object", True), R("a[][].b.c", "number", high=5.0))
    cases = {
        '{"a": [[{"b": {"c": 1}}], [{"b": {}}]]}': [],
        '{"a": [[], [{"b": {"c": 9}}]]}': ["a[]: items", "a[][].b.c: range"],
        '{"a": [["x"], "y"]}': ["a[]: type", "a[][]: type"],
        '{"a": [[{}, {"b": [1]}]]}': ["a[][].b: required"],
        '{"a": {}}': ["a: type"],
        "[]": ["json"],
    }
    got = documents.validate(spark.createDataFrame([(k,) for k in cases], "json string"), rules=rules)
    assert {r.json: r.violations for r in got.collect()} == cases


def test_documents_of_one_split_are_many_tasks(spark, tmp_path):
    spark.range(60_000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert registry.queries()["doc_validate"](spark, str(tmp_path)).rdd.getNumPartitions() >= 3

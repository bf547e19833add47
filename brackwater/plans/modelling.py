"""Queries over metrics, preparation, models and document validation."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from brackwater.operators import attributions, boosting, documents, exploration, information, isolation, learning, metrics
from brackwater.plans import adapters as ad
from brackwater.plans.registry import query
from brackwater.session import table

COLUMNS = ("quantity", "price", "discount", "tax")
_CONF = "count_if(y = 0 AND p = 0) AS tn, count_if(y = 0 AND p = 1) AS fp, count_if(y = 1 AND p = 0) AS fn, count_if(y = 1 AND p = 1) AS tp"
_RATES = """round(CASE WHEN tn + fp + fn + tp > 0 THEN (tp + tn) / (tn + fp + fn + tp) ELSE 0.0 END, 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 9) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 9) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1,
  round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 9) AS fpr, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END, 9) AS fnr"""
RATES = ("accuracy", "precision", "recall", "f1", "fpr", "fnr")
_AT_HALF = "CAST(score >= 0.5 AS INTEGER) AS p"


def _confusion(spark, d):
    return metrics.confusion(ad.scored(spark, d), F.col("y"), (F.col("score") >= 0.5).cast("int"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in RATES})


query("m_confusion", f"WITH {ad.SCORED} SELECT {_CONF} FROM (SELECT y, {_AT_HALF} FROM scored)")(_confusion)
query("m_scores", f"WITH {ad.SCORED}, c AS (SELECT {_CONF} FROM (SELECT y, {_AT_HALF} FROM scored)) SELECT tn, fp, fn, tp, {_RATES} FROM c")(lambda spark, d: _rounded(metrics.rates(_confusion(spark, d))))
_STEPS = f"""{ad.SCORED}, s AS (SELECT score, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM s WINDOW w AS (ORDER BY score DESC))"""
query("m_roc_auc", f"WITH {_STEPS} SELECT round(sum(neg * (cp - pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 9) AS roc_auc FROM c")(lambda spark, d: metrics.roc_auc(ad.scored(spark, d), "y", "score").withColumn("roc_auc", F.round("roc_auc", 9)))
query("m_avg_precision", f"WITH {_STEPS} SELECT round(sum(pos * (cp / (cp + cn))) / sum(pos), 9) AS average_precision FROM c")(lambda spark, d: metrics.average_precision(ad.scored(spark, d), "y", "score").withColumn("average_precision", F.round("average_precision", 9)))
query("m_roc_curve", f"WITH {_STEPS} SELECT round(score, 9) AS score, CAST(cp AS BIGINT) AS cum_pos, CAST(cn AS BIGINT) AS cum_neg FROM c")(lambda spark, d: metrics.curve(ad.scored(spark, d), "y", "score").select(F.round("score", 9).alias("score"), "cum_pos", "cum_neg"))
GRID = (0.1, 0.3, 0.5, 0.7, 0.9)
_SWEEP = f"""{ad.SCORED}, t(threshold) AS (VALUES {', '.join(f'(CAST({g} AS DOUBLE))' for g in GRID)}), c AS (SELECT threshold, {_CONF} FROM (SELECT threshold, y, CAST(score >= threshold AS INTEGER) AS p FROM scored, t) GROUP BY threshold)"""
query("m_threshold_sweep", f"WITH {_SWEEP} SELECT threshold, tn, fp, fn, tp, {_RATES} FROM c")(lambda spark, d: _rounded(metrics.threshold_sweep(ad.scored(spark, d), "y", "score", GRID)))
query("m_best_threshold", f"WITH {_SWEEP} SELECT threshold, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1")(
    lambda spark, d: _rounded(metrics.best_threshold(metrics.threshold_sweep(ad.scored(spark, d), "y", "score", GRID))).select("threshold", "f1"))
query("m_per_class", f"WITH {ad.SCORED} SELECT trim(category) AS category, count(*) AS total, count_if(score >= 0.5) AS detected, round(count_if(score >= 0.5) * 100.0 / count(*), 6) AS rate FROM scored GROUP BY 1")(
    lambda spark, d: metrics.detection_by_category(ad.scored(spark, d), "category", F.col("score") >= 0.5).withColumn("rate", F.round(F.col("rate").cast("double"), 6)))
query("m_errors", f"WITH {ad.SCORED} SELECT category, count_if(y = 0 AND score >= 0.5) AS false_positives, count_if(y = 1 AND score < 0.5) AS false_negatives FROM scored GROUP BY 1")(
    lambda spark, d: ad.scored(spark, d).groupBy("category").agg(F.count_if((F.col("y") == 0) & (F.col("score") >= 0.5)).alias("false_positives"), F.count_if((F.col("y") == 1) & (F.col("score") < 0.5)).alias("false_negatives")))
query("alert_load", f"WITH {ad.SCORED}, r AS (SELECT count_if(score >= 0.9) / count(*) AS rate FROM scored) SELECT round(rate, 9) AS rate, CAST(floor(rate * 10000) AS BIGINT) AS alerts, floor(rate * 10000) > 50 AS overload FROM r")(
    lambda spark, d: metrics.alert_load(ad.scored(spark, d), F.col("score") >= 0.9).withColumn("rate", F.round("rate", 9)))
query("split_stratified", f"WITH {ad.FLOWS}, r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY l_orderkey) - 0.5 AS place, count(*) OVER (PARTITION BY label) AS n FROM flows) SELECT label, CASE WHEN place / n < 0.7 THEN 0 WHEN place / n < 0.85 THEN 1 ELSE 2 END AS split, count(*) AS rows FROM r GROUP BY 1, 2")(
    lambda spark, d: exploration.stratified_split(ad.flows(spark, d), "label", F.xxhash64("l_orderkey", "l_linenumber", "price", "quantity")).groupBy("label", "split").agg(F.count("*").alias("rows")))
query("scale_standard", f"WITH {ad.FLOWS}, m AS (SELECT avg(price) AS a, stddev_pop(price) AS s FROM flows) SELECT l_orderkey, l_linenumber, price, round((price - a) / s, 6) AS scaled FROM flows, m")(
    lambda spark, d: _scaled(ad.flows(spark, d)))


def _scaled(f):
    fitted = learning.fit_scale(f, ["price"])
    return learning.scale(f, fitted, "_s").select("l_orderkey", "l_linenumber", "price", F.round("price_s", 6).alias("scaled"))


@query("impute_median", f"WITH {ad.FLOWS}, h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN quantity END AS quantity FROM flows), m AS (SELECT quantile_cont(CAST(quantity AS DOUBLE), 0.5) AS q FROM h) SELECT l_orderkey, l_linenumber, coalesce(quantity, q) AS quantity FROM h, m")
def impute_median(spark, d):
    f = ad.flows(spark, d).select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 != 0, F.col("quantity")).alias("quantity"))
    return learning.impute(f, learning.fit_impute(f, ["quantity"]))


query("clip_percentile", f"WITH {ad.FLOWS}, t AS (SELECT label, quantile_cont(price, 0.99) AS top FROM flows GROUP BY 1) SELECT label, count(*) AS n, round(max(price), 6) AS top FROM flows JOIN t USING (label) WHERE price <= t.top GROUP BY 1")(
    lambda spark, d: exploration.clip_by_label(ad.flows(spark, d), "price", "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.max("price"), 6).alias("top")))
query("mode_fill", "SELECT 'A' AS kind, o_orderpriority AS value FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1)")(
    lambda spark, d: spark.createDataFrame([("A", learning.fit_impute(table(spark, d, "orders"), [], ["o_orderpriority"])["o_orderpriority"])], "kind string, value string"))


def _broken_documents() -> list[str]:
    """A valid document, one document for every way to break every rule, and texts that are no JSON object."""
    good = {
        "event": {"event_id": "e", "timestamp": "2026-01-01T00:00:00Z", "source": "s", "event_type": "dns", "severity": "low"},
        "enrichment": {"threat_intel_matches": [{"indicator": "i", "source": "f", "threat_type": "t"}] * 2, "asset_context": {"owner": "o", "environment": "staging", "criticality": "high"}, "related_events": ["r", "q"]},
        "confidence": {"score": 0.5, "scale": "0.0-1.0", "applies_to": ["event_type"]},
        "approval": {"approval_status": "approved", "approver_id": "a", "approval_timestamp": "2026-01-02T00:00:00Z"},
        "audit_trail": [{"actor": {"id": "x", "type": "human"}, "action": "triage", "timestamp": "2026-01-03T00:00:00Z"}] * 2,
        "more": None,
    }

    def changed(path: str, value: object) -> str:
        doc = json.loads(json.dumps(good))
        at, keys = doc, path.replace("[]", ".[]").split(".")
        for k in keys[:-1]:
            at = at[-1] if k == "[]" else at[k]  # of an array the last item is broken
        last = -1 if keys[-1] == "[]" else keys[-1]
        if value is None:
            del at[last]
        else:
            at[last] = value
        return json.dumps(doc)

    out = [json.dumps(good)]
    for r in documents.RULES:
        out += [changed(r.path, None)] if r.required else []
        out.append(changed(r.path, 5 if r.type != "number" else "5"))
        out += [changed(r.path, "odd")] if r.values else []
        out += [changed(r.path, 1.5), changed(r.path, -0.5)] if r.low is not None else []
        out += [changed(r.path, [])] if r.min_items else []
    return [*out, "{}", "not json", "[1]", "null", '{"event": {}, "audit_trail": [{}, 7]}']


_DOCUMENTS = _broken_documents()


def _rule_sql(rule: documents.Rule) -> str:
    """CASE expression of DuckDB: the violation of one rule by the JSON value j, or NULL."""
    kinds = {"object": "('OBJECT')", "array": "('ARRAY')", "string": "('VARCHAR')", "number": "('BIGINT', 'UBIGINT', 'DOUBLE')"}

    def first(holder: str, path: str) -> str:
        parent = path.rpartition(".")[0]
        own = f"json_extract({holder}, '$.{path}')" if path else holder
        above = f"json_extract({holder}, '$.{parent}')" if parent else holder
        cases = [f"WHEN json_type({above}) = 'OBJECT' AND {own} IS NULL THEN 'required'"] if rule.required else []
        cases.append(f"WHEN json_type({own}) NOT IN {kinds[rule.type]} THEN 'type'")
        cases += [f"WHEN json_extract_string({own}, '$') NOT IN ({', '.join(repr(v) for v in rule.values)}) THEN 'enum'"] if rule.values else []
        cases += [f"WHEN CAST({own} AS DOUBLE) NOT BETWEEN {rule.low} AND {rule.high} THEN 'range'"] if rule.low is not None else []
        cases += [f"WHEN json_array_length({own}) < {rule.min_items} THEN 'items'"] if rule.min_items else []
        return f"CASE {' '.join(cases)} END"

    if "[]" not in rule.path:
        kind = first("j", rule.path)
    else:
        head, _, tail = rule.path.partition("[]")
        items = f"CASE WHEN json_type(j, '$.{head}') = 'ARRAY' THEN CAST(json_extract(j, '$.{head}') AS JSON[]) END"
        kind = f"list_filter(list_transform({items}, lambda x: {first('x', tail.lstrip('.'))}), lambda k: k IS NOT NULL)[1]"
    return f"'{rule.path}: ' || ({kind})"


@query("doc_validate", f"""WITH cases(n, t) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_DOCUMENTS))}),
checked AS (SELECT n, CASE WHEN json_type(j) = 'OBJECT' THEN list_filter([{", ".join(_rule_sql(r) for r in documents.RULES)}], lambda v: v IS NOT NULL) ELSE ['json'] END AS found
  FROM (SELECT n, TRY_CAST(t AS JSON) AS j FROM cases))
SELECT event_id, array_to_string(found, ';') AS violations, len(found) = 0 AS valid FROM events JOIN checked ON n = event_id % {len(_DOCUMENTS)}""")
def doc_validate(spark, d):
    """Documents of every kind in turn: each rule is broken in each way it can be. The numbers are dealt into tasks of about 20,000
    rows first: a file's few splits would be too few tasks for checks that take a fifth of a millisecond a row."""
    texts = F.array(*[F.lit(t) for t in _DOCUMENTS])
    ids = table(spark, d, "events").select("event_id")
    ids = ids.repartition(max(spark.sparkContext.defaultParallelism, -(-ids.count() // 20_000)))
    df = ids.select("event_id", F.get(texts, (F.col("event_id") % len(_DOCUMENTS)).cast("int")).alias("json"))
    return documents.validate(df).select("event_id", F.array_join("violations", ";").alias("violations"), "valid")


def _information_sql(label: str, columns=COLUMNS) -> str:
    """The estimator over all rows one by one: neighbours by rank in the label's order, rows nearer by a window of values."""
    far = "CAST(4e18 AS BIGINT)"
    back, ahead = ([f"coalesce(abs(u - {f}(u, {i}) OVER w), {far})" for i in (1, 2, 3)] for f in ("lag", "lead"))
    radius = f"least({back[2]}, greatest({back[1]}, {ahead[0]}), greatest({back[0]}, {ahead[1]}), {ahead[2]})"
    return f"""WITH {ad.FLOWS}, cells AS (SELECT {label} AS y, unnest([{", ".join(f"'{c}'" for c in columns)}]) AS "column", unnest([{", ".join(f"CAST({c} AS DOUBLE)" for c in columns)}]) AS v FROM flows),
placed AS (SELECT "column", y, CAST(round(v * 1000000.0) AS BIGINT) AS u FROM cells WHERE v IS NOT NULL),
near AS (SELECT *, {radius} AS radius, count(*) OVER (PARTITION BY "column", y) AS ny FROM placed WINDOW w AS (PARTITION BY "column", y ORDER BY u)),
counted AS (SELECT *, count(*) OVER (PARTITION BY "column" ORDER BY u RANGE BETWEEN greatest(radius, 1) - 1 PRECEDING AND greatest(radius, 1) - 1 FOLLOWING) AS m FROM near),
found AS (SELECT "column", greatest(0.0, {information.digamma_sql("count(*)")} + avg({information.digamma_sql("3")} - {information.digamma_sql("ny")} - {information.digamma_sql("m")})) AS mi FROM counted GROUP BY 1)"""


query("mi_topk", f"""{_information_sql("label")} SELECT "column", round(mi, 8) AS mi FROM found ORDER BY mi DESC, "column" LIMIT 3""")(
    lambda spark, d: information.mutual_information(ad.flows(spark, d), COLUMNS, "label").select("column", F.round("mi", 8).alias("mi")).orderBy(F.desc("mi"), "column").limit(3))
query("mi_neighbours", f"""{_information_sql("CAST(floor(quantity / 10) AS INTEGER)", ("quantity", "price"))} SELECT "column", round(mi, 8) AS mi FROM found""")(
    lambda spark, d: information.mutual_information(ad.flows(spark, d).withColumn("band", F.floor(F.col("quantity") / 10).cast("int")), ("quantity", "price"), "band").select("column", F.round("mi", 8).alias("mi")))
query("smote")(lambda spark, d: learning.smote(ad.flows(spark, d), COLUMNS, "label").groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in COLUMNS]))


def _split_flows(spark, d):
    """All flows with `held_out`: a third, by a hash of the key."""
    return ad.flows(spark, d).withColumn("held_out", F.crc32(F.concat_ws(":", "l_orderkey", "l_linenumber").cast("binary")) % 3 == 1)


def _trained(spark, d, kind, **params):
    """A model of the flows that are not held out, and all flows."""
    f = _split_flows(spark, d)
    return learning.train_classifier(f.filter("NOT held_out"), kind, COLUMNS, **params), f


def _model(kind, **params):
    def run(spark, d):
        fitted, f = _trained(spark, d, kind, **params)
        return learning.probabilities(fitted, f).select("l_orderkey", "l_linenumber", "label", "held_out", "score", "predicted")

    return run


@query("hist_boosting")
def hist_boosting(spark, d):
    """Histogram boosting with row and column sampling on two thirds of the flows; all are scored."""
    f = _split_flows(spark, d)
    model = boosting.fit(f.filter("NOT held_out"), COLUMNS, "label", ("l_orderkey", "l_linenumber"), rounds=10, depth=4)
    return boosting.predict(f, model).select("l_orderkey", "l_linenumber", "label", "held_out", "score", "predicted")


@query("tree_contributions")
def tree_contributions(spark, d):
    """What each column adds to the margin of boosted trees, for every flow."""
    fitted, f = _trained(spark, d, "boosted_trees", maxIter=10, maxDepth=4)
    found = attributions.explain(fitted, f)
    return found.select("l_orderkey", "l_linenumber", "base", *[F.col("contributions")[i].alias(c) for i, c in enumerate(COLUMNS)])


@query("top_contributions")
def top_contributions(spark, d):
    """Mean absolute contribution of each column to the probability of a forest."""
    fitted, f = _trained(spark, d, "random_forest", numTrees=20, maxDepth=6)
    return attributions.mean_contributions(attributions.explain(fitted, f.filter("held_out")), COLUMNS).orderBy(F.desc("mean_abs"), "feature").limit(10)


def model_search(spark, d):
    """Parameters and cross-validated F1 of a small random search."""
    _, scores = learning.search(ad.flows(spark, d), "logistic", COLUMNS, n_iter=2, folds=3)
    return spark.createDataFrame([(str(sorted(p.items())), float(f1)) for p, f1 in scores], "parameters string, f1 double")


query("cv_metrics")(lambda spark, d: learning.cross_validate(ad.flows(spark, d), "logistic", COLUMNS, folds=3, regParam=0.001))
query("fold_counts", f"WITH {ad.FLOWS}, n AS (SELECT label, count(*) AS n FROM flows GROUP BY 1) SELECT label, CAST(fold AS INTEGER) AS fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS rows FROM n, (SELECT unnest(range(5)) AS fold)")(
    lambda spark, d: learning.stratified_folds(ad.flows(spark, d), "label", 5).groupBy("label", "fold").agg(F.count("*").alias("rows")))


def perm_importance(spark, d):
    fitted, f = _trained(spark, d, "logistic")
    return learning.permutation_importance(fitted, f.filter("held_out"), COLUMNS, ("l_orderkey", "l_linenumber"))


query("model_search")(model_search)
query("perm_importance")(perm_importance)
query("hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 500")(
    lambda spark, d: exploration.hash_sample(table(spark, d, "orders"), "o_orderkey", 500).select("o_orderkey", "o_totalprice"))
query("m_retention", f"""WITH {ad.SCORED}, c AS (SELECT count_if(score >= 0.5) AS total, count_if(score >= 0.7) AS still FROM scored)
SELECT total, still, round(still * 100.0 / total, 6) AS retained, CASE WHEN still * 100.0 / total >= 80 THEN 'ROBUST' WHEN still * 100.0 / total >= 50 THEN 'MODERATE' ELSE 'VULNERABLE' END AS tier FROM c""")(
    lambda spark, d: ad.scored(spark, d).agg(*metrics.retention(F.col("score") >= 0.5, F.col("score") >= 0.7)).withColumn("retained", F.round(F.col("retained").cast("double"), 6)))
query("m_pr_curve", f"WITH {_STEPS} SELECT round(score, 9) AS score, round(cp / (cp + cn), 9) AS precision, round(cp / (SELECT sum(pos) FROM c), 9) AS recall FROM c")(
    lambda spark, d: metrics.pr_curve(ad.scored(spark, d), "y", "score").withColumns({c: F.round(c, 9) for c in ("score", "precision", "recall")}))
query("coerce_numbers", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN 'n/a' WHEN 3 THEN 'inf' ELSE '17' END AS raw,
  CASE event_id % 5 WHEN 1 THEN value WHEN 4 THEN 17.0 END AS number FROM events""")(
    lambda spark, d: learning.finite(_raw_numbers(spark, d).withColumn("number", learning.to_number(F.col("raw"))), ["number"]))
query("rf")(_model("random_forest", numTrees=20, maxDepth=6))
query("gbt")(_model("boosted_trees", maxIter=10, maxDepth=4))
query("lr")(_model("logistic", regParam=0.001))


@query("iforest_fit_score")
def iforest_fit_score(spark, d):
    return isolation.fit_predict(ad.flows(spark, d), COLUMNS, trees=50)[1].select("l_orderkey", "l_linenumber", "anomaly_score", "is_anomaly")


def _raw_numbers(spark, d):
    n = F.col("event_id") % 5
    return table(spark, d, "events").select("event_id", F.when(n == 1, F.col("value").cast("string")).when(n == 2, "n/a").when(n == 3, "inf").when(n == 4, "17").alias("raw"))


def _attacks(changes):
    """One row for each attack on the true anomalies that were found: total, still found, retained and tier."""

    def run(spark, d):
        f = ad.flows(spark, d)
        forest, scale = isolation.fit(f, COLUMNS, trees=50), learning.fit_scale(f, COLUMNS)
        base = isolation.evasion_base(isolation.predict(f, forest), "label")
        out = None
        for name, change in changes.items():
            after = isolation.predict(change(base, scale), forest)
            row = after.agg(*metrics.retention(F.lit(True), F.col("is_anomaly") == 1)).withColumn("attack", F.lit(name))
            out = row if out is None else out.unionByName(row)
        return out

    return run


query("evasion_noise")(_attacks({f"noise {s:.2f}": lambda f, scale, s=s: isolation.noise_attack(f, COLUMNS, s, scale) for s in (0.05, 0.10, 0.20)}))
query("evasion_scale")(_attacks({f"scale {x:.1f}": lambda f, scale, x=x: isolation.scaling_attack(f, COLUMNS, x, scale) for x in (0.8, 0.9, 1.1, 1.2)}))


def iforest_tuning(spark, d):
    f = ad.flows(spark, d)
    return isolation.tune(f, isolation.fit(f, COLUMNS, trees=50), "label", [float(x) for x in np.round(np.arange(-0.1, 0.11, 0.05), 2)])


query("iforest_tuning")(iforest_tuning)

"""Queries on records that grow and are compared: balanced splits, nested reports, settings, reuse of results, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import metrics, nested, splits
from gradus.plans.adapters import COHORTS_SQL, EYES_SQL, cohorts, eyes, table
from gradus.plans.registry import query
from gradus.plans.shared import graded
from gradus.sources import stores
from gradus.streaming import history

_C = [f"c{g}" for g in range(5)]
_LIST = f"[{', '.join(_C)}]"
_COST = " + ".join(f"(2 * s[f * 5 + {g + 1}] * c{g} + c{g} * c{g})::DOUBLE / t{g}" for g in range(5))


@query(f"""WITH RECURSIVE {EYES_SQL}, g AS (SELECT patient_id, {", ".join(f"count(*) FILTER (diagnosis = {g}) AS c{g}" for g in range(5))} FROM eyes GROUP BY patient_id),
    h AS (SELECT {", ".join(_C)}, count(*) AS n FROM g GROUP BY ALL),
    t AS (SELECT {", ".join(f"coalesce(nullif(sum(c{g} * n)::DOUBLE * sum(c{g} * n)::DOUBLE, 0), 1) AS t{g}" for g in range(5))} FROM h),
    items AS (SELECT *, row_number() OVER (ORDER BY {" + ".join(_C)} DESC, {", ".join(f"{c} DESC" for c in _C)}, r) AS i
        FROM (SELECT {", ".join(_C)}, unnest(range(n % 5)) AS r FROM h)),
    walk AS (SELECT 0::BIGINT AS i, list_transform(range(25), lambda j: 0::BIGINT) AS s, 0::BIGINT AS best
        UNION ALL SELECT i, list_transform(range(25), lambda j: s[j + 1] + CASE WHEN j // 5 = best - 1 THEN {_LIST}[j % 5 + 1] ELSE 0 END), best FROM (
            SELECT items.i, s, {", ".join(_C)}, list_position(costs, list_min(costs))::BIGINT AS best FROM (
                SELECT items.i, s, {", ".join(f"items.{c}" for c in _C)}, list_transform(range(5), lambda f: {_COST}) AS costs
                FROM walk JOIN items ON items.i = walk.i + 1, t) AS items)),
    spare AS (SELECT {", ".join(_C)}, r, best FROM items JOIN walk USING (i)),
    placed AS (SELECT patient_id, {", ".join(f"g.{c}" for c in _C)}, n,
        row_number() OVER (PARTITION BY {", ".join(f"g.{c}" for c in _C)} ORDER BY CAST('0x' || substr(md5('42:' || patient_id), 1, 8) AS BIGINT), patient_id) - 1 AS p
        FROM g JOIN h USING ({", ".join(_C)})),
    dealt AS (SELECT placed.*, CASE WHEN p < n // 5 * 5 THEN p % 5 + 1 ELSE best END AS fold FROM placed LEFT JOIN spare ON {" AND ".join(f"placed.{c} = spare.{c}" for c in _C)} AND r = p - n // 5 * 5)
    SELECT CAST(fold AS INTEGER) AS fold, count(*) AS groups, CAST(sum({" + ".join(_C)}) AS BIGINT) AS eyes, {", ".join(f"CAST(sum(c{g}) AS BIGINT) AS grade_{g}" for g in range(5))}
    FROM dealt GROUP BY fold""")
def balanced_group_folds(spark, d):
    dealt = splits.balanced_group_folds(eyes(spark, d).drop("fold"), "patient_id", "diagnosis", 5)
    grades = [F.count_if(F.col("diagnosis") == g).alias(f"grade_{g}") for g in range(5)]
    return dealt.groupBy("fold").agg(F.count_distinct("patient_id").alias("groups"), F.count(F.lit(1)).alias("eyes"), *grades)


# ---------------------------------------------------------------- nested reports

_RATES = "'rates', json_object('sensitivity', {se}, 'specificity', sp)"
_HEAD, _CELLS, _GRADES = "'cohort', cohort, 'n', n", "'confusion', json_object('tp', tp, 'fp', fp, 'tn', tn, 'fn', fn)", "'grades', [g0, g1, g2, g3, g4]"
_SAME = _RATES.format(se="se")


def _tree_sql(name: str, document: str) -> str:
    return f"""{name} AS (SELECT cohort, fullkey AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
            WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
        CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(j.value AS DOUBLE) WHEN type = 'ARRAY' THEN json_array_length(j.value)::DOUBLE END AS number,
        CASE WHEN type IN ('VARCHAR', 'BOOLEAN') THEN j.value ->> '$' END AS text FROM (SELECT cohort, {document} AS doc FROM facts), json_tree(doc) AS j)"""


_FOUND = f"""CASE cohort WHEN 'AFRICA' THEN json_object({_HEAD}, {_CELLS}, {_GRADES}, {_RATES.format(se="se + 0.01::DOUBLE")})
    WHEN 'AMERICA' THEN json_object('cohort', cohort, 'n', CAST(n AS VARCHAR), {_CELLS}, {_GRADES}, {_SAME})
    WHEN 'ASIA' THEN json_object({_HEAD}, 'confusion', json_object('tp', tp, 'tn', tn, 'fn', fn), {_GRADES}, {_SAME})
    WHEN 'EUROPE' THEN json_object({_HEAD}, {_CELLS}, 'grades', [g0, g1, g2, g3, g4, n], {_SAME})
    ELSE json_object('cohort', lower(cohort), 'n', n, {_CELLS}, {_GRADES}, {_RATES.format(se="se * (1 + 1e-12::DOUBLE)")}) END"""


@query(f"""WITH {COHORTS_SQL}, facts AS (SELECT *, tp::DOUBLE / (tp + fn) AS se, tn::DOUBLE / (tn + fp) AS sp FROM (
        SELECT cohort, count(*) AS n, {", ".join(f"count(*) FILTER (diagnosis {a} 2 AND pred {b} 2) AS {c}" for c, a, b in (("tp", ">=", ">="), ("fp", "<", ">="), ("tn", "<", "<"), ("fn", ">=", "<")))},
            {", ".join(f"count(*) FILTER (diagnosis = {g}) AS g{g}" for g in range(5))} FROM cohorts GROUP BY cohort)),
    {_tree_sql("a", f"json_object({_HEAD}, {_CELLS}, {_GRADES}, {_SAME})")}, {_tree_sql("b", _FOUND)},
    sides AS (SELECT coalesce(a.cohort, b.cohort) AS cohort, coalesce(a.path, b.path) AS path, CASE WHEN b.kind IS NULL THEN 'missing' WHEN a.kind IS NULL THEN 'added'
            WHEN a.kind <> b.kind THEN 'kind' WHEN a.kind = 'array' AND a.number <> b.number THEN 'length'
            WHEN a.kind = 'number' AND abs(a.number - b.number) > 1e-8 + 1e-7 * abs(b.number) THEN 'number' WHEN a.text <> b.text THEN 'text' END AS change,
        a.number AS recorded, b.number AS found, a.text AS recorded_text, b.text AS found_text FROM a FULL JOIN b ON a.cohort = b.cohort AND a.path = b.path)
    SELECT * FROM sides WHERE change IS NOT NULL""")
def nested_report_audit(spark, d):
    """Reports of the cohorts beside versions in which a value, a kind, a key, a length and a text were changed; one change is within the tolerance."""
    cells = metrics.cells(graded(cohorts(spark, d)), "diagnosis", "pred", ["cohort"])
    facts = metrics.referable_confusion(cells, ["cohort"]).join(metrics.grade_counts(cells, ["cohort"]), "cohort")
    n = sum((F.col(f"true_{g}") for g in range(5)), F.lit(0))

    def report(name=None, n=n, fp=True, more=False, se=None) -> F.Column:
        counted = [c for c in ("tp", "fp", "tn", "fn") if fp or c != "fp"]
        grades = F.array(*[F.col(f"true_{g}") for g in range(5)], *([n] if more else []))
        rates = F.struct((F.col("sensitivity") if se is None else se).alias("sensitivity"), "specificity")
        return F.to_json(F.struct((F.col("cohort") if name is None else name).alias("cohort"), n.alias("n"), F.struct(*counted).alias("confusion"), grades.alias("grades"), rates.alias("rates")))

    c = F.col("cohort")
    changed = (
        F.when(c == "AFRICA", report(se=F.col("sensitivity") + 0.01)).when(c == "AMERICA", report(n=n.cast("string"))).when(c == "ASIA", report(fp=False))
        .when(c == "EUROPE", report(more=True)).otherwise(report(name=F.lower("cohort"), se=F.col("sensitivity") * F.lit(1 + 1e-12)))
    )
    return nested.compare_reports(facts.select("cohort", report().alias("doc")), facts.select("cohort", changed.alias("doc")), "cohort", "doc")


# ---------------------------------------------------------------- settings of two runs

_SETTINGS = """s AS (SELECT o_custkey AS customer, o_orderkey AS k, x.setting, x.value FROM orders, (SELECT unnest([
        {'setting': 'status', 'value': o_orderstatus}, {'setting': 'priority', 'value': o_orderpriority}, {'setting': 'run.id', 'value': CAST(o_orderkey AS VARCHAR)},
        {'setting': CASE WHEN o_orderkey % 3 <> 0 THEN 'band' END, 'value': CASE WHEN o_totalprice > 150000 THEN 'high' END}]) AS x) WHERE x.setting IS NOT NULL),
    ends AS (SELECT o_custkey AS customer, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY o_custkey),
    l AS (SELECT s.* FROM s JOIN ends ON ends.customer = s.customer AND k = first), r AS (SELECT s.* FROM s JOIN ends ON ends.customer = s.customer AND k = last)"""


@query(f"""WITH {_SETTINGS}, z AS (SELECT coalesce(l.customer, r.customer) AS customer, coalesce(l.setting, r.setting) AS setting, l.value AS "left", r.value AS "right",
        CASE WHEN l.setting IS NULL THEN 'only_right' WHEN r.setting IS NULL THEN 'only_left' WHEN l.value IS DISTINCT FROM r.value THEN 'differs' END AS problem
        FROM l FULL JOIN r ON l.customer = r.customer AND l.setting = r.setting)
    SELECT * FROM z WHERE problem IS NOT NULL AND NOT starts_with(setting, 'run.')
    UNION ALL SELECT customer, 'band', NULL, NULL, 'absent' FROM ends WHERE NOT EXISTS (FROM z WHERE z.customer = ends.customer AND z.setting = 'band')""")
def settings_contract(spark, d):
    """Each customer's first order's settings against the last one's."""
    k = F.col("o_orderkey")
    base = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("run.id"), k.cast("string"))
    band = F.create_map(F.lit("band"), F.when(F.col("o_totalprice") > 150000, "high"))
    orders = table(spark, d, "orders").withColumn("settings", F.when(k % 3 != 0, F.map_concat(base, band)).otherwise(base))
    runs = orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.min_by("settings", "o_orderkey").alias("l"), F.max_by("settings", "o_orderkey").alias("r"))
    return nested.compare_settings(runs, "customer", "l", "r", ignored=["run."], required=["band", "status"])


# ---------------------------------------------------------------- reuse and histories


def _blanks(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("blanks"), F.length("text").cast("long").alias("chars"))


@query("""WITH now AS (SELECT doc_id, text AS old, CASE WHEN doc_id % 10 = 1 THEN text || ' !' ELSE text END AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    more AS (SELECT -1 - item_id AS doc_id, NULL AS old, text FROM benchmark)
    SELECT doc_id, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS blanks, CAST(length(text) AS BIGINT) AS chars, old IS NOT DISTINCT FROM text AS reused
    FROM (FROM now UNION ALL FROM more)""")
def incremental_reuse(spark, d):
    """Results over all documents, refreshed for a later state in which some went, some changed and others came; equal to computing all of them anew."""
    path = stores.shared_folder(spark, "reuse")
    rows = table(spark, d, "documents").select("doc_id", "text")
    stores.refresh(rows, path, "doc_id", {"measure": "blanks"}, _blanks)
    touched = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" !"))).otherwise(F.col("text"))
    now = rows.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", touched.alias("text"))
    more = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), "text")
    return stores.refresh(now.unionByName(more), path, "doc_id", {"measure": "blanks"}, _blanks).results


@query("""WITH w AS (SELECT event_type AS run, 'user_' || user_id % 7 AS metric, event_id % 50 AS step, value, ts, event_id,
        row_number() OVER (PARTITION BY event_type, user_id % 7, event_id % 50 ORDER BY ts DESC, event_id DESC) AS back FROM events)
    SELECT run, metric, CAST(step AS BIGINT) AS step, value, event_id FROM w WHERE back = 1""")
def metric_history(spark, d):
    """The stream of events as a history by step: taken in as batches, then once more from where the checkpoint stands."""
    path = stores.shared_folder(spark, "history")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")  # a single file is no folder to watch, a pattern is
    stream = events.select(
        F.col("event_type").alias("run"), F.concat(F.lit("user_"), (F.col("user_id") % 7).cast("string")).alias("metric"), (F.col("event_id") % 50).alias("step"), "value", "ts", "event_id"
    )
    for _ in range(2):
        history.log_metrics(stream, f"{path}/store", f"{path}/checkpoint", ["ts", "event_id"])
    return history.metric_history(spark, f"{path}/store", ["ts", "event_id"]).drop("ts")

"""Registered queries of the corpus engine, and their SQL twins.

Computed doubles are rounded to ``DIGITS`` places on both sides: sums of doubles
depend on their order in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonospan.functions import columns as fn
from sonospan.functions import frames
from sonospan.operators import agreement, campaign, intervals, matching, refdist
from sonospan.plans import expr, rules
from sonospan.plans import projections as view

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, recursive: bool = False):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{view.SQL.strip()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(n), DIGITS) + 0.0).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def run(body: dict, spark: SparkSession, sf_dir: str, bucket: float | None = 86_400.0) -> DataFrame:
    return rules.evaluate(rules.Rule.from_json(body), view.tiers(spark, sf_dir), view.signal(spark, sf_dir), bucket)


PHONES = {"tier": "phones"}


@register("""+ f AS (SELECT bundle_id, avg(v) AS m FROM p GROUP BY 1),
r AS (SELECT i.bundle_id, i.id, any_value(i.s) AS s, any_value(i.e) AS e, any_value(i.label) AS label, avg(p.v) AS m FROM iv i JOIN p ON p.bundle_id = i.bundle_id AND p.t BETWEEN i.s AND i.e GROUP BY 1, 2)
SELECT r.bundle_id, r.id, s + 0.5 * (e - s) AS "start", s + 0.5 * (e - s) AS "end", label FROM r JOIN f USING (bundle_id) WHERE r.m > 1.2 * f.m""")
def criterion_where_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run({"select": PHONES, "where": "mean(x) > 1.2 * mean(x, file)", "emit": {"kind": "point", "at": 0.5}}, spark, sf_dir)


@register("""SELECT bundle_id, id, s AS "start", e AS "end", label FROM iv i WHERE label IN ('click', 'purchase')
AND EXISTS (SELECT 1 FROM wd w WHERE w.bundle_id = i.bundle_id AND w.label = 'view' AND i.s >= w.s - 1e-9 AND i.e <= w.e + 1e-9)""")
def criterion_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run({"select": {"tier": "phones", "label_any": ["click", "purchase"]}, "within": {"tier": "words", "label_any": ["view"]}, "emit": {"kind": "span"}}, spark, sf_dir)


@register("""SELECT bundle_id, id, s + 0.25 * (e - s) AS "start", s + 0.75 * (e - s) AS "end", 'hit' AS label FROM wd i WHERE regexp_matches(label, 'c')
AND EXISTS (SELECT 1 FROM iv w WHERE w.bundle_id = i.bundle_id AND w.label = 'error' AND w.s < i.e AND i.s < w.e)
AND s + 0.75 * (e - s) > s + 0.25 * (e - s) + 1e-9""")
def criterion_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run({"select": {"tier": "words", "label_regex": "c"}, "overlaps": {"tier": "phones", "label_any": ["error"]}, "emit": {"kind": "span", "from": 0.25, "to": 0.75}, "label": "hit"}, spark, sf_dir, 86_400.0)


@register("""+ r AS (SELECT i.bundle_id, i.id, any_value(i.label) AS label, arg_max(p.t, (p.v, -p.t)) AS top, max(p.v) AS hi, min(p.v) AS lo FROM wd i JOIN p ON p.bundle_id = i.bundle_id AND p.t BETWEEN i.s AND i.e GROUP BY 1, 2)
SELECT bundle_id, id, top AS "start", top AS "end", label FROM r WHERE hi - lo >= 10""")
def criterion_argmax_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run({"select": {"tier": "words"}, "where": "range(x) >= 10", "emit": {"kind": "point_expr", "at": "argmax(x)"}}, spark, sf_dir)


@register("""+ j AS (SELECT i.bundle_id, i.id, i.label, p.t, p.v, lead(p.t) OVER w AS t1, lead(p.v) OVER w AS v1 FROM wd i JOIN p ON p.bundle_id = i.bundle_id AND p.t BETWEEN i.s AND i.e WINDOW w AS (PARTITION BY i.bundle_id, i.id ORDER BY p.t, p.v))
SELECT bundle_id, id, min(t + (20 - v) / (v1 - v) * (t1 - t)) AS "start", min(t + (20 - v) / (v1 - v) * (t1 - t)) AS "end", any_value(label) AS label FROM j WHERE v < 20 AND v1 >= 20 GROUP BY 1, 2""")
def criterion_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run({"select": {"tier": "words"}, "emit": {"kind": "point_expr", "at": "first_crossing(x, 20, rising)"}}, spark, sf_dir)


@register("""SELECT bundle_id, id, s + 0.02 AS "start", s + 0.3 * (e - s) + (e - s) / 2 AS "end", label FROM iv WHERE NOT (e - s < 60) AND s + 0.3 * (e - s) + (e - s) / 2 > s + 0.02 + 1e-9""")
def criterion_span_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run({"select": PHONES, "where": "not (duration < 60)", "emit": {"kind": "span_expr", "from": "start + 20ms", "to": "start + 30% + duration / 2"}}, spark, sf_dir)


def reducers(scope: str) -> list[expr.Reduction]:
    return [expr.Reduction(f, "x", scope) for f in ("mean", "max", "min", "median", "std", "range", "argmax", "argmin")]


REDUCED = "round(avg(v), 6) AS mean, max(v) AS max, min(v) AS min, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(max(v) - min(v), 6) AS range, round(arg_max(t, (v, -t)), 6) AS argmax, round(arg_min(t, (v, t)), 6) AS argmin"


@register(f"SELECT i.bundle_id, i.id, {REDUCED.replace('(v', '(p.v').replace('(t', '(p.t').replace('-t', '-p.t').replace(', t)', ', p.t)')} FROM wd i JOIN p ON p.bundle_id = i.bundle_id AND p.t BETWEEN i.s AND i.e GROUP BY 1, 2")
def signal_reducers_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = view.tiers(spark, sf_dir).filter("tier = 'words'").select("bundle_id", "id", "start", "end")
    wanted = reducers("interval")
    made = rules.reduced(words, view.signal(spark, sf_dir), wanted)
    return rounded(made.select("bundle_id", "id", *[F.col(f"_r{i}").alias(r.func) for i, r in enumerate(wanted)]))


@register(f"SELECT bundle_id, {REDUCED} FROM p GROUP BY 1")
def signal_reducers_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = reducers("file")
    made = view.signal(spark, sf_dir).groupBy("bundle_id").agg(*[rules.aggregate(r, r.func) for r in wanted])
    return rounded(made)


KAPPA = """j AS (SELECT {keys} a, b, count(*) AS n FROM u GROUP BY ALL),
tot AS (SELECT {keys} sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM j GROUP BY ALL),
ch AS (SELECT {keys} sum(x.n * y.n) AS chance FROM (SELECT {keys} a AS l, sum(n) AS n FROM j GROUP BY ALL) x JOIN (SELECT {keys} b AS l, sum(n) AS n FROM j GROUP BY ALL) y USING ({keys} l) GROUP BY ALL),
k AS (SELECT {keys} tot.n::BIGINT AS n, same / tot.n AS po, coalesce(chance, 0) / (tot.n * tot.n) AS pe FROM tot {join})
SELECT {keys} n, round(po, 6) AS percent_agreement, round(CASE WHEN abs(1 - pe) < 1e-12 THEN CASE WHEN abs(1 - po) < 1e-12 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k"""


@register("+ u AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels), " + KAPPA.format(keys="", join=", ch"))
def kappa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view.table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("a"), F.col("toxic").cast("string").alias("b"))
    return rounded(agreement.cohen_kappa(pairs, []))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two annotators: the phones, and the phones with their ends moved and every seventh label changed."""
    a = view.intervals(spark, sf_dir).select("bundle_id", "id", "start", "end", "label")
    b = a.withColumns({"end": F.col("end") + 1.0, "label": F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("label"))})
    return a, b


@register("""+ d AS (SELECT bundle_id, unnest([0.0, (id % 5) / 100.0]) AS d FROM iv)
SELECT bundle_id, round(avg(abs(d)), 6) AS mean_abs_diff, round(avg((abs(d) <= 0.02)::INT), 6) AS within_tolerance FROM d GROUP BY 1""")
def boundary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    iv = view.intervals(spark, sf_dir)
    d = iv.select("bundle_id", F.explode(F.array(F.lit(0.0), (F.col("id") % 5) / 100)).alias("d"))
    return rounded(agreement.deviations(d, ["bundle_id"], "d", 0.02))


FRAME_STEP = 21_600.0


@register("""+ b AS (SELECT bundle_id, id, s, e + 1 AS e, CASE WHEN id % 7 = 0 THEN 'other' ELSE label END AS label FROM iv),
x AS (SELECT bundle_id, max(e) AS extent FROM b GROUP BY 1), g AS (SELECT bundle_id, k, (k + 0.5) * 21600 AS t FROM (SELECT bundle_id, unnest(range(0, ceil(extent / 21600)::BIGINT)) AS k FROM x)),
la AS (SELECT g.bundle_id, g.k, coalesce(arg_min(i.label, (i.s, i.id)), '∅') AS a FROM g LEFT JOIN iv i ON i.bundle_id = g.bundle_id AND i.s <= g.t AND g.t < i.e GROUP BY 1, 2),
lb AS (SELECT g.bundle_id, g.k, coalesce(arg_min(i.label, (i.s, i.id)), '∅') AS b FROM g LEFT JOIN b i ON i.bundle_id = g.bundle_id AND i.s <= g.t AND g.t < i.e GROUP BY 1, 2),
u AS (SELECT bundle_id, a, b FROM la JOIN lb USING (bundle_id, k)), """ + KAPPA.format(keys="bundle_id,", join="LEFT JOIN ch USING (bundle_id)"))
def frame_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.frame_agreement(*sides(spark, sf_dir), FRAME_STEP))


SECOND = "b AS (SELECT bundle_id, id, s, e + 1 AS e, CASE WHEN id % 7 = 0 THEN 'other' ELSE label END AS label FROM iv)"


def greedy_sql(order: str) -> str:
    """A greedy matching of the pairs ``c`` in rounds: what is the best of both its sides is taken, and the free pairs go on."""
    ranks = ", ".join(f"row_number() OVER (PARTITION BY bundle_id, {side} ORDER BY {order}) AS r{side}" for side in ("a_id", "b_id"))
    gone = ", ".join(f"bool_or(ra_id = 1 AND rb_id = 1) OVER (PARTITION BY bundle_id, {side}) AS g{side}" for side in ("a_id", "b_id"))
    return f"""r AS (SELECT *, {ranks} FROM c
UNION ALL SELECT * EXCLUDE (ga_id, gb_id), {ranks} FROM (SELECT * EXCLUDE (ra_id, rb_id), {gone} FROM r) WHERE NOT ga_id AND NOT gb_id),
m AS (SELECT * EXCLUDE (ra_id, rb_id) FROM r WHERE ra_id = 1 AND rb_id = 1)"""


MATCHED = SECOND + """, c AS (SELECT x.bundle_id, x.id AS a_id, x.s AS a_start, x.e AS a_end, x.label AS a_label, y.id AS b_id, y.s AS b_start, y.e AS b_end, y.label AS b_label, least(x.e, y.e) - greatest(x.s, y.s) AS overlap
FROM iv x JOIN b y ON x.bundle_id = y.bundle_id AND x.s < y.e AND y.s < x.e), """ + greedy_sql("overlap DESC, a_start, a_id, b_start, b_id")


@register("+ " + MATCHED + " SELECT bundle_id, a_id, round(a_start, 6) AS a_start, round(a_end, 6) AS a_end, a_label, b_id, round(b_start, 6) AS b_start, round(b_end, 6) AS b_end, b_label, round(overlap, 6) AS overlap FROM m", recursive=True)
def interval_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.match_intervals(*sides(spark, sf_dir)))


def kappa_sql(name: str, source: str, n: str, po: str, kappa: str) -> str:
    """A table ``name`` of kappa by bundle over the labels (a, b) of ``source``."""
    return f"""{name}j AS (SELECT bundle_id, a, b, count(*) AS n FROM {source} GROUP BY ALL), {name}t AS (SELECT bundle_id, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM {name}j GROUP BY ALL),
{name}c AS (SELECT bundle_id, sum(x.n * y.n) AS chance FROM (SELECT bundle_id, a AS l, sum(n) AS n FROM {name}j GROUP BY ALL) x JOIN (SELECT bundle_id, b AS l, sum(n) AS n FROM {name}j GROUP BY ALL) y USING (bundle_id, l) GROUP BY ALL),
{name}k AS (SELECT bundle_id, t.n::BIGINT AS n, same / t.n AS po, coalesce(chance, 0) / (t.n * t.n) AS pe FROM {name}t t LEFT JOIN {name}c USING (bundle_id)),
{name} AS (SELECT bundle_id, n AS {n}, round(po, 6) AS {po}, round(CASE WHEN abs(1 - pe) < 1e-12 THEN CASE WHEN abs(1 - po) < 1e-12 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 6) AS {kappa} FROM {name}k)"""


FRAMES_SQL = """x AS (SELECT bundle_id, max(e) AS extent FROM b GROUP BY 1), g AS (SELECT bundle_id, k, (k + 0.5) * 21600 AS t FROM (SELECT bundle_id, unnest(range(0, ceil(extent / 21600)::BIGINT)) AS k FROM x)),
la AS (SELECT g.bundle_id, g.k, coalesce(arg_min(i.label, (i.s, i.id)), '∅') AS a FROM g LEFT JOIN iv i ON i.bundle_id = g.bundle_id AND i.s <= g.t AND g.t < i.e GROUP BY 1, 2),
lb AS (SELECT g.bundle_id, g.k, coalesce(arg_min(i.label, (i.s, i.id)), '∅') AS b FROM g LEFT JOIN b i ON i.bundle_id = g.bundle_id AND i.s <= g.t AND g.t < i.e GROUP BY 1, 2),
fu AS (SELECT bundle_id, a, b FROM la JOIN lb USING (bundle_id, k))"""
REPORTED = f"""mu AS (SELECT bundle_id, a_label AS a, b_label AS b FROM m), {kappa_sql('mk', 'mu', 'n_matched', 'percent_label_agreement', 'cohen_kappa')},
d AS (SELECT bundle_id, round(avg(abs(d)), 6) AS mean_abs_diff, round(avg((abs(d) <= 0.02)::INT), 6) AS within_tolerance FROM (SELECT bundle_id, unnest([{{deviation}}]) AS d FROM m) GROUP BY 1)"""


@register("+ " + MATCHED + ", " + REPORTED.format(deviation="a_start - b_start, a_end - b_end") + ", " + FRAMES_SQL + ", " + kappa_sql("fk", "fu", "frames", "frame_percent_agreement", "frame_kappa") + """,
n AS (SELECT bundle_id, count(*) AS n_a FROM iv GROUP BY 1)
SELECT bundle_id, n_a, n_a AS n_b, n_matched, percent_label_agreement, cohen_kappa, mean_abs_diff, within_tolerance, frame_percent_agreement, frame_kappa, n_a - n_matched AS n_only_a, n_a - n_matched AS n_only_b
FROM n JOIN mk USING (bundle_id) JOIN d USING (bundle_id) JOIN fk USING (bundle_id)""", recursive=True)
def interval_agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.compare_intervals(*sides(spark, sf_dir), 0.02, FRAME_STEP))


MATCHED_POINTS = """c AS (SELECT x.bundle_id, x.id AS a_id, y.id AS b_id, x.t AS a_t, y.t AS b_t, x.label AS a_label, y.label AS b_label FROM p x JOIN p y ON x.bundle_id = y.bundle_id AND x.id % 2 = 0 AND y.id % 2 = 1), """ + greedy_sql("abs(a_t - b_t), a_t, a_id, b_t, b_id")


@register("+ " + MATCHED_POINTS + " SELECT bundle_id, a_id, b_id, round(a_t, 6) AS a_t, round(b_t, 6) AS b_t, a_label, b_label FROM m", recursive=True)
def point_match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view.points(spark, sf_dir)
    return rounded(matching.match_points(p.filter("id % 2 = 0"), p.filter("id % 2 = 1")))


@register("+ " + MATCHED_POINTS + ", " + REPORTED.format(deviation="a_t - b_t") + """,
na AS (SELECT bundle_id, count(*) AS n_a FROM p WHERE id % 2 = 0 GROUP BY 1), nb AS (SELECT bundle_id, count(*) AS n_b FROM p WHERE id % 2 = 1 GROUP BY 1)
SELECT bundle_id, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_matched, 0) AS n_matched, coalesce(percent_label_agreement, 0) AS percent_label_agreement, coalesce(cohen_kappa, 0) AS cohen_kappa,
coalesce(mean_abs_diff, 0) AS mean_abs_diff, coalesce(within_tolerance, 0) AS within_tolerance, coalesce(n_a, 0) - coalesce(n_matched, 0) AS n_only_a, coalesce(n_b, 0) - coalesce(n_matched, 0) AS n_only_b
FROM na FULL JOIN nb USING (bundle_id) LEFT JOIN mk USING (bundle_id) LEFT JOIN d USING (bundle_id)""", recursive=True)
def point_agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of two point tiers whose times differ."""
    p = view.points(spark, sf_dir)
    return rounded(agreement.compare_points(p.filter("id % 2 = 0"), p.filter("id % 2 = 1")))


@register("""+ q AS (SELECT bundle_id, count(*) AS n, count(*) FILTER (label NOT IN ('A', 'N')) AS out_of_vocab, count(*) FILTER (coalesce(label, '') = '') AS missing_label FROM sh GROUP BY 1),
o AS (SELECT a.bundle_id, count(*) AS k FROM sh a JOIN sh b ON a.bundle_id = b.bundle_id AND a.r < b.r AND least(a.e, b.e) - greatest(a.s, b.s) > 1e-9 GROUP BY 1)
SELECT q.*, coalesce(k, 0)::BIGINT AS n_overlaps FROM q LEFT JOIN o USING (bundle_id)""")
def tier_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.tier_qa(view.shipments(spark, sf_dir), ["A", "N"], ["bundle_id"])


@register("""+ old AS (SELECT DISTINCT source AS tier, lang AS value FROM documents WHERE doc_id % 3 <> 0 AND lang <> 'de'), new AS (SELECT DISTINCT source AS tier, lang AS value FROM documents WHERE lang <> 'es'),
g AS (SELECT coalesce(o.tier, n.tier) AS tier, o.value AS o, n.value AS n FROM old o FULL JOIN new n ON o.tier = n.tier AND o.value = n.value),
r AS (SELECT tier, list_sort(list(n) FILTER (o IS NULL)) AS added, list_sort(list(o) FILTER (n IS NULL)) AS removed FROM g GROUP BY 1)
SELECT tier, array_to_string(coalesce(added, []), ',') AS added, array_to_string(coalesce(removed, []), ',') AS removed, (SELECT count(*) FROM documents d WHERE d.source = r.tier AND list_contains(coalesce(r.removed, []), d.lang)) AS affected FROM r WHERE len(coalesce(added, [])) + len(coalesce(removed, [])) > 0""")
def rubric_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tier"), F.col("lang").alias("label"))
    old = docs.filter("doc_id % 3 <> 0 and label <> 'de'").select("tier", F.col("label").alias("value"))
    new = docs.filter("label <> 'es'").select("tier", F.col("label").alias("value"))
    return campaign.rubric_impact(old, new, docs).withColumns({c: F.array_join(F.array_sort(c), ",") for c in ("added", "removed")})


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1992-01-01 00:00:00', o_orderdate)").cast("double")
    return view.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bundle_id"), F.col("o_orderkey").alias("id"), start.alias("start"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("annotator"))


STATUSES = ["F", "O", "P"]


@register("SELECT o_custkey AS bundle_id, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P, count(*) AS total FROM orders GROUP BY 1")
def target_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.progress(targets(spark, sf_dir), STATUSES, ["bundle_id"])


@register("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P, count(*) AS total FROM orders")
def project_target_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.progress(targets(spark, sf_dir), STATUSES)


@register("SELECT o_orderpriority AS annotator, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P, count(*) AS total FROM orders GROUP BY 1")
def assignment_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.progress(targets(spark, sf_dir), STATUSES, ["annotator"])


@register("""+ t AS (SELECT o_custkey AS bundle_id, date_diff('second', TIMESTAMP '1992-01-01', o_orderdate)::DOUBLE AS "start", o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS annotator FROM orders WHERE o_orderstatus IN ('O', 'P'))
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY "start", id) AS k FROM t) WHERE k = 1""")
def next_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaign.next_target(targets(spark, sf_dir), ["O", "P"])


@register()
def assign_targets_randomly(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_targets = targets(spark, sf_dir).withColumn("status", F.when(F.col("status") == "O", "unassigned").otherwise("done"))
    return campaign.assign_randomly(open_targets, ["ann", "bob", "cem"], 42)


SUMMARY = "count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, min(v) AS min, " + ", ".join(f"round(quantile_cont(v, {q}), 6) AS {k}" for k, q in refdist.QUANTILES.items()) + ", max(v) AS max"


@register(f"SELECT l_returnflag AS flag, l_linestatus AS status, {SUMMARY} FROM (SELECT *, l_quantity AS v FROM lineitem) GROUP BY 1, 2")
def refdist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = view.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return rounded(refdist.summary(data, "l_quantity", ["flag", "status"]))


@register(f"SELECT {SUMMARY} FROM (SELECT value AS v FROM events WHERE lower(event_type) = 'click')")
def refdist_filtered_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(refdist.summary(refdist.filtered(view.table(spark, sf_dir, "events"), {"event_type": "CLICK"}), "value"))


@register("""+ m AS (SELECT l_returnflag AS flag, avg(l_quantity) FILTER (l_linestatus = 'O') AS mean, coalesce(avg(l_quantity) FILTER (l_linestatus = 'F'), 0) AS sd FROM lineitem GROUP BY 1)
SELECT flag, 16::BIGINT AS n, round(mean, 6) AS mean, round(sd, 6) AS sd, """ + ", ".join(f"round(mean + ({z}) * sd, 6) AS {k}" for k, z in refdist.NORMAL.items()) + " FROM m WHERE mean IS NOT NULL")
def refdist_normative(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = view.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") == "O", "mean").otherwise("sd").alias("stat"), "l_quantity")
    return rounded(refdist.normative_summary(data, "l_quantity", 16, ["flag"]))


@register("""+ x AS (SELECT event_type AS label, min(value) AS lo, (max(value) - min(value)) / 12 AS w FROM events GROUP BY 1),
c AS (SELECT event_type AS label, least(floor((value - lo) / w), 11)::INT AS bin, count(*) AS n FROM events JOIN x ON x.label = event_type GROUP BY 1, 2)
SELECT label, b.bin::INT AS bin, round(lo + b.bin * w, 6) AS low, round(lo + (b.bin + 1) * w, 6) AS high, coalesce(n, 0)::BIGINT AS n FROM x CROSS JOIN range(12) b(bin) LEFT JOIN c USING (label, bin)""")
def refdist_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(refdist.histogram(view.table(spark, sf_dir, "events").withColumnRenamed("event_type", "label"), "value", 12, ["label"]))


@register("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_returnflag = 'R'")
def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refdist.points2d(view.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", {"l_returnflag": "r"})


@register("SELECT event_type AS label, count(DISTINCT user_id) AS n_speakers, count(DISTINCT user_id) >= 100 AS ok FROM events GROUP BY 1")
def refdist_k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refdist.k_anonymous(view.table(spark, sf_dir, "events").withColumnRenamed("event_type", "label"), ["label"], "user_id", 100)


@register("""+ k AS (SELECT * FROM iv WHERE label = 'purchase')
SELECT bundle_id, id, round(s, 6) AS "start", round(e, 6) AS "end", round(coalesce(sum(e - s + 0.5) OVER (ORDER BY bundle_id, s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS at FROM k""")
def concordance_retime(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = view.intervals(spark, sf_dir).filter("label = 'purchase'").select("bundle_id", "id", "start", "end")
    # the sum runs over the whole corpus: three places survive any order of adding
    return rounded(intervals.retimed(tokens, 0.5)).withColumn("at", F.round("at", 3))


@register("""+ k AS (SELECT * FROM wd WHERE label = 'purchase')
SELECT k.bundle_id, k.id AS token, i.id, round(greatest(i.s, k.s), 6) AS clip_start, round(least(i.e, k.e), 6) AS clip_end, i.label FROM k JOIN iv i ON i.bundle_id = k.bundle_id AND i.s < k.e AND k.s < i.e WHERE least(i.e, k.e) - greatest(i.s, k.s) > 1e-9""")
def concordance_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view.tiers(spark, sf_dir)
    tokens = t.filter("tier = 'words' and label = 'purchase'").withColumnRenamed("id", "token")
    return rounded(intervals.clip(tokens, t.filter("tier = 'phones'").drop("tier"), bucket_seconds=86_400.0))


@register("""+ m AS (SELECT bundle_id, 0 AS source, id, s, e, label FROM wd UNION ALL SELECT bundle_id, 1, id, s, e, label FROM iv)
SELECT bundle_id, source, id, round(s, 6) AS "start", round(e, 6) AS "end", label, row_number() OVER (PARTITION BY bundle_id ORDER BY s, e, source, id)::INT AS position FROM m""")
def merge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view.tiers(spark, sf_dir)
    return rounded(intervals.merge_tiers([t.filter("tier = 'words'"), t.filter("tier = 'phones'")]))


@register("""+ k AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY bundle_id ORDER BY s, id), 0) AS prior FROM iv WHERE label <> 'view')
SELECT bundle_id, id, round(s, 6) AS "start", round(e, 6) AS "end", label FROM k UNION ALL SELECT bundle_id, -1, round(prior, 6), round(s, 6), '' FROM k WHERE s > prior + 1e-9""")
def textgrid_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.fill_gaps(view.intervals(spark, sf_dir).filter("label <> 'view'"))).withColumn("id", F.coalesce("id", F.lit(-1).cast("long")))


@register("""+ f AS (SELECT *, v >= 20 AS ok, lag(v >= 20) OVER w AS before FROM p WINDOW w AS (PARTITION BY bundle_id ORDER BY t)),
r AS (SELECT *, sum((ok AND NOT coalesce(before, false))::INT) OVER (PARTITION BY bundle_id ORDER BY t) AS run FROM f)
SELECT bundle_id, round(min(t), 6) AS "start", round(max(t), 6) AS "end", count(*) AS n_frames FROM r WHERE ok GROUP BY bundle_id, run""")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(intervals.islands(view.points(spark, sf_dir), F.col("v") >= 20))


X = "emb AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 64 samples."""
    return view.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


@register(f"+ {X} SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 6) AS rms, round(20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x))), 6) AS db FROM emb")
def frame_rms_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors(spark, sf_dir).select("vec_id", fn.rms(F.col("x")).alias("rms"), fn.db_fs(fn.rms(F.col("x"))).alias("db")))


def exploded(df: DataFrame, c: Column) -> DataFrame:
    return rounded(df.select("vec_id", F.posexplode(c).alias("i", "v")))


@register(f"+ {X}, k AS (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS j FROM emb) SELECT vec_id, (j - 1)::INT AS i, round(CASE WHEN j = 1 THEN x[1] ELSE x[j] - 0.97 * x[j - 1] END, 6) AS v FROM k")
def preemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(vectors(spark, sf_dir), fn.preemphasis(F.col("x"), 0.97))


@register(f"+ {X}, k AS (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS j FROM emb) SELECT vec_id, (j - 1)::INT AS i, round(x[j] * (0.5 * (1 - cos(2 * pi() * (j - 1) / 63))), 6) + 0.0 AS v FROM k")
def hann_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(vectors(spark, sf_dir), fn.windowed(F.col("x"), fn.hann(64)))


@register(f"+ {X}, k AS (SELECT vec_id, x, unnest(range(1, len(x) + 1)) AS j FROM emb) SELECT vec_id, (j - 1)::INT AS i, round(list_avg(x[greatest(j - 2, 1):least(j + 2, len(x))]), 6) AS v FROM k")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(vectors(spark, sf_dir), fn.moving_average(F.col("x"), 5))


@register(f"+ {X}, k AS (SELECT vec_id, x, unnest(range(0, 33)) AS k FROM emb) SELECT vec_id, k::INT AS bin, round(pow(list_sum([x[j + 1] * cos(2 * pi() * k * j / 64) for j in range(0, 64)]), 2) + pow(list_sum([x[j + 1] * sin(2 * pi() * k * j / 64) for j in range(0, 64)]), 2), 6) AS power FROM k")
def dft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.power_rows(vectors(spark, sf_dir), "vec_id", "x"))


@register(f"+ {X}, k AS (SELECT vec_id, x, unnest(range(0, 33)) AS lag FROM emb) SELECT vec_id, lag::INT AS lag, round(list_sum([x[j + 1] * x[j + 1 + lag] for j in range(0, 64 - lag)]), 6) AS r FROM k")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors(spark, sf_dir).select("vec_id", F.posexplode(fn.autocorrelation(F.col("x"), 32)).alias("lag", "r")))


PERIODS = "s AS (SELECT bundle_id, t, id, v, count(*) OVER (PARTITION BY bundle_id) AS n, lead(v) OVER w AS nv, lag(v) OVER w AS pv, avg(v) OVER (PARTITION BY bundle_id ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5, count(v) OVER (PARTITION BY bundle_id ORDER BY t, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c5 FROM p WINDOW w AS (PARTITION BY bundle_id ORDER BY t, id))"


@register(f"+ {PERIODS} SELECT bundle_id, round(sum(abs(nv - v)) / (any_value(n) - 1) / avg(v), 6) AS jitter_local, round(avg(abs(v - m5)) FILTER (c5 = 5) / avg(v), 6) AS ppq5, round(sum(CASE WHEN v > 0 AND nv > 0 THEN abs(20 * log10(nv / v)) ELSE 0 END) / (any_value(n) - 1), 6) AS shimmer_db FROM s WHERE n > 5 GROUP BY 1")
def perturbation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jitter, 5-point quotient and shimmer in dB of each user's ordered values."""
    return rounded(fn.perturbation(view.points(spark, sf_dir), "bundle_id", ["t", "id"], "v"))


@register("SELECT l_orderkey, l_linenumber, round(greatest(0, least(10, 2.571 * (3.295 - 0.111 * l_quantity / 5 - 0.073 * l_discount * 100 - 0.213 * l_tax * 50 + 2.789 * l_discount - 0.032 * l_quantity + 0.077 * l_tax))), 9) AS avqi FROM lineitem")
def avqi_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return view.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.avqi(q / 5, d * 100, t * 50, d, q, t), 9).alias("avqi"))


@register("SELECT l_orderkey, l_linenumber, round(greatest(0, least(10, 2.92574 * (5.044774 - 0.172 * l_quantity / 5 - 0.193 * l_tax * 50 - 1.283 * l_discount - 0.396 * l_tax + 0.01 * l_quantity + 0.017 * l_tax + 1.473 * l_discount - 0.088 * l_tax * 50 - 68.295 * l_tax / 10))), 9) AS abi FROM lineitem")
def abi_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return view.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.abi(q / 5, t * 50, d, t, q, t, d, t * 50, t / 10), 9).alias("abi"))


@register("SELECT e.event_id, round(e.value + (CASE WHEN u.k > 0 THEN 94.0 - u.k END), 6) AS spl FROM events e LEFT JOIN (SELECT user_id, max(user_id % 7)::DOUBLE AS k FROM events GROUP BY 1) u USING (user_id)")
def calibrated_spl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view.table(spark, sf_dir, "events")
    known = e.groupBy("user_id").agg(F.max(F.col("user_id") % 7).cast("double").alias("k")).filter("k > 0")
    return e.join(known, "user_id", "left").select("event_id", F.round(campaign.spl(F.col("value"), F.lit(94.0), F.col("k")), DIGITS).alias("spl"))


@register("""+ v AS (SELECT unnest(['en', 'fr']) AS value) SELECT d.doc_id, d.source AS tier, d.lang AS label, (coalesce(d.lang, '') = '' OR v.value IS NOT NULL) AS in_vocabulary FROM documents d LEFT JOIN v ON v.value = d.lang""")
def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tier"), F.col("lang").alias("label"))
    vocabulary = docs.select("tier").distinct().withColumn("value", F.explode(F.array(F.lit("en"), F.lit("fr"))))
    return campaign.label_check(docs, vocabulary).select("doc_id", "tier", "label", "in_vocabulary")


@register("""+ c AS (SELECT * FROM (VALUES ('click', 'Ref A', '10.1/a', NULL), ('view', 'Ref B', NULL, 'https://b.example')) AS c(processor, reference, doi, url)),
f AS (SELECT user_id AS bundle_id, event_type AS processor, min(event_id) AS first_run FROM events GROUP BY 1, 2)
SELECT bundle_id, processor, reference, coalesce(url, 'https://doi.org/' || doi) AS weblink, row_number() OVER (PARTITION BY bundle_id ORDER BY first_run)::INT AS position FROM f JOIN c USING (processor)""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = view.table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), F.col("event_id").alias("id"), F.col("event_type").alias("processor"))
    known = spark.createDataFrame([("click", "Ref A", "10.1/a", None), ("view", "Ref B", None, "https://b.example")], "processor string, reference string, doi string, url string")
    return campaign.citations(runs, known, ["bundle_id"]).select("bundle_id", "processor", "reference", "weblink", "position")


from sonospan import audio_queries  # noqa: E402

QUERIES |= audio_queries.QUERIES
ORACLES |= audio_queries.ORACLES

from sonospan import corpus_queries  # noqa: E402, F401
from sonospan import live_queries  # noqa: E402, F401

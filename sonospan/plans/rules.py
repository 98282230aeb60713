"""Criterion rules: JSON -> plan of semi-joins, reductions, filter and emit."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonospan.operators.intervals import EPS, overlapping, within
from sonospan.operators.sweep import REDUCERS, reduced_in
from sonospan.plans import expr


@dataclass(frozen=True)
class Selector:
    tier: str
    label_any: tuple[str, ...] | None = None
    label_regex: str | None = None

    @classmethod
    def of(cls, body: dict | None) -> Selector | None:
        if body is None:
            return None
        return cls(body["tier"], tuple(body["label_any"]) if body.get("label_any") is not None else None, body.get("label_regex"))

    def matches(self, label: Column) -> Column:
        """A null label is the empty one."""
        label = F.coalesce(label, F.lit(""))
        ok = F.lit(True)
        if self.label_any is not None:
            ok = ok & (label.isin(*self.label_any) if self.label_any else F.lit(False))
        if self.label_regex is not None:
            ok = ok & label.rlike(self.label_regex)
        return ok


@dataclass(frozen=True)
class Rule:
    select: Selector
    emit: dict
    within: Selector | None = None
    overlaps: Selector | None = None
    where: expr.Node | None = None
    label: str | None = None

    @classmethod
    def from_json(cls, body: str | dict) -> Rule:
        body = json.loads(body) if isinstance(body, str) else body
        kind = body["emit"]["kind"]
        if kind not in ("span", "point", "point_expr", "span_expr"):
            raise ValueError(f"unknown emit kind {kind!r}")
        where = expr.parse(body["where"]) if body.get("where") is not None else None
        if where is not None and where.type != "boolean":
            raise expr.ExpressionError("where needs a boolean")
        rule = cls(Selector.of(body["select"]), body["emit"], Selector.of(body.get("within")), Selector.of(body.get("overlaps")), where, body.get("label"))
        for node in rule.anchors():
            if node.type != "number":
                raise expr.ExpressionError("an anchor needs a number")
        return rule

    def anchors(self) -> list[expr.Node]:
        if self.emit["kind"] == "point_expr":
            return [expr.parse(self.emit["at"])]
        if self.emit["kind"] == "span_expr":
            return [expr.parse(self.emit["from"]), expr.parse(self.emit["to"])]
        return []

    def referenced_signals(self) -> list[str]:
        return sorted({s for n in [*self.anchors(), *([self.where] if self.where else [])] for s in expr.signals(n)})


def crossing(samples: Column, threshold: Column, r: expr.Reduction) -> Column:
    """Time of the first or last crossing in an ordered array of (t, v); pairs are formed inside it only."""
    pairs = F.when(F.size(samples) >= 2, F.transform(F.sequence(F.lit(1), F.size(samples) - 1), lambda i: F.struct(F.get(samples, i - 1).alias("a"), F.get(samples, i).alias("b"))))
    up = lambda p: (p["a"]["v"] < threshold) & (p["b"]["v"] >= threshold)
    down = lambda p: (p["a"]["v"] > threshold) & (p["b"]["v"] <= threshold)
    test = {"rising": up, "falling": down, None: lambda p: up(p) | down(p)}[r.direction]
    hits = F.filter(pairs, lambda p: F.coalesce(test(p), F.lit(False)))
    hit = F.get(hits, F.lit(0) if r.func == "first_crossing" else F.size(hits) - 1)
    t0, v0, t1, v1 = hit["a"]["t"], hit["a"]["v"], hit["b"]["t"], hit["b"]["v"]
    return F.when(F.size(hits) > 0, t0 + (threshold - v0) / (v1 - v0) * (t1 - t0))


#: Decimals of a mean's sum; values from ``EXACT_FROM`` to ``EXACT_TO`` in size have all their digits there, whatever their number.
EXACT = "decimal(38,18)"
EXACT_FROM, EXACT_TO = 1e-2, 1e9


def mean(v: Column) -> Column:
    """The mean from a sum of decimals, rounded once: the same in any order, so that a mean which equals a bound is never moved off it.

    Where the largest value is very small or very large or one is not a number, the mean of doubles.
    """
    size = F.abs(v)
    total = F.sum(F.when(size < EXACT_TO, v.cast(EXACT)))
    return F.when((F.max(size) < EXACT_TO) & (F.max(size) >= EXACT_FROM), total.cast("double") / F.count(v)).otherwise(F.avg(v))


def aggregate(r: expr.Reduction, name: str) -> Column:
    """The aggregate of a reduction over columns t and v; NaN never wins an extreme, and ties go to the earliest time."""
    t, v = F.col("t"), F.col("v")
    real = F.when(~F.isnan(v), v)
    made = {
        "mean": lambda: mean(v),
        "max": lambda: F.max(real),
        "min": lambda: F.min(real),
        "range": lambda: F.max(real) - F.min(real),
        "median": lambda: F.median(v),
        "std": lambda: F.stddev_pop(v),
        "argmax": lambda: F.max_by(F.when(real.isNotNull(), t), F.when(real.isNotNull(), F.struct(real, -t))),
        "argmin": lambda: F.min_by(F.when(real.isNotNull(), t), F.when(real.isNotNull(), F.struct(real, t))),
    }
    if r.func in made:
        return made[r.func]().alias(name)
    return F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct("t", "v")))).alias(name)


def constant(node: expr.Node | None) -> float | None:
    """The value of a plain number, negative ones included."""
    if node is not None and node.kind == "unary" and node.value == "-":
        inner = constant(node.args[0])
        return None if inner is None else -inner
    return float(node.value) if node is not None and node.kind == "number" else None


def reducer(r: expr.Reduction) -> str | tuple:
    """What a sweep computes: a crossing of a plain number where it is, else the samples themselves."""
    if r.func in REDUCERS:
        return r.func
    threshold = constant(r.threshold)
    return "samples" if threshold is None else (r.func, r.direction, threshold)


def crossing_in_file(samples: DataFrame, r: expr.Reduction, name: str) -> DataFrame:
    """bundle_id and where the samples (_b, t, v) of a file first or last cross a plain number: pairs of neighbours, no array of samples."""
    w = Window.partitionBy("_b").orderBy("t", "v")
    threshold = F.lit(constant(r.threshold))
    pairs = samples.filter("v is not null and t is not null").select("_b", "t", "v", F.lead("t").over(w).alias("t1"), F.lead("v").over(w).alias("v1")).filter("v1 is not null and not isnan(v) and not isnan(v1)")
    up, down = (F.col("v") < threshold) & (F.col("v1") >= threshold), (F.col("v") > threshold) & (F.col("v1") <= threshold)
    at = F.col("t") + (threshold - F.col("v")) / (F.col("v1") - F.col("v")) * (F.col("t1") - F.col("t"))
    best = F.min if r.func == "first_crossing" else F.max
    return pairs.filter({"rising": up, "falling": down, None: up | down}[r.direction]).groupBy(F.col("_b").alias("bundle_id")).agg(best(at).alias(name))


def reduced(intervals: DataFrame, signals: DataFrame, wanted: list[expr.Reduction]) -> DataFrame:
    """``intervals`` with a column ``_r<i>`` for each reduction.  ``signals``: bundle_id, signal, t, v.

    One sorted sweep for each signal in interval scope, one aggregation for each
    signal in file scope; only named signals are read.
    """
    out = intervals
    for signal in sorted({r.signal for r in wanted}):
        own = signals.filter(F.col("signal") == signal).select(F.col("bundle_id").alias("_b"), "t", "v")
        some = [(i, r) for i, r in enumerate(wanted) if r.signal == signal]
        if here := [(f"_r{i}", reducer(r)) for i, r in some if r.scope == "interval"]:
            out = reduced_in(out, own.withColumnRenamed("_b", "bundle_id"), here)
        for i, r in some:
            if r.scope == "file" and isinstance(reducer(r), tuple):
                out = out.join(crossing_in_file(own, r, f"_r{i}"), "bundle_id", "left")
        if whole := [aggregate(r, f"_r{i}") for i, r in some if r.scope == "file" and not isinstance(reducer(r), tuple)]:
            out = out.join(own.groupBy(F.col("_b").alias("bundle_id")).agg(*whole), "bundle_id", "left")
    return out


def values(wanted: list[expr.Reduction], start: Column, end: Column) -> dict[expr.Reduction, Column]:
    found: dict[expr.Reduction, Column] = {}
    for i, r in enumerate(wanted):
        c = F.col(f"_r{i}")
        found[r] = crossing(c, expr.column(r.threshold, found, start, end), r) if reducer(r) == "samples" else c
    return found


def select_rois(rule: Rule, tiers: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    """Matched intervals before ``where``.  ``tiers``: bundle_id, tier, id, start, end, label."""
    def of(s: Selector) -> DataFrame:
        return tiers.filter((F.col("tier") == s.tier) & s.matches(F.col("label"))).select("bundle_id", "id", "start", "end", "label")

    rois = of(rule.select)
    if rule.within:
        rois = within(rois, of(rule.within), bucket_seconds)
    if rule.overlaps:
        rois = overlapping(rois, of(rule.overlaps), bucket_seconds)
    return rois


def evaluate(rule: Rule, tiers: DataFrame, signals: DataFrame | None = None, bucket_seconds: float | None = None) -> DataFrame:
    """Proposals: bundle_id, id (of the matched interval), start, end, label.  Points have start = end."""
    rois = select_rois(rule, tiers, bucket_seconds)
    anchors = rule.anchors()
    wanted = list(dict.fromkeys(r for n in [*([rule.where] if rule.where else []), *anchors] for r in expr.reductions(n)))
    rows = reduced(rois, signals, wanted) if wanted else rois
    start, end = F.col("start"), F.col("end")
    found = values(wanted, start, end)
    if rule.where:
        rows = rows.filter(F.coalesce(expr.column(rule.where, found, start, end), F.lit(False)))
    share = lambda x: F.lit(min(max(float(x), 0.0), 1.0))
    e = rule.emit
    if e["kind"] == "point":
        lo = hi = start + share(e.get("at", 0.5)) * (end - start)
    elif e["kind"] == "span":
        # the whole is the interval's own end: start + (end - start) may be off it by a bit
        place = lambda x: end if float(x) >= 1.0 else start + share(x) * (end - start)
        lo, hi = place(e.get("from", 0.0)), place(e.get("to", 1.0))
    elif e["kind"] == "point_expr":
        lo = hi = expr.column(anchors[0], found, start, end)
    else:
        lo, hi = (expr.column(n, found, start, end) for n in anchors)
    label = F.lit(rule.label) if rule.label is not None else F.col("label")
    out = rows.select("bundle_id", "id", lo.alias("start"), hi.alias("end"), label.alias("label")).filter(F.col("start").isNotNull() & F.col("end").isNotNull())
    return out if "point" in e["kind"] else out.filter(F.col("end") > F.col("start") + EPS)

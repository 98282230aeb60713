"""Mixing sources to target weights by subset-sum budget fitting.

A source's documents are counted by exact length in words.  Its target is met
by whole passes over the source and a subset for the rest: a proportional part
of every length's count, then a bounded-knapsack dynamic program over the counts
left for the budget that remains, which spans several of the longest documents.  Inside a length, documents are taken in
seeded hash order up to a cut, so the decision for a row needs only its source,
length and id, and reruns agree.

Only counts meet in one task: (source, length, count) rows of one source.  The
cut of a length with many documents is found inside one hash bucket of about
``BUCKET_ROWS`` rows.

Null text has size 0; a null source is a source of its own, ordered last.
Documents without words are never taken.  Rows that repeat an id are rows of
their own: equal hashes are told apart by text, and rows of one id and text are counted off, so
null and repeated ids are fitted like others.  Very long texts count whole.  An
empty table gives an empty result; columns with clashing names are kept.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonospan.llm.common import n_words, row_count, written

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2
BUCKET_ROWS = 10_000
#: Decisions of up to so many (source, length) pairs are broadcast, some 20 MB.
BROADCAST_ROWS = 200_000
#: Greedy steps bring a rest below four times this or four of the longest documents, whichever is more; the dynamic program fits that exactly.
DP_WORDS = 1 << 16


def targets(sizes: list[int], weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[float]:
    """Target words of sources given in order: a share by weight, at most ``most`` times the source, the excess shared again."""
    goal, found, still = share * sum(sizes), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while still and goal > 0:
        total = sum(weights[i % len(weights)] for i in still)
        full = [i for i in still if goal * weights[i % len(weights)] / total > most * sizes[i]]
        if not full:
            for i in still:
                found[i] = goal * weights[i % len(weights)] / total
            break
        for i in full:
            found[i] = Fraction(most * sizes[i])
            goal -= found[i]
        gone = set(full)
        still = [i for i in still if i not in gone]
    return [float(x) for x in found]


def knapsack(lengths: list[int], counts: list[int], budget: int, above: int = 0) -> list[int]:
    """How many of each length to take so that their sum is the largest that is at most ``budget``.

    With ``above``, the smallest sum from ``budget`` to ``budget + above`` instead, if there is one.
    Sums are bits of one integer; counts are split into powers of two.  Each
    step keeps the sums it reached first, from the least of them on, which is
    enough to walk back.
    """
    taken = [0] * len(lengths)
    most = budget + above
    if most <= 0:
        return taken
    mask, reached, steps = (1 << (most + 1)) - 1, 1, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        left, part = min(counts[i], most // lengths[i]) if lengths[i] else 0, 1
        while left > 0 and not reached >> budget & 1:
            part = min(part, left)
            grown = (reached << (part * lengths[i])) & mask
            if new := grown & ~reached:
                least = (new & -new).bit_length() - 1
                steps.append((i, part, least, new >> least))
                reached |= new
            left, part = left - part, part * 2
    over = reached >> budget
    at = budget + (over & -over).bit_length() - 1 if over else reached.bit_length() - 1
    for i, part, least, new in reversed(steps):
        if at >= least and new >> (at - least) & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def fit_counts(lengths: list[int], counts: list[int], goal: int) -> tuple[int, list[int]]:
    """Whole passes over a source and, per length, the documents to take once more, for ``goal`` words in all."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= 0 or goal <= 0:
        return 0, [0] * len(lengths)
    passes, rest = divmod(goal, total)
    unit = max(DP_WORDS, *(n for n, c in zip(lengths, counts, strict=True) if c))
    # the rest that the program fits is kept large, so that long documents have their chance
    share = max(0, rest - 2 * unit)
    taken = [c * share // total for c in counts]
    rest -= sum(n * k for n, k in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= 4 * unit:
            break
        if lengths[i]:
            more = min(counts[i] - taken[i], (rest - unit) // lengths[i])
            taken[i] += more
            rest -= more * lengths[i]
    left = [c - k for c, k in zip(counts, taken, strict=True)]
    extra = knapsack(lengths, left, rest)  # no document is longer than the unit, so the rest is at most four of it
    short = rest - sum(n * k for n, k in zip(lengths, extra, strict=True))
    if short > 1:  # a sum above may be nearer
        other = knapsack(lengths, left, rest, short - 1)
        if sum(n * k for n, k in zip(lengths, other, strict=True)) > rest:
            extra = other
    return passes, [k + e for k, e in zip(taken, extra, strict=True)]


def hashed(id_col: str | Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_col)


def decisions(sized: DataFrame, seed: int = 11) -> DataFrame:
    """(source, size) -> source_size, target, passes, and the last (hash, id, text hash) taken once more, with how many of the rows that have it.

    ``sized`` has id, source, size, t and is read three times.
    """
    spark = sized.sparkSession
    hist = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).collect()  # a row for each source
    order = sorted(totals, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    found = [(r["source"], r["source_size"], t) for r, t in zip(order, targets([r["source_size"] for r in order]), strict=True)]
    aims = spark.createDataFrame(found, f"source {sized.schema['source'].dataType.simpleString()}, source_size long, target double")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        passes, more = fit_counts(rows["size"].tolist(), rows["n"].tolist(), round(rows["target"].iloc[0]))
        return rows.assign(passes=passes, more=more)

    kind = sized.schema["source"].dataType.simpleString()
    joined = hist.alias("h").join(F.broadcast(aims).alias("a"), F.col("h.source").eqNullSafe(F.col("a.source"))).select("h.source", "h.size", "h.n", "a.source_size", "a.target")
    plan = written(joined.groupBy("source").applyInPandas(fit, f"source {kind}, size long, n long, source_size long, target double, passes int, more long"))
    parts = F.ceil(F.col("p.n") / BUCKET_ROWS)
    some = plan.filter((F.col("more") > 0) & (F.col("more") < F.col("n")))
    rows = (
        sized.alias("s")
        .join(attached(some).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")))
        .select("s.source", "s.size", "s.id", "s.t", hashed("s.id", seed).alias("h"), "p.more", parts.alias("parts"))
        .withColumn("bucket", F.pmod(F.col("h"), F.col("parts")))
    )
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = written(
        rows.groupBy("source", "size", "bucket", "more").agg(F.count("*").alias("n"))
        .withColumn("room", F.col("more") - F.coalesce(F.sum("n").over(before), F.lit(0)))
        .filter((F.col("room") > 0) & (F.col("room") <= F.col("n")))
        .select("source", "size", "bucket", "room")
    )
    of_length, key = Window.partitionBy("e.source", "e.size"), F.struct("r.h", "r.id", "r.t")
    cut = (
        rows.alias("r").join(attached(edge).alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.size") == F.col("e.size")) & (F.col("r.bucket") == F.col("e.bucket")))
        .select("e.source", "e.size", "r.bucket", key.alias("last"), "e.room", F.row_number().over(of_length.orderBy(key)).alias("k"), F.rank().over(of_length.orderBy(key)).alias("first"), F.count("*").over(Window.partitionBy("e.source", "e.size", "r.h", "r.id", "r.t")).alias("have"))
        .filter("k = room").select("source", "size", "bucket", "last", (F.col("room") - F.col("first") + 1).alias("keep"), "have")
    )
    return written(
        plan.alias("p").join(cut.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.size") == F.col("c.size")), "left")
        .select("p.source", "p.size", "p.n", "p.source_size", "p.target", "p.passes", "p.more", F.ceil(F.col("p.n") / BUCKET_ROWS).alias("parts"), "c.bucket", "c.last", "c.keep", "c.have")
    )


def attached(table: DataFrame) -> DataFrame:
    """A written table of (source, size) decisions, broadcast while it is small; beyond that it meets the rows by a shuffle."""
    return F.broadcast(table) if row_count(table) <= BROADCAST_ROWS else table


def taken(rows: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """``rows`` with their decision and ``times``: how often a row is taken, from its own id and its length's decision.

    Rows that repeat the id and text at a cut differ in nothing; as many of them
    as are still wanted are counted off, where there are any.
    """
    same = F.col("s.source").eqNullSafe(F.col("d.source")) & (F.col("s.size") == F.col("d.size"))
    met = rows.alias("s").join(attached(table).alias("d"), same)
    h = hashed("s.id", seed)
    bucket, own = F.pmod(h, F.col("d.parts")), F.struct(h.alias("h"), F.col("s.id").alias("id"), F.col("s.t").alias("t"))
    partly = (F.col("d.more") > 0) & (F.col("d.more") < F.col("d.n"))
    once_more = F.when(F.col("d.more") <= 0, False).when(~partly, True).when(bucket != F.col("d.bucket"), bucket < F.col("d.bucket")).otherwise(own <= F.col("d.last"))
    number = lambda more: F.when(F.col("s.size") == 0, 0).otherwise(F.col("d.passes") + more.cast("int"))
    if table.filter("keep < have").isEmpty():
        return met.select("s.*", "d.source_size", "d.target", number(once_more).alias("times"))
    tied = F.coalesce(partly & own.eqNullSafe(F.col("d.last")) & (F.col("d.keep") < F.col("d.have")), F.lit(False))
    off = F.row_number().over(Window.partitionBy("s.source", "s.size").orderBy("s.t")) <= F.col("d.keep")
    apart = met.filter(tied).select("s.*", "d.source_size", "d.target", number(off).alias("times"))
    return met.filter(~tied).select("s.*", "d.source_size", "d.target", number(once_more).alias("times")).unionByName(apart)


def with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """id, source, size and a hash of the text, which parts rows that repeat an id."""
    return docs.select(*more, F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), F.xxhash64(text_col).alias("t"))


def budget_mix(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    sized = written(with_sizes(docs, id_col, text_col, source_col))
    return taken(sized, decisions(sized, seed), seed).select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    sized = written(with_sizes(docs, id_col, text_col, source_col))
    rows = with_sizes(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    wanted = taken(rows, decisions(sized, seed), seed).filter("times > 0")
    return wanted.select("doc", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select("doc.*")

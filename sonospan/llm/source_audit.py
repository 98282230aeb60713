"""How the sources of a language differ in their terms: upper-bound term search and postings.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of the whole text, A-Z lower-cased.
A language keeps the V terms that at least ``min_docs`` of its documents hold.  A
group is a (lang, source) with a document; its N is its number of kept
occurrences.  With c occurrences a term has p = 1 + floor(1e9 * (c + 5) / (N + 5 V))
in the group, and q by the same rule in the language.

* Terms (``part`` term): the terms of a group with c > 0 and p > q, by p - q.  All
  terms of one count share p, so the least and greatest q of such a bucket bound
  all of its values.  Buckets whose bound lies strictly below what the buckets
  with the best guarantees already give for rank ``most`` are never opened.  Those
  that are left are evaluated best bound first, until the bound of what is unseen
  is strictly below the value of rank ``most``; ties at it are all seen.
* Pairs (``part`` pair): every other source of the language, by the sum of
  abs(p - q) over all kept terms, all ranks.  Count buckets give the sums against a
  source that lacks the term, postings correct them for terms that both have, so
  terms that both lack are never met.

Mappers add up counts of (lang, source, term) before the one shuffle by (lang,
term), so neither a hot source nor a frequent word is a hot group: a key has a row
for each source and task at most.  Long texts are read in pieces cut between
terms.  All arithmetic is on integers; products that may exceed 64 bits are
decimals.

Null text, lang and source count as ''.  An empty text is a document without
terms.  Rows that repeat count each.  A language that keeps no term gives pairs of
value 0 and no terms.  Ties go to the smaller item by its UTF-8 bytes.  Other
columns are not read; no rows give no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonospan.llm.common import row_count, written

TERM = re.compile(rb"[a-z\x80-\xff]+")
BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
PIECE_BYTES = 1 << 20
#: Terms that a task holds before it hands their counts on.
HELD_TERMS = 1 << 18
#: Groups up to which their totals are broadcast: some 50 bytes each.
BROADCAST_GROUPS = 100_000
SCALE, PRIOR = 1_000_000_000, 5


def cut(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes; no term is cut."""
    at = 0
    while at < len(data):
        stop = BREAK.search(data, at + size) if at + size < len(data) else None
        end = stop.start() if stop else len(data)
        yield data[at:end]
        at = end


def counted(batches: Iterator[pa.RecordBatch], held_terms: int = HELD_TERMS, piece: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of text, lang, source -> lang, source, term, n, docs; every group also has a row without a term."""
    known: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in known.items():
            terms = [None, *(t.decode("utf-8", "surrogatepass") for t in n)]
            cols = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
        known.clear()

    for batch in batches:
        for text, lang, source in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, docs = known.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            data = text.as_py()
            if len(data) <= piece:
                found = TERM.findall(data.lower())
                n.update(found)
                docs.update(set(found))
            else:
                own: set[bytes] = set()
                for part in cut(data, piece):
                    found = TERM.findall(part.lower())
                    n.update(found)
                    own.update(found)
                docs.update(own)
            size += len(n) - before
            if size >= held_terms:
                yield from given()
                size = 0
    yield from given()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 V)), exact; 1 where nothing is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    under = whole(total) + F.lit(PRIOR).cast("decimal(5,0)") * whole(kept)
    over = F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + F.lit(PRIOR).cast("decimal(5,0)"))
    return F.coalesce(1 + F.call_function("div", over, F.when(under > 0, under)), F.lit(1).cast("long"))


def best_first(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and bound, greatest first -> those that can be among the ``most`` greatest of their group, ties included.

    Within a bucket rows come by value, greatest first.
    """
    group, values, done = None, [], False
    for batch in batches:
        keep = []
        for lang, source, bound, value in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if (lang, source) != group:
                group, values, done = (lang, source), [], False
            if not done and len(values) >= most and bound < values[most - 1]:
                done = True  # no later bucket of the group reaches the rank
            take = not done and (len(values) < most or value >= values[most - 1])
            if take:
                values.append(value)
                if len(values) > most:
                    values.sort(reverse=True)
                    if len(values) > 4 * most:
                        del values[most:]
                elif len(values) == most:
                    values.sort(reverse=True)
            keep.append(take)
        yield batch.filter(pa.array(keep, pa.bool_()))


def top_terms(postings: DataFrame, most: int) -> DataFrame:
    """lang, source, item, value, rank of the ``most`` greatest p - q > 0 of each group, q the language's."""
    buckets = postings.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("size"), F.min("q").alias("low"), F.max("q").alias("high"))
    bounds = buckets.select("lang", "source", "n", "size", (F.col("p") - F.col("low")).alias("bound"), (F.col("p") - F.col("high")).alias("sure")).filter("bound > 0")
    # buckets that guarantee the greatest values give the rank a least value
    by_group = Window.partitionBy("lang", "source")
    enough = F.sum("size").over(by_group.orderBy(F.desc("sure")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) >= most
    opened = bounds.withColumn("reached", enough & (F.col("sure") > 0)).withColumn("least", F.coalesce(F.max(F.when(F.col("reached"), F.col("sure"))).over(by_group), F.lit(1)))
    opened = opened.filter("bound >= least").select("lang", "source", "n", "bound")
    seen = postings.join(opened, ["lang", "source", "n"]).select("lang", "source", "bound", (F.col("p") - F.col("q")).alias("value"), F.col("term").alias("item")).filter("value > 0")
    kinds = "lang string, source string, bound long, value long, item string"
    best = seen.repartition("lang", "source").sortWithinPartitions("lang", "source", F.desc("bound"), F.desc("value"), "item").mapInArrow(lambda it: best_first(it, most), kinds)
    rank = F.row_number().over(by_group.orderBy(F.desc("value"), "item"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).select("lang", "source", "item", "value", "rank")


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language by the sum of abs(p - q) over all kept terms."""
    none = groups.select("lang", "source", "kept", "own", "zero")
    others = none.select("lang", F.col("source").alias("item"), F.col("own").alias("other_own"), F.col("zero").alias("other_zero"))
    pairs = none.join(others, "lang").filter("source <> item")
    buckets = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("size"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    # a group's terms against each source as if that lacked them all
    alone = buckets.join(others, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("size") * gap("p", "other_zero")).alias("alone"))
    x = postings.select("lang", "term", "source", "p", "zero")
    y = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("other_zero"))
    both = x.join(y, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(
        F.count("*").alias("both"), F.sum(gap("p", "q") - gap("p", "other_zero") - gap("zero", "q") + gap("zero", "other_zero")).alias("fix")
    )
    both = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("k"), "fix").select("lang", "k.*", "fix")
    mirrored = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("other_alone"))
    key = ["lang", "source", "item"]
    nought = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = nought("alone") + nought("other_alone") + nought("fix") + (F.col("kept") - F.col("own") - F.col("other_own")) * gap("zero", "other_zero")
    summed = pairs.join(alone, key, "left").join(mirrored, key, "left").join(both, key, "left").select(*key, F.when(F.col("kept") > 0, value).otherwise(0).cast("long").alias("value"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_audit(docs: DataFrame, min_docs: int = 30, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: a row for each pair of sources and for each of a source's ``most`` leading terms."""
    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counts = known.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    # one shuffle, by (lang, term), serves the sums, the documents and the totals of a term
    by_term = Window.partitionBy("lang", "term")
    rows = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    first = F.row_number().over(by_term.orderBy("source")) == 1
    table = written(
        rows.withColumn("in_docs", F.sum("docs").over(by_term)).filter(F.col("term").isNull() | (F.col("in_docs") >= min_docs))
        .select("lang", "term", "source", "n", F.sum("n").over(by_term).alias("total"), first.alias("first"))
    )
    terms = table.filter("term is not null")
    own = table.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("term").alias("own"))
    whole = terms.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("kept"))
    groups = own.join(whole, "lang", "left").select("lang", "source", "size", "own", F.coalesce("lang_size", F.lit(0)).alias("lang_size"), F.coalesce("kept", F.lit(0)).alias("kept"))
    groups = written(groups.withColumn("zero", share(F.lit(0), F.col("size"), F.col("kept"))))
    small = F.broadcast(groups) if row_count(groups) <= BROADCAST_GROUPS else groups
    postings = written(
        terms.join(small, ["lang", "source"])
        .select("lang", "source", "term", "n", "zero", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), share(F.col("total"), F.col("lang_size"), F.col("kept")).alias("q"))
    )
    parts = [d.withColumn("part", F.lit(p)) for d, p in ((pair_sums(postings, groups), "pair"), (top_terms(postings, most), "term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def oracle_sql() -> str:
    return r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d
), t AS (SELECT r, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS kept FROM k GROUP BY lang
), gn AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), ln AS (SELECT lang, sum(n)::BIGINT AS size FROM c GROUP BY lang
), lt AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL
), p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (gn.size + 5 * v.kept) AS p,
    1 + (1000000000 * (lt.n + 5)::HUGEINT) // (ln.size + 5 * v.kept) AS q
  FROM gn JOIN v USING (lang) JOIN ln USING (lang) JOIN k USING (lang) JOIN lt ON lt.lang = gn.lang AND lt.term = k.term
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

"""Exact substring dedup: every byte covered by a 200-byte string that also starts elsewhere.

A window is a run of ``LENGTH`` bytes.  Its anchor is the leftmost place of the
least hash among its ``GRAM``-byte runs; equal windows have their anchors at one
offset, so repeats meet by anchor, about one for every 60 bytes of text.

1. Every document yields its anchors with a hash of their contexts (all bytes of
   windows that may have that anchor).  A task folds equal contexts, so a passage
   in very many documents is one row a task; an anchor whose context is equal to
   another's is covered without more ado, an anchor nobody shares goes.
2. Anchors with equal grams but different contexts meet with their bytes.  The
   suffixes that follow the gram, and the reversed prefixes before it, are sorted
   deep-shallow; common prefixes of neighbours give classes of suffixes equal
   down to any depth, and a window at offset o repeats where both the class of o
   bytes before and the class of the rest behind have another member.
3. A gram with very many different contexts is dealt to chunks.  Its range of
   offsets is then halved, again and again: each half goes on by the hash of the
   bytes that all its windows share, with the rows whose windows there are still
   open and one row of each class found, until no group needs two chunks or one
   offset is left, when the group's windows are equal.

Texts are told apart by a 64-bit hash, equal texts are one.  Null is empty.
Matches never cross documents; texts under ``LENGTH`` bytes lose nothing.
Repeated rows repeat each other, and so lose what is long enough.  Kept bytes
need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.llm.common import bit_table, leading, marked, written
from sonospan.llm.deep_shallow import deep_shallow
from sonospan.llm.line_dedup import powers
from sonospan.llm.rule_stats import mixed

LENGTH = 200
GRAM = 80
MARK_BITS = 24
CHUNK_ROWS = 4096
KERNEL_ROWS = 4096
HELD_ANCHORS = 1_500_000
PART_BYTES = 1 << 19
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_hash(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data, seed=1)
    return h - (1 << 64) if h >> 63 else h


class Sums:
    """Prefix hashes of a run of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 2)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTES[data] * up[: len(data)], dtype=np.uint64)])

    def part(self, lo, hi):
        return mixed((self.sums[hi] - self.sums[lo]) * self.down[lo] + mixed(np.asarray(hi - lo).astype(np.uint64)))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a text, hashes of their grams, hashes of their contexts.  Long texts are read in parts."""
    n, places, grams, contexts = len(data), [], [], []
    whole = np.frombuffer(data, dtype=np.uint8)
    span = LENGTH - GRAM
    for first in range(0, max(n - LENGTH + 1, 0), PART_BYTES):
        last = min(first + PART_BYTES, n - LENGTH + 1)  # windows that start in [first, last)
        lo, hi = max(0, first - span), min(n, last + 2 * LENGTH)
        sums = Sums(whole[lo:hi])
        at = np.arange(first - lo, last - lo + span)
        h = sums.part(at, at + GRAM)
        key = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(at), dtype=np.uint64)
        size = 1
        while 2 * size <= span + 1:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        rest = span + 1 - size
        if rest:
            key = np.minimum(key[:-rest], key[rest:])
        found = np.unique(key & np.uint64((1 << 21) - 1)).astype(np.int64)
        place = found + first
        left, right = np.maximum(place - span, 0), np.minimum(place + LENGTH, n)
        places.append(place)
        grams.append(h[found])
        contexts.append(mixed(sums.part(left - lo, right - lo) + (place - left).astype(np.uint64)))
    if not places:
        return (np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.uint64)] * 2)
    place, at = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(grams)[at], np.concatenate(contexts)[at]


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]


ROW = "gram long, context long, t long, place int, n int, many boolean"
NAMES = ["gram", "context", "t", "place", "n", "many"]


def rows_of(gram, context, t, place, n, many) -> pa.RecordBatch:
    """Anchor rows; a row without a gram is a covered span [place, n)."""
    return pa.RecordBatch.from_arrays([gram if isinstance(gram, pa.Array) else pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(t), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(many)], NAMES)


def context_span(place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(place - (LENGTH - GRAM), 0), np.minimum(place + LENGTH, n)


def covers(t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Span rows, merged within each text; spans too short for a window cover nothing."""
    long = hi - lo >= LENGTH
    t, lo, hi = t[long], lo[long], hi[long]
    order = np.lexsort((lo, t))
    t, lo, hi = t[order], lo[order], hi[order]
    out: list[list[np.ndarray]] = [[], [], []]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else []
    for a, b in zip(starts, np.append(starts[1:], len(t)) if len(t) else [], strict=True):
        x, y = spans(lo[a:b], hi[a:b])
        out[0].append(np.full(len(x), t[a]))
        out[1].append(x)
        out[2].append(y)
    t, lo, hi = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in out)
    none = np.zeros(len(t), dtype=np.int64)
    return rows_of(pa.nulls(len(t), pa.int64()), none, t, lo, hi, none.astype(bool))


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's texts, equal contexts folded."""
    held: list[tuple[np.ndarray, ...]] = []
    count, seen = 0, set()

    def folded() -> Iterator[pa.RecordBatch]:
        gram, context, t, place, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((context, gram))
        gram, context, t, place, n = (x[order] for x in (gram, context, t, place, n))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        many = np.repeat(size > 1, size)
        yield covers(t[many], *context_span(place[many], n[many]))
        one = np.flatnonzero(new)
        for lo in range(0, len(one), 100_000):
            i = one[lo : lo + 100_000]
            yield rows_of(gram[i], context[i], t[i], place[i], n[i], many[i])

    for batch in batches:
        for text in batch.column(0):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if len(data) < LENGTH:
                continue
            t = text_hash(data)
            if t in seen:  # a copy: all of it repeats, and so does the text met before
                yield covers(np.array([t]), np.array([0]), np.array([len(data)]))
                continue
            seen.add(t)
            place, gram, context = anchors(data)
            held.append((gram, context, np.full(len(place), t), place, np.full(len(place), len(data))))
            count += len(place)
            if count >= HELD_ANCHORS:
                yield from folded()
                count = 0
                seen = set() if len(seen) > 1_000_000 else seen
    if held:
        yield from folded()


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, context): spans of anchors with an equal context elsewhere, and one anchor of each context where a gram has several."""
    carry: list[np.ndarray] | None = None
    before = False  # the carried run's gram has had another context

    def settled(cols: list[np.ndarray], before: bool, last: bool) -> Iterator[pa.RecordBatch]:
        gram, context, t, place, n, many = cols
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(gram))
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        if not len(starts):
            return
        until = ends[-1]
        size = np.repeat(ends - starts, ends - starts)
        full = (size > 1) | many[:until]
        need = full & ~many[:until]
        yield covers(t[:until][need], *context_span(place[:until][need], n[:until][need]))
        prior = np.concatenate([[before], gram[starts[1:]] == gram[starts[1:] - 1]])
        after = np.array([e < len(gram) and gram[e] == gram[e - 1] for e in ends])
        i = starts[prior | after]
        if len(i):
            yield rows_of(gram[i], context[i], t[i], place[i], n[i], full[i])

    for batch in batches:
        null = batch.column(0).is_null()
        if null.true_count:
            yield batch.filter(null)
            batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(carry, cols, strict=True)]
        yield from settled(cols, before, False)
        gram, context = cols[0], cols[1]
        run = len(gram) - int(np.argmax(((gram != gram[-1]) | (context != context[-1]))[::-1])) if ((gram != gram[-1]) | (context != context[-1])).any() else 0
        before = gram[run] == gram[run - 1] if run else before
        carry = [c[run:] for c in cols]
    if carry is not None:
        yield from settled(carry, before, True)


OPEN = "group long, chunk int, chunks int, t long, place int, full boolean, low int, high int, left binary, gram binary, right binary"
OPEN_NAMES = ["group", "chunk", "chunks", "t", "place", "full", "low", "high", "left", "gram", "right"]


OPEN_SCHEMA = pa.schema(list(zip(OPEN_NAMES, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)))


def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of anchors with their bytes -> covered spans (chunk -1), and open anchors of groups that lie in several chunks."""
    held: list[dict] = []
    key = None

    def done() -> Iterator[pa.RecordBatch]:
        spanned, left_open = settle(held)
        held.clear()
        if spanned:
            yield pa.RecordBatch.from_pylist(spanned, schema=OPEN_SCHEMA)
        if left_open:
            yield pa.RecordBatch.from_pylist(left_open, schema=OPEN_SCHEMA)

    for batch in batches:
        for row in batch.to_pylist():
            if (row["group"], row["chunk"]) != key and len(held) >= KERNEL_ROWS:
                yield from done()
            key = row["group"], row["chunk"]
            held.append(row)
    if held:
        yield from done()


def padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    return out, np.array([len(s) for s in strings], dtype=np.int64)


def classes(order: np.ndarray, prefix: np.ndarray, depth: int) -> np.ndarray:
    """Class numbers of rows by (group, first ``depth`` bytes)."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(prefix < depth)
    return out


def settle(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    span = LENGTH - GRAM
    # rows of one text and place are one anchor; grams are compared, not trusted
    rows = list({(r["group"], r["chunk"], r["t"], r["place"]): r for r in rows}.values())
    numbers: dict[tuple, int] = {}
    group = np.array([numbers.setdefault((r["group"], r["chunk"], r["gram"]), len(numbers)) for r in rows])
    right, right_n = padded([r["right"] for r in rows], span)
    left, left_n = padded([r["left"][::-1] for r in rows], span)
    after, before = deep_shallow(group, right, right_n), deep_shallow(group, left, left_n)
    low, high = (np.array([r[k] for r in rows]) for k in ("low", "high"))
    repeats = np.zeros((len(rows), span + 1), dtype=bool)
    lead = np.zeros_like(repeats)  # first row of its class
    for o in range(span + 1):
        here = np.flatnonzero((left_n >= o) & (right_n >= span - o) & (low <= o) & (o <= high))
        if len(here) < 2:
            continue
        both = (classes(*before, o)[here] << 32) | classes(*after, span - o)[here]
        _, first, where, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        repeats[here, o] = count[where] > 1
        lead[here[first], o] = True
    chunked = np.array([r["chunks"] > 1 for r in rows])
    one = low == high
    repeats |= (np.arange(span + 1) == low[:, None]) & (chunked & one)[:, None]  # equal to the group's other chunks
    spanned, left_open = [], []
    for i, r in enumerate(rows):
        lo, hi = max(r["low"], span - len(r["right"])), min(r["high"], len(r["left"]))
        if not r["full"]:
            spanned += [CLOSED | {"t": r["t"], "low": r["place"] - b, "high": r["place"] - a + LENGTH} for a, b, yes in runs(repeats[i], lo, hi) if yes]
        if chunked[i] and not one[i]:
            mid = (r["low"] + r["high"]) // 2
            for x, y in ((r["low"], mid), (mid + 1, r["high"])):
                needed = slice(max(x, lo), min(y, hi) + 1)
                if (lead[i, needed] | ~repeats[i, needed]).any():
                    core = r["left"][len(r["left"]) - x :] + r["gram"] + r["right"][: span - y]
                    left_open.append(r | {"group": text_hash(core + bytes((x, y))), "chunk": 0, "chunks": 1, "low": x, "high": y})
    return spanned, left_open


CLOSED = {"group": 0, "chunk": -1, "chunks": 0, "place": 0, "full": False, "left": b"", "gram": b"", "right": b""}


def runs(flags: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, bool]]:
    """Maximal runs (first, last, value) of flags[lo..hi]."""
    at = lo
    while at <= hi:
        end = at
        while end < hi and flags[end + 1] == flags[at]:
            end += 1
        yield at, end, bool(flags[at])
        at = end + 1


def dealt(rows: DataFrame) -> DataFrame:
    """Rows whose group has others, with the group's chunks."""
    counts = rows.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1").select("group", F.ceil(F.col("size") / CHUNK_ROWS).cast("int").alias("chunks"))
    return rows.drop("chunk", "chunks").join(counts, "group").withColumn("chunk", F.pmod(F.xxhash64("t", "place"), F.col("chunks")).cast("int")).select(*OPEN_NAMES)


def covered_spans(texts: DataFrame) -> DataFrame:
    """(t, lo, hi) of covered bytes.  ``texts``: one text column, as (t, text) readable again."""
    found = written(
        texts.select("text").mapInArrow(anchor_rows, ROW)
        .repartition(F.coalesce("gram", "t")).sortWithinPartitions("gram", "context", "t", "place").mapInArrow(matched, ROW)
    )
    whole = found.filter("gram is null").select("t", F.col("place").alias("lo"), F.col("n").alias("hi"))
    part = found.filter("gram is not null")
    table = texts.sparkSession.sparkContext.broadcast(bit_table(part.select("t"), MARK_BITS))
    span = LENGTH - GRAM

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            t = np.array([text_hash((x.as_py() or "").encode("utf-8", "surrogatepass")) for x in batch.column(0)], dtype=np.int64)
            use = marked(table.value, leading(pa.array(t), MARK_BITS))
            for i in np.flatnonzero(use):
                if t[i] in seen:
                    use[i] = False
                elif len(seen) < 1_000_000:
                    seen.add(int(t[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t)], ["text", "t"]).filter(pa.array(use))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = (batch.column(0)[row].as_py() or "").encode("utf-8", "surrogatepass")
                t, places = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                for lo in range(0, len(places), 1000):
                    out = []
                    for p in places[lo : lo + 1000]:
                        a = p["place"]
                        out.append({"group": p["gram"], "chunk": 0, "chunks": 1, "t": t, "place": a, "full": p["many"], "low": 0, "high": span, "left": data[max(0, a - span) : a], "gram": data[a : a + GRAM], "right": data[a + GRAM : a + LENGTH]})
                    yield pa.RecordBatch.from_pylist(out, schema=OPEN_SCHEMA)

    places = part.groupBy("t").agg(F.collect_set(F.struct("gram", "place", "many")).alias("places"))
    sources = texts.select("text").mapInArrow(keyed, "text string, t long")
    chunks = part.groupBy(F.col("gram").alias("group")).agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")).filter("chunks > 1")
    rows = sources.join(places, "t").select("text", "t", "places").mapInArrow(contexts, OPEN)
    rows = rows.drop("chunks", "chunk").join(chunks, "group", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("t", "place"), F.col("chunks")).cast("int")).select(*OPEN_NAMES)
    spanned = [whole]
    while True:
        settled = written(rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk").mapInArrow(kernel, OPEN))
        spanned.append(settled.filter("chunk < 0").select("t", F.col("low").alias("lo"), F.col("high").alias("hi")))
        still = settled.filter("chunk >= 0")
        if still.isEmpty():
            break
        rows = dealt(still)
    out = spanned[0]
    for x in spanned[1:]:
        out = out.unionByName(x)
    return out


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_bytes`` the kept bytes.

    Texts of which nothing goes are finished in the scan; only the others are shuffled once more.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lost = written(covered_spans(texts).distinct())
    table = docs.sparkSession.sparkContext.broadcast(bit_table(lost.select("t"), MARK_BITS))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    def result(ids: pa.Array, kept: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
        columns = [ids, pa.array([n + len(k) for k, n, _ in kept], pa.int64()), pa.array([n for _, n, _ in kept], pa.int64()), pa.array([s for _, _, s in kept], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in kept], pa.string())]
        return pa.RecordBatch.from_arrays([*columns, *([pa.array([k for k, _, _ in kept], pa.binary())] if with_bytes else [])], ["id", *RESULT, *(["kept"] if with_bytes else [])])

    def data_of(batch: pa.RecordBatch) -> list[bytes]:
        return [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]

    def scanned(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[bytes], np.ndarray, np.ndarray]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                data = data_of(part)
                t = np.array([text_hash(x) for x in data], dtype=np.int64)
                yield part, data, t, marked(table.value, leading(pa.array(t), MARK_BITS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, _, use in scanned(batches):
            keep = np.flatnonzero(~use)
            yield result(batch.column(0).take(pa.array(keep)), [(data[i], 0, 0) for i in keep])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, t, use in scanned(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], ["id", "text", "t"]).filter(pa.array(use))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                kept = []
                for data, found in zip(data_of(part), part.column(2), strict=True):
                    found = found.as_py() or []
                    a, b = spans(np.array([x["lo"] for x in found], dtype=np.int64), np.array([x["hi"] for x in found], dtype=np.int64))
                    at = np.concatenate([[0], b]), np.concatenate([a, [len(data)]])
                    kept.append((b"".join(data[x:y] for x, y in zip(*at, strict=True)), int((b - a).sum()), len(a)))
                yield result(part.column(0), kept)

    of_text = lost.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    more = texts.mapInArrow(others, f"id {kind}, text string, t long").join(of_text, "t", "left").select("id", "text", "spans").mapInArrow(cut, schema)
    return texts.mapInArrow(whole, schema).unionByName(more).withColumnRenamed("id", id_col)

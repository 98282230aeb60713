"""Removing lines that repeat an earlier line up to one word, by a deletion-neighbourhood join.

Lines are runs between newlines.  Every line with a word takes part.  The edit
distance is counted in words for lines of ``NEAR_WORDS`` words or more, and in
characters for lines of fewer words that have ``NEAR_CHARS`` characters or more
(white space between words is one), such as unspaced scripts, addresses and code;
the bound is 1.  It is 0 for shorter lines, and between lines counted differently.
Order is (id, hash of the text, line number).  A line goes when an earlier line
equals it, or lies within the bound of it.

1. Lines whose first or last half nobody else has can have no neighbour.  Half
   keys seen with two different lines are marked in a bit table of fixed size; a
   wrong mark only costs rows.
2. Marked lines emit all variants within the bound: the line, and the line less
   each word or character, as hashes.  Equal variants meet: two lines of one
   length that miss the same place are a substitution apart, a line that equals
   another's variant is an insertion away.  Later lines are paired with the
   earliest line they meet so.
3. The edit distance of every pair is verified on the words or characters of its
   two lines, which are fetched for the paired lines alone.
4. Lines with a verified earlier partner are dropped wherever they occur.

Equal lines are told by a 64-bit hash of all their words.  Hashes, positions and
paired lines are all that is shuffled until the last join, which brings each
document the numbers of its dropped lines.  Exact repeats are folded by map-side
minima, variants by (variant, place, line).

Null text has no lines.  Rows that repeat an id and text are one document and
get one result; null ids are ids.  Very long texts are hashed whole, a run of
lines at a time.  A table without rows gives none.  Other columns are kept, but
input columns named ``n_lines`` or ``n_removed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonospan.llm.common import bit_table, leading, marked, written
from sonospan.llm.rule_stats import SPACES, mixed
from sonospan.llm.wordhash import powers, word_hashes

LEAST_WORDS = 1
NEAR_WORDS = 5
NEAR_CHARS = 20
MARK_BITS = 24
#: Texts hashed together, in bytes.
TOGETHER = 1 << 18
#: Sets hashes of characters apart from those of words.
CHARACTERS = 0x6A09E667F3BCC909
#: Tasks that share the later lines of one partner.
SALTS = 8


class Parts:
    """Lines as runs of hashed parts, which are words or characters."""

    def __init__(self, parts: np.ndarray, n: np.ndarray, salt: int = 0):
        self.n, self.salt = n, np.uint64(salt)
        self.end = np.cumsum(n)
        self.start = self.end - n
        up, self.down = powers(len(parts) + 2)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(parts * up[: len(parts)], dtype=np.uint64)])
        self.hash = named(self.part(self.start, self.end), n) ^ self.salt

    def part(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of runs of parts, wherever they stand."""
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]

    def half_keys(self, at: np.ndarray) -> np.ndarray:
        """Four keys a line: its first and last half as a partner of lines as long or longer, and of shorter ones."""
        lo, hi, n = self.start[at], self.end[at], self.n[at]
        out = []
        for shorter in (n, np.maximum(n - 1, 1)):
            half = shorter // 2
            out += [named(self.part(lo, lo + half), 2 * shorter), named(self.part(hi - half, hi), 2 * shorter + 1)]
        return np.stack(out, axis=1) ^ self.salt

    def variants(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(variant, place of the missing part or -1, index into ``at``): every line, and every line less each of its parts."""
        n = self.n[at]
        owner = np.repeat(np.arange(len(at)), n)
        lo, hi = self.start[at][owner], self.end[at][owner]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        w = lo + place
        less = (self.sums[w] - self.sums[lo] + (self.sums[hi] - self.sums[w + 1]) * self.down[1]) * self.down[lo]
        return np.concatenate([self.hash[at], named(less, hi - lo - 1) ^ self.salt]), np.concatenate([np.full(len(at), -1), place]), np.concatenate([np.arange(len(at)), owner])


class Lines(Parts):
    """Line hashes of some texts; lines are numbered through."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        words, start = word_hashes(data)
        breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        self.per_text = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
        self.first = np.cumsum(self.per_text) - self.per_text
        self.text = np.repeat(np.arange(len(texts)), self.per_text)
        super().__init__(words, np.bincount(np.searchsorted(breaks, start), minlength=len(self.text)))
        self.short, self.chars = self.characters(data, np.concatenate([[-1], breaks]) + 1, np.concatenate([breaks, [len(data)]]))
        #: Lines that can have near ones.
        self.near = np.union1d(np.flatnonzero(self.n >= NEAR_WORDS), self.short)

    def characters(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, Parts]:
        """Lines of few words but ``NEAR_CHARS`` characters or more, and their characters."""
        at = np.flatnonzero((self.n > 0) & (self.n < NEAR_WORDS) & (end - begin >= NEAR_CHARS))
        texts = [b" ".join(data[lo:hi].split()).decode("utf-8", "surrogatepass") for lo, hi in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
        n = np.array([len(t) for t in texts], dtype=np.int64)
        use = n >= NEAR_CHARS
        codes = np.frombuffer("".join(t for t, u in zip(texts, use.tolist(), strict=True) if u).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return at[use], Parts(mixed(codes.astype(np.uint64) + np.uint64(1)), n[use], CHARACTERS)

    def number(self, at: np.ndarray) -> np.ndarray:
        """Line numbers inside the texts."""
        return at - self.first[self.text[at]]

    def near_keys(self, at: np.ndarray) -> np.ndarray:
        """Half keys of lines that can have near ones."""
        out, few = self.half_keys(at), self.n[at] < NEAR_WORDS
        out[few] = self.chars.half_keys(np.searchsorted(self.short, at[few]))
        return out

    def near_variants(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Variants of lines that can have near ones."""
        few = self.n[at] < NEAR_WORDS
        v, place, own = self.variants(at[~few])
        cv, cplace, cown = self.chars.variants(np.searchsorted(self.short, at[few]))
        return np.concatenate([v, cv]), np.concatenate([place, cplace]), np.concatenate([np.flatnonzero(~few)[own], np.flatnonzero(few)[cown]])


def named(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mixed(h + mixed(n.astype(np.uint64) + np.uint64(0x1234567)))


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def text_key(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def together(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts) in runs of about ``TOGETHER`` bytes."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        data = bytes_of(text.as_py())
        held.append(data)
        size += len(data)
        if size >= TOGETHER:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def parts_of(line: str) -> list[str] | str:
    """What the edit distance of a line is counted in: words, or characters of lines with few words."""
    words = line.split(" ")
    return line if len(words) < NEAR_WORDS else words


def within_one(a: str, b: str) -> bool:
    """Whether two normalised lines are counted in the same parts and at most one insertion, deletion or substitution apart."""
    x, y = parts_of(a), parts_of(b)
    if type(x) is not type(y) or abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    at = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    return x[at + (len(x) == len(y)) :] == y[at + 1 :]


def verified(docs: DataFrame, pairs: DataFrame, bits: int = MARK_BITS) -> DataFrame:
    """Hashes of lines that lie within the bound of their earlier partner, read from the texts themselves.

    ``pairs``: h, t of a text that has the line, and the same of the partner as other_h and other_t.
    """
    ends = pairs.select("h", "t").union(pairs.select("other_h", "other_t"))
    texts, needed = (docs.sparkSession.sparkContext.broadcast(bit_table(ends.select(c), bits)) for c in ("t", "h"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data in together(batch.column(0)):
                t = np.array([text_key(x) for x in data], dtype=np.int64)
                some = np.flatnonzero(marked(texts.value, leading(pa.array(t), bits)))
                if not len(some):
                    continue
                lines = Lines([data[k] for k in some])
                use = lines.near[marked(needed.value, lines.hash[lines.near] >> np.uint64(64 - bits))] if len(lines.near) else lines.near
                hashes, found = [], []
                split: tuple[int, list[bytes]] = (-1, [])
                for i, h, k, line in zip(use.tolist(), lines.hash[use].view(np.int64).tolist(), lines.text[use].tolist(), lines.number(use).tolist(), strict=True):
                    if h in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(h)
                    if split[0] != k:
                        split = (k, data[some[k]].split(b"\n"))
                    hashes.append(h)
                    found.append(b" ".join(split[1][line].split()))
                if hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], ["h", "words"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within_one(*(x.as_py().decode("utf-8", "surrogatepass") for x in pair)) for pair in zip(batch.column(1), batch.column(2), strict=True)]
            yield batch.select([0]).filter(pa.array(near, pa.bool_()))

    words = written(docs.select("text").mapInArrow(fetch, "h long, words binary").groupBy("h").agg(F.min("words").alias("words")))
    # one early line may be the partner of a great many: its side is dealt over SALTS tasks
    salted = pairs.select("h", "other_h").distinct().withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
    partners = pairs.select("other_h").distinct().join(words.withColumnRenamed("h", "other_h"), "other_h").select("other_h", F.col("words").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = salted.join(words, "h").join(partners, ["other_h", "salt"]).select("h", "words", "other")
    return met.mapInArrow(compared, "h long").distinct()


def marks(keys: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the keys that two different lines have."""
    return bit_table(keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a < b").select("key"), bits)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def scanned(docs: DataFrame) -> DataFrame:
    """A row for each document with lines: id, t, and packed line numbers, line hashes, half keys and the lines that own those."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in together(batch.column(1)):
                found = Lines(texts)
                use = np.flatnonzero(found.n >= LEAST_WORDS)
                near = found.near
                packed = [found.number(use).astype("<i4"), found.hash[use], found.near_keys(near), found.hash[near]]
                cuts = [np.searchsorted(found.text[x], np.arange(len(texts) + 1)) for x in (use, use, near, near)]
                columns = [pa.array([p[c[k] : c[k + 1]].tobytes() for k in range(len(texts))], pa.binary()) for p, c in zip(packed, cuts, strict=True)]
                keys = pa.array([text_key(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), keys, *columns], ["id", "t", "lines", "hashes", "keys", "owners"]).filter(pa.array(np.diff(cuts[0]) > 0))

    return docs.mapInArrow(run, f"id {kind}, t long, lines binary, hashes binary, keys binary, owners binary")


def unpack(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of packed arrays one after another, and how many each row has."""
    arrays = [np.frombuffer(x.as_py(), dtype=dtype) for x in column]
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype=dtype), np.array([len(a) for a in arrays], dtype=np.int64)


def dropped_lines(docs: DataFrame, near: bool = True, mark_bits: int = MARK_BITS) -> DataFrame:
    """(id, t, drop): line numbers to drop, for the documents that lose any.  ``docs``: id, text."""
    kind = docs.schema["id"].dataType.simpleString()
    found = written(scanned(docs))

    def all_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, size = unpack(batch.column(2), "<i4")
            at = np.repeat(np.arange(len(size)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(batch.column(1).to_numpy()[at]), pa.array(lines), pa.array(unpack(batch.column(3), "<i8")[0])], ["id", "t", "line", "h"])

    def half_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unpack(batch.column(0), "<i8")[0]), pa.array(np.repeat(unpack(batch.column(1), "<i8")[0], 4))], ["key", "h"])

    lines = found.mapInArrow(all_lines, f"id {kind}, t long, line int, h long").withColumn("place", F.struct("id", "t", "line"))
    first = lines.groupBy("h").agg(F.min("place").alias("first"))
    gone = None
    if near:
        table = docs.sparkSession.sparkContext.broadcast(marks(found.select("keys", "owners").mapInArrow(half_keys, "key long, h long"), mark_bits))

        def with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, size = unpack(batch.column(0), "<u8")
                hit = np.repeat(np.arange(len(size)), size)[marked(table.value, keys >> np.uint64(64 - mark_bits))]
                yield batch.select([1]).take(pa.array(np.unique(hit)))

        texts = docs.sparkSession.sparkContext.broadcast(bit_table(found.select("keys", "t").mapInArrow(with_marks, "t long"), mark_bits))

        def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, tuple] = {}

            def earlier(h: int, place: tuple) -> bool:
                """Whether this is the earliest place of a line so far in this task."""
                if h in seen and seen[h] <= place:
                    return False
                if h in seen or len(seen) < 500_000:
                    seen[h] = place
                return True

            for batch in batches:
                ids = batch.column(0).to_pylist()
                for start, data in together(batch.column(1)):
                    t = np.array([text_key(x) for x in data], dtype=np.int64)
                    some = np.flatnonzero(marked(texts.value, leading(pa.array(t), mark_bits)))
                    if not len(some):
                        continue
                    lines = Lines([data[k] for k in some])
                    use = lines.near
                    use = use[marked(table.value, lines.near_keys(use) >> np.uint64(64 - mark_bits)).any(axis=1)] if len(use) else use
                    places = zip(lines.hash[use].tolist(), some[lines.text[use]].tolist(), lines.number(use).tolist(), strict=True)
                    use = use[[earlier(h, (ids[start + k] is not None, ids[start + k] or 0, int(t[k]), line)) for h, k, line in places]] if len(use) else use
                    if not len(use):
                        continue
                    v, place, own = lines.near_variants(use)
                    at = some[lines.text[use]]
                    yield pa.RecordBatch.from_arrays(
                        [signed(v), pa.array(place.astype(np.int32)), signed(lines.hash[use][own]), batch.column(0).take(pa.array(start + at[own])), pa.array(t[at][own]), pa.array(lines.number(use)[own].astype(np.int32))],
                        ["v", "without", "h", "id", "t", "line"],
                    )

        met = docs.mapInArrow(variants, f"v long, without int, h long, id {kind}, t long, line int").repartition("v")
        met = met.groupBy("v", "without", "h").agg(F.min(F.struct("id", "t", "line", "h")).alias("place"))
        of_v, of_place = Window.partitionBy("v"), Window.partitionBy("v", "without")
        met = met.withColumns({"own": F.min("place").over(of_place), "whole": F.min(F.when(F.col("without") < 0, F.col("place"))).over(of_v), "less": F.min(F.when(F.col("without") >= 0, F.col("place"))).over(of_v)})
        partners = F.when(F.col("without") < 0, F.array("less")).otherwise(F.array("own", "whole"))
        earlier_ones = F.filter(partners, lambda p: F.coalesce(p < F.col("place"), F.lit(False)))
        pairs = met.select("h", F.col("place.t").alias("t"), F.explode(earlier_ones).alias("p")).select("h", "t", F.col("p.h").alias("other_h"), F.col("p.t").alias("other_t"))
        # a line meets the same partner by many variants: once is enough
        pairs = written(pairs.groupBy("h", "other_h").agg(F.min("t").alias("t"), F.min("other_t").alias("other_t")))
        gone = verified(docs, pairs, mark_bits).withColumn("gone", F.lit(True))
    known = first if gone is None else first.join(gone, "h", "left")
    lost = lines.join(known, "h").filter((F.col("place") != F.col("first")) | (F.lit(False) if gone is None else F.coalesce("gone", F.lit(False))))
    return lost.groupBy("id", "t").agg(F.sort_array(F.collect_set("line")).alias("drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True) -> DataFrame:
    """All columns of ``docs``, the text without its dropped lines, then ``n_lines`` (with a word) and ``n_removed``."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    drop = written(dropped_lines(ids, near))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed") or c in (id_col, text_col)]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    at = own.index(text_col)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([text_key(bytes_of(x.as_py())) for x in batch.column(at)], pa.int64())], [*batch.schema.names, "t"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in inner.schema]
    joined = inner.mapInArrow(keyed, ", ".join([*fields, "t long"])).alias("d").join(drop.alias("x"), F.col(f"d.c{own.index(id_col)}").eqNullSafe(F.col("x.id")) & (F.col("d.t") == F.col("x.t")), "left").select(*[f"d.c{i}" for i in range(len(own))], "x.drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):  # few texts at a time: a batch may hold many MB
                batch = whole.slice(lo, 500)
                texts, n_lines, n_removed = [], [], []
                for text, drop in zip(batch.column(at), batch.column(len(own)), strict=True):
                    text, drop = text.as_py(), set(drop.as_py() or ())
                    lines = text.split("\n") if text else []
                    n_lines.append(sum(1 for x in lines if x.strip(SPACES)))
                    n_removed.append(len(drop))
                    texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                columns = [*batch.columns[: len(own)], pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[: len(own)], "n_lines", "n_removed"])

    out = joined.mapInArrow(cut, ", ".join([*fields, "n_lines long", "n_removed long"]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *[c for c in ("n_lines", "n_removed") if c not in own])


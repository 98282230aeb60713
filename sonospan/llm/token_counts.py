"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of frequent pre-token lengths, broadcast once.
A byte-pair vocabulary is learned most-frequent-first, so its leading whole
pre-tokens are the frequent ones; the table holds at most ``frequent`` of them
whatever the corpus size.  Tier two is a bounded cache in every worker for the
pre-tokens that miss.  No pre-token is ever shuffled: the plan is one map over
the scan.

Null text counts as empty.  Empty and null texts give zero tokens.  Very long
texts are counted a piece of some 2 ** 20 characters at a time, but for those with
a special string.  Repeated rows give repeated rows.  Other columns of the input
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.llm import pretokens

FREQUENT = 32_768


def frequent_lengths(path: str, frequent: int = FREQUENT) -> dict[str, int]:
    """Token counts of the ``frequent`` lowest-numbered vocabulary entries that are whole pre-tokens."""
    tok = pretokens.tokenizer(path)
    ids = sorted(set(tok.get_vocab().values()))
    texts = [t for t in tok.decode_batch([[i] for i in ids]) if t and "�" not in t and pretokens.BYTE_PATTERN.fullmatch(t)]
    texts = list(dict.fromkeys(texts))[:frequent]
    special = set(pretokens.special_strings(path))
    texts = [t for t in texts if t not in special]
    return {t: len(e.ids) for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True)}


def token_counter(path: str, frequent: dict[str, int]):
    """A function from a text to its number of tokens."""
    tok = pretokens.tokenizer(path)
    special = [s for s in pretokens.special_strings(path) if s]
    length = pretokens.TwoTier(frequent, lambda t: len(pretokens.model_ids(tok, t))).__getitem__

    def count(text: str) -> int:
        if any(s in text for s in special):
            return len(tok.encode(text, add_special_tokens=False).ids)
        return sum(map(of_piece, pretokens.pieces(text)))

    def of_piece(piece: str) -> int:
        if not piece.isascii() and pretokens.UNSURE.search(piece):
            return len(tok.encode(piece, add_special_tokens=False).ids)
        split = (pretokens.BYTE_PATTERN if pretokens.NOT_LATIN.search(piece) else pretokens.LATIN_BYTE_PATTERN).findall
        return sum(map(length, split(piece)))

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path, frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path, table.value)
        for batch in batches:
            # one text at a time: a batch of very long texts is never a list of strings
            counts = [count(t.as_py() or "") for t in batch.column(1)]
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.array([c > limit for c in counts])], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)

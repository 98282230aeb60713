"""Vector links, hard negatives and the audit of sources against brute force and on edge cases."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from sonospan.llm import hard_negatives, source_audit, vector_blocks, vector_links

VEC = "vec_id long, embedding array<double>, label int, v string, n string, id string, place string, block int, row int"
NAN, INF = float("nan"), float("inf")


def vectors(seed: int, n: int, dim: int = 12):
    """Clusters of near copies, exact and scaled copies, chains, odd vectors, repeated rows and ids."""
    r = np.random.default_rng(seed)
    made = r.normal(size=(n, dim)).tolist()
    hub = r.normal(size=dim)
    made += [(hub + r.normal(scale=0.08, size=dim)).tolist() for _ in range(n // 2)]
    made += [hub.tolist() for _ in range(5)] + [(3.5 * hub).tolist(), (-hub).tolist()]
    chain = r.normal(size=dim)
    for _ in range(6):
        made.append(chain.tolist())
        chain = chain + r.normal(scale=0.25, size=dim)
    made += [None, [], [0.0] * dim, [1.0, None], [NAN] * dim, [1.0, INF], [1.0, 2.0], [1.0, 2.0, 0.0], [1e200] * dim, [1e-200] * dim, [-0.0] + [1.0] * (dim - 1), [0.0] + [1.0] * (dim - 1)]
    rows = [(i, x, [None, 0, 1, 2, 2][i % 5], "x", "y", "z", "p", 1, 2) for i, x in enumerate(made)]
    rows += [rows[3], rows[n + 1], rows[n + 1], (7, hub.tolist(), 1, "x", "y", "z", "p", 1, 2), (None, hub.tolist(), 1, "x", "y", "z", "p", 1, 2), (50, hub.tolist(), 2, "x", "y", "z", "p", 1, 2), (50, hub.tolist(), 2, "x", "y", "z", "p", 1, 2)]
    return rows


def usable(x, zero_too=False):
    return x is not None and all(c is not None and math.isfinite(c) for c in x) and (zero_too or any(c != 0 for c in x))


def linked(rows, cosine):
    """(id, links, least id reachable, kept) of every row, by all pairs."""
    dim = max(len(x[1]) for x in rows if x[1] is not None)

    def unit(x):
        x = np.pad(np.array(x, dtype=float), (0, dim - len(x)))
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    good = {i: unit(x[1]) for i, x in enumerate(rows) if usable(x[1])}
    near = defaultdict(set)
    for i, a in good.items():
        for j, b in good.items():
            if i != j and a @ b >= cosine:
                near[i].add(j)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((row[0], len(near[i]), least, row[0] is not None and row[0] == least))
    return Counter(out)


@pytest.mark.parametrize(("block_rows", "cosine"), [(2048, 0.95), (17, 0.95), (40, 0.6)])
def test_vector_links_equal_all_pairs(spark, block_rows, cosine):
    rows = vectors(block_rows, 90)
    got = vector_links.vector_links(spark.createDataFrame(rows, VEC).repartition(4), cosine=cosine, block_rows=block_rows)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == linked(rows, cosine)


def test_vector_links_of_no_rows_and_of_none_usable(spark):
    assert vector_links.vector_links(spark.createDataFrame([], VEC)).collect() == []
    odd = [(1, None, 0, "x", "y", "z", "p", 1, 2), (2, [0.0, 0.0], 0, "x", "y", "z", "p", 1, 2), (None, [NAN], 0, "x", "y", "z", "p", 1, 2)]
    assert sorted(map(tuple, vector_links.vector_links(spark.createDataFrame(odd, VEC)).collect()), key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)], key=str)


def test_quantisation_bounds_hold_for_every_pair():
    r = np.random.default_rng(5)
    u = vector_blocks.units(np.concatenate([r.normal(size=(80, 40)), r.normal(size=(20, 40)) ** 5, np.eye(40)[:5]]))
    cells, scale, error = vector_links.quantised(u)
    approximate = (cells.astype(float) @ cells.astype(float).T) * scale[:, None] * scale[None]
    bound = error[:, None] + (1 + error[:, None]) * error[None]
    assert (np.abs(u @ u.T - approximate) <= bound + 1e-12).all()
    assert bound.max() < 0.2


def test_most_pairs_are_left_to_the_integers(monkeypatch):
    """Pairs that are computed in double precision are those near the threshold or above it."""
    r = np.random.default_rng(6)
    table = pa.table({"v": pa.array(list(r.normal(size=(600, 64))), pa.list_(pa.float64())), "node": np.arange(600), "n": np.ones(600, dtype=np.int64)})
    block = vector_links.Block(vector_links.packed(table, 0).to_pylist()[0])
    seen = []
    einsum = np.einsum
    monkeypatch.setattr(vector_links.np, "einsum", lambda *a: seen.append(len(a[1])) or einsum(*a))
    count = np.zeros(600, dtype=np.int64)
    list(vector_links.met(block, block, 0.4, count, count))
    exact = np.triu(block.units @ block.units.T, 1)
    assert count.sum() == 2 * (exact >= 0.4).sum()
    assert (exact >= 0.4).sum() <= sum(seen) <= (exact >= 0.36).sum()


def test_blocks_whose_angles_leave_no_room_do_not_meet(spark):
    r = np.random.default_rng(7)
    rows = [(i, (np.eye(12)[i % 12] + r.normal(scale=0.005, size=12)).tolist()) for i in range(600)]
    classes = spark.createDataFrame([(v, i, 1) for i, v in rows], "v array<double>, node long, n long")
    blocks = vector_links.blocks_of(classes, 30)
    n = blocks.count()
    assert n >= 12
    assert vector_links.meetings(blocks, 0.95).count() < n * (n + 1) / 4
    got = vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=30)
    assert {r.n_links for r in got.collect()} == {49}


def mined(rows, k=5, m=3):
    dim = max(len(x[1]) for x in rows if x[1] is not None)
    kept = [(i, r[0], r[2], np.array([math.floor(256 * c) for c in r[1]] + [0] * (dim - len(r[1])), dtype=object)) for i, r in enumerate(rows) if r[0] is not None and r[2] is not None and usable(r[1], True) and all(abs(c) < 1e6 for c in r[1])]
    out = []
    for i, anchor, label, x in kept:
        if anchor % 7:
            continue
        scored = sorted((-int(x @ y), j, lab == label) for row, j, lab, y in kept if row != i)
        for s, j, _ in [q for q in scored if q[2]][:k]:
            fit = [q for q in scored if not q[2] and 50 * -s <= 100 * -q[0] <= 95 * -s][:m]
            out += [(anchor, j, rank, q[1], -s, -q[0]) for rank, q in enumerate(fit, 1)]
    return Counter(out)


@pytest.mark.parametrize("sizes", [(8192, 1024), (40, 9), (7, 3)])
def test_hard_negatives_equal_all_pairs(spark, sizes, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 6)
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 3)
    rows = [r for r in vectors(11, 90) if r[1] is None or all(c is None or not math.isfinite(c) or abs(c) < 1e6 for c in r[1])]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VEC).repartition(3), F.col("vec_id") % 7 == 0, block_rows=sizes[0], anchor_rows=sizes[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert sum(want.values()) > 50
    assert Counter(map(tuple, got.collect())) == want


def test_hard_negatives_with_ties_one_label_and_no_rows(spark):
    ask = F.col("vec_id") % 10 == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VEC), ask).collect() == []
    same = [(i, [1.0, 0.5], 1, "x", "y", "z", "p", 1, 2) for i in range(30)]
    assert hard_negatives.hard_negatives(spark.createDataFrame(same, VEC), ask).collect() == []
    tied = [(i, [1.0, 0.0], 1, "", "", "", "", 1, 2) for i in range(8)] + [(i, [0.75, 0.0], 2, "", "", "", "", 1, 2) for i in range(8, 20)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(tied, VEC), F.col("vec_id") == 0)
    assert Counter(map(tuple, got.collect())) == Counter((0, p, k, 7 + k, 65536, 49152) for p in (1, 2, 3, 4, 5) for k in (1, 2, 3))


def test_pairs_of_nodes_bound_their_products_and_prune_groups():
    r = np.random.default_rng(8)
    centres = 40 * r.normal(size=(6, 10))
    x = np.floor(256 * (centres[np.arange(600) % 6] + r.normal(size=(600, 10))))
    labels = np.arange(600) % 4

    def tree(own, leaf):
        order, t = hard_negatives.grown(x[own], labels[own], leaf)
        row = {"n": len(order), "dim": 10, "ids": own[order], "rows": own[order], "labels": labels[own][order], "exact": x[own][order], **t}
        return hard_negatives.Tree({k: v if k in ("n", "dim") else v.astype(hard_negatives.ARRAYS[k]).tobytes() for k, v in row.items()})

    a, b = tree(np.arange(0, 600, 10), 5), tree(np.arange(600), 20)
    least, most = hard_negatives.intervals(a, b)
    exact = a.exact @ b.exact.T
    for i in range(len(a.lo)):
        for j in range(len(b.lo)):
            part = exact[a.lo[i] : a.hi[i], b.lo[j] : b.hi[j]]
            assert least[i, j] <= part.min() <= part.max() <= most[i, j]
    found = hard_negatives.Positives(a, 5)
    found.meet(b)
    assert found.scored < exact.size / 3


DOC = "doc_id long, text string, lang string, source string, n_chars long, term string, n int, docs int, p int"


def audited(rows, min_docs, most):
    docs = [tuple(x or "" for x in r[1:4]) for r in rows]
    lower = {chr(c): chr(c + 32) for c in range(65, 91)}
    found = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(lower.get(c, c) for c in t)), lang, s) for t, lang, s in docs]
    out = []
    for lang in {d[1] for d in found}:
        own = [d for d in found if d[1] == lang]
        held = Counter(t for d in own for t in set(d[0]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter(t for d in own if d[2] == s for t in d[0] if held[t] >= min_docs) for s in {d[2] for d in own}}
        total = sum(counts.values(), Counter())

        def p(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q, by = p(total), {s: p(c) for s, c in counts.items()}
        for s in counts:
            parts = {"pair": [(-sum(abs(by[s][t] - by[o][t]) for t in kept), o.encode(), o) for o in counts if o != s], "term": [(q[t] - by[s][t], t.encode(), t) for t in kept if counts[s][t] and by[s][t] > q[t]]}
            for part, values in parts.items():
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(values), 1) if part == "pair" or k <= most]
    return Counter(out)


def documents(seed, n):
    r = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(120)] + ["Über", "über", "ÜBER", "naïve", "日本語", "\U0001f600a", "WAx"]
    rows = []
    for i in range(n):
        source = [None, "", "a", "b", "B", "ü", "\U0001f600", "hot", "hot", "hot"][r.integers(10)]
        k = int(r.integers(0, 40))
        weight = 1 / (1 + np.arange(len(words)))
        picked = r.choice(len(words), size=k, p=weight / weight.sum())
        rows.append((i, " ".join(words[(w + (3 if source == "a" else 0)) % len(words)] + [",", "1", "_", "\x00", ""][w % 5] for w in picked), [None, "", "en", "en", "en", "de"][r.integers(6)], source, 0, "t", 1, 1, 1))
    return rows + [(n, None, "en", "a", 0, "t", 1, 1, 1), (n + 1, "", "empty", "a", 0, "t", 1, 1, 1), (n + 2, "12 --", "empty", "b", 0, "t", 1, 1, 1), rows[3], rows[3]]


@pytest.mark.parametrize(("min_docs", "most"), [(30, 50), (5, 4), (1, 3), (10_000, 50)])
def test_source_audit_equals_brute_force(spark, min_docs, most):
    rows = documents(min_docs, 400)
    got = source_audit.source_audit(spark.createDataFrame(rows, DOC).repartition(3), min_docs, most)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == audited(rows, min_docs, most)


def test_source_audit_of_no_rows(spark):
    assert source_audit.source_audit(spark.createDataFrame([], DOC)).collect() == []


def test_long_texts_are_counted_in_pieces_and_small_tables_handed_on():
    text = "Alpha beta,GAMMA\n" * 50 + "x" * 300 + " ü" * 40
    batch = pa.RecordBatch.from_arrays([pa.array([text, "", text]), pa.array(["en"] * 3), pa.array(["a"] * 3)], ["text", "lang", "source"])

    def counts(**how):
        out = defaultdict(Counter)
        for b in source_audit.counted(iter([batch, batch]), **how):
            for r in b.to_pylist():
                out[r["term"]].update(n=r["n"], docs=r["docs"])
        return out

    assert counts() == counts(piece=20) == counts(held_terms=1) == counts(held_terms=2, piece=7)
    assert counts()["gamma"] == Counter(n=200, docs=4)


def test_best_first_search_stops_below_the_rank_and_keeps_ties():
    values = [(9, 9, "a"), (9, 7, "b"), (8, 8, "c"), (7, 7, "d"), (7, 6, "e"), (6, 6, "f")]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 6), pa.array(["s"] * 6), *(pa.array([v[k] for v in values]) for k in range(3))], ["lang", "source", "bound", "value", "item"])
    kept = [r["item"] for b in source_audit.best_first(iter([batch]), 3) for r in b.to_pylist()]
    assert set("acbd") <= set(kept) and "f" not in kept

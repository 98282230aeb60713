"""Paths through recordings cut into blocks are those of whole recordings."""

import numpy as np
import pytest

from sonospan.functions import align
from sonospan.operators import paths

BLOCKS = "bundle_id long, block int, first long, emissions array<array<double>>"


def cut(rows, sizes):
    out = []
    for bundle, e in rows:
        at, k = 0, 0
        while at < len(e):
            n = sizes[k % len(sizes)]
            out.append((bundle, k, at, e[at : at + n].tolist()))
            at, k = at + n, k + 1
    return out


@pytest.mark.parametrize("sizes", [[1], [3, 1, 7], [1000]])
@pytest.mark.parametrize("silence", [0, 3])
def test_any_cut_gives_the_same_path(spark, sizes, silence):
    r = np.random.default_rng(4)
    rows, targets = [], []
    for bundle in range(4):
        t = [int(x) for x in r.integers(1, 5, size=(1, 6, 9, 3)[bundle])]
        e = np.log(r.dirichlet(np.full(5, 0.5), size=(25, 31, 40, 12)[bundle]) + 1e-9)
        if bundle == 2:
            e = np.round(e)  # many ties
        if bundle == 3:
            e[5:] = -np.inf
            e[5:, 0] = 0.0
            e[:5, t] = -1.0
        rows.append((bundle, e))
        targets.append((bundle, t))
    got = paths.forced_align_cut(spark.createDataFrame(cut(rows, sizes), BLOCKS), spark.createDataFrame(targets, "bundle_id long, targets array<int>"), min_silence_frames=silence).collect()
    for (bundle, e), (_, t) in zip(rows, targets, strict=True):
        want = sorted((s.first, s.end, s.token, s.score) for s in align.forced_align(e, t, min_silence_frames=silence) if s.end > s.first)
        mine = sorted((x["first"], x["end"], x["token"], x["score"]) for x in got if x["bundle_id"] == bundle)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert np.allclose(np.clip([m[3] for m in mine], -1e6, 0), np.clip([w[3] for w in want], -1e6, 0))


def test_matrices_compose():
    r = np.random.default_rng(2)
    _, may_skip = align.lattice([1, 2, 2, 3], 0)
    e = align.fixed(r.normal(size=(11, 9)))
    first, _ = align.advanced(None, e[:4], may_skip)
    whole, _ = align.advanced(None, e, may_skip)
    assert (paths.carried_over(paths.carried_over(first, paths.band(e[4:6], may_skip)), paths.band(e[6:], may_skip)) == whole).all()


def test_recordings_that_cannot_be_aligned(spark):
    e = np.log(np.full((3, 4), 0.25)).tolist()
    frame = lambda rows: spark.createDataFrame(rows, BLOCKS)
    targets = lambda t: spark.createDataFrame([(1, t)], "bundle_id long, targets array<int>")
    with pytest.raises(Exception, match="too few frames"):
        paths.forced_align_cut(frame([(1, 0, 0, e)]), targets([1, 1, 2])).collect()
    with pytest.raises(Exception, match="out of range"):
        paths.forced_align_cut(frame([(1, 0, 0, e)]), targets([9])).collect()
    with pytest.raises(Exception, match="first block"):
        paths.forced_align_cut(frame([(1, 1, 0, e)]), targets([1])).collect()
    assert paths.forced_align_cut(frame([]), targets([1])).collect() == []

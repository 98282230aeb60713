"""Frames of recordings cut into pieces are those of whole recordings, and no row holds a recording's samples."""

import numpy as np
import pytest

from sonospan import audio_queries as queries
from sonospan.functions import clinical, dsp

SMALL, RATE = "/root/testdata/sf0.001", 16_000


@pytest.fixture(scope="module")
def whole(spark):
    made = {r.bundle_id: np.array(r.samples) for r in queries.recordings(spark, SMALL).collect()}
    assert max(map(len, made.values())) > queries.PIECE * queries.EACH  # some recording has several pieces
    return made


def of_recording(name, x):
    kind, _, method = name.partition("_")
    if kind == "pitch":
        p = dsp.pitch(x, RATE, method)
        return np.stack([p["t"], p["hz"], p["voicing"]], axis=1)
    if kind == "mfcc":
        return dsp.mfcc(x, RATE, method=method)
    if kind == "ltas":
        hz, power = dsp.ltas(x, RATE)
        return np.stack([hz, 10 * np.log10(power)], axis=1)
    return dsp.log_mel_whisper(x, RATE)


@pytest.mark.parametrize("name", [f"pitch_{m}" for m in dsp.PITCH] + ["mfcc_librosa", "mfcc_kaldi", "mfcc_praat", "ltas", "whisper_log_mel"])
def test_pieces_give_what_whole_recordings_give(spark, whole, name):
    df = queries.QUERIES[name](spark, SMALL)
    assert "samples" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = df.toPandas()
    assert set(rows.bundle_id) == set(whole)
    for b, x in whole.items():
        own = rows[rows.bundle_id == b].sort_values(rows.columns[1])
        got = np.stack(own.iloc[:, 2]) if "frame" in own else own.iloc[:, 1:].to_numpy()
        np.testing.assert_allclose(got, of_recording(name, x), rtol=1e-9, atol=1e-9)


def test_voice_measures_of_pieces(spark):
    df = queries.QUERIES["clinical_measures"](spark, SMALL)
    got = {r.bundle_id: r.asDict() for r in df.collect()}
    for r in queries.recordings(spark, SMALL, 22_050).collect():
        for name, (want,) in clinical.measures(np.array(r.samples), 22_050).items():
            # the bands of gne are filtered piece by piece, which moves its prediction a little
            np.testing.assert_allclose(got[r.bundle_id][name], want, rtol=1e-9, atol=5e-4 if name == "gne" else 1e-9)
    assert "samples" not in df._jdf.queryExecution().optimizedPlan().toString()

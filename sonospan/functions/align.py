"""Syllables, phone tokens and forced alignment, word by word and utterance by utterance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# IPA classes of the sonority scale, most sonorous first.
VOWELS = "iyɨʉɯuɪʏʊeøɘɵɤoəɛœɜɞʌɔæɐaɶɑɒɚɝ"
SCALE = {9: "jwɥɰ", 8: "rɾɹɻʀʁɽ", 7: "lɫɭʎʟ", 6: "mɱnɳɲŋɴ", 5: "vzʒðβʐʑʝɣʕɦɮ", 4: "fsʃθɸʂɕçxχħhɬ", 3: "bdɖɟgɡɢ"}
RANK = {c: r for r, chars in SCALE.items() for c in chars} | dict.fromkeys(VOWELS, 10)
SYLLABIC = "̩̍"
NUCLEI = frozenset(VOWELS)


def base(phone: str) -> str | None:
    return next((c for c in phone if c in RANK or (unicodedata.category(c).startswith("L") and unicodedata.category(c) != "Lm")), None)


def sonority(phone: str) -> int:
    c = base(phone)
    return 1 if c is None else RANK.get(c, 2)


def is_nucleus(phone: str) -> bool:
    return any(c in SYLLABIC for c in phone) or base(phone) in NUCLEI


def syllabify(phones: list[str]) -> list[tuple[int, int]]:
    """Index ranges of a word's syllables: onsets reach left while sonority falls away from the nucleus."""
    if not phones:
        return []
    rank, nucleus = [sonority(p) for p in phones], [is_nucleus(p) for p in phones]
    heads = [i for i in range(len(phones)) if nucleus[i] and not (i and nucleus[i - 1])]
    cuts = [0]
    for head in heads[1:]:
        at = head
        while not nucleus[at - 1] and rank[at - 1] < rank[at]:
            at -= 1
        cuts.append(at)
    return list(zip(cuts, [*cuts[1:], len(phones)], strict=True))


def syllable_cuts(codes: np.ndarray, starts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where syllables begin in words put end to end, each letter a phone: ``syllabify`` of all at once.

    ``codes``: code points, ``starts``: where words begin, none empty; ``known``: a
    table by code point, -1 at first, that fills with rank * 2 + nucleus.
    """
    for c in np.unique(codes[known[codes] < 0]).tolist():
        known[c] = sonority(chr(c)) * 2 + is_nucleus(chr(c))
    rank, nucleus = known[codes] >> 1, (known[codes] & 1).astype(bool)
    begins = np.zeros(len(codes), dtype=bool)
    begins[starts] = True
    after = np.roll(nucleus, 1) & ~begins  # behind a nucleus of the same word
    heads = np.flatnonzero(nucleus & ~after)
    word = np.searchsorted(starts, heads, "right")
    heads = heads[1:][word[1:] == word[:-1]]
    # an onset may reach from a letter to the one before while sonority falls
    reaches = ~begins & ~after & (np.roll(rank, 1) < rank)
    last = np.maximum.accumulate(np.where(reaches, 0, np.arange(len(codes))))
    begins[last[heads]] = True
    return np.flatnonzero(begins)


def tokenize(ipa: str, vocabulary: dict[str, int]) -> list[int]:
    """Longest match from the left; what matches nothing is an error."""
    longest, at, out = max(map(len, vocabulary), default=0), 0, []
    while at < len(ipa):
        size = next((n for n in range(min(longest, len(ipa) - at), 0, -1) if ipa[at : at + n] in vocabulary), None)
        if size is None:
            raise ValueError(f"no token matches {ipa[at:]!r}")
        out.append(vocabulary[ipa[at : at + size]])
        at += size
    return out


class Span(NamedTuple):
    """Frames of one target, or of silence (label is the blank, token -1)."""

    label: int
    first: int
    end: int
    score: float
    token: int


def runs(key: np.ndarray) -> list[tuple[int, int]]:
    """First and end positions of runs of equal values."""
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return list(zip(cuts, cuts[1:], strict=False))


#: The score of what cannot be reached.
NEVER = np.int64(-(1 << 62))


def fixed(log_probs: np.ndarray) -> np.ndarray:
    """Log probabilities, cut at -1000, in whole numbers of 2 ** -32: their sums do not depend on the order of adding."""
    return np.rint(np.maximum(log_probs, -1000.0) * float(1 << 32)).astype(np.int64)


def lattice(targets: list[int], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the states, and the states that can be reached over the blank before them."""
    states = np.full(2 * len(targets) + 1, blank)
    states[1::2] = targets
    may_skip = np.zeros(len(states), dtype=bool)
    may_skip[3::2] = states[3::2] != states[1:-2:2]
    return states, may_skip


def advanced(score: np.ndarray | None, e: np.ndarray, may_skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores after the frames ``e`` (by states) from those before them (None: the recording begins), and how many states each came by."""
    frames, n = e.shape
    back = np.zeros((frames, n), dtype=np.int8)
    begin = 0
    if score is None:
        score, begin = np.full(n, NEVER), 1
        score[:2] = e[0, :2]
    gap = np.full(2, NEVER)
    for t in range(begin, frames):
        ways = np.stack([score, np.concatenate([gap[:1], score[:-1]]), np.where(may_skip, np.concatenate([gap, score[:-2]])[:n], NEVER)])
        back[t] = ways.argmax(axis=0)  # staying wins ties, then one step
        best = ways.max(axis=0)
        score = np.where(best > NEVER, np.maximum(best + e[t], NEVER), NEVER)
    return score, back


def likeliest_path(log_probs: np.ndarray, targets: list[int], blank: int) -> np.ndarray:
    """State of every frame: 2k + 1 is target k, 2k the blank before it."""
    states, may_skip = lattice(targets, blank)
    score, back = advanced(None, fixed(log_probs)[:, states], may_skip)
    at = len(states) - 1 if score[-1] >= score[-2] else len(states) - 2
    path = np.zeros(len(back), dtype=int)
    for t in range(len(back) - 1, -1, -1):
        path[t] = at
        at -= back[t, at]
    return path


def forced_align(log_probs: np.ndarray, targets: list[int], blank: int = 0, min_silence_frames: int = 0, silence_mask: np.ndarray | None = None) -> list[Span]:
    """Spans of the targets on the likeliest path; they partition the utterance.

    Blank frames belong to the phone before them, leading ones to the first.
    Silence is carved out where ``silence_mask`` is set, and where blanks last
    ``min_silence_frames`` or more (0: nowhere); a phone may then fall in several
    spans or in none.  Otherwise a phone without frames has an empty span.  Scores
    are mean log probabilities of the label over its span.
    """
    if not targets:
        raise ValueError("no targets")
    frames, repeats = len(log_probs), sum(a == b for a, b in zip(targets, targets[1:], strict=False))
    if not frames:
        raise ValueError("no frames")
    if not 0 <= min(blank, *targets) <= max(blank, *targets) < log_probs.shape[1]:
        raise ValueError("a label is out of range")
    if silence_mask is not None and len(silence_mask) != frames:
        raise ValueError("the silence mask has another number of frames")
    if frames < len(targets) + repeats:
        raise ValueError(f"{frames} frames cannot hold {len(targets)} phones")
    path = likeliest_path(log_probs, targets, blank)
    owner = np.maximum((path + 1) // 2 - 1, 0)
    silent = np.zeros(frames, dtype=bool) if silence_mask is None else np.array(silence_mask, dtype=bool)
    if min_silence_frames > 0:
        for a, b in runs(path % 2):
            if path[a] % 2 == 0 and b - a >= min_silence_frames:
                silent[a:b] = True
    spans = []
    for a, b in runs(np.where(silent, -1, owner)):
        token = -1 if silent[a] else int(owner[a])
        label = blank if token < 0 else targets[token]
        spans.append(Span(label, a, b, float(log_probs[a:b, label].mean()), token))
    if not silent.any() and len(spans) < len(targets):
        of_token, end, whole = {s.token: s for s in spans}, 0, []
        for k, label in enumerate(targets):
            whole.append(of_token.get(k, Span(label, end, end, float("-inf"), k)))
            end = whole[-1].end
        spans = whole
    return spans


def align_transcript(log_probs: np.ndarray, words: list[tuple[str, str]], vocabulary: dict[str, int], blank: int = 0, frame_rate: float = 50.0, min_silence_frames: int = 0, silence_mask: np.ndarray | None = None) -> list[tuple[str, float, float, str, float | None]]:
    """(tier, start, end, label, score) rows of the words, phones and syllables of one utterance.

    ``words``: (text, IPA).  Words and phones cover the utterance: pauses between
    words and silent phones have empty labels.  Syllables are found inside words.
    """
    tokens = [(w, t) for w, (_, ipa) in enumerate(words) for t in tokenize(ipa, vocabulary)]
    if not tokens:
        raise ValueError("the transcript has no phones")
    name = {i: p for p, i in vocabulary.items()}
    spans = forced_align(log_probs, [t for _, t in tokens], blank, min_silence_frames, silence_mask)
    phones = [("phones", s.first / frame_rate, s.end / frame_rate, "" if s.token < 0 else name[s.label], s.score) for s in spans]
    of_word: dict[int, list[tuple]] = {}
    for s, phone in zip(spans, phones, strict=True):
        if s.token >= 0:
            of_word.setdefault(tokens[s.token][0], []).append(phone)
    made, syllables, before = [], [], 0.0
    for w in sorted(of_word):
        own = of_word[w]
        start, end = min(p[1] for p in own), max(p[2] for p in own)
        if start > before + 1e-9:
            made.append(("words", before, start, "", None))
        made.append(("words", start, end, words[w][0], None))
        before = end
        if words[w][0]:
            syllables += [("syllables", own[a][1], own[b - 1][2], "".join(p[3] for p in own[a:b]), None) for a, b in syllabify([p[3] for p in own])]
    if phones[-1][2] > before + 1e-9:
        made.append(("words", before, phones[-1][2], "", None))
    return made + phones + syllables


def aligned(utterances: DataFrame, vocabulary: dict[str, int], blank: int = 0, frame_rate: float = 50.0, min_silence_frames: int = 0) -> DataFrame:
    """Tiers of many utterances, one a row: ``bundle_id``, ``emissions`` (array<array<double>> of log probabilities) and ``words`` (array of text, ipa).

    The rows (bundle_id, tier, start, end, label, score) are what a corpus takes as an alignment.
    """
    fields = {"bundle_id": pa.int64(), "tier": pa.string(), "start": pa.float64(), "end": pa.float64(), "label": pa.string(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, emissions, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                frames = emissions.values
                log_probs = np.asarray(frames.flatten(), dtype=float).reshape(len(frames), -1)
                rows = align_transcript(log_probs, [(w["text"], w["ipa"]) for w in words.as_py()], vocabulary, blank, frame_rate, min_silence_frames)
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * len(rows), pa.int64()), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(list(fields.values())[1:])]], list(fields))

    return utterances.select("bundle_id", "emissions", "words").mapInArrow(run, "bundle_id long, tier string, start double, end double, label string, score double")

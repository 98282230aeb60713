"""Parsers and writers of one file's content; Spark deals the files (see ``readers``)."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET

import numpy as np

EPS = 1e-9
SENTINEL = " {json:"


def decode_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, interleaved samples in [-1, 1]) of 16, 24, 32-bit integer or 32-bit float PCM."""
    rate, channels, bits, kind, at, body = 0, 0, 0, 0, 12, b""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        part = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", part[:16])
            if kind == 0xFFFE:
                kind = struct.unpack("<H", part[24:26])[0]
        elif name == b"data":
            body = part
        at += 8 + size + size % 2
    if (kind, bits) == (1, 16):
        return rate, channels, np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32768
    if (kind, bits) == (1, 32):
        return rate, channels, (np.frombuffer(body[: len(body) // 4 * 4], "<i4") / 2147483648).astype(np.float32)
    if (kind, bits) == (1, 24):
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        return rate, channels, ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) / 2147483648).astype(np.float32)
    if (kind, bits) == (3, 32):
        return rate, channels, np.frombuffer(body[: len(body) // 4 * 4], "<f4")
    raise ValueError(f"unsupported WAV format {kind} with {bits} bits")


def probe_wav(head: bytes, file_size: int) -> dict:
    """Rate, channels, frames and decoded bytes from the first bytes of a file."""
    at, found = 12, {}
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack("<I", head[at + 4 : at + 8])[0]
        if name == b"fmt ":
            _, channels, rate, _, block, _ = struct.unpack("<HHIIHH", head[at + 8 : at + 24])
            found = {"sample_rate": rate, "channels": channels, "block": block}
        elif name == b"data":
            frames = min(size, file_size - at - 8) // found["block"]
            return {"sample_rate": found["sample_rate"], "channels": found["channels"], "n_frames": frames, "decoded_bytes": 4 * frames * found["channels"]}
        at += 8 + size + size % 2
    raise ValueError("no audio data found")


def encode_wav(samples: np.ndarray, rate: int, channels: int = 1, floats: bool = False) -> bytes:
    """16-bit integers, or 32-bit floats, which keep what single precision holds and are not clipped."""
    body = samples.astype("<f4").tobytes() if floats else (np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes()
    each = 4 if floats else 2
    head = struct.pack("<HHIIHH", 3 if floats else 1, channels, rate, rate * channels * each, channels * each, 8 * each)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def encode_label(label: str, extra: str | None) -> str:
    return label if extra is None else f"{label}{SENTINEL}{extra}}}"


def decode_label(text: str) -> tuple[str, str | None]:
    at = text.rfind(SENTINEL)
    return (text[:at], text[at + len(SENTINEL) : -1]) if at >= 0 and text.endswith("}") else (text, None)


TEXTGRID_TOKEN = re.compile(r'"((?:[^"]|"")*)"|<(exists|absent)>|([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w\]])')


def parse_textgrid(text: str) -> list[dict]:
    """Rows (tier, kind, position, start, end, label) of the long or the short text form."""
    return rows_of(textgrid_columns(text))


def textgrid_columns(text: str) -> dict[str, list]:
    """The same as lists by column."""
    # both forms hold the same values in the same order; names and "=" of the long form are skipped
    text = re.sub(r"\[\d*\]", "", text.lstrip("﻿"))
    values = [quoted.replace('""', '"') if number == flag == "" else flag or float(number) for quoted, flag, number in TEXTGRID_TOKEN.findall(text)]
    if values[:2] != ["ooTextFile", "TextGrid"]:
        raise ValueError("not a TextGrid")
    out: dict[str, list] = {c: [] for c in ("tier", "kind", "position", "start", "end", "label")}
    at = 5  # both names, the time range and <exists>
    if values[4] != "exists":
        return out
    n_tiers, at = int(values[at]), at + 1
    for _ in range(n_tiers):
        kind, name, size = values[at], values[at + 1], int(values[at + 4])
        each = 3 if kind == "IntervalTier" else 2
        part = values[at + 5 : at + 5 + each * size]
        if len(part) < each * size:
            raise ValueError(f"tier {name!r} ends early")
        at += 5 + each * size
        start, end = list(map(float, part[::each])), list(map(float, part[each - 2 :: each]))
        out["tier"] += [name] * size
        out["kind"] += ["interval" if each == 3 else "point"] * size
        out["position"] += range(size)
        out["start"] += start
        out["end"] += end
        out["label"] += map(str, part[each - 1 :: each])
    return out


def gap_filled(rows: list[tuple[float, float, str]]) -> list[tuple[float, float, str]]:
    """Intervals in order with empty ones in the gaps; an overlap is an error."""
    out, at = [], 0.0
    for start, end, label in rows:
        if start < at - EPS:
            raise ValueError("overlapping intervals")
        if start > at + EPS:
            out.append((at, start, ""))
        out.append((start, end, label))
        at = end
    return out


def number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(float(x))


def write_textgrid(tiers: list[tuple[str, str, list[tuple[float, float, str]]]], duration: float) -> str:
    """Long text form of (name, kind, rows) tiers."""
    quote = lambda s: '"' + s.replace('"', '""') + '"'
    lines = ['File type = "ooTextFile"', 'Object class = "TextGrid"', "", "xmin = 0", f"xmax = {number(duration)}", "tiers? <exists>", f"size = {len(tiers)}", "item []:"]
    for k, (name, kind, rows) in enumerate(tiers, 1):
        is_interval = kind == "interval"
        rows = gap_filled(rows) if is_interval else rows
        lines += [f"    item [{k}]:", f'        class = "{"IntervalTier" if is_interval else "TextTier"}"', f"        name = {quote(name)}", "        xmin = 0", f"        xmax = {number(duration)}", f"        {'intervals' if is_interval else 'points'}: size = {len(rows)}"]
        for i, (start, end, label) in enumerate(rows, 1):
            if is_interval:
                lines += [f"        intervals [{i}]:", f"            xmin = {number(start)}", f"            xmax = {number(end)}", f"            text = {quote(label)}"]
            else:
                lines += [f"        points [{i}]:", f"            number = {number(start)}", f"            mark = {quote(label)}"]
    return "\n".join(lines) + "\n"


def parse_eaf(text: str) -> list[dict]:
    """Rows (tier, parent, kind, position, start, end, label, annotation, ref) of an ELAN document, tiers parents first.

    ``annotation`` is the document's name of an annotation, ``ref`` that of the one
    it hangs on.
    """
    return rows_of(eaf_columns(text))


def rows_of(columns: dict[str, list]) -> list[dict]:
    return [dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)]


def eaf_columns(text: str) -> dict[str, list]:
    """The same as lists by column."""
    root = ET.fromstring(text)
    slots = {s.get("TIME_SLOT_ID"): int(s.get("TIME_VALUE")) / 1000 for s in root.iter("TIME_SLOT") if s.get("TIME_VALUE") is not None}
    constraint = {t.get("LINGUISTIC_TYPE_ID"): t.get("CONSTRAINTS") for t in root.iter("LINGUISTIC_TYPE")}
    tiers = {t.get("TIER_ID"): t for t in root.iter("TIER")}
    ordered: dict[str, None] = {}

    def place(name: str, path: tuple[str, ...]) -> None:
        if name in path or name not in tiers:
            raise ValueError(f"tier {name!r} has a missing parent or is its own ancestor")
        parent = tiers[name].get("PARENT_REF")
        if parent is not None:
            place(parent, (*path, name))
        ordered.setdefault(name)

    for name in tiers:
        place(name, ())
    out: dict[str, list] = {c: [] for c in ("tier", "parent", "kind", "position", "start", "end", "label", "annotation", "ref")}
    for name in ordered:
        tier = tiers[name]
        timed_ones, references = list(tier.iter("ALIGNABLE_ANNOTATION")), list(tier.iter("REF_ANNOTATION"))
        n, none = len(timed_ones) + len(references), [None] * len(references)
        start = [slots.get(a.get("TIME_SLOT_REF1")) for a in timed_ones]
        end = [slots.get(a.get("TIME_SLOT_REF2")) for a in timed_ones]
        timed = [(s, e) for s, e in zip(start, end, strict=True) if s is not None and e is not None]
        if constraint.get(tier.get("LINGUISTIC_TYPE_REF")) == "Symbolic_Association" or (n and not timed):
            kind = "reference"
        else:
            kind = "point" if timed and all(e - s <= 0.002 for s, e in timed) else "interval"
        out["tier"] += [name] * n
        out["parent"] += [tier.get("PARENT_REF")] * n
        out["kind"] += [kind] * n
        out["position"] += range(n)
        out["start"] += start + none
        out["end"] += end + none
        out["label"] += [a.findtext("ANNOTATION_VALUE") or "" for a in (*timed_ones, *references)]
        out["annotation"] += [a.get("ANNOTATION_ID") for a in (*timed_ones, *references)]
        out["ref"] += [None] * len(timed_ones) + [a.get("ANNOTATION_REF") or None for a in references]
    return out


ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
ATTRIBUTE_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


def write_eaf(tiers: list[tuple[str, str | None, list[tuple]]]) -> str:
    """An ELAN document of (name, parent, rows) tiers; points last one millisecond.

    Rows are (start, end, label); those of a reference tier are (None, None, label,
    annotation it hangs on).  Annotations are named a1, a2, ... in order.
    """
    order: list[str] = []
    made: list[str] = []
    n, symbolic = 0, False
    for name, parent, rows in tiers:
        references = any(len(r) == 4 for r in rows)
        symbolic |= references
        under = f' PARENT_REF="{parent.translate(ATTRIBUTE_ESCAPES)}"' if parent else ""
        head = f'<TIER LINGUISTIC_TYPE_REF="{"symbolic" if references else "default"}" TIER_ID="{name.translate(ATTRIBUTE_ESCAPES)}"{under}'
        made.append(f"{head}>" if rows else f"{head} />")
        for row in rows:
            n += 1
            value = f"<ANNOTATION_VALUE>{row[2].translate(ESCAPES)}</ANNOTATION_VALUE>" if row[2] else "<ANNOTATION_VALUE />"
            if references:
                made.append(f'<ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a{n}" ANNOTATION_REF="{(row[3] or "").translate(ATTRIBUTE_ESCAPES)}">{value}</REF_ANNOTATION></ANNOTATION>')
            else:
                start, end = row[:2]
                a, b = f"ts{2 * n - 1}", f"ts{2 * n}"
                order.append(f'<TIME_SLOT TIME_SLOT_ID="{a}" TIME_VALUE="{round(start * 1000)}" /><TIME_SLOT TIME_SLOT_ID="{b}" TIME_VALUE="{round((end if end > start else start + 0.001) * 1000)}" />')
                made.append(f'<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a{n}" TIME_SLOT_REF1="{a}" TIME_SLOT_REF2="{b}">{value}</ALIGNABLE_ANNOTATION></ANNOTATION>')
        if rows:
            made.append("</TIER>")
    slots = f"<TIME_ORDER>{''.join(order)}</TIME_ORDER>" if order else "<TIME_ORDER />"
    kinds = '<LINGUISTIC_TYPE LINGUISTIC_TYPE_ID="default" TIME_ALIGNABLE="true" />' + '<LINGUISTIC_TYPE LINGUISTIC_TYPE_ID="symbolic" TIME_ALIGNABLE="false" CONSTRAINTS="Symbolic_Association" />' * symbolic
    return f'<ANNOTATION_DOCUMENT AUTHOR="" DATE="1970-01-01T00:00:00+00:00" FORMAT="2.8" VERSION="2.8"><HEADER MEDIA_FILE="" TIME_UNITS="milliseconds" />{slots}{"".join(made)}{kinds}</ANNOTATION_DOCUMENT>'

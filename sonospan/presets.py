"""Named parameter sets of the kernels: built-in ones, and a user's as JSON files."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Preset:
    id: str
    kind: str  # mfcc, formants or pitch
    version: str = "1"
    based_on: str = ""
    params: dict = field(default_factory=dict)


BUILT_IN = [
    *(Preset(m, "mfcc", based_on=m, params={"method": m}) for m in ("librosa", "kaldi", "praat")),
    *(Preset(f"formants-{m}", "formants", based_on=m, params={"method": m}) for m in ("burg", "autocorrelation")),
    *(Preset(m, "pitch", based_on=m, params={"method": m}) for m in ("boersma", "autocorrelation", "windowed", "yin", "pyin", "swipe")),
]


def valid_id(name: str) -> bool:
    return re.fullmatch(r"[a-z0-9]+(?:[-_][a-z0-9]+)*", name) is not None


class PresetStore:
    def __init__(self, root: str, kind: str):
        self.root, self.kind = Path(root), kind

    def list(self) -> list[Preset]:
        """Built-in presets first, then the user's by id."""
        mine = [Preset(**json.loads(p.read_text())) for p in sorted(self.root.glob(f"{self.kind}.*.json"))]
        return [p for p in BUILT_IN if p.kind == self.kind] + mine

    def get(self, name: str) -> Preset | None:
        return next((p for p in self.list() if p.id == name), None)

    def save(self, preset: Preset) -> Path:
        if not valid_id(preset.id) or any(p.id == preset.id and p.kind == preset.kind for p in BUILT_IN):
            raise ValueError(f"{preset.id!r} is reserved or not a valid id")
        self.root.mkdir(parents=True, exist_ok=True)
        path = self.root / f"{self.kind}.{preset.id}.json"
        path.write_text(json.dumps(asdict(preset), indent=1))
        return path

    def delete(self, name: str) -> bool:
        path = self.root / f"{self.kind}.{name}.json"
        found = path.exists()
        path.unlink(missing_ok=True)
        return found

"""Splitting text into pre-tokens exactly as the two public byte-pair tokenizers do.

A pre-token is encoded on its own, so its ids depend on nothing around it and
can be looked up.  Pieces holding a character on which this Unicode database and
the tokenizer's differ, and whole texts holding a special string, are left to the
tokenizer itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import regex

WS = r"\p{White_Space}"
BYTE_PATTERN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|{WS}+(?!\P{{White_Space}})|{WS}+"
)
WORD_PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WS}\p{{L}}\p{{N}}]+")
#: The same splits written for texts of ASCII and Latin letters only, for which the plain engine is several times faster.
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NOT_LATIN = re.compile(f"[^\\t\\n\\r -~{LATIN}]")
LATIN_BYTE_PATTERN = re.compile(rf" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t\n\r 0-9{LATIN}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
LATIN_WORD_PATTERN = re.compile(rf"[{LATIN}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t\n\r 0-9{LATIN}]+")
#: Code points that newer Unicode versions classify anew; all above the basic plane are left to the library too.
UNSURE = regex.compile("[՘֋֌࢏౜೜₏₝-₟꟎-ꟿ꭬꭭\U00010000-\U0010ffff]")
#: A single space between two non-spaces: no pre-token of either pattern reaches across its left side.
CUT = regex.compile(rf"(?<=\P{{White_Space}}) (?=\P{{White_Space}})")
PIECE_CHARS = 1 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a worker process, read once."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive parts of about ``size`` characters, so that a very long text needs little memory."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def normalized_words(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is no special case)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def byte_chars() -> dict[int, str]:
    """Byte -> the letter that stands for it in a byte-level vocabulary: printable bytes stay, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


def model_ids(tok, token: str) -> list[int]:
    """Ids of one pre-token, from the model alone."""
    return [t.id for t in tok.model.tokenize(token.encode().decode("latin-1").translate(BYTE_CHARS))]


class TwoTier(dict):
    """Pre-token -> value: a fixed tier given at the start, and a bounded tier of values worked out here.

    When the second tier is full it is emptied; results never depend on that.
    """

    def __init__(self, frequent: dict, make, room: int = 400_000):
        super().__init__(frequent)
        self._frequent, self._make, self._room = frequent, make, room + len(frequent)

    def __missing__(self, token: str):
        if len(self) >= self._room:
            self.clear()
            self.update(self._frequent)
        value = self[token] = self._make(token)
        return value

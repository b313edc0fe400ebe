"""Token ids of whole texts, inside tasks.

The vocabulary's normaliser lower-cases and its pattern splits a text into pieces before
anything else, none of them over white space, so the ids of a text are those of its
pieces in a row. Texts of characters up to U+017F (where the pattern's classes are spelt
out) are split here; in other texts this holds for each blank-separated word, and words
with further characters are pieces as they are. Texts that hold a special token's string,
and vocabularies of another make, go to the library whole or word by word.

Each Python worker remembers the ids of pieces in two tables of bounded size: when the
younger is full it becomes the older, and pieces found there move up, so those in use stay.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
import unicodedata

END_ID = 1
#: Pieces in a table; longer pieces are encoded but not remembered.
MAX_PIECES = 400_000
MAX_CHARS = 64
WIDE = re.compile("[^\x00-\u017f]")
BLANK = re.compile("[\x20\x09-\x0d]+")

_encoders: dict[str, "WordEncoder"] = {}


def _latin_pattern(made: dict) -> re.Pattern | None:
    """The vocabulary's own split pattern with its classes spelt out for U+0000-U+017F, if
    it lower-cases, and splits by one pattern whose matches are the pieces."""
    lower = any(x["type"] == "Lowercase" for x in (made["normalizer"] or {}).get("normalizers", []))
    split = [x for x in (made["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed"]
    if not lower or len(split) != 1:
        return None
    chars = [chr(c) for c in range(0x180)]
    for name, members in (("\\p{L}", [c for c in chars if c.isalpha()]), ("\\p{N}", [c for c in chars if unicodedata.category(c)[0] == "N"]), ("\\s", ["\t", "\n", "\x0b", "\x0c", "\r", " ", "\x85", "\xa0"])):
        own = (split[0]["pattern"]["Regex"] if name == "\\p{L}" else own).replace(name, "".join(map(re.escape, members)))
    return re.compile(own)


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in made["added_tokens"]]
        self.pattern = _latin_pattern(made)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        split = [self._pieces(t) if t else [] for t in texts]
        new: set[str] = set()
        for pieces in split:
            new.update(pieces)
        long = self._learn(new)
        found = self.young if not long else {**self.young, **long}
        return [b"".join(map(found.__getitem__, pieces)) for pieces in split]

    def _pieces(self, text: str) -> list[str]:
        if any(x in text for x in self.special):
            return [text]
        if self.pattern and not WIDE.search(text):
            return self.pattern.findall(text.lower())
        words = [w for w in BLANK.split(text) if w]
        if not self.pattern:
            return words
        return [p for w in words for p in ([w] if WIDE.search(w) else self.pattern.findall(w.lower()))]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Puts the pieces into the young table; returns those too long for it."""
        if len(self.young) > MAX_PIECES:
            self.old, self.young = self.young, {}
        young, old, long = self.young, self.old, {}
        pieces.difference_update(young)
        if old:
            kept = pieces & old.keys()
            young.update({p: old[p] for p in kept})
            pieces -= kept
        fresh = list(pieces)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = array.array("I", e.ids)
                if sys.byteorder == "big":
                    ids.byteswap()
                (long if len(p) > MAX_CHARS else young)[p] = ids.tobytes()
        return long


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(column, most_bytes: int = 4 << 20):
    """(first, last) row ranges of an Arrow string column whose texts hold about
    ``most_bytes`` bytes (a longer text stands alone), so that memory is bounded."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(column).to_pylist()
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > most_bytes:
            yield first, i
            first, held = i, 0
        held += (n or 0) + 64
    if first < len(sizes):
        yield first, len(sizes)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

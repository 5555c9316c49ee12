"""Whole-text encoding with the `tokenizers` library, with a memory of text pieces that is exact.

A text is cut at single blanks between other characters, and such a piece into the units of the tokenizer's own
splitting rule. No token crosses those cuts, so ids of pieces are encoded by the library once and kept as bytes
(little-endian unsigned 32-bit); the memory is bounded and lives as long as the Python worker. `Encoder.batch` cuts many
texts into units at once, by the classes of their characters, and looks every different unit up once.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import regex

#: The splitting rules of the two vocabularies (the second one after lower-casing).
SPLITS = {
    "byte_bpe": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_bpe": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: Text below this character has the same classes in every Unicode version; the rest goes to the library as it is.
_LATIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the vocabularies: printable Latin-1 characters for themselves, the other bytes
    for the characters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


#: A blank that is sure to begin a new token.
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: White space besides the common kinds.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
LIMIT = 300_000
_LETTER, _NUMBER, _BLANK, _OTHER = range(4)
#: What follows an apostrophe that begins a unit of its own, by its length.
_ENDINGS = {1: [b"s", b"t", b"m", b"d"], 2: [b"re", b"ve", b"ll"]}


def _classes() -> np.ndarray:
    """The class of every character below _LATIN_END in the splitting rules."""
    out = np.full(ord(_LATIN_END), _OTHER, np.uint8)
    for kind, rule in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_BLANK, r"[\t-\r \x85\xa0]")):
        out[[c for c in range(len(out)) if regex.match(rule, chr(c))]] = kind
    return out


_CLASSES = _classes()


def unit_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the units of the byte_bpe rule begin in UTF-8 texts of characters below _LATIN_END, one behind the other, none
    of them empty; `ends` are the ends of the texts."""
    kind = _CLASSES[raw]  # of ASCII; letters of two bytes follow
    lead = np.flatnonzero(raw >= 0xC0)
    kind[lead] = kind[lead + 1] = _CLASSES[((raw[lead].astype(np.int32) & 0x1F) << 6) | (raw[lead + 1] & 0x3F)]
    first = np.zeros(len(raw) + 1, bool)
    first[0] = first[ends] = True
    blank = kind == _BLANK
    start = first.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    # The last white space before other characters begins a unit; a blank takes them along.
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:-1])
    at = last - (raw[last] < 0xC0) * (raw[last] >= 0x80)
    start[at] = True
    start[last[raw[last] == 32] + 1] = False
    # An apostrophe that is a unit takes the endings along, and the letters behind them begin another one.
    for size, endings in _ENDINGS.items():
        at = np.flatnonzero((raw == 39) & start[:-1])
        at = at[at + size < len(raw)]
        at = at[start[at + 1] & ~first[at + 1] & ~first[at + size]]
        same = np.zeros(len(at), bool)
        for ending in endings:
            same |= np.logical_and.reduce([raw[at + 1 + i] == c for i, c in enumerate(ending)])
        at = at[same]
        start[at + 1] = False
        start[at + 1 + size] = True
    return np.flatnonzero(start[:-1])


class _Memory(dict):
    """piece -> bytes of its ids. When full it starts anew and takes over what is still in use from the entries before."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= LIMIT:
            self.before = dict(self)
            self.clear()
        out = self.before.get(piece)
        if out is None:
            out = self.encode(piece)
        self[piece] = out
        return out


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A text that holds one of these (end of text and the like) is left to the library, which gives them their own ids.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = next((k for k in SPLITS if os.path.basename(path).startswith(k)), None)
        self.blanks = kind == "byte_bpe"
        split = regex.compile(SPLITS[kind]).findall if kind else None
        model, letters = self.tokenizer.model, _byte_letters()

        def whole(piece: str) -> bytes:
            return np.asarray(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, "<u4").tobytes()

        def unit(part: str) -> bytes:
            # What the library's own splitting hands to its model: a unit of the rule, its bytes as letters.
            if len(part) > 2000:
                return whole(part)
            if part.isascii() and part.strip(" ").isalnum():
                shown = part.replace(" ", letters[32])
            else:
                shown = part.encode().decode("latin-1").translate(letters)
            return array("I", [t.id for t in model.tokenize(shown)]).tobytes()

        units = _Memory(unit)

        def pieces(piece: str) -> bytes:
            if len(piece) > 2000 or (not piece.isascii() and max(piece) >= _LATIN_END):
                return whole(piece)
            if not self.blanks:
                # Below _LATIN_END composing changes nothing and letters have one lower case.
                piece = piece.lower()
            if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
                return units[piece]
            return b"".join([units[u] for u in split(piece)])

        self.memory = _Memory(pieces) if kind else None
        self.after_blank = _Memory(lambda piece: pieces(" " + piece))
        self.whole, self.units = whole, units

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.memory is None or any(t in text for t in self.added):
            return self.whole(text)
        if not self.blanks:
            return b"".join(map(self.memory.__getitem__, text.split(" ")))
        if _plain(text):
            parts = text.split(" ")
            parts[0] = self.memory[parts[0]]
            parts[1:] = map(self.after_blank.__getitem__, parts[1:])
            return b"".join(parts)
        if "\x00" in text:
            return self.whole(text)
        return b"".join(map(self.memory.__getitem__, _CUT.sub("\x00 ", text).split("\x00")))


    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one behind the other, and their numbers."""
        cut = np.array([bool(t) and self.blanks and not any(a in t for a in self.added) for t in texts], bool)
        while True:
            encoded = [t.encode() for t, c in zip(texts, cut.tolist(), strict=True) if c]
            data, ends = b"".join(encoded), np.cumsum([len(x) for x in encoded], dtype=np.int64)
            raw = np.frombuffer(data, np.uint8)
            unknown = np.flatnonzero(_unknown(raw))
            if not len(unknown):
                break
            cut[np.flatnonzero(cut)[np.searchsorted(ends, unknown, "right")]] = False
        starts = unit_starts(raw, ends) if data else ends
        offsets = pa.py_buffer(np.append(starts, len(data)))
        units = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(data)).dictionary_encode()
        # Different units first, then the texts that are not cut, each as one.
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.units.__getitem__, names))
        others = np.flatnonzero(~cut)
        per = np.ones(len(texts), np.int64)
        per[cut] = np.diff(np.searchsorted(starts, ends), prepend=0)
        place = np.empty(int(per.sum()), np.int64)
        begins = np.cumsum(per) - per
        alone = np.zeros(len(place), bool)
        alone[begins[others]] = True
        place[~alone] = units.indices.to_numpy()
        place[alone] = np.arange(len(values), len(values) + len(others))
        values += [self(texts[i]) for i in others.tolist()]
        flat, counts = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4
        own = counts[place]
        stops = np.cumsum(own)
        ids = flat[np.arange(own.sum()) + np.repeat((np.cumsum(counts) - counts)[place] - (stops - own), own)]
        return ids, np.add.reduceat(own, begins) if len(texts) else per


def _unknown(raw: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 that begin a character of a class not known here: from _LATIN_END on, and U+001C to U+001F."""
    out = (raw >= 0xCA) | (raw - np.uint8(0x1C) < 4)
    out[:-1] |= (raw[:-1] == 0xC9) & (raw[1:] >= 0x90)
    return out


def _plain(text: str) -> bool:
    """Whether every blank stands alone between other characters that are not white space."""
    if text[0] == " " or text[-1] == " " or any(c in text for c in ("  ", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")):
        return False
    return text.isascii() and not _SEPARATORS.search(text) or not _SPACE.search(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """The file of a public vocabulary on this machine (executors resolve it on theirs)."""
    import public_tokenizers

    return public_tokenizers.path(name)

"""Segments of text for a byte-level BPE tokenizer, encoded once each and looked up after that.

Every text is cut into *pieces* whose token ids don't depend on their neighbours.  The pre-tokenizer's pattern takes a run of
white space as its last character (a blank goes with the next word) and the rest, so a text may be cut before a white-space
character if the character before it or the one behind it isn't white space.  Texts are cut before each such blank, tab and
line end, whatever their alphabet.  A piece that isn't known yet goes through the tokenizer: a word of common letters straight to its BPE
model, any other piece through the whole library.  Special strings are cut out first, as the library does.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release_arrow

#: Entries that a worker's cache holds at most before it is emptied, and characters of the longest piece that is kept.
CACHE_ENTRIES, KEPT_LENGTH = 1_500_000, 120

#: The characters that the pattern's ``\s`` takes.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A cut character inside a run of white space, where no cut is allowed.
INNER = re.compile(rf"[ \n\t](?<=[{SPACE}].)(?=[{SPACE}]|\Z)", re.DOTALL)
MAYBE_INNER = f"[{SPACE}][ \\n\\t]([{SPACE}]|\\z)"
#: Words of Latin, Greek or Cyrillic letters, which the pattern takes as one pre-token for certain.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ſΑ-ΡΣ-Ωα-ωА-яЁё]+")
#: Pieces of printed ASCII, and the pattern for them.
PRINTED = re.compile("[!-~]+")
PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")
#: Marks that are a pre-token of their own behind a word.
MARKS = ".,;:!?"
#: Stand-ins: before the first piece of a text, which no blank precedes; for a blank, line end and tab where no cut is allowed.
OPENING, HELD = "\x01", {" ": "\x02", "\n": "\x03", "\t": "\x04"}
RELEASED = str.maketrans({v: k for k, v in HELD.items()})
STAND_INS = (OPENING, *HELD.values())

#: The pre-tokenizer whose pattern the cuts rely on.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer; ValueError if its pre-tokens aren't those that the cuts rely on."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    rule = spec.get("pre_tokenizer") or {}
    if any(rule.get(k) != v for k, v in PRE_TOKENIZER.items()) or spec.get("normalizer") is not None:
        raise ValueError(f"{path}: not a byte-level tokenizer with its own pattern and without a normalizer")
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if spec["model"].get(k)]
    if spec["model"].get("type") != "BPE" or odd:
        raise ValueError(f"{path}: not a plain BPE model {odd}")
    if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that take in their surroundings")
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 bytes stay, others follow from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceCache(dict):
    """piece -> value of its ids; see ``split``.  ``first`` is a table that is asked before the worker's own entries.

    A word with one mark behind it, or a line end before it, is put together from the word, which is known more often.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], total: Callable[[list], object]):
        super().__init__()
        whole = tokenizer(path)
        self.tokenize, self.encode, self.value, self.total, self.first = whole.model.tokenize, whole.encode, value, total, {}
        self.letters = byte_letters()
        self.blank = " ".translate(self.letters)

    def word(self, word: str, blank: bool = True):
        mapped = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return self.value([t.id for t in self.tokenize(self.blank + mapped if blank else mapped)])

    def segment(self, text: str):
        return self.value(self.encode(text, add_special_tokens=False).ids)

    def __missing__(self, piece: str):
        found = self.first.get(piece)
        if found is not None:
            return found
        if piece.isalpha() and (piece.isascii() or WORD.fullmatch(piece)):
            found = self.word(piece)
        elif piece[-1:] in MARKS and WORD.fullmatch(piece, 0, len(piece) - 1):
            found = self.total([self[piece[:-1]], self.word(piece[-1], False)])
        elif piece[:1] in "\n\t" and WORD.fullmatch(piece, 1):
            found = self.total([self.segment(piece[0]), self.word(piece[1:], False)])
        elif PRINTED.fullmatch(piece):
            found = self.total([self.word(p[1:]) if p[0] == " " else self.word(p, False) for p in PRE_TOKEN.findall(" " + piece)])
        else:
            text = piece.translate(RELEASED)
            found = self.segment(text[1:] if piece[:1] == OPENING else text if piece[:1] in ("\n", "\t") else " " + text)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = found
        return found


def split(texts: list[str]) -> pa.ListArray:
    """The pieces of texts without stand-ins and special strings.

    The first piece stands behind ``OPENING``, others without the blank before them or with the line end or tab before them; an
    empty piece is a blank alone.
    """
    held = pa.array(texts, pa.string())
    for i in np.flatnonzero(pc.match_substring_regex(held, MAYBE_INNER).to_numpy(zero_copy_only=False)):
        texts[i] = INNER.sub(lambda m: HELD[m[0]], texts[i])
    marked = pa.array([OPENING + t for t in texts], pa.string())
    for mark in "\n\t":
        marked = pc.replace_substring(marked, mark, " " + mark)
    return pc.split_pattern(marked, " ")


class Plan:
    """Texts as parts that are cut into pieces, special strings between them, and texts that hold a stand-in themselves."""

    def __init__(self, texts: list[str], special: dict[str, int]):
        self.parts: list[str] = []
        self.whole: list[int] = []
        self.mixed: list[tuple[int, int, list[int]]] = []
        self.first = np.zeros(len(texts), np.int64)
        cut = re.compile("|".join(f"({re.escape(s)})" for s in sorted(special, key=len, reverse=True))) if special else None
        for i, text in enumerate(texts):
            self.first[i] = len(self.parts)
            if any(x in text for x in STAND_INS):
                self.whole.append(i)
                self.parts.append("")
            elif cut and any(x in text for x in special):
                between = [m[0] for m in cut.finditer(text)]
                self.mixed.append((i, len(self.parts), [special[s] for s in between]))
                at = 0
                for m in cut.finditer(text):
                    self.parts.append(text[at : m.start()])
                    at = m.end()
                self.parts.append(text[at:])
            else:
                self.parts.append(text)


class Encoder:
    """Token ids of batches of whole texts, or only how many; every distinct piece of a batch is looked up once."""

    def __init__(self, path: str, dtype: str | None = None):
        self.library, self.dtype = tokenizer(path), dtype
        self.cache = PieceCache(path, (lambda ids: array(dtype, ids).tobytes()) if dtype else len, b"".join if dtype else sum)
        self.special = special_strings(path)

    def _library_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _values(self, parts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Values of distinct pieces, each piece's place among them, and the pieces' limits per part."""
        lists = split(parts)
        coded = lists.flatten().dictionary_encode()
        values = list(map(self.cache.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        return values, coded.indices.to_numpy(), lists.offsets.to_numpy()

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        texts = [t or "" for t in texts]
        plan = Plan(texts, self.special)
        values, at, limits = self._values(plan.parts)
        sizes = np.diff(np.r_[0, np.cumsum(np.array(values, np.int64)[at])][limits])
        out = sizes[plan.first]
        for i, first, between in plan.mixed:
            out[i] = sizes[first : first + len(between) + 1].sum() + len(between)
        for i in plan.whole:
            out[i] = len(self._library_ids(texts[i]))
        return out

    def ids(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids of each text and ``end``, as little-endian integers of the encoder's type."""
        texts = [t or "" for t in texts]
        plan = Plan(texts, self.special)
        values, at, limits = self._values(plan.parts)
        width = np.dtype(self.dtype).itemsize
        n = np.fromiter(map(len, values), np.int32, len(values)) // width
        flat = np.frombuffer(b"".join(values), self.dtype)
        sizes = n[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        shift = (np.cumsum(n, dtype=np.int64) - n)[at] - (ends - sizes)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, sizes)].tobytes()
        cuts = (np.r_[0, ends][limits] * width).tolist()
        parts = [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        last = array(self.dtype, [end]).tobytes()
        out = [parts[i] + last for i in plan.first]
        for i, first, between in plan.mixed:
            out[i] = parts[first] + b"".join(array(self.dtype, [s]).tobytes() + parts[first + k] for k, s in enumerate(between, 1)) + last
        for i in plan.whole:
            out[i] = array(self.dtype, self._library_ids(texts[i])).tobytes() + last
        return out


def special_strings(path: str) -> dict[str, int]:
    """Strings that the library takes out of a text before anything else, and their ids."""
    return {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(maxsize=4)
def worker_encoder(path: str, dtype: str | None = None) -> Encoder:
    """This Python worker's encoder, whose cache lives as long as the worker, or until ``release_encoders``."""
    return Encoder(path, dtype)


def release_encoders() -> None:
    """Empties this worker's encoders: a worker serves later steps too, which need the memory."""
    worker_encoder.cache_clear()
    tokenizer.cache_clear()
    release_arrow()

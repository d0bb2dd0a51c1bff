"""Encoding whole texts chunk by chunk, each distinct chunk once.

A subword tokenizer splits a text before it merges, so a text can be cut at
places where that split always falls and the cut parts encoded apart. Parts
repeat, and a bounded cache keeps their ids. Where a text has white space that
makes a cut unsafe, the whole text is encoded at once.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex

#: A space inside or at the end of a run of white space: a cut there could split one token.
UNSAFE_SPACE = re.compile(r"\s (?!\S)")
#: Characters that Python counts as white space and the tokenizers' patterns do not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Entries of each generation of a cache.
CACHE = 400_000
#: Characters that are encoded in one round, whatever the size of a batch.
ROUND_CHARS = 2_000_000


_SPACE_PAIRS = [" " + c for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]


def _plainly_safe(text: str) -> bool:
    """ASCII text in which no space stands before white space or the end: a quick test that needs no pattern."""
    return text.isascii() and text[-1:] != " " and not any(p in text for p in _SPACE_PAIRS)


class Remembered(dict):
    """Values made once for each key. When it is full the entries become the old generation, and those used again move back."""

    def __init__(self, make: Callable[[str], bytes], most: int = CACHE) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: Marks that are a token of their own after a word of letters.
ENDS = ".,;:!?"


class ChunkEncoder:
    """Encodes texts with a coder, whose results are the bytes of 32-bit integers.

    kept: a space opens the next word; otherwise white space is dropped.
    letters(w): ids of ASCII letters after a kept space, or between dropped
    ones. word(p): ids of a piece of the split. pieces(t): the split of a text,
    or None if the split alone does not settle it. encode(t): ids of any text.
    """

    def __init__(self, coder, cache: int = CACHE) -> None:
        self.coder, self.kept = coder, coder.kept
        self.first = Remembered(coder.encode, cache // 8)
        self.rest = Remembered(self._after_space if coder.kept else self._between_spaces, cache)
        self.parts = Remembered(coder.word, cache // 8)
        self.ends = {c: coder.encode(c) for c in ENDS}

    def _after_space(self, w: str) -> bytes:
        if w.isalpha():  # letters only: one word of the split
            return self.coder.letters(w) if w.isascii() else self.coder.word(" " + w)
        if w[-1:] in self.ends and w[:-1].isalpha():
            return self.rest[w[:-1]] + self.ends[w[-1]]
        found = self.coder.pieces(" " + w)
        if found is None:
            return self.coder.encode(" " + w)
        return b"".join([self.rest[p[1:]] if p[0] == " " and p[1:].isalpha() else self.parts[p] for p in found])

    def _between_spaces(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            return self.coder.letters(w.lower())
        if w[-1] in self.ends and w[:-1].isalpha():
            return self.rest[w[:-1]] + self.ends[w[-1]]
        found = self.coder.pieces(w)
        if found is None:
            return self.coder.encode(w)
        if len(found) == 1:
            return self.coder.word(found[0])
        return b"".join([self.rest[p] if p.isascii() and p.isalpha() else self.parts[p] for p in found])

    def rest_a_while(self) -> None:
        """At a task's end: the worker that waits for the next one keeps the present generation only."""
        for kept in (self.first, self.rest, self.parts):
            kept.old = {}

    def encode_text(self, text: str) -> bytes:
        if not self.kept:
            return self.coder.encode(text) if ODD_SPACE.search(text) else b"".join(map(self.rest.__getitem__, text.split()))
        if not _plainly_safe(text) and UNSAFE_SPACE.search(text):
            return self.coder.encode(text)
        parts = text.split(" ")
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of each text in them)."""
        out = list(map(self.encode_text, texts))
        ends = np.zeros(len(out) + 1, np.int64)
        np.cumsum([len(b) // 4 for b in out], out=ends[1:])
        return np.frombuffer(b"".join(out), np.int32), ends


def rounds(texts: list[str], most: int = ROUND_CHARS) -> Iterable[slice]:
    """Slices of a batch that hold about ``most`` characters each; a longer text is a slice of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


#: The patterns by which the two kinds of vocabulary file split a text into words.
SPLIT_KEPT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_DROPPED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: What a vocabulary file must say of its split for the code here to stand for it.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
SPLITS = {
    "kept": (None, BYTES | {"use_regex": True}),
    "dropped": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT_DROPPED}, "behavior": "Removed", "invert": True}, BYTES | {"use_regex": False}]},
    ),
}


def unassigned(chunk: str) -> bool:
    """Whether a code point has no meaning yet: tables of different age disagree on those."""
    return not chunk.isascii() and "Cn" in map(unicodedata.category, chunk)


def check_split(path: str, spaces: str) -> dict:
    """The vocabulary file's contents, if it normalizes and splits text as ``spaces`` says; an error otherwise."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec["normalizer"], spec["pre_tokenizer"]) != SPLITS[spaces]:
        raise ValueError(f"{path} does not split text as '{spaces}' expects: {spec['normalizer']}, {spec['pre_tokenizer']}")
    return spec


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *[t["id"] for t in spec.get("added_tokens", [])]])


class LibraryWords:
    """Encodes chunks with the tokenizers library: its model sees each distinct word once.

    Words come from the vocabulary file's own split pattern. A chunk that the
    pattern alone does not settle (special tokens, unusual case or composition)
    goes through the library whole.
    """

    def __init__(self, path: str, spaces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_split(path, spaces)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenize = self.tokenizer.model.tokenize
        self.ids = [array("i", [i]).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.kept = spaces == "kept"
        self.split = regex.compile(SPLIT_KEPT if self.kept else SPLIT_DROPPED).findall
        self.names = byte_names()

    def letters(self, word: str) -> bytes:
        """ASCII letters after a space that is kept, or between spaces that are dropped: they stand for themselves."""
        ids = self.ids
        return b"".join([ids[t.id] for t in self.tokenize("\u0120" + word if self.kept else word)])

    def word(self, word: str) -> bytes:
        ids = self.ids
        return b"".join([ids[t.id] for t in self.tokenize("".join(map(self.names.__getitem__, word.encode())))])

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def fold(self, chunk: str) -> str | None:
        """Composed and in lower case, as the library does it; None where Python's lower case differs."""
        if chunk.isascii():
            return chunk.lower()
        return None if "\u03a3" in chunk else unicodedata.normalize("NFC", chunk).lower()

    def pieces(self, chunk: str) -> list[str] | None:
        if "<|" in chunk or len(chunk) > 2000 or unassigned(chunk):
            return None
        text = chunk if self.kept else self.fold(chunk)
        return None if text is None else self.split(text)

    def encode(self, chunk: str) -> bytes:
        found = self.pieces(chunk)
        return self.whole(chunk) if found is None else b"".join(map(self.word, found))


_LOADED: dict[tuple[str, str], ChunkEncoder] = {}


def library_encoder(path: str, spaces: str) -> ChunkEncoder:
    """The tokenizers library's encoder of a vocabulary file; one for each Python worker."""
    if (path, spaces) not in _LOADED:
        _LOADED[path, spaces] = ChunkEncoder(LibraryWords(path, spaces))
    return _LOADED[path, spaces]


def forget_encoders() -> None:
    """Drop the encoders of this Python worker; the next task that needs one loads it again."""
    _LOADED.clear()


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task, and its executor counts what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task that holds nothing for other operators: unless it ``encodes`` it drops their encoders first, at its end it gives memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget_encoders()
            give_back()
        yield from run(batches)
        give_back()

    return whole

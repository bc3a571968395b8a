"""Token ids of whole texts by a public byte-level BPE vocabulary, remembered by stretch of text between blanks.

A blank between two characters that are not white space always starts a token of this kind of pre-tokenizer, so the
stretches in front of such blanks can be encoded each by itself. Texts are gibberish or natural language alike: most
stretches come again, and only new ones run the tokenizers library. Texts where a blank meets other white space, or that
hold a special token's string, go through the library as a whole. The memory for stretches is bounded.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import resident

#: Every character that is white space to the pre-tokenizer or to Python, but for blank and line feed.
_ODD_SPACE = re.compile("[%s]" % "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"))
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose Unicode class all versions agree on.
_SETTLED = re.compile(r"[\n\x20-\x7e\xa1-ɏ]*\Z")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free character from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


#: What this subpackage does itself in a tokenizer's place (fixed values of the library's format).
BYTE_STEPS = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}}


def _holds(got, wanted) -> bool:
    if isinstance(wanted, dict):
        return isinstance(got, dict) and all(_holds(got.get(k), w) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(got, list) and len(got) == len(wanted) and all(map(_holds, got, wanted))
    return got == wanted


def expect(path: str, made: dict, steps: dict) -> None:
    """Raise unless the tokenizer file has the given steps, since with others the ids would be wrong without a word."""
    for name, wanted in steps.items():
        got = made.get(name)
        # Files of older versions leave out what is not set.
        if not _holds({"ignore_merges": False, "byte_fallback": False, **got} if name == "model" and isinstance(got, dict) else got, wanted):
            raise ValueError(f"{path}: the tokenizer's {name} is not the one that is encoded here")


class ByteLevelEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 250_000):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as little-endian unsigned 32-bit integers")
        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        letters = dict(enumerate(byte_letters()))
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        expect(path, made, BYTE_STEPS)
        made = made["model"]
        # The library's model without its own cache, which costs more than it saves behind the memory here.
        model = BPE(made["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in made["merges"]], cache_capacity=0)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        whole = self._whole

        def encode(text: str) -> bytes:
            if not _SETTLED.match(text) or (special and self._special.search(text)):
                return whole(text)
            return array("I", [t.id for p in _PIECES.findall(text) for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes()

        class Memory(dict):
            """Ids of a stretch that follows ``lead``; words are remembered, words with one mark behind them put together."""

            def __init__(self, lead: str, marks: dict):
                self.lead, self.letter_lead, self.marks = lead, lead.translate(letters), marks

            def __missing__(self, stretch: str) -> bytes:
                word = stretch[:-1]
                if (mark := self.marks.get(stretch[-1:])) and word.isalpha():
                    got = self[word] + mark
                elif stretch.isalpha() and _SETTLED.match(stretch):
                    letter = stretch if stretch.isascii() else stretch.encode().decode("latin-1").translate(letters)
                    got = array("I", [t.id for t in model.tokenize(self.letter_lead + letter)]).tobytes()
                elif (parts := stretch.split("\n", 1))[-1] and len(parts) == 2 and parts[0] and parts[1][0] != "\n" and "\n" != parts[0][-1]:
                    # A single line feed between other characters is a token of its own.
                    got = self[parts[0]] + line_feed + coder._first[parts[1]]
                else:
                    got = encode(self.lead + stretch)
                if len(self) < limit and len(stretch) < 64:
                    self[stretch] = got
                return got

        coder, line_feed = self, encode("\n")
        marks = {c: encode(c) for c in ".,;:!?"}
        self._first, self._later = Memory("", marks), Memory(" ", marks)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _odd(self, text: str) -> bool:
        """Whether a text can't be cut at its blanks."""
        return bool("  " in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text) or (self._special and self._special.search(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self._odd(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._first[first] + b"".join(map(self._later.__getitem__, rest))


    def encode_all(self, texts: list[str], most: int = 8 << 20) -> Iterator[bytes]:
        """The ids of each text. Stretches are looked up once for about ``most`` characters of text, and put together by numpy."""
        start = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= most or k == len(texts) - 1:
                yield from self._encode_group(texts[start : k + 1])
                start, size = k + 1, 0

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [self._whole(t) if self._odd(t) else None for t in texts]
        plain = [k for k, x in enumerate(out) if x is None]
        if not plain:
            return out
        cut = pc.split_pattern(pa.array([texts[k] for k in plain], pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        # A text's first stretch has no blank in front, so it has an entry of its own.
        known = coded.dictionary.to_pylist()
        first = bounds[:-1]
        entries = [*map(self._later.__getitem__, known), *(self._first[known[k]] for k in at[first].tolist())]
        at[first] = len(known) + np.arange(len(plain))
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        starts = np.cumsum(size) - size
        held = size[at]
        stop = np.cumsum(held)
        ids = np.frombuffer(b"".join(entries), "<u4")[np.repeat(starts[at] - (stop - held), held) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[bounds]
        for k, lo, hi in zip(plain, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = ids[lo:hi].tobytes()
        return out


def encoder(path: str) -> ByteLevelEncoder:
    """One for each worker process."""
    return resident(("bytes", path), lambda: ByteLevelEncoder(path))

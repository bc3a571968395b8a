"""BPE encoding and decoding with forced boundaries.

A merge only ever builds vocabulary tokens. Two neighbouring symbols that stand next to each other inside no token of the
vocabulary can therefore never come to lie in one token: between them is a certain cut, and what stands left and right of it
merges as if it were alone. A symbol is a byte, or the last byte of a word together with the end-of-word mark. Blanks, line
feeds and the pre-tokenizer's own bounds are certain cuts as well. A text is cut at all of them, each fragment is encoded by
the tokenizers library's model and remembered (in bounded memory), and the ids are put together again.

The vocabulary is one with word ends, lower case and dropped white space (see ``WORD_PATTERN``). Stretches with characters whose
Unicode class may differ between versions are cut into words by the library's normalizer and pre-tokenizer, and these words into
fragments; only a stretch with a special token's string is encoded by the library as it is.

Decoding goes from ids to their tokens' strings, joined as the library's ``decode(ids, skip_special_tokens=False)`` does for a
tokenizer without a decoder.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded one by one; extra
columns play no part; an empty table gives an empty table. A very long text is encoded whole, fragment by fragment, in a batch of its own.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import map_arrow, resident, text_or_empty
from .token_ids import _SETTLED, byte_letters, expect

#: The pre-tokenizer's pattern (a fixed value of the public vocabulary).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The steps that are done here in the tokenizer's place (fixed values of the public vocabulary).
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    "decoder": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False},
}


def symbols(token: str, end: str) -> list[str]:
    """The symbols of a vocabulary entry."""
    if end and token.endswith(end) and len(token) > len(end):
        own = list(token[: -len(end)])
        return [*own[:-1], own[-1] + end]
    return list(token)


class FragmentCoder:
    """``encode(text)`` gives ids as little-endian unsigned 32-bit integers, ``decode(ids)`` their text."""

    def __init__(self, path: str, limit: int = 600_000):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        expect(path, made, WORD_STEPS)
        model = made["model"]
        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Neighbours inside some token; any others have a certain cut between them.
        self.joined = {p for t in vocab for s in [symbols(t, self.end)] for p in zip(s, s[1:], strict=False)}
        self._inside = BPE(vocab, merges).tokenize  # fragments that don't end a word
        self._last = tokenizer.model.tokenize
        self._letters = dict(enumerate(byte_letters()))
        added = tokenizer.get_added_tokens_decoder()
        special = [t.content for t in added.values()]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        size = max([*vocab.values(), *added]) + 1
        self.strings = [""] * size
        for t, k in vocab.items():
            self.strings[k] = t
        for k, t in added.items():
            self.strings[k] = t.content
        self._words = regex.compile(WORD_PATTERN)
        coder = self

        class Fragments(dict):
            """Ids by fragment; a fragment that ends a word has the mark as its last character."""

            def __missing__(self, fragment: str) -> bytes:
                found = coder._last(fragment[:-1]) if fragment[-1] == "\0" else coder._inside(fragment)
                got = array("I", [t.id for t in found]).tobytes()
                if len(self) < limit and len(fragment) < 64:
                    self[fragment] = got
                return got

        class Stretches(dict):
            """Ids by stretch of text between blanks."""

            def __missing__(self, stretch: str) -> bytes:
                word = stretch[:-1]
                if (mark := marks.get(stretch[-1:])) and word.isalpha():
                    got = self[word] + mark
                else:
                    got = coder._stretch(stretch)
                if len(self) < limit and len(stretch) < 64:
                    self[stretch] = got
                return got

        self._fragments = Fragments()
        marks = {c: self._stretch(c) for c in ".,;:!?"}
        self._stretches = Stretches({"": b""})

    def cut(self, word: str) -> list[str]:
        """The fragments of a pre-token in byte letters; the last one has the end mark NUL behind it."""
        if len(word) == 1:
            return [word + "\0"]
        out, start, joined = [], 0, self.joined
        for k in range(1, len(word) - 1):
            if (word[k - 1], word[k]) not in joined:
                out.append(word[start:k])
                start = k
        k = len(word) - 1
        if (word[k - 1], word[k] + self.end) not in joined:
            out.append(word[start:k])
            start = k
        return [*out, word[start:] + "\0"]

    def _stretch(self, stretch: str) -> bytes:
        if self._special and self._special.search(stretch):
            return array("I", self.tokenizer.encode(stretch, add_special_tokens=False).ids).tobytes()
        if _SETTLED.match(stretch):
            words = self._words.findall(unicodedata.normalize("NFC", stretch).lower())
            words = [w if w.isascii() else w.encode().decode("latin-1").translate(self._letters) for w in words]
        else:
            # The library's own Unicode tables cut; its words come in byte letters.
            words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(stretch))]
        return b"".join(self._fragments[f] for w in words for f in self.cut(w))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._stretches.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def coder(path: str) -> FragmentCoder:
    """One for each worker process."""
    return resident(("fragments", path), lambda: FragmentCoder(path))


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (binary, 4 bytes each) of every text."""

    def run(batches):
        own = coder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(own.encode, b["text"].to_pylist()), pa.binary())], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")), run, "doc_id bigint, ids binary", heavy="text")


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with the text that its ids stand for."""

    def run(batches):
        own = coder(tokenizer)
        for b in batches:
            texts = (own.decode(np.frombuffer(x, "<u4")) for x in b["ids"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(encoded, run, "doc_id bigint, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and decoded texts stay in the task that made them."""

    def run(batches):
        own = coder(tokenizer)
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                ids = own.encode(text)
                said = own.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()))
            n, ids, said = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(said, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", heavy="text")

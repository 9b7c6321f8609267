"""BPE encoding and decoding with forced-boundary splitting (operator 7).

A merge can only join two neighbouring bytes that stand side by side inside
some token of the vocabulary. A byte pair that no token contains is thus a
certain cut: the fragments on both sides are encoded independently and their
ids concatenated. Cuts depend on the vocabulary alone, so fragments repeat
across a corpus far more often than texts do, and a bounded table of encoded
fragments and chunks serves a whole partition.

The tokenizer file is a parameter (a ``tokenizers`` JSON file with a BPE
model, byte-level alphabet and a word-end suffix); it is read once in each
Python worker and never trained.

Defined results: a null or empty text has no ids and decodes to ''; rows
with equal ids are encoded one by one; an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks of text and fragments that a worker remembers at most, each.
MEMORY = 500_000
#: The longest of them; longer ones are encoded anew each time.
MEMORY_WORD = 64

#: Below this code point a text is its own NFC form, and Python lower-cases
#: and classes its characters as the library does.
PLAIN = 0x300


#: Python's split() takes these for white space, the library doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


class Chunks(dict):
    """Ids of the pieces of text between white space, a bounded number."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, text: str) -> tuple:
        ids = self.encoder.chunk(text)
        if len(text) <= MEMORY_WORD:
            if len(self) >= MEMORY:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Ids and decoded text of whole texts, for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        inner = Tokenizer.from_file(path)
        inner.model.end_of_word_suffix = None
        # two views of one model: a word's last fragment carries the suffix
        self.last, self.inner = self.library.model, inner.model
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.tokens = [""] * (max([*spec["model"]["vocab"].values(),
                                   *(t["id"] for t in spec["added_tokens"])]) + 1)
        pairs = set()
        for token, i in spec["model"]["vocab"].items():
            self.tokens[i] = token
            body = token.removesuffix(self.suffix)
            pairs.update(zip(body, body[1:]))
        self.pairs = pairs
        self.added = {}
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
            self.added[t["content"]] = t["id"]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.alphabet = [self._byte(b) for b in range(256)]
        self.chunks = Chunks(self)
        self.fragments: dict[tuple[str, bool], tuple] = {}

    def _byte(self, b: int) -> str:
        """The byte-level alphabet: printable bytes stand for themselves, the
        others, in order, for the code points from 256 on."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        if b in printable:
            return chr(b)
        return chr(256 + [x for x in range(256) if x not in printable].index(b))

    def cuts(self, word: str) -> list[str]:
        """A word's bytes (in the byte-level alphabet), cut wherever no token
        holds the two neighbouring bytes."""
        pairs, out, start = self.pairs, [], 0
        for i in range(1, len(word)):
            if (word[i - 1], word[i]) not in pairs:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def fragment(self, text: str, last: bool) -> tuple:
        key = (text, last)
        ids = self.fragments.get(key)
        if ids is None:
            ids = tuple([t.id for t in (self.last if last else self.inner).tokenize(text)])
            if len(text) <= MEMORY_WORD:
                if len(self.fragments) >= MEMORY:
                    self.fragments.clear()
                self.fragments[key] = ids
        return ids

    def encode_word(self, byte_word: str) -> tuple:
        parts = self.cuts(byte_word)
        if len(parts) == 1:  # its chunk is remembered
            return tuple([t.id for t in self.last.tokenize(byte_word)])
        ids: list[int] = []
        for p in parts[:-1]:
            ids += self.fragment(p, False)
        ids += self.fragment(parts[-1], True)
        return tuple(ids)

    def chunk(self, text: str) -> tuple:
        """Ids of lower-cased text without white space."""
        alphabet, ids = self.alphabet, []
        for word in self.word.findall(text):
            ids += self.encode_word("".join([alphabet[b] for b in word.encode("utf-8")]))
        return tuple(ids)

    def _plain(self, text: str) -> list:
        """Ids of a piece without added tokens."""
        if (text.isascii() or max(text) < chr(PLAIN)) and not SEPARATORS.search(text):
            return list(chain.from_iterable(map(self.chunks.__getitem__, text.lower().split())))
        # any script: the library's own normal form and word split
        text = self.library.normalizer.normalize_str(text)
        return [i for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)
                for i in self.encode_word(w)]

    def encode(self, text: str | None) -> array:
        ids = array("I")
        if not text:
            return ids
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            if m.start() > at:
                ids.extend(self._plain(text[at:m.start()]))
            ids.append(self.added[m.group()])
            at = m.end()
        if at < len(text):
            ids.extend(self._plain(text[at:]))
        return ids

    def decode(self, ids) -> str:
        """The tokens with a space between (the file names no decoder)."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big" or ids.itemsize != 4:
        return np.asarray(ids, dtype="<u4").tobytes()
    return ids.tobytes()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (``keep_ids``) the
    ids themselves."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            n, a, d, every = [], [], [], array("I")
            for text in b.column("text"):
                ids = enc.encode(text.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(little_endian(ids)).hexdigest())
                d.append(hashlib.sha256(enc.decode(ids).encode("utf-8")).hexdigest())
                if keep_ids:
                    every.extend(ids)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if keep_ids:
                ends = np.cumsum([0, *n]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(ends, np.array(every, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)

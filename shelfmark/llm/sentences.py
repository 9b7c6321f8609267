"""SentencePiece (BPE) encoding and decoding by backtracking (operator 12).

A merge-type encoding is the only sequence of pieces in which every two
neighbours are compatible: merging their characters anew, best score first
and leftmost among equals, gives the same two pieces. (Merges inside a
stretch of pieces never depend on what lies outside as long as no merge
crosses its ends, and the first merge that crossed a boundary would cross it
for the two neighbours alone as well.) So the encoding is found from the
left: at each position the longest piece that an Aho-Corasick automaton
matches there is tried first, then shorter ones; a piece is taken if it is
compatible with the one before it and its end isn't known to fail; where none
is left, the position is marked in a bitfield and the last piece is given
back. A position is reached by one compatible sequence only, so that a failed
one never has to be tried again, and the work is linear but for the checks,
whose answers are remembered.

Places that no piece spans are certain cuts: before a space mark, on both
sides of a character that no longer piece holds (digits, line ends), and
between letters and others, so far as the model's pieces bear this out. The
chunks between cuts repeat across a corpus, so their results are remembered, a
bounded number in each worker. Characters outside the vocabulary fall back to
bytes.

The model file (BPE, without a character map) is a parameter; Spark sends it
to the workers. It is never trained.

Defined results: a null or empty text has no ids and decodes to ''; rows with
equal ids are encoded one by one; an empty table gives an empty result; only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chunks and pairs of pieces that a worker remembers at most, each.
MEMORY = 500_000
#: The longest chunk of them; longer ones are encoded anew each time.
MEMORY_CHUNK = 64

SPACE = "▁"
NEVER = float("-inf")
EMPTY = hashlib.sha256(b"").hexdigest()


class Chunks(dict):
    """Chunk -> (number of ids, ids joined by commas, decoded text); at most
    MEMORY of them, of which the older half makes room."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> tuple:
        ids = self.model.chunk_ids(chunk)
        text = self.model.surface(ids)
        out = len(ids), ",".join(map(str, ids)), text
        if len(chunk) <= MEMORY_CHUNK:
            if len(self) >= MEMORY:
                for old in list(islice(self, MEMORY // 2)):
                    del self[old]
            self[chunk] = out
        return out


def cuts(pieces: list[str]) -> re.Pattern | None:
    """Chunks of a marked text that no piece reaches beyond; None if pieces
    hold a space mark after another character."""
    multi, spanned = set(), set()
    for piece in pieces:
        if len(piece) > 1:
            multi.update(piece)
            spanned.update(zip(piece, piece[1:]))
    if any(b == SPACE != a for a, b in spanned):
        return None
    alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in multi)
    # letters: less those that some piece joins to another kind
    no_letters = ""
    while True:
        letter = re.compile(rf"[^\W\d_{no_letters}]")
        mixed = {a if letter.match(a) else b for a, b in spanned
                 if SPACE not in (a, b) and bool(letter.match(a)) != bool(letter.match(b))}
        if not mixed:
            break
        no_letters += "".join(map(re.escape, sorted(mixed)))
    other = rf"(?:(?![{SPACE}{alone}])[\W\d_{no_letters}])"
    single = f"|[{alone}]" if alone else ""
    free = rf"(?:(?![{alone}])[^\W\d_{no_letters}])" if re.search(r"[A-Za-z]", alone) else letter.pattern
    return re.compile(rf"{SPACE}*{free}+|{SPACE}*{other}+|{SPACE}+{single}")


class Model:
    """Encoding and decoding of whole texts, for one model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, trained = spec.normalizer_spec, spec.trainer_spec
        if trained.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without a character map or removal of spaces is needed")
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.unknown, self.unknown_text = library.unk_id(), trained.unk_surface
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.pieces: list[str | None] = []  # None: nothing to decode
        self.byte_of: dict[int, int] = {}
        self.bytes = [-1] * 256
        automaton = ahocorasick.Automaton()
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_of[i] = int(piece[3:5], 16)
                self.bytes[self.byte_of[i]] = i
            elif spec.pieces[i].type not in (1, 2, 3):
                raise ValueError(f"pieces of type {spec.pieces[i].type} aren't supported")
            plain = not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))
            self.pieces.append(piece if plain else None)
            if plain:
                self.ids[piece], self.score[piece] = i, library.get_score(i)
                if len(piece) > 1:
                    automaton.add_word(piece, len(piece))
        if len(automaton):
            automaton.make_automaton()
        self.automaton = automaton
        self.cut = cuts(list(self.ids))
        #: what a plain piece decodes to
        self.plain = [None if p is None else p.replace(SPACE, " ") for p in self.pieces]
        self.chunks = Chunks(self)
        self.pairs: dict[tuple[str, str], bool] = {}

    # --- encoding ---------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: best score first, leftmost first."""
        symbols, score = list(text), self.score.get
        scores = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            i = scores.index(best)
            new = symbols[i] + symbols[i + 1]
            symbols[i:i + 2] = [new]
            del scores[i]
            if i:
                scores[i - 1] = score(symbols[i - 1] + new, NEVER)
            if i < len(scores):
                scores[i] = score(new + symbols[i + 1], NEVER)
        return symbols

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` (or begin, after '')."""
        key = (left, right)
        fit = self.pairs.get(key)
        if fit is None:
            fit = self.merged(left + right) == ([left, right] if left else [right])
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            self.pairs[key] = fit
        return fit

    def split(self, text: str) -> list[str]:
        """The pieces of one chunk, by backtracking."""
        n = len(text)
        at: list[list[int]] = [[1] for _ in text]  # lengths matched, ascending
        if len(self.automaton):
            for end, length in self.automaton.iter(text):
                at[end + 1 - length].append(length)
        failed = bytearray(n + 1)  # the bitfield
        out: list[str] = []
        known, pos, left = self.pairs.get, 0, ""
        while pos < n:
            lengths = at[pos]
            while lengths:
                end = pos + lengths.pop()
                if failed[end]:
                    continue
                piece = text[pos:end]
                fit = known((left, piece))
                if fit or fit is None and self.fits(left, piece):
                    out.append(piece)
                    left, pos = piece, end
                    break
            else:
                failed[pos] = 1
                pos -= len(out.pop())
                left = out[-1] if out else ""
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        ids = []
        for piece in self.split(chunk):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            else:
                spelled = [self.bytes[b] for b in piece.encode("utf-8")]
                ids += spelled if -1 not in spelled else [self.unknown]
        return ids

    def parts(self, text: str | None) -> list[str]:
        """A text's chunks; none for null or empty."""
        if not text:
            return []
        marked = self.prefix + text.replace(" ", SPACE)
        return self.cut.findall(marked) if self.cut else [marked]

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.parts(text) for i in self.chunk_ids(c)]

    # --- decoding ---------------------------------------------------------

    def surface(self, ids) -> str:
        """The text of ids, the mark of the text's begin included."""
        try:
            return "".join([self.plain[i] for i in ids])
        except TypeError:  # bytes, control pieces or the unknown one
            pass
        out, raw = [], bytearray()

        def spell():
            while raw:
                try:
                    out.append(raw.decode("utf-8"))
                    raw.clear()
                except UnicodeDecodeError as e:  # each stray byte is one mark
                    out.append(raw[:e.start].decode("utf-8") + "�")
                    del raw[:e.start + 1]

        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            spell()
            out.append(self.plain[i] if self.plain[i] is not None else
                       self.unknown_text if i == self.unknown else "")
        spell()
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of any ids."""
        text = self.surface(ids)
        first = next((i for i in ids if i in self.byte_of or self.pieces[i] is not None or i == self.unknown), None)
        mark = first is not None and (self.pieces[first] or "").startswith(SPACE)
        return text[1:] if self.prefix and mark else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        found = list(map(self.chunks.__getitem__, self.parts(text)))
        if not found:
            return 0, EMPTY, EMPTY
        n, ids, decoded = zip(*found)
        text = "".join(decoded)
        return (sum(n), hashlib.sha256(",".join(ids).encode()).hexdigest(),
                hashlib.sha256((text[1:] if self.prefix else text).encode("utf-8")).hexdigest())


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and (``keep_ids``) the
    ids themselves."""
    docs.sparkSession.sparkContext.addFile(model_file)
    name = os.path.basename(model_file)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        m = model(SparkFiles.get(name))
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            found = [m.digests(t) for t in texts]
            cols = [b.column("doc_id"), pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.string())]
            if keep_ids:
                ids = [np.array([int(i) for c in m.parts(t) for i in m.chunks[c][1].split(",")], dtype=np.int32)
                       for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)

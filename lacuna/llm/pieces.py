"""Encoding texts into subword pieces and back.

A text is cut into pieces of a fixed vocabulary so that the sum of their log scores
is largest (Viterbi).  Pieces are looked up in a double-array trie.  A space is part
of pieces as their marker, and one marker stands before each text.  A character that
no piece has becomes pieces of its UTF-8 bytes.  Decoding joins the pieces' bytes and
takes the first marker off, which gives back every text exactly.

No piece has a marker behind another character, so a text falls into words with
their markers, whose best cuts do not touch each other.  A task remembers cuts of
words; those it has not met are cut together, position by position, in numpy.

Null and empty texts have no pieces.  A very long text takes memory in proportion to
its length, and a very long word steps in proportion to it; an empty table gives an
empty result; of cuts with equal scores the first found counts, the same in every run.  Repeated rows are encoded each.  Only `text`
is read, and of the other columns those that the caller keeps.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from lacuna.llm.common import read

MARKER = "▁"
#: What a byte piece costs more than the rarest piece.
BYTE_PENALTY = 10.0
#: Pieces with scores below this are in the vocabulary but not used.
UNUSED = -1e8
#: Words whose cuts a task remembers before it starts afresh, and texts handled at once.
MEMO = 200_000
SLICE = 128

_WORD = re.compile(" +[^ ]*")


@dataclass
class DoubleArray:
    """A trie over character codes: from node s, code c leads to base[s] + c if check says so."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, words: list[tuple[tuple[int, ...], int]], codes: int) -> "DoubleArray":
        """Place nodes breadth first, each node's children at the first base where all their slots are free.

        words: (codes, value), each code from 1 to `codes`.
        """
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, value in words:
            at = 0
            for c in word:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = value
        size = len(children) + 2 * codes + 2
        base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        free, queue = 1, [(0, 0)]
        for node, slot in queue:
            if not children[node]:
                continue
            order = sorted(children[node])
            while taken[free]:
                free += 1
            b = max(free - order[0], 0)
            while any(taken[b + c] for c in order):
                b = max(taken.index(0, b + order[0] + 1) - order[0], b + 1)
                if b + codes + 1 >= len(taken):
                    grow = len(taken)
                    taken += bytearray(grow)
                    base, check, out = (np.append(a, np.full(grow, v, np.int32)) for a, v in ((base, 0), (check, -1), (out, -1)))
            base[slot] = b
            for c in order:
                child = children[node][c]
                taken[b + c], check[b + c], out[b + c] = 1, slot, ends[child]
                queue.append((child, b + c))
        used = len(taken) - codes - 1
        while used > 1 and not taken[used - 1]:
            used -= 1
        return cls(*(a[: used + codes + 1] for a in (base, check, out)))


@dataclass
class Vocabulary:
    """Trie, scores and bytes of all pieces.

    code: of each code point, 0 where no piece has it.  score, start, size: by piece;
    start and size say where its bytes are in blob.  byte_piece: id of each byte's.
    """

    trie: DoubleArray
    code: np.ndarray
    score: np.ndarray
    blob: np.ndarray
    start: np.ndarray
    size: np.ndarray
    byte_piece: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int | None]]) -> "Vocabulary":
        """pieces: (text with markers, log score, byte it stands for) by id; -inf scores are not used."""
        texts = [p.replace(MARKER, " ") for p, _, _ in pieces]
        score = np.array([s for _, s, _ in pieces], float)
        usable = [i for i, (p, s, b) in enumerate(pieces) if b is None and p and s > -np.inf]
        if any(" " in texts[i].lstrip(" ") for i in usable):
            raise ValueError("a piece has a marker behind another character")
        alphabet = sorted({c for i in usable for c in texts[i]})
        code = np.zeros(0x110000, np.int32)
        code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        trie = DoubleArray.build([(tuple(int(code[ord(c)]) for c in texts[i]), i) for i in usable], len(alphabet))
        byte_piece = np.full(256, -1, np.int64)
        raw = []
        for i, (t, (_, _, b)) in enumerate(zip(texts, pieces, strict=True)):
            raw.append(bytes([b]) if b is not None else t.encode() if score[i] > -np.inf else b"")
            if b is not None:
                byte_piece[b] = i
        if (byte_piece < 0).any():
            raise ValueError("a byte has no piece")
        score[byte_piece] = score[usable].min() - BYTE_PENALTY
        size = np.array([len(r) for r in raw])
        return cls(trie, code, score, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size) - size, size, byte_piece,
                   max(len(texts[i]) for i in usable))


def load(model_file: str, ranked: bool) -> Vocabulary:
    """The pieces of a model file.

    A model of the unigram kind has log scores.  One made by merging has ranks (0, -1,
    -2, ...) in their place; with `ranked`, Zipf's law turns them into log scores.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = []
    for i in range(model.get_piece_size()):
        s, byte = model.get_score(i), int(model.id_to_piece(i)[1:-1], 16) if model.is_byte(i) else None
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or s < UNUSED:
            s = -np.inf
        pieces.append((model.id_to_piece(i), s, byte))
    if ranked:
        total = np.log(sum(1 / (1 - s) for _, s, b in pieces if b is None and s > -np.inf))
        pieces = [(p, -np.log(1 - s) - total if s > -np.inf else s, b) for p, s, b in pieces]
    return Vocabulary.of(pieces)


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, bytes] = {}

    def _edges(self, points: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and piece of every piece that stands in the words; -1 for a character without any."""
        t, codes = self.v.trie, self.v.code[points]
        at = np.arange(len(points))
        node, alive = np.zeros(len(points), np.int32), at
        found, single = [], np.zeros(len(points), bool)
        for length in range(1, self.v.longest + 1):
            alive = alive[alive + length - 1 < end[alive]]
            c = codes[alive + length - 1]
            to = t.base[node[alive]] + c
            ok = (c > 0) & (t.check[to] == node[alive])
            alive, to = alive[ok], to[ok]
            node[alive] = to
            hit = t.value[to] >= 0
            found.append((alive[hit], np.full(hit.sum(), length), t.value[to[hit]]))
            if length == 1:
                single[alive[hit]] = True
        other = np.flatnonzero(~single)
        found.append((other, np.ones(len(other), int), np.full(len(other), -1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _learn(self, words: list[str]) -> None:
        """Cut words that were not met before; the best cut of each is kept as bytes of int32."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in words])
        begin = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        start, length, piece = self._edges(points, (begin + lengths)[word])
        utf8 = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        byte_score = self.v.score[self.v.byte_piece[0]]
        score = np.where(piece >= 0, self.v.score[piece], byte_score * utf8[start])
        # A word of n characters has n + 1 states.  Edges are followed by the distance of
        # their start from the word's, and by length: no two of a step meet in one state.
        step = (start - begin[word[start]]) * (self.v.longest + 1) + length
        if step.max() < 1 << 15:
            step = step.astype(np.int16)  # sorted by radix
        order = np.argsort(step, kind="stable")
        start, length, piece, score = start[order], length[order], piece[order], score[order]
        state = start + word[start]
        best = np.full(len(points) + len(words), -np.inf)
        back = np.full(len(best), -1)
        best[begin + np.arange(len(words))] = 0
        cuts = np.append(np.flatnonzero(np.diff(step[order], prepend=-1)), len(order))
        for a, b in zip(cuts, cuts[1:], strict=False):
            gain = best[state[a:b]] + score[a:b]
            to = state[a:b] + length[a:b]
            better = gain > best[to]
            best[to[better]] = gain[better]
            back[to[better]] = np.arange(a, b)[better]
        # Walk back all words together.
        here, owner, taken = begin + lengths + np.arange(len(words)), np.arange(len(words)), []
        while len(here):
            edge = back[here]
            taken.append((owner, edge))
            here = state[edge]
            more = here > begin[owner] + owner
            here, owner = here[more], owner[more]
        owner, edge = (np.concatenate(x) for x in zip(*reversed(taken), strict=True))
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        ids, bounds = piece[edge].astype(np.int32), np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        raw, at = ids.tobytes(), bounds.tolist()
        self.known.update(zip(words, (raw[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True))
        for n in np.unique(owner[ids < 0]):
            a, b = bounds[n] // 4, bounds[n + 1] // 4
            parts = [
                self.v.byte_piece[list(chr(c).encode("utf-8", "surrogatepass"))] if i < 0 else [i]
                for i, c in zip(ids[a:b], points[start[edge[a:b]]], strict=True)
            ]
            self.known[words[n]] = np.concatenate(parts).astype(np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each whole text."""
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        if new := list({w for ws in words for w in ws} - self.known.keys()):
            self._learn(new)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), np.int32) for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; bytes that are no UTF-8 become replacement characters."""
        size = self.v.size[ids]
        at = np.repeat(self.v.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.v.blob[at].tobytes().decode("utf-8", "replace").removeprefix(" ")


def encoded(docs: DataFrame, vocabulary: Vocabulary, ids: str = "piece_ids", exact: str = "round_trip") -> DataFrame:
    """The documents with their piece ids and whether these decode to the same text.

    Results leave a task in small batches, whatever the size of those that come in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(at_text).to_pylist()
                found = coder.encode(texts)
                same = [coder.decode(f) == (t or "") for f, t in zip(found, texts, strict=True)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(same, pa.bool_())], [*part.schema.names, ids, exact])

    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(exact, BooleanType())])
    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """The rows with the text that their piece ids stand for; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(shared.value)
        for found in batches:
            yield pd.Series([coder.decode(np.asarray(f, np.int64)) if f is not None and len(f) else "" for f in found], dtype=object)

    return rows.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def public_vocabulary(model_file: str | None = None) -> Vocabulary:
    return load(model_file or public_tokenizers.path("piece_bpe_32k.model"), ranked=True)


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encoded(docs, public_vocabulary(model_file))
    return rows.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")


QUERIES = {"op10_sentencepiece": (op10_sentencepiece, None)}

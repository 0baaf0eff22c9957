"""Encoding words with byte pair merges, prefix by prefix, and back.

The merges of a vocabulary turn each word into tokens.  The tokens of a prefix are a
prefix of the tokens, so a word is known by the last token of each of its prefixes.
That token is the one that ends the prefix, as an automaton over all tokens finds
them, and that stays apart from the last token of the prefix before it; there is
exactly one.  Two tokens stay apart if no merge across their boundary comes earlier
than the merges that made them, which their own parts tell.  Back-pointers from the
word's end give the tokens, in time linear in its length.

Normalising and splitting into words follow the vocabulary file.  Neither reaches
across ASCII white space.  Texts of plain characters are split at once, of others what
stands between white space; a task remembers the tokens of words, and works out only
those it has not met.  Special tokens in a text are taken as such.

Null and empty texts have no tokens.  A very long text, with or without white space,
takes memory in proportion to its length.  Repeated rows are encoded each, and their
order does not matter; there are no ties, as the tokens are unique.  An empty table
gives an empty table.  Only `text` is read; columns of the names that are added are
replaced, others are carried along.
"""

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from lacuna.llm.common import read

#: Entries a task remembers before it starts afresh, and texts handled at once.
MEMO = 300_000
PAIRS = 1_000_000
SLICE = 128
#: Last symbols of words are other symbols than the same bytes inside; this is how far away.
FINAL = 0x1000

# How the vocabulary splits normalised text, and the first letter for bytes that do not show.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FIRST = 0x100

_CHUNK = re.compile("[^ \t-\r]+")
#: Characters whose normal form, case and kind are plain: ASCII, Latin letters, usual punctuation; and words of these.
_OTHER = re.compile("[^ -~\t-\rÀ-ÖØ-öø-ÿ«»‘’“”–—…€]")
_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \t-\r]+")


class Merges:
    """Tokens as symbol strings, what they are made of, and an automaton that finds them."""

    def __init__(self, model: dict):
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a vocabulary of merges with word ends")
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        self.symbols: list[str] = [""] * size
        self.rank = [-1] * size  # the merge that makes the token; -1 for single symbols
        self.parts: list[tuple[int, int]] = [(-1, -1)] * size
        self.merge: dict[tuple[int, int], int] = {}
        for name, i in vocab.items():
            if len(name) == 1:
                self.symbols[i] = name
            elif len(name) == len(suffix) + 1 and name.endswith(suffix):
                self.symbols[i] = chr(ord(name[0]) + FINAL)
        made_by: list[int] = []  # the token of each merge
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            if not self.symbols[a] or not self.symbols[b] or self.symbols[made] or max(self.rank[a], self.rank[b]) >= rank:
                raise ValueError(f"merge {rank} makes a token twice or from tokens that come later")
            self.symbols[made], self.rank[made], self.parts[made] = self.symbols[a] + self.symbols[b], rank, (a, b)
            self.merge[a, b] = rank
            made_by.append(made)
        self.length = [len(s) for s in self.symbols]
        self.final = [bool(s) and ord(s[-1]) >= FINAL for s in self.symbols]
        # A token that its own symbols do not give, as an earlier merge parts them, ends no prefix.
        self.given = [bool(s) for s in self.symbols]
        for (a, b), rank in self.merge.items():
            made = made_by[rank]
            self.given[made] = self.given[a] and self.given[b] and self._apart_until(a, b, rank)
        self.automaton = ahocorasick.Automaton()
        for i, s in enumerate(self.symbols):
            if self.given[i]:
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self._known: dict[int, bool] = {}  # by both tokens

    def _apart_until(self, left: int, right: int, before: int) -> bool:
        """Whether no merge across the boundary comes before the merge `before`.

        The one of the two made last is taken apart, again and again.  The tokens that
        then meet at the boundary would have been merged had their merge come before it.
        Of equal merges the leftmost comes first.
        """
        while True:
            if self.merge.get((left, right), before) < before:
                return False
            if self.rank[left] > self.rank[right]:
                before, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                before, right = self.rank[right] + 1, self.parts[right][0]
            else:
                return True

    def apart(self, a: int, b: int) -> bool:
        """Whether the symbols of a and b, merged together, give a and b again."""
        if len(self._known) > PAIRS:
            self._known.clear()
        known = self._known[a << 32 | b] = self._apart_until(a, b, len(self.merge))
        return known

    def encode(self, words: list[str]) -> list[bytes]:
        """Tokens of each word of symbols, as 32-bit integers; the words stand one after another, none reaches into the next."""
        length, final, known = self.length, self.final, self._known
        text = "".join(words)
        last = [-1] * (len(text) + 1)  # of each prefix
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - length[token]]
                if before >= 0 and not final[before]:
                    apart = known.get(before << 32 | token)
                    if not (self.apart(before, token) if apart is None else apart):
                        continue
                last[end] = token
        tokens, at = [], len(text)
        while at:
            tokens.append(last[at])
            at -= length[last[at]]
        ids = np.array(tokens[::-1], "<u4")
        ends = np.append(0, np.flatnonzero(np.array(final)[ids]) + 1) * 4
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class WordCoder:
    """Encodes and decodes whole texts with one vocabulary file's content."""

    def __init__(self, vocabulary: str):
        told = json.loads(vocabulary)
        kinds = [[x["type"] for x in (told[k] or {}).get(f"{k.replace('_', '')}s", [])] for k in ("normalizer", "pre_tokenizer")]
        split = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or split["pattern"] != {"Regex": SPLIT} or told["decoder"]:
            raise ValueError("a vocabulary that normalises or splits texts in another way")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search("[ \t-\r]", t["content"]) for t in told["added_tokens"]):
            raise ValueError("a special token that reaches beyond itself")
        self.merges = Merges(told["model"])
        self.normalize = Tokenizer.from_str(vocabulary).normalizer.normalize_str
        self.split = Split(Regex(SPLIT), "removed", invert=True).pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = np.full(max([len(self.merges.symbols) - 1, *self.special.values()]) + 1, "", object)
        for name, i in (told["model"]["vocab"] | self.special).items():
            self.names[i] = name
        # Letters that stand for bytes: themselves where they show, others in order from FIRST on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = {b: FIRST + i for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.letters = {b: chr(hidden.get(b, b)) for b in range(256)}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, list[str]] = {}

    def _symbols(self, word: str) -> str:
        if not (word.isascii() and word.isprintable()):
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return word[:-1] + chr(ord(word[-1]) + FINAL)

    def _words(self, text: str) -> list[str]:
        """The words of a stretch without special tokens."""
        if not _OTHER.search(text):
            return _PLAIN.findall(text.lower())
        out = []
        for chunk in _CHUNK.findall(text):
            words = self.chunks.get(chunk)
            if words is None:
                words = self.chunks[chunk] = [w for w, _ in self.split(self.normalize(chunk))]
            out += words
        return out

    def _parts(self, text: str) -> list[str]:
        """The words and special tokens of a text."""
        if self.between and self.between.search(text):
            return [w for p in self.between.split(text) for w in ([p] if p in self.special else self._words(p))]
        return self._words(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each whole text, as little-endian 32-bit integers."""
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        if len(self.words) > MEMO:
            self.words.clear()
        if not self.words:
            self.words = {name: np.array([i], "<u4").tobytes() for name, i in self.special.items()}
        cut = [self._parts(t) if t else [] for t in texts]
        if new := list({w for ws in cut for w in ws} - self.words.keys()):
            self.words.update(zip(new, self.merges.encode([self._symbols(w) for w in new]), strict=True))
        return [b"".join(map(self.words.__getitem__, ws)) for ws in cut]

    def decode(self, ids: bytes | None) -> str:
        """The names of the tokens with a space between, as a vocabulary without decoder gives them."""
        return " ".join(self.names[np.frombuffer(ids or b"", "<u4")])


@lru_cache(maxsize=1)
def coder(vocabulary: str) -> WordCoder:
    return WordCoder(vocabulary)


def _with_column(df: DataFrame, name: str, of: str, kind, make) -> DataFrame:
    """Add a column made of another by make(coder, values), in small Arrow batches."""
    kept = df.drop(name)
    at = kept.columns.index(of)
    schema = StructType([*kept.schema.fields, StructField(name, kind)])
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                made = pa.array(make(part.column(at).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return kept.mapInArrow(run, schema)


def encoded(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The documents with their token ids, as little-endian 32-bit integers in a binary column."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file
    return _with_column(docs, ids, "text", BinaryType(), lambda texts: coder(shared.value).encode(texts))


def decoded(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows with the text that their token ids stand for; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    return _with_column(rows, text, ids, StringType(), lambda found: [coder(shared.value).decode(f) for f in found])


def public_vocabulary(vocabulary_file: str | None = None) -> str:
    return Path(vocabulary_file or public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


def op13_word_bpe(spark: SparkSession, sf_dir: str, vocabulary_file: str | None = None) -> DataFrame:
    vocabulary = public_vocabulary(vocabulary_file)
    ids = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    rows = decoded(ids.drop("text"), vocabulary)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op13_word_bpe": (op13_word_bpe, None)}

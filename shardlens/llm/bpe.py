"""BPE encoding and decoding with a word-level vocabulary file (operator 3).

A word is cut by backtracking: an Aho-Corasick automaton finds every vocabulary token in it, the longest token
at each position is tried first, and a token stays only if it is *compatible* with the one before it, i.e.
merging the symbols of the two alone gives exactly the two. Tokens that are pairwise compatible are the one
result of the merges, and a position that led nowhere is never entered again, so the time is linear in the
word. The pair-compatibility table is filled as pairs turn up. Decoding gathers token strings from one byte
string by a table of offsets.

Both directions are column expressions (:func:`encode`, :func:`decode`), or one pass (:func:`with_tokens`), over
Arrow batches: no shuffle, rows keep their other columns, texts are taken whole. Null is the empty text and gives no ids; an empty id list
decodes to the empty text; ids that the vocabulary lacks are passed over; null ids decode to null.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardlens.llm.common import Recent, frugal, small_batches, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
#: Words, runs of text and token pairs kept in each Python worker (twice as many at most), and the longest such word; a
#: bound on memory alone.
CACHED_WORDS, CACHED_CHUNKS, CACHED_PAIRS, CACHED_LENGTH = 120_000, 60_000, 100_000, 64
#: Bytes of decoded text in one outgoing batch.
BATCH = 2 << 20
END = 256  # symbol of a byte that ends a word: byte + END


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """One vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a word-level BPE file of the known form")
        # Case, composition and word classes are Unicode tables of the file's own library; only merging is ours.
        library = Tokenizer.from_file(path)
        self.normalize, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        suffix, as_byte = model["end_of_word_suffix"], _byte_characters()
        self.symbol_of = {ord(c): b for c, b in as_byte.items()}
        strings = dict(sorted(((i, s) for s, i in model["vocab"].items())))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        strings |= {i: s for s, i in self.special.items()}

        self.symbols: dict[int, str] = {}
        for i, s in strings.items():
            if s in self.special:
                continue
            ends = s.endswith(suffix)
            word = [chr(as_byte[c]) for c in (s[: -len(suffix)] if ends else s)]
            if ends:
                word[-1] = chr(ord(word[-1]) + END)
            self.symbols[i] = "".join(word)
        self.single = {s: i for i, s in self.symbols.items() if len(s) == 1}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        vocab = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b if not a.endswith(suffix) else a])
                       for rank, (a, b) in enumerate(pairs)}
        self.pair_table = Recent(self.stay_apart, CACHED_PAIRS)
        self.byte_character = {b: chr(c) for c, b in self.symbol_of.items()}
        self.automaton = ahocorasick.Automaton()
        made = {word: i for i, word in self.symbols.items() if self.merged(word) == [i]}  # no others can be in a result
        self.length, self.shorter = [0] * (max(strings) + 1), [-1] * (max(strings) + 1)
        for word, i in made.items():
            self.automaton.add_word(word, (i, len(word)))
            self.length[i] = len(word)
            self.shorter[i] = next((made[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in made), -1)
        self.automaton.make_automaton()

        encoded = [(strings.get(i, "") + " ").encode() if i in strings else b"" for i in range(max(strings) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in encoded])])
        self.blob = np.frombuffer(b"".join(encoded), np.uint8)
        self.words = Recent(self.encode_piece, CACHED_WORDS, CACHED_LENGTH)
        self.chunks = Recent(self.encode_chunk, CACHED_CHUNKS, CACHED_LENGTH)

    def merged(self, symbols: str) -> list[int]:
        """The merges applied in rank order, leftmost first."""
        ids = [self.single[s] for s in symbols]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i:i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def stay_apart(self, pair: int) -> bool:
        """Whether the two tokens (in one number) stay as they are side by side."""
        left, right = pair >> 32, pair & 0xFFFFFFFF
        return self.merged(self.symbols[left] + self.symbols[right]) == [left, right]

    def cut(self, word: str) -> list[int]:
        """Token ids of one word given as symbols: the longest matches if they are compatible, else backtracking."""
        pairs, longest, covered, before = self.pair_table, [], 0, -1
        for _, (token, length) in self.automaton.iter_long(word):
            if before >= 0 and not pairs[before << 32 | token]:
                break
            longest.append(token)
            covered, before = covered + length, token
        if covered == len(word):
            return longest
        best = [-1] * len(word)  # the longest token that starts here; its prefixes that are tokens follow in ``shorter``
        for last, (token, length) in self.automaton.iter(word):
            best[last - length + 1] = token  # at one start, longer tokens come later
        length, shorter, closed = self.length, self.shorter, bytearray(len(word) + 1)
        out: list[int] = []
        start, token = 0, best[0]
        while start < len(word):
            while token >= 0:
                stop = start + length[token]
                if not closed[stop] and (not out or pairs[out[-1] << 32 | token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                start = stop
                token = best[start] if start < len(word) else -1
            else:
                closed[start] = 1
                token = out.pop()
                start -= length[token]
                token = shorter[token]
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        """Ids (int32 bytes) of a run of text without white space."""
        word = chunk.rstrip(",.")
        if len(word) >= len(chunk) - 1 and word.isalpha() and (word.isascii() or _is_latin(word)):  # one word, and a mark at most
            piece = word.lower()
            if not piece.isascii():
                piece = "".join(map(self.byte_character.__getitem__, piece.encode()))
            return self.words[piece] + (self.words[chunk[-1]] if len(word) < len(chunk) else b"")
        ids = [self.words[piece] for piece, _ in self.pieces(self.normalize(chunk))]
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one word in byte-level characters."""
        raw = piece.translate(self.symbol_of)
        return array("i", self.cut(raw[:-1] + chr(ord(raw[-1]) + END))).tobytes()

    def encode(self, text: str) -> np.ndarray:
        look, parts = self.chunks.__getitem__, []
        for part in self.cut_special(text) if "<|" in text else (text,):
            if part in self.special:
                parts.append(np.int32(self.special[part]).tobytes())
            else:
                parts += map(look, _chunks(part))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by one space."""
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        if not (total := int(size.sum())):
            return ""
        place = np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)
        return self.blob[place].tobytes()[:-1].decode()


def _is_latin(word: str) -> bool:
    """Whether all letters are of the first 256 characters: there, composed forms and lower case are the same everywhere."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _chunks(text: str) -> list[str]:
    """Runs without Unicode white space. ``str.split`` also splits at U+001C to U+001F, which are not white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        import regex

        return regex.findall(r"\P{White_Space}+", text)
    return text.split()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(text: Column, path: str) -> Column:
    """``array<int>`` of the token ids of each whole text."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for texts in batches:
            yield pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return ids(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """The text of each id list: token strings joined by one space, special tokens kept."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = load(path)
        for lists in batches:
            yield pd.Series([None if x is None else bpe.decode(_integers(x)) for x in lists], dtype=object)

    return texts(ids)


def _integers(ids) -> np.ndarray:
    ids = np.asarray(ids)
    if ids.dtype.kind == "f" or ids.dtype == object:  # null elements
        ids = np.array([-1 if x is None or x != x else int(x) for x in ids])
    return ids.astype(np.int64, copy=False)


def with_tokens(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of ``text`` and what they decode to; columns of these two names are replaced.
    Both directions in one pass and one Python worker, in batches of bounded size."""
    small_batches(df.sparkSession)
    df = df.drop(*({ids, decoded} - {text}))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts, first, lists, strings, size = batch.column(text), 0, [], [], 0
            for i in range(batch.num_rows):
                lists.append(bpe.encode(texts[i].as_py() or ""))
                strings.append(bpe.decode(lists[-1].astype(np.int64)))
                size += len(strings[-1])
                if size >= BATCH or i == batch.num_rows - 1:
                    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                    own = [pa.ListArray.from_arrays(ends, np.concatenate(lists)), pa.array(strings, pa.string())]
                    rows = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *own], [*rows.schema.names, ids, decoded])
                    first, lists, strings, size = i + 1, [], [], 0

    return df.mapInArrow(frugal(run), schema)


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Per document: token count, and SHA-256 of the ids and of the decoded text."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (with_tokens(texts, path)
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded"), 256).alias("decoded_sha256")))


def op3_backtracking_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def encoded(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: every text as token ids, shown by their number and digests."""
    return digests(docs, tokenizer_path(VOCABULARY))

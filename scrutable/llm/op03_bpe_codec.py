"""BPE encoding and decoding with forced boundaries.

Byte pairs that occur inside no vocabulary token mark certain cuts: no merge can ever span one, so the
fragments between cuts are encoded independently and concatenated. Fragments repeat far more often than
words, so each task merges a fragment once and looks it up afterwards.

Nulls and empty texts have no tokens; every row gives one row, repeated rows repeat; only the id and the
text are read, so further columns, whatever their names, do not matter. Texts of any length are encoded
whole; an empty table gives no rows. A text whose special strings occur verbatim yields their ids.

Which characters are letters, how they compose and what their lower case is depends on the year of a Unicode
table. Texts with characters on which tables may differ are normalised and split by the tokenizers library's
own functions, so that they come out as it has them; cuts, merges and ids are the operator's own for all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .bpe import WORD_PATTERN, Remembered, Vocabulary, newer_characters, normal, special_mark, special_splitter
from .common import ship
from .kernels import slices

SCHEMA = "doc_id long, ids binary, decoded string"


class Codec:
    """Encoder and decoder of one task. Ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.inside = vocabulary, vocabulary.forced_pairs()
        self.split, self.mark = special_splitter(vocabulary.special), special_mark(vocabulary.special)
        self.find, self.newer = regex.compile(WORD_PATTERN).findall, newer_characters()
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(WORD_PATTERN), "removed", invert=True)
        self.fragment = Remembered(lambda key: self.v.merge(self.v.symbols(key[1:], key[0] == "e")))
        self.word = Remembered(self.encode_word)
        self.shown = Remembered(lambda ids: " ".join(self.v.tokens[int(i)] for i in np.frombuffer(ids, "<u4")))

    def encode_word(self, word: str) -> bytes:
        text = "".join(self.v.byte[b] for b in word.encode())
        ids, at = [], 0
        for i in range(1, len(text)):
            if (text[i - 1], text[i]) not in self.inside:
                ids += self.fragment["-" + text[at:i]]
                at = i
        ids += self.fragment["e" + text[at:]]
        return np.array(ids, "<u4").tobytes()

    def words(self, part: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if part.isascii() or not self.newer.search(part):
            return self.find(normal(part))
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))]

    def encode(self, text: str | None) -> list[bytes]:
        """The ids of each pre-token of a whole text."""
        out: list[bytes] = []
        parts = self.split.split(text or "") if self.mark is not None and self.mark in (text or "") else [text or ""]
        for part in parts:
            if part in self.v.special:
                out.append(np.array([self.v.special[part]], "<u4").tobytes())
            elif part:
                out += map(self.word.__getitem__, self.words(part))
        return out

    def decode(self, pieces: list[bytes]) -> str:
        """Token strings joined by one space; the tokenizer file names no decoder, so that is its decoded text."""
        return " ".join(map(self.shown.__getitem__, pieces))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row's whole text; `tokenizer` is the path of a word-BPE JSON file."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))  # bounded by the vocabulary's size

    def run(batches):
        codec = Codec(shared.value)
        for batch in slices(batches):
            ids, texts = [], []
            for text in batch.column("text").to_pylist():
                pieces = codec.encode(text)
                ids.append(b"".join(pieces))
                texts.append(codec.decode(pieces))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

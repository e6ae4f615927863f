"""Token counts with a whole-token shortcut.

Before the job, every vocabulary string is encoded by itself; those that come out as one token are proved
to count one wherever they are a whole pre-token. Tasks count those by table and merge only the rest.

Nulls count as empty (0 bytes, 0 tokens); one row comes out for each row, repeated rows repeat; only id
and text are read, further columns are ignored whatever their names. Whole texts of any length are
counted; an empty table gives no rows. A special string inside a text counts as one token.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe import BYTE_PATTERN, Remembered, Vocabulary, special_mark, special_splitter
from .common import ship
from .kernels import slices


def whole_tokens(vocabulary: Vocabulary) -> dict[str, int]:
    """Pre-tokens proved to be one token: the vocabulary strings that encode alone as just themselves."""
    back = {c: b for b, c in enumerate(vocabulary.byte)}
    whole = {}
    for token, i in vocabulary.ids.items():
        if vocabulary.merge(vocabulary.symbols(token, True)) == [i]:
            try:
                whole[bytes(back[c] for c in token).decode()] = 1
            except UnicodeDecodeError:
                pass  # part of a character: no pre-token is one
    return whole


class Counter:
    def __init__(self, vocabulary: Vocabulary, whole: dict[str, int]):
        self.v = vocabulary
        self.split, self.mark = special_splitter(vocabulary.special), special_mark(vocabulary.special)
        self.find = regex.compile(BYTE_PATTERN).findall
        self.known = Remembered(self.merged)
        self.whole = whole

    def merged(self, word: str) -> int:
        return self.whole.get(word) or len(self.v.merge(self.v.symbols("".join(self.v.byte[b] for b in word.encode()), True)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.mark is None or self.mark not in text:
            return sum(map(self.known.__getitem__, self.find(text)))
        return sum(1 if part in self.v.special else sum(map(self.known.__getitem__, self.find(part))) for part in self.split.split(text))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text; `tokenizer` is a byte-BPE JSON file."""
    ship(docs.sparkSession)
    vocabulary = Vocabulary(tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))  # bounded by the vocabulary's size

    def run(batches):
        counter = Counter(*shared.value)
        for batch in slices(batches):
            counts = [counter.count(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("n_bytes").cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

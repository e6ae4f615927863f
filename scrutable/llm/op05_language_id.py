"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts every n-gram of letters (words lower-cased, padded by one space) in every training text,
by language. An n-gram belongs to a language when its rate there is at least `share` of its highest rate
in any language; every n-gram of every training text takes part, and the test is on rates, so it behaves
alike at every corpus size. The filters of all languages are one table of `slots` words whose bit L belongs to language L: the AND of an
n-gram's k words is the set of languages that contain it. For a text, hits are counted per language, the
hits expected of that language's false positives are taken off, and the highest corrected rate decides.

Null texts and texts without a letter are `und` with score 0. One row comes out for each row; repeated
rows repeat; only id, text and (in training) language are read, so other columns do not matter. Ties go
to the smallest language name. Without any training row every text is `und`. Whole texts are read.

The table is built by Spark (an OR over the bits of each slot) with `bits_per_gram` slots for each n-gram of
the fullest language, however many those are. Up to `broadcast_slots` slots (64 MB for each 64 languages) every
task gets it; beyond, it stays a table: the distinct n-grams of the texts meet their slots by a shuffled join,
and the texts meet their n-grams' masks by another. Both ways decide alike; the tests compare them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, discard, merged, ship
from .kernels import mix, slices

SIZES = (2, 3, 4)


def letter_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts with every run of other characters as one space; the row of each code point."""
    padded = [f" {x or ''} ".lower() for x in texts]  # each text has a space of its own at both ends
    sizes = np.array([len(x) for x in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), sizes)
    letter = ((codes >= 97) & (codes <= 122)) | (codes == 0xAA) | (codes == 0xB5) | (codes == 0xBA)
    high = np.flatnonzero(codes >= 0xC0)
    if len(high):
        values, back = np.unique(codes[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in values])[back]
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1] | (rows[1:] != rows[:-1])
    return codes[keep], rows[keep]


def ngrams(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, 64-bit values of all n-grams inside a padded word, in text order, and their rows."""
    codes, rows = letter_codes(texts)
    space = codes == 32
    codes, found = codes.astype(np.uint64), []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint64)
        for i in range(n):
            value = value * np.uint64(0x110000 + 7) + codes[i : i + m]
        inner = space[:m] & space[n - 1 :] if n == 2 else np.zeros(m, bool)
        for i in range(1, n - 1):
            inner |= space[i : i + m]
        fits = (rows[:m] == rows[n - 1 :]) & ~inner
        found.append((value[fits], rows[:m][fits]))
    return found


def count_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over every row with a language; tasks add up their own rows first."""
    ship(docs.sparkSession)

    def run(batches):
        counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang):
            g, c = counts.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

        for batch in slices(batches):
            parts = ngrams(batch.column("text").to_pylist())
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                of = langs == lang
                g, c = np.unique(np.concatenate([grams[of[rows]] for grams, rows in parts] or [np.zeros(0, np.uint64)]), return_counts=True)
                if lang in counts:
                    both, back = np.unique(np.concatenate([counts[lang][0], g]), return_inverse=True)
                    c = np.bincount(back, np.concatenate([counts[lang][1], c])).astype(np.int64)
                    g = both
                counts[lang] = (g, c.astype(np.int64))
                if len(g) > 500_000:
                    yield out(lang)
        for lang in list(counts):
            yield out(lang)

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slots_of(grams: np.ndarray, slots: int, hashes: int) -> np.ndarray:
    """Slots of each n-gram, one row a hash; `slots` is a power of two, the hashes are parts of one 64-bit value."""
    h, last = mix(grams), np.uint64(slots - 1)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & last).view(np.int64) for i in range(hashes)]


class StoredFilters:
    """Bit-sliced Bloom filters as a frame (word, slot, bits), without empty slots."""

    def __init__(self, langs: list[str], cells: DataFrame, slots: int, hashes: int):
        self.langs, self.cells, self.slots, self.hashes = langs, cells, slots, hashes
        set_bits = [F.sum(F.shiftrightunsigned("bits", b).bitwiseAND(1)).alias(str(b)) for b in range(min(64, len(langs)))]
        counts = {r["word"]: r for r in cells.groupBy("word").agg(*set_bits).collect()}
        self.false = np.array([counts[i // 64][str(i % 64)] / slots if i // 64 in counts else 0.0 for i in range(len(langs))]) ** hashes

    def array(self) -> "Filters":
        filled = self.cells.toArrow()
        table = np.zeros((-(-len(self.langs) // 64), self.slots), np.uint64)
        table[filled.column("word").to_numpy(), filled.column("slot").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
        return Filters(self.langs, table, self.hashes, self.false)

    def decide(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang_pred, score) of frames (doc_id, text): the same as `Filters.decide`, by joins."""
        slots, hashes = self.slots, self.hashes

        def grams_of(batches):
            for batch in slices(batches):
                parts, ids = ngrams(batch.column("text").to_pylist()), batch.column("row").to_numpy()
                for grams, rows in parts:
                    order = np.lexsort((grams, rows))
                    grams, rows = grams[order], rows[order]
                    new = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1]))[: len(grams)])
                    n = np.diff(np.append(new, len(grams)))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows[new]]), pa.array(grams[new].view(np.int64)), pa.array(n)], ["row", "gram", "n"])

        def places_of(batches):
            for batch in batches:
                grams = batch.column("gram").to_numpy().view(np.uint64)
                for slot in slots_of(grams, slots, hashes):
                    yield pa.RecordBatch.from_arrays([batch.column("gram"), pa.array(slot)], ["gram", "slot"])

        rows = cut(docs.withColumn("row", F.monotonically_increasing_id()))
        grams = cut(rows.select("row", "text").mapInArrow(grams_of, "row long, gram long, n long"))
        asked = grams.select("gram").distinct().mapInArrow(places_of, "gram long, slot long")
        found = merged(asked, self.cells, "slot").groupBy("gram", "word").agg(F.count("*").alias("k"), F.bit_and("bits").alias("mask"))
        found = found.where((F.col("k") == hashes) & (F.col("mask") != 0))
        places = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("mask", b) == 1), lambda b: F.col("word") * 64 + b)
        masks = found.select("gram", F.explode(places).alias("place"))
        hits = merged(grams, masks, "gram").groupBy("row", "place").agg(F.sum("n").alias("hits"))
        totals = grams.groupBy("row").agg(F.sum("n").alias("total"))
        false = F.element_at(F.array(*map(F.lit, self.false.tolist())), (F.col("place") + 1).cast("int"))
        rate = (F.col("hits") / F.col("total") - false) / F.greatest(1 - false, F.lit(1e-9))
        rates = merged(hits, totals, "row").select("row", "place", F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0)).alias("rate"))
        best = rates.groupBy("row").agg(F.max(F.struct("rate", (-F.col("place")).alias("order"))).alias("best"))
        lang = F.element_at(F.array(*map(F.lit, self.langs)), F.coalesce(F.when(F.col("best.rate") > 0, 1 - F.col("best.order")), F.lit(1)).cast("int"))
        out = merged(merged(rows.select("row", "doc_id"), totals, "row", "left"), best, "row", "left")
        known = F.col("total").isNotNull()
        return out.select("doc_id", F.when(known, lang).otherwise("und").alias("lang_pred"), F.when(known, F.coalesce("best.rate", F.lit(0.0))).otherwise(0.0).alias("score"))


class Filters:
    """Bit-sliced Bloom filters: table[w, s] has bit b set if language 64w+b holds an n-gram that hashes to slot s."""

    def __init__(self, langs: list[str], table: np.ndarray, hashes: int, false: np.ndarray):
        self.langs, self.hashes, self.false = langs, hashes, false
        self.table = table.astype(np.min_scalar_type((1 << min(64, max(1, len(langs)))) - 1))  # as narrow as the languages allow

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts = ngrams(texts)
        total, rates = np.zeros(len(texts)), np.zeros((len(self.langs), len(texts)))
        for grams, rows in parts:
            bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            total += np.diff(bounds)
            at = slots_of(grams, self.table.shape[1], self.hashes)
            for w, table in enumerate(self.table):
                mask = table[at[0]]
                for x in at[1:]:
                    mask &= table[x]
                for b in range(min(64, len(self.langs) - 64 * w)):
                    hit = (mask >> mask.dtype.type(b)) & mask.dtype.type(1)
                    rates[64 * w + b, full] += np.add.reduceat(hit, bounds[:-1][full], dtype=np.int64)
        rates = rates / np.maximum(total, 1)
        rates = np.clip((rates - self.false[:, None]) / np.maximum(1 - self.false[:, None], 1e-9), 0, 1)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = rates.argmax(axis=0)
        return [self.langs[b] if n else "und" for b, n in zip(best, total, strict=True)], np.where(total > 0, rates.max(axis=0), 0.0)


def fit(train: DataFrame, share: float = 0.5, bits_per_gram: int = 16, hashes: int = 4, broadcast_slots: int = 1 << 23, **columns) -> Filters | StoredFilters:
    """Filters over all training rows: as arrays up to `broadcast_slots` slots, as a table beyond."""
    counts = cut(count_ngrams(train, **columns))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Filters([], np.zeros((1, 64), np.uint64), hashes, np.zeros(0))
    totals = F.create_map(*[F.lit(x) for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect() for x in (r["lang"], float(r["total"]))])
    places = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, i)])
    rates = F.struct(F.element_at(places, F.col("lang")).alias("place"), (F.col("n") / F.element_at(totals, F.col("lang"))).alias("rate"))
    each = counts.groupBy("gram").agg(F.collect_list(rates).alias("each")).withColumn("top", F.array_max("each.rate"))
    kept = cut(each.select("gram", F.explode(F.filter("each", lambda e: e["rate"] >= share * F.col("top"))).alias("e")).select("gram", "e.place"))
    fullest = kept.groupBy("place").count().agg(F.max("count")).first()[0]
    slots = 1 << int(np.ceil(np.log2(max(64, fullest) * bits_per_gram)))

    def bits(batches):
        for batch in batches:
            grams, place = batch.column("gram").to_numpy(), batch.column("place").to_numpy().astype(np.int64)
            for slot in slots_of(grams, slots, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(place // 64), pa.array(slot), pa.array(np.uint64(1) << (place % 64).astype(np.uint64)).view(pa.int64())], ["word", "slot", "bits"])

    filled = cut(kept.mapInArrow(bits, "word long, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")))
    discard(counts, kept)
    stored = StoredFilters(langs, filled, slots, hashes)
    if slots > broadcast_slots:
        return stored
    filters = stored.array()
    discard(filled)
    return filters


def predict(docs: DataFrame, filters: Filters | StoredFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if isinstance(filters, StoredFilters):
        return filters.decide(docs)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # at most broadcast_slots words per 64 languages

    def run(batches):
        for batch in slices(batches):
            langs, scores = shared.value.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(fold: int, of: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))

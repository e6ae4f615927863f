"""Toxicity with noisy-channel deobfuscation.

A character language model is counted over all given texts: every trigram, however rare. Words that may be
disguised (a letter and an imitating sign or digit anywhere in a word, a letter twice or more in a row, three
or more short pieces spaced out by blanks, single letters spaced out by one same sign) become lattices: a run
of one character can stand for the letters it imitates, once or twice, or for nothing, each at a channel
cost. Viterbi decoding under the language model picks the restored word. The word as written is one reading
too, its runs of letters as words, with signs at its end free as in ordinary writing: "no!", "page2" or
"letter" stay by score. Other words have one path only, themselves.

All trigrams are kept. As long as they are at most `broadcast_trigrams`, counted first, every task gets the
model and restores the texts it reads; nothing is shuffled. Beyond that, distinct suspicious words become a
table, each asks for the trigrams of its lattice, these meet their probabilities by a shuffled join, every
word is decoded with just those, and texts meet their restored words by a shuffle. Both ways restore alike.

A document is scored by the learned evidence of its restored words: smoothed log odds of word beginnings and
whole words, shrunk where few labelled rows hold them, calibrated by a logistic curve over the strongest and
the summed evidence. The classifier is fitted on at most `sample_rows` labelled rows (the lowest hashes of
doc_id); nothing else is sampled or cut. Features are 64-bit hashes, none shares a slot with another.

Null and empty texts have no evidence and score the calibrated base. One row comes out for each row, repeated
rows repeat; a doc_id whose labels disagree counts as toxic if any label says so, null labels are ignored;
other columns are never read. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .bpe import Remembered
from .common import cut, discard, merged, ship
from .kernels import lower_ascii, slices, span_hashes, text_bytes, word_spans
from .kernels import _BYTE
from .op05_language_id import letter_codes

#: Letters that a digit or sign imitates.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
PUNCTUATION = ".,;:!?\"'()[]{}|*#&%-_"
COST_LEET, COST_DROP, COST_SHRINK, COST_HALVE = -0.7, -9.0, -0.3, -6.0
PIECE = 2  # characters of a piece of a spaced-out word, at most
_SIGNS = "".join(LEET)
_EDGE = "".join(c for c in PUNCTUATION if c not in LEET)  # imitates nothing
_LETTERS = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"([^\W\d_])\1")
_UNIT = rf"(?:[^\W\d_]|[{re.escape(_SIGNS)}])"
_CHAIN = re.compile(rf"(?<![^\W_]){_UNIT}([^\w\s]|_){_UNIT}(?:\1{_UNIT})+(?![^\W_])")
PREFIXES = (4, 5, 6, 8)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


# --- character language model -------------------------------------------------------------------

def count_trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): every trigram of letters, words padded by a space, over all texts."""
    ship(docs.sparkSession)

    def run(batches):
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches):
            codes, rows = letter_codes(batch.column("text").to_pylist())
            if len(codes) < 3:
                continue
            value = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
            value = value[(rows[:-2] == rows[2:]) & (codes[1:-1] != 32)]
            g, c = np.unique(value, return_counts=True)
            grams, back = np.unique(np.concatenate([grams, g]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, c])).astype(np.int64)
            if len(grams) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "n"])
                grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def gram(text: str) -> int:
    return (ord(text[0]) << 42) | (ord(text[1]) << 21) | ord(text[2])


M21, M42 = (1 << 21) - 1, (1 << 42) - 1


class CharModel:
    """Trigram model with interpolation down to single characters."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.total = float(counts.sum()) + 1.0
        self.tables = []  # sorted keys and sums: trigrams, first two, last two, middle
        for key in (grams, grams >> 21, grams & M42, (grams >> 21) & M21):
            keys, back = np.unique(key, return_inverse=True)
            self.tables.append((keys, np.bincount(back, counts, minlength=len(keys))))
        self.known: dict[str, float] = {}

    def count(self, table: int, keys: np.ndarray) -> np.ndarray:
        known, sums = self.tables[table]
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, sums[at], 0.0)

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of the last characters of trigrams after their first two."""
        p1 = (self.count(3, keys & M21) + 0.5) / (self.total + 500)
        p2 = (self.count(2, keys & M42) + 50 * p1) / (self.count(3, (keys >> 21) & M21) + 50)
        return np.log((self.count(0, keys) + 20 * p2) / (self.count(1, keys >> 21) + 20))

    def log(self, before: str, c: str) -> float:
        key = before + c
        if key not in self.known:
            self.known[key] = float(self.logs(np.array([gram(key)]))[0])
        return self.known[key]

    def word(self, text: str) -> float:
        """Log probability of a word's letters, its two edges included."""
        state, total = "  ", 0.0
        for c in text + " ":
            total += self.log(state, c)
            state = state[1] + c
        return total


# --- decoding ------------------------------------------------------------------------------------

def spelled(link: tuple | None) -> str:
    """The letters along a chain of links, from its start."""
    pieces = []
    while link is not None:
        piece, link = link
        pieces.append(piece)
    return "".join(reversed(pieces))


class Decoder:
    def __init__(self, model: CharModel):
        self.model = model
        self.restore = Remembered(self.decode, longest=64)  # longer words hardly repeat

    def arcs(self, c: str, n: int) -> list[tuple[str, float]]:
        """What a run of n equal characters can stand for, with channel cost."""
        letters = c if c.isalpha() else LEET.get(c, "")
        out = []
        for x in letters:
            cost = 0.0 if x == c else COST_LEET
            out.append((x, cost + (0.0 if n == 1 else COST_HALVE if n == 2 and x == c else COST_SHRINK)))
            if n > 1:
                out.append((x + x, cost + (COST_SHRINK if n > 2 else 0.0)))
        if not c.isalpha():
            out.append(("", COST_DROP))
        return out

    def path(self, text: str) -> tuple[float, str]:
        """Best restored word of a lattice and its score.

        A state keeps its last letters and a link to the state before, so work and memory are linear in the word.
        """
        best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] == text[i]:
                j += 1
            step: dict[str, tuple[float, tuple | None]] = {}
            arcs = self.arcs(text[i], j - i)
            for state, (score, link) in best.items():
                for letters, cost in arcs:
                    s, total = state, score + cost
                    for c in letters:
                        total += self.model.log(s, c)
                        s = s[1] + c
                    if s not in step or total > step[s][0]:
                        step[s] = (total, (letters, link))
            best, i = step, j
        ends = [(score + self.model.log(s, " "), spelled(link)) for s, (score, link) in best.items()]
        return max(ends, default=(0.0, ""))

    def plain(self, text: str) -> float:
        """Score of a word as written: its runs of letters as words; signs before a letter cost what dropping costs."""
        runs = list(_LETTERS.finditer(text))
        gaps = sum(a.start() > end for a, end in zip(runs, [0, *[r.end() for r in runs]], strict=False))
        return sum(self.model.word(r[0]) for r in runs) + gaps * COST_DROP

    def joined(self, m: re.Match) -> str:
        """Single characters spaced out by one same sign: the word they make, if that is likelier than letters apart."""
        letters = m[0][::2]
        if not any(c.isalpha() for c in letters):
            return m[0]
        score, word = self.path(letters)
        return word if word and score > sum(self.path(c)[0] for c in letters) else m[0]

    def decode(self, token: str) -> str:
        """A disguised word, or letters spaced out by single blanks or signs, restored; else the token as it is."""
        text = token.lower()
        if " " in text:
            parts = text.split(" ")
            score, word = self.path("".join(parts))
            apart = sum(self.path(p)[0] for p in parts)
            return word if score > apart else token
        given, text = text, _CHAIN.sub(self.joined, text)
        kept = token if text == given else text
        core = text.strip(PUNCTUATION)
        size = len(core)
        while size > 2 and core[size - 1] == core[size - 2] == core[size - 3] and not core[size - 1].isalpha():
            last = core[size - 1]
            while size and core[size - 1] == last:
                size -= 1
        core = core[:size]
        if not any(c.isalpha() for c in core):
            return kept
        forms = dict.fromkeys([core, text.strip(_EDGE), core.rstrip(_SIGNS + PUNCTUATION)])
        readings = [self.path(f) for f in forms if _TWICE.search(f) or any(c in LEET for c in f)]
        score, word = max(readings, default=(-math.inf, ""))
        return word if word and score > self.plain(core) else kept


def suspects(data: np.ndarray, offsets: np.ndarray, model: CharModel | None = None) -> list[tuple[int, int]]:
    """Byte spans of words that may be disguised, in order: every word or chain that has another reading.

    With a model, a word with nothing but a doubled letter is left out if halving gains less than it costs.
    """
    start, end, first = word_spans(data, offsets)
    if not len(start):
        return []
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
    codes = np.frombuffer(lower_ascii(data).tobytes().decode().encode("utf-32-le"), "<u4").copy()
    letter, leet = (codes >= 97) & (codes <= 122), np.zeros(len(codes), bool)
    for c in LEET:
        leet |= codes == ord(c)
    high = np.flatnonzero(codes >= 128)
    if len(high):
        values, back = np.unique(codes[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in values])[back]
        codes[high] = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in values], "<u4")[back]
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    unit, sign = letter | leet, ~(letter | white | ((codes >= 48) & (codes <= 57)))
    other = np.zeros(len(codes), bool)  # a letter twice, or three single characters with one same sign between
    other[:-1] = letter[:-1] & (codes[:-1] == codes[1:])
    if model is not None:
        other = worth_halving(codes, letter, other, model)
    other[:-4] |= unit[:-4] & sign[1:-3] & unit[2:-2] & (codes[1:-3] == codes[3:-1]) & unit[4:]

    def within(flags):
        """How many of the flagged characters each word has."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[stop] - total[begin]

    begin, stop = np.searchsorted(at, start), np.searchsorted(at, end)
    flagged = ((within(letter) > 0) & (within(leet) > 0)) | (within(other) > 0)
    single = (stop - begin <= PIECE) & (within(unit) == stop - begin)
    ends = np.cumsum(data == 10)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    chained = np.zeros(len(start), bool)
    chained[1:] = single[1:] & single[:-1] & (ends[start[1:]] == ends[end[:-1] - 1]) & (row[1:] == row[:-1])
    spans = [(int(start[i]), int(end[i])) for i in np.flatnonzero(flagged)]
    heads = np.flatnonzero(single & ~chained)
    for h in heads[np.append(chained, False)[heads + 1]]:
        t = h
        while t + 1 < len(start) and chained[t + 1]:
            t += 1
        if t - h >= 2:
            spans.append((int(start[h]), int(end[t])))
    return sorted(spans)


def worth_halving(codes: np.ndarray, letter: np.ndarray, twice: np.ndarray, model: CharModel) -> np.ndarray:
    """Which doubled letters the model would rather see once; runs of three and doubles close to others all stay."""
    at = np.flatnonzero(twice)
    around = np.concatenate([[32, 32], np.where(letter, codes, 32), [32, 32]]).astype(np.int64)
    before, x, after = around[at + 1], around[at + 2], around[at + 4]
    pair = lambda a, b, c: model.logs((a << 42) | (b << 21) | c)
    gain = pair(before, x, after) - pair(before, x, x) - pair(x, x, after)
    close = np.zeros(len(at), bool)
    close[1:] = np.diff(at) <= 3
    close[:-1] |= np.diff(at) <= 3
    out = np.zeros(len(codes), bool)
    out[at[close | (gain + COST_HALVE > 0)]] = True
    return out


def restore(column, decoder: Decoder) -> tuple[list[str | None], np.ndarray]:
    """Texts with disguised words restored, and how many spans were rewritten in each."""
    texts, (data, offsets) = column.to_pylist(), text_bytes(column)
    changed = np.zeros(len(texts), np.int64)
    spans = suspects(data, offsets, decoder.model)
    by_row: dict[int, list[tuple[int, int]]] = {}
    for a, b in spans:
        by_row.setdefault(int(np.searchsorted(offsets, a, side="right")) - 1, []).append((a, b))
    for r, found in by_row.items():
        raw, out, at = data[offsets[r] : offsets[r + 1]].tobytes(), [], 0
        for a, b in found:
            a, b = a - int(offsets[r]), b - int(offsets[r])
            token = raw[a:b].decode()
            word = decoder.restore[" ".join(token.split())]
            if word != token:
                out += [raw[at:a].decode(), word]
                at = b
                changed[r] += 1
        texts[r] = "".join(out) + raw[at:].decode()
    return texts, changed


# --- evidence ------------------------------------------------------------------------------------

def evidence(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features (64-bit hashes of beginnings of words and of whole words) of each row, and their rows."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    start, end, first = word_spans(np.where(_LETTER[data], data, 32).astype(np.uint8), offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    values, features, rows = _BYTE[data], [], []
    for k in (*PREFIXES, 0):
        fits = end - start > k if k else end - start >= 3
        s = start[fits]
        features.append((span_hashes(values, s, s + k if k else end[fits]) + np.uint64(k)).view(np.int64))
        rows.append(row[fits])
    features, rows = np.concatenate(features), np.concatenate(rows)
    order = np.lexsort((features, rows))
    features, rows = features[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (features[1:] != features[:-1]) | (rows[1:] != rows[:-1])
    return features[new], rows[new]


class Classifier:
    """Weights by feature, sorted, and three numbers of a logistic curve over the strongest and the summed evidence."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, curve: np.ndarray):
        order = np.argsort(features)
        self.features, self.weights, self.curve = features[order], weights[order], curve

    def hits(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, weight) of the features that speak for the label."""
        features, rows = evidence(column)
        if not len(self.features) or not len(features):
            return rows[:0], features[:0], np.zeros(0)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        found = self.features[at] == features
        return rows[found], features[found], self.weights[at[found]]

    def strength(self, column) -> np.ndarray:
        """Per row: the largest weight found, and the fourth root of the sum of fourth powers."""
        rows, _, w = self.hits(column)
        out = np.zeros((len(column), 2))
        np.maximum.at(out[:, 0], rows, w)
        out[:, 1] = np.bincount(rows, w**4, minlength=len(column)) ** 0.25
        return out

    def score(self, column) -> np.ndarray:
        if not len(self.curve):
            return np.zeros(len(column))
        x = self.strength(column) @ self.curve[1:] + self.curve[0]
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Explorer(Decoder):
    """Walks every path that decoding may take, and notes the trigrams on the way; probabilities decide nothing here."""

    def __init__(self):
        super().__init__(self)
        self.seen: set[str] = set()
        self.raw = False

    def log(self, before: str, c: str) -> float:
        self.seen.add(before + c)
        return 0.0

    word = CharModel.word

    def path(self, text: str) -> tuple[float, str]:
        super().path(text)
        return 1.0, "x"

    def joined(self, m: re.Match) -> str:
        super().joined(m)
        return m[0][::2] if self.raw else m[0]

    def explore(self, token: str) -> np.ndarray:
        self.seen.clear()
        for self.raw in (False, True):
            self.decode(token)
        codes = np.frombuffer("".join(self.seen).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, 3)
        return (codes[:, 0] << 42) | (codes[:, 1] << 21) | codes[:, 2]


class Known:
    """Log probabilities of the trigrams that one word asks for."""

    def __init__(self, grams: list[int], logs: list[float]):
        self.logs = dict(zip(grams, logs, strict=True))

    def log(self, before: str, c: str) -> float:
        return self.logs[gram(before + c)]

    word = CharModel.word


def log_probabilities(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, log) of trigrams, interpolated down to single characters, from the counts of all trigrams."""
    head, tail = F.shiftright("gram", 21), F.col("gram").bitwiseAND((1 << 42) - 1)
    middle, last = head.bitwiseAND((1 << 21) - 1), F.col("gram").bitwiseAND((1 << 21) - 1)
    total = float(grams.agg(F.sum("n")).first()[0] or 0) + 1.0
    summed = lambda key, name: grams.groupBy(key.alias(name)).agg(F.sum("n").alias(f"n_{name}"))
    ones = cut(summed(middle, "middle"), few=True)
    rows = merged(asked, grams, "gram", "left").withColumns({"head": head, "tail": tail, "middle": middle, "last": last})
    for side in (summed(head, "head"), summed(tail, "tail"), ones, ones.toDF("last", "n_last")):
        rows = merged(rows, side, side.columns[0], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    p1 = (n("n_last") + 0.5) / (total + 500)
    p2 = (n("n_tail") + 50 * p1) / (n("n_middle") + 50)
    return rows.select("gram", F.log((n("n") + 20 * p2) / (n("n_head") + 20)).alias("log"))


def decode_words(words: DataFrame, grams: DataFrame) -> DataFrame:
    """(token, word): each distinct suspicious word and what it is restored to, or itself."""

    def explore(batches):
        explorer = Explorer()
        for batch in batches:
            for token, key in zip(batch.column("token").to_pylist(), batch.column("key").to_pylist(), strict=True):
                asked = explorer.explore(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), key, np.int64)), pa.array(asked)], ["key", "gram"])

    def decode(batches):
        for batch in batches:
            tokens, found = batch.column("token").to_pylist(), batch.column("logs").to_pylist()
            out = [Decoder(Known([x["gram"] for x in logs], [x["log"] for x in logs])).decode(t) for t, logs in zip(tokens, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(out, pa.string())], ["token", "word"])

    words = cut(words.select("token").distinct().withColumn("key", F.xxhash64("token")), few=True)
    asked = cut(words.mapInArrow(explore, "key long, gram long"))
    logs = cut(log_probabilities(asked.select("gram").distinct(), grams), few=True)
    each = merged(asked, logs, "gram").groupBy("key").agg(F.collect_list(F.struct("gram", "log")).alias("logs"))
    decoded = cut(merged(words, each, "key").select("token", "logs").mapInArrow(decode, "token string, word string"), few=True)
    discard(asked, logs)
    return decoded


def spots(column) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each row's UTF-8 bytes and the spans of its suspicious words in them."""
    data, offsets = text_bytes(column)
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    for a, b in suspects(data, offsets):
        r = int(np.searchsorted(offsets, a, side="right")) - 1
        found[r].append((a - int(offsets[r]), b - int(offsets[r])))
    raw = data.tobytes()
    return [(raw[offsets[r] : offsets[r + 1]], spans) for r, spans in enumerate(found)]


def one_blank(token: bytes) -> str:
    return " ".join(token.decode().split())


def with_words(raw: bytes, spans: list[tuple[int, int]], words: list[str]) -> str:
    """A text with the given words in place of the spans."""
    out, at = [], 0
    for (a, b), word in zip(spans, words, strict=True):
        out += [raw[at:a].decode(), word]
        at = b
    return "".join(out) + raw[at:].decode()


def tokens_of(batches):
    """(row, token): the distinct suspicious words of each row."""
    for batch in slices(batches):
        rows, tokens = [], []
        for r, (raw, spans) in zip(batch.column("row").to_pylist(), spots(batch.column("text")), strict=True):
            found = {one_blank(raw[a:b]) for a, b in spans}
            rows += [r] * len(found)
            tokens += found
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(tokens, pa.string())], ["row", "token"])


def restored(docs: DataFrame, grams: "Trigrams") -> DataFrame:
    """`docs`, which have a column `text`, with their texts restored, and `n_restored`: spans rewritten in each."""
    ship(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_restored", T.LongType())])
    if grams.model is not None:
        shared = docs.sparkSession.sparkContext.broadcast(grams.model)

        def within(batches):
            decoder = Decoder(CharModel(*shared.value))
            for batch in slices(batches):
                texts, changed = restore(batch.column("text"), decoder)
                yield replaced(batch, texts, changed)

        return docs.mapInArrow(within, schema)

    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    tokens = cut(rows.select(F.col("_row").alias("row"), "text").mapInArrow(tokens_of, "row long, token string"))
    words = decode_words(tokens, grams.table)
    found = merged(tokens, words.where("token <> word"), "token").groupBy(F.col("row").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct("token", "word"))).alias("_words"))

    def apart(batches):
        for batch in slices(batches):
            texts, changed = [], []
            for (raw, spans), words in zip(spots(batch.column("text")), batch.column("_words").to_pylist(), strict=True):
                known = dict(words or ())
                new = [known.get(one_blank(raw[a:b]), raw[a:b].decode()) for a, b in spans]
                changed.append(sum(w != raw[a:b].decode() for w, (a, b) in zip(new, spans, strict=True)))
                texts.append(with_words(raw, spans, new))
            yield replaced(batch.drop_columns(["_row", "_words"]), texts, np.array(changed, np.int64))

    return merged(rows, found, "_row", "left").select(*docs.columns, "_row", "_words").mapInArrow(apart, schema)


def replaced(batch: pa.RecordBatch, texts: list[str | None], changed: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(changed)], [*batch.schema.names, "n_restored"])


class Trigrams:
    """The counted trigrams as a table, and as arrays for every task where they are few enough."""

    def __init__(self, table: DataFrame, most: int):
        self.table, self.model = table, None
        if table.count() <= most:
            arrow = table.toArrow()
            self.model = arrow.column("gram").to_numpy(), arrow.column("n").to_numpy()


class Toxicity:
    """A fitted model: the trigrams and the classifier."""

    def __init__(self, grams: Trigrams, classifier: Classifier):
        self.grams, self.classifier = grams, classifier


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000, smoothing: float = 4.0, broadcast_trigrams: int = 500_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Language model over all texts of `docs`; classifier from at most `sample_rows` labelled ones.

    The driver receives the features of those rows at most, and two numbers for each of them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    grams = Trigrams(cut(count_trigrams(docs), few=True), broadcast_trigrams)
    sample = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = sample.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", (F.col("y") > 0).alias("y"), (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("learn"))
    rows = cut(restored(rows, grams))
    sizes = {(r["learn"], r["y"]): r["count"] for r in rows.groupBy("learn", "y").count().collect()}
    clean, toxic = sizes.get((True, False), 0), sizes.get((True, True), 0)
    if not clean or not toxic:
        return Toxicity(grams, Classifier(np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))

    def count(batches):
        for batch in slices(batches):
            features, at = evidence(batch.column("text"))
            y = batch.column("y").to_numpy(zero_copy_only=False)[at]
            features, back = np.unique(features, return_inverse=True)
            both = [np.bincount(back, y == label, minlength=len(features)).astype(np.int64) for label in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array(features), *map(pa.array, both)], ["feature", "clean", "toxic"])

    base = toxic / (toxic + clean)
    counts = rows.where("learn").select("text", "y").mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + smoothing * base) / (F.col("clean") + smoothing * (1 - base))) - math.log(base / (1 - base))
    # a weight that does not speak for the label adds to neither strength, so it need not travel
    found = counts.withColumn("w", odds * F.col("toxic") / (F.col("toxic") + smoothing)).where("w > 0").select("feature", "w").toArrow()
    model = Classifier(found.column("feature").to_numpy(), found.column("w").to_numpy(), np.zeros(0))
    weighed = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in slices(batches):
            x = weighed.value.strength(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("y")], ["a", "b", "y"])

    x = rows.where("NOT learn").select("text", "y").mapInArrow(measure, "a double, b double, y boolean").toArrow()
    model.curve = logistic(np.column_stack([x.column("a").to_numpy(), x.column("b").to_numpy()]), x.column("y").to_numpy().astype(float))
    discard(rows)
    return Toxicity(grams, model)


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_restored) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.classifier)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text"))), batch.column("n_restored")], ["doc_id", "score", "n_restored"])

    rows = restored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model.grams)
    out = rows.mapInArrow(run, "doc_id long, score double, n_restored long")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_restored")


def accepted(docs: DataFrame, model: Toxicity, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns unchanged, whose whole text is not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model.classifier)
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        for batch in slices(batches):
            yield batch.select(["row"]).filter(pa.array(shared.value.score(batch.column("text")) < 0.5))

    kept = restored(rows, model.grams).select("text", "row").mapInArrow(run, T.StructType([rows.schema["row"]]))
    return kept.select("row.*")

"""Substring dedup with suffix automata over reference shards.

A window is 13 consecutive words. A window is removed from a document if a document of smaller doc_id holds
it too; words covered by a removed window go.

Which text can repeat is found first. The anchor of a window is the smallest hash among its five-word
grams, so equal windows have equal anchors; consecutive windows with one anchor form a segment. Anchors of
one document only are set aside: their windows cannot repeat. For the others, equal segments (same anchor and
same hash of all words) are one distinct segment, owned by the smallest document that holds it.

The distinct segments are the reference. They are dealt into shards by anchor, so a shard holds every place
where its windows may occur; the number of shards follows the amount of text, their size does not. Each
shard's segments go into one generalised suffix automaton whose states carry the smallest document that
reaches them; the segments are then streamed through it, and wherever the matching statistic reaches 13, the
state of that match tells the first document with the window. What a document loses is decided by these
statistics alone: a window goes where its first document is a smaller one.

An anchor with very many distinct segments (a passage in countless contexts) would outgrow a shard. Its
segments are taken apart into windows, which are dealt one by one; an automaton of texts of one window's
length could only tell equal from different, so equal ones are found by two 64-bit hashes.

The automata are not broadcast: the reference grows with the corpus, so each shard's automaton stays in the
task that built it and the segments that may match it are sent there.

Words are runs without ASCII white space, unchanged. Null and empty texts have no words. Rows without
doc_id are kept whole and are no reference; rows that repeat a doc_id are the same document, and each gives
an output row. Other columns are never read; an empty table gives no rows. Segments of one anchor are
compared by 64-bit hashes of all their words, windows inside automata word by word (48 bits each).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, discard, merged, ship
from .kernels import mix, slices, span_hashes, text_bytes, windows, word_hashes, word_spans

WINDOW, GRAM, LONGEST = 13, 5, 62  # words of a window and of an anchor; windows of a segment at most (bits of a mask)
SHARD_SEGMENTS, HOT_SEGMENTS, SALTS = 2_000, 2_000, 16
CODE_BYTES = 6


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; each state knows the smallest owner that reaches it."""

    def __init__(self):
        self.next, self.link, self.length, self.owner = [{}], [-1], [0], [1 << 63]

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.owner.append(1 << 63)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, words, owner: int) -> None:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in words:
            q = nxt[last].get(c)
            if q is None:
                cur, p = len(nxt), last
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                owners.append(1 << 63)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
                last = cur
            else:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, c)
            if owner < owners[last]:
                owners[last] = owner

    def close(self) -> None:
        """Pass owners from longer matches to their suffixes."""
        link, owners = self.link, self.owner
        for s in np.argsort(self.length)[:0:-1].tolist():
            p = link[s]
            if owners[s] < owners[p]:
                owners[p] = owners[s]

    def statistics(self, words, size: int):
        """For each position where the last `size` words occur in the reference: (position of the first of them, smallest owner)."""
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        state = matched = 0
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            q = nxt[state].get(c)
            if q is None:
                continue
            state, matched = q, matched + 1
            while length[link[state]] >= size:
                state = link[state]
            if matched >= size:
                matched = size
                yield i - size + 1, owners[state]


# --- inside tasks -------------------------------------------------------------------------------

def segments(column) -> dict[str, np.ndarray]:
    """Segments of all rows: row, anchor, fp (hash of the words), begin (first word), n (windows), and word hashes."""
    data, offsets = text_bytes(column)
    start, end, first = word_spans(data, offsets)
    h = word_hashes(data, start, end)
    at, bounds = windows(first, WINDOW)
    out = {"words": h, "first": first, "windows": at, "bounds": bounds}
    if not len(at):
        empty = np.zeros(0, np.int64)
        return out | {"row": empty, "anchor": empty, "fp": empty, "begin": empty, "n": empty}
    grams = np.arange(len(h) - GRAM + 1)
    g = span_hashes(h, grams, grams + GRAM)
    anchor = g[at].copy()
    for i in range(1, WINDOW - GRAM + 1):
        np.minimum(anchor, g[at + i], out=anchor)
    row = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
    change = np.ones(len(at), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(change)
    since = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(since % LONGEST == 0)
    n = np.diff(np.append(begin, len(at)))
    fp = span_hashes(h, at[begin], at[begin] + n + WINDOW - 1)
    return out | {"row": row[begin], "anchor": anchor[begin].view(np.int64), "fp": fp.view(np.int64), "begin": at[begin], "n": n}


def payload(words: np.ndarray, begin: np.ndarray, n: np.ndarray) -> pa.Array:
    """The words of each segment as fixed-width codes."""
    sizes = n + WINDOW - 1
    stop = np.cumsum(sizes)
    flat = np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - (stop - sizes), sizes)
    codes = np.ascontiguousarray(words[flat].view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES])
    offsets = np.concatenate([[0], stop * CODE_BYTES]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.tobytes())])


def codes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // CODE_BYTES, 8), np.uint8)
    wide[:, :CODE_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, CODE_BYTES)
    return wide.view(np.uint64).ravel()


def anchors_of(batches):
    """(anchor, low, high): anchors with the smallest and largest document of a slice."""
    for batch in slices(batches):
        s = segments(batch.column("text"))
        doc = batch.column("doc_id").to_numpy()[s["row"]]
        anchor, back = np.unique(s["anchor"], return_inverse=True)
        low, high = np.full(len(anchor), np.iinfo(np.int64).max), np.full(len(anchor), np.iinfo(np.int64).min)
        np.minimum.at(low, back, doc)
        np.maximum.at(high, back, doc)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(low), pa.array(high)], ["anchor", "low", "high"])


def segments_of(batches):
    """(doc_id, anchor, fp) of every segment, once a document."""
    for batch in slices(batches):
        s = segments(batch.column("text"))
        key = np.unique(np.stack([s["row"], s["fp"]], axis=1), axis=0, return_index=True)[1] if len(s["fp"]) else s["fp"]
        doc = batch.column("doc_id").to_numpy()[s["row"][key]]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s["anchor"][key]), pa.array(s["fp"][key])], ["doc_id", "anchor", "fp"])


def payloads_of(batches):
    """(low, anchor, fp, words) of the segments that each document is asked for in `wanted`."""
    for batch in slices(batches):
        s = segments(batch.column("text"))
        asked = {(r, fp) for r, wanted in enumerate(batch.column("wanted").to_pylist()) for fp in wanted}
        take = []
        for i, key in enumerate(zip(s["row"].tolist(), s["fp"].tolist(), strict=True)):
            if key in asked:
                asked.remove(key)
                take.append(i)
        take = np.array(take, np.int64)
        doc = batch.column("doc_id").to_numpy()[s["row"][take]]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(s["anchor"][take]), pa.array(s["fp"][take]), payload(s["words"], s["begin"][take], s["n"][take])], ["low", "anchor", "fp", "words"])


def match_shard(shard: pa.Table) -> pa.Table:
    """(anchor, fp, low, mask) of a shard's segments: the document from which on every window repeats, and the windows that a smaller one than the owner holds."""
    once = np.unique(np.stack([shard.column("anchor").to_numpy(), shard.column("fp").to_numpy()]), axis=1, return_index=True)[1]
    shard = shard.take(once)  # rows that repeat a doc_id send a segment twice
    owner, raw = shard.column("low").to_pylist(), shard.column("words").to_pylist()
    words = [codes(x).tolist() for x in raw]
    automaton = SuffixAutomaton()
    for w, o in zip(words, owner, strict=True):
        automaton.add(w, o)
    automaton.close()
    lows, masks = [], []
    for w, o in zip(words, owner, strict=True):
        low, mask = -(1 << 63), 0
        for i, first in automaton.statistics(w, WINDOW):
            low = max(low, first)
            if first < o:
                mask |= 1 << i
        lows.append(low)
        masks.append(mask)
    return pa.table({"anchor": shard.column("anchor"), "fp": shard.column("fp"), "low": pa.array(lows, pa.int64()), "mask": pa.array(masks, pa.int64())})


def windows_of(batches):
    """(anchor, fp, low, i, window, check) for each window of each segment given: two hashes of its words."""
    for batch in batches:
        out = {"anchor": [], "fp": [], "low": [], "i": [], "window": [], "check": []}
        for a, f, o, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "fp", "low", "words")), strict=True):
            w = codes(raw)
            at = np.arange(len(w) - WINDOW + 1)
            out["window"] += span_hashes(w, at, at + WINDOW).view(np.int64).tolist()
            out["check"] += span_hashes(mix(w), at, at + WINDOW).view(np.int64).tolist()
            out["i"] += at.tolist()
            for c, v in (("anchor", a), ("fp", f), ("low", o)):
                out[c] += [v] * len(at)
        yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int32() if c == "i" else pa.int64()) for c in out], list(out))


def remove(batches):
    """(doc_id, text, n_words, n_removed) after taking out the words that the marked windows cover."""
    for batch in slices(batches):
        data, offsets = text_bytes(batch.column("text"))
        start, end, first = word_spans(data, offsets)
        cover = np.zeros(len(start) + WINDOW + 1, np.int64)
        marks = {(r, m["fp"]): m["mask"] for r, given in enumerate(batch.column("marks").to_pylist()) for m in given or ()}
        s = segments(batch.column("text")) if marks else {"row": np.zeros(0, np.int64)}
        busy = np.flatnonzero(np.isin(s["row"], [r for r, _ in marks]))
        for i in busy.tolist():
            key = (int(s["row"][i]), int(s["fp"][i]))
            if key not in marks:
                continue
            base, n, mask = int(s["begin"][i]), int(s["n"][i]), marks[key]
            if mask is None:
                cover[base] += 1
                cover[base + n + WINDOW - 1] -= 1
            else:
                for j in range(n):
                    if mask >> j & 1:
                        cover[base + j] += 1
                        cover[base + j + WINDOW] -= 1
        gone = np.cumsum(cover)[: len(start)] > 0
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        removed = np.bincount(row[gone], minlength=len(first) - 1)
        stay = np.flatnonzero(~gone)
        sizes = end[stay] - start[stay] + 1
        stop = np.cumsum(sizes)
        flat = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start[stay] - (stop - sizes), sizes)
        kept = np.append(data, np.uint8(32))[flat]
        kept[stop - 1] = 32  # one blank after each word; the last one of a row is cut off below
        ends = np.concatenate([[0], stop])[np.searchsorted(stay, first)]
        raw = kept.tobytes()
        texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64))], ["doc_id", "text", "n_words", "n_removed"])


# --- on Spark ------------------------------------------------------------------------------------

def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, n_removed): each document without the words of windows that a smaller doc_id holds."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = docs.where("doc_id IS NOT NULL")
    live = own.mapInArrow(anchors_of, "anchor long, low long, high long").groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor")
    found = own.mapInArrow(segments_of, "doc_id long, anchor long, fp long")
    found = cut(merged(found, live, "anchor", "left_semi"))
    lows = cut(found.groupBy("anchor", "fp").agg(F.min("doc_id").alias("low")))
    wanted = lows.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list("fp").alias("wanted"))
    words = cut(merged(own, wanted, "doc_id").mapInArrow(payloads_of, "low long, anchor long, fp long, words binary"))

    # anchors that would outgrow a shard, found by counts and met by their segments in salted pieces
    hot = lows.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT_SEGMENTS)
    hot = hot.select("anchor", F.lit(True).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    told = cut(merged(words.withColumn("salt", F.pmod("fp", F.lit(SALTS)).cast("int")), hot, ["anchor", "salt"], "left").drop("salt"))
    shards = max(1, -(-lows.count() // SHARD_SEGMENTS))
    dealt = told.where("hot IS NULL").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    known = dealt.groupBy("shard").applyInArrow(match_shard, "anchor long, fp long, low long, mask long")

    apart = cut(told.where("hot").select("anchor", "fp", "low", "words").mapInArrow(windows_of, "anchor long, fp long, low long, i int, window long, check long"))
    firsts = apart.groupBy("window", "check").agg(F.min("low").alias("first"))
    smaller = F.expr("bit_or(CASE WHEN first < low THEN shiftleft(1L, i) ELSE 0L END)")
    apart = merged(apart, firsts, ["window", "check"]).groupBy("anchor", "fp").agg(F.min("low").alias("low"), smaller.alias("mask"))
    known = cut(known.unionByName(apart))

    marked = merged(found, known, ["anchor", "fp"]).where("doc_id > low OR mask <> 0")
    mark = F.struct("fp", F.when(F.col("doc_id") <= F.col("low"), F.col("mask")).alias("mask"))
    marks = cut(marked.select("doc_id", mark.alias("mark")).distinct().groupBy("doc_id").agg(F.collect_list("mark").alias("marks")))
    discard(found, lows, words, told, known)
    return merged(docs, marks, "doc_id", "left").mapInArrow(remove, "doc_id long, text string, n_words long, n_removed long")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS k FROM wins
), firsts AS (
  SELECT k, min(doc_id) AS low FROM keyed GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM keyed JOIN firsts USING (k) WHERE doc_id > low
), each AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM words
), kept AS (
  SELECT each.doc_id, count(*) FILTER (WHERE gone.j IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY each.j) FILTER (WHERE gone.j IS NULL) AS t
  FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.j = gone.j GROUP BY each.doc_id
)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

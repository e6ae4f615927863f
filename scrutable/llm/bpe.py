"""Byte-pair encoding from a public tokenizer file: merges, forced boundaries, whole-token table.

A tokenizer file (JSON with a vocabulary and ranked merges over byte characters) is read once on the
driver; what tasks need is a few bounded tables (at most one entry a vocabulary string or merge).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from os.path import commonprefix

import regex

#: The split patterns of the two public tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CACHE = 250_000  # distinct pre-tokens whose result a task remembers; beyond it the memory is emptied, results don't change


def byte_characters() -> list[str]:
    """The printable stand-in character of each byte: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids and ranked merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.byte = byte_characters()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])

    def forced_pairs(self) -> frozenset[tuple[str, str]]:
        """Pairs of neighbouring byte characters found inside some token; a cut is certain between any others."""
        inside = set()
        for token in self.ids:
            plain = token.removesuffix(self.suffix) if self.suffix else token
            inside.update(zip(plain, plain[1:], strict=False))
        return frozenset(inside)

    def symbols(self, text: str, last: bool) -> list[int]:
        """Start symbols of a run of byte characters; the last one carries the end-of-word suffix."""
        out = [self.ids[c] for c in text]
        if last and self.suffix and text:
            out[-1] = self.ids[text[-1] + self.suffix]
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the lowest-ranked merge, leftmost first, until none applies; O(n log n) by a heap over a linked list."""
        merges = self.merges
        if len(ids) < 2:
            return ids
        if len(ids) <= 24:
            while True:
                best, at = None, -1
                for i in range(len(ids) - 1):
                    m = merges.get((ids[i], ids[i + 1]))
                    if m is not None and (best is None or m[0] < best[0]):
                        best, at = m, i
                if best is None:
                    return ids
                ids = [*ids[:at], best[1], *ids[at + 2 :]]
        ids, n = list(ids), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


class Remembered(dict):
    """A bounded memory of a function of strings: looked up in C, computed where missing; keys over `longest` are not kept."""

    def __init__(self, function, limit: int = CACHE, longest: int = 1 << 16):
        super().__init__()
        self.function, self.limit, self.longest = function, limit, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.function(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.function(key)
        return value


def special_mark(special) -> str | None:
    """What all special strings begin with: a text without it holds none. None where there are no special strings."""
    return commonprefix(list(special)) if special else None


def special_splitter(special):
    return regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")")


def newer_characters() -> re.Pattern:
    """Characters that Unicode tables of different years may read differently: assigned since 3.2 or not at all.

    Signs and emoji are the same in all of them and stay out, as most texts with characters that new hold those.
    """
    newer = [c for c in map(chr, range(0x10000)) if unicodedata.ucd_3_2_0.category(c) == "Cn" and unicodedata.category(c) not in ("So", "Sm", "Sc")]
    return re.compile("[" + "".join(newer) + "\U00010000-\U0001EFFF\U0001FBF0-\U0010FFFF]")


def normal(text: str) -> str:
    """NFC, then each character lower-cased by itself (no final-sigma rule)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            return "".join(c.lower() for c in text)
    return text.lower()

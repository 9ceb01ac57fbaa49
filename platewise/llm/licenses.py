"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import batches
from .license_texts import TEXTS

#: Words in a fingerprint and fingerprints in a window: every run of GRAM + WINDOW - 1 words that a text shares with a template has one.
GRAM, WINDOW = 3, 3
#: Cells on either side of the candidates' diagonals.
BAND = 8
#: Share of a template's words that must be matched in order.
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def winnowed(words: list[str]) -> set[int]:
    """Places of the fingerprints: in each window of grams that with the smallest hash, the last one of equals."""
    grams = [xxhash.xxh64_intdigest(" ".join(words[i:i + GRAM])) for i in range(max(1, len(words) - GRAM + 1))]
    width = min(WINDOW, len(grams))
    return {min(range(at, at + width), key=lambda i: (grams[i], -i)) for at in range(len(grams) - width + 1)}


def align(template: list[str], words: list[str | None], low: int, high: int) -> tuple[int, int, int, int, int] | None:
    """(score, matched, first, last, template words passed) of the best local alignment among the diagonals `low` to
    `high` (place in the text less place in the template); the first of equal ones."""
    width = high - low + 1
    # score, matched words, first word, last word of the alignment that ends in each cell
    none = (0, 0, -1, -1)
    above, best = [none] * (width + 1), None
    for i, want in enumerate(template):
        row, left = [none] * (width + 1), none
        for c in range(width):
            j = i + low + c
            if not 0 <= j < len(words):
                left = none
                continue
            diagonal, up = above[c], above[c + 1]
            if words[j] == want:
                cell = (diagonal[0] + MATCH, diagonal[1] + 1, diagonal[2] if diagonal[0] > 0 else j, j)
            else:
                cell = (diagonal[0] + MISMATCH, *diagonal[1:])
            if up[0] + GAP > cell[0]:
                cell = (up[0] + GAP, *up[1:])
            if left[0] + GAP > cell[0]:
                cell = (left[0] + GAP, *left[1:])
            if cell[0] <= 0:
                cell = none
            row[c] = left = cell
            if cell[0] and (best is None or cell[0] > best[0]):
                best = (*cell, i + 1)
        above = row
    return best


class Scanner:
    """An inverted index of the templates' fingerprints and the alignments against them."""

    def __init__(self, templates: Mapping[str, str], coverage: float, band: int):
        self.names, self.words = list(templates), [words_of(t) for t in templates.values()]
        self.coverage, self.band = coverage, band
        self.index: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for at in winnowed(words) if words else ():
                self.index[tuple(words[at:at + GRAM])].append((t, at))
        self.first = {gram[0] for gram in self.index}
        self.short = sorted({len(gram) for gram in self.index})

    def hits(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Template: (diagonal, place in the text) of each shared fingerprint."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in [k for k, w in enumerate(words) if w in self.first]:
            for n in self.short:
                for t, place in self.index.get(tuple(words[at:at + n]), ()):
                    found[t].append((at - place, at))
        return found

    def candidates(self, hits: list[tuple[int, int]], size: int) -> Iterator[list[tuple[int, int]]]:
        """Hits whose diagonals lie within a band of each other belong together."""
        reach = max(self.band, size // 8)
        group: list[tuple[int, int]] = []
        for hit in sorted(hits):
            if group and (hit[0] - group[-1][0] > reach or hit[0] - group[0][0] > 4 * reach):
                yield group
                group = []
            group.append(hit)
        yield group

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) by start; start and end are code points.  Of overlapping
        findings that with more matched words stays, of equal ones that with more coverage, then the earlier."""
        words = words_of(text)
        found = []
        for t, hits in self.hits(words).items():
            template = self.words[t]
            for group in self.candidates(hits, len(template)):
                low, high = group[0][0] - self.band, group[-1][0] + self.band
                start = max(0, low)
                part: list[str | None] = words[start:len(template) + high]
                while group and (best := align(template, part, low - start, high - start)) and best[1] >= self.coverage * len(template):
                    _, matched, first, last, _ = best
                    found.append((-matched, -matched / len(template), first + start, last + start, t))
                    part[first:last + 1] = [None] * (last + 1 - first)  # a next occurrence lies outside
                    group = [h for h in group if not first <= h[1] - start <= last]
        if not found:
            return []
        kept: list[tuple] = []
        for f in sorted(found):
            if all(f[3] < k[2] or f[2] > k[3] for k in kept):
                kept.append(f)
        kept.sort(key=lambda f: f[2])
        # Lower case may have more code points than the text ("İ"): places are taken from the text word by word.
        places = self._places(text, words)
        return [(self.names[f[4]], -f[1], -f[0], places[f[2]][0], places[f[3]][1]) for f in kept]

    @staticmethod
    def _places(text: str, words: list[str]) -> list[tuple[int, int]]:
        places = [m.span() for m in _WORD.finditer(text.lower())]
        if len(text.lower()) == len(text):
            return places
        back = [k for k, c in enumerate(text) for _ in c.lower()]
        return [(back[a], back[b - 1] + 1) for a, b in places]


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], coverage: float, band: int) -> Scanner:
    return Scanner(dict(templates), coverage, band)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEXTS, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """doc_id, license, coverage, matched_words, start, end: a row per finding.

    Every run of five words that a document shares with a template gives a candidate; only these are aligned, along the
    diagonals of their fingerprints, so the work grows with the words and the findings.  The templates are part of
    the program and the only thing that all tasks hold; nothing moves between partitions.

    Null, empty and very short texts have no findings.  Every occurrence is reported; a template without words matches
    nothing.  Rows with a null or repeated doc_id are scanned as they are; an empty table gives no rows.
    """
    key = tuple(templates.items())
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, coverage, band)
        for batch in batches(it):
            found = [(k, *f) for k, t in enumerate(batch.column(1).to_pylist()) if t for f in scanner.scan(t)]
            if found:
                row, name, share, matched, start, end = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(name), pa.array(share, pa.float64()), pa.array(matched, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["doc_id", "license", "coverage", "matched_words", "start", "end"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, license string, coverage double, matched_words long, start long, end long")

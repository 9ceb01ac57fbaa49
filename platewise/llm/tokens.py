"""Token ids of whole texts by files of the tokenizers library."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import batches

#: Pieces remembered in each of two generations; the older one is dropped when the younger is full.
REMEMBERED = 250_000
#: Pieces of these parts alone are split here as the files do it: Latin letters (composed, so that normal forms leave
#: them alone), digits and ASCII marks but for the apostrophe, which the files treat apart.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_PARTS = {True: re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+"), False: re.compile(f"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+")}
#: White space beyond blank, tab and line ends: there Python and the tokenizers need not agree on what splits.
_RARE_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_PAIR = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile("[ \t\r\n]+")
#: Characters that every library puts into the same class, those of Latin-1 and a few more.
_LATIN = bytes([9, 10, 13, *range(32, 127), *range(161, 173), *range(174, 256)])
_COMMON = {*_LATIN.decode("latin-1"), *map(chr, range(0x2010, 0x2028)), *"‹›€"}
#: Texts with runs of twice as many characters, or of white space, do not go to a backtracking pattern.
_WORD_PART, _GAP_PART = 500, 100


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take the letters from 256 on in their order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Encoder:
    """Encodes texts piece by piece.

    No token of these files reaches over the cuts made here, so the ids of a text are those of its pieces in
    turn, and a piece that came before need not be encoded again.  `word` files drop white space: they are cut at
    it.  Byte-level files join a blank to what follows: they are cut before single blanks between other
    characters.  Texts that hold the spelling of a special token are encoded whole.

    A byte-level file that tiktoken can run by its own vocabulary is run by it over texts of common characters, which takes
    about 60 % of the time; the pieces are for the other texts.
    """

    def __init__(self, path: str, word: bool, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word, self.young, self.old, self.parts = word, {}, {}, {}
        self.letters = _byte_letters()
        self.size = max(self.tokenizer.get_vocab_size(), end + 1)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.end = np.array([end], self.kind).tobytes()
        self.fast = None
        if not word:
            from .alignment import Bytewise  # which imports this module

            self.fast = Bytewise(path).fast

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of pieces not seen before: simple ones part by part, others by the whole file."""
        simple, parts, known = _SIMPLE.fullmatch, _PARTS[self.word].findall, self.parts
        blank, code, tokenize = self.letters[32], self.code, self.tokenizer.model.tokenize
        other = []
        for piece in pieces:
            if not simple(piece):
                other.append(piece)
                continue
            found = parts(piece.lower() if self.word else piece)
            if not self.word:
                found[0] = blank + found[0]
            for f in found:
                if f not in known:
                    # Printable ASCII stands for itself; so does the letter that stands for the blank.
                    letters = f if piece.isascii() else "".join(map(self.letters.__getitem__, f.replace(blank, " ").encode()))
                    known[f] = array(code, [t.id for t in tokenize(letters)]).tobytes()
            yield piece, known[found[0]] if len(found) == 1 else b"".join([known[f] for f in found])
        yield from zip(other, self._bytes(other if self.word else [" " + p for p in other]))
        if len(known) > REMEMBERED:
            known.clear()

    def _pieces(self, text: str) -> tuple[str | None, list[str]]:
        """What is encoded as it is at the start of the text, and the pieces after it."""
        if "<|" in text:
            return text, []
        if self.word:
            return None, _PLAIN.split(text) if _RARE_SPACE.search(text) else text.split()
        if _PAIR.search(text):
            first, *rest = _SINGLE.split(text)
            return first, rest
        first, blank, rest = text.partition(" ")
        return first, rest.split(" ") if blank else []

    @staticmethod
    def _common(text: str) -> bool:
        """Whether tiktoken gives the ids of the tokenizers library: common characters, no special spelling, no very long run."""
        if "<|" in text:
            return False
        try:
            odd = bool(text.encode("latin-1").translate(None, _LATIN))
        except UnicodeEncodeError:
            odd = not _COMMON.issuperset(text)
        # A long run covers one of the aligned stretches.
        n = len(text)
        return not odd and (all(text.find(" ", at, at + _WORD_PART) >= 0 for at in range(0, n - _WORD_PART + 1, _WORD_PART))
                            and not any(text[at:at + _GAP_PART].isspace() for at in range(0, n - _GAP_PART + 1, _GAP_PART)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian unsigned integers of `kind`."""
        if self.fast is None:
            return self._by_pieces(texts)
        common = list(map(self._common, texts))
        rest = iter(self._by_pieces([t for t, c in zip(texts, common) if not c]))
        encode, code, end = self.fast.encode_ordinary, self.code, self.end
        return [array(code, encode(t)).tobytes() + end if c else next(rest) for t, c in zip(texts, common)]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        known = self.young
        old, fresh = self.old, []
        for p in set().union(*(rest for _, rest in cut)):
            if p not in known:
                if p in old:
                    known[p] = old[p]
                else:
                    fresh.append(p)
        known.update(self._fresh(fresh))
        first = iter(self._bytes([f for f, _ in cut if f is not None]))
        get, end = known.__getitem__, self.end
        out = [b"".join([b"" if f is None else next(first), *map(get, rest), end]) for f, rest in cut]
        if len(known) > REMEMBERED:
            self.old, self.young = known, {}
        return out


@lru_cache(maxsize=4)
def encoder(path: str, word: bool, end: int) -> Encoder:
    """One encoder per file in a worker; it lives on from task to task."""
    return Encoder(path, word, end)


def token_rows(docs: DataFrame, path: str, word: bool, end: int, doc_id: str = "doc_id", text: str = "text", squeeze: bool = False) -> DataFrame:
    """part, doc_id, start, n_tokens, ids: the ids of every document with the end id, in the order of each
    partition; start counts the ids before it in its partition.  Null texts are empty; each row is a document.

    With `squeeze` the ids are compressed and `tie`, the crc32 of the plain ones, is added: in the same function, since each
    further one in a stage would have workers, and encoders, of its own."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path, word, end), TaskContext.get().partitionId(), 0
        width, small = np.dtype(enc.kind).itemsize, zstandard.ZstdCompressor(level=1).compress
        for batch in batches(it, 256):
            ids = enc.encode([t or "" for t in batch.column(1).to_pylist()])
            n = np.array([len(b) // width for b in ids], np.int64)
            start = at + np.cumsum(n) - n
            at += int(n.sum())
            arrays, names = [pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(start), pa.array(n)], ["part", "doc_id", "start", "n_tokens"]
            if squeeze:
                arrays.append(pa.array([zlib.crc32(b) for b in ids], pa.int64()))
                names.append("tie")
                ids = [small(b) for b in ids]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.binary())], names=[*names, "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"part int, doc_id {kind}, start long, n_tokens long, {'tie long, ' if squeeze else ''}ids binary")


def wide(ids: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(ids, kind).astype("<u4")



"""Encoding of whole texts with a public byte-level BPE vocabulary, by batched numpy merge rounds.

Each Arrow batch is split into words as the vocabulary asks (on flat arrays of code points); the distinct words are kept as one flat array of
symbols.  A round finds, for every word at once, its lowest-ranked adjacent pair (binary search over the sorted pair
keys) and merges all its occurrences; words without a known pair leave the array.  The ids equal those of the
sequential algorithm, since within a word always the lowest-ranked pair goes first, left to right.

Defined cases: a null or empty text gives an empty list; special-token strings inside a text are ordinary text; texts
of any length are encoded whole; other columns do not matter; repeated ids give repeated rows; an empty table gives an
empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisframe.llm.codepoints import SPACE, blocks, class_table, flatten, spread
from axisframe.workspace import ship_package

#: The contractions that the vocabulary splits off, by their first letter.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")
_SHIFT = np.int64(20)
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, as character -> byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(hidden)}


@dataclass(frozen=True)
class Merges:
    """A vocabulary as arrays: id of each byte; sorted pair keys with the rank and the id of the merged symbol."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray

    @classmethod
    def from_json(cls, path: str) -> Merges:
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = (left << _SHIFT) | right
        order = np.argsort(keys, kind="stable")
        byte_ids = np.zeros(256, np.int32)
        for char, byte in byte_alphabet().items():
            byte_ids[byte] = vocab[char]
        return cls(byte_ids, keys[order], order.astype(np.int32), merged[order])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Position of each pair's merge in key order, or ``_NONE``."""
        wanted = (left.astype(np.int64) << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)


def encode_words(data: np.ndarray, offsets: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words at once.  ``data``: their bytes, one after another; word w has bytes offsets[w]:offsets[w+1].
    Gives the ids in the same form."""
    by_rank_id = np.empty(len(m.ranks), np.int32)
    by_rank_id[m.ranks] = m.merged
    lengths = np.diff(offsets)
    symbols = m.byte_ids[data]
    word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    done_word: list[np.ndarray] = []
    done_symbols: list[np.ndarray] = []

    rank = np.full(len(symbols), _NONE, np.int32)
    if len(symbols) > 1:
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = m.rank_of(symbols[inside], symbols[inside + 1])
    while len(symbols):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[first, len(word)])
        lowest = np.minimum.reduceat(rank, first)
        going = np.repeat(lowest != _NONE, sizes)
        if not going.all():
            done_word.append(word[~going])
            done_symbols.append(symbols[~going])
            symbols, word, rank = symbols[going], word[going], rank[going]
            kept = lowest != _NONE
            sizes, lowest = sizes[kept], lowest[kept]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, sizes))
        # Consecutive hits are overlapping occurrences of one pair (x x x): every other one merges, from the left.
        starts_run = np.r_[True, np.diff(at) != 1]
        run_start = np.maximum.accumulate(np.where(starts_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols[at] = by_rank_id[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        now = at - np.arange(len(at))
        symbols, word, rank = symbols[keep], word[keep], rank[keep]
        for changed in (now, now[now > 0] - 1):
            inside = changed[changed + 1 < len(symbols)]
            same = word[inside] == word[inside + 1]
            rank[inside] = np.where(same, m.rank_of(symbols[inside], symbols[inside + 1]), _NONE)
            rank[changed[changed + 1 >= len(symbols)]] = _NONE
    if not done_word:
        return np.zeros(0, np.int32), np.zeros(len(lengths) + 1, np.int64)
    words, ids = np.concatenate(done_word), np.concatenate(done_symbols)
    ids = ids[np.argsort(words, kind="stable")]
    return ids, np.r_[0, np.cumsum(np.bincount(words, minlength=len(lengths)))]


def word_starts(chars: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each code point begins a word.  Words are runs of letters, of numbers, or of other characters, each with
    one space before it; contractions; and white space, whose last character stands alone unless the text ends."""
    n, kind = len(chars), table[chars]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    run = first.copy()
    run[0] = True
    run[1:n] |= kind[1:] != kind[:-1]
    begins = run[:n].copy()
    # White space that something follows in the same text.
    follows = np.flatnonzero(run[1:n] & ~first[1:n] & (kind[: n - 1] == SPACE)) + 1
    begins[follows - 1] = True
    begins[follows[chars[follows - 1] == 32]] = False
    quote = np.flatnonzero((chars == 39) & begins)
    room = np.searchsorted(starts, quote, side="right")
    room = starts[np.minimum(room, len(starts) - 1)] - quote
    at = lambda k: np.where(room > k, chars[np.minimum(quote + k, n - 1)], 0)
    one = np.isin(at(1), [ord(c) for c in ONE_LETTER])
    two = np.zeros(len(quote), bool)
    for a, b in TWO_LETTERS:
        two |= (at(1) == ord(a)) & (at(2) == ord(b))
    for hit, size in ((one, 2), (two, 3)):
        begins[quote[hit] + 1] = False
        begins[quote[hit & (room > size)] + size] = True
    return begins


def encode_texts(texts: pa.Array, table: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of ``texts`` and where each text's ids start (one more than there are texts)."""
    chars, starts = flatten(texts)
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    begins = np.flatnonzero(word_starts(chars, starts, table))
    width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
    bytes_to = np.r_[0, np.cumsum(width, dtype=np.int64)]
    del chars, width
    whole = pa.array(["".join(x for x in texts.to_pylist() if x)], pa.large_string()).buffers()[2]
    offsets = np.r_[bytes_to[begins], bytes_to[-1]]
    pieces = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), whole)
    per_text = np.searchsorted(begins, starts)
    coded = pieces.dictionary_encode()
    del pieces, bytes_to
    distinct = coded.dictionary.cast(pa.large_binary())
    _, offsets, data = distinct.buffers()
    offsets = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    ids, id_starts = encode_words(data, offsets - offsets[0], m)
    use = coded.indices.to_numpy(zero_copy_only=False)
    sizes = np.diff(id_starts)[use]
    return ids[spread(id_starts[use], sizes)], np.r_[0, np.cumsum(sizes)][per_text]


_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def safe_parts(text: str, most: int) -> list[str]:
    """A long text in parts of about ``most`` characters whose ids, one after another, are those of the whole: cut before
    single spaces between letters, where a word always begins."""
    parts, start = [], 0
    while len(text) - start > most and (cut := _CUT.search(text, start + most)):
        parts.append(text[start : cut.start()])
        start = cut.start()
    return [*parts, text[start:]]


def encode_corpus(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """(id_col, ids): the token ids of every text, without special tokens.  One narrow pass, no shuffle; the
    vocabulary and the table of character classes (of fixed size, under 3 MB) is broadcast, so executors need no file."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((class_table(), Merges.from_json(vocab_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, m = shared.value
        for batch in batches:
            for a, b in blocks(batch.column(1), block_bytes):
                part = batch.slice(a, b - a)
                texts = part.column(1)
                if b - a == 1 and texts[0].is_valid and len(text := texts[0].as_py()) > block_bytes:
                    ids = np.concatenate([encode_texts(pa.array([x]), table, m)[0] for x in safe_parts(text, block_bytes)])
                    starts = np.array([0, len(ids)])
                else:
                    ids, starts = encode_texts(texts, table, m)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)

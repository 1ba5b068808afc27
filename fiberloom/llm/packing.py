"""Packing token pieces into fixed windows by minimum bin slack.

Texts are tokenized in Arrow batches; each document (its ids and a closing id) is cut into full windows
and one remainder.  From then on only piece rows are moved, never ids.

Windows are planned on the histogram of piece lengths, which has at most ``capacity`` entries whatever
the number of documents.  A bitset subset-sum program over the lengths that are left, each up to its
count, finds the multiset that fills a window closest to capacity; backtracking over the saved bitsets
gives its counts.  The multiset is laid down as often as the counts allow, so the number of different
multisets stays in the order of the number of lengths.

A piece finds its window by its number among the pieces of its length.  These numbers come from counts
by (length, hash bucket) and a numbering inside each bucket, so that one frequent length is shared out.

Defined cases: a null text is an empty one and packs as its closing id alone; repeated rows are
separate documents with pieces of their own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiberloom.llm.batches import bounded, tidy
from fiberloom.scratch import settle

CAPACITY = 2048
END_ID = 1
#: Words and stems whose ids a worker remembers, the length above which it remembers none, and characters encoded at a time.
CACHE_WORDS, CACHE_UNITS, CACHE_CHARS, GROUP_CHARS = 200_000, 250_000, 40, 1 << 19
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)").fullmatch
#: How byte-level vocabularies show bytes that are not printable Latin-1: counted on from 256.
SHOWN_BYTES = dict(zip((b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)), range(256, 512), strict=False))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of whole texts, by way of their space-separated words.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its
    words in a row.  Words are looked up first.  A new word of Latin-1 letters, perhaps with ASCII signs behind them,
    is put together from its lower-cased stem and its tail, each given to the BPE model as the
    tokenizer's own steps would give it; every other new word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def unit(self, text: str) -> bytes:
        """Ids of one piece that the tokenizer's patterns would not split."""
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(SHOWN_BYTES)
        found = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        if len(self.units) >= CACHE_UNITS:
            self.units.clear()
        self.units[text] = found
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.words)
        if len(self.words) + len(new) > CACHE_WORDS and len(new) > 0.3 * sum(map(len, split)):
            self.words.clear()  # what is remembered is of other texts
            new = set().union(*split)
        others, units, unit = [], self.units.get, self.unit
        for w in new:
            if m := SIMPLE(w):
                stem, tail = m.groups()
                stem = stem.lower()
                ids = units(stem) or unit(stem)
                self.words[w] = ids + (units(tail) or unit(tail)) if tail else ids
            else:
                others.append(w)
        for w, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.words[w] = array("I", e.ids).tobytes()
        out = [np.frombuffer(b"".join(map(self.words.__getitem__, words)), dtype="<u4") for words in split]
        forget = new if len(self.words) > CACHE_WORDS else [w for w in others if len(w) > CACHE_CHARS]
        for w in forget:
            del self.words[w]
        return out


def encoded(encoder: WordEncoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text in order, encoded in groups of about GROUP_CHARS characters."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py() or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield from encoder.encode(group)
            group, size = [], 0
    yield from encoder.encode(group)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full windows from its start, then what is left; with the ids too if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            blobs: list[bytes] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(encoder, batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity].tobytes()
                    rows.append((doc_id, at, len(own) // 4, zlib.crc32(own), len(ids)))
                    if with_ids:
                        blobs.append(own)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(blobs, pa.binary())] if with_ids else []), names=names + (["ids"] if with_ids else []))

    return bounded(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES + (", ids binary" if with_ids else ""))


def fill_window(lengths: list[int], counts: list[int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest to capacity, as length to number.

    ``reach`` is a bitset of sums, bit s set if s can be made; each length is added in powers of two up to
    its count.  The bitset before each such item is kept for backtracking.  Longer lengths come first, so
    that among equal fills short pieces, which fit anywhere, are kept back.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length, count in zip(lengths, counts, strict=True):
        left, block = min(count, capacity // length), 1
        while left:
            n = min(block, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left, block = left - n, block * 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            used[length] = used.get(length, 0) + n
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, each, offset, sequence, times): pieces ``first`` and on of a length go ``each`` to a window.

    Piece number r of that length with first <= r < first + each * times lies in window
    sequence + (r - first) // each at offset + length * ((r - first) % each).
    """
    left = {k: n for k, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    plan, sequence = [], 0
    while left:
        lengths = sorted(left, reverse=True)
        fill = fill_window(lengths, [left[k] for k in lengths], capacity)
        times, offset = min(left[k] // n for k, n in fill.items()), 0
        for k in sorted(fill, reverse=True):
            plan.append((k, used[k], fill[k], offset, sequence, times))
            offset += k * fill[k]
            used[k] += fill[k] * times
            left[k] -= fill[k] * times
            if not left[k]:
                del left[k]
        sequence += times
    return plan


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a settled table of pieces (doc_id, start, length, ids_crc32, ...)."""
    spark = pieces.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = settle(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(plan_windows(histogram, capacity) or [], "length long, first long, each long, at long, sequence long, times long")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "_bucket", before.alias("_before"))  # at most capacity times buckets rows
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = dealt.withColumn("_inside", inside).join(starts, ["length", "_bucket"]).withColumn("_r", F.col("_before") + F.col("_inside"))
    steps = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "each", "at", "sequence", "times"))).alias("_steps"))
    # of the steps of its length, the last that starts at or before the piece's number
    placed = numbered.join(F.broadcast(steps), "length").withColumn("_s", F.element_at(F.filter("_steps", lambda s: s["first"] <= F.col("_r")), -1))
    nth = F.col("_r") - F.col("_s.first")
    sequence = F.col("_s.sequence") + F.floor(nth / F.col("_s.each"))
    offset = F.col("_s.at") + F.col("length") * (nth % F.col("_s.each"))
    return placed.select(*[c for c in pieces.columns], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its window: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return place(settle(cut_pieces(documents, path or tokenizer_path(), capacity, end_id), "pack-pieces"), capacity)

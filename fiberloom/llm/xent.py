"""Cross-entropy difference: how much more a text is like a target than like the corpus.

Two bigram models, of the target documents and of all documents, share one vocabulary (words and bigrams under
64-bit hashes), one order and one smoothing:

    P(w) = (c(w) + ALPHA) / (N + ALPHA * V)        P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU)

V is the number of distinct words of the corpus, and 1 << WORD_BITS at least: what a small corpus has less is kept
for words unseen.  A document's loss under a model is the mean of -log2 P over its words, each after the one before
it (the first after a start sign); its score is target loss minus background loss, lower being more like the target.

Every word of every document is counted.  Documents are read once, in chunks of CHUNK_CHARS; a chunk keeps its words by
number and sends each distinct word and bigram once, with its counts, to the bucket of its hash.  Buckets add up
the chunks' counts and send each chunk the sums of what it has; chunks then score their documents.  The number of
buckets grows with the corpus, and a common word is one entry of each chunk, so no task grows with either.  Which
documents are targets meets the ids of the chunks by a shuffle and comes back as one bit a document, so that no task and
not the driver holds the table of targets, which grows with the corpus.

Defined cases: a null text or one without words has no losses and no score (null); labels without a matching
document count for nothing; without any target document its model is uniform, which leaves scores comparable;
a doc_id labelled twice counts once; rows that share a doc_id are each counted and scored; an empty table gives
an empty result; other columns are ignored.  A target document's own words are part of the target counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.batches import bounded, give_back, tidy
from fiberloom.scratch import join_checked, settle

#: The least vocabulary of the smoothing.
WORD_BITS = 17
ALPHA, MU = 0.5, 4.0
START = 0
CACHE_WORDS = 1 << 18
CHUNK_CHARS = 1 << 24
#: Words of the corpus for each bucket, and the least number of buckets.
BUCKET_WORDS, LEAST_BUCKETS = 5_000_000, 64
U = np.uint64
SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")
#: A chunk: ids and sizes of its documents, their words by number, and the hashes of these.
CHUNK = "chunk long, ids array<long>, sizes binary, own binary, words binary, n_words long, starts long"
#: What a chunk has of a bucket, in order of hashes: those and its counts, or the counts of the corpus.
SENT = "chunk long, bucket long, words binary, pairs binary, word_counts binary, pair_counts binary"
SUMS = "chunk long, bucket long, word_counts binary, pair_counts binary, vocabulary long"


def squeezed(x: np.ndarray) -> bytes:
    """An array of numbers, compressed by the first bytes of all, then the second ones, and so on."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def expanded(x: bytes, kind: type) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().reshape(-1).view(kind)


class WordPlaces(dict):
    """Word to its hash, never that of the start sign."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = at = xxhash.xxh3_64_intdigest(word.lower()) or 1
        return at


def bigram_places(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before.astype(U) * U(0x9E3779B97F4A7C15) + word.astype(U) * U(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def befores(sizes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What stands before each word."""
    before = np.r_[own[:0], START, own[:-1]].astype(own.dtype) if len(own) else own
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = START
    return before


def distinct_pairs(sizes: np.ndarray, own: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct bigrams, the place of each word's bigram among them); ``own`` numbers ``words`` from 1."""
    n = len(words) + 1
    pairs, at = np.unique(befores(sizes, own).astype(np.int64) * n + own, return_inverse=True)
    known = np.r_[U(START), words]
    return bigram_places(known[pairs // n], known[pairs % n]), at


def in_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges): ``order[edges[b] : edges[b + 1]]`` are the places of bucket b's hashes, which lie in one range."""
    order = np.argsort(hashes)
    firsts = np.array([-(-(b << 64) // buckets) for b in range(buckets)], dtype=U)
    return order, np.r_[np.searchsorted(hashes[order], firsts), len(hashes)]


def counted(at: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Two columns for ``n`` entries: how often each stands in all words, and in the chosen ones."""
    return np.stack([np.bincount(at, minlength=n), np.bincount(at[chosen], minlength=n)], axis=1)


def in_chunks(documents: DataFrame) -> DataFrame:
    """Rows of CHUNK for documents (doc_id, text)."""
    most_chars = CHUNK_CHARS

    def chunk(number: int, ids: list, parts: list[np.ndarray], numbers: dict[int, int]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        own, words = np.concatenate(parts), np.fromiter(numbers, dtype=U, count=len(numbers))
        common = np.argsort(-np.bincount(own, minlength=len(words)), kind="stable")  # low numbers for common words
        rank = np.empty(len(words), dtype=np.int32)
        rank[common] = np.arange(1, len(words) + 1, dtype=np.int32)
        sums = len(own), (sizes > 0).sum()
        blobs = [squeezed(x) for x in (sizes, rank[own], words[common])]
        columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in blobs], *[pa.array([int(x)]) for x in sums]]
        return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        places, chunks = WordPlaces(), TaskContext.get().partitionId() << 32
        ids, parts, chars, numbers, known = [], [], 0, {}, {}

        def number(w: str) -> int:
            known[w] = n = numbers.setdefault(places[w], len(numbers))
            return n

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = [w for w in text.translate(SPACE).split(" ") if w]
                ids.append(i)
                parts.append(np.array([known[w] if w in known else number(w) for w in words], dtype=np.int32))
                chars += len(text) + 16
                if chars >= most_chars:
                    yield chunk(chunks, ids, parts, numbers)
                    chunks += 1
                    ids, parts, chars = [], [], 0
                    numbers.clear()
                    known.clear()
        if ids:
            yield chunk(chunks, ids, parts, numbers)

    return bounded(documents).select("doc_id", "text").mapInArrow(tidy(run), CHUNK)


def with_marks(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """``chunks`` with ``marks``: (at, bits) where targets are among its documents, 64 documents a number; null without any."""
    places = chunks.select("chunk", F.posexplode("ids").alias("_place", "doc_id")).where("doc_id is not null")
    found = places.join(targets.hint("shuffle_merge"), "doc_id", "left_semi")
    bits = found.groupBy("chunk", F.expr("_place div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, _place % 64))").alias("bits"))
    marks = settle(bits.groupBy("chunk").agg(F.collect_list(F.struct("at", "bits")).alias("marks")), "xent-marks")
    return join_checked(chunks, marks, "chunk", "left")


def marked(marks: list[dict] | None, n: int) -> np.ndarray:
    """Which of a chunk's ``n`` documents are targets."""
    bits = np.zeros(-(-n // 64), dtype="<i8")
    for m in marks or []:
        bits[m["at"]] = m["bits"]
    return np.unpackbits(bits.view(np.uint8), count=n, bitorder="little").astype(bool)


def target_sums(chunks: DataFrame) -> tuple[int, int]:
    """Words of the target, and its documents with a word, for chunks with marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [expanded(x, np.int64) for x in batch.column(0).to_pylist()]
            own = [s[marked(m, len(s))] for s, m in zip(sizes, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in own], pa.int64()), pa.array([int((x > 0).sum()) for x in own], pa.int64())], names=["n", "starts"])

    sums = chunks.where("marks is not null").select("sizes", "marks").mapInArrow(run, "n long, starts long")
    return tuple(sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "starts")]).first())


def send(chunks: DataFrame, buckets: int) -> DataFrame:
    """Rows of SENT for rows of CHUNK with marks."""

    def one(r: dict) -> Iterator[pa.RecordBatch]:
        sizes, own, words = expanded(r["sizes"], np.int64), expanded(r["own"], np.int32), expanded(r["words"], U)
        chosen = np.repeat(marked(r["marks"], len(sizes)), sizes)
        pairs, at = distinct_pairs(sizes, own, words)
        sides = []
        for hashes, places in ((words, own - 1), (pairs, at)):
            order, edges = in_order(hashes, buckets)
            sides.append((hashes[order], counted(places, chosen, len(hashes))[order].astype(np.int32), edges))
        for b in range(buckets):
            (h, hn), (p, pn) = [(x[e[b] : e[b + 1]], n[e[b] : e[b + 1]]) for x, n, e in sides]
            if len(h) or len(p):
                blobs = [squeezed(np.diff(h, prepend=U(0))), squeezed(np.diff(p, prepend=U(0))), squeezed(hn), squeezed(pn)]
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]]), pa.array([b]), *[pa.array([x], pa.binary()) for x in blobs]], names=[f.split(" ")[0] for f in SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from one(batch.slice(i, 1).to_pylist()[0])

    return chunks.select("chunk", "sizes", "marks", "own", "words").mapInArrow(tidy(run), SENT)


def add_up(sent: DataFrame) -> DataFrame:
    """Rows of SUMS; vocabulary is the bucket's number of distinct words, once."""

    def summed(hashes: list[bytes], counts: list[bytes]) -> tuple[int, list[bytes]]:
        parts = [np.cumsum(expanded(h, U), dtype=U) for h in hashes]
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        own = np.concatenate([expanded(c, np.int32) for c in counts]).reshape(-1, 2)
        # exact up to 2**53
        total = np.stack([np.bincount(at, weights=own[:, k], minlength=len(distinct)) for k in (0, 1)], axis=1).astype(np.int64)
        return len(distinct), [squeezed(total[x]) for x in np.split(at, np.cumsum([len(p) for p in parts])[:-1])]

    def add(table: pa.Table) -> pa.Table:
        (n, ones), (_, twos) = [summed(table.column(h).to_pylist(), table.column(c).to_pylist()) for h, c in (("words", "word_counts"), ("pairs", "pair_counts"))]
        give_back()
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "word_counts": pa.array(ones, pa.binary()), "pair_counts": pa.array(twos, pa.binary()), "vocabulary": pa.array([n] + [0] * (len(ones) - 1), pa.int64())})

    return sent.groupBy("bucket").applyInArrow(add, SUMS)


def score(chunks: DataFrame, sums: DataFrame, totals: tuple[int, int], starts: tuple[int, int], buckets: int) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of every document; totals and starts are of the corpus, then of the target."""
    size = max(1 << WORD_BITS, sums.agg(F.coalesce(F.sum("vocabulary"), F.lit(0))).first()[0])

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket").to_pylist()
        head = table.slice(bucket.index(-1), 1)
        sizes, own, words = [expanded(head.column(c)[0].as_py(), kind) for c, kind in (("sizes", np.int64), ("own", np.int32), ("words", U))]
        pairs, at = distinct_pairs(sizes, own, words)
        found = []
        for name, hashes in (("word_counts", words), ("pair_counts", pairs)):
            order, edges = in_order(hashes, buckets)
            counts = np.zeros((len(hashes), 2))
            for b, part in zip(bucket, table.column(name), strict=True):
                if b >= 0:
                    counts[order[edges[b] : edges[b + 1]]] = expanded(part.as_py(), np.int64).reshape(-1, 2)
            found.append(counts)
        doc, before = np.repeat(np.arange(len(sizes)), sizes), befores(sizes, own)
        means = []
        for k in (1, 0):
            one = np.r_[starts[k], found[0][:, k]]
            share = (one + ALPHA) / (totals[k] + ALPHA * size)
            losses = -np.log2((found[1][at, k] + MU * share[own]) / (one[before] + MU))
            means.append(np.bincount(doc, weights=losses, minlength=len(sizes)) / np.maximum(sizes, 1))
        none = sizes == 0
        columns = [pa.array(x, pa.float64(), mask=none) for x in (means[0], means[1], means[0] - means[1])]
        give_back()
        return pa.table([head.column("ids").combine_chunks().flatten(), pa.array(sizes), *columns], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    null = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    whole = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "ids", "sizes", "own", "words", *null("binary", "word_counts", "pair_counts"))
    back = sums.select("chunk", "bucket", *null("array<long>", "ids"), *null("binary", "sizes", "own", "words"), "word_counts", "pair_counts")
    return whole.unionByName(back).groupBy("chunk").applyInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, score double")


def cross_entropy_difference(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The scores of all documents; ``targets`` has the doc_ids of the target documents."""
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chunks = settle(in_chunks(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "xent-chunks")
    t = chunks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "starts")]).first()
    buckets = max(LEAST_BUCKETS, -(-t["n_words"] // BUCKET_WORDS))
    dealt = with_marks(chunks, ids)
    n_target, target_starts = target_sums(dealt)
    sums = settle(add_up(send(dealt, buckets)), "xent-sums")
    return score(chunks, sums, (t["n_words"], n_target), (t["starts"], target_starts), buckets)

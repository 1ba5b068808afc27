"""Document fingerprints: a quartile bucket digest over hashed byte triplets.

Triplets of neighbouring bytes (and of every other byte) are hashed into BUCKETS counters.  The digest
holds a checksum byte, the logarithm of the length, the ratios of the three quartiles, and for each
bucket the quartile its count lies in, two bits each, as hexadecimal text.  Two digests are compared by
a difference score with a bound, mapped to a likeness from 1 (equal) down to 0.

Texts move in one exchange, dealt by ranges of doc_id and, within one, of the text's first characters; each range
is then read in order.  What a range cannot end by itself (the rows of its last id, and more rows of one id than
WAITING_BYTES) is set down beside the first texts of ranges and meets its successor in a join; nothing of it reaches the driver.

Defined cases: null text is empty text, whose digest is all zeros; texts under three bytes have empty
counters; the next document of a doc_id is the least larger one (the first for the last; itself when
alone); where rows share a doc_id each is fingerprinted, and the least text among them is their predecessor's
view of that id (in order of bytes); a null doc_id (or -2**63) counts as an id before all others; a text of any length
is read whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiberloom.llm.batches import bounded, tidy
from fiberloom.scratch import join_checked, settle

BUCKETS = 128
#: Of a difference: weights of a quartile step, the length's and the ratios' share, and the bound.
STEP_COST, FAR_COST, LENGTH_COST, RATIO_COST, BOUND = 1, 6, 2, 1, 300
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
BLOCK = 1 << 20
#: Bytes of text in a range of ids, about, and the most ranges (beyond that they grow; a range is streamed, not held).
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 16
#: Bytes of texts of one id that wait for their successor in a worker.
WAITING_BYTES = 8 << 20
#: Characters of a text by which rows of one id are dealt.
DEALT_CHARS = 16


def triplet_counts(data: np.ndarray) -> np.ndarray:
    """Counters of the hashed triplets (i, i+1, i+2) and (i, i+1, i+3) of a byte array."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    a, b, c = MULTIPLIERS
    for at in range(0, max(len(data) - 2, 0), BLOCK):
        x = data[at : at + BLOCK + 3].astype(np.uint32)
        n = min(BLOCK, len(data) - 2 - at)
        pair = x[:n] * a + x[1 : n + 1] * b
        h = pair + x[2 : n + 2] * c
        h ^= h >> np.uint32(15)
        counts += np.bincount((h * a) >> np.uint32(25), minlength=BUCKETS)
        n = min(n, len(x) - 3)
        if n > 0:
            h = pair[:n] + (x[3 : n + 3] + np.uint32(256)) * c
            h ^= h >> np.uint32(15)
            counts += np.bincount((h * a) >> np.uint32(25), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """The digest of a byte string: 4 + 2 + BUCKETS / 2 hexadecimal characters and the checksum's 2."""
    own = np.frombuffer(data, dtype=np.uint8)
    counts = triplet_counts(own)
    q1, q2, q3 = (int(x) for x in np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = (code[0::4] << 6) | (code[1::4] << 4) | (code[2::4] << 2) | code[3::4]
    length = min(0xFFFF, round(1024 * math.log2(len(data) + 1)))
    ratios = (q1 * 100 // q3 % 16) << 4 | (q2 * 100 // q3 % 16) if q3 else 0
    checksum = hashlib.blake2b(data, digest_size=1).digest()[0] if data else 0
    return f"{checksum:02x}{length:04x}{ratios:02x}{body.astype(np.uint8).tobytes().hex()}"


def difference(left: str, right: str) -> int:
    """0 for equal digests, at most BOUND."""
    a, b = (np.frombuffer(bytes.fromhex(x), dtype=np.uint8) for x in (left, right))
    spread = lambda x: np.stack([x[4:] >> 6, x[4:] >> 4 & 3, x[4:] >> 2 & 3, x[4:] & 3]).astype(np.int64)
    steps = np.abs(spread(a) - spread(b))
    score = int(np.where(steps == 3, FAR_COST, steps * STEP_COST).sum())
    lengths = abs((int(a[1]) << 8 | int(a[2])) - (int(b[1]) << 8 | int(b[2]))) // 512
    wrap = lambda x, y: min(abs(x - y), 16 - abs(x - y))
    ratios = wrap(int(a[3]) >> 4, int(b[3]) >> 4) + wrap(int(a[3]) & 15, int(b[3]) & 15)
    return min(BOUND, score + LENGTH_COST * lengths + RATIO_COST * ratios + int(a[0] != b[0]))


def likeness(left: str, right: str) -> float:
    return 1.0 - difference(left, right) / BOUND


DONE, WAITING, HEAD = 0, 1, 2
FIELDS = (("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))
NAMES = [n for n, _ in FIELDS]
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def beside(doc_id: int, whole: str, mine: str, head: str, head_print: str) -> tuple:
    """A row of FIELDS for a text and its successor's, with their fingerprints."""
    n, cut = len(whole), len(whole) // 4
    edited = (whole[: n - cut] + head[:cut]).encode()
    theirs = fingerprint(edited)
    return doc_id, n, hashlib.sha256(edited).hexdigest(), mine, theirs, likeness(mine, theirs), likeness(mine, head_print)


def arrow(rows: list[tuple], more: tuple = ()) -> pa.RecordBatch:
    fields = (*FIELDS, *more)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def read_ranges(dealt: DataFrame) -> DataFrame:
    """FIELDS, kind and text for ranges in order of (_id, text): DONE rows, rows WAITING for a successor, and HEAD rows.

    HEAD rows are the least text of each range's first two ids, and of an id that follows rows set down as WAITING;
    so the successor of a waiting row is the least HEAD with a larger id.
    """
    most = WAITING_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        waiting: list[tuple[int, str, str]] = []  # rows of the id at hand, with their fingerprints
        current, nth, size, set_down = None, -1, 0, False

        def down() -> None:
            rows.extend((i, len(t), None, f, None, None, None, WAITING, t) for i, t, f in waiting)
            waiting.clear()

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = value.as_py()
                mine = fingerprint(whole.encode())
                if doc_id != current:
                    rows.extend((*beside(*w, whole, mine), DONE, None) for w in waiting)
                    nth += 1
                    if nth < 2 or set_down:
                        rows.append((doc_id, len(whole), None, mine, None, None, None, HEAD, whole))
                    waiting.clear()
                    current, size, set_down = doc_id, 0, False
                waiting.append((doc_id, whole, mine))
                size += len(whole)
                if size > most:
                    down()
                    size, set_down = 0, True
            yield arrow(rows, (("kind", pa.int32()), ("text", pa.string())))
            rows.clear()
        down()
        yield arrow(rows, (("kind", pa.int32()), ("text", pa.string())))

    return bounded(dealt).mapInArrow(tidy(run), f"{ROW}, kind int, text string")


def met(waiting: DataFrame, heads: DataFrame) -> DataFrame:
    """FIELDS of waiting rows beside their successors."""
    least = settle(heads.groupBy("doc_id").agg(F.min(F.struct("text", "fingerprint")).alias("_h")).select(F.col("doc_id").alias("_next"), F.col("_h.text").alias("_head"), F.col("_h.fingerprint").alias("_print")), "digest-heads")
    ids = waiting.select("doc_id", F.lit(None).cast("long").alias("_head")).unionByName(least.select(F.col("_next").alias("doc_id"), F.col("_next").alias("_head")))
    ids = ids.groupBy("doc_id").agg(F.max("_head").alias("_head"))  # some rows a range
    later = Window.orderBy(F.col("doc_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = least.agg(F.min("_next")).first()[0]
    follow = settle(ids.select("doc_id", F.coalesce(F.last("_head", ignorenulls=True).over(later), F.lit(first).cast("long")).alias("_next")), "digest-follow")
    placed = join_checked(waiting.select("doc_id", "text", "fingerprint"), follow, "doc_id", row_bytes=32, salt_by="text")
    pairs = join_checked(placed, least, "_next", row_bytes=220, salt_by="text").select("doc_id", "text", "fingerprint", "_head", "_print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow([beside(*(v.as_py() for v in row)) for row in zip(*batch.columns, strict=True)])

    return bounded(pairs).mapInArrow(tidy(run), ROW)


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edit with its successor, and how alike they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    low = F.lit(-(1 << 63)).cast("long")
    text = documents.select(F.coalesce(F.col("doc_id").cast("long"), low).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    dealt = text.repartitionByRange(ranges, "_id", F.substring("text", 1, DEALT_CHARS)).sortWithinPartitions("_id", "text")
    read = settle(read_ranges(dealt), "digest-ranges")
    kind = lambda k: read.where(F.col("kind") == k)
    out = kind(DONE).select(*NAMES).unionByName(met(kind(WAITING), kind(HEAD)))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != low, F.col("doc_id")))

"""Removal of repeated byte strings, by sparse suffix sorting with bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the table (by doc_id, then
by place).  Matches never cross documents.

Suffixes are first put into buckets by the hash of a q-gram: each string is filed under one q-gram inside it,
the one with the least hash (the leftmost on ties), so equal strings share bucket and place in it, and one place
files a run of neighbouring strings.  Each bucket is refined by sorting on the identifiers (64-bit hashes) of what lies at
later offsets, behind the q-gram and then round to what lies before it; only buckets with several runs are sorted on, by
their updated pointers.  Of runs that end in one bucket the first stays and the others are repeats.  Runs of a q-gram's
bucket that end in several can still share strings; those need bytes: they are refiled by the bytes
next to the q-gram and sorted as suffixes by bucket-pointer refinement, to the depth of ``length`` bytes: initial
buckets of seven bytes, refined by the bucket pointers of the suffixes one depth further on, whose updates serve
the next, doubled depth; buckets with one suffix are left alone.

Texts are dealt once into chunks, and that exchange is read again for each pass.  Chunks first drop runs that
repeat inside them, so what a very common passage sends to one bucket is a run a chunk; unlike runs around a common q-gram
are refiled under different neighbours.  What passes between chunks and buckets is packed arrays.

Rows that share a doc_id (or have none) are numbered in order of their texts over ranges, and dealt into chunks by id and
number, so that a third of all rows without an id is shared out like any other.

Defined cases: null text is empty text; texts shorter than ``length`` lose nothing; a text of any length is taken whole; rows with
one doc_id are ordered by text (equal rows: one of them keeps all); a null doc_id comes before all others; an empty
table gives an empty result; columns named in ``keep`` are carried along (with ``_kept`` behind the name where a result has it
too), others ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fiberloom.llm.batches import bounded
from fiberloom.scratch import join_checked, ordered_parts, settle

LENGTH = 100
GRAM = 32
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
PLACE_BITS = 18
BLOCK = (1 << PLACE_BITS) - 1
#: The result's own columns; characters of a text by which rows of one id are dealt over ranges; bits of a place in a text.
RESULT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text")
DEALT_CHARS, TEXT_BITS = 16, 31
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers:
        base = 0x5851F42D4C957F2D
        for b in (base, pow(base, -1, 1 << 64)):
            own = np.full(BLOCK + 2, b, dtype=U)
            own[0] = 1
            _powers.append(np.multiply.accumulate(own))
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any substrings of a block."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers()
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    have, own = 1, x
    while have * 2 <= width:
        own = np.minimum(own[:-have], own[have:])
        have *= 2
    rest = width - have
    return np.minimum(own[: len(own) - rest], own[rest:]) if rest else own


@dataclass
class Runs:
    """Runs of neighbouring strings filed under one q-gram; all places count from the block's or chunk's start."""

    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray
    key: np.ndarray
    before: np.ndarray
    behind: np.ndarray
    left: np.ndarray
    right: np.ndarray


def block_runs(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> Runs:
    """The runs of a block; ``valid`` marks where a string may start."""
    hashes = Hashes(data)
    grams = hashes.all(gram)
    ranked = (grams >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(grams), dtype=U)
    starts = np.flatnonzero(valid)
    under = (sliding_least(ranked, length - gram + 1)[starts] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (under[1:] != under[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else np.zeros(0, dtype=np.int64)
    first, last, at = starts[edge], starts[np.r_[edge[1:] - 1, len(starts) - 1].astype(np.int64)] if len(edge) else starts[:0], under[edge]
    shape = ((at - first).astype(U) << U(32)) | (last - first).astype(U)
    before = mixed(hashes.at(first, at) + shape * U(0x9E3779B97F4A7C15))
    behind = hashes.at(np.minimum(at + gram, last + length), last + length)
    half = (length - gram) // 2
    return Runs(first, last, at, grams[at], before, behind, hashes.at(np.maximum(at - half, 0), at), hashes.at(at + gram, np.minimum(at + gram + half, len(data))))


class Chunk:
    """The documents of a chunk in order, their bytes in a row, and all their runs."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        ids = table.column("_id").to_numpy()
        texts = [(x.as_py() or "").encode() for x in table.column("text")]
        numbers = table.column("_nth").to_numpy() if "_nth" in table.column_names else np.zeros(len(ids), dtype=np.int64)
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], numbers[i], texts[i]))
        self.ids, numbers = ids[self.order].astype(np.int64), numbers[self.order].astype(np.int64)
        texts = [texts[i] for i in self.order]
        sizes = np.array([len(x) for x in texts], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        valid = np.zeros(len(self.data) + 1, dtype=np.int8)
        np.add.at(valid, self.starts[:-1], (sizes >= length).astype(np.int8))
        np.add.at(valid, self.starts[1:] - np.minimum(sizes, length - 1), -(sizes >= length).astype(np.int8))
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        parts = []
        for lo, hi in self.blocks(length):  # strings that start in [lo, hi)
            window = self.data[lo : min(hi + length - 1, len(self.data))]
            if len(window) >= length:
                own = np.zeros(len(window), dtype=bool)
                own[: hi - lo] = valid[lo:hi]
                own[len(window) - length + 1 :] = False
                r = block_runs(window, own, length, gram)
                parts.append(Runs(r.first + lo, r.last + lo, r.gram + lo, r.key, r.before, r.behind, r.left, r.right))
        get = lambda name, kind: np.concatenate([getattr(p, name) for p in parts]) if parts else np.zeros(0, dtype=kind)
        self.runs = Runs(*(get(n, np.int64) for n in ("first", "last", "gram")), *(get(n, U) for n in ("key", "before", "behind", "left", "right")))
        doc = np.searchsorted(self.starts, self.runs.first, side="right") - 1
        self.doc = self.ids[doc] if len(doc) else np.zeros(0, dtype=np.int64)
        self.place = self.runs.first - self.starts[doc] + (numbers[doc] << TEXT_BITS) if len(doc) else np.zeros(0, dtype=np.int64)
        # runs are in order of (document, place), so a stable sort leaves the first of equal runs first
        pointer = refine_names(self.runs.key, self.runs.behind, self.runs.before)
        sort = np.argsort(pointer, kind="stable")
        same = np.r_[False, pointer[sort][1:] == pointer[sort][:-1]] if len(sort) else np.zeros(0, dtype=bool)
        self.sent, self.repeats = sort[~same], sort[same]

    def blocks(self, length: int) -> Iterator[tuple[int, int]]:
        """Stretches of whole documents of at most BLOCK bytes with their strings; longer documents alone, in equal steps from their start."""
        most, lo = BLOCK - length, 0
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if b - lo > most:
                if a > lo:
                    yield lo, a
                lo = a
                while b - lo > most:
                    yield lo, lo + most
                    lo += most
        if self.starts[-1] > lo:
            yield lo, int(self.starts[-1])

    def by_bucket(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """The sent runs of each bucket, in an order that any pass finds again."""
        yield from grouped((self.runs.key[self.sent] % U(buckets)).astype(np.int64), self.sent)


def grouped(group: np.ndarray, what: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(group):
        return
    sort = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.r_[True, group[sort][1:] != group[sort][:-1]])
    for a, b in zip(edge, [*edge[1:], len(sort)], strict=True):
        yield int(group[sort[a]]), what[sort[a:b]]


def planes(*arrays: np.ndarray) -> bytes:
    """Arrays of one length after one another, 64-bit ones as their low and high halves: small numbers then compress well."""
    out = [np.uint32(len(arrays[0])).tobytes()]
    for a in arrays:
        if a.dtype.itemsize == 8:
            halves = np.ascontiguousarray(a).view(np.uint32).reshape(-1, 2)
            out += [halves[:, 0].tobytes(), halves[:, 1].tobytes()]
        else:
            out.append(a.tobytes())
    return b"".join(out)


def unplanes(blob: bytes, *kinds) -> tuple[list[np.ndarray], bytes]:
    """What planes() packed, and the bytes after it."""
    n, at, out = int(np.frombuffer(blob, np.uint32, 1)[0]), 4, []
    for kind in kinds:
        if np.dtype(kind).itemsize == 8:
            halves = np.empty((n, 2), dtype=np.uint32)
            halves[:, 0], halves[:, 1] = np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, np.uint32, n, at + 4 * n)
            out.append(halves.reshape(-1).view(kind))
        else:
            out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, blob[at:]


def refine(data: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Bucket pointers of all suffixes of ``data`` sorted to ``depth`` bytes (all the way if None).

    A pointer is the place of the last suffix of its bucket; suffixes equal to that depth share one.  Behind
    the end of the data comes a sign before all others.
    """
    n, goal = len(data), depth or len(data) + 1
    if not n:
        return np.zeros(0, dtype=np.int64)
    q = min(7, goal)
    padded = np.concatenate([data.astype(U) + U(1), np.zeros(q, dtype=U)])
    key = np.zeros(n, dtype=U)
    for i in range(q):  # digits to the base of 257
        key = key * U(257) + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ends = bucket_ends(key[order])
    pointer = np.empty(n + 1, dtype=np.int64)
    pointer[order] = ends
    pointer[n] = -1
    size = np.bincount(ends, minlength=n)
    open_, have = order[size[ends] > 1], q
    while len(open_) and have < goal:
        step = min(have, goal - have)
        own, later = pointer[open_], pointer[np.minimum(open_ + step, n)]
        sort = np.lexsort((later, own))
        open_, own, later = open_[sort], own[sort], later[sort]
        outer = bucket_ends(own)
        inner = bucket_ends(own * (n + 2) + later + 1)
        pointer[open_] = own - (outer - inner)
        alone = np.bincount(inner, minlength=len(open_))[inner] == 1
        open_ = open_[~alone]
        have += step
    return pointer[:n]


def bucket_ends(*keys: np.ndarray) -> np.ndarray:
    """For keys sorted by the first, then the next ones: the place of the last that is equal in all."""
    if not len(keys[0]):
        return np.zeros(0, dtype=np.int64)
    last = np.flatnonzero(np.r_[np.any([k[1:] != k[:-1] for k in keys], axis=0), True])
    return np.repeat(last, np.diff(np.r_[-1, last]))


def refine_names(first: np.ndarray, *later: np.ndarray) -> np.ndarray:
    """Bucket pointers of records: buckets of equal ``first``, refined by sorting each on the names at later offsets in turn."""
    order = np.argsort(first, kind="stable")
    ends = bucket_ends(first[order])
    pointer = np.empty(len(first), dtype=np.int64)
    pointer[order] = ends
    open_ = order[np.bincount(ends, minlength=len(first))[ends] > 1]
    for names in later:
        sort = np.lexsort((names[open_], pointer[open_]))
        open_ = open_[sort]
        own = pointer[open_]
        inner = bucket_ends(own, names[open_])
        pointer[open_] = own - (bucket_ends(own) - inner)
        open_ = open_[np.bincount(inner, minlength=len(open_))[inner] > 1]
    return pointer


def suffix_array(data: bytes) -> np.ndarray:
    """All suffixes in order."""
    return np.argsort(refine(np.frombuffer(data, dtype=np.uint8)))


def rows(schema: pa.Schema, made: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)] if made else [pa.array([], t) for t in schema.types], schema=schema)


SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])


def judge_bucket(table: pa.Table) -> pa.Table:
    """Runs of one bucket from all chunks: which are repeats, and which have to be compared as bytes."""
    chunks, blobs = table.column("chunk").to_pylist(), [x.as_py() for x in table.column("blob")]
    parts = [unplanes(b, U, U, U, np.int64, np.int64)[0] for b in blobs]
    key, before, behind, doc, place = (np.concatenate([p[i] for p in parts]) for i in range(5))
    origin = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    nth = np.concatenate([np.arange(len(p[0])) for p in parts]).astype(np.uint32)
    pointer = refine_names(key, behind, before)
    sort = np.lexsort((place, doc, pointer))
    key, pointer = key[sort], pointer[sort]  # pointers of one key follow one another
    new_key, new_run = np.r_[True, key[1:] != key[:-1]], np.r_[True, pointer[1:] != pointer[:-1]]
    group = np.cumsum(new_key) - 1
    unlike = np.bincount(group, weights=new_run)[group] > 1
    kind = np.where(~new_run, 1, np.where(unlike, 2, 0))
    made, bucket = [], table.column("bucket")[0].as_py()
    hit = sort[kind > 0]
    for at, which in grouped(origin[hit], np.flatnonzero(kind > 0)):
        made.append((chunks[at], bucket, planes(nth[sort[which]], kind[which].astype(np.uint8))))
    return rows(REPLY, made)


def marked(chunk: Chunk, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that repeat earlier ones, runs to compare, and the places of single strings found to repeat."""
    told: dict[int, bytes] = {}
    places = []
    for bucket, blob in zip(replies.column("bucket").to_pylist(), replies.column("blob"), strict=True):
        if bucket >= 0:
            told[bucket] = blob.as_py()
        else:
            places.append(np.frombuffer(blob.as_py(), dtype=np.uint32))
    again, compare = [chunk.repeats], []
    for bucket, own in chunk.by_bucket(buckets) if told else ():
        if bucket in told:
            (nth, kind), _ = unplanes(told[bucket], np.uint32, np.uint8)
            again.append(own[nth[kind == 1]])
            compare.append(own[nth[kind == 2]])
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, dtype=t)
    return join(again, np.int64), join(compare, np.int64), join(places, np.int64)


def unlike_runs(chunk: Chunk, which: np.ndarray, number: int, buckets: int, length: int, gram: int) -> Iterator[tuple]:
    """Strings of the runs to compare, with their bytes, filed by what stands left or right of the q-gram."""
    r, half = chunk.runs, (length - gram) // 2
    middle = r.gram[which] - half
    lefts, rights = (r.first[which], np.minimum(r.last[which], middle)), (np.maximum(r.first[which], middle + 1), r.last[which])
    first, last = np.r_[lefts[0], rights[0]], np.r_[lefts[1], rights[1]]
    key = mixed(np.r_[r.key[which], r.key[which] ^ U(1)] + np.r_[r.left[which], r.right[which]] * U(0x9E3779B97F4A7C15))
    own, some = np.r_[which, which], first <= last
    first, last, key, own = first[some], last[some], key[some], own[some]
    place = chunk.place[own] + first - r.first[own]
    for bucket, at in grouped((key % U(buckets)).astype(np.int64), np.arange(len(own))):
        text = b"".join(chunk.data[a : b + length].tobytes() for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True))
        yield bucket, number, planes(key[at], chunk.doc[own[at]], place[at], first[at].astype(np.uint32), (last - first)[at].astype(np.uint32)) + text


def judge_bytes(table: pa.Table, length: int) -> pa.Table:
    """Strings of one bucket sorted as suffixes: the places of all but the first of equal ones, by chunk."""
    parts, texts = [], []
    chunk_of = []
    for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("blob"), strict=True):
        arrays, text = unplanes(blob.as_py(), U, np.int64, np.int64, np.uint32, np.uint32)
        parts.append(arrays)
        texts.append(np.frombuffer(text, dtype=np.uint8))
        chunk_of.append(np.full(len(arrays[0]), chunk, dtype=np.int64))
    key, doc, place, address, more = (np.concatenate([p[i] for p in parts]) for i in range(5))
    chunk, data = np.concatenate(chunk_of), np.concatenate(texts)
    size = more.astype(np.int64) + length
    start = np.cumsum(size) - size
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    use = np.flatnonzero(n[inverse] > 1)
    if not len(use):
        return rows(REPLY, [])
    index = lambda lo, n: np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    pointer = refine(data[index(start[use], size[use])], length)
    windows = more[use].astype(np.int64) + 1
    local = index(np.cumsum(size[use]) - size[use], windows)
    run = np.repeat(use, windows)
    nth = local - np.repeat(np.cumsum(size[use]) - size[use], windows)
    bucket = pointer[local]
    sort = np.lexsort((place[run] + nth, doc[run], bucket))
    again = sort[1:][bucket[sort][1:] == bucket[sort][:-1]]
    made = [(number, -1, np.sort(address[run[at]] + nth[at]).astype(np.uint32).tobytes()) for number, at in grouped(chunk[run[again]], again)]
    return rows(REPLY, made)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (_id, text, ...) with ``_nth``: 0 for an id of one row, else the row's number, in order of text, among all rows of such ids."""
    several = settle(rows.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "repeats-shared")
    if several.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    told = join_checked(rows, several.withColumn("_shared", F.lit(True)), "_id", "left", row_bytes=24, salt_by="text")
    parts = ordered_parts(told.where("_shared").drop("_shared").withColumn("_start", F.substring("text", 1, DEALT_CHARS)), ["_id", "_start"], "repeats-parts")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = settle(counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")), "repeats-before")  # a row a part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_id", "text"))
    shared = parts.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("_nth", F.col("_before") + F.col("_inside"))
    return told.where("_shared is null").drop("_shared").withColumn("_nth", F.lit(0).cast("long")).unionByName(settle(shared.select(*rows.columns, "_nth"), "repeats-numbered"))


def cut_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """doc_id, the kept columns, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end), and the text that is left if asked for.

    A character that loses some of its bytes is left out of that text.
    """
    spark = bounded(documents).sparkSession
    low = F.lit(-(1 << 63)).cast("long")
    sized = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, buckets = max(parts, -(-sized // CHUNK_BYTES)), max(parts, -(-sized // BUCKET_BYTES))
    carried = [(c, f"_k{i}", c + "_kept" if c in RESULT else c) for i, c in enumerate(keep)]
    dealt = numbered(documents.select(F.coalesce(F.col("doc_id").cast("long"), low).alias("_id"), "text", *[F.col(c).alias(k) for c, k, _ in carried]))
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_nth"), F.lit(chunks)))

    def send(table: pa.Table) -> pa.Table:
        own, number = Chunk(table, length, gram), table.column("_chunk")[0].as_py()
        return rows(SENT, [(b, number, planes(own.runs.key[at], own.runs.before[at], own.runs.behind[at], own.doc[at], own.place[at])) for b, at in own.by_bucket(buckets)])

    def send_bytes(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows or not table.num_rows:
            return rows(SENT, [])
        own, number = Chunk(table, length, gram), table.column("_chunk")[0].as_py()
        return rows(SENT, list(unlike_runs(own, marked(own, replies, buckets)[1], number, buckets, length, gram)))

    text = ", kept_text string" if with_text else ""
    kept = "".join(f", {k} {documents.schema[c].dataType.simpleString()}" for c, k, _ in carried)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        own = Chunk(table, length, gram)
        again, _, places = marked(own, replies, buckets)
        kind = np.int16 if length < 1 << 14 else np.int32  # a byte lies in ``length`` strings, told twice at most
        change = np.zeros(len(own.data) + 1, dtype=kind)
        np.add.at(change, own.runs.first[again], 1)
        np.add.at(change, own.runs.last[again] + length, -1)
        np.add.at(change, places, 1)
        np.add.at(change, places + length, -1)
        gone = np.cumsum(change[:-1], dtype=kind) > 0
        out: list[list] = [[] for _ in range(6)]
        for a, b in zip(own.starts[:-1].tolist(), own.starts[1:].tolist(), strict=True):
            cut, data = gone[a:b], own.data[a:b]
            edges = np.flatnonzero(np.diff(np.r_[False, cut, False].astype(np.int8))).astype(np.int64)
            left = data[~cut].tobytes() if len(edges) else data.tobytes()
            for column, x in zip(out, (b - a, int(cut.sum()), len(edges) // 2, hashlib.sha256(left).hexdigest(), edges.tolist(), left.decode(errors="ignore") if with_text else None), strict=True):
                column.append(x)
        ids = pa.array([None if x == -(1 << 63) else x for x in own.ids.tolist()], pa.int64())
        columns = {"doc_id": ids} | {k: table.column(k).take(pa.array(own.order, pa.int64())) for _, k, _ in carried}
        columns |= dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), (pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=False)), strict=True))
        return pa.table(columns | ({"kept_text": pa.array(out[5], pa.string())} if with_text else {}))

    sent = "bucket long, chunk long, blob binary"
    reply = "chunk long, bucket long, blob binary"
    judged = dealt.groupBy("_chunk").applyInArrow(send, sent).groupBy("bucket").applyInArrow(judge_bucket, reply)
    unlike = dealt.groupBy("_chunk").cogroup(judged.groupBy("chunk")).applyInArrow(send_bytes, sent)
    compared = unlike.groupBy("bucket").applyInArrow(lambda table: judge_bytes(table, length), reply)
    told = judged.unionByName(compared)
    cut = dealt.groupBy("_chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, f"doc_id long{kept}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>{text}")
    return cut.withColumnsRenamed({k: name for _, k, name in carried})

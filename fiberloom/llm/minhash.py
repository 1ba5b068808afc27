"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

A shingle weighs 1 + ln(its number in the document).  Each shingle is a Poisson process of arrivals, at a
rate of its weight, each arrival falling on one of the signature's registers; a register keeps the shingle
that came first, and a shingle is followed no further once its next arrival is after all registers' times.
Two registers agree with the probability Jaccard similarity.

Documents with equal shingles are one node.  Nodes that agree on a whole band of registers are candidates;
in each band every node is compared with the least one (its pivot), by the exact similarity of the shingle
weights.  Nodes that are not linked to their band's pivot are compared with other pivots of it, for some turns.
Links are closed to components.  What is still apart in a band after that is compared in full: all pairs of different
components that agree in a band and share a rare shingle, in a prefix of each set's weight that no pair similar
enough can lack.

Equal documents are counted by partial aggregation and never paired; a hot pivot is one side of an equi-join
that adaptive execution splits.  Shingle sets are built only for candidates.

Defined cases: a document of one to four words has one shingle, all of it; a null text or one without words
is a class of its own; ties and repeated rows fall into one class; class_id is the least doc_id of a class (null
if all its ids are, and the same for two classes that hold rows of one doc_id), class_key is its own name, which no other class has;
a text of any length is taken whole; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiberloom.llm.batches import bounded, tidy
from fiberloom.operators.graph import connected_components
from fiberloom.scratch import join_checked, settle

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Turns of new pivots before what is still apart is compared in full.
TURNS = 2
#: Shingles of a set, rare ones first, by which a pair is looked at before it is made; bytes of sets in a chunk.
SKETCH, CHUNK_BYTES = 64, 4 << 20
GROUP_WORDS = 1 << 16
CACHE_WORDS = 1 << 17
U = np.uint64
SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to CACHE_WORDS words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str], words: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, number) of each document's distinct shingles, in order of document and hash."""
    split = [[w for w in t.translate(SPACE).split(" ") if w] if not t.isascii() else t.encode().split() for t in texts]
    split = [[w.decode() for w in s] if s and isinstance(s[0], bytes) else s for s in split]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    h = np.fromiter((words[w] for s in split for w in s), dtype=U, count=int(sizes.sum()))
    end = np.cumsum(sizes)
    own = np.repeat(np.arange(len(texts)), sizes)
    # a shingle starts at each word with four more behind it; short documents get one at their first word
    left = np.repeat(end, sizes) - np.arange(len(h))
    short = np.repeat((sizes < WORDS) & (sizes > 0), sizes)
    padded = np.concatenate([h, np.zeros(WORDS, dtype=U)])
    made = np.zeros(len(h), dtype=U)
    for j in range(WORDS):
        there = padded[j : j + len(h)]
        made = made * U(0x9E3779B97F4A7C15) + np.where(left > j, mixed(there + U(j + 1)), U(0))
    starts = (left >= WORDS) | (short & np.r_[True, own[1:] != own[:-1]] if len(own) else short)
    doc, made = own[starts], mixed(made[starts])
    sort = np.lexsort((made, doc))
    doc, made = doc[sort], made[sort]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (made[1:] != made[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
    return doc[new], made[new], np.diff(np.r_[new, len(doc)])


def weights(numbers: np.ndarray) -> np.ndarray:
    return 1 + np.log(numbers)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """The ProbMinHash signature of each of ``docs`` weighted sets (zeros for an empty one)."""
    time = np.full(docs * registers, np.inf)
    kept = np.zeros(docs * registers, dtype=U)
    element, weight, at, now, state = element, weight, doc, np.zeros(len(doc)), element.copy()
    while len(at):
        state = state + U(0x9E3779B97F4A7C15)
        draw = mixed(state)
        now = now - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        spot = at * registers + (mixed(draw ^ U(0xD6E8FEB86659FD93)) % U(registers)).astype(np.int64)
        np.minimum.at(time, spot, now)
        first = time[spot] == now
        kept[spot[first]] = element[first]
        latest = time.reshape(docs, registers).max(axis=1)
        more = now < latest[at]
        element, weight, at, now, state = element[more], weight[more], at[more], now[more], state[more]
    return kept.reshape(docs, registers)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key for each band of ``rows`` registers."""
    parts = signature.reshape(len(signature), -1, rows)
    keys = np.zeros(parts.shape[:2], dtype=U) + np.arange(1, parts.shape[1] + 1, dtype=U)
    for j in range(rows):
        keys = mixed(keys * U(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The sum over shared i of 1 / sum_j max(a_j / a_i, b_j / b_i), elements sorted in each set."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    sort = np.argsort(ratio, kind="stable")
    x, y, ratio = x[sort], y[sort], ratio[sort]
    # with r_i = b_i / a_i: elements up to r_i count by a, those above it by b
    upto = np.cumsum(x)[np.searchsorted(ratio, ratio, side="right") - 1]
    above = y.sum() - np.cumsum(y)[np.searchsorted(ratio, ratio, side="right") - 1]
    return float((1 / ((only_a + upto) / x + (only_b + above) / y)).sum())


def groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's texts with about GROUP_WORDS words."""
    start, own, size = 0, [], 0
    for i, t in enumerate(texts):
        own.append(t.as_py() or "")
        size += len(own[-1])
        if size >= 6 * GROUP_WORDS:
            yield start, own
            start, own, size = i + 1, [], 0
    if own:
        yield start, own


def content_keys(doc: np.ndarray, element: np.ndarray, number: np.ndarray, docs: int) -> list[bytes | None]:
    """A 128-bit hash of each weighted set; None for an empty one."""
    edge = np.searchsorted(doc, np.arange(docs + 1))
    return [xxhash.xxh3_128_digest(element[a:b].tobytes() + number[a:b].tobytes()) if b > a else None for a, b in zip(edge[:-1], edge[1:], strict=True)]


def sign(documents: DataFrame) -> DataFrame:
    """doc_id, at (of id and text), key (of the weighted set; null without words) and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            keys, bands = [], []
            for _, texts in groups(batch.column(2)):
                doc, element, number = shingle_sets(texts, words)
                keys += content_keys(doc, element, number, len(texts))
                bands.append(band_keys(signatures(doc, element, weights(number), len(texts))))
            flat = np.concatenate(bands).reshape(-1) if bands else np.zeros(0, dtype=np.int64)
            offsets = np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "at", "key", "bands"])

    return bounded(documents).select(F.col("doc_id").cast("long"), row_mark().alias("at"), "text").mapInArrow(tidy(run), "doc_id long, at long, key binary, bands array<long>")


def row_mark() -> Column:
    """A hash of a row's id and text, by which its text is found again."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def weighted_sets(documents: DataFrame) -> DataFrame:
    """key and the packed set (hashes, then numbers) of each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for _, texts in groups(batch.column(0)):
                doc, element, number = shingle_sets(texts, words)
                keys, edge = content_keys(doc, element, number, len(texts)), np.searchsorted(doc, np.arange(len(texts) + 1))
                sets = [element[a:b].tobytes() + number[a:b].astype(np.uint32).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "weighted"])

    return bounded(documents).select("text").mapInArrow(tidy(run), "key binary, weighted binary").where("key is not null")


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) for pairs of keys."""
    left = sets.select(F.col("key").alias("a"), F.col("weighted").alias("_x"))
    right = sets.select(F.col("key").alias("b"), F.col("weighted").alias("_y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
            n = len(x) // 12
            return np.frombuffer(x, U, n), weights(np.frombuffer(x, np.uint32, n, 8 * n))

        for batch in batches:
            values = [probability_jaccard(*unpack(x.as_py()), *unpack(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    return bounded(both).mapInArrow(tidy(run), "a binary, b binary, similarity double").distinct()


def candidate_sets(documents: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Weighted sets of the nodes in ``pairs``, from the text of one document each."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    ids = settle(nodes.select("key", "at").join(keys, "key").select("at").distinct(), "near-ids")
    texts = documents.select(row_mark().alias("at"), "text")
    return settle(weighted_sets(join_checked(texts, ids, "at", row_bytes=48, salt_by="text")).join(keys, "key", "left_semi").dropDuplicates(["key"]), "near-sets")


def apart_in_bands(met: DataFrame, parts: DataFrame) -> DataFrame:
    """(_i, _band, key, component) of the bands whose nodes lie in several components."""
    placed = met.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    several = placed.groupBy("_i", "_band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_n")).where("_lo <> _hi and _n > 2")
    return placed.join(several.select("_i", "_band"), ["_i", "_band"]).select("_i", "_band", "key", "component")


def pairs_with_pivots(met: DataFrame, open_: DataFrame, turn: int) -> DataFrame:
    """(_i, _band, a, b): each open node of a band and another pivot, drawn by hash from all of the band's nodes."""
    drawn = met.groupBy("_i", "_band").agg(F.min(F.struct(F.xxhash64("key", "_i", F.lit(turn)).alias("h"), F.col("key").alias("pivot"))).alias("_p"))
    pairs = open_.join(drawn, ["_i", "_band"]).where("key <> _p.pivot")
    return pairs.select("_i", "_band", "key", F.least("key", "_p.pivot").alias("a"), F.greatest("key", "_p.pivot").alias("b"))


def packed_sets(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set sizes, hashes, shares of the weight) of a chunk of sets, in order of key."""
    order = sorted(zip(table.column("key").to_pylist(), table.column("weighted").to_pylist(), strict=True))
    sizes = np.array([len(x) // 12 for _, x in order], dtype=np.int64)
    hashes = np.concatenate([np.frombuffer(x, U, len(x) // 12) for _, x in order])
    own = [weights(np.frombuffer(x, np.uint32, len(x) // 12, len(x) // 12 * 8)) for _, x in order]
    return [k for k, _ in order], sizes, hashes, np.concatenate([w / w.sum() for w in own])


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    sort = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, bucket[sort][1:] != bucket[sort][:-1]])
    for a, b in zip(edge, [*edge[1:], len(sort)], strict=True):
        yield int(bucket[sort[a]]), sort[a:b]


def ranked_prefixes(sets: DataFrame, share: float) -> DataFrame:
    """Each set's shingles in one order of all shingles of these sets, rare ones first, up to ``share`` of its weight.

    Returns key, prefix (of o, before), sketch (its first SKETCH o that are not alone), last (of the sketch), alone and
    least.  o is a shingle's place in the order: in how many sets it is, then 43 bits of its hash; before is the
    share of weight ahead of it; alone is that of shingles in no other set.

    Chunks of sets send their hashes, without keys, to buckets of hashes, which send back numbers in the same order.
    """
    spark = sets.sparkSession
    size = sets.agg(F.coalesce(F.sum(F.octet_length("weighted")), F.lit(0)).alias("n")).first()["n"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(parts, -(-size // CHUNK_BYTES))
    dealt = sets.select("key", "weighted").withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    packet = "bucket long, chunk long, blob binary"
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])

    def made(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def send(table: pa.Table) -> pa.Table:
        _, _, hashes, _ = packed_sets(table)
        chunk = table.column("chunk")[0].as_py()
        return made([(b, chunk, hashes[at].tobytes()) for b, at in split_by((hashes % U(chunks)).astype(np.int64))])

    def count(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, U) for x in table.column("blob").to_pylist()]
        _, which, n = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        told = np.split(np.minimum(n, (1 << 20) - 1)[which].astype(np.uint32), np.cumsum([len(x) for x in blobs])[:-1])
        return made([(b, c, x.tobytes()) for b, c, x in zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist(), told, strict=True)])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        keys, sizes, hashes, p = packed_sets(table)
        told = dict(zip(replies.column("bucket").to_pylist(), replies.column("blob").to_pylist(), strict=True))
        often = np.empty(len(hashes), dtype=np.int64)
        for b, at in split_by((hashes % U(chunks)).astype(np.int64)):
            often[at] = np.frombuffer(told[b], dtype=np.uint32)
        place = (often << 43) + (hashes & U((1 << 43) - 1)).astype(np.int64)
        own = np.repeat(np.arange(len(keys)), sizes)
        sort = np.lexsort((place, own))
        out = {c: [] for c in ("key", "prefix", "sketch", "last", "alone", "least")}
        end = np.cumsum(sizes)
        for k, a, b in zip(keys, end - sizes, end, strict=True):
            at = sort[a:b]
            before = np.cumsum(p[at]) - p[at]
            some = often[at] > 1
            use = some & (before <= share + 1e-9)
            sketch = place[at][some][:SKETCH]
            for c, v in zip(out, (k, [{"o": o, "before": f} for o, f in zip(place[at][use].tolist(), before[use].tolist(), strict=True)], sketch.tolist(), int(sketch[-1]) if len(sketch) else None, float(p[at][~some].sum()), float(p[at].min())), strict=True):
                out[c].append(v)
        pair = pa.list_(pa.struct([("o", pa.int64()), ("before", pa.float64())]))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), (pa.binary(), pair, pa.list_(pa.int64()), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    numbers = dealt.groupBy("chunk").applyInArrow(send, packet).groupBy("bucket").applyInArrow(count, packet)
    return dealt.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(finish, "key binary, prefix array<struct<o: long, before: double>>, sketch array<long>, last long, alone double, least double")


def bound(left: Column, right: Column) -> Column:
    """The most similarity of two sets with unshared shares of weight of at least ``left`` and ``right``.

    Each shared i adds at most 1 / (1 / a_i + right / b_i), and this is concave in (a_i, b_i); so the sum is at most that of the totals.
    """
    left, right = F.least(left, F.lit(0.999)), F.least(right, F.lit(0.999))
    return 1 / (1 / (1 - left) + 1 / (1 - right) - 1)


def pairs_by_prefix(nodes: DataFrame, sets: DataFrame, apart: DataFrame, similarity: float) -> DataFrame:
    """All pairs of unlike components that agree in a band and can be similar enough at all.

    Similar sets share shingles of at least ``similarity`` of either's weight; so in one order of all shingles, rare ones
    first, the least shared shingle lies within the first 1 - similarity of the weight of both, and what stands before it
    is unshared, which bounds the similarity.  Pairs are made on that shingle alone, and not within the component
    that has most nodes there.
    """
    own = settle(apart.select("key", "component").distinct().join(nodes.select("key", "bands"), "key"), "near-own")
    ranked = settle(ranked_prefixes(sets.join(own.select("key"), "key", "left_semi"), 1 - similarity), "near-ranked")
    rows = ranked.select("key", F.explode("prefix").alias("_e")).select("key", "_e.o", "_e.before").groupBy("key", "o").agg(F.min("before").alias("before"))
    placed = settle(rows.join(own.select("key", "component"), "key"), "near-prefix")
    sizes = placed.groupBy("o", "component").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("o").agg(F.max(F.struct("_n", "component")).alias("_m"), F.count("*").alias("_parts")).where("_parts > 1").select("o", F.col("_m.component").alias("main"))
    more = own.select("key", "bands").join(ranked.drop("prefix"), "key")
    rows = settle(placed.join(main, "o").join(more, "key"), "near-prefix-rows")
    side = lambda df, n, *more: df.select("o", *more, F.col("key").alias(n), *[F.col(c).alias(c + n) for c in ("component", "bands", "before", "sketch", "last", "alone", "least")])
    x, y = side(rows.where("component <> main"), "a"), side(rows, "b", "main")
    once = (F.col("componentb") == F.col("main")) | (F.col("a") < F.col("b"))
    can_be = lambda u, v: bound(u, v) >= similarity - 1e-9
    shared = F.array_intersect("sketcha", "sketchb")
    seen = lambda n, m: (F.size(F.filter(f"sketch{n}", lambda e: e <= F.col(f"last{m}"))) - F.size(shared)) * F.col(f"least{n}")
    lost = lambda n, m: F.greatest(F.col(f"before{n}"), F.col(f"alone{n}") + seen(n, m)) - 1e-9
    met = (x["o"] == y["o"]) & can_be(F.col("beforea"), F.col("beforeb")) & (F.col("componenta") != F.col("componentb")) & once
    first = (F.size(shared) == 0) | (F.array_min(shared) == x["o"])
    pairs = x.join(y, met & F.arrays_overlap("bandsa", "bandsb") & first & can_be(lost("a", "b"), lost("b", "a")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_classes(documents: DataFrame, similarity: float = SIMILARITY, turns: int = TURNS) -> DataFrame:
    """doc_id, class_id, class_size (documents in the class) and class_key for every document."""
    docs = settle(sign(documents), "near-signed")
    nodes = settle(docs.where("key is not null").groupBy("key", "bands").agg(F.min("doc_id").alias("rep"), F.min_by("at", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("at")), "near-nodes")
    banded = settle(nodes.select("key", F.posexplode("bands").alias("_i", "_band")), "near-bands")
    pivots = banded.groupBy("_i", "_band").agg(F.min("key").alias("pivot"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    met = settle(banded.join(pivots, ["_i", "_band"]), "near-met")
    asked = settle(met.where("key <> pivot").select("_i", "_band", "key", F.col("pivot").alias("a"), F.col("key").alias("b")), "near-asked")
    met = met.select("_i", "_band", "key")
    sets = candidate_sets(documents, nodes, asked)
    links = None
    for turn in range(1, turns + 2):
        new = settle(similarities(asked.select("a", "b").distinct(), sets).where(F.col("similarity") >= similarity).select("a", "b"), "near-links")
        links = new if links is None else links.unionByName(new)
        if turn <= turns:
            open_ = asked.join(new, ["a", "b"], "left_anti").select("_i", "_band", "key")
            asked = settle(pairs_with_pivots(met, open_, turn), "near-asked")
    parts = settle(connected_components(links, "a", "b"), "near-parts")
    apart = settle(apart_in_bands(met, parts), "near-apart")
    rest = settle(pairs_by_prefix(nodes, sets, apart, similarity), "near-rest")
    new = settle(similarities(rest, sets).where(F.col("similarity") >= similarity).select("a", "b"), "near-links")
    if not new.isEmpty():
        parts = settle(connected_components(links.unionByName(new), "a", "b"), "near-parts")

    known = nodes.join(parts.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    named = known.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = settle(known.join(named, "component").select("key", "component", "class_id"), "near-classes")
    sizes = docs.where("key is not null").groupBy("key").agg(F.count("*").alias("_n"))
    sized = classes.join(sizes, "key").groupBy("component").agg(F.sum("_n").alias("class_size")).join(classes, "component")
    sized = settle(sized.select("key", "class_id", "class_size", F.lower(F.hex("component")).alias("class_key")), "near-sized")
    out = docs.where("key is not null").select("doc_id", "key").join(sized, "key").select("doc_id", "class_id", "class_size", "class_key")
    row = F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))
    alone = docs.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), row.alias("class_key"))
    return out.unionByName(alone)

"""Importance resampling towards a target distribution, by distinct lines.

A text is cut at its newlines. Features are runs of one or two words, hashed into buckets;
a bucket's gain is the log ratio of its shares in the target and in the corpus, a
document's weight the mean gain of its features. Documents are drawn without replacement
by weight plus Gumbel noise.

Segment deduplication: a blocked Bloom filter (``exact_dedup.repeated_filter``, at most
32 MB) tells which lines can occur more than once. Those meet by digest, their features
are counted once and multiplied by their occurrences, and their gain is worked out once
and joined to the documents that hold them. All other lines are counted where they are.
Pairs of words across line ends are counted apart, with the document. Every feature is
hashed once: the buckets of a document's own lines are stored as small integers, so the
weights need no text. What leaves a task whole is one count per bucket.

Lines longer than ``PIECE`` bytes are cut further, at the next separator, and joined by
the same pairs; the features are those of the uncut line.

Defined results: null texts have no words, no features and weight 0; rows that share an
id are separate documents. A null id draws its noise from an empty id and ranks as
larger than any other. Equal scores rank by id, rows with one id and one score in any
order. An empty table gives an empty result, an empty target counts as no features.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paroxys.llm.common import LOWER_BYTES, binary, fresh, give_back, written
from paroxys.llm.exact_dedup import BITS_PER_ROW, BLOCK_BITS, MAX_BITS, PROBES, repeated_filter

BUCKETS = 10_000
#: Documents below this number of words are never drawn.
MIN_WORDS = 20
#: Share of the other documents that is drawn, in percent.
PERCENT = 25
SEED = 7
#: Bytes after which a long line is cut, and text handled at once.
PIECE = 1 << 16
STEP_BYTES = 1 << 20
#: Bytes of repeated lines a task holds before it hands them on.
HELD_BYTES = 16 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def segments_of(text: bytes, piece: int = PIECE) -> list[bytes]:
    """The lower-cased lines with a word; long ones in pieces that end before a separator."""
    out = []
    for line in text.translate(LOWER_BYTES).split(b"\n"):
        at = 0
        while len(line) - at > piece:
            gap = _GAP.search(line, at + piece)
            if gap is None:
                break
            out.append(line[at : gap.start()])
            at = gap.start()
        out.append(line[at:] if at else line)
    return [s for s in out if _WORD.search(s)]


def _line_hash(segment: bytes) -> int:
    return xxhash.xxh64_intdigest(segment, seed=42)


def _number_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _pair(a: bytes, b: bytes) -> int:
    return crc32(b, crc32(b" ", crc32(a)))


def line_buckets(words: list[bytes], starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and of each word with the one before it.

    ``starts`` marks the words that begin a line; their pairs mean nothing.
    """
    n = len(words)
    single = list(map(crc32, words))
    spaced = map(crc32, repeat(b" "), single)
    pairs = np.zeros(n, np.uint32)
    if n > 1:
        pairs[1:] = np.fromiter(map(crc32, islice(words, 1, None), spaced), np.uint32, n - 1)
    kind = _number_type(buckets)
    return (
        (np.array(single, np.uint32) % np.uint32(buckets)).astype(kind),
        (pairs % np.uint32(buckets)).astype(kind)[~starts],
    )


def _blobs(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """One binary value per owner, of the bucket numbers that belong to it."""
    order = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=n)) * values.itemsize
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values[order]))]
    )


def _numbers(blobs: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column one after the other, and how many each value has."""
    _, offsets, data = blobs.buffers()
    if not len(blobs) or data is None:
        return np.empty(0, kind), np.zeros(len(blobs), np.int64)
    ends = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    return flat.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Repeated:
    """Which line hashes may occur more than once: the filter's bits in one array."""

    def __init__(self, blocks: DataFrame, n_blocks: int) -> None:
        bits = np.zeros((n_blocks, BLOCK_BITS // 64), "<i8")
        for at, words in blocks.select("block", "words").toPandas().itertuples(index=False):
            bits[at] = words
        self.words, self.n_blocks = bits.view("<u8"), n_blocks

    def __call__(self, hashes: list[int]) -> np.ndarray:
        u = np.array(hashes, np.uint64)
        block = np.mod(u.view(np.int64), self.n_blocks)
        found = np.ones(len(u), bool)
        for k in range(PROBES):
            bit = (u >> np.uint64(64 - 12 * (k + 1))) & np.uint64(BLOCK_BITS - 1)
            word = self.words[block, (bit >> np.uint64(6)).astype(np.int64)]
            found &= ((word >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
        return found


def _repeated_lines(texts: DataFrame, piece: int, bits_per_row: int, max_bits: int) -> _Repeated:
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_line_hash(s) for text in binary(batch, "text") for s in segments_of(text, piece)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["h"])

    lines = written(texts.select("text").mapInArrow(hashes, "h bigint"), "line-hashes")
    bits = min(max_bits, 1 << max(18, (lines.count() * bits_per_row).bit_length()))
    n_blocks = bits // BLOCK_BITS
    return _Repeated(written(repeated_filter(lines, n_blocks), "line-filter"), n_blocks)


class Parts:
    """The texts of a table taken apart and stored: documents, uses of lines, lines.

    ``docs`` has ``(row, id, text_key, n_words, n_own, own)`` per row of the input: ``own``
    are the buckets of all features outside repeated lines. ``uses`` has ``(row, digest,
    times)``. ``lines`` has ``(digest, times, n_features, own)`` per distinct repeated line.
    """

    def __init__(self, docs: DataFrame, uses: DataFrame, lines: DataFrame, buckets: int) -> None:
        self.docs, self.uses, self.lines, self.buckets = docs, uses, lines, buckets

    def counts(self) -> DataFrame:
        """``(bucket, n)`` of all features."""
        buckets, kind = self.buckets, _number_type(self.buckets)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, np.int64)
            for part in _slices(batches):
                found, lengths = _numbers(part.column("own"), kind)
                times = np.repeat(part.column("times").to_numpy().astype(np.float64), lengths)
                total += np.bincount(found, weights=times, minlength=buckets).astype(np.int64)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

        own = self.docs.select("own", F.lit(1).cast("bigint").alias("times"))
        rows = own.unionAll(self.lines.select("own", "times"))
        partial = rows.mapInArrow(add, "bucket bigint, n bigint")
        return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def take_apart(
    docs: DataFrame,
    id_column: str,
    text: str = "text",
    buckets: int = BUCKETS,
    piece: int = PIECE,
    bits_per_row: int = BITS_PER_ROW,
    max_bits: int = MAX_BITS,
) -> Parts:
    """Cut every text into lines and hash the features of each distinct line once."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    repeated = spark.sparkContext.broadcast(_repeated_lines(texts, piece, bits_per_row, max_bits))
    kind = _number_type(buckets)
    id_type = texts.schema["id"].dataType.simpleString()
    schema = (
        f"row bigint, id {id_type}, text_key binary, n_words bigint, n_own bigint, own binary, "
        "digest binary, times bigint, line binary"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        held: dict[bytes, list] = {}
        held_bytes = 0
        arrow: pa.Schema | None = None

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            """Rows with the given columns; all others are null."""
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow],
                schema=arrow,
            )

        def hand_on() -> pa.RecordBatch:
            keys = list(held)
            return batch_of(
                len(keys), digest=keys, times=[held[k][0] for k in keys], line=[held[k][1] for k in keys]
            )

        def step(ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal row, held_bytes
            lines = [segments_of(t, piece) for t in texts]
            often = iter(repeated.value([_line_hash(s) for own in lines for s in own]).tolist())
            words: list[bytes] = []
            first: list[int] = []
            word_doc: list[int] = []
            lengths: list[int] = []
            cross: list[int] = []
            cross_doc: list[int] = []
            n_words = np.zeros(len(texts), np.int64)
            uses: list[tuple[int, bytes, int]] = []
            for doc, own in enumerate(lines):
                last = None
                shared: Counter = Counter()
                for segment in own:
                    if next(often):
                        key = hashlib.md5(segment).digest()
                        entry = held.get(key)
                        if entry is None:
                            found = _WORD.findall(segment)
                            entry = held[key] = [0, segment, len(found), found[0], found[-1]]
                            held_bytes += len(segment) + 200
                        entry[0] += 1
                        shared[key] += 1
                        n, begin, end = entry[2:]
                    else:
                        found = _WORD.findall(segment)
                        first.append(len(words))
                        words += found
                        word_doc.append(doc)
                        lengths.append(len(found))
                        n, begin, end = len(found), found[0], found[-1]
                    n_words[doc] += n
                    if last is not None:
                        cross.append(_pair(last, begin))
                        cross_doc.append(doc)
                    last = end
                uses += [(row + doc, key, times) for key, times in shared.items()]
            starts = np.zeros(len(words), bool)
            starts[first] = True
            owner = np.repeat(np.array(word_doc, np.uint32), lengths)
            single, pairs = line_buckets(words, starts, buckets)
            over = (np.array(cross, np.uint32) % np.uint32(buckets)).astype(kind)
            owners = np.concatenate([owner, owner[~starts], np.array(cross_doc, np.uint32)])
            values = np.concatenate([single, pairs, over])
            yield batch_of(
                len(texts),
                row=np.arange(row, row + len(texts)),
                id=ids,
                text_key=[hashlib.md5(t).digest() for t in texts],
                n_words=n_words,
                n_own=np.bincount(owners, minlength=len(texts)),
                own=_blobs(values, owners, len(texts)),
            )
            if uses:
                rows, keys, times = zip(*uses)
                yield batch_of(len(uses), row=list(rows), digest=list(keys), times=list(times))
            row += len(texts)
            if held_bytes > HELD_BYTES:
                yield hand_on()
                held.clear()
                held_bytes = 0

        for batch in batches:
            if arrow is None:
                kinds = [("row", pa.int64()), ("id", batch.schema.field("id").type), ("text_key", pa.binary())]
                kinds += [("n_words", pa.int64()), ("n_own", pa.int64()), ("own", pa.binary())]
                arrow = pa.schema([*kinds, ("digest", pa.binary()), ("times", pa.int64()), ("line", pa.binary())])
            begin, size, texts = 0, 0, []
            for at, text in enumerate(binary(batch, "text")):
                texts.append(text)
                size += len(text)
                if size >= STEP_BYTES or at + 1 == batch.num_rows:
                    yield from step(batch.column("id").slice(begin, len(texts)), texts)
                    begin, size, texts = at + 1, 0, []
        if held:
            yield hand_on()
        give_back()

    stored = written(texts.mapInArrow(cut, schema), "parts")
    own = stored.where(F.col("text_key").isNotNull()).select("row", "id", "text_key", "n_words", "n_own", "own")
    uses = stored.where(F.col("row").isNotNull() & F.col("digest").isNotNull()).select("row", "digest", "times")
    lines = (
        stored.where(F.col("line").isNotNull())
        .groupBy("digest")
        .agg(F.sum("times").alias("times"), F.any_value("line").alias("line"))
    )

    def count_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_features, own = [], []
            for line in binary(batch, "line"):
                words = _WORD.findall(line)
                starts = np.zeros(len(words), bool)
                starts[:1] = True
                found = np.concatenate(line_buckets(words, starts, buckets))
                n_features.append(len(found))
                own.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("times"), pa.array(n_features, pa.int64()), pa.array(own, pa.binary())],
                ["digest", "times", "n_features", "own"],
            )

    counted = lines.mapInArrow(count_lines, "digest binary, times bigint, n_features bigint, own binary")
    return Parts(own, uses, written(counted, "lines"), buckets)


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from two ``(bucket, n)`` tables of at most ``buckets`` rows."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, rows in ((s, corpus), (t, target)):
        for bucket, n in rows.select("bucket", "n").collect():
            counts[bucket] = n
    top, bottom = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(r)) for r in top / bottom], np.int64)


def _gain_sums(rows: DataFrame, keep: list[str], gain: np.ndarray, buckets: int) -> DataFrame:
    """``keep`` and the summed gain of the buckets in ``own``."""
    kind = _number_type(buckets)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in keep) + ", gain bigint"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found, lengths = _numbers(part.column("own"), kind)
            upto = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(lengths)
            sums = upto[ends] - upto[ends - lengths]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], pa.array(sums, pa.int64())], [*keep, "gain"]
            )

    return rows.select(*keep, "own").mapInArrow(look_up, schema)


def floor_div(top: Column, bottom: Column) -> Column:
    return ((top - F.pmod(top, bottom)) / bottom).cast("bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the head of a digest of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    head = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.ln(-F.ln((head + F.lit(0.5)) / F.lit(4294967296.0))))


def weigh(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_id: str = "item_id",
    target_text: str = "text",
    seed: int = SEED,
    **options,
) -> DataFrame:
    """``(row, id, text_key, n_words, n_features, weight, score)`` per row of ``docs``, stored.

    ``row`` numbers the rows of this run, ``text_key`` is the MD5 digest of the text.
    """
    own = take_apart(docs, doc_id, text, **options)
    aim = take_apart(target, target_id, target_text, **options)
    gain = gains(own.counts(), aim.counts(), own.buckets)
    # Both sides are plain stored tables, so that Spark can split a line of many documents.
    lines = written(_gain_sums(own.lines, ["digest", "n_features"], gain, own.buckets), "line-gains")
    shared = (
        own.uses.join(lines, "digest")
        .groupBy("row")
        .agg(
            F.sum(F.col("gain") * F.col("times")).alias("gain_shared"),
            F.sum(F.col("n_features") * F.col("times")).alias("n_shared"),
        )
    )
    alone = _gain_sums(own.docs, ["row", "id", "text_key", "n_words", "n_own"], gain, own.buckets)
    zero = F.lit(0).cast("bigint")
    n = F.col("n_own") + F.coalesce("n_shared", zero)
    total = F.col("gain") + F.coalesce("gain_shared", zero)
    weight = F.when(F.col("n_features") > 0, floor_div(F.col("total"), F.col("n_features"))).otherwise(zero)
    scored = (
        alone.join(shared, "row", "left")
        .select("row", "id", "text_key", "n_words", n.alias("n_features"), total.alias("total"))
        .withColumn("weight", weight)
        .withColumn("score", F.col("weight") + noise(F.col("id"), seed))
        .drop("total")
    )
    return written(scored, "weights")


def rank(weights: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``weights`` with ``rank``: 1, 2, 3... for the drawn rows, null for all others.

    Rows are sorted over ranges of (score, id, row); a rank is the place within the range
    plus the rows of the ranges before.
    """
    able = weights.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    placed = written(
        able.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranks",
    ).withColumn("_part", F.shiftright("_at", 33))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per range.
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    offsets = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at") - F.col("_first") + F.col("_before") + 1
    ranked = placed.join(F.broadcast(offsets), "_part").select(
        *weights.columns, F.when(place <= drawn, place).alias("rank")
    )
    few = weights.where(F.col("n_words") < min_words)
    return ranked.unionAll(few.withColumn("rank", F.lit(None).cast("bigint")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    **options,
) -> DataFrame:
    """The drawn rows of ``docs``, all columns.

    Rows that repeat both id and text are interchangeable; as many of them stay as were drawn.
    """
    ranked = rank(weigh(docs, target, doc_id, text, **options), percent, min_words)
    key, drawn, number, owner, group = fresh(docs, "text_key", "drawn", "number", "owner", "group")
    groups = written(
        ranked.groupBy(F.col("id").alias(owner), F.col("text_key").alias(group)).agg(
            F.count("rank").alias(drawn), F.count("*").alias(number)
        ),
        "drawn",
    ).where(F.col(drawn) > 0)
    own_key = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    found = docs.withColumn(key, own_key).join(
        groups, (F.col(key) == F.col(group)) & F.col(doc_id).eqNullSafe(F.col(owner))
    )
    whole = found.where(F.col(drawn) == F.col(number))
    # At most one group of repeated rows straddles the cut.
    cut = found.where(F.col(drawn) < F.col(number))
    some = cut.withColumn(number, F.row_number().over(W.partitionBy(owner, group).orderBy(F.lit(1))))
    return whole.unionAll(some.where(F.col(number) <= F.col(drawn))).select(*docs.columns)


def report(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """One row per document: features, weight, score and rank."""
    ranked = rank(weigh(docs, target, **options), percent, min_words)
    return ranked.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")

"""Removal of passages that an earlier document holds, by sorted suffixes.

A passage is a string of ``LENGTH`` bytes. Each one is the head of a suffix; its leading
token is its smallest hashed ``GRAM``-byte gram, which equal passages share wherever
they stand. Neighbouring suffixes mostly have the same leading token, so they travel
together as one stretch of text instead of ``LENGTH`` bytes each.

Splitters sampled from (leading token, document) cut the stretches into buckets, so a
token that a third of all documents contain is spread over many. A bucket sorts its
suffixes by multikey quicksort, eight bytes at a time, and knows the smallest document
of each passage it holds. Only the first and last token of a bucket can continue in
another one: their passages are compared across buckets by an ordinary aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import binary, give_back, small, written

LENGTH = 50
GRAM = 16
#: Bytes of stretches in a bucket, about; bounds what a task holds.
BUCKET_BYTES = 4 << 20
#: Bytes of stretches a task gathers before it sends them on.
FLUSH_BYTES = 32 << 20
#: Suffixes of repeated stretches judged at a time.
STEP = 1 << 19
#: Texts are cut into pieces of this many suffixes, short texts gathered up to it.
PIECE = 1 << 19
#: Sampled stretches per bucket, and bytes of sampled texts per bucket.
SAMPLES, SAMPLE_BYTES = 64, 32 << 10
#: Stretch bytes per text byte, as measured; used to choose the number of buckets.
SPREAD = 3.8
LAST = 2**63 - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _words(buffer: np.ndarray, dtype: str = "<u8") -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    return np.ndarray((max(len(buffer) - 7, 0),), dtype, buffer, strides=(1,))


def _mix(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    x = low * _A + high * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(29))


def _gram_hashes(buffer: np.ndarray) -> np.ndarray:
    words = _words(buffer)
    return _mix(words[: -GRAM + 8], words[GRAM - 8 :])


def _window_minima(x: np.ndarray) -> np.ndarray:
    """Smallest of the gram hashes inside each passage."""
    span, m = LENGTH - GRAM + 1, x
    width = 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = span - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def stretches(lengths: np.ndarray, buffer: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of pieces that lie one after another in ``buffer``.

    Returns first byte, number of suffixes, leading token, the token's place from the
    first byte, and the piece's number.
    """
    x = _gram_hashes(buffer)
    lead = _window_minima(x)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    valid = np.zeros(len(lead) + 1, np.int32)
    some = lengths >= LENGTH
    np.add.at(valid, starts[some], 1)
    np.add.at(valid, ends[some] - LENGTH + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (lead[1:] != lead[:-1])
    new[starts[some]] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(lead))
    piece = np.searchsorted(ends, first, side="right")
    count = np.minimum(stop, ends[piece] - LENGTH + 1) - first
    place = np.empty(len(first), np.int64)
    for a in range(0, len(first), 1 << 16):
        own = first[a : a + (1 << 16)]
        place[a : a + len(own)] = np.argmax(
            x[own[:, None] + np.arange(LENGTH - GRAM + 1)] == lead[own][:, None], axis=1
        )
    return first, count, lead[first], place, piece


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Groups of ``(doc, row, offset, bytes)`` of about ``PIECE`` bytes."""
    group, size = [], 0
    for batch in batches:
        docs, rows = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
        for doc, row, body in zip(docs.tolist(), rows.tolist(), binary(batch, "text")):
            for at in range(0, max(len(body) - LENGTH + 1, 0), PIECE):
                part = body[at : at + PIECE + LENGTH - 1]
                group.append((doc, row, at, part))
                size += len(part)
                if size >= PIECE:
                    yield group
                    group, size = [], 0
    if group:
        yield group


def _cut(group: list[tuple[int, int, int, bytes]]):
    buffer = np.frombuffer(b"".join(p[3] for p in group), np.uint8)
    lengths = np.array([len(p[3]) for p in group])
    first, count, lead, place, piece = stretches(lengths, buffer)
    doc = np.array([p[0] for p in group], np.int64)[piece]
    row = np.array([p[1] for p in group], np.int64)[piece]
    start = np.array([p[2] for p in group], np.int64)[piece] + first - (np.cumsum(lengths) - lengths)[piece]
    return buffer, first, count, lead, place, doc, row, start


def choose_splitters(rows: DataFrame, buckets: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """``buckets - 1`` ordered (token, document) pairs from a bounded sample of texts."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _pieces(batches):
            _, _, _, lead, _, doc, _, _ = _cut(group)
            chance = min(1.0, SAMPLES / (SAMPLE_BYTES / 18))
            keep = np.random.default_rng(abs(group[0][0]) % 2**32).random(len(lead)) < chance
            yield pa.RecordBatch.from_arrays(
                [pa.array(lead[keep].view(np.int64)), pa.array(doc[keep])], names=["lead", "doc"]
            )

    limit = int(share * (1 << 30))
    picked = rows.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) < limit)
    found = picked.mapInArrow(sample, "lead bigint, doc bigint").toPandas()
    lead, doc = found["lead"].to_numpy(np.int64).view(np.uint64), found["doc"].to_numpy(np.int64)
    order = np.lexsort((doc, lead))
    if not len(order):
        return lead, doc
    at = order[np.unique(np.arange(1, buckets) * len(order) // buckets)]
    return lead[at], doc[at]


def _bucket_of(lead: np.ndarray, doc: np.ndarray, splitters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of splitters at or below each (token, document)."""
    s_lead, s_doc = splitters
    low, high = np.searchsorted(s_lead, lead, "left"), np.searchsorted(s_lead, lead, "right")
    shared = np.flatnonzero(low != high)
    bucket = low.copy()
    for value in np.unique(low[shared]):
        own = shared[low[shared] == value]
        bucket[own] += np.searchsorted(s_doc[value : high[own[0]]], doc[own], "right")
    return bucket


def _gather(buffer: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many stretches, one after another."""
    total = int(size.sum())
    step = np.ones(total, np.int64)
    ends = np.cumsum(size)
    step[0] = first[0]
    step[ends[:-1]] = first[1:] - (first[:-1] + size[:-1] - 1)
    return buffer[np.cumsum(step)]


def _pack(parts: list[tuple[np.ndarray, ...]], bodies: list[np.ndarray]) -> bytes:
    doc, row, start, count, place = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.argsort(doc, kind="stable")
    if not (order[1:] > order[:-1]).all():
        size = count + LENGTH - 1
        body = np.concatenate(bodies)
        bodies = [_gather(body, (np.cumsum(size) - size)[order], size[order])]
        doc, row, start, count, place = (c[order] for c in (doc, row, start, count, place))
    head = b"".join(
        [
            np.int64(len(doc)).tobytes(),
            np.diff(doc, prepend=0).tobytes(),
            (row - doc).tobytes(),
            start.astype(np.uint32).tobytes(),
            count.astype(np.uint32).tobytes(),
            place.astype(np.uint8).tobytes(),
        ]
    )
    squeeze = zstandard.ZstdCompressor(level=1)
    a = squeeze.compress(np.frombuffer(head[8:-len(doc)], np.uint8).reshape(-1, 4).T.tobytes())
    b = squeeze.compress(head[-len(doc) :] + b"".join(x.tobytes() for x in bodies))
    return head[:8] + np.int64(len(a)).tobytes() + a + b


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, size = np.frombuffer(blob[:16], np.int64).tolist()
    open_ = zstandard.ZstdDecompressor()
    a = np.frombuffer(open_.decompress(blob[16 : 16 + size]), np.uint8).reshape(4, -1).T.copy().reshape(-1)
    b = np.frombuffer(open_.decompress(blob[16 + size :]), np.uint8)
    doc = np.cumsum(a[: 8 * n].view(np.int64))
    row = a[8 * n : 16 * n].view(np.int64) + doc
    start = a[16 * n : 20 * n].view(np.uint32).astype(np.int64)
    count = a[20 * n :].view(np.uint32).astype(np.int64)
    return doc, row, start, count, b[:n].astype(np.int64), b[n:]


def deal(rows: DataFrame, splitters: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(bucket, blob)``: the stretches of all texts, packed per task and bucket."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket, (parts, bodies) in held.items():
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([bucket], pa.int64()), "blob": [_pack(parts, bodies)]}
                )

        for group in _pieces(batches):
            buffer, first, count, lead, place, doc, row, start = _cut(group)
            bucket = _bucket_of(lead, doc, shared.value)
            order = np.argsort(bucket, kind="stable")
            length = count + LENGTH - 1
            bodies = _gather(buffer, first[order], length[order])
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            edges = np.concatenate([[0], np.cumsum(length[order])])
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
                own = order[a:b]
                parts, texts = held.setdefault(int(bucket[own[0]]), ([], []))
                parts.append((doc[own], row[own], start[own], count[own], place[own]))
                texts.append(bodies[edges[a] : edges[b]])
            size += len(bodies)
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = {}, 0
                give_back()
        yield from flush()
        held = {}
        give_back()

    return rows.mapInArrow(run, "bucket bigint, blob binary")


def multikey_groups(buffer: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the passages that begin at ``at`` and number equal ones alike.

    Multikey quicksort with eight bytes as a character: after each character only
    passages with equal heads go on, and heads that agree as a whole are not sorted
    again. Returns the sorted order and the first position of each group in it.
    """
    words = _words(buffer, ">u8")
    head = words[at].astype(np.uint64)
    order = np.argsort(head, kind="stable")
    new = np.ones(len(at), bool)
    new[1:] = head[order][1:] != head[order][:-1]
    for depth in [*range(8, LENGTH - 8, 8), LENGTH - 8]:
        twin = ~new
        twin[:-1] |= ~new[1:]
        place = np.flatnonzero(twin)
        if not len(place):
            break
        value = words[at[order[place]] + depth].astype(np.uint64)
        begins = new[place]
        group = np.cumsum(begins) - 1
        uneven = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(uneven, group, value != value[np.flatnonzero(begins)][group])
        mixed = uneven[group]
        if mixed.any():
            inner, own, g = place[mixed], value[mixed], group[mixed]
            sort = np.lexsort((own, g))
            order[inner] = order[inner[sort]]
            own, g = own[sort], g[sort]
            first = np.ones(len(own), bool)
            first[1:] = (own[1:] != own[:-1]) | (g[1:] != g[:-1])
            new[inner] = first
    return order, np.flatnonzero(new)


def _solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Removed stretches of one bucket, and what its border tokens must still compare."""
    parts = [_unpack(b) for b in blobs]
    doc, row, start, count, place = (np.concatenate([p[k] for p in parts]) for k in range(5))
    buffer = np.concatenate([p[5] for p in parts])
    del parts
    size = count + LENGTH - 1
    first = np.cumsum(size) - size
    words = _words(buffer)
    lead = _mix(words[first + place], words[first + place + GRAM - 8])
    order = np.lexsort((start, row, doc, lead))
    doc, row, start, count, size, first, lead = (c[order] for c in (doc, row, start, count, size, first, lead))
    new = np.ones(len(lead), bool)
    new[1:] = lead[1:] != lead[:-1]
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    several = doc[np.append(begin[1:], len(doc)) - 1] != doc[begin]
    border = np.zeros(len(begin), bool)
    border[[0, -1]] = True
    own = np.flatnonzero((several | border)[group])
    if not len(own):
        return
    text = buffer.tobytes()
    numbers: dict[bytes, int] = {}
    seen = np.fromiter(
        (
            numbers.setdefault(text[a:b], len(numbers))
            for a, b in zip(first[own].tolist(), (first[own] + size[own]).tolist())
        ),
        np.int64,
        len(own),
    )
    kept = np.unique(seen, return_index=True)[1]
    u = own[kept]
    del numbers, text
    # Suffixes of the distinct stretches, in order of stretch and place.
    width = count[u]
    base = np.cumsum(width) - width
    inside = np.arange(int(width.sum())) - np.repeat(base, width)
    sorted_, heads = multikey_groups(buffer, np.repeat(first[u], width) + inside)
    holder = np.repeat(doc[u], width)
    lowest = np.empty(len(holder), np.int64)
    least = np.minimum.reduceat(holder[sorted_], heads)
    lowest[sorted_] = np.repeat(least, np.diff(np.append(heads, len(sorted_))))
    del inside, sorted_, heads, holder, least
    # All occurrences, a bounded number of suffixes at a time.
    ends = np.cumsum(count[own])
    cut = np.searchsorted(ends, np.arange(STEP, int(ends[-1]) + STEP, STEP), "left") + 1
    last = 0
    for stop in np.unique(np.minimum(cut, len(own))).tolist():
        o, s = own[last:stop], seen[last:stop]
        last = stop
        n = count[o]
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        low = lowest[np.repeat(base[s], n) + off]
        mine = np.repeat(doc[o], n)
        gone = low < mine
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        # A run also ends where its stretch ends.
        close = np.cumsum(n) - 1
        opens = gone & ((edge[:-1] == 1) | (off == 0))
        shuts = gone & (edge[1:] == -1)
        shuts[close] |= gone[close]
        a, b = np.flatnonzero(opens), np.flatnonzero(shuts)
        which = np.repeat(np.arange(len(o)), n)
        if len(a):
            i = o[which[a]]
            yield _found(row[i], doc[i], start[i] + off[a], start[i] + off[b] + LENGTH, None)
        rest = np.flatnonzero(~gone & np.repeat(border[group[o]], n))
        for c in range(0, len(rest), 1 << 16):
            r = rest[c : c + (1 << 16)]
            i = o[which[r]]
            pos = first[i] + off[r]
            strings = buffer[pos[:, None] + np.arange(LENGTH)].tobytes()
            yield _found(
                row[i],
                doc[i],
                start[i] + off[r],
                start[i] + off[r] + LENGTH,
                [strings[k : k + LENGTH] for k in range(0, len(strings), LENGTH)],
            )


def _found(row, doc, a, b, passage) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in (row, doc, a, b)]
    texts = pa.nulls(len(row), pa.binary()) if passage is None else pa.array(passage, pa.binary())
    return pa.RecordBatch.from_arrays([*columns, texts], names=["row", "doc", "a", "b", "passage"])


def repeated_spans(rows: DataFrame, buckets: int, splitters: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(row, a, b)``: stretches of bytes to remove, possibly overlapping."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if bucket != at and held:
                    yield from _solve(held)
                    held = []
                    give_back()
                at = bucket
                held.append(blob.as_py())
        if held:
            yield from _solve(held)
            held = []
            give_back()

    dealt = deal(rows, splitters).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = written(
        dealt.mapInArrow(run, "row bigint, doc bigint, a bigint, b bigint, passage binary"), "stretches"
    )
    border = found.where("passage is not null")
    lowest = border.groupBy("passage").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    late = border.join(lowest, "passage").where("doc > low")
    return found.where("passage is null").select("row", "a", "b").unionAll(late.select("row", "a", "b"))


def _merged(spans: DataFrame) -> DataFrame:
    """``(row, starts, ends)``: the spans of each row, sorted and merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, starts, ends = None, [], []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_pydict(
                {"row": columns[0], "starts": columns[1], "ends": columns[2]},
                schema=pa.schema(
                    [("row", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
                ),
            )

        for batch in batches:
            for row, a, b in zip(*(batch.column(c).to_pylist() for c in ("row", "a", "b"))):
                if row != at:
                    if at is not None:
                        out.append((at, starts, ends))
                        if len(out) >= 4096:
                            yield flush()
                    at, starts, ends = row, [a], [b]
                elif a <= ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
        if at is not None:
            out.append((at, starts, ends))
            yield flush()

    ordered = spans.repartition("row").sortWithinPartitions("row", "a")
    return ordered.mapInArrow(run, "row bigint, starts array<bigint>, ends array<bigint>")


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, keep_text: bool = False
) -> DataFrame:
    """One row per document row: its size, what was removed and the rest's digest.

    Removed is each byte inside a ``LENGTH``-byte string that also starts in a row with a
    smaller id. A null id counts as larger than any other; rows with equal ids do not
    remove from each other. Null and empty texts, and those shorter than ``LENGTH``
    bytes, lose nothing. Ids are whole numbers. With ``keep_text`` the remaining bytes
    come as ``kept`` (binary: a cut may fall inside a character).
    """
    order = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("doc")
    base = docs.select(F.col(doc_id).alias("doc_id"), order, F.col(text).cast("string").alias("text"))
    facts = base.agg(
        F.count("*").alias("n"),
        F.countDistinct("doc").alias("ids"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"),
    ).first()
    if facts.n == facts.ids:
        rows = base.withColumn("row", F.col("doc"))
    else:
        rows = written(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    buckets = max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
        -(-int(facts.size * SPREAD) // bucket_bytes),
    )
    share = min(1.0, buckets * SAMPLE_BYTES / max(facts.size, 1))
    slim = rows.select("doc", "row", "text")
    splitters = choose_splitters(slim, buckets, share)
    spans = written(_merged(repeated_spans(slim, buckets, splitters)), "spans")
    joined = rows.select("doc_id", "row", "text").join(small(spans, 200_000), "row", "left")
    kind = dict(docs.select(doc_id).dtypes)[doc_id]
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans_, digests, kept = [], [], [], [], []
            spans = zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())
            for body, (starts, ends) in zip(binary(batch, "text"), spans):
                gone = sum(ends) - sum(starts) if starts else 0
                if gone:
                    body_kept = b"".join(body[a:b] for a, b in zip([0, *ends], [*starts, len(body)]))
                else:
                    body_kept = body
                sizes.append(len(body))
                removed.append(gone)
                spans_.append(len(starts or ()))
                digests.append(hashlib.sha256(body_kept).hexdigest())
                kept.append(body_kept if keep_text else b"")
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans_)), pa.array(digests)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(finish, schema + (", kept binary" if keep_text else ""))

"""Katz backoff language model over words: bigrams, words, one unknown word.

Counts are discounted by Good-Turing; what a context saves goes to the words never seen
after it, by their own discounted probability, with a weight that makes every context
sum to one exactly. A token is evaluated recursively: the bigram if it was seen, else
the context's backoff weight times the word, else the unknown word.

Nothing is looked up row by row. Tasks turn texts into blocks with a local vocabulary;
block vocabularies meet in word buckets, where counts are added up and given back once
per block and word. Then each block sends its distinct (context, word, document) triples
to context buckets, which count, normalise and score in place. A context so frequent
that it would fill a bucket is spread over all by the next word; its sums are the only
thing that leaves the buckets, and their number is bounded by tokens per bucket.

Words are known by their 64-bit hash. Tables are stored in the shared folder by bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import LOWER_BYTES, binary, give_back, written

#: Tokens of a block, and triples of a bucket, about; they bound what a task holds.
BLOCK_TOKENS = 3 << 19
BUCKET_TRIPLES = 1 << 21
#: Documents whose parts of the score are added up together.
SHARD_ROWS = 1 << 14
#: Counts up to this are discounted by Good-Turing; larger ones keep this share, so that
#: no context is without mass for the words it has not seen.
DISCOUNTED, KEPT = 5, 0.999
_BEGIN, _END = 0, 1
#: Hashes kept for the two marks; a text's word with such a hash is moved on.
_MARKS = 2


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays, bytes of equal rank together, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1)
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        body = squeeze.compress(planes)
        parts.append(np.array([len(a), len(body)], np.int64).tobytes() + a.dtype.str.encode().ljust(4) + body)
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at, open_ = [], 0, zstandard.ZstdDecompressor()
    while at < len(blob):
        n, size = np.frombuffer(blob[at : at + 16], np.int64).tolist()
        kind = np.dtype(blob[at + 16 : at + 20].decode().strip())
        planes = open_.decompress(blob[at + 20 : at + 20 + size]) if n else b""
        out.append(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T.copy().reshape(-1).view(kind))
        at += 20 + size
    return out


def discounts(counts_of_counts: Mapping[int, int], top: int = DISCOUNTED) -> np.ndarray:
    """Katz discount factors for counts 0..top+1 (the last stands for all larger ones).

    Where Good-Turing gives no factor inside (0, 1), as on tiny tables, every count r is
    discounted by half a count: (r - 0.5) / r, and larger ones like ``top + 1``.
    """
    n = [0, *(counts_of_counts.get(r, 0) for r in range(1, top + 2))]
    plain = np.array([1.0, *((r - 0.5) / r for r in range(1, top + 2))])
    if not all(n[1:]):
        return plain
    cut = (top + 1) * n[top + 1] / n[1]
    if cut >= 1:
        return plain
    d = [1.0]
    for r in range(1, top + 1):
        star = (r + 1) * n[r + 1] / n[r]
        d.append((star / r - cut) / (1 - cut))
    if not all(0 < x < 1 for x in d[1:]):
        return plain
    return np.array([*d, KEPT])


def _of(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, len(d) - 1)]


# Blocks -------------------------------------------------------------------------------


def _word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h if h >= _MARKS else h + _MARKS


class _Block:
    def __init__(self) -> None:
        self.words: dict = {_BEGIN: 0, _END: 1}
        self.tokens: list[np.ndarray] = []
        self.segments: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, row: int, trained: int, context: bytes | int, words: list) -> None:
        known = self.words
        number = known.setdefault
        lead = number(context, len(known))
        ids = np.fromiter((number(w, len(known)) for w in words), np.uint32, len(words))
        self.tokens.append(ids)
        self.segments.append((row, trained, lead, len(words)))
        self.size += len(words)

    def finish(self) -> dict[str, bytes]:
        hashes = np.array([w if isinstance(w, int) else _word_hash(w) for w in self.words], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        tokens = rank[np.concatenate(self.tokens)]
        row, trained, lead, n = (np.array(c, np.int64) for c in zip(*self.segments))
        mine = np.repeat(trained > 0, n)
        counts = np.bincount(tokens[mine], minlength=len(hashes)).astype(np.uint32)
        return {
            "vocabulary": pack(hashes[order], counts),
            "body": pack(tokens, row, trained.astype(np.uint8), rank[lead], n),
        }


def blocks(rows: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(block, vocabulary, body)`` of rows ``(row, trained, text)``; long texts are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()

        def out() -> pa.RecordBatch:
            nonlocal number, block
            columns = {"block": pa.array([number], pa.int64()), **{k: [v] for k, v in block.finish().items()}}
            number, block = number + 1, _Block()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            facts = zip(batch.column("row").to_pylist(), batch.column("trained").to_pylist())
            for (row, trained), body in zip(facts, binary(batch, "text")):
                words: list = body.translate(LOWER_BYTES).split()
                words.append(_END)
                context: bytes | int = _BEGIN
                for at in range(0, len(words), block_tokens):
                    part = words[at : at + block_tokens]
                    block.add(row, int(trained), context, part)
                    context = part[-1]
                    if block.size >= block_tokens:
                        yield out()
                        give_back()
        if block.size:
            yield out()
            give_back()

    return rows.mapInArrow(run, "block bigint, vocabulary binary, body binary")


def _split_range(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """First place of each bucket's hash range in sorted hashes."""
    limits = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]])


def word_counts(stored: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the corpus counts of the block's words, in their order,
    and each word's number in the bucket; once per bucket its word and token totals and
    its counts of counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("vocabulary")):
                hashes, counts = unpack(blob.as_py())
                cut = _split_range(hashes, buckets)
                for b in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[b], cut[b + 1])
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": pa.array([b], pa.int64()), "block": pa.array([block], pa.int64()), "blob": [pack(hashes[own], counts[own])]}
                    )

    def total(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(blob) for _, blob in held]
        words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        at = 0
        for (block, _), part in zip(held, parts):
            own = place[at : at + len(part[0])]
            at += len(own)
            yield _gathered(bucket, block, pack(sums[own], own.astype(np.uint32)), None)
        seen = sums[sums > 0]
        r, n = np.unique(seen[seen <= DISCOUNTED + 1], return_counts=True)
        facts = np.array([len(seen), seen.sum(), *np.bincount(r, n, DISCOUNTED + 2)[1:]], np.int64)
        yield _gathered(bucket, None, None, facts)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches, "block"):
            yield from total(bucket, held)
            give_back()

    dealt = stored.select("block", "vocabulary").mapInArrow(deal, "bucket bigint, block bigint, blob binary")
    return (
        dealt.repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(reduce, "bucket bigint, block bigint, blob binary, facts array<bigint>")
    )


def _gathered(bucket, block, blob, facts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([bucket], pa.int64()),
            pa.array([block], pa.int64()),
            pa.array([blob], pa.binary()),
            pa.array([None if facts is None else facts.tolist()], pa.list_(pa.int64())),
        ],
        names=["bucket", "block", "blob", "facts"],
    )


def _by_bucket(batches: Iterator[pa.RecordBatch], extra: str) -> Iterator[tuple[int, list[tuple]]]:
    at, held = None, []
    for batch in batches:
        for bucket, other, blob in zip(batch.column("bucket").to_pylist(), batch.column(extra).to_pylist(), batch.column("blob")):
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append((other, blob.as_py()))
    if held:
        yield at, held


# Words to contexts --------------------------------------------------------------------


def _word_log(counts: np.ndarray, model: dict) -> np.ndarray:
    """log10 probability of words by their training counts; count 0 is the unknown word."""
    seen = np.maximum(counts, 1)
    p = np.log10(_of(seen, model["d1"])) + np.log10(seen) - model["log_n"]
    return np.where(counts > 0, p, model["log_unknown"])


def triples(stored: DataFrame, gathered: DataFrame, model: dict, buckets: int, word_buckets: int) -> DataFrame:
    """``(bucket, kind, blob)``: triples for the context buckets, and per block the
    documents' token figures (kind 1)."""
    shared = stored.sparkSession.sparkContext.broadcast(model)

    def solve(body: bytes, answers: list[bytes], order: list[int], block: int) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tokens, row, trained, lead, n = unpack(body)
        parts = [unpack(a) for a in answers]
        counts = np.concatenate([p[0] for p in parts])
        ids = np.concatenate([(np.uint64(b) << np.uint64(32)) | p[1].astype(np.uint64) for b, p in zip(order, parts)])
        # Figures of each segment.
        starts = np.cumsum(n) - n
        c = counts[tokens]
        base = np.log10(c + 1) - np.log10(own["n"] + own["v"] + 1)
        figures = [row, n, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts)]
        yield _sent(block % buckets, 1, pack(*figures))
        # Distinct (context, word, document) with their number.
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[starts] = lead
        segment = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        pair = (before.astype(np.uint64) << np.uint64(32)) | tokens
        order_ = np.lexsort((segment, pair))
        pair, segment = pair[order_], segment[order_]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(pair))).astype(np.uint32)
        pair, segment = pair[at], segment[at].astype(np.int64)
        del before, order_, new
        u, v = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begins = ids[u] == own["begin"]
        cu = np.where(begins, own["texts"], counts[u])
        with np.errstate(over="ignore"):
            salt = (ids[v] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            home = (ids[u] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
        bucket = np.where(cu > own["hot"], (home + salt) % np.uint64(buckets), home % np.uint64(buckets)).astype(np.int64)
        place = np.lexsort((segment, v, u, bucket))
        cuts = np.flatnonzero(np.diff(bucket[place])) + 1
        for p in np.split(place, cuts):
            uu, vv = u[p], v[p]
            opens = np.ones(len(p), bool)
            opens[1:] = (uu[1:] != uu[:-1]) | (vv[1:] != vv[:-1])
            first = np.flatnonzero(opens)
            docs = np.diff(np.append(first, len(p))).astype(np.uint32)
            cu_ = cu[p][first]
            yield _sent(
                int(bucket[p[0]]),
                0,
                pack(
                    ids[uu[first]], ids[vv[first]], cu_, counts[vv[first]], docs,
                    row[segment[p]], trained[segment[p]], times[p],
                ),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, body, answers, order = None, None, [], []
        for batch in batches:
            for block, bucket, blob in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("blob")):
                if block != at:
                    if body is not None:
                        yield from solve(body, answers, order, at)
                        give_back()
                    at, body, answers, order = block, None, [], []
                if bucket < 0:
                    body = blob.as_py()
                else:
                    answers.append(blob.as_py())
                    order.append(bucket)
        if body is not None:
            yield from solve(body, answers, order, at)
            give_back()

    both = stored.select("block", F.lit(-1).cast("bigint").alias("bucket"), F.col("body").alias("blob")).unionAll(
        gathered.where("block is not null").select("block", "bucket", "blob")
    )
    return (
        both.repartition(max(buckets, word_buckets), "block")
        .sortWithinPartitions("block", "bucket")
        .mapInArrow(run, "bucket bigint, kind int, blob binary")
    )


def _sent(bucket: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())],
        names=["bucket", "kind", "blob"],
    )


# Context buckets ----------------------------------------------------------------------


def _context_bucket(blobs: list[bytes], model: dict) -> tuple[bytes, bytes, bytes, list[int], bytes]:
    """Count bigrams; keep what scoring needs once the bigram discounts are known.

    Returns the seen part (per document: log of relative counts and how often each count
    class occurs), the unseen part (document, context, number), the contexts (id, total,
    sums by count class, probability mass of their seen words), counts of counts, and
    the bigrams themselves (context, word, count).
    """
    parts = [unpack(b) for b in blobs]
    u, v, cu, cv, docs = (np.concatenate([p[k] for p in parts]) for k in range(5))
    row, trained, times = (np.concatenate([p[k] for p in parts]) for k in range(5, 8))
    del parts
    order = np.lexsort((v, u))
    new = np.ones(len(u), bool)
    new[1:] = (u[order][1:] != u[order][:-1]) | (v[order][1:] != v[order][:-1])
    pair = np.empty(len(u), np.int64)
    pair[order] = np.cumsum(new) - 1
    first = order[new]
    del order, new
    each = np.repeat(pair, docs)
    count = np.bincount(each, times * (trained > 0), len(first)).astype(np.int64)
    u, cu, cv = u[first], cu[first], cv[first]
    opens = np.ones(len(u), bool)
    opens[1:] = u[1:] != u[:-1]
    context = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    seen = count > 0
    level = np.minimum(count, DISCOUNTED + 1)
    sums = np.zeros((len(heads), DISCOUNTED + 2))
    np.add.at(sums, (context[seen], level[seen]), count[seen])
    mass = np.bincount(context[seen], 10.0 ** _word_log(cv[seen], model), len(heads))
    counts_of_counts = np.bincount(level[seen], minlength=DISCOUNTED + 2)[1:].tolist()
    contexts = pack(u[heads], cu[heads], mass, *(sums[:, r].copy() for r in range(1, DISCOUNTED + 2)))
    # Occurrences, added up by document.
    ids, doc = np.unique(row, return_inverse=True)
    got = seen[each]
    ratio = np.log10(np.maximum(count, 1)) - np.log10(np.maximum(cu, 1))
    sure = np.bincount(doc[got], (ratio[each] * times)[got], len(ids))
    classes = [
        np.bincount(doc[got & (level[each] == r)], times[got & (level[each] == r)], len(ids)).astype(np.int64)
        for r in range(1, DISCOUNTED + 2)
    ]
    words = np.bincount(doc[~got], (_word_log(cv, model)[each] * times)[~got], len(ids))
    known = pack(ids, sure + words, *classes)
    # Only contexts seen in training weigh what backs off to the word itself.
    off = ~got & (cu[each] > 0)
    key = (doc[off].astype(np.uint64) << np.uint64(32)) | context[each[off]].astype(np.uint64)
    key, where = np.unique(key, return_inverse=True)
    number = np.bincount(where, times[off], len(key)).astype(np.int64)
    unseen = pack((key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), number)
    return known, unseen, contexts, counts_of_counts, pack(u[seen], v[first][seen], count[seen])


def context_buckets(dealt: DataFrame, model: dict, buckets: int, keep_bigrams: bool = False) -> DataFrame:
    shared = dealt.sparkSession.sparkContext.broadcast(model)
    schema = "bucket bigint, known binary, unseen binary, contexts binary, n array<bigint>, figures binary, bigrams binary, hot array<struct<u:bigint,c:bigint,sums:array<double>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for bucket, held in _by_bucket(batches, "kind"):
            result = {"bucket": bucket, "known": None, "unseen": None, "contexts": None, "n": None, "hot": None, "figures": None, "bigrams": None}
            figures = [unpack(b) for kind, b in held if kind == 1]
            if figures:
                result["figures"] = pack(*(np.concatenate([f[k] for f in figures]) for k in range(4)))
            blobs = [b for kind, b in held if kind == 0]
            if blobs:
                known, unseen, contexts, n, bigrams = _context_bucket(blobs, own)
                u, c, mass, *sums = unpack(contexts)
                hot = np.flatnonzero(c > own["hot"])
                result |= {"known": known, "unseen": unseen, "contexts": contexts, "n": n}
                result["bigrams"] = bigrams if keep_bigrams else None
                result["hot"] = [
                    {"u": int(u[i].view(np.int64)), "c": int(c[i]), "sums": [float(mass[i]), *(float(s[i]) for s in sums)]}
                    for i in hot
                ]
            yield pa.RecordBatch.from_pylist([result], schema=_BUCKET)
            give_back()

    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


_BUCKET = pa.schema(
    [
        ("bucket", pa.int64()),
        ("known", pa.binary()),
        ("unseen", pa.binary()),
        ("contexts", pa.binary()),
        ("n", pa.list_(pa.int64())),
        ("figures", pa.binary()),
        ("bigrams", pa.binary()),
        ("hot", pa.list_(pa.struct([("u", pa.int64()), ("c", pa.int64()), ("sums", pa.list_(pa.float64()))]))),
    ]
)


def backoff_weights(total: np.ndarray, mass: np.ndarray, sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Weight of the words not seen after each context.

    ``sums`` are the context's counts by count class, ``total`` all of them, ``mass`` the
    word probability of what was seen.
    """
    return (1.0 - (sums @ d[1:]) / total) / (1.0 - mass)


def document_scores(tables: DataFrame, d2: np.ndarray, hot: dict[int, float], shards: int) -> DataFrame:
    """``(row, n_tokens, n_known, base, score)``; each bucket packs its parts by shard."""
    shared = tables.sparkSession.sparkContext.broadcast((d2, hot))

    def deal(row, n, known, base, score) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            mixed = row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(own):
                blob = pack(row[own], n[own], known[own], base[own], score[own])
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard[own[0]]], pa.int64()), "blob": [blob]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, spread = shared.value
        for batch in batches:
            for item in batch.to_pylist():
                if item["figures"]:
                    row, n, known, base = unpack(item["figures"])
                    yield from deal(row, n, known, base, np.zeros(len(row)))
                if item["known"]:
                    row, score, *classes = unpack(item["known"])
                    for r, number in enumerate(classes, 1):
                        score = score + number * np.log10(d[r])
                    u, c, mass, *sums = unpack(item["contexts"])
                    weight = np.ones(len(u))
                    own = c > 0
                    weight[own] = backoff_weights(c[own], mass[own], np.stack(sums, axis=1)[own], d)
                    for i, key in enumerate(u.view(np.int64).tolist()):
                        if key in spread:
                            weight[i] = spread[key]
                    doc, context, number = unpack(item["unseen"])
                    off = np.bincount(doc, number * np.log10(weight[context]), len(row)) if len(doc) else 0.0
                    zero = np.zeros(len(row), np.int64)
                    yield from deal(row, zero, zero, np.zeros(len(row)), score + off)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def total() -> list[np.ndarray]:
            parts = [np.concatenate([h[k] for h in held]) for k in range(5)]
            row, place = np.unique(parts[0], return_inverse=True)
            sums = [np.bincount(place, p, len(row)) for p in parts[1:]]
            return [row, *(s.astype(np.int64) for s in sums[:2]), *sums[2:]]

        for batch in batches:
            held += [unpack(b.as_py()) for b in batch.column("blob")]
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [total()]
        if held:
            row, n, known, base, score = total()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (row, n, known, base, score)], names=["row", "n_tokens", "n_known", "base", "score"]
            )

    dealt = tables.select("known", "unseen", "contexts", "figures").mapInArrow(run, "shard bigint, blob binary")
    return dealt.repartition(shards, "shard").mapInArrow(
        add, "row bigint, n_tokens bigint, n_known bigint, base double, score double"
    )


def fit_and_score(
    docs: DataFrame,
    trained: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    block_tokens: int = BLOCK_TOKENS,
    bucket_triples: int = BUCKET_TRIPLES,
    keep_bigrams: bool = False,
) -> tuple[DataFrame, dict]:
    """Learn from the rows where ``trained`` holds and score every row.

    Returns ``(doc_id, trained, n_tokens, n_known, base, score)`` per row and the model:
    its figures, discounts and the stored ``tables``. A text has its words and one end
    token; null and empty texts have the end token alone. ``base`` is the add-one word
    score, ``score`` the model's, both log10. Rows that repeat an id are scored each by
    itself, null ids too. Without training rows every word is the unknown one, which then
    has probability one. An empty table gives an empty result.
    """
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(trained, F.lit(False)).alias("trained"),
        F.col(text).cast("string").alias("text"),
    )
    facts = base.agg(
        F.count("*").alias("n"),
        F.countDistinct("doc_id").alias("ids"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size"),
        F.count(F.when(F.col("trained"), 1)).alias("texts"),
    ).first()
    if facts.n == facts.ids and dict(base.dtypes)["doc_id"] in ("bigint", "int"):
        rows = base.withColumn("row", F.col("doc_id").cast("bigint"))
    else:
        rows = written(base.withColumn("row", F.monotonically_increasing_id()), "rows")
    guess = facts.size // 6 + facts.n
    word_buckets = max(8, -(-guess // (4 * bucket_triples)))
    buckets = max(8, -(-guess // bucket_triples))
    stored = written(blocks(rows.select("row", "trained", "text"), block_tokens), "blocks")
    gathered = written(word_counts(stored, word_buckets), "words")
    sums = gathered.where("facts is not null").select(
        *[F.coalesce(F.sum(F.col("facts")[i]), F.lit(0)).alias(f"f{i}") for i in range(DISCOUNTED + 3)]
    ).first()
    v, n, *counts = (int(x) for x in sums)
    d1 = discounts(dict(enumerate(counts, 1)))
    single = np.arange(1, DISCOUNTED + 1) * np.array(counts[:DISCOUNTED])
    used = (single * d1[1 : DISCOUNTED + 1]).sum() + (n - single.sum()) * d1[-1]
    model = {
        "v": v,
        "n": n,
        "texts": facts.texts,
        "d1": d1,
        "log_n": np.log10(max(n, 1)),
        "log_unknown": float(np.log10(1.0 - used / max(n, 1))),
        "begin": np.uint64(_BEGIN),
        "hot": max(1 << 10, guess // (4 * buckets)),
    }
    dealt = triples(stored, gathered, model, buckets, word_buckets)
    tables = written(context_buckets(dealt, model, buckets, keep_bigrams), "contexts")
    got = tables.where("n is not null").select(
        *[F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"n{i}") for i in range(DISCOUNTED + 1)]
    ).first()
    d2 = discounts({r: int(c) for r, c in enumerate(got, 1)})
    # At most four contexts per bucket are spread over the buckets.
    pieces = tables.select(F.explode("hot").alias("h")).select("h.u", "h.c", "h.sums").groupBy("u", "c").agg(
        *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DISCOUNTED + 2)]
    )
    hot = {
        r[0]: float(backoff_weights(np.array([r[1]]), np.array([r[2]]), np.array([r[3:]], float), d2)[0])
        for r in pieces.collect()
    }
    parts = document_scores(tables, d2, hot, max(8, facts.n // SHARD_ROWS))
    scored = rows.select("doc_id", "trained", "row").join(parts, "row").drop("row")
    return scored, model | {"d2": d2, "hot_weights": hot, "tables": tables, "words": gathered, "blocks": stored}

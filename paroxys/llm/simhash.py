"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that near ones agree in one segment but for at
most one bit: two segments of 32 bits for up to three differing bits. Every segment is
indexed once for each of its bits with that bit deleted, so near fingerprints meet under
an equal key. Keys are joined by sorting; what meets is verified, and a key leaves at
most one link per fingerprint, never all pairs.

Equal fingerprints count once, however many documents have them. A key that more than
``RUN_LIMIT`` fingerprints share is split again by the part of the fingerprint that is
still free, in halves with one deleted bit, which loses no near pair: of three differing
bits one half has at most one. At the third level a key fixes all but eleven bits, so no
task ever holds more than 2048 fingerprints of one key.

``drop_near`` finds near texts (word shingles, Jaccard similarity) exactly. Links between
fingerprints come first and gather most of a group; every one is verified on the shingles.
What they miss is found by a prefix filter: in one order of all shingles, rare ones first,
similar sets share one of their first shingles. These are the keys. Members of a key are
compared by size and by a bitmap of shingle parities, which never rule out a similar pair.
Under the first keys of each text, those that most texts have, members meet with their texts
and are verified on the spot: such a part hands out only verified links that span its groups, fewer than it has
members, and a pair that fails leaves no row. Sizes and bitmaps are compared before: texts move only to members
with a pair that these allow. Pairs that share no first key, or have a long
text, are then compared under all keys and verified afterwards. Large keys are compared in
blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import LOWER_BYTES, binary, fresh, give_back, small, written
from paroxys.llm.components import components

MAX_BITS = 3
RUN_LIMIT = 2048
SEED = 42
#: For near texts: shingle length, similarity, and members of a key compared in one block.
SHINGLE, SIMILARITY, NEAR_LIMIT = 5, 0.8, 1024
#: Bits of the bitmap that rules out pairs; keys of a node that link it to their ends.
PARITY_BITS, HUB_KEYS = 1024, 4
#: First keys of a text under which pairs are verified on the spot, and the shingles up to
#: which a text goes there; the other pairs are verified after the last round.
FIRST_KEYS, FIRST_SHINGLES = 3, 4096
#: Shingles that one task holds for verification.
_HELD_GRAMS = 1 << 22
#: Texts of the sample that orders shingles by frequency, and shingles counted there.
SAMPLE_TEXTS, COMMON = 20_000, 1 << 18
_SLICE = 1 << 16


def shingle_hashes(text: bytes, n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``n``-word shingle, repeats included; a shorter text is one shingle."""
    ws = text.translate(LOWER_BYTES).split()
    if not ws:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(ws) <= n:
        return np.array([digest(b" ".join(ws), seed)], np.uint64)
    line = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(ws) - n + 1].tolist(), ends[n - 1 :].tolist())
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(ws) - n + 1)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as an unsigned number; none: zero."""
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), _SLICE):
        part = hashes[begin : begin + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp)``: the 64-bit fingerprint of each row, as a signed number.

    Null and empty texts have fingerprint zero.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(majority(shingle_hashes(body, n, seed))) for body in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


def _variants(rows: DataFrame, first: str, width: int) -> DataFrame:
    """Two halves of the ``2 * width`` bits of ``fp`` from bit ``free`` on, each with one
    of its bits deleted. Adds ``key``; ``free`` becomes the other half's first bit.
    ``first`` is what earlier levels fixed."""
    j = F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("j")
    mask = (1 << width) - 1
    half = f"(free + if(j < {width}, 0, {width}))"
    masked = f"(shiftright(fp, {half}) & {mask}L) & ~shiftleft(1L, j % {width})"
    return rows.select("fp", "free", *([first] if first else []), j).select(
        (F.xxhash64(first, "j", F.expr(masked)) if first else F.expr(f"shiftleft(cast(j as bigint), {width}) | ({masked})")).alias("key"),
        F.expr(f"free + if(j < {width}, {width}, 0)").alias("free"),
        "fp",
    )


def sorted_runs(
    batches: Iterator[pa.RecordBatch], limit: int | None = None
) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Cut batches sorted by ``key`` into pieces of whole runs.

    Yields ``(columns, heavy)``. A run longer than ``limit`` comes in heavy pieces of its
    own, so that no more than about ``limit`` rows and a batch are held.
    """
    held: dict[str, np.ndarray] | None = None
    heavy_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        if heavy_key is not None:
            same = cols["key"] == heavy_key
            if same.any():
                yield {n: c[same] for n, c in cols.items()}, True
                cols = {n: c[~same] for n, c in cols.items()}
            if not len(cols["key"]):
                continue
            heavy_key = None
        if held is not None:
            cols = {n: np.concatenate([held[n], c]) for n, c in cols.items()}
        key = cols["key"]
        begin = int(np.searchsorted(key, key[-1]))
        if begin:
            yield {n: c[:begin] for n, c in cols.items()}, False
        held = {n: c[begin:] for n, c in cols.items()}
        if limit is not None and len(held["key"]) > limit:
            heavy_key = held["key"][0]
            yield held, True
            held = None
    if held is not None and len(held["key"]):
        yield held, False


def _runs_of_two(key: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(key)]])
    several = ends - starts > 1
    return list(zip(starts[several].tolist(), ends[several].tolist()))


def _near_components(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """Index of the first member of each fingerprint's component within one key."""
    root = np.full(len(fps), -1)
    for i in range(len(fps)):
        if root[i] >= 0:
            continue
        root[i] = i
        todo = [i]
        while todo:
            at = todo.pop()
            near = np.flatnonzero((np.bitwise_count(fps ^ fps[at]) <= max_bits) & (root < 0))
            root[near] = i
            todo.extend(near.tolist())
    return root


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, run_limit: int = RUN_LIMIT) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that span all components of
    the graph of pairs with at most ``max_bits`` (three or fewer) differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one deleted bit cover up to three bits")

    def link(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
        for cols, heavy in sorted_runs(batches, limit):
            if heavy:
                none = pa.nulls(len(cols["key"]), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols["key"]), pa.array(cols["free"]), pa.array(cols["fp"]), none],
                    names=["key", "free", "fp", "root"],
                )
                continue
            unsigned = cols["fp"].view(np.uint64)
            a, b, k = [], [], []
            for begin, end in _runs_of_two(cols["key"]):
                if limit is not None and end - begin > limit:
                    k.append(np.arange(begin, end))
                    continue
                root = _near_components(unsigned[begin:end], max_bits)
                own = np.flatnonzero(root != np.arange(end - begin))
                a.append(cols["fp"][begin + own])
                b.append(cols["fp"][begin + root[own]])
            if a and sum(map(len, a)):
                a, b = np.concatenate(a), np.concatenate(b)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, pa.nulls(len(a), pa.int32()), pa.array(a), pa.array(b)], names=["key", "free", "fp", "root"]
                )
            if k:
                at = np.concatenate(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols["key"][at]), pa.array(cols["free"][at]), pa.array(cols["fp"][at]), pa.nulls(len(at), pa.int64())],
                    names=["key", "free", "fp", "root"],
                )

    rows = _variants(fps.select("fp", F.lit(0).alias("free")), "", 32)
    found = None
    for width in (16, 8, 0):
        limit = run_limit if width else None
        sorted_rows = rows.repartition("key").sortWithinPartitions("key")
        out = written(
            sorted_rows.mapInArrow(
                lambda batches, limit=limit: link(batches, limit), "key bigint, free int, fp bigint, root bigint"
            ),
            "links",
        )
        links = out.where("root is not null").select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct()
        found = links if found is None else found.unionAll(links)
        heavy = out.where("root is null")
        if not width or heavy.isEmpty():
            break
        rows = _variants(heavy, "key", width)
    return found.distinct()


def near_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, max_bits: int = MAX_BITS, run_limit: int = RUN_LIMIT
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest id reachable over links; a null id counts as larger
    than any other. Repeated rows are linked with each other. An empty table stays empty.
    """
    rows = written(fingerprints(docs, doc_id, text, n), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    parts = components(near_links(classes.select("fp"), max_bits, run_limit))
    rooted = written(
        classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
            "root", F.coalesce("root", "fp")
        ),
        "rooted",
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.join(lowest, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near texts ---------------------------------------------------------------------------


def _needed(size: int, similarity: float) -> int:
    """Shingles a set must share with any similar one."""
    return int(np.ceil(similarity * size - 1e-9))


def _prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in the global order (count in the sample, hash): so
    many that any two similar sets have one of them in common."""
    known, times = common
    weight = np.zeros(len(grams), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        weight = np.where(known[at] == grams, times[at], 0)
    return grams[np.lexsort((grams, weight))][: len(grams) - _needed(len(grams), similarity) + 1]


def _parity(grams: np.ndarray) -> np.ndarray:
    """Bitmap with the parity of the shingles of each bit. Two bitmaps never differ in
    more bits than their sets differ in shingles."""
    bits = np.bincount((grams % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _wide_parity(grams: np.ndarray) -> bytes:
    """The same bitmap with about as many bits as there are shingles, a power of two."""
    bits = max(PARITY_BITS, 1 << max(len(grams) - 1, 0).bit_length())
    odd = np.bincount((grams % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _wide_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps; the larger one is folded to the size of the other."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets of shingles, without repeats, are similar; empty sets are."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return union == 0 or common >= similarity * union


class _Sets:
    """Shingle sets of the texts of a piece, made when asked for and held up to a bound."""

    def __init__(self, texts: np.ndarray, shingle: int):
        self.texts, self.shingle = texts, shingle
        self.held: dict[int, np.ndarray] = {}
        self.total = 0

    def __getitem__(self, at: int) -> np.ndarray:
        if at not in self.held:
            if self.total > _HELD_GRAMS:
                self.held, self.total = {}, 0
            self.held[at] = np.unique(shingle_hashes(self.texts[at].encode(), self.shingle))
            self.total += len(self.held[at])
        return self.held[at]


def _settled(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` have one of their first keys in common."""
    met = np.zeros(len(a), bool)
    for i in range(first.shape[1]):
        for j in range(first.shape[1]):
            met |= first[a, i] == first[b, j]
    return met


def _meetings(
    key: np.ndarray,
    size: np.ndarray,
    root: np.ndarray,
    sig: np.ndarray,
    similarity: float,
    forest: bool,
    near: Callable[[int, int], bool] | None = None,
    settled: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs under one key, of different roots, whose sizes and bitmaps allow
    the similarity; rows are sorted by key and size.

    With ``forest`` only pairs that join two roots not yet joined under the key: at most
    one less than the key has members. There ``near`` decides whether a pair joins them.
    Pairs that are ``settled`` are left out.
    """
    ratio = (1 - similarity) / (1 + similarity)
    at = np.arange(len(key))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    group = root.copy()
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for step in range(1, len(key)):
        at = at[at + step < len(key)]
        # Later rows of the key are larger still.
        at = at[(key[at + step] == key[at]) & (similarity * size[at + step] <= size[at] + 1e-9)]
        if not len(at):
            break
        own = at[group[at] != group[at + step]]
        for part in np.split(own, range(_SLICE, len(own), _SLICE)):
            apart = np.bitwise_count(sig[part] ^ sig[part + step]).sum(axis=1, dtype=np.int64)
            hit = part[apart <= ratio * (size[part] + size[part + step]) + 1e-9]
            if settled is not None:
                hit = hit[~settled(hit, hit + step)]
            if forest:
                joins = []
                for x in hit.tolist():
                    old, new = group[x + step], group[x]
                    if old != new and (near is None or near(x, x + step)):
                        members = group[starts[run[x]] : starts[run[x] + 1]]
                        members[members == old] = new
                        joins.append(x)
                hit = np.array(joins, np.int64)
            a.append(hit)
            b.append(hit + step)
    return np.concatenate(a), np.concatenate(b)


def _spread(live: DataFrame, run_limit: int) -> DataFrame:
    """Rows ``(part, node, root)`` of the keys that hold several roots.

    A part has about twice ``run_limit`` rows at most and any two members of a key that
    have different roots meet in one. Large keys are cut into blocks by hash; members of
    the key's most frequent root have blocks of their own, which never meet each other.
    """
    counts = live.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = written(counts.where("lo < hi").select("key", "c"), "mixed")
    heavy = mixed.where(F.col("c") > run_limit)
    light = live.join(mixed.where(F.col("c") <= run_limit).select("key"), "key", "left_semi")
    light = light.select(F.col("key").alias("part"), "node", "root")
    if heavy.isEmpty():
        return light
    per_root = live.join(heavy, "key").groupBy("key", "c", "root").agg(F.count("*").alias("n"))
    tops = per_root.groupBy("key", "c").agg(F.max(F.struct("n", "root")).alias("top"))
    blocks = written(
        tops.select(
            "key",
            F.col("top.root").alias("top"),
            F.ceil(F.col("top.n") / run_limit).alias("n_top"),
            F.ceil((F.col("c") - F.col("top.n")) / run_limit).alias("n_rest"),
        ),
        "blocks",
    )
    # Blocks of the rest are 0 to n_rest - 1, those of the most frequent root follow.
    in_top = F.col("root") == F.col("top")
    home = F.when(in_top, F.col("n_rest") + F.pmod(F.xxhash64("node"), F.col("n_top"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("n_rest"))
    )
    last = F.when(in_top, F.col("n_rest") - 1).otherwise(F.col("n_rest") + F.col("n_top") - 1)
    met = live.join(blocks, "key").select(
        "key", "node", "root", home.alias("home"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("other")
    )
    part = F.xxhash64("key", F.least("home", "other"), F.greatest("home", "other"))
    return light.unionByName(met.select(part.alias("part"), "node", "root"))


_WORDS = PARITY_BITS // 64


def _sides(parts: DataFrame, *of_nodes: DataFrame) -> DataFrame:
    """The rows of each part together, by size, with what their nodes carry."""
    for table in of_nodes:
        parts = parts.join(table, "node")
    sig = [F.col("sig")[k].alias(f"s{k}") for k in range(_WORDS)]
    sides = parts.select(*[c for c in parts.columns if c != "sig"], *sig)
    return sides.repartition("key").sortWithinPartitions("key", "size")


def _bitmaps(cols: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([cols[f"s{k}"] for k in range(_WORDS)], axis=1).view(np.uint64)


def _pairs(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    x, y = node[x], node[y]
    pair = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def open_parts(parts: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``parts(key, node, root)`` whose sizes and bitmaps allow the similarity
    to another root's row of the part. All others are in no similar pair there."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _ in sorted_runs(batches):
            paired = np.zeros(len(cols["key"]), bool)

            def note(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                paired[a] = paired[b] = True
                return paired[a]

            _meetings(cols["key"], cols["size"], cols["root"], _bitmaps(cols), similarity, False, settled=note)
            if paired.any():
                names = ["key", "node", "root"]
                yield pa.RecordBatch.from_arrays([pa.array(cols[n][paired]) for n in names], names=names)

    return _sides(parts, sigs).mapInArrow(meet, "key bigint, node bigint, root bigint")


def verified_parts(
    parts: DataFrame, sigs: DataFrame, texts: DataFrame, shingle: int, similarity: float
) -> DataFrame:
    """Links ``(a, b)`` between similar nodes of different roots that meet in a part.

    ``parts`` has ``(key, node, root)``, ``texts`` each node's text. The links of a part
    span the groups that its similar pairs make and are fewer than its members; a pair
    that is not similar leaves no row.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _ in sorted_runs(batches):
            sets = _Sets(cols["text"], shingle)
            near = lambda i, j: _alike(sets[i], sets[j], similarity)
            x, y = _meetings(cols["key"], cols["size"], cols["root"], _bitmaps(cols), similarity, True, near)
            if len(x):
                yield _pairs(cols["node"], x, y)
        give_back()

    return _sides(parts, sigs, texts).mapInArrow(meet, "a bigint, b bigint").distinct()


def near_candidates(
    live: DataFrame, sigs: DataFrame, first: DataFrame, similarity: float, run_limit: int, first_shingles: int
) -> DataFrame:
    """Distinct pairs ``(a, b)`` of nodes of different roots that share a key and may be
    similar; ``live`` has ``(key, node, root)``, ``sigs`` each node's size and bitmap.
    ``first`` has each node's first keys: short texts that share one have been verified."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _ in sorted_runs(batches):
            keys = np.stack([cols[f"k{i}"] for i in range(FIRST_KEYS)], axis=1)
            short = cols["size"] <= first_shingles

            def settled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return short[a] & short[b] & _settled(keys, a, b)

            x, y = _meetings(
                cols["key"], cols["size"], cols["root"], _bitmaps(cols), similarity, False, settled=settled
            )
            if len(x):
                yield _pairs(cols["node"], x, y)
        give_back()

    parts = written(_spread(live, run_limit).withColumnRenamed("part", "key"), "parts")
    # A text with fewer first keys names one of them again.
    names = [F.coalesce(F.get("first", F.lit(i)), F.col("first")[0]).alias(f"k{i}") for i in range(FIRST_KEYS)]
    return _sides(parts, sigs, first.select("node", *names)).mapInArrow(meet, "a bigint, b bigint").distinct()


def _grams(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for body in binary(batch, "text"):
        yield np.unique(shingle_hashes(body, shingle))


def common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a hash sample have, and in how many; sorted.

    They only order the shingles of a set. Any order gives the same result, this one
    keeps frequent shingles from becoming keys.
    """
    share = min(1.0, SAMPLE_TEXTS / max(texts.count(), 1))
    ranges = 1 << 30
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(ranges)) < int(share * ranges)).select("text").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in _grams(batch, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], names=["gram"])

    counts = sample.mapInArrow(cut, "gram bigint").groupBy("gram").agg(F.count("*").alias("n")).where("n > 2")
    got = counts.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    grams, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def drop_near(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    run_limit: int = NEAR_LIMIT,
    first_shingles: int = FIRST_SHINGLES,
) -> DataFrame:
    """One document of each group of near texts, in the columns of ``docs``.

    Near are texts whose sets of ``shingle``-word shingles have at least the Jaccard
    ``similarity``; groups are connected. The smallest id stays (null counts as larger
    than any other). Equal texts are near; rows that repeat the id and text of the
    document that stays, stay too. Texts without words, null or empty, form one group.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0 and at most 1")
    sha, = fresh(docs, "sha")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    hashed = docs.withColumn(sha, F.sha2(body, 256))
    slim = hashed.select(F.col(doc_id).alias("id"), F.col(sha).alias("sha"), F.col(text).cast("string").alias("text"))
    shared_order = docs.sparkSession.sparkContext.broadcast(common_shingles(slim, shingle))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sig, wide, keys, prints = [], [], [], [], []
            for body in binary(batch, "text"):
                all_grams = shingle_hashes(body, shingle)
                grams = np.unique(all_grams)
                prints.append(_signed(majority(all_grams)))
                size.append(len(grams))
                sig.append(_parity(grams))
                wide.append(_wide_parity(grams))
                # Texts without words have one key of their own.
                keys.append(_prefix(grams, shared_order.value, similarity).view(np.int64) if len(grams) else np.zeros(1, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("sha"),
                    pa.array(size, pa.int64()),
                    pa.array(sig, pa.list_(pa.int64())),
                    pa.array(wide, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(prints, pa.int64()),
                ],
                names=["id", "sha", "size", "sig", "wide", "keys", "fp"],
            )
        give_back()

    kind = dict(slim.dtypes)["id"]
    signed = slim.mapInArrow(sign, f"id {kind}, sha string, size bigint, sig array<bigint>, wide binary, keys array<bigint>, fp bigint")
    texts = signed.groupBy("sha").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("size", "sig", "wide", "keys", "fp")]
    )
    nodes = written(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sigs = nodes.select("node", "size", "sig")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [g.view(np.int64) for g in _grams(batch, shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), pa.array(found, pa.list_(pa.int64()))], names=["sha", "grams"]
            )
        give_back()

    ratio = (1 - similarity) / (1 + similarity)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = ratio * (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) + 1e-9
            apart = [_wide_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("wa"), batch.column("wb"))]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, float) <= most))
        give_back()

    wide = lambda end: nodes.select(F.col("node").alias(end), F.col("size").alias(f"n{end}"), F.col("wide").alias(f"w{end}"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The stored pairs whose shingle sets are similar. The wide bitmaps come first:
        they spare most sets of long texts."""
        pairs = pairs.join(wide("a"), "a").join(wide("b"), "b").select("a", "b", "na", "nb", "wa", "wb")
        pairs = written(pairs.mapInArrow(possible, "a bigint, b bigint"), "possible")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        asked = written(nodes.select("node", "sha").join(ends, "node"), "asked")
        grams = (
            slim.join(small(asked.select("sha")), "sha", "left_semi")
            .select("sha", "text")
            .mapInArrow(sets, "sha string, grams array<bigint>")
        )
        grams = written(grams.join(small(asked), "sha").dropDuplicates(["node"]).select("node", "grams"), "grams")
        both = pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(
            grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b"
        )
        both = both.withColumn("common", F.size(F.array_intersect("ga", "gb")))
        union = F.size("ga") + F.size("gb") - F.col("common")
        alike = (union == 0) | (F.col("common") >= F.lit(similarity) * union)
        return written(both.where(alike).select("a", "b"), "alike")

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` whose sizes and bitmaps allow the similarity."""
        side = lambda end: sigs.select(F.col("node").alias(end), F.col("size").alias(f"n{end}"), F.col("sig").alias(f"s{end}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        apart = F.aggregate(
            F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
        )
        return both.where(
            (F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9)
            & (apart <= F.lit(ratio) * (F.col("na") + F.col("nb")) + 1e-9)
        ).select("a", "b")

    def pairs_of(ends: DataFrame) -> DataFrame:
        return ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    # First by fingerprint: texts of one fingerprint with its first text, and the first texts
    # of fingerprints that deletion variants link. A link per fingerprint, however large a group.
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    linked = near_links(firsts.select("fp"))
    end = lambda name, own: firsts.select(F.col("fp").alias(name), F.col("first").alias(own))
    across = linked.join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    within = nodes.join(firsts, "fp").select(F.col("node").alias("x"), F.col("first").alias("y"))
    links = verified(written(close(pairs_of(written(across.unionAll(within), "print-pairs"))), "pairs"))
    # What is left, exactly, by keys that several nodes have: the nodes at the ends of each key.
    # A node names a key once. Most keys have one node: those are counted and go no further.
    index = nodes.select("node", F.posexplode("keys").alias("place", "key"))
    several = written(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "several")
    shared = written(index.join(several, "key"), "shared")
    ends = written(shared.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")), "ends")
    # First one link of each node per key to either end, which gathers large groups by
    # a linear number of comparisons; of nodes that are still apart.
    roots = written(components(links), "roots")
    of = lambda name, own: roots.select(F.col("node").alias(name), F.col("root").alias(own))
    hubs = shared.where(F.col("place") < HUB_KEYS).join(ends, "key")
    hubs = hubs.select(F.col("node").alias("x"), F.explode(F.array("low", "high")).alias("y"))
    hubs = written(pairs_of(hubs), "hubs").join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left")
    hubs = hubs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    links = links.unionAll(verified(written(close(hubs), "pairs")))
    roots = written(components(links), "roots")
    # Then what is still apart. Short texts that share one of their first keys are verified
    # where they meet. First are the keys that most texts have: borderline texts of a group
    # share those, seldom the rare ones.
    in_order = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "key"))), 1, FIRST_KEYS)
    first = written(shared.groupBy("node").agg(in_order["key"].alias("first")), "first")
    rooted = lambda rows: written(
        rows.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "live"
    )
    brief = sigs.where(F.col("size") <= first_shingles).select("node")
    live = rooted(first.join(brief, "node").select("node", F.explode("first").alias("key")))
    parts = written(_spread(live, run_limit).withColumnRenamed("part", "key"), "parts")
    parts = written(open_parts(parts, sigs, similarity), "open-parts")
    asked = written(nodes.select("node", "sha").join(parts.select("node").distinct(), "node"), "asked")
    # Not stored: these rows lie by node already when the parts ask for them.
    bodies = slim.select("sha", "text").join(small(asked), "sha").groupBy("node")
    bodies = bodies.agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    links = links.unionAll(written(verified_parts(parts, sigs, bodies, shingle, similarity), "alike"))
    roots = written(components(links), "roots")
    # At last every other pair of different groups, so that none is lost.
    live = rooted(shared.select("key", "node"))
    pairs = written(near_candidates(live, sigs, first, similarity, run_limit, first_shingles), "pairs")
    if not pairs.isEmpty():
        links = links.unionAll(verified(pairs))
        roots = written(components(links), "roots")
    # Both sides of the join by group are stored, so that Spark can split large groups.
    grouped = written(nodes.select("node", "sha", "id").join(roots, "node"), "grouped")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("sha"))).alias("best"))
    best = written(best, "best")
    losers = written(
        grouped.join(best, "root").where(F.col("sha") != F.col("best.sha")).select(F.col("sha").alias(sha)), "losers"
    )
    # Of equal texts only the rows with the smallest id stay.
    lowest = slim.select("id", "sha")
    again = lowest.groupBy("sha").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1")
    again = written(again.select(F.col("sha").alias(sha), "low"), "again")
    low, = fresh(hashed, "low")
    kept = hashed.join(small(losers), sha, "left_anti").join(
        small(again.withColumnRenamed("low", low)), sha, "left"
    )
    first = F.col(low).isNull() | F.col(doc_id).eqNullSafe(F.col(low))
    return kept.where(first).select(*docs.columns)

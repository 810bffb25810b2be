"""Benchmark decontamination: find windows of test items inside training documents.

The windows of the test set form a hash set that is broadcast in blocks of at most
``block_windows`` windows, so no broadcast grows with the test set. Each document is
scanned as a whole. A hash hit is verified word by word before it counts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paroxys.llm.common import LOWER_BYTES, binary, fresh, give_back, spans_of, written

WINDOW = 10
BLOCK_WINDOWS = 1_000_000
#: Bytes that separate words: every ASCII byte that is neither digit nor lower-case letter.
_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = LOWER_BYTES.translate(bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS)))
_WORD = re.compile(rb"[^ ]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def item_windows(benchmark: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """Distinct ``(window, item)``: words joined by blanks, and the item id as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("item").to_pylist(), binary(batch, "text")):
                ws = words(body)
                if ws:
                    grams = {b" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}
                    yield pa.RecordBatch.from_pydict(
                        {"window": [g.decode() for g in grams], "item": [name] * len(grams)}
                    )

    rows = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"),
        F.col(text).cast("string").alias("text"),
    )
    return rows.mapInArrow(cut, "window string, item string").distinct()


class WindowSet:
    """Windows of one block: word numbers, rolling hashes by length, items by window."""

    def __init__(self, rows: list[tuple[str, str]]):
        items: dict[bytes, list[str]] = defaultdict(list)
        for window, item in rows:
            items[window.encode()].append(item)
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], list[str]]]] = defaultdict(list)
        for window, names in items.items():
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in window.split(b" ")]
            by_length[len(ids)].append((ids, names))
        self.lengths = []
        for length, entries in sorted(by_length.items()):
            matrix = np.array([ids for ids, _ in entries], dtype=np.uint64)
            for seed in range(1000):
                factors = np.random.default_rng([seed, length]).integers(
                    1, 2**63, length, dtype=np.uint64
                ) | np.uint64(1)
                hashes = (matrix * factors).sum(axis=1, dtype=np.uint64)
                if len(np.unique(hashes)) == len(hashes):
                    break
            order = np.argsort(hashes)
            names = [entries[i][1] for i in order]
            self.lengths.append((length, factors, hashes[order], matrix[order], names))

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word spans and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(0)), np.uint64, len(ws))
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        starts, ends, found = [], [], set()
        for length, factors, hashes, matrix, names in self.lengths:
            if len(ws) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            grams = ids[at[:, None] + np.arange(length)]
            place = np.searchsorted(hashes, (grams * factors).sum(axis=1, dtype=np.uint64))
            place[place == len(hashes)] = 0
            hit = (matrix[place] == grams).all(axis=1)
            starts.extend(at[hit].tolist())
            ends.extend((at[hit] + length).tolist())
            for window in np.unique(place[hit]):
                found.update(names[window])
        pairs = sorted(zip(starts, ends))
        return spans_of([a for a, _ in pairs], [b for _, b in pairs]), found


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` plus three under fresh names.

    The returned mapping names them: ``words`` (count), ``spans`` (hit word spans, half
    open, merged) and ``items`` (ids of the items with windows in the document). Null
    and empty texts have no words. Items without words have no window; a null item id
    reads as the empty string; rows sharing an item id are one item. Repeated documents
    are scanned row by row. An empty test set hits nothing.
    """
    spark = docs.sparkSession
    counted, spans, items = fresh(docs, "words", "spans", "items")
    windows = written(item_windows(benchmark, item, item_text, n), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    span_type = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    out = docs.select(
        "*",
        F.lit(None).cast("bigint").alias(counted),
        F.array().cast(span_type).alias(spans),
        F.array().cast("array<string>").alias(items),
    )
    for number in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == number)
        rows = [(r.window, r.item) for r in part.toLocalIterator()]
        shared = spark.sparkContext.broadcast(WindowSet(rows))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                n_words, all_spans, all_items = [], [], []
                earlier = zip(batch.column(spans).to_pylist(), batch.column(items).to_pylist())
                for body, (old_spans, old_items) in zip(binary(batch, text), earlier):
                    ws = words(body)
                    new, found = block.scan(ws)
                    joined = sorted([*((s["a"], s["b"]) for s in old_spans), *new])
                    merged = spans_of([a for a, _ in joined], [b for _, b in joined])
                    n_words.append(len(ws))
                    all_spans.append([{"a": a, "b": b} for a, b in merged])
                    all_items.append(sorted({*old_items, *found}))
                columns = {name: batch.column(name) for name in batch.schema.names}
                columns[counted] = pa.array(n_words, pa.int64())
                columns[spans] = pa.array(all_spans, batch.schema.field(spans).type)
                columns[items] = pa.array(all_items, batch.schema.field(items).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            give_back()

        out = out.mapInArrow(scan, out.schema)
        if number + 1 < blocks:
            out = written(out, "hits")
    return out, {"words": counted, "spans": spans, "items": items}


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in ``spans`` and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(_TABLE))]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, action: str = "drop", text: str = "text", **options
) -> DataFrame:
    """Documents without test passages, in the columns of ``docs``.

    ``action="drop"`` removes hit documents, ``"cut"`` only the hit words with what
    stands between them.
    """
    found, names = find_hits(docs, benchmark, text=text, **options)
    if action == "drop":
        return found.where(F.size(names["spans"]) == 0).select(*docs.columns)
    if action != "cut":
        raise ValueError("action is 'drop' or 'cut'")
    schema = found.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(names["spans"]).to_pylist()
            bodies = batch.column(text).to_pylist()
            new = [
                body
                if not marks
                else without_spans(body.encode(), [(s["a"], s["b"]) for s in marks]).decode()
                for body, marks in zip(bodies, spans)
            ]
            place = batch.schema.get_field_index(text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.column(text).type))

    return found.mapInArrow(cut, schema).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document row with the figures of its hits."""
    found, names = find_hits(docs.select(doc_id, options.get("text", "text")), benchmark, **options)
    hit = F.aggregate(names["spans"], F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        F.col(doc_id).alias("doc_id"),
        F.col(names["words"]).alias("n_words"),
        hit.alias("n_hit"),
        F.size(names["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.col(names["spans"]).alias("word_spans"),
    )

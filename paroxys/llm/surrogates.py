"""Keyed surrogates for personal data.

Entities are e-mail addresses, phone numbers, IPv4 addresses, card-like numbers and
names. Every distinct entity gets one surrogate for the whole corpus, drawn from a keyed
hash: letters become letters of the same script and case, digits digits, punctuation
stays. First names change within their gender and script, surnames keep title, script
and case. The same entity in another notation (phone punctuation, letter case) gets the
same surrogate in that notation, so references stay joined.

Surrogates of different entities must differ, and none may be a real entity. The table
of distinct entities is checked for both by joins, and those that lose draw again until
none is left. From the ninth draw on a surrogate may be longer, so draws do not run out.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import small, written

MAX_ROUNDS = 60
# First names by script and gender, titles by gender, letters by script.
FIRST_NAMES = {
    "latin f": "Anna Maria Julia Laura Sofia Clara Elena Sarah Emma Lucia Marie Ingrid".split(),
    "latin m": "John Peter Thomas Daniel Carlos Pierre Hans Miguel David Robert Paul Luis".split(),
    "cyrillic f": "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана".split(),
    "cyrillic m": "Иван Пётр Сергей Дмитрий Андрей Алексей Николай Михаил".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Señora Madame".split(), "m": "Mr Herr Señor Monsieur".split()}
LETTERS = {
    "latin": ("bcdfghjklmnprstvz", "aeiou"),
    "cyrillic": ("бвгдзклмнпрстфх", "аеиоу"),
    "greek": ("βγδζκλμνπρστφχ", "αειου"),
}
_GROUP_OF = {name: group for group, names in FIRST_NAMES.items() for name in names}
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_NUMBER = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(?\d(?:[ .()\-]{0,2}\d){6,18}(?![\w])")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_SURNAME = r"[^\W\d_a-zа-яß-ÿ][^\W\d_]+"
_NAME = re.compile(
    rf"\b(?:(?P<title>{'|'.join(t for ts in TITLES.values() for t in ts)})\.? (?:(?P<mid>{'|'.join(_GROUP_OF)}) )?(?P<last>{_SURNAME})"
    rf"|(?P<first>{'|'.join(_GROUP_OF)})\b(?: (?P<sur>{_SURNAME}))?)"
)


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical form)`` in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    found += [(m.start(), m.end(), "ip", m[0]) for m in _IP.finditer(text)]
    for m in _NUMBER.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if _IP.fullmatch(m[0]):
            continue
        if m[0].isdigit():
            if len(digits) >= 13:
                found.append((m.start(), m.end(), "card", digits))
        elif re.search(r"[()+\- ]", m[0]) and 8 <= len(digits) <= 15:
            found.append((m.start(), m.end(), "phone", digits))
        elif len(digits) >= 13:
            found.append((m.start(), m.end(), "card", digits))
    for m in _NAME.finditer(text):
        for part in ("mid", "first"):
            if m[part]:
                found.append((*m.span(part), "first name", m[part]))
        for part in ("last", "sur"):
            if m[part]:
                found.append((*m.span(part), "surname", m[part].lower()))
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[tuple[int, int, str, str]] = []
    for entity in found:
        if not out or entity[0] >= out[-1][1]:
            out.append(entity)
    return out


def _stream(key: bytes, kind: str, canonical: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        message = f"{kind}\0{canonical}\0{attempt}\0{block}".encode()
        yield from hmac.new(key, message, hashlib.sha256).digest()
        block += 1


def _script(letter: str) -> str:
    code = ord(letter)
    return "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 else "latin"


def _letters(source: str, draw: Iterator[int]) -> str:
    out = []
    for n, c in enumerate(source):
        if c.isalpha():
            consonants, vowels = LETTERS[_script(c)]
            pool = vowels if n % 2 else consonants
            new = pool[next(draw) % len(pool)]
            out.append(new.upper() if c.isupper() else new)
        elif c.isdigit():
            out.append(str(next(draw) % 10))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical form of the attempt's surrogate."""
    draw = _stream(key, kind, canonical, attempt)
    extra = max(0, attempt - 7)
    if kind == "first name":
        # A keyed rotation of the own list: one to one, and nobody keeps the name.
        names = FIRST_NAMES[_GROUP_OF[canonical]]
        turn = next(_stream(key, kind, _GROUP_OF[canonical], 0)) % (len(names) - 1) + 1
        return names[(names.index(canonical) + turn) % len(names)]
    if kind == "email":
        local, _, domain = canonical.partition("@")
        rest, _, top = domain.rpartition(".")
        return f"{_letters(local + 'a' * extra, draw)}@{_letters(rest, draw)}.{top}"
    if kind == "ip":
        octets = []
        for octet in canonical.split("."):
            size = 3 if extra else len(octet)
            low, high = (1, 10, 100)[size - 1], (9, 99, 254)[size - 1]
            octets.append(str(low + (next(draw) * 256 + next(draw)) % (high - low + 1)))
        return ".".join(octets)
    if kind == "surname":
        return _letters(canonical + canonical[-1] * extra, draw)
    digits = canonical[0] + "".join(str(next(draw) % 10) for _ in range(len(canonical) - 1 + extra))
    if kind == "card" and _luhn(canonical) == 0:
        digits = next(digits[:-1] + str(d) for d in range(10) if _luhn(digits[:-1] + str(d)) == 0)
    return digits


def render(original: str, kind: str, new: str) -> str:
    """The surrogate in the original's notation: punctuation and letter case."""
    if kind in ("phone", "card"):
        left = iter(new)
        out = "".join(next(left) if c.isdigit() else c for c in original)
        return out + "".join(left)
    if kind in ("email", "surname"):
        if original.isupper() and len(original) > 1:
            return new.upper()
        return new[:1].upper() + new[1:] if original[:1].isupper() else new
    return new


def _entities(rows: DataFrame) -> DataFrame:
    """``(id, h, kind, canonical, n)`` of each row's distinct entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, names, counts = [], [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                own: dict[tuple[str, str], int] = {}
                for _, _, kind, canonical in find_entities(text or ""):
                    own[kind, canonical] = own.get((kind, canonical), 0) + 1
                for (kind, canonical), times in own.items():
                    at.append(n)
                    kinds.append(kind)
                    names.append(canonical)
                    counts.append(times)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(where), batch.column("h").take(where), pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                names=["id", "h", "kind", "canonical", "n"],
            )

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, h bigint, kind string, canonical string, n bigint")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """``(kind, canonical, new)`` for distinct ``entities``, checked for collisions.

    Of entities that draw the same surrogate the one with the smallest canonical form
    has it. Fails if some are still without a surrogate after ``MAX_ROUNDS`` draws.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(
                new=[surrogate(key, *row) for row in batch[["kind", "canonical", "attempt"]].itertuples(index=False)]
            )

    schema = "kind string, canonical string, attempt int, new string"
    real = entities.select("kind", F.col("canonical").alias("new"))
    pending = entities.select("kind", "canonical", F.lit(0).alias("attempt"))
    done = None
    for _ in range(MAX_ROUNDS):
        drawn = written(pending.select("kind", "canonical", "attempt").mapInPandas(draw, schema), "drawn")
        # First names swap within their list: real names on purpose, never the same one.
        free = drawn.where("kind <> 'first name'").join(real, ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new"), ["kind", "new"], "left_anti")
        first = free.groupBy("kind", "new").agg(F.min("canonical").alias("canonical"))
        names = drawn.where("kind = 'first name'").select("kind", "new", "canonical")
        won = written(first.unionByName(names).select("kind", "canonical", "new"), "won")
        done = won if done is None else written(done.unionAll(won), "done")
        pending = written(
            drawn.join(won, ["kind", "canonical"], "left_anti").select("kind", "canonical", F.col("attempt") + 1).toDF("kind", "canonical", "attempt"),
            "pending",
        )
        if pending.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} draws")


def replace(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text, n_entities, kinds)`` of every row with surrogates in the text.

    ``kinds`` maps each kind found to its number of mentions. A null text stays null and
    has none. Repeated rows and equal entities in any row get equal surrogates; null ids
    are allowed. An empty table stays empty. Extra columns are not carried.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    found = written(_entities(base), "mentions")
    table = assign(found.select("kind", "canonical").distinct(), key)
    named = found.distinct().join(table, ["kind", "canonical"])
    own = named.groupBy("id", "h").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "canonical"), "new"))).alias("table")
    )
    own = written(own.withColumnsRenamed({"id": "own_id", "h": "own_h"}), "own")
    joined = base.join(
        small(own, 200_000), F.col("id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h")), "left"
    ).select("id", "text", "table")
    kind = dict(base.dtypes)["id"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers, kinds = [], [], []
            for body, entries in zip(batch.column("text").to_pylist(), batch.column("table").to_pylist()):
                counts: dict[str, int] = {}
                if entries:
                    new, out, last = dict(entries), [], 0
                    for a, b, what, canonical in find_entities(body):
                        out += [body[last:a], render(body[a:b], what, new[f"{what}\0{canonical}"])]
                        counts[what] = counts.get(what, 0) + 1
                        last = b
                    body = "".join([*out, body[last:]])
                texts.append(body)
                numbers.append(sum(counts.values()))
                kinds.append(sorted(counts.items()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array(numbers, pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int64()))],
                names=["doc_id", "text", "n_entities", "kinds"],
            )

    return joined.mapInArrow(apply, f"doc_id {kind}, text string, n_entities bigint, kinds map<string,bigint>")

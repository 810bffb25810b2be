"""Quality rules as weak supervision: vote or abstain, learn accuracies, keep by posterior.

Each rule looks at one trait of a text and votes good, votes bad or abstains. No rule
decides alone: expectation-maximisation over all documents estimates how often each rule
is right on good and on bad texts, and how many texts are good, without any label. The
posterior probability of good, given the votes, then stands in for the usual test that
all rules must pass.

One pass over the texts makes whole numbers per document; the votes are expressions over
them. Documents with the same votes have the same posterior, so the estimation needs only
the number of documents per vote pattern, at most ``3 ** len(RULES)`` rows at any size of
the table. Those go to the driver; the posteriors come back as a table of the same bound.

An abstaining rule says nothing about a text: only cast votes enter the likelihood, so a
short text is not bad for the rules that cannot judge it.

Defined results: a null text has no words. Rows that share an id are separate documents,
all counted. If no rule votes, the posterior is the estimated share of good texts. An
empty table gives an empty result. A text must fit one task with its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import binary, fresh, give_back, written

#: Words of a window whose return inside a text counts as repetition.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Rounds of the estimation, and what a rule is believed to be before it is seen:
#: right four times of five.
ROUNDS = 100
HITS, MISSES = 4.0, 1.0
THRESHOLD = 0.5

#: Whole numbers taken from a text.
FIGURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letters",
    "n_capitals",
    "n_echoes",
    "n_top",
)

#: Rule -> (votes bad, votes good), over the figures, in SQL that all engines share.
#: Shares are in percent, so that everything stays in whole numbers.
RULES: Mapping[str, tuple[str, str]] = {
    "symbols": ("100 * n_symbols > 10 * n_words", "n_words > 0 and 100 * n_symbols <= n_words"),
    "letters": ("100 * n_letters < 70 * word_chars", "n_words > 0 and 100 * n_letters >= 90 * word_chars"),
    "capitals": ("100 * n_capitals > 30 * n_letters", "n_letters > 0 and 100 * n_capitals <= 10 * n_letters"),
    "lines": ("n_dup_lines >= 2 and 100 * n_dup_lines > 30 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    "passages": ("100 * n_repeat_words > 20 * n_words", "n_words >= 20 and n_repeat_words = 0"),
    "echoes": ("100 * n_echoes > 20 * n_words", "n_words >= 20 and 100 * n_echoes <= 2 * n_words"),
    "top_word": ("n_words >= 20 and 100 * n_top > 30 * n_words", "n_words >= 20 and 100 * n_top <= 12 * n_words"),
    "word_length": (
        "word_chars < 2 * n_words or word_chars > 12 * n_words",
        "n_words > 0 and word_chars >= 3 * n_words and word_chars <= 8 * n_words",
    ),
}
#: Texts that no posterior can save.
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"

_SPACES = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(0x41, 0x5B))
#: ASCII bytes that are no letters; what is left, continuation bytes aside, counts as one.
_NO_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha())


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a window that occurs twice or more; ``ids`` numbers the words."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # Equal windows have equal sums: most texts end here.
    mixed = np.zeros(n, np.uint64)
    spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    for k in range(window):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + spread[k : n + k]
        mixed ^= mixed >> np.uint64(29)
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0
    # Exactly: number the windows by their two halves, again and again.
    names, width = ids.astype(np.int64), 1
    while width < window:
        step = min(width, window - width)
        left, right = names[: len(names) - step], names[step:]
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        width += step
    often = np.bincount(names)[names] > 1
    change = np.zeros(len(ids) + 1, np.int64)
    change[:n] += often
    change[window : n + window] -= often
    return int((np.cumsum(change) > 0).sum())


def figures_of(text: bytes) -> tuple[int, ...]:
    """The ``FIGURES`` of one text."""
    words = text.split()
    if not words:
        return (0,) * len(FIGURES)
    code: dict[bytes, int] = {}
    ids = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    solid = text.translate(None, _SPACES + _CONTINUED)
    letters = solid.translate(None, _NO_LETTERS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(solid),
        len(solid) - len(solid.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids),
        len(lines),
        len(letters),
        len(letters) - len(letters.translate(None, _CAPITALS)),
        int((ids[1:] == ids[:-1]).sum()),
        int(np.bincount(ids).max()),
    )


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of ``docs`` (all by default) and the figures, under fresh names."""
    keep = tuple(docs.columns) if keep is None else keep
    (body, *own) = fresh(docs, "body", *FIGURES)
    rows = docs.select(*keep, F.col(text).cast("string").alias(body))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"`{c}` bigint" for c in own]])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([figures_of(t) for t in binary(batch, body)], np.int64).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(c) for c in found.T.copy()]], [*keep, *own]
            )
        give_back()

    return rows.mapInArrow(look, schema), dict(zip(FIGURES, own))


def votes(rules: Mapping[str, tuple[str, str]] = RULES) -> Column:
    """The votes as one number: a digit per rule, 0 for bad, 1 for abstaining, 2 for good."""
    code = F.lit(0)
    for bad, good in rules.values():
        digit = F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1)
        code = code * 3 + digit
    return code.cast("int")


def digits(pattern: np.ndarray, rules: int) -> np.ndarray:
    """Votes of each pattern, -1, 0 or 1, one column per rule."""
    powers = 3 ** np.arange(rules - 1, -1, -1)
    return pattern[:, None] // powers % 3 - 1


class Model:
    """What the estimation found: the share of good texts, and for each rule how often its
    votes are right on good and on bad texts."""

    def __init__(self, good: float, right_on_good: np.ndarray, right_on_bad: np.ndarray) -> None:
        self.good, self.right_on_good, self.right_on_bad = good, right_on_good, right_on_bad

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        up, down = cast > 0, cast < 0
        odds = math.log(self.good / (1 - self.good)) + (
            up @ np.log(self.right_on_good / (1 - self.right_on_bad))
            + down @ np.log((1 - self.right_on_good) / self.right_on_bad)
        )
        return 1 / (1 + np.exp(-odds))


def estimate(cast: np.ndarray, times: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over vote patterns that occur ``times``.

    The first posterior is the share of good among the cast votes and a neutral one.
    """
    times = times.astype(np.float64)
    up, down = (cast > 0).astype(float), (cast < 0).astype(float)
    quality = (up.sum(1) + 0.5) / (up.sum(1) + down.sum(1) + 1)
    model = None
    for _ in range(rounds):
        good, bad = times * quality, times * (1 - quality)
        model = Model(
            float((good.sum() + 1) / (times.sum() + 2)),
            (good @ up + HITS) / (good @ (up + down) + HITS + MISSES),
            (bad @ down + HITS) / (bad @ (up + down) + HITS + MISSES),
        )
        quality = model.posterior(cast)
    return model


def score(
    docs: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    rules: Mapping[str, tuple[str, str]] = RULES,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, dict[str, str], Model | None]:
    """The columns ``keep`` (all by default) with figures, ``quality``, ``base_failed`` and
    ``kept``, the names of the new columns, and the model."""
    rows, names = measure(docs, text, keep)
    pattern, quality, failed, kept, code, chance = fresh(
        rows, "pattern", "quality", "base_failed", "kept", "code", "chance"
    )
    # Rules speak of figures by plain names; columns of the table may bear the same ones.
    columns = [c for c in rows.columns if c not in names.values()]
    carried = F.struct(*[F.col(c) for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
    plain = rows.select(carried.alias("carried_columns"), *[F.col(own).alias(name) for name, own in names.items()])
    judged = plain.withColumns({pattern: votes(rules), failed: F.expr(BASE_FAILED)})
    stored = written(judged, "figures")
    counted = stored.groupBy(pattern).agg(F.count("*").alias("n")).orderBy(pattern).collect()
    model, found = None, []
    if counted:
        cast = digits(np.array([r[0] for r in counted]), len(rules))
        model = estimate(cast, np.array([r[1] for r in counted]), rounds)
        found = [(r[0], float(p)) for r, p in zip(counted, model.posterior(cast))]
    # One row per vote pattern that occurs.
    chances = docs.sparkSession.createDataFrame(found, f"`{code}` int, `{chance}` double")
    result = (
        stored.join(F.broadcast(chances), F.col(pattern) == F.col(code))
        .select(
            *[F.col("carried_columns")[c].alias(c) for c in columns],
            *[F.col(name).alias(own) for name, own in names.items()],
            F.col(chance).alias(quality),
            F.col(failed),
            (~F.col(failed) & (F.col(chance) >= threshold)).alias(kept),
        )
    )
    return result, {**names, "quality": quality, "base_failed": failed, "kept": kept}, model


def filter_quality(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, in its columns."""
    rows, names, _ = score(docs, text, **options)
    return rows.where(names["kept"]).select(*docs.columns)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: figures, base verdict, posterior and verdict."""
    rows, names, _ = score(docs, text, (doc_id,), **options)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        F.col(doc_id).alias("doc_id"),
        *[F.col(names[c]).alias(c) for c in base],
        F.col(names["base_failed"]).alias("base_failed"),
        F.col(names["kept"]).alias("kept"),
        F.round(names["quality"], 6).alias("quality"),
    )

"""Language identification with error-correcting output codes.

Every language has a codeword; each bit of it is predicted by a binary n-gram
classifier (hashed byte bigrams and trigrams, log odds between the languages on the two
sides of the bit). Decoding weighs the loss of each bit by how far that bit was better
than chance on the training rows, and chooses the codeword with the smallest loss. When
the runner-up is nearly as close, the document is flagged as ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paroxys.llm.common import LOWER_BYTES, binary, fresh, give_back

DIMS = 1 << 14
#: Labelled rows the classifiers are fitted on, at most about this many.
FIT_ROWS = 20_000
#: Ambiguous below this difference of the two best decoding probabilities.
MIN_GAP = 0.2
#: Margins are means over n-grams; the factor that turns them into logistic losses.
SCALE = 8.0
UNDETERMINED = "und"
SLICE = 1 << 21
_NOT_LETTERS = bytes(b for b in range(0x80) if not chr(b).isalpha())
_TABLE = LOWER_BYTES.translate(bytes.maketrans(_NOT_LETTERS, b" " * len(_NOT_LETTERS)))
_LETTER = re.compile(rb"[A-Za-z]")
_SHIFT = np.uint32(32 - (DIMS.bit_length() - 1))


def has_letter(text: bytes) -> bool:
    if _LETTER.search(text):
        return True
    if text.isascii():
        return False
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def gram_counts(text: bytes) -> np.ndarray:
    """How often each hashed bigram and trigram occurs in the whole text."""
    total = np.zeros(DIMS)
    squeezed = b" " + b" ".join(text.translate(_TABLE).split()) + b" "
    raw = np.frombuffer(squeezed, np.uint8)
    for begin in range(0, max(len(raw) - 1, 0), SLICE):
        part = raw[begin : begin + SLICE + 2].astype(np.uint32)
        two = (part[:-1] << np.uint32(8)) | part[1:]
        three = (two[:-1] << np.uint32(8)) | part[2:]
        last = begin + SLICE + 2 >= len(raw)
        two = two if last else two[:SLICE]
        both = np.concatenate([two * np.uint32(0x9E3779B1), (three ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B)])
        total += np.bincount(both >> _SHIFT, minlength=DIMS)
    return total


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +1/-1 per language: all splits up to five languages, else random ones.

    Random codes have about ten bits per doubling of the number of languages; of several
    draws the one with the largest smallest distance is taken.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        rest = range(1, n)
        ones = [set(c) | {0} for k in range(n - 1) for c in combinations(rest, k)]
        return np.array([[1 if i in s else -1 for s in ones] for i in range(n)], np.int8)
    rng = np.random.default_rng(seed)
    bits = int(10 * np.ceil(np.log2(n)))
    best, best_distance = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if apart > best_distance:
            best, best_distance = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    def margins(self, text: bytes) -> np.ndarray:
        counts = gram_counts(text)
        return counts @ self.weights / max(counts.sum(), 1.0)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, probability of its codeword, and whether the choice is ambiguous."""
        loss = np.log1p(np.exp(-SCALE * self.code * margins)) @ self.bit_weights
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        gap = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)
        return self.languages[order[0]], float(p[order[0]]), bool(gap < MIN_GAP)


def fit(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    fit_rows: int = FIT_ROWS,
    seed: int = 42,
) -> Model:
    """Fit on a hash sample of about ``fit_rows`` labelled rows (all, if there are fewer).

    Rows without text or label are not used. The driver receives one count per language
    and hashed n-gram, a size that does not depend on the number of rows.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    share = min(1.0, fit_rows / max(rows.select("lang").count(), 1))
    ranges = 1 << 30
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(ranges)) < int(share * ranges))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), binary(batch, "text")):
                if has_letter(body):
                    sums[name] = sums.get(name, 0) + gram_counts(body)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "gram": at, "n": total[at]})

    grams = (
        sample.select("lang", "text")
        .mapInArrow(count, "lang string, gram bigint, n double")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    languages = sorted(grams["lang"].unique())
    shares = np.ones((len(languages), DIMS))
    place = {name: i for i, name in enumerate(languages)}
    np.add.at(shares, (grams["lang"].map(place).to_numpy(int), grams["gram"].to_numpy(int)), grams["n"].to_numpy())
    shares /= shares.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((DIMS, code.shape[1]))
    for b in range(code.shape[1]):
        yes, no = shares[code[:, b] > 0], shares[code[:, b] < 0]
        if len(yes) and len(no):
            weights[:, b] = np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0))
    model = Model(languages, code, weights, np.ones(code.shape[1]))
    if len(languages) > 1:
        model.bit_weights = _bit_weights(sample, model)
    return model


def _bit_weights(sample: DataFrame, model: Model) -> np.ndarray:
    """Log odds of a right bit on the training sample, scaled to a mean of one."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        row = {name: i for i, name in enumerate(own.languages)}
        n, right = 0, np.zeros(own.code.shape[1])
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), binary(batch, "text")):
                if name in row and has_letter(body):
                    n += 1
                    right += own.code[row[name]] * own.margins(body) > 0
        yield pa.RecordBatch.from_pydict(
            {"bit": list(range(len(right))), "n": [float(n)] * len(right), "ok": right}
        )

    got = (
        sample.select("lang", "text")
        .mapInArrow(judge, "bit bigint, n double, ok double")
        .groupBy("bit")
        .agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))
        .orderBy("bit")
        .toPandas()
    )
    right = (got["ok"].to_numpy() + 1) / (got["n"].to_numpy() + 2)
    odds = np.maximum(np.log(right / (1 - right)), 0.01)
    return odds / odds.mean()


def predict(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` plus ``lang``, ``score`` and ``ambiguous`` under fresh names.

    A null text and one without any letter get ``und`` with score 0, not ambiguous; so
    does every text if nothing was learned. The score is the probability of the chosen
    codeword.
    """
    lang, score, doubt = fresh(docs, "lang", "score", "ambiguous")
    base = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score), F.lit(False).alias(doubt))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [
                own.decode(own.margins(body)) if own.languages and has_letter(body) else (UNDETERMINED, 0.0, False)
                for body in binary(batch, text)
            ]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[lang] = pa.array([f[0] for f in found], batch.schema.field(lang).type)
            columns[score] = pa.array([f[1] for f in found], pa.float64())
            columns[doubt] = pa.array([f[2] for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        give_back()

    return base.mapInArrow(run, base.schema), {"lang": lang, "score": score, "ambiguous": doubt}

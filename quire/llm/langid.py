"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import binary_rows, slices

#: Bins that byte 3-grams are hashed to.
BINS = 1 << 14
#: Labelled rows per language, about, that the classifiers are fitted on; everything else covers all rows.
SAMPLE_PER_LANGUAGE = 200
#: Languages that may be learned.
MOST_LANGUAGES = 500
#: A decision is ambiguous if the codeword next to the chosen one is closer than this probability to it.
AMBIGUOUS_BELOW = 0.2
UNKNOWN = "und"
#: Positions that are scored at a time.
STEP = 1 << 20

# ASCII letters fold to lower case, everything else of ASCII to a space; other bytes stay
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = 32
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def _bins(data: np.ndarray) -> np.ndarray:
    """Bin of the 3-gram that starts at each position; -1 where it holds two spaces in a row or does not fit."""
    b = FOLD[data]
    found = np.full(len(b), -1, np.int32)
    if len(b) >= 3:
        x, y, z = b[:-2].astype(np.uint32), b[1:-1].astype(np.uint32), b[2:].astype(np.uint32)
        codes = ((x << 16 | y << 8 | z) * np.uint32(2654435761)) >> np.uint32(32 - 14)
        found[:-2] = np.where((y == 32) & ((x == 32) | (z == 32)), -1, codes.astype(np.int32))
    return found


@dataclass
class Model:
    """Languages, their codewords (+1 and -1), and one linear classifier per bit with its weight in decoding."""

    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bins x bits
    bias: np.ndarray
    trust: np.ndarray


def codewords(n: int) -> np.ndarray:
    """n codewords: all splits of up to seven languages, else random splits that lie far apart."""
    if n <= 7:
        bits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(bits, float).T.reshape(n, -1)
    rng = np.random.default_rng(1)
    length = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(50):
        code = np.where(rng.random((n, length)) < 0.5, -1.0, 1.0)
        apart = int(((length - code @ code.T) / 2 + np.eye(n) * length).min())
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of about ``per_language`` rows of each language, chosen by a hash of their id.

    Rows with a null text, language or id teach nothing. The sample is bounded by the parameter times the number
    of languages, whatever the size of the table; only the counts of its n-grams reach the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull())
    totals = rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r[lang] for r in totals)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BINS, 0), np.float32), np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for r in totals for x in (r[lang], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text", STEP):
                out = []
                for data in some.column("_text").to_pylist():
                    bins = _bins(np.frombuffer(b" " + data + b" ", np.uint8))
                    out.append(np.bincount(bins[bins >= 0], minlength=BINS).astype("<f4"))
                yield pa.RecordBatch.from_arrays([some.column("lang"), pa.array([(x / max(1, x.sum())).astype("<f2").tobytes() for x in out], pa.binary())], ["lang", "x"])

    found = sample.mapInArrow(count, "lang string, x binary").toPandas()
    order = found.sort_values(["lang", "x"]).index  # the rows come in any order
    x = np.zeros((len(found), BINS), np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(found.at[i, "x"], "<f2")
    y = np.array([languages.index(v) for v in found["lang"][order]], np.int64)
    del found
    return _train(x, y, languages)


def _train(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Ridge regression towards the bits of the codewords, solved through the small matrix of inner products."""
    code = codewords(len(languages))
    if not code.shape[1] or not len(x):
        return Model(languages, code, np.zeros((BINS, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.zeros(code.shape[1]))
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= scale
    z = x
    balance = 1 / np.bincount(y, minlength=len(languages))[y]
    mean = (balance @ z / balance.sum()).astype(np.float32)
    z -= mean
    target = code[y]
    middle = (balance[:, None] * target).sum(axis=0) / balance.sum()
    kernel = (z @ z.T).astype(np.float64)
    ridge = 0.05 * np.trace(kernel) / len(z) * np.diag(1 / (balance / balance.mean()))
    dual = np.linalg.solve(kernel + ridge, target - middle)
    weights = (z.T @ dual) * scale[:, None]
    bias = middle - (mean / scale) @ weights * 1.0
    margin = (kernel @ dual + middle) * target
    trust = np.clip((balance[:, None] * (margin > 0)).sum(axis=0) / balance.sum() - 0.5, 0.01, None)
    return Model(languages, code, weights.astype(np.float32), bias, trust / trust.sum())


def decode(model: Model, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its probability, and whether another one is about as near."""
    k = len(model.languages)
    if k == 1 or not outputs.shape[1]:
        return np.zeros(len(outputs), np.int64), np.ones(len(outputs)), np.zeros(len(outputs), bool)
    agreement = outputs[:, None, :] * model.code[None]
    loss = (model.trust * np.log1p(np.exp(-4 * np.clip(agreement, -8, 8)))).sum(axis=2)
    p = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    ranked = np.sort(p, axis=1)
    return p.argmax(axis=1), p.max(axis=1), ranked[:, -1] - ranked[:, -2] < AMBIGUOUS_BELOW


def identify(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` for every row, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language was learned.
    All columns of ``rows`` stay. No shuffle takes place: the model (bins times bits) travels with the tasks.
    """
    names = rows.columns
    inner = rows.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`").cast("binary")).alias("_text"))
    schema = ", ".join(f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields)) + ", lang_pred string, score double, ambiguous boolean"
    table = np.vstack([model.weights, np.zeros((1, model.weights.shape[1]), np.float32)])  # bin -1 adds nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "_text"):
                column = some.column("_text")
                data, ends = binary_rows(column)
                sums, used = np.zeros((len(column), table.shape[1])), np.zeros(len(column))
                lengths = np.diff(ends)
                for lo in range(int(ends[0]), int(ends[-1]), STEP):
                    hi = min(lo + STEP, int(ends[-1]))
                    bins = _bins(data[lo : min(hi + 2, len(data))])[: hi - lo]
                    first, last = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, hi, "left")
                    for back in (1, 2):  # 3-grams do not cross from one text to the next
                        cut = ends[first + 1 : last + 1] - back - lo
                        bins[cut[(cut >= 0) & (cut < len(bins))]] = -1
                    rows_here = np.arange(first, last)[lengths[first:last] > 0]
                    starts = np.maximum(ends[rows_here] - lo, 0)
                    for bit in range(table.shape[1]):
                        sums[rows_here, bit] += np.add.reduceat(table[bins, bit], starts)
                    used[rows_here] += np.add.reduceat(bins >= 0, starts, dtype=np.int64)
                outputs = sums / np.maximum(used, 1)[:, None] + model.bias
                known = np.asarray(column.is_valid()) & bool(model.languages)
                if model.languages:
                    best, p, close = decode(model, outputs)
                    pred = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                else:
                    pred, p, close = np.full(len(column), UNKNOWN, object), np.zeros(len(column)), np.zeros(len(column), bool)
                new = [pa.array(pred, pa.string()), pa.array(np.where(known, p, 0.0)), pa.array(close & known)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *new], [*some.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    found = inner.mapInArrow(run, schema)
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(names) if c not in ("lang_pred", "score", "ambiguous")]
    return found.select(*kept, "lang_pred", "score", "ambiguous")

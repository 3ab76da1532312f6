"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of lower-cased text for each language over a bounded sample of labelled rows; the matrix of
log-probabilities (languages x buckets, bounded by both) is broadcast, and batches of whole texts are scored in numpy
by gathering and segment-summing.

Null text and text without a letter get ``und`` and score 0; ties go to the alphabetically first language; rows with a
null language are never learned; without a single labelled row all is ``und``; repeated rows are predicted each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
ORDERS = (2, 3)
BUCKETS = 1 << 15
#: Labelled rows of each language that training expects to read (a hash decides; fewer if there are fewer).
TRAIN_DOCS = 1500
#: Texts are worked on in runs of about so many code points.
RUN = 1 << 20
#: n-grams as good as independent: longer texts' log-likelihoods are scaled down to this many for the score.
INDEPENDENT = 40
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram at each place of an array of code points."""
    h = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint32)
    for i in range(n):
        h += codes[i : len(codes) - n + 1 + i] * _MULTIPLIERS[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], str]]:
    """(numbers of texts, their concatenation) of about RUN code points; a longer text comes in overlapping parts."""
    numbers, parts, held = [], [], 0
    for i, text in enumerate(texts):
        if text is None:
            continue
        for at in range(0, max(len(text), 1), RUN):
            part = text[at : at + RUN + max(ORDERS) - 1]
            numbers.append(i)
            parts.append(part)
            held += len(part)
            if held >= RUN:
                yield numbers, parts
                numbers, parts, held = [], [], 0
    if numbers:
        yield numbers, parts


def _segments(parts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a run, and for the parts that have any: their number and where theirs begin and end."""
    codes = [code_points(p) for p in parts]
    ends = np.cumsum([len(c) for c in codes])
    starts = ends - np.array([len(c) for c in codes])
    have = np.flatnonzero(ends - starts >= n)
    bounds = np.stack([starts[have], ends[have] - n + 1], axis=1).ravel()
    return hashed(np.concatenate(codes), n) if len(have) else np.zeros(0, np.int32), have, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS, dtype=np.int64))
            for _, parts in _runs([text]):
                for k, n in enumerate(ORDERS):
                    own[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(hashed(code_points(parts[0]), n), minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [orders * buckets, languages] float32), add-half smoothed."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(6)).alias("h")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((len(ORDERS) * BUCKETS, 0), np.float32)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(min(1.0, train_docs / n) * 2**20)))])
    sample = rows.filter(F.pmod("h", F.lit(2**20)) < F.element_at(share, F.col("lang"))).select("lang", "text")
    summed = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(summed.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(ORDERS) * BUCKETS, len(langs)))
    counts[summed.column("bucket").to_numpy(), [number[x] for x in summed.column("lang").to_pylist()]] = summed.column("n").to_numpy()
    logs = np.empty_like(counts, dtype=np.float32)
    for k in range(len(ORDERS)):
        part = counts[k * BUCKETS : (k + 1) * BUCKETS] + 0.5
        logs[k * BUCKETS : (k + 1) * BUCKETS] = np.log(part / part.sum(axis=0))
    return langs, logs


def score(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], list[float]]:
    """Predicted language and its posterior of each text."""
    total, grams = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
    columns = [[np.ascontiguousarray(logs[k * BUCKETS : (k + 1) * BUCKETS, j]) for j in range(len(langs))] for k in range(len(ORDERS))]
    for numbers, parts in _runs(texts):
        numbers = np.array(numbers)
        for k, n in enumerate(ORDERS):
            buckets, have, bounds = _segments(parts, n)
            if not len(have):
                continue
            inside = bounds[:-1] if bounds[-1] >= len(buckets) else bounds
            np.add.at(grams, numbers[have], bounds[1::2] - bounds[::2])
            for j in range(len(langs)):
                np.add.at(total[:, j], numbers[have], np.add.reduceat(columns[k][j][buckets], inside, dtype=np.float64)[::2])
    pred, posterior = [], []
    for i, text in enumerate(texts):
        if text is None or not langs or not _LETTER.search(text):
            pred.append(UNKNOWN)
            posterior.append(0.0)
            continue
        scaled = total[i] * min(1.0, INDEPENDENT / grams[i]) if grams[i] else total[i]
        best = int(np.argmax(scaled))
        pred.append(langs[best])
        posterior.append(float(1 / np.exp(scaled - scaled[best]).sum()))
    return pred, posterior


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; only the text is looked at."""
    model = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches):
        for batch in batches:
            pred, posterior = score(batch.column(1).to_pylist(), langs, model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(posterior, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")

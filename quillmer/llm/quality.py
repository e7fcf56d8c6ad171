"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Hashed word unigrams and bigrams are counted twice: over the trusted documents and over all documents.  A document's
score is the mean, over its own n-grams, of an estimate of ``log p_target - log p_raw``; it is kept when it passes the
base rules and its score is at least ``threshold``.

:func:`shrunk_ratios`, which the query and the pipeline use, takes ``2**MODEL_BITS`` buckets and draws each bucket's
target count towards the count that its share of the corpus would give, by ``PRIOR`` n-grams: a bucket seen once or
twice says little in a table of any size, and without evidence the ratio is 0.  The target is bounded by
``max_trusted`` documents, so it doesn't fill the buckets as the corpus grows.  :func:`log_ratios` is the same with
``2**BUCKET_BITS`` buckets smoothed by one towards the uniform distribution; its verdicts depend on the table's size.

Defined results: a null text counts as empty; an empty text has zero words and fails the base rules; a null id
is scored like any other (it is never trusted); repeated rows are scored each; an empty table gives an empty
result; without trusted documents every shrunk ratio is 0, so the base rules alone decide (``log_ratios``: the
target is the smoothing's uniform distribution and the same threshold holds); other columns are ignored unless named in ``carry``.  Texts are read whole, in passes of about 1 MB or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, buffers, codes, mix, pack, pick, string_hashes, sums, text_slices, thrifty, unpack

BUCKET_BITS = 16
MODEL_BITS = 20
#: Buckets that travel together.
BLOCK = 1 << 14
#: N-grams of the corpus's own distribution that a bucket's target count is drawn by.
PRIOR = 2.0
#: Mean log ratio (nats per n-gram) below which a document is rejected.
THRESHOLD = -0.25
#: Bound on the labelled rows that the target is counted from; beyond it those of smallest hash are used.
MAX_TRUSTED = 65_536
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def features(words: Words, h: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each unigram and bigram, and the text each belongs to."""
    text = words.text_of_word()
    shift = np.uint64(64 - bits)
    if len(h) < 2:
        return (h >> shift).astype(np.int64), text
    inside = text[1:] == text[:-1]
    pairs = mix(h[:-1] * _PAIR + h[1:])[inside]
    return (np.concatenate([h, pairs]) >> shift).astype(np.int64), np.concatenate([text, text[1:][inside]])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), bool)


def twice(keys: list[np.ndarray]) -> np.ndarray:
    """Which of the rows that the columns ``keys`` make up occur twice or more."""
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = mix(h + k.astype(np.uint64))
    at = np.flatnonzero(repeated(h))  # equal rows are among these; rows of one hash that differ are told apart here
    order = np.lexsort([k[at] for k in keys])
    same = np.ones(max(len(at) - 1, 0), bool)
    for k in keys:
        ordered = k[at][order]
        same &= ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys[0]), bool)
    out[at[order]] = np.append(same, False)[: len(at)] | np.append(False, same)[: len(at)]
    return out


def base_counts(words: Words, code: np.ndarray) -> dict[str, np.ndarray]:
    """``code``: the words' numbers, of :meth:`Words.codes`."""
    raw, offsets = words.raw, words.offsets
    n = len(words.counts)
    lead = words.solid & ((raw & 0xC0) != 0x80)
    text = words.text_of_word()
    # lines: between line feeds and the texts' ends
    cut = np.flatnonzero(raw == 10)
    starts = np.concatenate([offsets[:-1], cut + 1])
    order = np.lexsort((np.arange(len(starts)) < n, starts))  # an empty last line stands where the next text starts, and before it
    starts = np.sort(starts)
    line_text = np.concatenate([np.arange(n), np.searchsorted(offsets, cut, side="right") - 1])[order]
    ends = np.minimum(np.append(starts[1:], len(raw)), offsets[1:][line_text])
    breaks = np.zeros(len(raw) + 1, bool)
    breaks[cut] = True
    ends = np.where((ends > starts) & breaks[np.maximum(ends - 1, 0)] & (ends - 1 >= starts), ends - 1, ends)
    solid = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(words.solid, out=solid[1:])
    full = solid[ends] > solid[starts]
    line, _ = codes(raw[raw != 10], ends - starts)  # all lines, one after another
    owner = line_text[full]
    keys = owner << 32 | line[full]
    dup_lines = np.bincount(owner, minlength=n) - np.bincount(owner[np.unique(keys, return_index=True)[1]], minlength=n)
    # words in windows that the text holds twice
    covered = np.zeros(len(code), bool)
    if len(code) >= WINDOW:
        n_windows = len(code) - WINDOW + 1
        inside = np.flatnonzero(text[WINDOW - 1 :] == text[:n_windows])
        hit = inside[twice([text[inside], *(code[inside + j] for j in range(WINDOW))])]
        step = np.zeros(len(code) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + WINDOW, -1)
        covered = np.cumsum(step)[:-1] > 0
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": sums(lead, offsets),
        "n_symbols": sums(_SYMBOL[raw], offsets),
        "n_dup_lines": dup_lines.astype(np.int64),
        "n_repeat_words": sums(covered, words.first),
    }


def counts(docs: DataFrame, trusted: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """N-grams of each bucket in all and in the trusted documents.  ``trusted``: its first column names documents.

    Every task adds up its own buckets and sends them as packed blocks of ``BLOCK`` buckets, which are added up by block;
    the driver gets 2**bits numbers at most whatever the input.
    """
    ids = trusted.select(F.col(f"`{trusted.columns[0]}`").alias("id")).where("id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_trusted).withColumn("target", F.lit(True))
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(ids), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    size = min(BLOCK, 1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), np.int64)
        for b in text_slices(batches, "text"):
            words = Words(*buffers(b.column("text")))
            bucket, text = features(words, words.hashes(), bits)
            target = b.column("target").to_numpy(zero_copy_only=False)
            total[0] += np.bincount(bucket, minlength=1 << bits)
            if target.any():
                total[1] += np.bincount(bucket[target[text]], minlength=1 << bits)
        for k, (raw, good) in enumerate(zip(total[0].reshape(-1, size), total[1].reshape(-1, size), strict=True)):
            if raw.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "body": [pack(raw=raw, good=good)]})

    def add(t: pa.Table) -> pa.Table:
        both = np.zeros((2, size), np.int64)
        for body in t.column("body").to_pylist():
            x = unpack(body)
            both += np.stack([x["raw"], x["good"]]).astype(np.int64)
        return pa.table({"block": t.column("block").slice(0, 1), "body": pa.array([pack(raw=both[0], good=both[1])], pa.binary())})

    summed = rows.mapInArrow(thrifty(count), "block int, body binary").groupBy("block").applyInArrow(thrifty(add), "block int, body binary").toArrow()
    total = np.zeros((2, 1 << bits))
    for k, body in zip(summed["block"].to_pylist(), summed["body"].to_pylist(), strict=True):
        x = unpack(body)
        total[0, k * size : (k + 1) * size], total[1, k * size : (k + 1) * size] = x["raw"], x["good"]
    return total


def shrunk_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """``log p_target - log p_raw`` of each of 2**MODEL_BITS buckets, shrunk towards 0."""
    raw, target = counts(docs, trusted, MODEL_BITS, id_col, text_col, max_trusted)
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log(target + PRIOR) - np.log(expected + PRIOR)


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """``log p_target - log p_raw`` of each of 2**BUCKET_BITS buckets, add-one smoothed."""
    total = counts(docs, trusted, BUCKET_BITS, id_col, text_col, max_trusted)
    p = (total + 1) / (total.sum(axis=1, keepdims=True) + (1 << BUCKET_BITS))
    return np.log(p[1]) - np.log(p[0])


def judge(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts, verdicts and score."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), *measure(b.column("text"), table.value, threshold)], names)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pick(docs, id=id_col, text=text_col).mapInArrow(thrifty(score), SCHEMA)


def measure(texts: pa.Array, ratios: np.ndarray, threshold: float) -> list[pa.Array]:
    words = Words(*buffers(texts))
    code, distinct = words.codes()
    c = base_counts(words, code)
    bucket, text = features(words, string_hashes(distinct)[code], len(ratios).bit_length() - 1)
    n = len(words.counts)
    number = np.bincount(text, minlength=n)
    score = np.bincount(text, weights=ratios[bucket], minlength=n) / np.maximum(number, 1)
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    return [*(pa.array(x) for x in c.values()), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]


def keep_good(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    table, schema = docs.sparkSession.sparkContext.broadcast(ratios), docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text_col):
            yield b.filter(measure(b.column(text_col), table.value, threshold)[6])

    return docs.mapInArrow(thrifty(keep), schema)

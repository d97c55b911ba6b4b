"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted hash arrays that workers map into memory.

Counting: every task turns its texts into word hashes, sums equal bigrams and sends the sums to the bucket of the bigram's hash
(buckets are ranges of hashes, so no frequent word is the work of one task). A bucket writes its bigrams as a sorted array and
passes on, per word, the counts of the word and of the bigrams that begin and end with it; buckets of words write those as sorted
arrays. Files appear under their final name only when complete and are the same when a task runs again. Scoring: each worker maps
the files and looks up sorted batches of hashes. Two words a context is what the disk budget allows; see README.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.word_hashes import mixed, word_hashes
from notewright.session import fresh_path

#: Context of the first word, and the token after the last one.
BEGIN, END = np.uint64(1), np.uint64(2)
#: Bytes of training text for each bucket, about.
BUCKET_BYTES = 16 << 20
#: Tokens that a task sums up before it sends; bytes of text that are scored at a time.
HELD_TOKENS = 2_000_000
SCORED_BYTES = 2 << 20
#: Files that a worker keeps mapped.
OPEN_FILES = 512

MESSAGE = "bucket int, a binary, b binary, n binary, m binary"
MANY = 255


def local_folder(path: str) -> str:
    """The path by which this machine sees a shared folder."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: the model is mapped into memory, so the shared folder must be mounted (a file: path)")
    return url.path


def bigram_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before) * np.uint64(0xD6E8FEB86659FD93) + word)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of hashes, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def token_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token before, the token, and the row of every token; each text ends with one END and begins after BEGIN."""
    hashes, rows = word_hashes(texts, lower=True)
    hashes[hashes <= END] += np.uint64(3)
    n = len(texts)
    ends = np.cumsum(np.bincount(rows, minlength=n) + 1) - 1
    tokens = np.full(len(hashes) + n, END, dtype=np.uint64)
    tokens[np.arange(len(hashes)) + rows] = hashes
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[:1] = BEGIN
    before[ends[:-1] + 1] = BEGIN
    row = np.repeat(np.arange(n), np.diff(ends, prepend=-1))
    return before, tokens, row


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of texts of about `size` bytes."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = lengths[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lengths, done + size, "right")))
        yield texts.slice(at, end - at)
        at = end


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First position of each distinct key in key order, and its total."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    if counts is None:
        total = np.diff(np.append(first, len(keys)))
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    return order[first], total.astype(np.int64)


def _message(bucket: int, *arrays: np.ndarray) -> dict:
    return {"bucket": bucket} | {name: x.tobytes() for name, x in zip("abnm", [*arrays, *[np.zeros(0)] * (4 - len(arrays))])}


_ARROW = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary()), ("m", pa.binary())])


def _batch(messages: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(messages, schema=_ARROW)


def _bigram_messages(before: np.ndarray, words: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct bigrams with counts, by bucket: runs of the first word (a: word, m: bigrams), second words (b), counts (n)."""
    keys = bigram_keys(before, words)
    first, total = summed(keys)
    before, words, keys = before[first], words[first], keys[first]
    bucket = bucket_of(keys, buckets)
    borders = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in range(buckets):
        lo, hi = borders[k], borders[k + 1]
        if lo == hi:
            continue
        order = lo + np.argsort(before[lo:hi], kind="stable")
        heads = before[order]
        runs = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        lengths = np.diff(np.append(runs, len(heads)))
        yield _batch([_message(k, heads[runs], words[order], total[order].astype(np.uint32), lengths.astype(np.uint32))])


def count_bigrams(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for texts in slices(batch.column(0), SCORED_BYTES):
                before, words, _ = token_pairs(texts)
                held.append((before, words))
                size += len(words)
                if size >= HELD_TOKENS:
                    yield from _bigram_messages(*map(np.concatenate, zip(*held)), buckets)
                    held, size = [], 0
        if held:
            yield from _bigram_messages(*map(np.concatenate, zip(*held)), buckets)

    return docs.select("text").mapInArrow(run, MESSAGE)


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """Complete or not at all, however often a task runs."""
    path = os.path.join(folder, name)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        array.tofile(f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name) if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], dtype=np.int64)


def store_bigrams(messages: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Write each bucket's bigrams; per word and bucket: count (as second word), bigrams ending and starting with it by count."""

    def run(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        before = np.repeat(_column(table, "a", np.uint64), _column(table, "m", np.uint32))
        words, counts = _column(table, "b", np.uint64), _column(table, "n", np.uint32).astype(np.int64)
        keys = bigram_keys(before, words)
        first, total = summed(keys, counts)
        before, words, keys = before[first], words[first], keys[first]
        _write(folder, f"bigram-{k}.keys", keys)
        _write(folder, f"bigram-{k}.counts", np.minimum(total, MANY).astype(np.uint8))
        many = np.flatnonzero(total >= MANY)
        _write(folder, f"bigram-{k}.many", np.stack([many, total[many]]).astype(np.int64))
        # One row of numbers per word: count, continuations, bigrams seen once, twice, more often.
        both, inverse = np.unique(np.concatenate([words, before]), return_inverse=True)
        as_word, as_context = inverse[: len(words)], inverse[len(words) :]
        size = len(both)
        numbers = np.stack(
            [
                np.bincount(as_word, weights=total, minlength=size),
                np.bincount(as_word, minlength=size),
                *[np.bincount(as_context[hit], minlength=size) for hit in (total == 1, total == 2, total > 2)],
            ]
        ).astype(np.int64)
        bucket = bucket_of(both, buckets)
        borders = np.searchsorted(bucket, np.arange(buckets + 1))
        out = [
            _message(w, both[borders[w] : borders[w + 1]], numbers[:, borders[w] : borders[w + 1]].astype(np.uint32))
            for w in range(buckets)
            if borders[w] < borders[w + 1]
        ]
        out.append(_message(-1 - k % buckets, _counts_of_counts(total)))
        return pa.Table.from_batches([_batch(out)])

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


SUMS = ("n1", "n2", "n3", "n4", "words", "more", "tokens", "bigrams")
NUMBERS = np.dtype([("count", np.uint64), ("ends", np.uint32), ("once", np.uint32), ("twice", np.uint32), ("more", np.uint32)])


def store_words(messages: DataFrame, folder: str) -> DataFrame:
    """Write each bucket of words; sums that the discounts need."""

    def run(table: pa.Table) -> pa.Table:
        k = table.column("bucket")[0].as_py()
        out = {"words": 0, "more": 0, "tokens": 0, "bigrams": 0}
        if k < 0:
            sums = _column(table, "a", np.int64).reshape(-1, 4).sum(axis=0)
            kind = "bigram"
        else:
            hashes = _column(table, "a", np.uint64)
            parts = [np.frombuffer(x.as_buffer(), dtype=np.uint32).reshape(5, -1) for x in table.column("b")]
            numbers = np.concatenate(parts, axis=1).astype(np.int64)
            distinct, inverse = np.unique(hashes, return_inverse=True)
            totals = [np.bincount(inverse, weights=row, minlength=len(distinct)).astype(np.int64) for row in numbers]
            if any(t.max(initial=0) >= 1 << 32 for t in totals[1:]):
                raise OverflowError("more bigrams of one word than 32 bits hold")
            stored = np.zeros(len(distinct), dtype=NUMBERS)
            for name, t in zip(NUMBERS.names, totals):
                stored[name] = t
            _write(folder, f"word-{k}.keys", distinct)
            _write(folder, f"word-{k}.numbers", stored)
            sums, kind = _counts_of_counts(totals[1]), "word"
            out = {"words": int((totals[0] > 0).sum()), "more": int((totals[1] > 2).sum()), "tokens": int(totals[0].sum()), "bigrams": int(totals[1].sum())}
        row = {"kind": kind} | {f"n{i + 1}": int(x) for i, x in enumerate(sums)} | out
        return pa.Table.from_pylist([row])

    return messages.groupBy("bucket").applyInArrow(run, "kind string, " + ", ".join(f"{c} long" for c in SUMS))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more, from the numbers of entries counted 1 to 4 times; within 0 and the count."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5

    def one(k: int, lower: int, higher: int) -> float:
        return min(float(k), max(0.0, k - (k + 1) * y * higher / lower)) if lower else k / 2

    return one(1, n1, n2), one(2, n2, n3), one(3, n3, n4)


@functools.lru_cache(maxsize=OPEN_FILES)
def mapped(path: str, kind: str) -> np.ndarray:
    """A file as an array that the system pages in and out."""
    size = os.path.getsize(path) if os.path.exists(path) else 0
    dtype = NUMBERS if kind == "numbers" else np.dtype(kind)
    return np.memmap(path, dtype=dtype, mode="r") if size else np.zeros(0, dtype=dtype)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums. Small: it goes to every worker."""

    folder: str
    buckets: int
    tokens: int
    words: int
    bigrams: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_classes: tuple[int, int, int]

    def _by_bucket(self, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        borders = np.searchsorted(bucket_of(keys, self.buckets), np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(borders)):
            yield int(k), int(borders[k]), int(borders[k + 1])

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, 0 for unseen ones."""
        out = np.zeros(len(keys), dtype=np.int64)
        for k, lo, hi in self._by_bucket(keys):
            path = os.path.join(self.folder, f"bigram-{k}")
            stored = mapped(f"{path}.keys", "u8")
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[lo:hi]), len(stored) - 1)
            hit = np.flatnonzero(stored[at] == keys[lo:hi])
            counts = mapped(f"{path}.counts", "u1")[at[hit]].astype(np.int64)
            large = counts == MANY
            if large.any():
                where, total = mapped(f"{path}.many", "i8").reshape(2, -1)
                counts[large] = total[np.searchsorted(where, at[hit][large])]
            out[lo + hit] = counts
        return out

    def word_numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted words, zeros for unseen ones."""
        out = np.zeros(len(keys), dtype=NUMBERS)
        for k, lo, hi in self._by_bucket(keys):
            stored = mapped(os.path.join(self.folder, f"word-{k}.keys"), "u8")
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[lo:hi]), len(stored) - 1)
            hit = np.flatnonzero(stored[at] == keys[lo:hi])
            out[lo + hit] = mapped(os.path.join(self.folder, f"word-{k}.numbers"), "numbers")[at[hit]]
        return out

    def word_probability(self, ends: np.ndarray) -> np.ndarray:
        """Of words by the number of bigrams that end with them; what is discounted goes evenly to all words and one unknown."""
        uniform = 1.0 / (self.words + 1)
        if not self.bigrams:
            return np.full(len(ends), uniform)
        d = np.array([0.0, *self.word_discounts])
        spread = float(np.dot(self.word_discounts, self.word_classes))
        kept = np.maximum(ends - d[np.minimum(ends, 3)], 0.0)
        return (kept + spread * uniform) / self.bigrams

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        before, tokens, row = token_pairs(texts)
        n = len(texts)
        words, inverse = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        numbers = self.word_numbers(words)
        as_token, as_context = inverse[: len(tokens)], inverse[len(tokens) :]
        lower = self.word_probability(numbers["ends"].astype(np.int64))
        # Every occurrence of a word is the context of the token after it; BEGIN occurs as often as END.
        ends_at = np.searchsorted(words, END)
        total = numbers["count"].astype(np.float64)
        total[words == BEGIN] = total[ends_at] if len(words) else 0
        d = np.array([0.0, *self.bigram_discounts])
        spread = d[1] * numbers["once"] + d[2] * numbers["twice"] + d[3] * numbers["more"]
        keys = bigram_keys(before, tokens)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.empty(len(keys), dtype=np.int64)
        counts[order] = np.repeat(self.bigram_counts(ordered[first]), np.diff(np.append(first, len(keys))))
        p_lower, total_here = lower[as_token], total[as_context]
        seen = total_here > 0
        safe = np.where(seen, total_here, 1.0)
        p = np.where(seen, (np.maximum(counts - d[np.minimum(counts, 3)], 0.0) + spread[as_context] * p_lower) / safe, p_lower)
        known = numbers["count"][as_token].astype(np.float64)
        base = np.log10((known + 1) / (self.tokens + self.words + 1))
        return {
            "n_tokens": np.bincount(row, minlength=n),
            "n_known": np.bincount(row, weights=known > 0, minlength=n).astype(np.int64),
            "base_score": np.bincount(row, weights=base, minlength=n),
            "score": np.bincount(row, weights=np.log10(p), minlength=n),
        }


def train(docs: DataFrame) -> Model:
    """The model of all whole texts of `docs` (null: empty). An empty table gives a model in which every token is unknown."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "kneser-ney")
    local = local_folder(folder)
    os.makedirs(local, exist_ok=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    messages = store_bigrams(count_bigrams(docs, buckets), local, buckets)
    rows = store_words(messages, local).groupBy("kind").agg(*[F.sum(c).alias(c) for c in SUMS])
    sums = {r["kind"]: r for r in rows.collect()}
    pairs, words = (sums[k].asDict() if k in sums else dict.fromkeys(SUMS, 0) for k in ("bigram", "word"))
    n = [words[f"n{i}"] for i in (1, 2, 3, 4)]
    return Model(
        local, buckets, words["tokens"], words["words"], words["bigrams"],
        discounts([pairs[f"n{i}"] for i in (1, 2, 3, 4)]), discounts(n), (n[0], n[1], words["more"]),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out as given, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text. No shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(2), SCORED_BYTES):
                found = model.score(texts)
                n = len(texts)
                columns = [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(found["n_tokens"], pa.int64())]
                columns += [pa.array(found["n_known"], pa.int64()), pa.array(np.full(n, model.tokens), pa.int64())]
                columns += [pa.array(found["base_score"]), pa.array(found["score"]), pa.array(10 ** (-found["score"] / found["n_tokens"]))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += n

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    schema = f"doc_id {kinds['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those whose id's crc32 modulo 7 is not 2. Repeated and null ids are rows like others."""
    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    return score(rows, train(rows.filter(~F.col("held_out"))))

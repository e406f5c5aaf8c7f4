"""Evaluation texts inside a training corpus.

Method: a broadcast hash set of the normalised n-grams of the test items; every
training text is scanned in windows of n words, hits are verified word by word,
and the spans or the documents are removed.

A word is a run of letters or digits in lower case, so case, punctuation, white
space and line layout do not count. The set holds 64-bit hashes of word
windows; a text's windows are hashed at once by sums over shifted arrays, and
only words that occur in items have numbers at all. The items' text is
broadcast only after its size was measured; larger item sets go the other way,
where windows are joined with the items' windows by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a row that count as a passage.
WORDS = 10
#: Items with more characters in all than this are not broadcast.
MAX_BROADCAST_CHARS = 50_000_000
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """The words of a text, in lower case."""
    return _WORD.findall(text.lower())


def _window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n numbers, by position."""
    count = len(ids) - n + 1
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * _BASE + mixed[i : i + count]
    return out


class ItemWindows:
    """All windows of n words of the items, by hash."""

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS) -> None:
        self.n = n
        self.number: dict[str, int] = {}
        self.texts: dict[int, np.ndarray] = {}
        hashes, at = [], []
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int64)
            self.texts[item] = ids
            if len(ids) >= n:
                hashes.append(_window_hashes(ids, n))
                at.extend((item, i) for i in range(len(ids) - n + 1))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.at = flat[order], [at[i] for i in order]

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first word of the window in the text, in the item) of each verified window."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in words(text)], np.int64)
        n = self.n
        if len(ids) < n or not len(self.hashes):
            return []
        # windows with a word that no item has are out
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        open_ = np.flatnonzero(unknown[n:] == unknown[:-n])
        if not len(open_):
            return []
        h = _window_hashes(ids, n)[open_]
        first = np.searchsorted(self.hashes, h, "left")
        last = np.searchsorted(self.hashes, h, "right")
        found = []
        for k in np.flatnonzero(last > first):
            w = ids[open_[k] : open_[k] + n]
            for j in range(first[k], last[k]):
                item, i = self.at[j]
                if np.array_equal(self.texts[item][i : i + n], w):
                    found.append((item, int(open_[k]), i))
        return found

    def without_spans(self, text: str) -> str:
        """The text with every passage taken out that an item has (from its first word's to its last word's end)."""
        return _cut_out(text, sorted({p for _, p, _ in self.hits(text)}), self.n)


def _cut_out(text: str, hit: list[int], n: int) -> str:
    """The text without the windows of n words that begin at the words hit (ascending)."""
    if not hit:
        return text
    # lower() may change a text's length; spans are found in the text itself
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(words(text)):
        spans = _spans_by_lowering(text)
    out, done = [], 0
    for p in hit:
        begin, end = spans[p][0], spans[p + n - 1][1]
        if begin > done:
            out.append(text[done:begin])
        done = max(done, end)
    out.append(text[done:])
    return "".join(out)


def _spans_by_lowering(text: str) -> list[tuple[int, int]]:
    """Spans in the text of the words of its lower case, where lowering changes lengths."""
    source = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(source[m.start()], source[m.end() - 1] + 1) for m in _WORD.finditer("".join(c.lower() for c in text))]


def _collected(items: DataFrame, item_key: str, item_text: str, limit: int) -> list[tuple[int, str]] | None:
    """The items if their measured size allows it."""
    rows = items.select(F.col(item_key).cast("long"), item_text).where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull())
    size = rows.agg(F.sum(F.length(item_text))).head()[0] or 0
    return [tuple(r) for r in rows.collect()] if size <= limit else None


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = WORDS, limit: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """(key, item_id): each document and each item of which n consecutive words stand in it, once.

    NULL and empty texts have no words; texts and items of fewer than n words
    match nothing. An item that is repeated under several ids is reported under
    each of them. Keys that occur in several rows come out once with an item.
    """
    kind = dict(docs.dtypes)[key]
    known = _collected(items, item_key, item_text, limit)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") >= 2 * n - 1)
    if known is None:
        return _joined(rows, items, item_key, item_text, n, kind).withColumnRenamed("key", key)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = ItemWindows(shared.value, n)
        for b in batches:
            keys, found_keys, found_items = b.column(0).to_pylist(), [], []
            for k, t in zip(keys, b.column(1), strict=True):
                for item in sorted({i for i, _, _ in windows.hits(t.as_py())}):
                    found_keys.append(k)
                    found_items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(found_keys, b.column(0).type), pa.array(found_items, pa.int64())], ["key", "item_id"])

    return rows.mapInArrow(run, f"key {kind}, item_id long").distinct().withColumnRenamed("key", key)


def _joined(rows: DataFrame, items: DataFrame, item_key: str, item_text: str, n: int, kind: str) -> DataFrame:
    """leaks() without broadcast: windows of documents and items meet by hash.

    Windows of items are collapsed to one row for each window before the join;
    the pairs are as many as the result's verified windows.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                w = words(t.as_py())
                grams = list({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(grams)), pa.array(grams, pa.string())], ["key", "gram"])

    of_docs = rows.mapInArrow(windows, f"key {kind}, gram string")
    wanted = items.select(F.col(item_key).cast("long").alias("key"), F.col(item_text).alias("text")).where("key is not null and text is not null")
    of_items = wanted.mapInArrow(windows, "key long, gram string").withColumnRenamed("key", "item_id")
    hashed = lambda df: df.withColumn("h", F.xxhash64("gram"))
    return hashed(of_docs).join(hashed(of_items), ["h", "gram"]).select("key", "item_id").distinct()


def clean(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int = WORDS, limit: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """(key, text): every document without the passages that items have; others come out as they are.

    Item sets above the limit are not broadcast: windows of documents and items
    are joined by hash, and the texts are cut at the positions that come out.
    """
    kind = dict(docs.dtypes)[key]
    known = _collected(items, item_key, item_text, limit)
    if known is None:
        return _clean_joined(docs, key, text, items, item_key, item_text, n)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = ItemWindows(shared.value, n)
        for b in batches:
            texts = [None if t is None else windows.without_spans(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, text string")
    return out.withColumnsRenamed({"key": key, "text": text})


def _clean_joined(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, n: int) -> DataFrame:
    """clean() without broadcast.

    A text stands for all its rows: rows with one text, whatever their keys, get
    the same positions, found once. Windows of items are made distinct first, so
    each window of a text meets at most one row.
    """
    kind = dict(docs.dtypes)[key]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                w = words(t.as_py())
                grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(grams)), pa.array(range(len(grams)), pa.int32()), pa.array(grams, pa.string())], ["id", "at", "gram"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not hit else _cut_out(t, hit, n) for t, hit in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.sha2("text", 256).alias("id"))
    long_ = rows.where(F.length("text") >= 2 * n - 1).dropDuplicates(["id"]).select("id", "text")
    of_docs = long_.mapInArrow(windows, "id string, at int, gram string").withColumn("h", F.xxhash64("gram"))
    wanted = items.where(F.col(item_key).isNotNull()).select(F.lit("").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    of_items = wanted.mapInArrow(windows, "id string, at int, gram string").select(F.xxhash64("gram").alias("h"), "gram").distinct()
    hits = of_docs.join(of_items, ["h", "gram"]).groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("hit"))
    out = rows.join(hits, "id", "left").select("key", "text", "hit").mapInArrow(cut_out, f"key {kind}, text string")
    return out.withColumnsRenamed({"key": key, "text": text})

"""Encoding a whole corpus with a public byte-level BPE vocabulary.

Method: a backtracking encoder. An Aho-Corasick automaton gives, for every
position of a piece of text, the tokens that begin there; the encoder takes the
longest and steps back to shorter ones whenever two neighbouring tokens could
not stand side by side in the result of the merges. Which pairs can is decided
by unrolling both tokens into the merges they were made of, and kept in a table.
The result equals that of applying the merges in order, in time linear in the
text. Decoding looks up each id in one byte string by an offset table.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder of the tokenizer files; a parameter of every function that reads them.
TOKENIZER_DIR = "/opt/tokenizers"
#: A vocabulary file larger than this isn't broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
# Fixed value: how byte-level BPE cuts text into pieces. White space is that of
# Unicode's property: the regex module's \s would also take the separators U+001C to U+001F.
PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if it shows, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the encoder of one vocabulary file (tokenizers' JSON)."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)["model"]
        byte_of = printable_bytes()
        raw = lambda t: bytes(byte_of[c] for c in t)
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right = ids[raw(a)], ids[raw(b)]
            whole = ids[raw(a) + raw(b)]
            self.merge.setdefault((left, right), rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
        made = {t: i for t, i in ids.items() if len(t) == 1 or i in self.parts}
        self.length = {i: len(t) for t, i in made.items()}
        self.single = {t[0]: i for t, i in made.items() if len(t) == 1}
        # bytes stand as the characters of equal number in the automaton
        self.automaton = ahocorasick.Automaton()
        for t, i in made.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        size = max(ids.values()) + 1
        by_id = [b""] * size
        for t, i in ids.items():
            by_id[i] = t
        self.blob = b"".join(by_id)
        self.offsets = array("q", [0])
        for t in by_id:
            self.offsets.append(self.offsets[-1] + len(t))
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.cut = regex.compile(PIECES).findall

    def _can_stand(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens when their bytes are merged together.

        Both are undone, the later merge first, along the border between them;
        they may not stand if two tokens at the border had merged before
        either of them was complete.
        """
        key = (left, right)
        if (kept := self.compatible.get(key)) is not None:
            return kept
        a, b, ok = left, right, True
        until = float(len(self.merge))  # merges before this turn could still join the two at the border
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < until:
                ok = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                until, a = ra, self.parts[a][1]
            else:
                # merges of one rank run from the left: at the border before inside the right token
                until, b = rb + 0.5, self.parts[b][0]
        self.compatible[key] = ok
        return ok

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(data.decode("latin-1")):
            starts[end + 1 - self.length[token]].append(token)  # ends grow, so the longest comes last
        out: list[int] = []
        tried = [len(s) for s in starts]  # candidates not yet ruled out at a position, given what stands before
        at = 0
        dead = bytearray(n + 1)
        while at < n:
            i = tried[at]
            while i:
                token = starts[at][i - 1]
                end = at + self.length[token]
                if not dead[end] and (not out or self._can_stand(out[-1], token)):
                    break
                i -= 1
            if i:
                tried[at] = i - 1
                out.append(token)
                at = end
                if at < n:
                    tried[at] = len(starts[at])
            else:
                dead[at] = 1
                at -= self.length[out.pop()]
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for p in self.cut(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= 40:
                    if len(known) > 300_000:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        off, blob = self.offsets, self.blob
        return b"".join([blob[off[i] : off[i + 1]] for i in ids]).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(content: str) -> Vocabulary:
    """One vocabulary for each Python worker, kept between tasks."""
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def read_vocabulary(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> str:
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{name} is too large to be broadcast")
    return content


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): token ids of every text, without special tokens; their strings are ordinary text.

    NULL and empty texts have the empty list. Keys may repeat; each row comes
    out once. Nothing is shuffled. Only the two columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for b in batches:
            keys, texts = b.columns
            step = 256
            for i in range(0, b.num_rows, step):
                ids = [vocabulary.encode(t) if t else [] for t in texts.slice(i, step).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(i, step), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_corpus(df: DataFrame, key: str, ids: str, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text): the texts of lists of ids; a NULL or empty list gives the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(folder, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for b in batches:
            texts = [vocabulary.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def token_counts(df: DataFrame, ids: str = "ids") -> DataFrame:
    """(token_id, n): how often each id occurs; map-side combined."""
    return df.select(F.explode(ids).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")

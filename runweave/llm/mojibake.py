"""Text that was decoded with a wrong encoding: finding it and restoring the original.

Method: character n-gram models with smoothing are trained on clean records;
every chain "encode as X, decode as Y" is scored on the tokens it applies to,
line by line, and the likeliest is accepted if it beats the text as it stands by
a margin. This goes on until no chain does, so a text may have been decoded
wrongly any number of times: each step must raise the likelihood by the margin,
so the steps end by themselves.

Clean records are found in two rounds: first those without any sign in their
form (no replacement or control characters, no token whose bytes decode as
UTF-8), then, with a first model, those that stand. Counts come from all words of
all clean records but the held-out tenth. The margin is chosen on that tenth:
its lines as they are and garbled on purpose, so that the fewest of both are
judged wrongly.

Characters that were replaced or lost on reading can't be had back by a chain.
The model judges them too: a text is garbled beyond restoring when some other
character in their place makes it likelier by the margin.

The model is a count-min table of hashed n-gram counts: two independent cells for
each n-gram, of which the lesser counts, so what is broadcast has a fixed size. Words
are counted, and their readings scored, once for each distinct word of a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of each of the two rows of the table of hashed n-gram counts.
CELLS = 1 << 21
#: Natural logarithm of the likelihood ratio that a restored line must exceed, until one is chosen on held-out records.
MARGIN = 3.0
#: One record in so many is held out to choose the margin.
HELD_OUT = 10
#: Distinct words that a task keeps at a time; then it starts anew, which costs time only.
KEPT = 100_000
# Encodings that texts were read with by mistake, and that they were written in.
READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-2", "cp1253", "cp1254", "iso8859-15")
WRITTEN_IN = ("utf-8", "cp1251", "cp1250", "cp1252", "cp1253", "iso8859-7", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "cp932", "euc_jp", "iso8859-2")
# A token keeps the blank after the first half of a UTF-8 pair when another follows: it may have been a no-break space.
_TOKEN = re.compile("[^ \t\r\n\x0b\x0c]*[\u00c2-\u00df] (?= )|[^ \t\r\n\x0b\x0c]+")
_MARKS = re.compile("[\x80-\x9f\ufffd]")
_HIGH = re.compile("[^\x00-\x7f]")
_ENDS = re.compile("(\r\n|\r|\n)")
# Halves of UTF-8 pairs whose second byte was lost: a no-break space at the end of a word (or made plain), a soft hyphen within.
_HALF_AT_END, _HALF_WITHIN = re.compile(rb"([\xc2-\xdf])[ ]?$"), re.compile(rb"([\xc2-\xdf])(?=[a-z])")
_ORDER = {f"{x}>{y}{z}": -(100 * i + 2 * j + len(z)) for i, x in enumerate(READ_AS) for j, y in enumerate(WRITTEN_IN) for z in ("", "~")}
#: A chain of two is so much less likely than one: it is one of so many.
LONGER = float(np.log(len(READ_AS) * len(WRITTEN_IN)))
#: Characters that single-byte encodings have beyond ASCII: what a replaced one may have been.
_LETTERS = sorted({c for e in READ_AS for c in bytes(range(128, 256)).decode(e, "ignore") if c.isprintable() and not _MARKS.match(c)})


def _encoded(text: str, encoding: str) -> bytes | None:
    """Bytes of a text; bytes that the Windows code pages leave undefined were kept as control characters."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not "\x80" <= c <= "\x9f":
                return None
            out.append(ord(c))
    return bytes(out)


def _decoded(data: bytes, encoding: str) -> str | None:
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


@lru_cache(1 << 16)
def readings(token: str) -> tuple[tuple[str, str], ...]:
    """(chain, text) of every chain that turns the token into another text without control characters.

    Chains that end in ~ complete UTF-8 pairs whose second byte was lost.
    """
    found: dict[str, str] = {}
    for x in READ_AS:
        data = _encoded(token, x)
        if data is None:
            continue
        for y in WRITTEN_IN:
            t = _decoded(data, y) if y != x else None
            if t is None or t == token or "\ufffd" in t:
                continue
            if _HIGH.search(t) if y == "utf-8" else not _MARKS.search(t):
                found[f"{x}>{y}"] = t
        whole = _HALF_WITHIN.sub(b"\\1\xad", _HALF_AT_END.sub(b"\\1\xa0", data))
        t = _decoded(whole, "utf-8") if whole != data else None
        if t is not None and not _MARKS.search(t):
            found[f"{x}>utf-8~"] = t
    return tuple(found.items())


def decodes_as_utf8(token: str) -> bool:
    """Whether a token's bytes in the commonest encodings are UTF-8 (texts of other scripts may be so by chance in others)."""
    return any(c in ("cp1252>utf-8", "latin-1>utf-8") for c, _ in readings(token))


def _hashes(text: np.ndarray, kind: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells for the n-gram of the width that ends at each place of a row of characters."""
    h = np.full(len(text), (kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for back in range(width - 1, -1, -1):
        h[back:] ^= text[: len(text) - back]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return (h & np.uint64(CELLS - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(CELLS - 1)).astype(np.int64)


# n-grams that are counted: (kind, width, first place they end at, may they end with the word?); the last two are the contexts of pairs and triples.
_GRAMS = ((0, 1, 1, True), (1, 2, 1, True), (2, 3, 2, True), (3, 1, 0, False), (4, 2, 1, False))
_BEGIN, _END = "\x02", "\x03"


def _row(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters of all words with their ends, number of the word at each place)."""
    text = np.frombuffer("".join(f"{_BEGIN}{w}{_END}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return text, np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))


def _table(words: Counter) -> np.ndarray:
    """Counts (2, CELLS) of the n-grams of words: one-, two- and three-character ones, and the contexts of the longer ones."""
    out = np.zeros((2, CELLS))
    if not words:
        return out
    text, of = _row(list(words))
    times = np.fromiter(words.values(), np.float64, len(words))[of]
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    place = np.arange(len(text)) - begins[of]
    last = text == ord(_END)
    for kind, width, least, to_end in _GRAMS:
        which = (place >= least) & (to_end | ~last)
        for r, cells in enumerate(_hashes(text, kind, width)):
            out[r] += np.bincount(cells[which], times[which], CELLS)
    return out


class Model:
    """Log probability of words by interpolated character trigrams, and the chains that make words likelier."""

    def __init__(self, table: np.ndarray, total: float) -> None:
        self.table = table
        self.total = max(1.0, total)
        self.seen: dict[str, float] = {}
        self.better: dict[str, tuple] = {}

    def score_all(self, words: Iterable[str]) -> None:
        """Scores of words that have none yet, in one go."""
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        if not new:
            return
        text, of = _row(new)
        place = np.arange(len(text)) - np.flatnonzero(np.diff(of, prepend=-1))[of]

        def n(kind: int, width: int) -> np.ndarray:
            a, b = _hashes(text, kind, width)
            return np.minimum(self.table[0][a], self.table[1][b])

        back = lambda x: np.concatenate((x[:1], x[:-1]))  # noqa: E731  # the context ends one place before
        p = (n(0, 1) + 1e-3) / (self.total + 100)
        p = (n(1, 2) + 2.0 * p) / (back(n(3, 1)) + 2.0)
        p = np.where(place > 1, (n(2, 3) + 2.0 * p) / (back(n(4, 2)) + 2.0), p)
        logs = np.where(place > 0, np.log(np.minimum(p, 1.0)), 0.0)
        for w, x in zip(new, np.bincount(of, logs, len(new)).tolist(), strict=True):
            self.seen[w] = x

    def score(self, word: str) -> float:
        if word not in self.seen:
            self.score_all([word])
        return self.seen[word]

    def gains_all(self, words: Iterable[str]) -> None:
        """Finds the chains that make each of the words likelier."""
        if len(self.better) > KEPT:
            self.better.clear()
        if len(self.seen) > 20 * KEPT:
            self.seen.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.better]
        steps = {w: readings(w) for w in new}
        ahead = {t: [u for c, u in readings(t) if c.endswith(">utf-8")] for r in steps.values() for _, t in r if not t.isascii()}
        self.score_all([*new, *(t for r in steps.values() for _, t in r), *(u for us in ahead.values() for u in us)])
        at = self.seen
        for w, found in steps.items():
            # a single character that also stands alone in clean text proves nothing by itself
            alone = len(w) == 1 and self._known(w)
            rows = []
            for chain, t in found:
                # a chain that leads on (decoded twice) may look no better after one step
                gain = max(at[t], *(at[u] - LONGER for u in ahead.get(t, ())), -np.inf) - at[w]
                if gain > 0:
                    rows.append((chain, 0.0 if alone else gain, t))
            self.better[w] = tuple(rows)

    def _known(self, word: str) -> bool:
        text, _ = _row([word])
        a, b = _hashes(text, 2, 3)
        return min(self.table[0][a[2]], self.table[1][b[2]]) >= 3

    def step(self, line: str) -> tuple[str | None, float, dict[str, str]]:
        """(chain, gain, new words): the likeliest chain of a line."""
        words = [w for w in dict.fromkeys(_TOKEN.findall(line)) if not w.isascii()]
        if any(w not in self.better for w in words):
            self.gains_all(words)
        gains: dict[str, float] = {}
        to: dict[str, dict[str, str]] = {}
        for w in words:
            for chain, gain, t in self.better[w]:
                gains[chain] = gains.get(chain, 0.0) + gain
                to.setdefault(chain, {})[w] = t
        best = max(gains, key=lambda c: (round(gains[c], 6), c.endswith("utf-8"), _ORDER[c]), default=None)
        return best, gains.get(best, 0.0), to.get(best, {})

    def restore_line(self, line: str, margin: float) -> tuple[str, list[str]]:
        """(text, chains): the likeliest original of a line and the chains that led there; no chains if it stands."""
        chains: list[str] = []
        met = {line}
        while True:
            chain, gain, to = self.step(line)
            if chain is None or gain <= margin:
                return line, chains
            line = _TOKEN.sub(lambda m: to.get(m.group(), m.group()), line)  # noqa: B023  # called at once
            if line in met:  # a look ahead that led back
                return line, chains
            met.add(line)
            chains.append(chain)

    def lost(self, text: str, margin: float) -> bool:
        """Whether other characters in place of replaced or control ones make a text likelier by the margin."""
        for w in _TOKEN.findall(text):
            if _MARKS.search(w):
                now, best = w, self.score(w)
                for m in _MARKS.finditer(w):
                    tries = [now[: m.start()] + c + now[m.end() :] for c in _LETTERS]
                    self.score_all(tries)
                    now = max(tries, key=self.seen.__getitem__)
                if self.score(now) - best > margin:
                    return True
        return False

    def restore(self, text: str, margin: float = MARGIN) -> tuple[str, list[str], bool]:
        """(text, chains, garbled?) of a whole text; line ends stay as they are."""
        out, chains = [], []
        for line in _ENDS.split(text):
            fixed, c = (line, []) if line.isascii() else self.restore_line(line, margin)
            out.append(fixed)
            chains += c
        return "".join(out), list(dict.fromkeys(chains)), bool(chains) or bool(_MARKS.search(text)) and self.lost(text, margin)

    def prepare(self, texts: Iterable[str]) -> None:
        """Scores all words of a batch of texts at once."""
        self.gains_all({w for t in texts for w in _TOKEN.findall(t) if not w.isascii()})


def looks_clean(text: str) -> bool:
    """No sign of garbling in the form of a text."""
    if text.isascii():
        return True
    return not _MARKS.search(text) and not any(decodes_as_utf8(t) for t in _TOKEN.findall(text) if not t.isascii())


def _count(batches: Iterator[pa.RecordBatch], clean: Callable[[list[str]], list[bool]]) -> Iterator[pa.RecordBatch]:
    """Cells of the n-grams in the clean texts of a partition: (cell, n), with the number of characters under -1."""
    table, words, chars = np.zeros((2, CELLS)), Counter(), 0
    for b in batches:
        texts = b.column(0).to_pylist()
        for text, good in zip(texts, clean(texts), strict=True):
            if good:
                words.update(_TOKEN.findall(text))
        if len(words) > KEPT:
            table += _table(words)
            chars += sum((len(w) + 1) * n for w, n in words.items())
            words.clear()
    table += _table(words)
    chars += sum((len(w) + 1) * n for w, n in words.items())
    flat = table.ravel()
    at = np.flatnonzero(flat)
    if not len(at):
        return
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([chars], pa.int64())], ["cell", "n"])
    for i in range(0, len(at), 50_000):
        part = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(flat[part].astype(np.int64))], ["cell", "n"])


def _trained(texts: DataFrame, make_clean) -> tuple[np.ndarray, float]:
    """(table, characters) of all clean records: at most 2 x CELLS counts reach the driver."""
    counted = texts.mapInArrow(lambda it: _count(it, make_clean()), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = counted.column("cell").to_numpy(), counted.column("n").to_numpy()
    table = np.zeros(2 * CELLS, np.float32)
    table[cells[cells >= 0]] = n[cells >= 0]
    return table.reshape(2, CELLS), float(n[cells < 0].sum())


def _wrongly_read(line: str) -> str | None:
    """A line garbled on purpose, by a pair of encodings that its own text picks."""
    pairs = [(x, y) for y in WRITTEN_IN for x in READ_AS if x != y]
    at = sum(map(ord, line)) % len(pairs)
    for x, y in (*pairs[at:], *pairs[:at]):
        try:
            t = line.encode(y).decode(x)
        except UnicodeError:
            continue
        if t != line:
            return t
    return None


def _gains(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(gain, was it garbled?, n): whole gains of the lines of clean-looking records, as they are and garbled on purpose."""
    found: Counter = Counter()
    for b in batches:
        for text in filter(looks_clean, b.column(0).to_pylist()):
            for line in _ENDS.split(text):
                if line.isascii() or (wrong := _wrongly_read(line)) is None:
                    continue
                for x, garbled in ((line, False), (wrong, True)):
                    found[min(60, int(model.step(x)[1])), garbled] += 1
    if found:
        keys, n = zip(*found.items(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array(n, pa.int64())], ["gain", "garbled", "n"])


def _margin(rows: list[tuple[int, bool, int]]) -> float:
    """The margin with the fewest wrong judgements: lines that stand and lose, garbled ones that stand; the middle of several."""
    if not rows:
        return MARGIN
    wrong = {m: sum(n for gain, garbled, n in rows if (gain < m) == garbled) for m in range(1, 61)}
    best = [m for m, w in wrong.items() if w == min(wrong.values())]
    return float(best[len(best) // 2])


def train(df: DataFrame, text: str) -> tuple[tuple[np.ndarray, float], float]:
    """((table, characters), margin): the model of the clean records of df, and the margin chosen on those held out."""
    texts = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
    held = F.pmod(F.xxhash64("t"), F.lit(HELD_OUT)) == 0
    kept = texts.where(~held)
    sc = df.sparkSession.sparkContext
    first = sc.broadcast(_trained(kept, lambda: lambda ts: [looks_clean(t) for t in ts]))

    def stands():
        model = Model(*first.value)

        def clean(ts: list[str]) -> list[bool]:
            good = [looks_clean(t) for t in ts]
            model.prepare(t for t, g in zip(ts, good, strict=True) if g and not t.isascii())
            return [g and (t.isascii() or not model.restore(t)[2]) for t, g in zip(ts, good, strict=True)]

        return clean

    counts = _trained(kept, stands)
    second = sc.broadcast(counts)
    high = texts.where(held & F.col("t").rlike("[^\\x00-\\x7F]"))
    rows = high.mapInArrow(lambda it: _gains(it, Model(*second.value)), "gain int, garbled boolean, n long").groupBy("gain", "garbled").agg(F.sum("n").alias("n")).collect()  # 122 at most
    return counts, _margin([tuple(r) for r in rows])


def restored(df: DataFrame, keys: list[str], text: str, margin: float | None = None, model: tuple | None = None) -> DataFrame:
    """(keys, restored_text, chains) of every row with other than ASCII characters that is garbled.

    NULL, empty and ASCII texts are no case. Repeated rows come out as often as
    they are there. restorable texts have chains; others (characters were
    replaced on reading) come out with what can be restored of them.
    """
    counts, chosen = model or train(df, text)
    least = chosen if margin is None else margin
    shared = df.sparkSession.sparkContext.broadcast(counts)
    kinds = dict(df.dtypes)
    high = df.select(*keys, F.col(text).alias("t")).where(F.col("t").rlike("[^\\x00-\\x7F]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            texts = b.column(len(keys)).to_pylist()
            model.prepare(texts)
            out = [model.restore(t, least) for t in texts]
            pick = pa.array([i for i, r in enumerate(out) if r[2]], pa.int64())
            rows = [out[i] for i in pick.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(pick) for i in range(len(keys))], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))],
                [*keys, "restored_text", "chains"],
            )

    return high.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", restored_text string, chains array<string>")

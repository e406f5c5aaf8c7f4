"""Per-document text statistics, and documents that are not running prose.

Method: mergeable quantile sketches (KLL) of each statistic per language turn
values into percentiles and robust z-scores, and the tails of the distributions
are flagged. Statistics are taken of whole documents and of their blocks
(paragraphs); a document is no prose when blocks in a tail hold more than half
of its characters. What is said over and over is looked for in the whole document,
so neither the length of the repeated line nor blank lines matter. The quantiles of a
language are blended with those of all texts, each statistic's by the number of its
own values in the language. Percentiles and z-scores of documents are strictly those
of their language.

A document may hold any number of blocks (definitions have one for each job), so the
sketches get the median of its blocks from each document: every block counts, and every
document counts once. A large part of a corpus may be no prose, so the scale of a tail is
that of the other side of the median, where prose lies: from the median to the third quartile for a low
tail, from the first quartile to the median for a high one.

Common words are learned for every language: those that make up at least COMMON of the
words in its lines that end like a sentence (at most 1 / COMMON words a language, so
their number is bounded). A block is held against its document's language; without one,
or where the words are clearly those of another, against the language whose words they are.
Text is read once for the words and once for statistics, whose rows are written to the
shared checkpoint folder, as they are needed for the sketches and for the scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.session import cut

#: A common word makes up at least this part of the words in a language's sentences.
COMMON = 0.002
#: Quantiles of all texts weigh as much as so many values of the language itself.
PRIOR_VALUES = 200
#: By so much the words of another language must be the more common ones for a text to be in it.
OTHER_LANGUAGE = 0.2
#: Statistic of blocks: (tail, distance in robust standard deviations, least scale).
TAILS = {
    "common_share": ("low", 2.5, 0.06),
    "symbol_ratio": ("high", 5.0, 0.006),
    "digit_ratio": ("high", 5.0, 0.03),
    "word_length": ("high", 5.0, 0.7),
    "marker_share": ("high", 4.0, 0.1),
    "top_pair_share": ("high", 5.0, 0.02),
    "log_words_a_part": ("low", 2.3, 0.25),
    "repeated_share": ("high", 5.0, 0.1),
}
#: Shares of words vary by chance in short texts: their variance is added to the scale.
SAMPLED = ("common_share",)
#: Values beyond which a block is in the tail however many blocks of its language are so.
SURE = {"repeated_share": 0.5}
#: Of words a part (between line ends, commas, full stops), so many parts of so many words count along, as short texts have few.
USUAL_PARTS, USUAL_WORDS = 1.0, 8.0
#: So many times in a row (lines: anywhere in the document) is over and over. Texts of a few set sentences repeat one by chance fewer times.
REPEATS = 8
#: Size of the sketches: the rank of a quantile is off by about 2 / SKETCH.
SKETCH = 4096
#: Statistics of documents.
STATS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")
_ENDS = "\r\n|[\r\n\u0085\u2028\u2029]"
_MARKS = "\u0300-\u036f"
_IDEOGRAPHS = "\u3041-\u30ff\u3400-\u9fff"
_LINE = re.compile(_ENDS)
_BLOCK = re.compile(rf"(?:{_ENDS})\s*(?:{_ENDS})")
_WORD = re.compile(rf"[^\W\d_]+(?:[{_MARKS}'’]+[^\W\d_]+)*")
_MARKER = re.compile(r"\s*(?:[-*•–·+▪◦‣]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s")
_SYMBOL = re.compile(rf"[^\w\s{_MARKS}.,;:!?'\"“”„‘’«»()…。、！？「」『』（）–—-]|_")
_PART = re.compile(_ENDS + r"|[.!?…。、！？;,/|•·]\s|[。、！？]| [/|–—-]+ ")
_PART_WITH_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"[\d_]")
_ENDED = re.compile(r"[.!?…。！？:;][\"'”’»)」』]*\s*$")
_CJK = re.compile(f"[{_IDEOGRAPHS}]")
_UNIT = re.compile(f"[{_IDEOGRAPHS}]|[^{_IDEOGRAPHS}]+")
# for the JVM: lines that end like a sentence, and the words or ideographs in them
_J_SENTENCES = r"(?m)^(.*[.!?…。！？][\"'”’»)」』]*)\s*$"
_J_WORDS = r"([\u3041-\u30ff\u3400-\u9fff]|(?:(?![\u3041-\u30ff\u3400-\u9fff])\p{L})+(?:[\u0300-\u036f'’]+(?:(?![\u3041-\u30ff\u3400-\u9fff])\p{L})+)*)"


def common_words(docs: DataFrame, text: str, lang: str, least: float = COMMON) -> DataFrame:
    """(lang, words): the words that make up at least `least` of the words in each language's sentences.

    Sentences are lines that end like one; of Chinese and Japanese each character is a word. Rows
    without language add to none. A language without sentences has no row.
    """
    sentences = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(_J_SENTENCES), 1), "\n")
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), sentences.alias("s"))
    counts = rows.select("lang", F.explode(F.regexp_extract_all("s", F.lit(_J_WORDS), 1)).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("whole"))
    kept = counts.join(sizes, "lang").where(F.col("n") >= F.col("whole") * least)
    return kept.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("words"))


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _low_median(values: list[float | None]) -> float | None:
    """The lower median of the values that there are."""
    there = sorted(v for v in values if v is not None)
    return there[(len(there) - 1) // 2] if there else None


def _units(words: list[str]) -> list[str]:
    """Chinese and Japanese have no blanks between words: each character of theirs counts as one."""
    if not _CJK.search(" ".join(words)):
        return words
    return [u for w in words for u in ((w,) if w.isascii() else _UNIT.findall(w))]


def _in_a_row(tokens: list[str], times: int = REPEATS) -> np.ndarray:
    """Whether each token stands in a sequence that follows itself until it is there so many times."""
    n = len(tokens)
    marked = np.zeros(n, bool)
    # what is there so many times in a row has its pairs of tokens one time fewer at least
    if n < times or max(Counter(pairwise(tokens)).values()) < times - 1:
        return marked
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, n)
    # a period is the distance of a pair of tokens to the same pair before it, that many times
    pair = ids[:-1] * len(number) + ids[1:]
    order = np.argsort(pair, kind="stable")
    ordered = pair[order]
    distance = np.diff(order)[ordered[1:] == ordered[:-1]]
    if len(distance) < times - 2:
        return marked
    for p in np.flatnonzero(np.bincount(distance)[: n // times + 1] >= times - 2).tolist():
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids[p:] == ids[:-p], [0]))))
        for begin, end in zip(edges[::2], edges[1::2], strict=True):
            if end - begin >= (times - 1) * p:
                marked[begin : end + p] = True
    return marked


def repeated_shares(parts: list[str], words: list[list[str]]) -> list[float]:
    """Of each block (with its words in lower case) of a document, the share of its letters that stand in words or lines which the document has over and over.

    Blank lines, line breaks, digits, case and punctuation between the words do
    not count; of Chinese and Japanese each character is a word.
    """
    if sum(len(_CJK.findall(p)) for p in parts) > 0.3 * sum(map(len, parts)):
        words = [_units(ws) for ws in words]
    marked = _in_a_row([w for ws in words for w in ws])
    lines = [[x for x in map(str.strip, _LINE.split(p.lower())) if x] for p in parts]
    often = {x for x, n in Counter(x for xs in lines for x in xs).items() if n >= REPEATS} if sum(map(len, lines)) >= REPEATS else set()
    if not often and not marked.any():
        return [0.0] * len(parts)
    out, at = [], 0
    for ws, xs in zip(words, lines, strict=True):
        sizes = np.fromiter(map(len, ws), np.int64, len(ws))
        in_a_row = _share(int(sizes[marked[at : at + len(ws)]].sum()), int(sizes.sum()))
        out.append(max(in_a_row, _share(sum(len(x) for x in xs if x in often), sum(map(len, xs)))))
        at += len(ws)
    return out


class Measure:
    """Statistics of texts and blocks, given each language's common words."""

    def __init__(self, common: dict[str, frozenset[str]]) -> None:
        self.common = common

    def language(self, units: list[str], lang: str) -> tuple[str, float | None]:
        """(language, share of its common words): the text's own unless the words are clearly another's.

        Without words, or without common words of any language, the share is None.
        """
        n = len(units)
        own = self.common.get(lang)
        if not n or not self.common:
            return lang, None
        share = _share(sum(map(own.__contains__, units)), n) if own is not None else None
        if share is not None and share + OTHER_LANGUAGE > 1:
            return lang, share
        best, other = lang, share if share is not None else 0.0
        ahead = OTHER_LANGUAGE if share is not None else 0.0
        for name, ws in self.common.items():
            x = _share(sum(map(ws.__contains__, units)), n)
            if x > other + ahead:
                best, other, ahead = name, x, 0.0
        return (lang, share) if best == lang else (best, other)

    def document(self, text: str, lang: str) -> tuple:
        words = [w.lower() for w in _WORD.findall(text)]
        lines = [x for x in _LINE.split(text) if x.strip()]
        return (
            len(words), _share(sum(map(len, words)), len(words)), _share(len(_SYMBOL.findall(text)), len(text)),
            _share(sum(bool(_ENDED.search(x)) for x in lines), len(lines)), self.language(_units(words), lang)[1] or 0.0,
        )

    def blocks(self, text: str, lang: str) -> list[tuple]:
        """block() of each block of a text, followed by the text's language and medians in its first row, NULL in others."""
        parts = blocks(text)
        words = [_WORD.findall(p.lower()) for p in parts]
        if lang not in self.common:
            lang = self.language([u for ws in words for u in _units(ws)], lang)[0]
        rows = [self.block(p, ws, r, lang) for p, ws, r in zip(parts, words, repeated_shares(parts, words), strict=True)]
        medians = [_low_median([r[i] for r in rows]) for i in range(3, 3 + len(TAILS))]
        return [(*r, lang, *medians) if i == 0 else (*r, None, *[None] * len(TAILS)) for i, r in enumerate(rows)]

    def block(self, text: str, words: list[str], repeated: float, lang: str) -> tuple:
        """language, chars, words, and the statistics in TAILS; NULL where a block has too few words to tell."""
        chars = len("".join(text.split()))
        lines = [x for x in _LINE.split(text) if x.strip()]
        units = _units(words)
        n = len(units)
        lang, share = self.language(units, lang)
        if not n and self.common:
            share = 0.0
        parts = sum(map(bool, map(_PART_WITH_LETTER.search, _PART.split(text))))
        top = max(Counter(pairwise(units)).values()) if n >= 12 else 0
        return (
            lang, chars, n, share,
            _share(len(_SYMBOL.findall(text)), chars), _share(len(_DIGIT.findall(text)), chars),
            _share(sum(map(len, units)), n),
            _share(sum(map(bool, map(_MARKER.match, lines))), len(lines)),
            (top - 1) / (n - 1) if n >= 12 else None,
            math.log((n + USUAL_PARTS * USUAL_WORDS) / (parts + USUAL_PARTS)) if n else None,
            repeated,
        )


def blocks(text: str) -> list[str]:
    """Paragraphs of a text: parts between blank lines."""
    return [b for b in _BLOCK.split(text) if b.strip()]


_BLOCK_SCHEMA = "chars long, words long, " + ", ".join(f"{s} double" for s in TAILS) + ", text_lang string, " + ", ".join(f"median_{s} double" for s in TAILS)
_STATS_SCHEMA = "n_words long, mean_word_length double, symbol_ratio double, punctuated_line_share double, common_word_share double"


def _measured(docs: DataFrame, key: str, text: str, lang: str, of_blocks: bool) -> DataFrame:
    """Statistics of each text, or of each of its blocks, with key and language."""
    lists = {r["lang"]: frozenset(r["words"]) for r in common_words(docs, text, lang).collect()}  # at most 1 / COMMON words a language
    shared = docs.sparkSession.sparkContext.broadcast(lists)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(lang), F.lit("*")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    types = [pa.string(), pa.int64(), *[pa.float64()] * 4]
    if of_blocks:
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * len(TAILS), pa.string(), *[pa.float64()] * len(TAILS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(shared.value)
        for b in batches:
            at, out = [], []
            for i, (t, own) in enumerate(zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)):
                found = measure.blocks(t, own) if of_blocks else [(own, *measure.document(t, own))]
                at += [i] * len(found)
                out += found
            if not at:
                continue
            take = pa.array(at, pa.int64())
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)]
            names = ["chars", "words", *TAILS, "text_lang", *[f"median_{s}" for s in TAILS]] if of_blocks else list(STATS)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *cols], ["key", "lang", *names])

    return rows.mapInArrow(run, f"key {kind}, lang string, " + (_BLOCK_SCHEMA if of_blocks else _STATS_SCHEMA))


def sketches(rows: DataFrame, stats: list[str]) -> DataFrame:
    """(lang, sketch of each statistic), for each language and, under '*', for all rows; merged map-side."""
    merged = [F.kll_sketch_agg_double(s, SKETCH).alias(s) for s in stats]
    return rows.where("lang != '*'").groupBy("lang").agg(*merged).unionByName(rows.agg(*merged).select(F.lit("*").alias("lang"), *stats))


def _with_sketches(rows: DataFrame, values: DataFrame, stats: list[str], columns: dict[str, tuple[str, Column]], prior: float) -> DataFrame:
    """rows with arrays (name: statistic, quantiles) from the sketches of their language over the values.

    The arrays of all rows count as `prior` values beside the n that the
    language has of the statistic: (n * own + prior * all) / (n + prior). Those
    of a language without any value are the ones of all rows.
    """
    table = sketches(values, stats)
    table = table.select("lang", *[c.alias(name) for name, (_, c) in columns.items()], *[F.kll_sketch_get_n_double(s).cast("double").alias(f"n_{s}") for s in stats])
    whole = table.where("lang = '*'").select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_all_{c}") for c in columns])
    blended = table.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")  # one row
    for c, (s, _) in columns.items():
        own = F.col(f"n_{s}") / (F.col(f"n_{s}") + prior)
        mixed = F.zip_with(c, f"_all_{c}", lambda x, y: own * x + (1 - own) * y)  # noqa: B023  # called at once
        blended = blended.withColumn(c, F.coalesce(F.when(F.col("lang") == "*", F.col(c)).otherwise(mixed), F.col(f"_all_{c}")))
    return rows.join(blended.select("lang", *columns), "lang", "left")


def _quantiles(s: str) -> Column:
    """First quartile, median and third quartile; NULL of an empty sketch."""
    empty = F.kll_sketch_get_n_double(s) == 0
    return F.when(~empty, F.kll_sketch_get_quantile_double(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))


def not_prose(docs: DataFrame, key: str, text: str, lang: str, tails: dict = TAILS, half: float = 0.5) -> DataFrame:
    """(key, tail_share) of each document of which blocks in a tail hold more than half of the characters.

    NULL, empty and blank texts are no case. Of rows with one key the blocks count together.
    """
    rows = cut(_measured(docs, key, text, lang, True))
    values = rows.where("text_lang is not null").select(F.col("text_lang").alias("lang"), *[F.col(f"median_{s}").alias(s) for s in tails])
    scored = _with_sketches(rows, values, list(tails), {f"q_{s}": (s, _quantiles(s)) for s in tails}, PRIOR_VALUES)
    flag = F.lit(False)
    for s, (side, far, least) in tails.items():
        q = F.col(f"q_{s}")
        scale = F.greatest((q[2] - q[1] if side == "low" else q[1] - q[0]) / 0.6745, F.lit(least))
        if s in SAMPLED:
            p = F.least(F.greatest(q[1], F.lit(0.05)), F.lit(0.95))
            scale = F.sqrt(scale * scale + p * (1 - p) / F.greatest("words", F.lit(1)))
        z = (F.col(s) - q[1]) / scale
        flag = flag | F.coalesce(z < -far if side == "low" else z > far, F.lit(False))
        if s in SURE:
            flag = flag | F.coalesce(F.col(s) > SURE[s], F.lit(False))
    by_doc = scored.groupBy("key").agg((F.sum(F.when(flag, F.col("chars")).otherwise(0)) / F.sum("chars")).alias("tail_share"))
    return by_doc.where(F.col("tail_share") > half).withColumnRenamed("key", key)


def statistics(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, statistics, and of each its percentile and robust z-score within the language) of every text that isn't NULL."""
    rows = cut(_measured(docs, key, text, lang, False).withColumn("n_words", F.col("n_words").cast("double")))
    grid = F.array(*[F.lit(i / 100) for i in range(101)])
    columns = {f"k_{s}": (s, F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, grid))) for s in STATS}
    columns |= {f"q_{s}": (s, _quantiles(s)) for s in STATS}
    scored = _with_sketches(rows, rows, list(STATS), columns, 0.0)
    out = [F.col("key").alias(key), F.when(F.col("lang") != "*", F.col("lang")).alias("lang")]
    for s in STATS:
        q = F.col(f"q_{s}")
        scale = F.greatest((q[2] - q[0]) / 1.349, F.lit(1e-3))
        value = F.col(s)
        below = F.size(F.filter(f"k_{s}", lambda x: x <= value))  # noqa: B023  # of the 101 percentiles
        out += [F.col(s), F.greatest(below - 1, F.lit(0)).alias(f"{s}_percentile"), ((F.col(s) - q[1]) / scale).alias(f"{s}_z")]
    return scored.select(*out)

"""Texts that lost their end, by a backward character n-gram model of how texts end.

For the context that ends at a position (read backward from it) the model counts how often it occurs in the corpus and
how often a text ends there. A finished text ends in a context where texts end; a cut one in a context that the corpus
continues. Contexts are kept in two alphabets: the characters themselves, and their shape (words by the case of
their first letter, digit runs, other characters as they are), which knows endings whose words are rare, such as
signatures. The log-odds of ending are
smoothed from short to long contexts; the better of the two alphabets counts, against a threshold per language and
column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deuceframe.session import Scratch

#: Lengths of the contexts, in characters and in units of shape.
CHAR_ORDERS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17)
SHAPE_ORDERS = (1, 2, 3, 4, 6, 8)
N_CHAR, N_ORDERS = len(CHAR_ORDERS), len(CHAR_ORDERS) + len(SHAPE_ORDERS)
PAD = max(CHAR_ORDERS)
#: Weight of the shorter context's estimate, in occurrences.
SMOOTHING = (2.0, 4.0)
#: Bits of the filter (of the contexts that end a text) for each such context, and at most (as powers of two). Beyond, the
#: contexts are counted in several passes, each with a filter for its share of them.
BITS_EACH, FILTER_BITS = 16, 28
#: Contexts that end more than this share of the texts are joined by broadcast; there are at most N_ORDERS / share.
HOT_SHARE = 1 / 2000
#: What transport puts behind a cut: ellipses, "more" marks, broken characters, beginnings of entities and tags.
MARKS = re.compile(
    r"(?:\s*(?:\[more\]|\[\.\.\.\]|…|\.\.\.|�|&[a-z#0-9]{0,6};?|</?[a-z]{0,8}\s*/?>?|[<(\[{])\s*)+$"
)
#: A text is judged with its mark (its author put it there) if this many other texts have the same mark behind the same
#: characters, as many as the order says, and if at least this share of all places with these characters ends so. The
#: share is what tells an author's phrase from a mark that transport put behind many cuts, however many texts there are.
MARK_CONTEXT, MARK_TEXTS, MARK_SHARE = CHAR_ORDERS.index(8), 3, 0.1
#: Ends and steps of the histograms of log-odds (values beyond count at the ends), the weight of the pooled one in each
#: group's, and how deep a valley must be, against the lower of the heights beside it, to be one.
LOW, HIGH, BIN = -30.0, 15.0, 0.25
POOLED_WEIGHT = 200.0
VALLEY = 0.25
MEMORY_ROWS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_UPPER, _LOWER, _DIGIT, _SYMBOL = 65, 97, 57, 35
_JOINERS = np.array([ord(c) for c in "-'’"], np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolling(codes: np.ndarray, orders: tuple[int, ...], first: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the order, hash of the context that ends at each position of `codes`)."""
    n = len(codes)
    h, power = np.zeros(n, np.uint64), 1
    for k in range(1, max(orders) + 1):
        shifted = np.zeros(n, np.uint64)
        shifted[k - 1 :] = codes[: n - k + 1] + np.uint64(7)
        h = h + shifted * np.uint64(power)
        power = power * _BASE % 2**64
        if k in orders:
            yield first + orders.index(k), _mix(h * np.uint64(2 * k + 1) + np.uint64(first))


def _joined(texts: list[str]) -> np.ndarray:
    """The characters of all texts, each text after PAD marks of its start."""
    return np.frombuffer(("\x01" * PAD).join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32)


def _shape(chars: np.ndarray) -> np.ndarray:
    kinds, where = np.unique(chars, return_inverse=True)
    classes = np.empty(len(kinds), np.uint64)
    for i, code in enumerate(kinds):
        c = chr(code)
        if c.isalpha():
            classes[i] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            classes[i] = _DIGIT
        else:
            classes[i] = _SYMBOL if code > 0x2100 or c in "½‒—–" else code
    return classes[where]


def char_contexts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: its number, the hashes at all positions, and the place of each text's last one (-1: none)."""
    chars = _joined(texts)
    last = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)) + PAD) - 1
    real = chars != 1
    for j, h in _rolling(chars.astype(np.uint64), CHAR_ORDERS, 0):
        yield j, h[real], np.cumsum(real)[last] - 1


def shape_contexts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same in units of shape."""
    chars = _joined(texts)
    last = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)) + PAD) - 1
    classes = _shape(chars)
    letters = (classes == _UPPER) | (classes == _LOWER)
    inside = np.zeros(len(chars), bool)  # hyphens and apostrophes between letters belong to the word
    inside[1:-1] = np.isin(chars[1:-1], _JOINERS) & letters[:-2] & letters[2:]
    letters |= inside
    digits = classes == _DIGIT
    keep = np.concatenate(([True], ~((letters[1:] & letters[:-1]) | (digits[1:] & digits[:-1]))))
    units = classes[keep]
    last_unit = np.cumsum(keep)[last] - 1
    real = units != 1
    for j, h in _rolling(units, SHAPE_ORDERS, N_CHAR):
        yield j, h[real], np.cumsum(real)[last_unit] - 1


def contexts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if texts:
        yield from char_contexts(texts)
        yield from shape_contexts(texts)


def _end(text: str) -> str:
    """As much of the end as its shape needs: every blank is a unit of its own."""
    return text[-200:] if text.count(" ", max(0, len(text) - 200)) > max(SHAPE_ORDERS) else text


def strip_mark(text: str) -> str:
    return MARKS.sub("", text).rstrip()


def _bare(text: str, tail: str) -> tuple[str, str]:
    """The end of the text without its mark, and the mark."""
    bare = strip_mark(tail)
    if len(bare) < len(tail) < len(text) and bare.count(" ") <= max(SHAPE_ORDERS):
        bare = strip_mark(text)
        return _end(bare), text[len(bare) :]
    return bare, tail[len(bare) :]


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash of the text, contexts of the end, contexts of the end without its mark or null, the mark and what
    stands before it or null)."""
    for batch in batches:
        ids, texts = batch.column(0), [(t or "").replace("\x01", " ").rstrip() for t in batch.column(2).to_pylist()]
        keep = [i for i, t in enumerate(texts) if t]
        if not keep:
            continue
        tails = [_end(texts[i]) for i in keep]
        bare, mark = zip(*[_bare(texts[i], t) for t, i in zip(tails, keep, strict=True)], strict=True)
        size = CHAR_ORDERS[MARK_CONTEXT]
        marks = [("\x01" * size + b)[-size:] + m if b and m else None for b, m in zip(bare, mark, strict=True)]
        rows = []
        for part in (tails, [b if b and b != t else "" for b, t in zip(bare, tails, strict=True)]):
            at = [i for i, t in enumerate(part) if t]
            table = np.zeros((len(part), N_ORDERS), np.uint64)
            if at:
                some = [part[i] for i in at]
                for j, h, last in chain(char_contexts([t[-PAD:] for t in some]), shape_contexts(some)):
                    table[at, j] = h[last]
            rows.append([list(r) if part[i] else None for i, r in enumerate(table.view(np.int64).tolist())])
        take = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(take),
                batch.column(1).take(take),
                pa.array(rows[0], pa.list_(pa.int64())),
                pa.array(rows[1], pa.list_(pa.int64())),
                pa.array(marks, pa.string()),
            ],
            ["doc_id", "text_hash", "ending", "bare", "mark"],
        )


def _count_contexts(filter_bits: np.ndarray):
    mask = np.uint64(8 * len(filter_bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(N_ORDERS)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for j, parts in enumerate(held):
                if parts:
                    hashes = np.concatenate([p[0] for p in parts])
                    unique, where = np.unique(hashes, return_inverse=True)
                    n = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(unique), j, np.int32)), pa.array(unique.view(np.int64)), pa.array(n)],
                        ["j", "h", "n"],
                    )

        for batch in batches:
            texts = [t for t in ((t or "").replace("\x01", " ").rstrip() for t in batch.column(0).to_pylist()) if t]
            while texts:
                chars = cut = 0
                while cut < len(texts) and (chars < 1_000_000 or not cut):
                    chars, cut = chars + len(texts[cut]), cut + 1
                for j, h, _ in contexts(texts[:cut]):
                    low = h & mask
                    found = h[(filter_bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                    unique, n = np.unique(found, return_counts=True)
                    held[j].append((unique, n))
                    size += len(unique)
                texts = texts[cut:]
            if size > MEMORY_ROWS:
                yield from flush()
                held, size = [[] for _ in range(N_ORDERS)], 0
        yield from flush()

    return run


def _filters(endings: DataFrame) -> Iterator[tuple[np.ndarray, int, int]]:
    """(bits, number of passes, pass): the filters of the contexts that end a text, one for each pass: at most 2 ** FILTER_BITS bits (32 MB) come to the
    driver for each, whatever the number of texts, and at most one bit in BITS_EACH is set."""
    h = endings.select(F.explode(F.concat("ending", F.coalesce("bare", F.array()))).alias("h"))
    need = BITS_EACH * h.agg(F.approx_count_distinct("h").alias("n")).first().n
    size = min(max(int(need - 1).bit_length(), 16), FILTER_BITS) if need else 16
    passes = max(1, -(-need // (1 << FILTER_BITS)))
    bit = F.col("h").bitwiseAND(F.lit((1 << size) - 1))
    for number in range(passes):
        mine = h if passes == 1 else h.where(F.pmod(F.shiftright("h", 32), F.lit(passes)) == number)
        words = (
            mine.select(F.shiftright(bit, 5).cast("int").alias("word"), F.expr("shiftleft(1L, cast(h & 31 as int))").alias("v"))
            .groupBy("word")
            .agg(F.bit_or("v").alias("v"))
            .toPandas()
        )
        bits = np.zeros(1 << (size - 5), np.uint32)
        bits[words.word.to_numpy()] = words.v.to_numpy().astype(np.uint32)
        yield bits.view(np.uint8), passes, number


def _log_odds(n: np.ndarray, ends: np.ndarray, orders: range, prior: float, weight: float, own_end: int) -> np.ndarray:
    """Of ending, from the shortest context to the longest; own_end: 1 if the text itself is among the ends."""
    p = np.full(len(n), prior)
    last = np.full(len(n), np.inf)
    for k, j in enumerate(orders):
        nn, ee = np.maximum(n[:, j] - 1, 0), np.maximum(ends[:, j] - own_end, 0)
        news = (nn * 3 <= last) | ((nn >= 5) & (nn * 1.4 <= last)) | (k == 0)
        use = (nn > 0) & news
        p = np.where(use, (ee + weight * p) / (nn + weight), p)
        last = np.where(use, nn, last)
    p = np.clip(p, 1e-12, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def _score(priors: tuple[float, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            def table(column: str) -> np.ndarray:
                return np.array([np.zeros(N_ORDERS) if x is None else x for x in pdf[column]], float).reshape(-1, N_ORDERS)

            n, ends = table("n"), table("ends")
            chars, shapes = range(N_CHAR), range(N_CHAR, N_ORDERS)

            def best(n: np.ndarray, ends: np.ndarray, own: int) -> np.ndarray:
                return np.maximum(
                    _log_odds(n, ends, chars, priors[0], SMOOTHING[0], own),
                    _log_odds(n, ends, shapes, priors[1], SMOOTHING[1], own),
                )

            whole = best(n, ends, 1)
            marked = pdf["marked"].to_numpy(bool)
            n_bare = table("n_bare")
            bare = best(n_bare, table("ends_bare"), 0)
            authors = (pdf["mark_texts"] - 1 >= MARK_TEXTS) & (pdf["mark_rows"] >= MARK_SHARE * n_bare[:, MARK_CONTEXT])
            yield pd.DataFrame({"doc_id": pdf.doc_id, "log_odds": np.where(marked & ~authors, bare, whole)})

    return run


def language(lang: Column) -> Column:
    """The language's two letters; 'und' where none is given."""
    low = F.lower(F.trim(lang))
    three = F.create_map(*[F.lit(x) for x in ("spa", "es", "eng", "en", "fra", "fr", "fre", "fr", "deu", "de", "ger", "de")])
    return F.when(low.isNull() | (low == "") | (low == "und"), "und").otherwise(
        F.coalesce(three[low], F.regexp_extract(low, "^[a-z]{1,3}", 0))
    )


def valley(counts: np.ndarray) -> int | None:
    """The bin of the deepest valley left of the histogram's largest height below its median, or None if it has none.

    A valley's depth is its density against the lower of the greatest densities on both sides, each with one count more,
    so that a few scattered texts make none; of equal ones the one next to the height counts.
    """
    density = np.convolve(counts, (0.25, 0.5, 1.0, 0.5, 0.25), "same")
    median = int(np.searchsorted(np.cumsum(counts), counts.sum() / 2))
    top = int(np.argmax(density[: median + 1]))
    if top < 2:
        return None
    before, after = np.maximum.accumulate(density)[:top], np.maximum.accumulate(density[top::-1])[::-1][:top]
    depth = np.round((density[:top] + 1) / (np.minimum(before, after) + 1), 6)
    best = top - 1 - int(np.argmin(depth[::-1]))
    return best if depth[best] <= VALLEY else None


def _thresholds(scored: DataFrame, otherwise: float) -> DataFrame:
    """(language, source, threshold): the valley between the cut and the finished texts of each group.

    A group's histogram is filled up with the pooled one, so that small groups follow all texts; where neither has a
    valley, the threshold is `otherwise`.
    """
    width = int((HIGH - LOW) / BIN)
    at = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.floor((F.col("log_odds") - LOW) / BIN))).cast("int")
    counts = scored.groupBy("language", "source", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    pooled = counts.groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # as many rows as bins
    base = np.zeros(width)
    base[pooled.bin.to_numpy()] = pooled.n
    common = valley(base)
    level = otherwise if common is None else LOW + (common + 0.5) * BIN
    share = base * (POOLED_WEIGHT / max(base.sum(), 1))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = share.copy()
        own[pdf.bin.to_numpy()] += pdf.n.to_numpy()
        best = valley(own)
        return pd.DataFrame({"language": [key[0]], "source": [key[1]], "threshold": [level if best is None else LOW + (best + 0.5) * BIN]})

    return counts.groupBy("language", "source").applyInPandas(one, "language string, source string, threshold double")


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, language, source, log_odds, threshold, is_cut) of each text that is not null, empty or blank.

    docs: doc_id, text, lang, source; doc_id is unique (rows with a repeated one would be judged together). Null
    languages form a group of their own, as null sources do. Equal texts end alike and count once as evidence, and a
    text is no evidence for its own ending. Texts of any length are counted whole. An empty table gives an empty table.
    Text that is cut just behind a sentence is not found: it ends in no word and no sentence.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "truncation")
    given = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("length(trim(text)) > 0")
    kind = docs.schema["doc_id"].dataType.simpleString()
    endings = scratch.write(
        given.mapInArrow(
            _endings, f"doc_id {kind}, text_hash bigint, ending array<bigint>, bare array<bigint>, mark string"
        ),
        "endings",
    )
    counts = None
    for bits, passes, number in _filters(endings):
        shared = spark.sparkContext.broadcast(bits)
        counter = lambda batches, shared=shared: _count_contexts(shared.value)(batches)
        found = docs.select("text").where("length(trim(text)) > 0").mapInArrow(counter, "j int, h bigint, n bigint")
        if passes > 1:
            found = found.where(F.pmod(F.shiftright("h", 32), F.lit(passes)) == number)
        counts = found if counts is None else counts.unionByName(found)
    counts = counts.groupBy("j", "h").agg(F.sum("n").alias("n"))
    long = endings.select("doc_id", "text_hash", F.posexplode("ending").alias("j", "h"))
    ends = (  # copies are reduced before the contexts meet
        long.groupBy("j", "h", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("j", "h").agg(F.count(F.lit(1)).alias("ends"), F.sum("copies").alias("copies"))
    )
    known = counts.join(ends, ["j", "h"], "left").select(
        "j",
        "h",
        (F.col("n") - F.coalesce("copies", F.lit(0)) + F.coalesce("ends", F.lit(0))).alias("n"),
        F.coalesce("ends", F.lit(0)).alias("ends"),
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )
    known = scratch.write(known, "known")
    totals = known.where(F.col("j").isin(0, N_CHAR)).groupBy("j").agg(
        F.sum("n").alias("n"), F.sum("ends").alias("e"), F.sum("copies").alias("c")
    )
    sums = {r.j: r for r in totals.collect()}
    priors = tuple(
        (sums[j].e / max(sums[j].n, 1)) if j in sums and sums[j].e else 0.005 for j in (0, N_CHAR)
    )
    # of all positions, not only those whose context ends some text: both differ little at the shortest order
    n_texts = max((r.c for r in sums.values()), default=0)
    hot = known.where(F.col("copies") > max(1000.0, n_texts * HOT_SHARE))
    asked = endings.select("doc_id", F.lit(False).alias("is_bare"), F.posexplode("ending").alias("j", "h")).unionByName(
        endings.where("bare is not null").select(
            "doc_id", F.lit(True).alias("is_bare"), F.posexplode("bare").alias("j", "h")
        )
    )
    cold = asked.join(F.broadcast(hot.select("j", "h")), ["j", "h"], "left_anti").join(known, ["j", "h"])
    found = asked.join(F.broadcast(hot), ["j", "h"]).unionByName(cold)
    # the marks come as one more order: texts and rows that end in the same mark behind the same characters
    with_mark = endings.where("mark is not null")
    shared_marks = (
        with_mark.groupBy("mark").agg(F.count_distinct("text_hash").alias("ends"), F.count(F.lit(1)).alias("n"))
        .where(F.col("ends") > MARK_TEXTS)
    )
    found = found.unionByName(
        with_mark.select("doc_id", "mark", F.lit(True).alias("is_bare"), F.lit(N_ORDERS).alias("j"), F.lit(0).cast("bigint").alias("h"))
        .join(shared_marks, "mark").drop("mark"),
        allowMissingColumns=True,
    )
    cells = found.groupBy("doc_id").agg(
        F.max("is_bare").alias("marked"),
        *[F.coalesce(F.max(F.when(F.col("j") == N_ORDERS, F.col(c))), F.lit(0)).alias(name) for c, name in (("n", "mark_rows"), ("ends", "mark_texts"))],
        *[
            F.array(*[F.coalesce(F.max(F.when((F.col("j") == j) & (F.col("is_bare") == bare), F.col(c))), F.lit(0)) for j in range(N_ORDERS)]).alias(name)
            for c, bare, name in (
                ("n", False, "n"), ("ends", False, "ends"), ("n", True, "n_bare"), ("ends", True, "ends_bare")
            )
        ],
    )
    scores = cells.mapInPandas(_score(priors), f"doc_id {kind}, log_odds double")
    about = docs.select("doc_id", language(F.col("lang")).alias("language"), F.coalesce("source", F.lit("")).alias("source"))
    scored = scratch.write(scores.join(about, "doc_id"), "scored")
    # where the texts show no valley: what ends in a context that ends more rarely than any place in a text
    levels = scratch.write(_thresholds(scored, float(np.log(priors[0]))), "levels")
    scratch.keep_only("scored", "levels")
    return scored.join(levels, ["language", "source"], "left").select(
        "doc_id",
        "language",
        "source",
        "log_odds",
        "threshold",
        (F.col("log_odds") < F.col("threshold")).alias("is_cut"),
    )


def truncation_report(judged: DataFrame) -> DataFrame:
    """(source, texts, cut, share): how often each source truncates."""
    return judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("is_cut").alias("cut"),
        F.round(F.count_if("is_cut") / F.count(F.lit(1)), 6).alias("share"),
    )

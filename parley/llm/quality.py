"""Quality rules: text statistics and n-gram perplexity in language-specific bands.

The model is a modified Kneser-Ney model over 64 symbols.  Letters of ASCII have symbols of their own; characters beyond
ASCII are spelled by their UTF-8 bytes, so no two of them are alike.  Counts come from every text of the corpus; a language has at most 64 ** ORDER n-grams however large the corpus is, so one task can build its arrays and
every worker can map them.  An n-gram is looked up by its hash in a sorted array; the hash is a bijection of the packed
symbols, so different n-grams never meet.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from parley.llm.common import (flat_bytes, map_file, mixed, new_folder, partition_table, pieces, runs,
                               small_batches, stored, text_bytes, write_file)

ORDER = 4
WIDTH = 6
SYMBOLS = 1 << WIDTH
EDGE = 0  # before and after every text
NO_SYMBOL = 255  # bytes that UTF-8 never holds


def symbol_table() -> np.ndarray:
    """The symbol of each UTF-8 byte: letters of ASCII alone, its other characters by class.

    Bytes beyond ASCII keep all six bits they carry, counted down from 63: a first byte tells by them how many follow, so
    the symbols of different characters differ, and the first bytes of accented Latin letters share none with ASCII.
    """
    table = np.full(256, 58, np.uint8)  # other ASCII marks
    table[:32] = 63
    for k, group in enumerate((b" \t\n\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                               b"0123456789", b".,;:", b"'\"-()", b"!?")):
        for i, byte in enumerate(group):
            table[byte] = (1, 2 + i, 28 + i, 54, 55, 56, 57)[k]
    table[0x80:] = 63 - (np.arange(0x80, 0x100) & 0x3F)
    table[[0xC0, 0xC1, *range(0xF5, 0x100)]] = NO_SYMBOL
    return table


TABLE = symbol_table()
SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
MARKS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def language(column: str | Column) -> Column:
    """Codes of two or three letters; anything else is one language of its own, so there are few."""
    code = F.lower(column if isinstance(column, Column) else F.col(column))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise("und")


def packed_grams(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol and at the end of each text, and the number of them in each text."""
    symbols = TABLE[data]
    real = symbols != NO_SYMBOL
    count = np.diff(np.r_[0, np.cumsum(real)][ends])
    size = count + ORDER  # edges before, one after
    stop = np.cumsum(size)
    flat = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint32)
    inside = np.ones(len(flat), bool)
    starts = stop - size
    inside[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    counted = inside.copy()
    inside[stop - 1] = False
    flat[inside] = symbols[real]
    gram = flat.copy()
    for back in range(1, ORDER):
        gram[back:] |= flat[:-back] << np.uint32(WIDTH * back)
    return gram[counted], count + 1


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of (lang, text); every batch is counted before the shuffle."""
    small_batches(docs.sparkSession, 2000)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for piece in pieces(batch, 1):
                names = piece.column(0).to_numpy(zero_copy_only=False)
                grams, count = packed_grams(*flat_bytes(piece.column(1)))
                for name in np.unique(names):
                    own = np.sort(grams[np.repeat(names == name, count)])
                    first = runs(own)
                    found.setdefault(name, []).append((own[first], np.diff(np.r_[first, len(own)])))
            for name, parts in found.items():
                grams, n = (np.concatenate([p[k] for p in parts]) for k in range(2))
                order = np.argsort(grams)
                first = runs(grams[order])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(name, len(first)), pa.string()), pa.array(grams[order][first].astype(np.int32)),
                    pa.array(np.add.reduceat(n[order], first))], ["lang", "gram", "n"])

    return docs.mapInArrow(apply, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Discount of n-grams seen 0, 1, 2, and 3 or more times."""
    n1, n2, n3, n4 = (max(1, int((counts == k).sum())) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 0.95, 1.9, 2.85])


def smoothed(grams: np.ndarray, counts: np.ndarray, order: int = ORDER) -> list[dict[str, np.ndarray]]:
    """Modified Kneser-Ney arrays of each order from 1: packed n-grams with their log10 probability, and packed
    contexts with the log10 of the weight that they leave to the next lower order.

    Lower orders count in how many different places an n-gram continues, not how often.
    """
    levels: list[tuple[np.ndarray, np.ndarray]] = [(grams.astype(np.uint64), counts.astype(np.int64))]
    for k in range(order - 1, 0, -1):
        keys, of = np.unique(levels[0][0] & np.uint64((1 << WIDTH * k) - 1), return_counts=True)
        levels.insert(0, (keys, of.astype(np.int64)))
    out = []
    for k, (keys, n) in enumerate(levels, 1):
        contexts, at = np.unique(keys >> np.uint64(WIDTH), return_inverse=True)
        total = np.bincount(at, n)
        discount = _discounts(n)[np.minimum(n, 3)]
        left = np.bincount(at, discount) / total
        if k == 1:
            lower = np.full(len(keys), 1 / SYMBOLS)
        else:
            below = keys & np.uint64((1 << WIDTH * (k - 1)) - 1)
            lower = 10 ** out[-1]["p"][np.searchsorted(out[-1]["key"], below)]
        out.append({"key": keys, "p": np.log10((n - discount) / total[at] + left[at] * lower),
                    "context": contexts, "left": np.log10(np.maximum(left, 1e-12))})
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    return mixed(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class GramModel:
    """Sorted hash arrays of one language in one mapped file."""

    def __init__(self, uri: str):
        raw = map_file(uri)
        size = int.from_bytes(memoryview(raw)[:8], "little")
        self.levels = []
        at = 8 + size
        for level in json.loads(bytes(memoryview(raw)[8:at])):
            arrays = {}
            for name, kind, count in level:
                arrays[name] = np.frombuffer(raw, kind, count, at)
                at += arrays[name].nbytes
            self.levels.append(arrays)

    @staticmethod
    def write(uri: str, levels: list[dict[str, np.ndarray]]) -> None:
        head, blocks = [], []
        for level in levels:
            arrays = {}
            for key, value in (("key", "p"), ("context", "left")):
                h = hashed(level[key])
                order = np.argsort(h)
                arrays[key], arrays[value] = h[order], level[value][order].astype(np.float64)
            head.append([(n, a.dtype.str, len(a)) for n, a in arrays.items()])
            blocks += [a.tobytes() for a in arrays.values()]
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        write_file(uri, [len(text).to_bytes(8, "little"), text, *blocks])

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        h = hashed(wanted)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        return np.where(hit, values[at], 0.0), hit

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of the last symbol of each packed n-gram; unseen ones back off."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            level, own = self.levels[k - 1], grams[todo] & np.uint64((1 << WIDTH * k) - 1)
            p, hit = self._find(level["key"], level["p"], own)
            out[todo[hit]] += p[hit]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            out[todo] += self._find(level["context"], level["left"], own >> np.uint64(WIDTH))[0]
        out[todo] -= np.log10(SYMBOLS)
        return out


@lru_cache(maxsize=64)
def _model(uri: str) -> GramModel:
    return GramModel(uri)


def train(docs: DataFrame) -> dict[str, str]:
    """Count the n-grams of (lang, text) with Spark and write one model file for each language; URIs by language.

    There are at most some 18,000 languages (see ``language``), and a language has at most 64 ** ORDER n-grams.
    """
    folder = new_folder(docs.sparkSession, "ngrams")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = partition_table(batches)
        if rows is None:
            return
        names = rows.column("lang").to_numpy(zero_copy_only=False)
        grams, counts = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
        for name in np.unique(names):
            own = np.flatnonzero(names == name)
            own = own[np.argsort(grams[own])]
            uri = f"{folder}/{name}-{TaskContext.get().taskAttemptId()}.bin"
            GramModel.write(uri, smoothed(grams[own], counts[own]))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([uri])], ["lang", "uri"])

    files = stored(gram_counts(docs).repartition("lang").mapInArrow(apply, "lang string, uri string"), "models")
    return {r.lang: r.uri for r in files.collect()}


def log_probabilities(batch: pa.RecordBatch, names: int, texts: int, models: dict[str, str]
                      ) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probability and number of symbols of each text.

    Only the n-grams of the whole batch are held, so that each different one is looked up once.
    """
    parts = [packed_grams(*flat_bytes(piece.column(texts))) for piece in pieces(batch, texts)]
    if not parts:
        return np.zeros(0), np.zeros(0, np.int64)
    of = batch.column(names).to_numpy(zero_copy_only=False)
    rows = np.cumsum([0, *(len(count) for _, count in parts)])
    out = np.zeros(len(of))
    seen = np.zeros(1 << WIDTH * ORDER, bool)
    for name in np.unique(of):
        same = [of[a:b] == name for a, b in zip(rows[:-1], rows[1:])]
        for (grams, count), own in zip(parts, same):
            seen[grams[np.repeat(own, count)]] = True
        distinct = np.flatnonzero(seen).astype(np.uint32)
        seen[distinct] = False
        p = _model(models[name]).log10(distinct.astype(np.uint64))
        for (grams, count), own, start in zip(parts, same, rows):
            if own.any():
                size = count[own]
                score = p[np.searchsorted(distinct, grams[np.repeat(own, count)])]
                out[start + np.flatnonzero(own)] = np.add.reduceat(score, np.cumsum(size) - size)
    return out, np.concatenate([count for _, count in parts])


def repeated_words(words: list[list[bytes]], window: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of words which the text has twice or more."""
    size = np.array([len(w) for w in words], np.int64)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for own in words for w in own), np.int64, int(size.sum()))
    doc = np.repeat(np.arange(len(words)), size)
    n = len(ids) - window + 1
    if n < 1:
        return np.zeros(len(words), np.int64)
    at = np.flatnonzero(doc[:n] == doc[window - 1:])
    h = mixed(doc[at].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        h = mixed(h * np.uint64(31) + ids[at + k].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    first = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
    run = np.cumsum(first) - 1
    lead = at[order][np.flatnonzero(first)][run] if len(h) else at
    for k in range(window):
        if not np.array_equal(ids[at[order] + k], ids[lead + k]) or not np.array_equal(doc[at[order]], doc[lead]):
            raise RuntimeError("two windows share a hash")
    many = np.bincount(run, minlength=1)[run] > 1 if len(h) else np.zeros(0, bool)
    cover = np.zeros(len(ids) + 1, np.int64)
    hits = at[order][many]
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + window, -1)
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=len(words))


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][ends])


def measures(docs: DataFrame, models: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_grams, log10p) of (key, lang, text)."""
    small_batches(docs.sparkSession, 1000)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            score, count = log_probabilities(whole, 1, 2, models)
            at = 0
            for batch in pieces(whole, 2):
                texts = text_bytes(batch.column(2))
                words = [t.split() for t in texts]
                data, ends = flat_bytes(batch.column(2))
                lines = [[x for x in t.split(b"\n") if x.strip()] if b"\n" in t else () for t in texts]
                own = slice(at, at := at + batch.num_rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
                    pa.array(_sums(((data & 0xC0) != 0x80) & ~SPACES[data], ends)), pa.array(_sums(MARKS[data], ends)),
                    pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                    pa.array(repeated_words(words)), pa.array(count[own]), pa.array(score[own])], NAMES)

    NAMES = ["key", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_grams", "log10p"]
    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(apply, f"key {kind}, lang string, n_words long, word_chars long, n_symbols long, "
                                  "n_dup_lines long, n_repeat_words long, n_grams long, log10p double")


def _middle(bins: DataFrame, value: str, name: str) -> DataFrame:
    """(lang, name): the lower median of ``value`` over rows (lang, value, n)."""
    up = Window.partitionBy("lang").orderBy(value)
    return (bins.withColumn("_up", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(Window.partitionBy("lang")))
            .filter("2 * _up >= _all").groupBy("lang").agg(F.min(value).alias(name)))


def bands(measured: DataFrame, spread: float, step: float = 0.001) -> DataFrame:
    """(lang, middle, low, high): perplexity bands around each language's median log10 perplexity.

    Half the width is ``spread`` times the median distance from the median, but at least ``step``.  Medians are those
    of values rounded to ``step``, counted before they are shuffled, so that they are the same in every run.
    """
    bins = measured.groupBy("lang", F.round(F.col("level") / step).cast("long").alias("bin")).agg(
        F.count("*").alias("n"))
    middle = _middle(bins, "bin", "middle")
    away = bins.join(middle, "lang").withColumn("away", F.abs(F.col("bin") - F.col("middle"))).groupBy(
        "lang", "away").agg(F.sum("n").alias("n"))
    half = F.greatest("away", F.lit(1)) * spread
    return middle.join(_middle(away, "away", "away"), "lang").select(
        "lang", (F.col("middle") * step).alias("middle"), ((F.col("middle") - half) * step).alias("low"),
        ((F.col("middle") + half) * step).alias("high"))


def judge(docs: DataFrame, spread: float = 5.5, prior: float = 100.0, key: str = "doc_id", text: str = "text",
          lang: str = "lang", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One row for each row of ``docs``: the statistics, ``base_failed``, the perplexity and ``kept``.

    ``level`` is the log10 perplexity of a symbol.  A short text says little about itself: its level is drawn towards
    the language's median as if ``prior`` symbols of median level were added to it, and the band then rejects what
    is still outside.  Null and empty texts have no words and fail the base rules.  A language of few rows has a
    band of its own like any other; null and odd language codes are the language "und".  Repeated rows and rows
    without a key stay.  An empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), language(lang).alias("lang"), F.col(text).alias("text"))
    measured = stored(measures(rows, train(rows.select("lang", "text"))), "measures").withColumn(
        "level", -F.col("log10p") / F.col("n_grams"))
    joined = measured.join(bands(measured, spread), "lang")
    drawn = (F.col("level") * F.col("n_grams") + F.col("middle") * prior) / (F.col("n_grams") + prior)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return joined.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & drawn.between(F.col("low"), F.col("high"))).alias("kept"),
        F.pow(F.lit(10.0), "level").alias("perplexity"), drawn.alias("drawn"), "low", "high")

"""Word-level BPE by batched numpy merge rounds, with a tokenizer file of the public library as vocabulary.

A word is cut at special tokens, normalised (NFC, lower case) and split into pieces, and every distinct piece is merged
once: the symbols of all new pieces lie in one flat array, and each round merges the lowest-rank pair of every piece.
Ranks come from a binary search over sorted pair keys.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from parley.llm.chunks import numbered
from parley.llm.common import flat_bytes, pieces, ranges, small_batches

#: The bytes that bytes.split() parts words at.
ASCII_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: A mark after a plain letter or digit begins a piece of its own, so words are numbered without the marks behind them.
MARK, PLAIN = np.isin(np.arange(256), list(b".,;:!?")), np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"
                                                                                    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
CACHE = 600_000  # distinct words a worker remembers before it starts afresh

# White space as the tokenizer's pattern engine has it.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it has a visible form, else one from U+0100."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


class Splitter:
    """Text to pieces, as the normaliser and the pre-tokenizer of the file say; a line feed is a piece here."""

    def __init__(self, spec: dict):
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"].replace(r"\s", SPACE)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError("the tokenizer file normalises or splits in another way")
        self.find = regex.compile("\n|" + pattern).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split

    def plain(self, text: str) -> list[str]:
        if not text.isascii():  # a final sigma lowers like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def __call__(self, text: str) -> list[str]:
        if not self.special or not any(t in text for t in self.special):
            return self.plain(text)
        out: list[str] = []
        for part in self.cut(text):
            out += [part] if part in self.special else self.plain(part)
        return out


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab = model["vocab"]
        self.split = Splitter(spec)
        self.size = max([*vocab.values(), *self.split.special.values()]) + 1
        suffix = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + suffix] for s in symbols])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]
        born = np.full(self.size, -1)
        born[made[::-1]] = np.arange(len(made))[::-1]
        #: True where no merge can bring forth a pair of lower rank, so all places of a pair merge in one round.
        self.steady = bool(((born[left] < np.arange(len(made))) & (born[right] < np.arange(len(made)))).all()
                           and len(np.unique(made)) == len(made))
        tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.split.special.items()]:
            tokens[i] = token
        raw = [t.encode() for t in tokens]
        self.token_bytes = np.frombuffer(b"".join(t + b" " for t in raw), np.uint8)
        self.token_length = np.array([len(t) + 1 for t in raw])
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self._forget()

    def _forget(self) -> None:
        """Start the memory of words anew: ids of all known words in one array, and where each word's ids begin."""
        self.known: dict[bytes, int] = {}
        self.flat = [np.zeros(0, np.int64)]
        self.lengths = [np.zeros(0, np.int64)]

    def _ranked(self, symbol: np.ndarray, piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pairs that begin at ``at``: place in the sorted keys, and rank (beyond all if it is no merge)."""
        after = np.minimum(at + 1, len(symbol) - 1)
        key = symbol[at] * self.size + symbol[after]
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[found] == key) & (piece[at] == piece[after]) & (after > at)
        return found, np.where(hit, self.ranks[found], len(self.keys))

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the pieces, one after the other, and the number of ids of each."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        symbol[np.cumsum(size) - 1] = self.last[data[np.cumsum(size) - 1]]
        piece = np.repeat(np.arange(len(raw)), size)
        place = np.arange(len(symbol))
        none = len(self.keys)
        found, rank = self._ranked(symbol, piece, place)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.r_[begin, len(piece)]))
            over = least == none
            if over.any():
                done.append((piece[over], place[over], symbol[over]))
                going = ~over
                symbol, piece, place, found, rank, least = (
                    x[going] for x in (symbol, piece, place, found, rank, least))
                if not len(symbol):
                    break
            chosen = np.flatnonzero(rank == least)
            if self.steady:  # in a row of overlapping places every other one
                row = np.flatnonzero(np.r_[True, np.diff(chosen) != 1])
                within = np.arange(len(chosen)) - np.repeat(row, np.diff(np.r_[row, len(chosen)]))
                chosen = chosen[within % 2 == 0]
            else:
                chosen = chosen[np.r_[True, np.diff(piece[chosen]) != 0]]
            symbol[chosen] = self.made[found[chosen]]
            stay = np.ones(len(symbol), bool)
            stay[chosen + 1] = False
            symbol, piece, place, found, rank = (x[stay] for x in (symbol, piece, place, found, rank))
            now = chosen - np.arange(len(chosen))
            changed = np.concatenate([now, now[now > 0] - 1])
            found[changed], rank[changed] = self._ranked(symbol, piece, changed)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        piece, place, symbol = (np.concatenate([d[k] for d in done]) for k in range(3))
        return symbol[np.argsort(place)], np.bincount(piece, minlength=len(raw))

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words: split them, merge every distinct piece once."""
        tokens = self.split(b"\n".join(words).decode())
        index = dict.fromkeys(("\n", *self.split.special))
        fixed = len(index)
        index.update(dict.fromkeys(tokens))
        index = {t: k for k, t in enumerate(index)}
        ids, lengths = self.merge(list(index)[fixed:])
        flat = np.concatenate([np.array([*self.split.special.values()], np.int64), ids])
        lengths = np.concatenate([[0], np.ones(fixed - 1, np.int64), lengths])
        which = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
        of_piece = lengths[which]
        ends = np.append(np.cumsum(of_piece)[which == 0], of_piece.sum())
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.flat = [np.concatenate([*self.flat, flat[ranges((np.cumsum(lengths) - lengths)[which], of_piece)]])]
        self.lengths = [np.concatenate([*self.lengths, np.diff(ends, prepend=0)])]
        self.starts = np.cumsum(self.lengths[0]) - self.lengths[0]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (UTF-8) and the number of ids of each."""
        offsets = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)].astype(np.int64)
        return self.encode_flat(np.frombuffer(b"".join(texts), np.uint8), offsets)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for a column of texts; null counts as empty."""
        return self.encode_flat(*flat_bytes(column))

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts side by side in one array, with the n + 1 offsets between them.

        No piece spans ASCII white space or goes from a plain letter to a mark, and nothing composes across these places,
        so what lies between them is encoded alone.  Arrow numbers the different ones, and only these become Python
        objects.
        """
        solid = ~ASCII_SPACE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        first = offsets[:-1][offsets[1:] > offsets[:-1]]
        begin[first] = solid[first]
        begin[1:] |= MARK[data[1:]] & PLAIN[data[:-1]]
        starts = np.flatnonzero(begin)
        counts = np.diff(np.searchsorted(starts, offsets))
        if len(self.known) > CACHE:
            self._forget()
        if not len(starts):
            return np.zeros(0, np.int64), counts
        place, words = numbered(data[solid], (np.cumsum(solid) - 1)[starts])
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[place]
        of_word = self.lengths[0][which]
        ends = np.r_[0, np.cumsum(of_word)][np.r_[0, np.cumsum(counts)]]
        return self.flat[0][ranges(self.starts[which], of_word)], np.diff(ends)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids joined by one space, as the file names no decoder."""
        if not len(ids):
            return ""
        at = ranges(self.token_start[ids], self.token_length[ids])
        return self.token_bytes[at].tobytes()[:-1].decode()


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``ids`` (array of int), ``n_tokens`` and ``decoded`` (the ids decoded again).

    Null and empty texts have no ids and decode to the empty text; columns of these names are replaced.
    """
    small_batches(docs.sparkSession, 2000)
    docs = docs.drop("ids", "n_tokens", "decoded")
    at = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in (piece for whole in batches for piece in pieces(whole, at)):
            ids, counts = bpe.encode_column(batch.column(at))
            offsets = np.r_[0, np.cumsum(counts)]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            texts = [bpe.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(counts), pa.array(texts, pa.string())],
                                             [*batch.schema.names, "ids", "n_tokens", "decoded"])

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(apply, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again.

    Null texts count as empty, and empty or blank ones have no ids and decode to the empty text.  Rows without a key
    and repeated rows come back like any other.  Columns besides key and text are not looked at.
    """
    small_batches(docs.sparkSession, 2000)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in (piece for whole in batches for piece in pieces(whole, 1)):
            ids, counts = bpe.encode_column(batch.column(1))
            ends = np.cumsum(counts)
            own = [ids[e - n:e] for e, n in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in own], pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
            .mapInArrow(apply, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("key", key))

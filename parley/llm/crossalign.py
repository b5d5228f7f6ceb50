"""Which tokens of two tokenizers stand for each other: alignment by byte offsets and corpus-wide counts of id pairs.

Documents are aligned twice.  The first pass finds how often every task sees each pair of overlapping tokens.  The
distinct pairs are dealt to shards by hash, and every shard gets a minimal perfect hash with its keys beside it.  The
tasks' counts become dense vectors indexed by that hash and are summed up a tree.  The second pass aligns the documents
again and looks the counts up; keys are compared, so a pair that is not there is never taken for another.

Texts are worked off in chunks (see ``chunks``): no token of either tokenizer spans a chunk's begin, so the alignment of
a text is that of its chunks, and a worker aligns a chunk once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from parley.llm import bytebpe
from parley.llm.chunks import cuts, numbered
from parley.llm.common import flat_bytes, map_file, mixed, new_folder, ranges, runs, small_batches, stored, write_file
from parley.llm.perfecthash import MinimalHash

FAN = 16  # vectors that one task adds up
SHARD_PAIRS = 200_000  # distinct pairs of a shard, about
KNOWN = 600_000  # chunks a worker remembers before it starts afresh
TOGETHER = 64  # chunks that are encoded as one text
WIDE = "▁"


class Pair:
    """Both tokenizers: bytes of every token, and the tokens of chunks."""

    def __init__(self, path_a: str, path_b: str):
        self.a = bytebpe.load(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = max(self.a.bytes_of) + 1
        self.size_b = self.b.get_piece_size()
        self.length_a = np.array([len(self.a.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        pieces = [self._piece(i) for i in range(self.size_b)]
        self.length_b = np.array([len(p) for p in pieces], np.int64)
        self.bytes_b = np.frombuffer(b"".join(pieces), np.uint8)
        self.start_b = np.cumsum(self.length_b) - self.length_b
        if any(b" " in p.lstrip(b" ") for p in pieces):
            raise ValueError("the model has pieces that span words")
        digits = [str(i).encode() + b"," for i in range(max(size, self.size_b))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_length = np.array([len(d) for d in digits], np.int64)
        self.digits_start = np.cumsum(self.digits_length) - self.digits_length

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        return self.b.id_to_piece(i).replace(WIDE, " ").encode()

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for texts that begin with a space, one after the other; None if bytes get lost."""
        whole = "".join(texts)
        raw = np.frombuffer(whole.encode(), np.uint8)
        a = self.a.encode(whole, special=False).astype(np.int64)
        lists = self.b.encode([t[1:] for t in texts], num_threads=1)
        b = np.fromiter((i for ids in lists for i in ids), np.int64)
        back = self.bytes_b[ranges(self.start_b[b], self.length_b[b])]
        if self.length_a[a].sum() != len(raw) or not self.length_b[b].all() or not np.array_equal(back, raw):
            return None
        return a, b

    def tokens(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers for the chunks side by side, and the bytes of each chunk (0: it has no tokens)."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        size = np.array([len(c) for c in chunks], np.int64)
        plain = [k for k, (t, c) in enumerate(zip(texts, chunks))
                 if t[1:2].strip() and t[-1:].strip() and WIDE not in t and t[1:2].isprintable() and t[-1:].isprintable()
                 and "�" not in t]
        joined = ["".join([texts[i] for i in plain[k:k + TOGETHER]]) for k in range(0, len(plain), TOGETHER)]
        found = self._tokens(joined) if joined else None
        own: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(chunks)
        alone = set(range(len(chunks))) - (set(plain) if found else set())
        for k in alone:
            own[k] = self._tokens([texts[k]]) if texts[k].encode() == chunks[k] and WIDE not in texts[k] else None
            if own[k] is None:
                size[k] = 0
        if not alone:
            return *found, size
        none = np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = [(none, none)] * len(chunks)
        if found:  # cut the joined tokens at the chunks' ends
            at = np.r_[0, np.cumsum(size[plain])]
            place = [np.searchsorted(np.cumsum(length[ids]), at, side="right")
                     for ids, length in zip(found, (self.length_a, self.length_b))]
            for n, k in enumerate(plain):
                parts[k] = tuple(ids[p[n]:p[n + 1]] for ids, p in zip(found, place))
        for k in alone:
            parts[k] = own[k] or (none, none)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), size


@dataclass
class Alignment:
    """Of chunks side by side: links as pair codes, and for each chunk how many tokens, groups and links it has."""

    a: np.ndarray
    b: np.ndarray
    codes: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    bad: np.ndarray


def align(pair: Pair, chunks: list[bytes]) -> Alignment:
    """Groups end where tokens of both end; tokens are linked where their bytes overlap."""
    a, b, size = pair.tokens(chunks)
    end_a, end_b, ends = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b]), np.cumsum(size)
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    first = np.searchsorted(end_b, end_a - pair.length_a[a], side="right")
    links = np.searchsorted(end_b, end_a) - first + 1
    codes = np.repeat(a, links) * pair.size_b + b[ranges(first, links)]
    each = lambda upto: np.diff(np.searchsorted(upto, ends, side="right"), prepend=0)
    n_a = each(end_a)
    n_links = np.diff(np.r_[0, np.cumsum(links)][np.cumsum(n_a)], prepend=0)
    return Alignment(a, b, codes, n_a, each(end_b), each(both), n_links,
                     np.searchsorted(both, end_a), np.searchsorted(both, end_b), size == 0)


def group_texts(pair: Pair, found: Alignment) -> list[bytes]:
    """``a,a|b;a|b,b;`` of every chunk in decimal ids, built as one array of characters."""
    a, b, in_a, in_b = found.a, found.b, found.group_a, found.group_b
    place_a = np.arange(len(a)) + np.searchsorted(in_b, in_a)
    place_b = np.arange(len(b)) + np.searchsorted(in_a, in_b, side="right")
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    length = pair.digits_length[ids]
    text = pair.digits[ranges(pair.digits_start[ids], length)]
    ends = np.cumsum(length)
    last = lambda group: np.flatnonzero(np.append(group[1:] != group[:-1], True)) if len(group) else group
    text[ends[place_a[last(in_a)]] - 1] = ord("|")
    text[ends[place_b[last(in_b)]] - 1] = ord(";")
    whole = text.tobytes()
    at = np.r_[0, ends][np.r_[0, np.cumsum(found.n_a + found.n_b)]].tolist()
    return [whole[x:y] for x, y in zip(at[:-1], at[1:])]


def _spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a space and the text, of every text that is not empty."""
    data, offsets = flat_bytes(column)
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    return np.insert(data, at, 0x20), offsets + np.r_[0, np.cumsum(full)]


class Chunked:
    """Numbers of the chunks a worker knows."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def full(self) -> bool:
        return len(self.known) > KNOWN

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of a column of texts: the number of each chunk, the number of chunks of each text, and the new chunks."""
        data, offsets = _spaced(column)
        starts, counts = cuts(data, offsets)
        which, chunks = numbered(data, starts)
        new = [c for c in chunks if c not in self.known]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[which], counts, new


def _any(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether any flag of each text is set."""
    return np.diff(np.r_[0, np.cumsum(flags)][np.r_[0, np.cumsum(counts)]]) > 0


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def task_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(worker, pair, n): how often each task of the first pass has seen each pair; a task adds up what it can hold."""
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, worker = load(path_a, path_b), TaskContext.get().partitionId()
        state, codes, links, bad, times = Chunked(), [], [], [], np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            n_links = np.concatenate([np.zeros(0, np.int64), *links])
            flat = np.concatenate([np.zeros(0, np.int64), *codes])
            of_link = np.repeat(times, n_links)
            order = np.argsort(flat, kind="stable")
            at = runs(flat[order])
            n = np.add.reduceat(of_link[order], at) if len(at) else at
            pairs = flat[order][at][n > 0]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), worker, np.int32)), pa.array(pairs), pa.array(n[n > 0])],
                ["worker", "pair", "n"])

        for batch in batches:
            rows, counts, new = state.rows(batch.column(0))
            if new:
                found = align(pair, new)
                codes.append(found.codes)
                links.append(found.n_links)
                bad.append(found.bad)
            if not len(rows):
                continue
            times = np.concatenate([times, np.zeros(len(state.known) - len(times), np.int64)])
            flags = np.concatenate(bad)
            sound = np.repeat(~_any(flags[rows], counts), counts)
            times += np.bincount(rows[sound], minlength=len(times))
            if state.full():
                yield told()
                state, codes, links, bad, times = Chunked(), [], [], [], np.zeros(0, np.int64)
        yield told()

    return docs.select(text).mapInArrow(apply, "worker int, pair long, n long")


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _hashes(pairs: DataFrame, folder: str) -> DataFrame:
    """(shard, name, n): a file for each shard with the minimal perfect hash of its pairs and the keys in its order."""

    def apply(group: tuple, rows: pa.Table) -> pa.Table:
        keys = rows.column("pair").to_numpy()
        own = MinimalHash.of(keys)
        ordered = np.zeros(len(keys), "<i8")
        ordered[own.number(keys)] = keys
        name = f"hash-{group[0].as_py()}-{TaskContext.get().taskAttemptId()}.bin"
        write_file(f"{folder}/{name}", [*own.blocks(), ordered])
        return pa.table({"shard": [group[0].as_py()], "name": [name], "n": [len(keys)]})

    return pairs.groupBy("shard").applyInArrow(apply, "shard long, name string, n long")


@lru_cache(maxsize=64)
def _read_hash(uri: str) -> tuple[MinimalHash, np.ndarray]:
    data = np.frombuffer(map_file(uri), np.uint8)
    own, at = MinimalHash.read(data)
    return own, data[at:].view("<i8")


@lru_cache(maxsize=64)
def _read_counts(uri: str) -> np.ndarray:
    return np.frombuffer(map_file(uri), "<i8")


def _vectors(seen: DataFrame, folder: str, names: dict[int, str], workers: int) -> DataFrame:
    """(shard, counts): one dense vector for each shard, indexed by its hash, summed up a tree of tasks."""

    def dense(group: tuple, rows: pa.Table) -> pa.Table:
        shard = group[0].as_py()
        own, keys = _read_hash(f"{folder}/{names[shard]}")
        pairs = rows.column("pair").to_numpy()
        at = own.number(pairs)
        if (at < 0).any() or not np.array_equal(keys[at], pairs):
            raise ValueError("a pair is not among the keys of its shard")
        total = np.zeros(len(keys), "<i8")
        np.add.at(total, at, rows.column("n").to_numpy())
        return pa.table({"shard": [shard], "node": [group[1].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    def add(group: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(raw.as_buffer(), "<i8") for raw in rows.column("counts"))
        return pa.table({"shard": [group[0].as_py()], "node": [group[1].as_py()],
                         "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "shard long, node long, counts binary"
    level = seen.withColumn("node", F.expr(f"worker div {FAN}")).groupBy("shard", "node").applyInArrow(dense, schema)
    nodes = -(-workers // FAN)
    while nodes > 1:  # as often as the number of tasks can be divided by FAN
        level = level.withColumn("node", F.expr(f"node div {FAN}")).groupBy("shard", "node").applyInArrow(add, schema)
        nodes = -(-nodes // FAN)
    return level.select("shard", "counts")


@dataclass
class Counts:
    """Where the counts lie: a file name for keys and for counts of every shard, and the highest count of each B id."""

    folder: str
    keys: dict[int, str]
    counts: dict[int, str]
    best: np.ndarray

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 if it is none; every shard is visited once."""
        out = np.zeros(len(pairs), np.int64)
        shard = _shard(pairs, max(1, len(self.keys)))
        order = np.argsort(shard, kind="stable")
        begin = runs(shard[order])
        for x, y in zip(begin, np.append(begin[1:], len(order))):
            at = order[x:y]
            k = int(shard[at[0]])
            if k not in self.keys:
                continue
            own, keys = _read_hash(f"{self.folder}/{self.keys[k]}")
            number = own.number(pairs[at])
            known = (number >= 0) & (keys[number] == pairs[at])
            out[at] = np.where(known, _read_counts(f"{self.folder}/{self.counts[k]}")[number], 0)
        return out


def count_pairs(docs: DataFrame, path_a: str, path_b: str, text: str = "text",
                shard_pairs: int = SHARD_PAIRS) -> Counts:
    """The first pass.  Through the driver go one row a shard and one number for each id of the second vocabulary."""
    spark = docs.sparkSession
    folder = new_folder(spark, "pairs")
    seen = stored(task_counts(docs, path_a, path_b, text), "seen")
    distinct = stored(seen.select("pair").distinct(), "distinct")
    total, workers = distinct.count(), (seen.agg(F.max("worker")).first()[0] or 0) + 1
    shards = max(1, -(-total // shard_pairs))

    def dealt(df: DataFrame) -> DataFrame:
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("pair")
                own = pa.array(_shard(batch.column(at).to_numpy(), shards))
                yield pa.RecordBatch.from_arrays([own, *batch.columns], ["shard", *batch.schema.names])

        small_batches(spark, 100_000)
        return df.mapInArrow(apply, ", ".join(["shard long", *(f"{c} {t}" for c, t in df.dtypes)]))

    hashes = {r.shard: r.name for r in stored(_hashes(dealt(distinct), folder), "hashes").collect()}
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = f"counts-{shard}-{TaskContext.get().taskAttemptId()}.bin"
                write_file(f"{folder}/{name}", [raw.as_buffer()])
                _, keys = _read_hash(f"{folder}/{hashes[shard]}")
                best = np.zeros(size_b, np.int64)
                np.maximum.at(best, keys % size_b, np.frombuffer(raw.as_buffer(), "<i8"))
                used = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), shard)), pa.array([name] * len(used), pa.string()), pa.array(used),
                     pa.array(best[used])], ["shard", "name", "b", "best"])

    vectors = _vectors(dealt(seen), folder, hashes, workers)
    kept = stored(vectors.mapInArrow(keep, "shard long, name string, b long, best long"), "best")
    best = np.zeros(size_b, np.int64)
    for row in kept.groupBy("b").agg(F.max("best").alias("best")).collect():
        best[row.b] = row.best
    names = {r.shard: r.name for r in kept.select("shard", "name").distinct().collect()}
    return Counts(folder, {k: hashes.get(k, "") for k in range(shards) if k in hashes} or {}, names, best)


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
            with_groups: bool = False, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and the groups' text if wanted, of every row.

    Tokenizer A (byte-level) reads a space and the text, B (pieces) the text, which it begins with a space itself; strings
    of special tokens are plain text.  A row whose text is null or empty, or whose tokens of A or of B do not give back a
    space and the text, has zeros and an empty string, and its tokens count nowhere.  Rows without a key and repeated rows
    count like any other.  An empty table gives no rows.  Columns besides key and text are not looked at.
    """
    spark = docs.sparkSession
    counts = count_pairs(docs, path_a, path_b, text, shard_pairs)
    small_batches(spark)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(path_a, path_b)
        state, texts, sums, bad = Chunked(), [], [], []
        for batch in batches:
            if state.full():
                state, texts, sums, bad = Chunked(), [], [], []
            rows, chunks, new = state.rows(batch.column(1))
            if new:
                found = align(pair, new)
                distinct, which = np.unique(found.codes, return_inverse=True)
                known = counts.of(distinct)
                of_link = known[which]
                high = (known == counts.best[distinct % pair.size_b])[which]
                link_ends = np.r_[0, np.cumsum(found.n_links)]
                per_chunk = lambda x: np.diff(np.r_[0, np.cumsum(x)][link_ends])
                sums.append(np.stack([found.n_a, found.n_b, found.n_groups, found.n_links, per_chunk(high),
                                      per_chunk(of_link)], 1).astype(np.int64))
                texts += group_texts(pair, found)
                bad.append(found.bad)
                sums, bad = [np.concatenate(sums)], [np.concatenate(bad)]
            ends = np.r_[0, np.cumsum(chunks)]
            if len(rows):
                total = np.r_[np.zeros((1, len(numbers)), np.int64), np.cumsum(sums[0][rows], 0)]
                total = np.diff(total[ends], axis=0)
                sound = (chunks > 0) & ~_any(bad[0][rows], chunks)
                total[~sound] = 0
            else:
                total, sound = np.zeros((len(chunks), len(numbers)), np.int64), np.zeros(len(chunks), bool)
            at = rows.tolist()
            groups = [b"".join([texts[i] for i in at[x:y]])[:-1] if good else b""
                      for x, y, good in zip(ends[:-1].tolist(), ends[1:].tolist(), sound.tolist())]
            digest = [hashlib.sha256(g).hexdigest() if good else "" for g, good in zip(groups, sound.tolist())]
            columns = [batch.column(0), *(pa.array(c) for c in np.ascontiguousarray(total.T)), pa.array(digest, pa.string())]
            names = ["key", *numbers, "groups_sha256"]
            if with_groups:
                columns, names = [*columns, pa.array([g.decode() for g in groups], pa.string())], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"key {kind}", *(f"{n} long" for n in numbers), "groups_sha256 string",
                        *(["groups string"] if with_groups else [])])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(apply, schema).withColumnRenamed("key", key)

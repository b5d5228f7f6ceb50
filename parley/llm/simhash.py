"""Near-duplicates: SimHash fingerprints joined to themselves through a binary trie, and exact shingle similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parley.llm.common import mixed, partition_table, ranges, small_batches, stored, text_bytes
from parley.llm.graph import connected_components

BITS = 64


def shingle_hashes(parts: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of the whole sequence if it is shorter."""
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        return np.array([digest(joined, seed)] if parts else [], np.uint64)
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1:])), np.uint64,
                       len(parts) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k:k + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; zero without words."""
    return majority(shingle_hashes(text.lower().split(), words, seed))


def more_fingerprints(hashes: np.ndarray, first: int, count: int) -> list[int]:
    """Majority bits of ``count`` other hashes of the same shingles, numbered from ``first``."""
    steps = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(first, first + count)]
    return [majority(mixed(hashes ^ step)) for step in steps]


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the 64-bit fingerprint of every whole text as a signed long.  Null and blank texts have zero."""
    small_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(b, words) for b in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(apply, f"key {kind}, fp long")
            .withColumnRenamed("key", key))


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    up = parent[nodes]
    while True:
        further = parent[up]
        if np.array_equal(further, up):
            return up
        up = further


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Join the sets of a[i] and b[i]; returns the few pairs of roots that had to be linked."""
    made = []
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        if len(a):
            order = np.lexsort((b, a))
            first = order[np.r_[True, a[order][1:] != a[order][:-1]]]
            parent[a[first]] = b[first]
            made.append((a[first], b[first]))
    return made


def trie_links(codes: np.ndarray, depth: int, budget: int, steps: np.ndarray, side: np.ndarray | None = None,
               accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
               frontier: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all codes within ``budget`` differing bits that share their first ``depth`` bits.

    ``codes`` are sorted 64-bit numbers and stand for a binary trie: a node is a range of them and its
    children part at the next bit.  Pairs of nodes go down together; the differing bits of their paths add up, and a
    pair ends where they exceed the budget.  steps[d] is the least number of differing bits that a pair must have
    when it reaches depth d (pairs below are found in another ordering of the bits).  Only links that join two sets
    come back, not all pairs: their components are the same.  With ``side`` (0 or 1 for each code) only pairs of
    different sides count, with ``accept`` only pairs (by index) that it accepts.
    """
    n = len(codes)
    parent = np.arange(n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = codes >> np.uint64(BITS - depth) if depth else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    hi = np.r_[lo[1:], n]
    many = hi - lo > 1

    def link(a: np.ndarray, b: np.ndarray) -> None:
        ok = np.bitwise_count(codes[a] ^ codes[b]) <= budget
        if side is not None:
            ok &= side[a] != side[b]
        a, b = a[ok], b[ok]
        if accept is not None and len(a):
            ok = accept(a, b)
            a, b = a[ok], b[ok]
        out.extend(unite(parent, a, b))

    stack = [(depth, lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int16))]
    while stack:
        d, alo, ahi, blo, bhi, diff = stack.pop()
        if not len(alo):
            continue
        if len(alo) > frontier:
            half = len(alo) // 2
            stack += [(d, *(x[:half] for x in (alo, ahi, blo, bhi, diff))),
                      (d, *(x[half:] for x in (alo, ahi, blo, bhi, diff)))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():  # the rest of both paths at once
            a, b = alo[single], blo[single]
            other = a != b
            link(a[other], b[other])
            keep = ~single
            alo, ahi, blo, bhi, diff = (x[keep] for x in (alo, ahi, blo, bhi, diff))
            if not len(alo):
                continue
        if d == BITS:  # the codes of a node are equal now
            left, right = ahi - alo, bhi - blo
            until = np.cumsum(left * right)
            for k in range(0, int(until[-1]), frontier):
                pair = np.arange(k, min(k + frontier, int(until[-1])))
                of = np.searchsorted(until, pair, "right")
                pair = pair - (until - left * right)[of]
                a, b = alo[of] + pair // right[of], blo[of] + pair % right[of]
                once = (a < b) | (alo[of] != blo[of])
                link(a[once], b[once])
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - d)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        amid = np.searchsorted(codes, (codes[alo] & above) | bit)
        bmid = np.searchsorted(codes, (codes[blo] & above) | bit)
        same = alo == blo
        pairs = [(alo, amid, blo, bmid, diff, None), (amid, ahi, bmid, bhi, diff, None),
                 (alo, amid, bmid, bhi, diff + 1, None), (amid, ahi, blo, bmid, diff + 1, ~same)]
        parts = []
        for a0, a1, b0, b1, bits, mask in pairs:
            ok = (a1 > a0) & (b1 > b0) & (bits <= budget) & (bits >= steps[d + 1])
            if mask is not None:
                ok &= mask
            ok &= ~((a0 == b0) & (a1 - a0 == 1))
            parts.append(tuple(x[ok] for x in (a0, a1, b0, b1, bits)))
        stack.append((d + 1, *(np.concatenate([p[k] for p in parts]) for k in range(5))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def block_bounds(budget: int) -> list[tuple[int, int]]:
    """First and last bit of budget + 1 blocks: two codes within the budget agree in one of them."""
    cuts = [BITS * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def _turned(column: str, bound: tuple[int, int]) -> Column:
    """The code with the bits of a block first, the others in their order."""
    a, b = bound
    width, rest = b - a, BITS - b
    code = F.col(column)
    value = F.shiftrightunsigned(F.shiftleft(code, a), BITS - width)
    tail = code.bitwiseAND(F.lit((1 << rest) - 1).cast("long")) if rest else F.lit(0).cast("long")
    body = F.shiftleft(value, BITS - width).bitwiseOR(tail)
    if not a:
        return body
    return body.bitwiseOR(F.shiftleft(F.shiftrightunsigned(code, BITS - a), rest))


def links(nodes: DataFrame, budget: int = 4, tile: int = 50_000, node: str = "fp", tables: tuple[str, ...] = ("fp",),
          witness: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """(u, v): links whose components are those of all pairs of nodes within ``budget`` differing bits in a table.

    ``nodes``: distinct ``node`` numbers with one 64-bit code for each of the ``tables``; with ``witness`` columns a
    pair must also differ in no more than ``limit`` bits of them together.  Codes within the budget agree in one of
    budget + 1 blocks of bits; each block value is a subtrie whose codes meet in one task.  A block value with more
    than ``tile`` codes is cut into tiles of about that many, and each pair of tiles is a task of its own; the test
    uses counts, so results don't depend on it.
    """
    bounds = block_bounds(budget)
    each = F.explode(F.array(*[
        F.struct(F.lit(t * len(bounds) + k).alias("block"), _turned(name, bound).alias("code"),
                 F.shiftrightunsigned(_turned(name, bound), BITS - (bound[1] - bound[0])).alias("value"))
        for t, name in enumerate(tables) for k, bound in enumerate(bounds)])).alias("x")
    rows = nodes.select(F.col(node).alias("node"), *witness, each).select("node", *witness, "x.*")
    sizes = rows.groupBy("block", "value").count().filter(F.col("count") > tile).select(
        "block", "value", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    cut = rows.join(sizes, ["block", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = cut.withColumn("own", own).withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "block", "value", F.least("own", "with").alias("t0"), F.greatest("own", "with").alias("t1"),
        F.when(F.col("own") <= F.col("with"), 0).otherwise(1).cast("byte").alias("side"), "code", "node", *witness)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = partition_table(batches)
        if rows is None:
            return
        get = {n: rows.column(n).to_numpy() for n in rows.schema.names}
        codes = get["code"].view(np.uint64)
        tiled = get["t0"] != get["t1"]
        jobs = []
        for block in np.unique(get["block"]):
            k = int(block) % len(bounds)
            width = bounds[k][1] - bounds[k][0]
            steps = np.zeros(BITS + 1, np.int16)
            for j in range(k):  # an earlier block without a difference finds the pair itself
                steps[width + bounds[j][1]] = j + 1
            mine = get["block"] == block
            plain = mine & ~tiled & (get["t0"] == 0)
            jobs.append((width, steps, plain, False))
            rest = mine & ~plain
            if rest.any():
                key = np.stack([get["value"][rest], get["t0"][rest], get["t1"][rest]], 1)
                for value, t0, t1 in np.unique(key, axis=0):
                    which = rest & (get["value"] == value) & (get["t0"] == t0) & (get["t1"] == t1)
                    jobs.append((width, steps, which, t0 != t1))
        for width, steps, which, two in jobs:
            chosen = np.flatnonzero(which)
            chosen = chosen[np.argsort(codes[chosen], kind="stable")]
            accept = None
            if witness:
                more = [get[c][chosen].view(np.uint64) for c in witness]
                accept = lambda a, b: sum(
                    np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in more) <= limit
            u, v = trie_links(codes[chosen], width, budget, steps, get["side"][chosen] if two else None, accept)
            if len(u):
                names = get["node"][chosen]
                yield pa.RecordBatch.from_arrays([pa.array(names[u]), pa.array(names[v])], ["u", "v"])

    return dealt.repartition("block", "value", "t0", "t1").mapInArrow(apply, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, text: str = "text", key: str = "doc_id",
                    tile: int = 50_000) -> DataFrame:
    """(key, fp, component): fingerprints linked at ``budget`` or fewer differing bits, with the smallest key reachable.

    Rows with equal fingerprints are one node, so copies cost nothing beyond one aggregation.  Null texts count as
    empty, empty texts have the fingerprint zero and link like any other; repeated rows come back repeated; rows
    without a key take part and get their component's smallest key, null if it has none.  An empty table gives no
    rows.  Columns other than key and text are not looked at.
    """
    prints = stored(fingerprints(docs, words, text, key), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    return _labelled(prints, nodes, links(nodes, budget, tile), "fp", key).select(key, "fp", "component")


def _labelled(rows: DataFrame, nodes: DataFrame, found: DataFrame, node: str, key: str) -> DataFrame:
    """``rows`` with the smallest key of their node's component."""
    parts = connected_components(found)
    labelled = nodes.join(parts.withColumnRenamed("node", node), node, "left").select(
        node, "least", F.coalesce("component", node).alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component"))
    return rows.join(labelled.join(smallest, "label").select(node, "component"), node)


def differing_bits(similarity: float, bits: int) -> int:
    """Most bits that fingerprints of that many bits may differ in: the expected number at a shingle similarity, and
    one standard deviation."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + (bits * share * (1 - share)) ** 0.5)


def similar_documents(docs: DataFrame, similarity: float = 0.8, words: int = 5, table_words: int = 2, tables: int = 8,
                      witnesses: int = 8, budget: int = 4, text: str = "text", key: str = "doc_id",
                      tile: int = 50_000) -> DataFrame:
    """(key, component): documents linked at a similarity of about ``similarity`` or more on ``words``-word shingles.

    One fingerprint of 64 bits finds only texts that are almost the same within a few bits.  So there are several,
    of shorter shingles: a pair is a candidate if one of the ``tables`` has it within ``budget`` bits, and is linked if
    the long fingerprint (64 bits for each of ``witnesses``) of the ``words``-word shingles says that they are similar
    enough.  All candidates of the tables are looked at, in the trie join; rows with equal fingerprints are one node.
    Nulls, empty texts, repeated rows, rows without a key and empty tables are as in ``near_duplicates``.
    """
    small_batches(docs.sparkSession)
    names = [f"t{k}" for k in range(tables)] + [f"w{k}" for k in range(witnesses)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in text_bytes(batch.column(1)):
                parts = body.lower().split()
                rows.append(more_fingerprints(shingle_hashes(parts, table_words), 0, tables)
                            + more_fingerprints(shingle_hashes(parts, words), tables, witnesses))
            codes = np.array(rows, np.uint64).reshape(len(rows), len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.ascontiguousarray(codes[:, k])) for k in range(len(names))]],
                ["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    prints = stored(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        apply, f"key {kind}, " + ", ".join(f"{n} long" for n in names)).withColumn("node", F.xxhash64(*names)), "fingerprints")
    nodes = prints.groupBy("node", *names).agg(F.min("key").alias("least"))
    found = links(nodes, budget, tile, "node", tuple(names[:tables]), tuple(names[tables:]),
                  differing_bits(similarity, BITS * witnesses))
    return _labelled(prints.select("key", "node"), nodes.select("node", "least"), found, "node", "key").select(
        F.col("key").alias(key), "component")


def min_hashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """The least value of ``count`` hash functions over the shingles; two sets agree in each with a probability that is
    their similarity.  The largest number without shingles."""
    steps = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factor, shift = steps[:count] | np.uint64(1), steps[count:]
    least = np.full(count, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 256):
        np.minimum(least, (shingles[k:k + 256, None] * factor + shift).min(0), out=least)
    return least


def bucket_links(bucket: np.ndarray, group: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray],
                 every: bool, few: int = 32, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (by index) of rows of one bucket and different groups that are alike: ``every`` one, or as many as join
    the same sets.

    ``bucket`` is sorted.  A large bucket is walked: what a row reaches is not compared with anything but the rows
    that nothing has reached yet, so a bucket of copies costs one comparison a row.
    """
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(bucket)])
    out = []
    parent = np.arange(len(bucket))
    for size in np.unique(sizes[(sizes > 1) & (sizes <= few)]):  # all pairs of all small buckets at once
        left, right = np.triu_indices(size, 1)
        at = starts[sizes == size]
        each = max(1, block // len(left))
        for k in range(0, len(at), each):
            a, b = ((at[k:k + each, None] + x).ravel() for x in (left, right))
            ok = group[a] != group[b]
            a, b = a[ok], b[ok]
            ok = alike(a, b)
            a, b = a[ok], b[ok]
            out.extend([(a, b)] if every else unite(parent, a, b))
    for at, size in zip(starts[sizes > few], sizes[sizes > few]):
        rest = np.arange(at, at + size)
        while every and len(rest) > 1:
            own, rest = rest[0], rest[1:]
            other = rest[group[rest] != group[own]]
            found = other[alike(np.full(len(other), own), other)]
            out.append((np.full(len(found), own), found))
        reached: list[int] = []
        while len(rest) and not every:
            if not reached:
                reached, rest = [int(rest[0])], rest[1:]
            own = reached.pop()
            same = group[rest] == group[own]
            found = same.copy()
            found[~same] = alike(np.full(int((~same).sum()), own), rest[~same])
            far = rest[found & ~same]
            out.append((np.full(len(far), own), far))
            reached += rest[found].tolist()
            rest = rest[~found]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def band_links(nodes: DataFrame, bands: list[str], witness: list[str], limit: int, tile: int) -> DataFrame:
    """(u, v), u < v: of the pairs of nodes (node, bands, witnesses) that share a band and differ in no more than ``limit``
    bits of the witnesses, as many as join the same sets.

    A band value of more than ``tile`` nodes is cut into tiles, and each pair of tiles is a task of its own.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col(name).alias("value"))
                               for k, name in enumerate(bands)])).alias("x")
    rows = nodes.select("node", *witness, each).select("node", *witness, "x.*")
    sizes = rows.groupBy("band", "value").count().filter(F.col("count") > tile).select(
        "band", "value", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    cut = rows.join(F.broadcast(sizes), ["band", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn(
        "with", F.explode(F.expr("sequence(0, tiles - 1)"))).select(
        "band", "value", F.least("own", "with").alias("t0"), F.greatest("own", "with").alias("t1"), "node", *witness)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = partition_table(batches)
        if rows is None:
            return
        get = {n: rows.column(n).to_numpy() for n in rows.schema.names}
        order = np.lexsort((get["t1"], get["t0"], get["value"], get["band"]))
        new = np.zeros(len(order), bool)
        for name in ("band", "value", "t0", "t1"):
            own = get[name][order]
            new[1:] |= own[1:] != own[:-1]
        more = [get[c].view(np.uint64)[order] for c in witness]
        u, v = bucket_links(np.cumsum(new), get["node"][order], lambda a, b: sum(
            (np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in more), np.zeros(len(a), np.int64)) <= limit, False)
        if len(u):
            u, v = get["node"][order][u], get["node"][order][v]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return dealt.repartition("band", "value", "t0", "t1").mapInArrow(apply, "u long, v long").distinct()


def similarities(values: np.ndarray, starts: np.ndarray, size: np.ndarray, block: int = 1 << 20
                 ) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The Jaccard similarity of sets a[i] and b[i], 1 for two empty ones; set k is the ``size[k]`` distinct values from
    ``starts[k]`` on."""
    known, ids = np.unique(values, return_inverse=True)
    have = np.sort(np.repeat(np.arange(len(size)), size) * len(known) + ids[ranges(starts, size)])

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        less = size[a] <= size[b]
        small, large = np.where(less, a, b), np.where(less, b, a)
        both = np.zeros(len(a), np.int64)
        until = np.cumsum(size[small])
        cuts = np.unique(np.r_[0, np.searchsorted(until, np.arange(block, until[-1], block)), len(a)]) if len(a) else [0]
        for k, stop in zip(cuts[:-1], cuts[1:]):
            own = size[small[k:stop]]
            asked = np.repeat(large[k:stop], own) * len(known) + ids[ranges(starts[small[k:stop]], own)]
            hit = np.zeros(len(asked), bool)
            if len(asked):
                hit = have[np.minimum(np.searchsorted(have, asked), len(have) - 1)] == asked
            both[k:stop] = np.bincount(np.repeat(np.arange(stop - k), own)[hit], minlength=stop - k)
        either = size[a] + size[b] - both
        return np.where(either == 0, 1.0, both / np.maximum(either, 1))

    return of


def set_links(nodes: DataFrame, bands: list[str], witness: list[str], limit: int, similarity: float, weight: int
              ) -> DataFrame:
    """(u, v): of the pairs of nodes (part, node, bands, witnesses, shingles) of one part that share a band, differ in no
    more than ``limit`` bits of the witnesses and whose shingle sets have the similarity, as many as join the same sets.

    A part's nodes come with their sets and are compared where they meet, so that only links leave a task: fewer than
    it has nodes.  A part of more than ``weight`` shingles is cut into tiles, and each pair of tiles is a task of its own.
    """
    sizes = nodes.groupBy("part").agg(F.sum(F.size("shingles") + F.lit(1)).alias("weight")).filter(
        F.col("weight") > weight).select("part", F.ceil(F.col("weight") / weight).cast("int").alias("tiles"))
    cut = nodes.join(F.broadcast(sizes), "part", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn(
        "with", F.explode(F.expr("sequence(0, tiles - 1)"))).filter("tiles = 1 OR own <> with").select(
        "part", F.least("own", "with").alias("t0"), F.greatest("own", "with").alias("t1"), "node", *bands, *witness,
        "shingles")

    def apply(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        get = {n: rows.column(n).to_numpy() for n in ("node", *bands, *witness)}
        sets = rows.column("shingles").combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        ends = sets.offsets.to_numpy().astype(np.int64)
        marks, met = (np.stack([get[c] for c in names], 1) for names in (witness, bands))
        likeness = similarities(sets.flatten().to_numpy(), ends[:-1] - ends[0], np.diff(ends))

        def alike(a: np.ndarray, b: np.ndarray, before: int) -> np.ndarray:
            ok = np.bitwise_count((marks[a] ^ marks[b]).view(np.uint64)).sum(1, dtype=np.int64) <= limit
            # those that met in an earlier band are in different sets still
            ok[ok] = (met[a[ok], :before] != met[b[ok], :before]).all(1)
            ok[ok] = likeness(a[ok], b[ok]) >= similarity
            return ok

        parent, found = np.arange(len(ends) - 1), []
        for k, name in enumerate(bands):
            order = np.argsort(get[name], kind="stable")
            value = get[name][order]
            a, b = bucket_links(np.cumsum(np.r_[False, value[1:] != value[:-1]]), _roots(parent, order),
                                lambda i, j: alike(order[i], order[j], k), False)
            found += unite(parent, order[a], order[b])
        u, v = (get["node"][np.concatenate([f[k] for f in found] or [parent[:0]])] for k in (0, 1))
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return dealt.groupBy("part", "t0", "t1").applyInArrow(apply, "u long, v long")


def shingle_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, bands: int = 25, rows: int = 5,
                       witnesses: int = 8, text: str = "text", key: str = "doc_id", tile: int = 50_000,
                       linked: Callable[[DataFrame], DataFrame] | None = None, weight: int = 1 << 21) -> DataFrame:
    """(key, component): documents whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or
    more, and what they reach through others.

    Candidates share one of ``bands`` bands of ``rows`` min-hashes, whatever the edit is: an appended or trimmed copy is
    found like a scattered one (a pair at 0.8 is missed with a probability of 0.00005).  Candidates whose min-hashes
    differ in a last bit too often for the similarity (by four standard deviations) are passed over.  The others are
    compared exactly, by their whole shingle sets.  At first, in a join, only as many pairs are compared as join the
    same sets of candidates; a set where some are less similar then goes through ``set_links`` as a whole.  Equal texts
    are one node, texts without words are alike.  Nulls, repeated rows, rows without a key and empty tables are as in
    ``near_duplicates``.  ``linked`` may give further links (u, v) between the nodes of a table (node, text).
    """
    small_batches(docs.sparkSession)
    names, marks = [f"b{k}" for k in range(bands)], [f"w{k}" for k in range(witnesses)]
    count = max(bands * rows, BITS * witnesses)
    share = BITS * witnesses * (1 - similarity) / 2
    limit = int(share + 4 * (share * (1 + similarity) / 2) ** 0.5)

    def shingles(body: bytes) -> np.ndarray:
        return np.unique(shingle_hashes(body.lower().split(), words))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([min_hashes(shingles(b), count) for b in text_bytes(batch.column(1))], np.uint64)
            least = least.reshape(batch.num_rows, count)
            codes = [np.zeros(batch.num_rows, np.uint64) for _ in names]
            for k in range(bands):
                for value in least[:, k * rows:(k + 1) * rows].T:
                    codes[k] = mixed(codes[k] * np.uint64(31) + value)
            bits = np.packbits((mixed(least[:, :BITS * witnesses]) & np.uint64(1)).astype(bool), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c.view(np.int64)) for c in codes],
                 *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(witnesses)]], ["node", *names, *marks])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(b).view(np.int64) for b in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "shingles"])

    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("node"))
    texts = docs.select(F.xxhash64(body).alias("node"), body.alias("text"))
    codes = ", ".join(f"{n} long" for n in (*names, *marks))
    pool = stored(texts.mapInArrow(prints, f"node long, {codes}").dropDuplicates(["node"]), "prints")
    pairs = stored(band_links(pool, names, marks, limit, tile), "pairs")
    # rows without any candidate end here: links name every node that has one
    ends = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    known = stored(texts.join(ends, "node", "left_semi").dropDuplicates(["node"]).mapInArrow(
        sets, "node long, shingles array<long>"), "shingles")
    a = known.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = known.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    either = F.size("a") + F.size("b") - both
    tested = stored(pairs.join(b, "v").join(a, "u").select(
        "u", "v", ((either == 0) | (both / either >= similarity)).alias("linked")), "tested")
    good, less = tested.filter("linked").select("u", "v"), tested.filter(~F.col("linked"))
    if not less.isEmpty():
        parts = stored(connected_components(pairs).withColumnRenamed("component", "part"), "parts")
        mixed_parts = less.select(F.col("u").alias("node")).join(parts, "node").select("part").distinct()
        rest = pool.join(parts.join(mixed_parts, "part", "left_semi"), "node").join(known, "node")
        good = good.unionByName(stored(set_links(rest, names, marks, limit, similarity, weight), "links"))
    if linked is not None:
        good = good.unionByName(linked(texts).select("u", "v"))
    nodes = keyed.groupBy("node").agg(F.min("key").alias("least"))
    return _labelled(keyed, nodes, good, "node", "key").select(F.col("key").alias(key), "component")


def all_duplicates(docs: DataFrame, words: int = 4, budget: int = 4, text: str = "text", key: str = "doc_id",
                   tile: int = 50_000, **shingles) -> DataFrame:
    """(key, component): documents linked by their fingerprints, as in ``near_duplicates``, or by their shingle sets, as in
    ``shingle_duplicates``, and what they reach through either."""

    def linked(texts: DataFrame) -> DataFrame:
        found = near_duplicates(texts, words, budget, "text", "node", tile)
        return found.filter("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v"))

    return shingle_duplicates(docs, text=text, key=key, tile=tile, linked=linked, **shingles)

import random

import numpy as np
import xxhash

from parley.llm import simhash
from parley.llm.graph import connected_components
from parley.llm.simhash import (bucket_links, differing_bits, fingerprint, links, near_duplicates, shingle_duplicates,
                                similar_documents)


def plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_words(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
            .translate({c: " " for c in range(9, 14)}).split(" ") if w]


def plain_tables(text, words, first, count):
    """Other fingerprints of the same shingles, by integer arithmetic."""
    parts, out, whole = plain_words(text), [], 2**64
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    for k in range(first, first + count):
        hashes = []
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42) ^ (k + 1) * 0x9E3779B97F4A7C15 % whole
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ h >> 33) * factor % whole
            hashes.append(h ^ h >> 33)
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return out


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " ".join(rng.choice(["A", "bé\x0b", "the ", "Ünd\t", "x\n"]) for _ in range(n))
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_links_connect_like_all_pairs(spark):
    rng = random.Random(2)
    codes = {rng.getrandbits(64) for _ in range(400)} | {0, 2**64 - 1, 2**63}
    for base in rng.sample(sorted(codes), 60):
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 7)):
                x ^= 1 << b
            codes.add(x)
    codes = sorted(codes)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    arr = np.array(codes, np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    want = plain_components([(codes[a], codes[b]) for a, b in zip(*np.nonzero(near))], codes)
    fps = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    for tile in (50_000, 7):
        found = [(r.u % 2**64, r.v % 2**64) for r in links(fps, 4, tile).collect()]
        assert plain_components(found, codes) == want


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(-5, 2000), (7, 7)]
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = plain_components(pairs, nodes)
    assert got == {n: want[n] for n in got} and nodes - set(got) <= {7}


def test_near_duplicates_whole_rule(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n", "One", "one", "a b c", "x" * 100_000]
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "One"), (None, "a b c")]
    docs = spark.createDataFrame([(*r, 1, "e") for r in rows], "doc_id long, text string, fp int, component string")
    got = near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = plain_components(pairs, range(len(rows)))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[group[i]] = min(key, least.get(group[i], key))
    want = sorted((str(k), prints[i], least.get(group[i])) for i, (k, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component) for r in got) == want


def test_similar_documents(spark):
    """Linked as the rule says, for every tile; nearly all texts of a similarity over 0.8 are, and none of under 0.6."""
    rng = random.Random(12)
    texts = [None, "", "one two", "one two", "One  two\n"]
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 300))]
        texts.append(" ".join(base))
        for edits in (1, 3, 6, 12, 40):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    tables, longer = ([plain_tables(t, *of) for t in texts] for of in ((2, 0, 8), (5, 8, 8)))
    sets = [{tuple(plain_words(t)[i:i + 5]) for i in range(len(plain_words(t)) - 4)} for t in texts]
    bits = lambda a, b: [(x ^ y).bit_count() for x, y in zip(a, b)]
    limit, pairs, close, found = differing_bits(0.8, 512), [], 0, 0
    assert limit == 85
    for i in range(len(rows)):
        for j in range(i):
            linked = min(bits(tables[i], tables[j])) <= 4 and sum(bits(longer[i], longer[j])) <= limit
            pairs += [(i, j)] if linked else []
            same = len(sets[i] & sets[j]) / (len(sets[i] | sets[j]) or 1)
            close, found = close + (same >= 0.8), found + (linked and same >= 0.8)
            assert not (linked and sets[i] and same < 0.6)
    assert found >= 0.85 * close > 40
    want = plain_components(pairs, range(len(rows)))
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, t0 int, node int, w0 string")
    for tile in (50_000, 5):
        got = {r.doc_id: r.component for r in similar_documents(docs, tile=tile).collect()}
        assert got == want


def test_no_rows(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingle_duplicates_whole_rule(spark):
    """All pairs at 0.8 or more are linked, appended and trimmed copies too, and none below."""
    rng = random.Random(13)
    texts = [None, "", " \n", "One", "one", "a b c", "a b c d e f", "x" * 50_000]
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 400))]
        texts.append(" ".join(base))
        for part in (0.02, 0.1, 0.2, 0.24, 0.27, 0.4):
            more = int(part * len(base))
            texts.append(" ".join(base + [f"n{rng.randrange(10_000)}" for _ in range(more)]))
            texts.append(" ".join(base[:len(base) - int(more / (1 + part))]))
        for edits in (1, 3, 6, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(copy))
    frame = [f"f{k}" for k in range(60)]  # a page template: more rows than a small bucket, most of them not alike
    texts += [" ".join(frame + [f"p{rng.randrange(10**6)}" for _ in range(rng.choice([3, 9, 14, 18]))]) for _ in range(90)]
    rows = list(enumerate(texts)) + [(3, "One"), (None, "a b c")]
    sets = []
    for _, t in rows:
        own = plain_words(t)
        sets.append({tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set())
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    group = plain_components(pairs, range(len(rows)))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[group[i]] = min(k, least.get(group[i], k))
    want = sorted((str(k), least.get(group[i])) for i, (k, _) in enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (50_000, 20):
        got = shingle_duplicates(docs, tile=tile).collect()
        assert sorted((str(r.doc_id), r.component) for r in got) == want
    assert shingle_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bucket_of_copies_is_not_all_pairs():
    asked = []

    def alike(a, b):
        asked.append(len(a))
        return np.ones(len(a), bool)

    u, v = bucket_links(np.zeros(3000, np.int64), np.arange(3000), alike, False)
    assert len(u) == 2999 == sum(asked)


def test_all_pairs_of_sets_just_below_stay_in_their_task(spark):
    """Of texts that are candidates of each other, but few of them alike enough, only links come back: no more than nodes."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(120):
        copy = list(base)
        for _ in range(rng.choice([2, 3, 4])):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(copy)
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = plain_components(pairs, range(len(sets)))
    near = [[xxhash.xxh64_intdigest(" ".join(s), 42) for s in sorted(own)] for own in sets]
    rows = [(7, i, 0, 0, 0, np.array(own, np.uint64).view(np.int64).tolist()) for i, own in enumerate(near)]
    nodes = spark.createDataFrame(rows, "part long, node long, b0 long, b1 long, w0 long, shingles array<long>")
    for weight in (1 << 21, 6000):
        links = [(r.u, r.v) for r in simhash.set_links(nodes, ["b0", "b1"], ["w0"], 0, 0.8, weight).collect()]
        assert plain_components(links, range(len(sets))) == group
        assert len(links) < 120 or weight == 6000
    assert len(pairs) > 100 and len(set(group.values())) > 3
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component for r in shingle_duplicates(docs, weight=6000).collect()} == {
        i: group[i] for i in range(len(texts))}


def test_similarities():
    sets = [[], [3, 5, 8], [5, 8], [], [1, 2], [3, 5, 8]]
    size = np.array([len(s) for s in sets])
    of = simhash.similarities(np.array(sum(sets, [])), np.cumsum(size) - size, size, block=2)
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(6) for j in range(6)]))
    want = [len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) if sets[i] or sets[j] else 1 for i, j in zip(a, b)]
    assert of(a, b).tolist() == want
    assert len(of(a[:0], b[:0])) == 0
    empty = simhash.similarities(np.zeros(0, np.int64), np.zeros(2, np.int64), np.zeros(2, np.int64))
    assert empty(np.array([0]), np.array([1])).tolist() == [1]

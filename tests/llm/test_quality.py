import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parley.llm import quality

ODD = [None, "", " \n\t", "short", "ab ab ab ab ab ab ab ab ab ab ab ab", "one two three four five six seven eight nine ten",
       "# a | b\n# a | b\n\n\nx\x0by\nx\x0by\n \n \n", "ñandú 你好 \x00 end " * 3, "long " + "word " * 30_000, "z" * 50_000]


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(hit))


def symbols(text):
    return [int(quality.TABLE[b]) for b in (text or "").encode() if quality.TABLE[b] != quality.NO_SYMBOL]


def plain_model(texts):
    """Interpolated modified Kneser-Ney over dictionaries, from the textbook's formulas."""
    n = quality.ORDER
    counts = [Counter() for _ in range(n + 1)]
    for text in texts:
        s = [0] * (n - 1) + symbols(text) + [0]
        counts[n].update(tuple(s[i:i + n]) for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, context = {}, {}
    for k in range(1, n + 1):
        c1, c2, c3, c4 = (max(1, sum(c == j for c in counts[k].values())) for j in (1, 2, 3, 4))
        y = c1 / (c1 + 2 * c2)
        raw = [0, 1 - 2 * y * c2 / c1, 2 - 3 * y * c3 / c2, 3 - 4 * y * c4 / c3]
        discounts[k] = [min(max(r, 0), most) for r, most in zip(raw, (0, 0.95, 1.9, 2.85))]
        context[k] = defaultdict(list)
        for g, c in counts[k].items():
            context[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / quality.SYMBOLS
        own = context[k].get(g[:-1])
        if not own:
            return p(g[1:])
        d, c = discounts[k], counts[k].get(g, 0)
        left = max(sum(d[min(x, 3)] for x in own) / sum(own), 1e-12)
        return (c - d[min(c, 3)] if c else 0) / sum(own) + left * p(g[1:])

    def score(text):
        s = [0] * (n - 1) + symbols(text) + [0]
        return sum(math.log10(p(tuple(s[i:i + n]))) for i in range(len(s) - n + 1))

    return score


def sample():
    rng = random.Random(4)
    rows = []
    for lang, bits in (("en", ["the ", "ing ", "and ", "ar"]), ("DE", ["der ", "ung ", "ein", "ß "])):
        for _ in range(60):
            rows.append((lang, "".join(rng.choice(bits) for _ in range(rng.randint(20, 150)))))
        rows += [(lang, "".join(rng.choice("QXZ| ") for _ in range(400))) for _ in range(3)]
    rows += [("x-odd", "Zahl 1 2 3 4 5 6 7 8 9 10 11")] + [(None, t) for t in ODD]
    return [(i, t, lang) for i, (lang, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def judged(spark):
    rows = sample() + [(7, sample()[7][1], "en"), (None, "und so weiter", "en")]
    docs = spark.createDataFrame([(*r, 1, "l", 2.0) for r in rows],
                                 "doc_id long, text string, lang string, n_words int, level string, low double")
    return rows, quality.judge(docs.repartition(3)).collect()


def test_base_statistics(judged):
    rows, got = judged
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        want = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id][:50]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_verdict_like_the_textbook(judged):
    rows, got = judged
    by_lang = defaultdict(list)
    for i, text, lang in rows:
        by_lang[lang.lower() if lang and re.fullmatch("[a-z]{2,3}", lang.lower()) else "und"].append((i, text))
    verdicts = {}
    for own in by_lang.values():
        score = plain_model([t for _, t in own])
        size = [len(symbols(t)) + 1 for _, t in own]
        levels = [-score(t) / n for (_, t), n in zip(own, size)]
        bins = sorted(math.floor(x / 0.001 + 0.5) for x in levels)
        middle = bins[(len(bins) - 1) // 2]
        half = 5.5 * max(1, sorted(abs(b - middle) for b in bins)[(len(bins) - 1) // 2])
        for (i, _), level, n in zip(own, levels, size):
            drawn = (level * n + middle * 0.001 * 100) / (n + 100)
            verdicts[i] = (level, (middle - half) * 0.001 <= drawn <= (middle + half) * 0.001)
    for r in got:
        level, inside = verdicts[r.doc_id]
        assert math.isclose(math.log10(r.perplexity), level, rel_tol=1e-6, abs_tol=1e-9)
        assert r.kept == (inside and not r.base_failed)
    assert any(not r.kept and not r.base_failed for r in got) and sum(r.kept for r in got) > 50


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"abc ", np.uint8), 3000)
    grams, _ = quality.packed_grams(data, np.array([0, 1000, 3000]))
    keys, counts = np.unique(grams, return_counts=True)
    model = quality.GramModel.__new__(quality.GramModel)
    model.levels = []
    for level in quality.smoothed(keys, counts):
        arrays = {}
        for key, value in (("key", "p"), ("context", "left")):
            h = quality.hashed(level[key])
            arrays[key], arrays[value] = h[np.argsort(h)], level[value][np.argsort(h)]
        model.levels.append(arrays)
    for context in (int(grams[50]) >> 6, 0, 0b111111_000010_000011):
        every = np.uint64(context << 6) + np.arange(64, dtype=np.uint64)
        assert math.isclose((10 ** model.log10(every)).sum(), 1, rel_tol=1e-6)


def test_no_rows(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


class Taken(Exception):
    pass


class Texts:
    """Stands for rows (key, lang, text) and gives the function that a step runs over their batches."""

    def __init__(self, spark):
        self.sparkSession, self.schema = spark, spark.createDataFrame([], "key long, lang string, text string").schema

    def mapInArrow(self, function, _schema):
        raise Taken(function)

    def function(self, step, *args):
        with pytest.raises(Taken) as taken:
            step(self, *args)
        return taken.value.args[0]


def test_workers_hold_pieces_of_a_batch(spark, tmp_path):
    """A batch of many bytes is worked on in pieces: a worker needs far less than tens of times its size."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=700)) for _ in range(2000)] + [None, ""]
    langs = [("en", "de")[k % 2] for k in range(len(texts))]
    size = sum(len(t or "") for t in texts)
    batch = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts)], ["lang", "text"])

    def peak(run):
        tracemalloc.start()
        out = list(run())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    counted, most = peak(lambda: Texts(spark).function(quality.gram_counts)(iter([batch])))
    assert size > 7e6 and most < 12 * size
    want = Counter()
    for lang, text in zip(langs[:50], texts[:50]):
        s = [0] * 3 + symbols(text) + [0]
        want.update((lang, s[i] << 18 | s[i + 1] << 12 | s[i + 2] << 6 | s[i + 3]) for i in range(len(s) - 3))
    few = Texts(spark).function(quality.gram_counts)(iter([batch.slice(0, 50)]))
    assert {(r["lang"], r["gram"]): r["n"] for b in few for r in b.to_pylist()} == want
    models = {}
    for part in counted:
        uri = f"file://{tmp_path}/{part['lang'][0]}.bin"
        quality.GramModel.write(uri, quality.smoothed(part["gram"].to_numpy(), part["n"].to_numpy()))
        models[part["lang"][0].as_py()] = uri
    keyed = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *batch.columns], ["key", *batch.schema.names])
    measured, most = peak(lambda: Texts(spark).function(quality.measures, models)(iter([keyed])))
    assert most < 25 * size
    assert [k for b in measured for k in b["key"].to_pylist()] == list(range(len(texts)))


def test_characters_beyond_ascii_differ():
    """Every character has symbols of its own beyond ASCII, and none is the beginning of another's."""
    every = [tuple(symbols(chr(c))) for c in (*range(0x80, 0xD800, 3), *range(0xE000, 0x110000, 97))]
    known = set(every)
    assert len(known) == len(every)
    assert not any(found[:k] in known for found in every for k in range(1, len(found)))


@pytest.mark.parametrize("first, second", [("прстнвдк", "оеаи"), ("कतनमरलसह", "ािेो"), ("κτνμρλσπ", "αειο")])
def test_scrambled_letters_beyond_ascii(spark, first, second):
    """Texts of one script whose letters come in another order than the other texts' are no good texts."""
    rng = random.Random(7)

    def word():
        return "".join(rng.choice(first) + rng.choice(second) for _ in range(rng.randint(1, 4)))

    rows = [(i, " ".join(word() for _ in range(150)), "xx") for i in range(80)]
    for i in range(80, 83):
        # the same letters, and words as long
        scrambled = ["".join(rng.sample(w, len(w))) for w in rows[i - 80][1].split()]
        rows.append((i, " ".join(scrambled), "xx"))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert not any(r.base_failed for r in got)
    assert not any(r.kept for r in got if r.doc_id >= 80)
    assert sum(r.kept for r in got) >= 75

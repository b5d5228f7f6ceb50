"""Sequence operators against plain models on random conversations, and with position buckets of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from parley.operators import annotate as a
from parley.operators import merge as m
from parley.operators import windows as w
from parley.session import cut_lineage


def random_rows(seed, n_conv=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n_conv):
        at = 0
        for i in range(rng.choice([1, 2, 3, 7, 15, 40])):
            at += rng.choice([0, 5, 20, 29, 30, 31, 200, 4000, 90000, -10])
            rows.append((f"c{c:02d}", i, {
                "at": at, "content": "x" * rng.choice([0, 3, 20, 60, 120]), "user_id": rng.choice(["a", "b", None]),
                "origin": rng.choice(["User", "Agent"]), "private": rng.random() < 0.1, "votes": rng.randint(-2, 3),
                "metadata": {"skipAnalysis": "true"} if rng.random() < 0.15 else {}}))
    return rows


def by_conversation(rows):
    out = {}
    for conv, i, row in rows:
        out.setdefault(conv, []).append({"idx": i, **row})
    return out


def skipped(row):
    return row["metadata"].get("skipAnalysis") == "true"


def model_start(rows, compat):
    size, count, anchor = 0, 0, None
    for row in reversed(rows):
        if skipped(row):
            continue
        anchor = row["at"] if anchor is None else anchor
        forced = size < 100 or count < 2 or row["at"] >= anchor - 180
        allowed = size < 300 and count < 10 and row["at"] >= anchor - 86400
        if not (forced or allowed):
            return row["idx"] if compat else row["idx"] + 1
        size += len(row["content"])
        count += 0 if compat else 1
    return 0


def model_context(rows, i):
    """Neighbours in the order of their distance, forward first where equal; a nearer one behind a farther one on its
    side waits for it.  The first that passes neither limit ends the context."""
    n = len(rows)
    if n <= 2:
        return 0, n
    if i >= n - 1:
        return model_start(rows, True), n
    order = []
    for side, places in ((0, range(i, n)), (1, range(i - 1, -1, -1))):
        ages = [abs(rows[k]["at"] - rows[i]["at"]) * (1 if side == 0 and rows[k]["at"] >= rows[i]["at"]
                                                      or side == 1 and rows[k]["at"] <= rows[i]["at"] else -1) for k in places]
        order += [(max(ages[:j + 1]), side, j, ages[j], k) for j, k in enumerate(places)]
    chars, low, high = 0, i, i
    for taken, (_, _, _, age, k) in enumerate(sorted(order)):
        forced = chars < 100 or taken < 2 or age <= 180
        if not forced and not (chars < 300 and taken < 10 and age <= 86400):
            break
        chars += len(rows[k]["content"]) if forced else 0
        low, high = min(low, k), max(high, k)
    return min(low, max(0, i - 1)), max(high, min(n - 1, i + 1))


def model_runs(rows, timeout):
    runs, last = [], None
    for row in rows:
        if row["private"] or skipped(row):
            continue
        follows = (last is not None and last["user_id"] == row["user_id"] and last["origin"] == row["origin"]
                   and row["at"] < last["at"] + timeout)
        if follows:
            runs[-1].append(row)
        else:
            runs.append([row])
        last = row
    return [(run[0]["idx"], "\n".join(r["content"] for r in run), sum(r["votes"] for r in run)) for run in runs]


@pytest.mark.parametrize("bucket", [4, 4096])
@pytest.mark.parametrize("compat", [False, True])
def test_context_start(messages, bucket, compat):
    rows = random_rows(1)
    got = {r.conv_id: r.start for r in w.context_start(messages(rows), compat=compat, rows=bucket).collect()}
    assert got == {c: model_start(r, False) if not compat else 0 for c, r in by_conversation(rows).items()}


@pytest.mark.parametrize("halo,bucket", [(16, 4096), (2, 8)])
def test_message_context(messages, halo, bucket):
    rows = random_rows(2)
    got = {(r.conv_id, r.idx): (r.start, r.end)
           for r in w.message_context(messages(rows), halo=halo, rows=bucket).collect()}
    # the historic start of a last message is always 0
    want = {(c, i): (model_context(r, i) if i < len(r) - 1 or len(r) <= 2 else (0, len(r)))
            for c, r in by_conversation(rows).items() for i in range(len(r))}
    assert got == want


@pytest.mark.parametrize("bucket", [3, 4096])
def test_merge_consecutive(messages, bucket):
    rows = random_rows(3)
    got = sorted((r.conv_id, r.idx, r.run, r.content, r.votes)
                 for r in w.merge_consecutive(messages(rows), 30, bucket).collect())
    assert [(c, idx, text, votes) for c, idx, _, text, votes in got] == sorted(
        (c, *run) for c, r in by_conversation(rows).items() for run in model_runs(r, 30))


def test_a_run_over_a_bucket_edge_is_one_row(messages):
    rows = [("c", i, {"at": i, "content": str(i), "user_id": "a"}) for i in range(4094, 4098)]
    got = w.merge_consecutive(messages(rows), 30).collect()
    assert [(r.idx, r.content, r.message_idxs) for r in got] == [(4094, "4094\n4095\n4096\n4097", [4094, 4095, 4096, 4097])]


@pytest.mark.parametrize("bucket", [3, 4096])
def test_keep_last_and_window(messages, bucket):
    rows = random_rows(4)
    table = messages(rows)
    kept = sorted((r.conv_id, r.idx) for r in w.keep_last(table, 5, bucket).collect())
    window = sorted((r.conv_id, r.idx, r.start, r.end, r.skipped) for r in w.analysis_window(table, 5, bucket).collect())
    want = [(c, row["idx"]) for c, r in by_conversation(rows).items() for row in r[-5:]]
    assert kept == sorted(want)
    assert window == sorted((c, row["idx"], max(0, len(r) - 5), len(r), sum(skipped(x) for x in r[-5:]))
                            for c, r in by_conversation(rows).items() for row in r[-5:])


def test_effective_window():
    assert [w.effective_window(n) for n in (None, -1, 0, 2, 3, 10)] == [0, 0, 3, 3, 3, 10]


def test_hit_runs_and_neighbours(spark, messages):
    table = messages([("c", i, {}) for i in range(10)])
    hits = spark.createDataFrame([("c", i, float(i)) for i in (0, 1, 2, 5, 8, 9)], "conv_id string, idx int, score double")
    for bucket in (2, 4096):
        runs = w.hit_runs(hits, bucket)
        assert sorted((r.start, r.end, r.score) for r in runs.collect()) == [(0, 3, 0.0), (5, 6, 5.0), (8, 10, 8.0)]
    around = sorted((r.start, r.side, r.idx) for r in w.with_neighbours(runs, table).collect())
    assert around == [(0, "after", 3), (0, "after", 4), (5, "after", 6), (5, "after", 7), (5, "before", 4),
                      (8, "before", 7)]


def test_merge_contained_against_model(spark):
    rng = random.Random(5)
    rows = []
    for msg in range(30):
        for _ in range(rng.randint(1, 12)):
            start = rng.randint(0, 6)
            rows.append(("c", msg, start, start + rng.randint(1, 6), rng.choice("ab"), rng.choice(["Place", "Term"]),
                         [f"h{rng.randint(0, 3)}"], 0.5))
    tokens = spark.createDataFrame(rows, "conv_id string, message_idx int, start int, end int, value string, type string, "
                                         "hints array<string>, confidence double")
    want = []
    for key in sorted({(r[1], r[5]) for r in rows}):
        active = None
        for r in sorted((r for r in rows if (r[1], r[5]) == key), key=lambda r: (r[2], -r[3], r[4])):
            if active is None or r[3] > active[1] or r[4] != active[2]:
                active = [r[2], r[3], r[4], set(r[6])]
                want.append((key, active))
            else:
                active[3].update(r[6])
    want = sorted((k, s, e, v, tuple(sorted(h))) for k, (s, e, v, h) in want)
    got = sorted(((r.message_idx, r.type), r.start, r.end, r.value, tuple(r.hints)) for r in a.merge_contained(tokens).collect())
    assert got == want


def test_latch_slots_with_small_buckets(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("c", i, rng.choice(["x", "y", None]), rng.choice(["Place", "Date", "Attribute", "Keyword"]),
             rng.random()) for i in range(60)]
    tokens = spark.createDataFrame(rows, "conv_id string, token_idx long, value string, type string, confidence double")
    monkeypatch.setattr(a, "bucket_of", lambda c: F.expr(f"`{c}` div 4"))
    got = sorted(r.token_idx for r in a.latch_slots(tokens).collect())
    best, want = {}, []
    for _, i, value, kind, confidence in rows:
        role = {"Place": "location", "Date": "time", "Keyword": "alphabet"}.get(kind)
        if role and value is not None and confidence > best.get((role, value), -1):
            best[role, value] = confidence
            want.append(i)
    assert got == want


def test_message_cap(spark, messages):
    """55 messages under a cap of 50, then one more, then one deleted and one more."""
    conv = spark.createDataFrame([("c", None)], "conv_id string, deleted timestamp")
    table = messages([("c", i, {"msg_id": f"msg-{i}"}) for i in range(50)])
    now = F.current_timestamp()

    def append(table, ids):
        new = messages([("c", i, {"msg_id": name}) for i, name in enumerate(ids)]).withColumnRenamed("idx", "seq")
        merged, rejected = m.append_messages(conv, table, new, now, cap=50)
        assert rejected.isEmpty()
        return cut_lineage(merged)

    def ids(table):
        rows = table.orderBy("idx").collect()
        assert [r.idx for r in rows] == list(range(len(rows)))
        return [r.msg_id for r in rows]

    table = append(table, [f"msg-{i}" for i in range(50, 55)])
    assert (len(ids(table)), ids(table)[0]) == (50, "msg-5")
    table = append(table, ["appended-0"])
    assert (ids(table)[0], ids(table)[-1], len(ids(table))) == ("msg-6", "appended-0", 50)
    table = cut_lineage(m.delete_message(table, spark.createDataFrame([("c", "msg-10")], "conv_id string, msg_id string")))
    assert len(ids(table)) == 49
    table = append(table, ["appended-1"])
    assert (len(ids(table)), ids(table)[0], ids(table)[-1]) == (50, "msg-6", "appended-1")


def test_append_generates_id_and_time(spark, messages):
    conv = spark.createDataFrame([("c", None)], "conv_id string, deleted timestamp")
    new = messages([("c", 0, {"msg_id": " ", "time": None}), ("d", 0, {})]).withColumnRenamed("idx", "seq")
    merged, rejected = m.append_messages(conv, messages([]), new, F.lit("2024-05-05").cast("timestamp"))
    row = merged.first()
    assert len(row.msg_id) == 24 and row.time.year == 2024 and row.time.month == 5
    assert [r.conv_id for r in rejected.collect()] == ["d"]


def test_two_changes_of_one_message(spark, messages):
    stored = messages([("c", 0, {}), ("c", 1, {})])
    changes = messages([("c", 0, {"content": "first", "at": 10}), ("c", 0, {"content": "second", "at": 20}),
                        ("c", 7, {"content": "nobody"}), ("c", 1, {"content": "same", "at": 5}),
                        ("c", 1, {"content": "same", "at": 5})]).drop("idx")
    now, back = m.update_message(stored, changes)
    assert sorted((r.idx, r.content) for r in now.collect()) == [(0, "second"), (1, "same")]
    assert sorted((r.content, r.reason) for r in back.collect()) == [
        ("first", "a later change of the message"), ("nobody", "no such message"), ("same", "a later change of the message")]


def test_later_buckets_are_a_growing_frame(spark):
    """A frame that ends at the last row is summed anew for each row, in the square of a long conversation's buckets."""
    from parley.scan import after

    rows = spark.createDataFrame([(c, b, 10 ** b) for c in (1, 2) for b in range(5)] + [(1, None, 7)],
                                 "conv_id long, bucket long, n long")
    later = rows.withColumn("later", F.sum("n").over(after(["conv_id"], "bucket")))
    got = {(r.conv_id, r.bucket): r.later for r in later.collect()}
    assert all(got[c, b] == (sum(10 ** k for k in range(b + 1, 5)) or None) for c in (1, 2) for b in range(5))
    assert got[1, None] == 11111
    assert "unboundedfollowing" not in later._jdf.queryExecution().toString().lower()

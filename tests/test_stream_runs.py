"""The stream's run merger against a plain model, a message at a time."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from parley.streaming.runs import RunMerger

MIN = 60_000_000
COLUMNS = ["conv_id", "idx", "msg_id", "content", "user_id", "origin", "votes", "voted", "micros"]


class State:
    """What a handle gives, counting the calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def _call(self, rows):
        self.calls += 1
        self.rows = rows

    def get(self):
        self.calls += 1
        return self.rows[0] if isinstance(self.rows, tuple) else iter(list(self.rows))

    def exists(self):
        return bool(self.rows)

    def put(self, rows):
        self._call(list(rows))

    def appendList(self, rows):
        self._call([*self.rows, *rows])

    def update(self, row):
        self._call((row,))

    def clear(self):
        self._call([])


class Handle:
    def __init__(self):
        self.states, self.timers = [], []

    def _new(self, *_):
        self.states.append(State())
        return self.states[-1]

    getListState = getValueState = _new

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def plain(batches, step):
    """(conv, idx, ids, content, votes, late) of batches of messages, each with the watermark at which it comes."""
    out, waiting, runs, lasts = [], {}, {}, {}
    for watermark, rows in batches:
        for r in rows:
            late = r[8] is None or r[8] < watermark
            out += [(r[0], r[1], [r[2]], r[3], r[6] if r[7] else None, True)] if late else []
            waiting.setdefault(r[0], []).extend([] if late else [r])
        for conv, own in waiting.items():
            for r in sorted((r for r in own if r[8] < watermark), key=lambda r: r[1:3]):
                run = runs.get(conv)
                if r[1] <= lasts.get(conv, -1):
                    out.append((conv, r[1], [r[2]], r[3], r[6] if r[7] else None, True))
                    continue
                lasts[conv] = r[1]
                if run and run[-1][4:6] == r[4:6] and r[8] < run[-1][8] + step:
                    run.append(r)
                else:
                    out += [closed(conv, run)] if run else []
                    runs[conv] = [r]
            waiting[conv] = rest = [r for r in own if r[8] >= watermark]
            run = runs.get(conv)
            if run and run[-1][8] + step <= watermark and not any(r[8] < run[-1][8] + step for r in rest):
                out.append(closed(conv, runs.pop(conv)))
    return out


def closed(conv, run):
    votes = sum(r[6] for r in run) if any(r[7] for r in run) else None
    return conv, run[0][1], [r[2] for r in run], "\n".join(r[3] or "" for r in run), votes, False


def merged(batches, step, block):
    merger, handle = RunMerger(step, block), Handle()
    merger.init(handle)
    out = []
    for watermark, rows in batches:
        timer = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark // 1000)
        given = pd.DataFrame(rows, columns=COLUMNS)
        frames = list(merger.handleInputRows((7,), iter([given[:3], given[3:]]), timer)) if rows else []
        if any(t <= watermark // 1000 for t in handle.timers):
            frames += merger.handleExpiredTimer((7,), timer, None)
        for f in frames:
            out += [(r.conv_id, int(r.idx), list(r.message_ids), r.content, None if pd.isna(r.votes) else int(r.votes),
                     bool(r.late)) for r in f.itertuples()]
    return out, sum(s.calls for s in handle.states)


def messages(seed, convs, many, disorder):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        at = 0
        for i in range(rng.randint(1, many)):
            at += rng.choice([0, 5, 20, 40]) * MIN // 60
            conv = None if c == 0 else str(c)
            rows.append((conv, i, f"{c}-{i}", rng.choice([None, "", "text", "a b"]), rng.choice([None, "u", "u", "v"]),
                         rng.choice(["User", "User", "Agent"]), (v := rng.choice([0, 0, 3])), int(v > 0 or i % 2), at))
    rows.sort(key=lambda r: r[8] + rng.randint(0, disorder) * MIN // 60)
    rows += [rows[3], rows[5]]  # repeated ones
    cut = [rows[k:k + 40] for k in range(0, len(rows), 40)]
    watermark, batches = 0, []
    for batch in cut:
        batches.append((watermark, batch))
        watermark = max(watermark, max(r[8] for r in batch) - 3 * MIN)
    return [*batches, (watermark, []), (watermark + 10 * MIN, []), (watermark + 99 * MIN, [])]


@pytest.mark.parametrize("block", [4, 50_000])
@pytest.mark.parametrize("seed", range(12))
def test_run_merger_like_the_plain_model(seed, block):
    batches = messages(seed, 9, 60, 400 if seed % 2 else 0)
    got, _ = merged(batches, 30, block)
    key = lambda r: (r[5], str(r[0]), r[1], r[2], str(r))
    assert sorted(got, key=key) == sorted(plain(batches, 30 * MIN // 60), key=key)


def test_state_calls_do_not_grow_with_conversations():
    """A bucket takes the same few calls to its state however many conversations and messages it has."""
    few, many = (merged(messages(1, n, 20, 0)[:3], 30, 50_000)[1] for n in (5, 500))
    assert many <= few + 4
    assert merged([(0, [(str(c), 0, "m", "t", "u", "User", 1, 1, MIN) for c in range(3000)]), (9 * MIN, [])], 30, 50_000)[1] < 15


def test_message_without_a_time_is_late():
    got, _ = merged([(0, [("1", 0, "m", "t", "u", "User", 1, 1, None), ("1", 1, "n", "t", "u", "User", 0, 0, MIN)]),
                     (9 * MIN, [])], 30, 50_000)
    assert got == [("1", 0, ["m"], "t", 1, True), ("1", 1, ["n"], "t", None, False)]

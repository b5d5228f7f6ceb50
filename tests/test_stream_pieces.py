"""The stream's run merger on many messages at once: slices of what is ready, pieces of long runs."""

from types import SimpleNamespace

import pandas as pd
import pytest
from test_stream_runs import COLUMNS, MIN, Handle, messages, plain

from parley.streaming import runs
from parley.streaming.runs import RunMerger


def given(batches, step, block, piece):
    merger, handle, out = RunMerger(step, block, piece), Handle(), []
    merger.init(handle)
    for watermark, rows in batches:
        timer = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark // 1000)
        cut = [pd.DataFrame(rows[k:k + 7], columns=COLUMNS) for k in range(0, len(rows), 7)]
        frames = list(merger.handleInputRows((7,), iter(cut), timer)) if rows else []
        if any(t <= watermark // 1000 for t in handle.timers):
            frames += merger.handleExpiredTimer((7,), timer, None)
        out += [r for f in frames for r in f.itertuples()]
    return out


def whole(rows):
    out, long = [], {}
    for r in rows:
        votes = None if pd.isna(r.votes) else int(r.votes)
        if r.parts == 1:
            out.append((r.conv_id, int(r.idx), list(r.message_ids), r.content, votes, bool(r.late)))
        else:
            long.setdefault((r.conv_id, int(r.idx), votes, bool(r.late), int(r.parts)), []).append(r)
    for (conv, idx, votes, late, parts), found in long.items():
        found = sorted(found, key=lambda r: r.part)
        assert [r.part for r in found] == list(range(parts))
        out.append((conv, idx, [m for r in found for m in r.message_ids], "\n".join(r.content for r in found), votes, late))
    return out


@pytest.mark.parametrize("block, piece", [(2, 3), (2, 1), (3, 50_000), (50_000, 2)])
@pytest.mark.parametrize("seed", range(4))
def test_slices_and_pieces_like_the_plain_model(seed, block, piece):
    small = messages(seed, 9, 60, 400 if seed % 2 else 0)
    every = [r for _, rows in small for r in rows]
    once = [(0, every), (small[-3][0] // 2, []), (small[-3][0], []), (small[-1][0], [])]
    key = lambda r: (r[5], str(r[0]), r[1], r[2], str(r))
    for batches in (small, once):
        got = given(batches, 30, block, piece)
        assert max(len(r.message_ids) for r in got) <= piece
        assert sorted(whole(got), key=key) == sorted(plain(batches, 30 * MIN // 60), key=key)


def test_a_worker_merges_some_blocks_at_a_time(monkeypatch):
    """One long run: what is merged at once and what comes out at once is bounded."""
    at_once, merge = [], RunMerger._merged
    monkeypatch.setattr(RunMerger, "_merged", lambda self, ready, *rest: at_once.append(ready.num_rows) or merge(self, ready, *rest))
    rows = [("1", i, f"m{i}", "t", "u", "User", 1, 1, MIN + i) for i in range(5000)]
    got = given([(0, rows), (5 * MIN, []), (9 * MIN, rows[:1])], 30, 10, 20)
    assert max(at_once) <= runs.TOGETHER * 10 and sum(at_once) == 5000
    assert max(len(r.message_ids) for r in got) <= 20
    assert sorted(len(r[2]) for r in whole(got)) == [1, 5000]


def test_whole_runs(spark):
    table = spark.createDataFrame(
        [(1, 0, 1, 2, "c\nd", "m2,m3", 5), (1, 0, 0, 2, "a\nb", "m0,m1", 5), (None, 3, 0, 1, "x", "m", None),
         (None, 7, 2, 3, "c", "3", None), (None, 7, 0, 3, "a", "1", None), (None, 7, 1, 3, "b", "2", None)],
        "conv_id long, idx int, part int, parts int, content string, ids string, votes long")
    found = runs.whole_runs(table, {"content": "\n", "ids": ","}).select("conv_id", "idx", "content", "ids", "votes").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [(1, 0, "a\nb\nc\nd", "m0,m1,m2,m3", 5), (None, 3, "x", "m", None), (None, 7, "a\nb\nc", "1,2,3", None)], key=str)

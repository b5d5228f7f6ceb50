"""Runs of messages on a stream, as a stateful processor with list state and timers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parley.operators.windows import indexable_messages

_WAITING = pa.schema([("conv_id", pa.string()), ("idx", pa.int64()), ("msg_id", pa.string()), ("content", pa.string()),
                      ("user_id", pa.string()), ("origin", pa.string()), ("votes", pa.int64()), ("voted", pa.int64()),
                      ("micros", pa.int64())])
_OPEN = pa.schema([("conv_id", pa.string()), ("user_id", pa.string()), ("origin", pa.string()), ("micros", pa.int64()),
                   ("idx", pa.int64()), ("last_idx", pa.int64()), ("votes", pa.int64()), ("voted", pa.int64()),
                   ("kept", pa.int64())])
_PART = pa.schema([("conv_id", pa.string()), ("msg_id", pa.string()), ("content", pa.string())])
_OUT = "conv_id string, idx int, message_ids array<string>, content string, votes long, late boolean, part int, parts int"
_OUT_COLUMNS = ["conv_id", "idx", "message_ids", "content", "votes", "late", "part", "parts"]
_FOREVER = np.iinfo(np.int64).max // 2
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Blocks of messages that go to or come from the state at once.
TOGETHER = 16


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(block)).read_all()


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _codes(*columns: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value of the columns, null being one, and the values."""
    coded = pa.chunked_array([c for x in columns for c in x.chunks], pa.string()).combine_chunks().dictionary_encode(
        null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class RunMerger(StatefulProcessor):
    """A bucket of conversations: messages wait until the watermark has passed them, then join their conversation's open
    run or close it, all conversations of the bucket at once.

    State, in Arrow blocks: the waiting messages; for each conversation who wrote its open run, that run's last message
    and its votes; and the parts of open runs, to which messages are appended without reading them unless a run that has
    some is closed.  A timer stands at the next moment at which something can happen.

    A worker holds some blocks of messages at a time and the state's blocks compressed, however many messages are ready.
    A run of more than ``piece`` messages comes out in pieces: ``part`` 0, 1, ... of ``parts``, see ``whole_runs``.
    """

    def __init__(self, timeout_s: int, block: int = 50_000, piece: int = 50_000):
        self.step = timeout_s * 1_000_000
        self.block = block
        self.piece = piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "low long, high long, block binary")
        self.open = handle.getValueState("open", "block binary")
        self.parts = handle.getListState("parts", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        in_time, blocks = [], []
        for given in rows:
            given = pa.Table.from_pandas(given[_WAITING.names], _WAITING, preserve_index=False)
            if given.column("idx").null_count:
                raise ValueError("a message has no place in its list")
            # a message without a time has no place that a watermark could reach
            late = pc.fill_null(pc.less(given.column("micros"), watermark), True)
            yield from self._alone(given.filter(late))
            given = given.filter(pc.invert(late))
            if given.num_rows:
                in_time.append(given)
            if sum(x.num_rows for x in in_time) >= self.block:
                blocks += self._blocks(pa.concat_tables(in_time))
                in_time = []
            if len(blocks) >= TOGETHER:
                self.waiting.appendList(blocks)
                blocks = []
        if in_time:
            blocks += self._blocks(pa.concat_tables(in_time))
        if blocks:
            self.waiting.appendList(blocks)
        yield from self._advance(watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs() * 1000)

    def _blocks(self, table: pa.Table) -> list[tuple]:
        pieces = (table.slice(at, self.block) for at in range(0, table.num_rows, self.block))
        return [(int(_numbers(x, "micros").min()), int(_numbers(x, "micros").max()), _packed(x)) for x in pieces]

    def _alone(self, late: pa.Table) -> Iterator[pd.DataFrame]:
        for at in range(0, late.num_rows, self.block):
            rows = late.slice(at, self.block)
            yield pd.DataFrame({
                "conv_id": rows.column("conv_id").to_pylist(), "idx": _numbers(rows, "idx").astype(np.int32),
                "message_ids": [[m] for m in rows.column("msg_id").to_pylist()],
                "content": rows.column("content").to_pylist(),
                "votes": pd.array(_numbers(rows, "votes"), "Int64").copy(), "late": True}).assign(
                votes=lambda x: x["votes"].where(_numbers(rows, "voted") > 0), part=np.int32(0), parts=np.int32(1))[_OUT_COLUMNS]

    def _advance(self, watermark: int) -> Iterator[pd.DataFrame]:
        """Work off what the watermark has passed; rows of closed runs, and of messages whose place has been passed."""
        ready, rest = [], []
        for low, high, block in self.waiting.get():
            if low >= watermark:
                rest.append((low, high, block))
            elif high < watermark:
                ready.append(block)
            else:
                table = _unpacked(block)
                passed = pc.less(table.column("micros"), watermark)
                ready.append(_packed(table.filter(passed)))
                rest += self._blocks(table.filter(pc.invert(passed)))
        opened = _unpacked(self.open.get()[0]) if self.open.exists() else _OPEN.empty_table()
        least = int((_numbers(opened, "micros")[_numbers(opened, "idx") >= 0]).min(initial=_FOREVER))
        if ready or least + self.step <= watermark:
            if ready:
                self.waiting.put(rest) if rest else self.waiting.clear()
            for table, last in self._slices(ready):
                opened, late, closing = self._merged(table.combine_chunks(), rest, opened, watermark, last)
                yield from self._alone(late)
                yield from self._closed(*closing)
            self.open.update((_packed(opened),))
        self._wake(watermark, opened, rest)

    def _slices(self, ready: list[bytes]) -> Iterator[tuple[pa.Table, bool]]:
        """The messages of the blocks, some blocks' worth at a time in the order of conversations and places, and whether
        these are the last.  Messages of one place stay together."""
        if len(ready) <= TOGETHER:
            yield pa.concat_tables([_unpacked(b) for b in ready] or [_WAITING.empty_table()]), True
            return
        seen, convs, places = {}, [], []
        for block in ready:
            table = _unpacked(block)
            coded, names = _codes(table.column("conv_id"))
            convs.append(np.array([seen.setdefault(c, len(seen)) for c in names.to_pylist()], np.int64)[coded])
            places.append(_numbers(table, "idx"))
        ends = np.cumsum([len(x) for x in places])
        conv, place = np.concatenate(convs), np.concatenate(places)
        del convs, places
        order = np.lexsort((place, conv))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (conv[order][1:] != conv[order][:-1]) | (place[order][1:] != place[order][:-1])
        number = np.empty(len(order), np.int32)
        number[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) // (TOGETHER * self.block)
        del conv, place, order, fresh
        number = np.split(number, ends[:-1])
        used = np.unique(np.concatenate([np.unique(x) for x in number]))
        for k in used:
            yield pa.concat_tables([_unpacked(b).filter(pa.array(x == k)) for b, x in zip(ready, number) if (x == k).any()]), (
                k == used[-1])

    def _merged(self, ready: pa.Table, rest: list[tuple], opened: pa.Table, watermark: int, last_slice: bool):
        """The open runs afterwards, the messages whose place has been passed, and what ``_closed`` needs to know."""
        n = opened.num_rows
        conv, names = _codes(opened.column("conv_id"), ready.column("conv_id"))
        user, _ = _codes(opened.column("user_id"), ready.column("user_id"))
        origin, kinds = _codes(opened.column("origin"), ready.column("origin"))
        author = user * (len(kinds) + 1) + origin
        place = np.r_[_numbers(opened, "last_idx"), _numbers(ready, "idx")]
        micros = np.r_[_numbers(opened, "micros"), _numbers(ready, "micros")]
        known = np.arange(n + ready.num_rows) < n
        order = np.lexsort((place, ~known, conv))
        tied = ~known[order][1:] & (conv[order][1:] == conv[order][:-1]) & (place[order][1:] == place[order][:-1])
        if tied.any():  # the first in the order of all columns has the place
            ranks = pc.sort_indices(ready, [(c, "ascending") for c in _WAITING.names]).to_numpy().astype(np.int64)
            rank = np.zeros(len(place), np.int64)
            rank[n + ranks] = np.arange(len(ranks))
            order = np.lexsort((rank, place, ~known, conv))
        last = np.full(len(names), -1)
        last[conv[:n]] = place[:n]
        passed = ~known & (place <= last[conv])
        passed[order[1:]] |= (~known[order][1:] & ~known[order][:-1] & (conv[order][1:] == conv[order][:-1])
                              & (place[order][1:] == place[order][:-1]))
        late = ready.take(order[passed[order]] - n)
        order = order[~passed[order]]
        own, at, who = conv[order], micros[order], author[order]
        over = np.r_[_numbers(opened, "idx") < 0, np.zeros(ready.num_rows, bool)][order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ((own[1:] != own[:-1]) | (who[1:] != who[:-1]) | (at[1:] >= at[:-1] + self.step) | over[:-1])
        begin = np.flatnonzero(fresh)
        end = np.r_[begin[1:], len(order)].astype(np.int64) - 1
        run = np.cumsum(fresh) - 1
        go_on = order[begin] < n
        state = np.where(go_on, order[begin], 0)
        value = lambda name: (_numbers(opened, name)[state] if n else np.zeros(len(begin), np.int64))
        first = np.where(go_on, value("idx"), place[order[begin]])
        sums = []
        for name in ("votes", "voted"):
            sums.append(np.add.reduceat(np.r_[_numbers(opened, name), _numbers(ready, name)][order], begin)
                        if len(begin) else np.zeros(0, np.int64))
        votes, voted = sums
        # a message that goes on would have to be earlier than the watermark
        final = np.r_[own[begin][1:] != own[begin][:-1], True] if len(begin) else np.zeros(0, bool)
        limit = at[end] + self.step
        done = final & (limit <= watermark) & last_slice
        if done.any():
            done &= self._earliest(rest, names, int(limit[done].max()))[own[begin]] >= limit
        closes = (~final | done) & (first >= 0)
        held = np.where(go_on, value("kept"), 0)
        fits = order >= n
        told, stays = fits & closes[run], fits & ~closes[run]
        count = lambda which: (np.bincount(run[which], minlength=len(begin)).astype(np.int64) if len(begin)
                               else np.zeros(0, np.int64))
        added, texts, of = count(stays), ready.select(_PART.names), None
        if (closes & (held > 0)).any():
            of = np.full(len(names) + 1, -1)
            of[own[begin[closes & (held > 0)]]] = np.flatnonzero(closes & (held > 0))
        closing = (of, texts.take(order[told] - n), run[told], texts.take(order[stays] - n), names, own[begin], first, votes,
                   voted, held + count(told))
        # the place in the list stays known, so that a straggler is told from a new run
        gone = (done | (first < 0))[final]
        stop = order[end][final]
        text = lambda name: pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), pa.chunked_array(
            opened.column(name).chunks + ready.column(name).chunks, pa.string()).take(pa.array(stop)))
        table = pa.table([
            names.take(pa.array(own[end][final])), text("user_id"), text("origin"), at[end][final],
            np.where(gone, -1, first[final]), place[stop], np.where(gone, 0, votes[final]),
            np.where(gone, 0, voted[final]), np.where(gone, 0, (held + added)[final])], _OPEN)
        return table, late, closing

    def _earliest(self, rest: list[tuple], names: pa.Array, limit: int) -> np.ndarray:
        """The first waiting moment of each conversation, as far as it is before ``limit``."""
        out = np.full(len(names), _FOREVER)
        for low, _, block in rest:
            if low < limit:
                table = _unpacked(block)
                code = pc.index_in(table.column("conv_id"), names)
                here = pc.is_valid(code)
                np.minimum.at(out, code.filter(here).to_numpy().astype(np.int64),
                              table.column("micros").filter(here).to_numpy())
        return out

    def _packed_parts(self, parts: list[pa.Table]) -> list[tuple]:
        table = pa.concat_tables(parts or [_PART.empty_table()])
        return [(_packed(table.slice(at, self.block)),) for at in range(0, table.num_rows, self.block)]

    def _leaving(self, of: np.ndarray, names: pa.Array) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """The parts of closed runs that the state holds, a block at a time with the run of each; the others stay in order."""
        stay, loose = [], []
        for (block,) in self.parts.get():
            table = _unpacked(block)
            code = pc.fill_null(pc.index_in(table.column("conv_id"), names), len(names)).to_numpy().astype(np.int64)
            leaves = of[code] >= 0
            if leaves.any():
                yield table.filter(pa.array(leaves)), of[code][leaves]
                table = table.filter(pa.array(~leaves))
            if not leaves.any() and 2 * table.num_rows >= self.block:
                stay += [*self._packed_parts(loose), (block,)]
                loose = []
            else:
                loose.append(table)
                if sum(x.num_rows for x in loose) >= self.block:
                    stay += self._packed_parts(loose)
                    loose = []
        stay += self._packed_parts(loose)
        self.parts.put(stay) if stay else self.parts.clear()

    def _closed(self, of: np.ndarray | None, told: pa.Table, run: np.ndarray, stays: pa.Table, names: pa.Array,
                conv: np.ndarray, first: np.ndarray, votes: np.ndarray, voted: np.ndarray, number: np.ndarray
                ) -> Iterator[pd.DataFrame]:
        """The rows of closed runs; the messages that go on with an open one are kept.

        ``told``, ``run``: messages of closed runs and the run of each, after those that the state holds (``of``: the run of
        each conversation).  ``number``: how many messages a run has.
        """
        parts = np.maximum(1, -(-number // self.piece))
        given = np.zeros(len(number), np.int64)
        held, group, rows, limit = [], [], 0, TOGETHER * self.piece

        def pieces(table: pa.Table, group: np.ndarray, last: bool) -> Iterator[pd.DataFrame | tuple]:
            order = np.argsort(group, kind="stable")
            group = group[order]
            place = np.arange(len(group)) - np.searchsorted(group, group)
            if not last:  # whole pieces of long runs only
                many = np.bincount(group, minlength=len(number))
                out = (parts[group] > 1) & (place < (many // self.piece * self.piece)[group])
                yield table.take(order[~out]), group[~out]
                order, group, place = order[out], group[out], place[out]
            part = given[group] + place // self.piece
            begin = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])]) if len(
                group) else np.zeros(0, np.int64)
            stop = np.r_[begin[1:], len(group)].astype(np.int64)
            np.add.at(given, group[begin], 1)
            k = 0
            while k < len(begin):  # a block of messages at a time
                to = max(k + 1, int(np.searchsorted(stop, begin[k] + self.block, "right")))
                own = table.take(order[begin[k]:stop[to - 1]]).combine_chunks()
                runs, ends = group[begin[k:to]], np.r_[begin[k:to], stop[to - 1]] - begin[k]
                listed = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column.combine_chunks()) for column in (
                    own.column("msg_id"), pc.fill_null(own.column("content"), ""))]
                yield pd.DataFrame({
                    "conv_id": names.take(pa.array(conv[runs])).to_pylist(), "idx": first[runs].astype(np.int32),
                    "message_ids": listed[0].to_pandas(), "content": pc.binary_join(listed[1], "\n").to_pylist(),
                    "votes": pd.array(votes[runs], "Int64"), "late": False, "part": part[begin[k:to]].astype(np.int32),
                    "parts": parts[runs].astype(np.int32)}).assign(
                    votes=lambda x: x["votes"].where(voted[runs] > 0))[_OUT_COLUMNS]
                k = to

        for table, runs in [] if of is None else self._leaving(of, names):
            held.append(table)
            group.append(runs)
            rows += len(runs)
            if rows >= limit:
                found = pieces(pa.concat_tables(held), np.concatenate(group), False)
                left, runs = next(found)
                held, group, rows, limit = [left], [runs], len(runs), len(runs) + TOGETHER * self.piece
                yield from found
        yield from pieces(pa.concat_tables([*held, told]), np.concatenate([*group, run]), True)
        if stays.num_rows:
            self.parts.appendList(self._packed_parts([stays]))

    def _wake(self, watermark: int, opened: pa.Table, rest: list[tuple]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        moments = [min(low for low, _, _ in rest) // 1000 + 1] if rest else []
        runs = _numbers(opened, "micros")[_numbers(opened, "idx") >= 0]
        if len(runs):
            moments.append((int(runs.min()) + self.step) // 1000 + 1)
        if moments:
            self.handle.registerTimer(max(min(moments), watermark // 1000 + 1))

    def close(self) -> None:
        pass


def merge_consecutive_stream(msg: DataFrame, timeout_s: int = 30, watermark: str = "1 hour", key_type: str = "bigint",
                             buckets: int = 256) -> DataFrame:
    """Runs of messages as in ``merge_consecutive``, on a stream, and the messages that came too late for them.

    The messages of a conversation may arrive in any order within ``watermark``: they wait until it has passed them and
    are taken in list order.  Rows with ``late``: a single message behind the watermark when it came, or behind a place of
    the list that has been worked off, or without a time; nothing vanishes.  A run comes out when a message does not
    continue it, or when the watermark has passed its last message by ``timeout_s``.  ``split_late`` parts the two.  A run
    of more than 50,000 messages comes in pieces (``part`` of ``parts``), all in one batch; ``whole_runs`` puts them together.

    The conversations are dealt out to ``buckets``, each of which is one key of the state; a stream keeps that number.
    """
    # without its event time column the processor gets late rows too, and tells them itself
    source = (indexable_messages(msg).withWatermark("time", watermark)
              .select(F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int").alias("bucket"),
                      F.col("conv_id").cast("string").alias("conv_id"), "idx", "msg_id", "content", "user_id", "origin",
                      F.coalesce(F.col("votes").cast("long"), F.lit(0).cast("long")).alias("votes"),
                      F.col("votes").isNotNull().cast("long").alias("voted"), F.unix_micros("time").alias("micros")))
    source.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    source.sparkSession.conf.set("spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch", TOGETHER)
    return source.groupBy("bucket").transformWithStateInPandas(RunMerger(timeout_s), _OUT, "append", "EventTime").withColumn(
        "conv_id", F.col("conv_id").cast(key_type))


def whole_runs(pieces: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """Runs, the pieces of long ones put together: ``texts`` are text columns and what stands between two pieces of each."""
    rest = [c for c in pieces.columns if c not in ("conv_id", "idx", "part", "parts", *texts)]
    listed = F.array_sort(F.collect_list(F.struct("part", *texts))).alias("_pieces")
    long = pieces.filter("parts > 1").groupBy("conv_id", "idx").agg(*[F.first(c).alias(c) for c in rest], listed)
    joined = [F.array_join(F.col("_pieces")[c], between).alias(c) for c, between in texts.items()]
    return pieces.filter("parts = 1").drop("part", "parts").unionByName(long.select("conv_id", "idx", *rest, *joined))


def split_late(runs: str, late: str):
    """Batch function that writes runs and late messages of the stream to two tables; a repeated batch writes them again."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for path, rows in ((runs, batch.filter("not late")), (late, batch.filter("late"))):
            rows.drop("late").withColumn("batch", F.lit(number)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batch.unpersist()

    return each

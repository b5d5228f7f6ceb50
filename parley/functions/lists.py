"""The best documents of one block for a block of queries, by lists of postings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 6
CELLS = 2_000_000


def rounded(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Numbers in units of the last digit, half up as Spark rounds: by the digits that a number is written with."""
    scaled = x * 10.0 ** digits
    low = np.floor(scaled)
    out = low + (scaled - low >= 0.5)
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(scaled - low - 0.5) < 1e-4 + np.abs(x) * 1e-9):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(unit, ROUND_HALF_UP).scaleb(digits))
    return out


def _codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Equal values of both have the same number."""
    coded = pa.concat_arrays([left, right.cast(left.type)]).dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes[:len(left)], codes[len(left):], len(coded.dictionary)


def _lists(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The entries of all rows, and the row of each."""
    lists = table.column("_terms").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), sizes)


def _field(entries: pa.Array, name: str) -> np.ndarray:
    return pc.struct_field(entries, name).to_numpy(zero_copy_only=False)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Block:
    """Postings of the terms asked for, a list for each term by falling count, then by the order of the documents."""

    def __init__(self, queries: pa.Table, documents: pa.Table, scope: Sequence[str], doc: str):
        q_scope, d_scope = np.zeros(len(queries), np.int64), np.zeros(len(documents), np.int64)
        for c in scope:
            q, d, n = _codes(queries.column(c).combine_chunks(), documents.column(c).combine_chunks())
            q_scope, d_scope = q_scope * n + q, d_scope * n + d
        asked, self.query = _lists(queries)
        held, row = _lists(documents)
        words = pc.struct_field(asked, "term").dictionary_encode()
        term = pc.fill_null(pc.index_in(pc.struct_field(held, "term"), value_set=words.dictionary), -1).to_numpy(
            zero_copy_only=False).astype(np.int64)
        # documents that come twice are one
        ids, _, n = _codes(documents.column(doc).combine_chunks(), documents.column(doc).combine_chunks().slice(0, 0))
        _, self.row, own = np.unique(d_scope * n + ids, return_index=True, return_inverse=True)
        self.docs = len(self.row)
        ranks = pc.sort_indices(documents.select(["votes", doc]).take(pa.array(self.row)), [
            ("votes", "descending"), (doc, "ascending")], null_placement="at_end").to_numpy()
        self.rank = np.empty(self.docs, np.int64)
        self.rank[ranks] = np.arange(self.docs)
        keep = np.flatnonzero(term >= 0)
        many = max(len(words.dictionary), 1)
        key = d_scope[row[keep]] * many + term[keep]
        of, tf = own[row[keep]], _field(held, "tf")[keep].astype(np.float64)
        order = np.lexsort((self.rank[of], -tf, key))
        self.of, self.tf = of[order], tf[order]
        keys, self.begin, self.size = np.unique(key[order], return_index=True, return_counts=True)
        wanted = q_scope[self.query] * many + words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(keys, wanted)
        there = np.flatnonzero(at < len(keys))
        there = there[keys[at[there]] == wanted[there]]
        self.query, self.list = self.query[there], at[there]
        self.boost, self.idf = _field(asked, "boost")[there], _field(asked, "idf")[there]
        # the bound of what is unread holds for positive weights only
        self.heavy = _field(asked, "heavy")[there].astype(bool) & (self.boost * self.idf > 0)
        self._sorted: tuple[np.ndarray, np.ndarray] | None = None

    def counts(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """How often each document holds the term of each list."""
        if self._sorted is None:
            cell = np.repeat(np.arange(len(self.begin)), self.size) * self.docs + self.of
            order = np.argsort(cell, kind="stable")
            cells, first = np.unique(cell[order], return_index=True)
            self._sorted = cells, np.add.reduceat(self.tf[order], first)
        cells, tf = self._sorted
        wanted = lists * self.docs + docs
        at = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
        return np.where(cells[at] == wanted, tf[at], 0.0)

    def best(self, terms: slice, wanted: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, document, score in units) of the queries that the ``terms`` belong to."""
        pending = np.arange(terms.start, terms.stop)
        while len(pending):
            names, query = np.unique(self.query[pending], return_inverse=True)
            lists, weight = self.list[pending], self.boost[pending]
            idf, size, width = self.idf[pending], self.size[self.list[pending]], len(names) * self.docs
            part = self.heavy[pending] & (size > depth)
            read = np.where(part, depth, size)
            at = _ranges(self.begin[lists], read)
            cell = np.repeat(query, read) * self.docs + self.of[at]
            seen = np.bincount(cell, minlength=width) > 0
            whole = np.repeat(~part, read)
            value = np.repeat(weight, read)[whole] * (self.tf[at[whole]] * np.repeat(idf, read)[whole])
            score = np.bincount(cell[whole], value, width).astype(np.float64)
            if part.any():
                score += self._looked_up(seen, len(names), query[part], lists[part], weight[part], idf[part])
            found = self._first(np.where(seen, score, -np.inf).reshape(len(names), self.docs), wanted)
            open_ = self._open(found, len(names), query[part], lists[part], weight[part], idf[part], wanted, depth)
            done = ~open_[found[0]]
            yield names[found[0][done]], found[1][done], found[2][done]
            pending = pending[open_[query]]
            depth *= 8

    def _looked_up(self, seen, queries, query, lists, weight, idf) -> np.ndarray:
        """What the terms whose lists are read in part add to the documents found."""
        cells = np.flatnonzero(seen)
        number = np.bincount(cells // self.docs, minlength=queries)
        begin = np.cumsum(number) - number
        out = np.zeros(len(seen))
        steps = np.cumsum(number[query]) // CELLS
        for step in np.unique(steps):
            t = np.flatnonzero(steps == step)
            n = number[query[t]]
            cell = cells[_ranges(begin[query[t]], n)]
            tf = self.counts(np.repeat(lists[t], n), cell % self.docs)
            out += np.bincount(cell, np.repeat(weight[t], n) * (tf * np.repeat(idf[t], n)), len(seen))
        return out

    def _first(self, score: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of each query in order: query, document, score in units."""
        least = np.full(len(score), -np.inf)
        if self.docs > wanted:
            least = np.partition(score, self.docs - wanted, axis=1)[:, self.docs - wanted]
        # what is rounded to the same number may win by its rank
        query, of = np.nonzero((score >= (least - 2 * 10.0 ** -DIGITS)[:, None]) & (score > -np.inf))
        units = rounded(score[query, of])
        order = np.lexsort((self.rank[of], -units, query))
        query, of, units = query[order], of[order], units[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        few = place < wanted
        return query[few], of[few], units[few]

    def _open(self, found, queries, query, lists, weight, idf, wanted, depth) -> np.ndarray:
        """Queries whose last result does not beat everything still unread in their lists."""
        out = np.zeros(queries, bool)
        if len(query):
            following = self.begin[lists] + depth
            bound = rounded(np.bincount(query, weight * (self.tf[following] * idf), queries))
            nearest = np.zeros(queries, np.int64)
            np.maximum.at(nearest, query, self.rank[self.of[following]])
            number = np.bincount(found[0], minlength=queries)
            last = np.cumsum(number) - 1
            last_units = np.where(number > 0, found[2][last], -np.inf)
            behind = (last_units < bound) | ((last_units == bound) & (self.rank[found[1][last]] > nearest))
            out[query] = True
            out &= (number < wanted) | behind
        return out


def best_of_block(queries: pa.Table, documents: pa.Table, scope: Sequence[str], doc: str, wanted: int, depth: int) -> pa.Table:
    """The ``wanted`` best documents of the block for each query: scope, _q, doc, score, votes.

    ``queries``: scope, _q, _terms (term, boost, idf, heavy); ``documents``: scope, doc, votes, _terms (term, tf).  A score
    is the sum of boost * tf * idf.  Documents are found through the whole lists of terms that are not ``heavy`` and the
    first ``depth`` entries of the others, which are read eight times as deep where that does not settle the best ones.
    """
    block = Block(queries, documents, scope, doc) if len(queries) and len(documents) else None
    out = []
    if block is not None and len(block.query):
        bounds = np.r_[np.flatnonzero(np.r_[True, block.query[1:] != block.query[:-1]]), len(block.query)]
        entries = np.r_[0, np.cumsum(block.size[block.list])][bounds]
        a = 0
        while a < len(bounds) - 1:  # some queries at a time
            b = min(int(np.searchsorted(entries, entries[a] + CELLS, "right")) - 1, a + CELLS // block.docs)
            b = max(b, a + 1)
            out += block.best(slice(bounds[a], bounds[b]), wanted, depth)
            a = b
    query, of, units = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    row = block.row[of] if out else of
    named = {c: queries.column(c).take(pa.array(query)) for c in (*scope, "_q")}
    picked = documents.select([doc, "votes"]).take(pa.array(row))
    return pa.table(named | {doc: picked.column(doc), "score": pa.array(units / 10.0 ** DIGITS, pa.float64()),
                             "votes": picked.column("votes")})

"""Texts as chunks that tokenizers encode independently, numbered by Arrow so that Python sees each new one once.

A chunk begins at a single space between two characters that are no white space.  No piece of a byte-level
pre-tokenizer and no piece of a vocabulary without inner spaces spans such a place, so the tokens of a text are those
of its chunks, one after the other, and a worker encodes a chunk once however often it comes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A chunk is not cut off beside these bytes: ASCII white space and control characters.
BLANK = np.zeros(256, bool)
BLANK[:0x21] = True
BLANK[0x7F] = True


def wide_blanks(data: np.ndarray) -> np.ndarray:
    """Places of all bytes of white space beyond ASCII."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(lead):
        return lead
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    code = (padded[lead].astype(np.int64) << 16) | (padded[lead + 1].astype(np.int64) << 8) | padded[lead + 2]
    two = lead[np.isin(code >> 8, (0xC285, 0xC2A0))]
    three = lead[np.isin(code, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080))
                 | ((code >= 0xE28080) & (code <= 0xE2808A))]
    return np.concatenate([two, two + 1, three, three + 1, three + 2])


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk, and the number of chunks of each text; texts are given by their n + 1 byte offsets."""
    solid = ~BLANK[data]
    wide = wide_blanks(data)
    if len(wide):
        solid[wide] = False
    begin = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        begin[1:-2] = (data[1:-1] == 0x20) & solid[:-2] & solid[2:]
    full = offsets[1:] > offsets[:-1]
    # the character before a text belongs to another one, as does the one after its last
    begin[offsets[1:][full] - 1] = False
    begin[offsets[:-1][full]] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.diff(np.searchsorted(starts, offsets))


def numbered(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each chunk the number of its bytes among the different ones, and those."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    ends = np.append(starts, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


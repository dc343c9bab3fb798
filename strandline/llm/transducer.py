"""Finite transducers over symbol streams, run as composed state-transition functions.

A stream of symbols is cut into chunks. A chunk's effect is a function from the state before it to
the state after it; all chunks' functions are computed side by side, a parallel prefix scan composes
them, and with the state before each chunk known, all chunks emit their output side by side.
"""

from __future__ import annotations

import numpy as np


def prefix_compose(functions: np.ndarray) -> np.ndarray:
    """Row i: the composition of functions 0..i (first 0, then 1, ...). Hillis-Steele scan, log2 steps."""
    done, step = functions.copy(), 1
    while step < len(done):
        # what comes first is looked up first: later[earlier]
        done[step:] = np.take_along_axis(done[step:], done[:-step].copy(), axis=1)
        step *= 2
    return done


def run(table: np.ndarray, emits: np.ndarray, symbols: np.ndarray, start: int, chunk: int = 256) -> np.ndarray:
    """What the transducer emits at each symbol. ``table`` and ``emits`` are [state, symbol]."""
    n, states = len(symbols), table.shape[0]
    if not n:
        return np.zeros(0, emits.dtype)
    idle = table.shape[1]  # padding: leaves every state as it is
    table = np.concatenate([table, np.arange(states, dtype=table.dtype)[:, None]], axis=1)
    emits = np.concatenate([emits, np.zeros((states, 1), emits.dtype)], axis=1)
    rows = -(-n // chunk)
    cells = np.full(rows * chunk, idle, dtype=np.int64)
    cells[:n] = symbols
    cells = np.ascontiguousarray(cells.reshape(rows, chunk).T)  # step-major: all chunks take a step at once
    before = np.full(rows, start, dtype=np.int64)
    if rows > 1:
        functions = np.tile(np.arange(states, dtype=np.int64), (rows, 1))
        for symbol in cells:
            functions = table[functions, symbol[:, None]].astype(np.int64)
        before[1:] = prefix_compose(functions)[:-1, start]
    out = np.empty((chunk, rows), emits.dtype)
    for i, symbol in enumerate(cells):
        out[i] = emits[before, symbol]
        before = table[before, symbol].astype(np.int64)
    return out.T.reshape(-1)[:n]

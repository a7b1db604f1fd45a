"""A zero-phase Butterworth low-pass in NumPy."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, wn: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital low-pass with cutoff `wn` of the Nyquist rate."""
    if not 0 < wn < 1:
        raise ValueError("the cutoff must lie between 0 and the Nyquist rate")
    k = np.arange(1, order + 1)
    warped = 4 * np.tan(np.pi * wn / 2)
    poles = warped * np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    gain = (warped**order / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)).real, np.poly((4 + poles) / (4 - poles)).real


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state under a constant input of one."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[np.arange(1, n), np.arange(n - 1)] = 1
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


#: Rows whose response is one matrix product.
BLOCK = 128


class Recurrence:
    """y[t] = C z[t] + D x[t], z[t+1] = A z[t] + B x[t]: the filter as a linear recurrence over its state z.

    Blocks of rows are answered from a zero state at once, by matrix products. The state that each
    block leaves is then carried to the next by a scan that doubles its reach each step, and what a
    state adds to its block is one more product. So no step is taken for a row, and parts of a
    series can be joined by their last states alone.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray, block: int = BLOCK):
        n = len(a) - 1
        self.order, self.block = n, block
        step = np.zeros((n, n))
        step[:, 0] = -a[1:]
        step[np.arange(n - 1), np.arange(1, n)] = 1
        self._step, enter = step, b[1:] - a[1:] * b[0]
        seen = np.zeros((block, n))  # what a state adds to each row: C A^k
        left = np.zeros((block, n))  # what a row leaves in the state at the block's end: A^(block-1-k) B
        state, own = np.eye(n)[0], enter
        for k in range(block):
            seen[k] = state
            left[block - 1 - k] = own
            state, own = state @ step, step @ own
        answer = np.concatenate([[b[0]], seen[:-1] @ enter])
        places = np.subtract.outer(np.arange(block), np.arange(block))
        self._answers = np.where(places >= 0, answer[np.maximum(places, 0)], 0.0)
        self._seen, self._left = seen, left

    def power(self, rows: int) -> np.ndarray:
        """What so many rows make of a state."""
        return np.linalg.matrix_power(self._step, rows)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The answers to x, and the state after it, from `state` on."""
        m = -(-len(x) // self.block)
        rows = np.zeros((m, self.block))
        rows.ravel()[: len(x)] = x
        states = np.concatenate([state[None], (rows @ self._left)[:-1]]) if m else state[None]
        jump, reach = self.power(self.block), 1
        while reach < m:
            ahead = states.copy()
            ahead[reach:] += states[:-reach] @ jump.T
            states, jump, reach = ahead, jump @ jump, 2 * reach
        out = (rows @ self._answers.T + states @ self._seen.T).ravel()[: len(x)] if m else np.zeros(0)
        rest = len(x) - (m - 1) * self.block if m else 0
        last = rows[m - 1, :rest] @ self._left[self.block - rest :] if m else 0.0
        return out, (self.power(rest) @ states[-1] + last if m else state)


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward pass with odd extension of 3 * (order + 1) rows at either end."""
    pad = 3 * len(a)
    if len(x) <= pad:
        raise ValueError(f"the filter needs more than {pad} rows")
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    zi, filter_ = _steady(b, a), Recurrence(b, a)
    ahead = filter_.run(wide, zi * wide[0])[0][::-1]
    return filter_.run(ahead, zi * ahead[0])[0][::-1][pad:-pad]


def smooth(values: np.ndarray, step_min: float, cutoff_min: float, order: int = 3) -> np.ndarray:
    """Low-pass a complete, evenly spaced series."""
    if cutoff_min <= 2 * step_min:
        raise ValueError(f"a cutoff of {cutoff_min:g} min is at or above the Nyquist limit of {2 * step_min:g} min")
    return filtfilt(*butterworth(order, 2 * step_min / cutoff_min), np.asarray(values, float))

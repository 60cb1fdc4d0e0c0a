"""Per-key sequential state machines shared by the batch and streaming
operators: the token-bucket throttle (Z1) and the TTL result cache (Z4).

Both are genuinely sequential per key (each decision depends on the
previous ones), so they run as a scan over one key's events in time order.
The batch twins get that order from Spark (``repartition`` by key +
``sortWithinPartitions``, which spills instead of holding a key in
memory) and stream rows through ``mapInPandas`` with the state carried
between batches of the same partition; the streaming versions keep the
state in Spark's state store (``applyInPandasWithState``).
"""

from __future__ import annotations

from typing import Iterable, Iterator

import pandas as pd


class TokenBucket:
    """New key starts with ``burst`` tokens; refill ``rpm/60`` per
    second up to ``burst``; a request is allowed iff at least one token is
    available, which it consumes; a denial leaves the state unchanged (the
    same as storing the capped refill, since refills are monotone)."""

    def __init__(self, rpm: float = 60, burst: float = 10):
        self.rate = rpm / 60.0
        self.burst = float(burst)

    def step(self, state, t: float):
        """state = (tokens, last_update) or None -> (new_state, allowed,
        tokens_before, retry_after)."""
        if state is None:
            tokens = self.burst
        else:
            tok, last = state
            tokens = min(self.burst, tok + (t - last) * self.rate)
        if tokens >= 1:
            return (tokens - 1, t), True, tokens, 0.0
        retry = (1 - tokens) / self.rate
        return state, False, tokens, retry


class TtlCache:
    """A request is a hit iff the key's cached entry is still live
    (``expires_at > t``, or ``>=`` for the service boundary); a miss stores
    a fresh entry expiring at ``t + ttl``."""

    def __init__(self, ttl_seconds: float, boundary: str = "root"):
        self.ttl = float(ttl_seconds)
        self.boundary = boundary

    def step(self, state, t: float):
        live = state is not None and (state[0] > t if self.boundary == "root" else state[0] >= t)
        if live:
            return state, True
        return (t + self.ttl,), False


def scan_sorted(frames: Iterable[pd.DataFrame], key: str, ts: str, machine, emit) -> Iterator[pd.DataFrame]:
    """Run ``machine`` over rows already sorted by (key, ts), carrying the
    current key's state across Arrow batches. ``emit(row, state, result)``
    returns the output dict for a row."""
    cur_key, state = object(), None
    for pdf in frames:
        out = []
        for row in pdf.itertuples(index=False):
            k = getattr(row, key)
            if k != cur_key:
                cur_key, state = k, None
            state, *res = machine.step(state, getattr(row, ts))
            out.append(emit(row, state, res))
        if out:
            yield pd.DataFrame(out)

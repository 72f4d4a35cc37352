"""The two-threshold latch over a stream of samples: segments come out as they close.

State is one row a recording, so it grows with open recordings and not with samples. Samples of a recording must come in
order, and a missing value changes nothing; a recording silent for longer than the timeout closes its open segment and gives its state back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "rec long, s long, e long"
STATE = "start long, last long"


def stream_latch(samples: DataFrame, enter: float, leave: float, timeout_ms: int = 600_000) -> DataFrame:
    """``rec, s, e`` of closed segments from a stream of ``rec, i, v``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last = state.get if state.exists else (-1, -1)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"rec": [key[0]], "s": [start], "e": [last + 1]} if start >= 0 else {"rec": [], "s": [], "e": []})
            return
        closed = [np.empty((2, 0), np.int64)]
        for b in batches:
            b = b.sort_values("i")
            i, v = b["i"].to_numpy(), b["v"].to_numpy(float)
            if not len(i):
                continue
            decides = np.where(v >= enter, 1, np.where(v < leave, 0, -1))
            decided = np.maximum.accumulate(np.where(decides >= 0, np.arange(len(v)), -1))
            on = np.where(decided >= 0, decides[decided] == 1, start >= 0)
            turns = np.diff(np.append(start >= 0, on).astype(np.int8))
            begins, ends = np.append(start, i[turns == 1])[0 if start >= 0 else 1 :], i[turns == -1]
            closed.append(np.stack([begins[: len(ends)], ends]))
            start, last = begins[-1] if len(begins) > len(ends) else -1, i[-1]
        state.update((int(start), int(last)))
        state.setTimeoutDuration(timeout_ms)
        s, e = np.concatenate(closed, 1)
        yield pd.DataFrame({"rec": key[0], "s": s, "e": e})

    return samples.groupBy("rec").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)

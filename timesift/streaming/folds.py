"""The ordered passes over streams.

Rows wait in state until the watermark passes them, then go through the same step as the batch
pass, in order, so that results do not depend on how rows fell into micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timesift.operators.keyed import Step


def stream_fold(df: DataFrame, keys: Sequence[str], ts: str, idx: str, uses: Sequence[str], step: Step,
                adds: str) -> DataFrame:
    """(keys, idx, added columns) of the rows ``step`` keeps. ``df`` must carry a watermark on ``ts``.

    State per key: the step's own state and the rows newer than the watermark.
    """
    keys, uses = list(keys), list(uses)
    added = T._parse_datatype_string(adds).fields if adds else []
    out_schema = T.StructType([df.schema[k] for k in keys] + [df.schema[idx], *added])
    names = [f.name for f in out_schema.fields]

    def plain(value):
        return value.item() if hasattr(value, "item") else (list(value) if hasattr(value, "tolist") else value)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, waiting = (json.loads(s) for s in state.get) if state.exists else (None, [])
        if not state.hasTimedOut:
            for batch in batches:
                waiting += [[int(t), plain(at), [plain(v) for v in values]]
                            for t, at, values in zip(batch["__ms"], batch[idx], zip(*[batch[c] for c in uses]))]
        mark = state.getCurrentWatermarkMs()
        ready = sorted((w for w in waiting if w[0] <= mark), key=lambda w: w[:2])
        waiting = [w for w in waiting if w[0] > mark]
        made = []
        for _, at, values in ready:
            out, fold = step(fold, *values)
            if out is not None:
                made.append((*key, at, *out))
        state.update((json.dumps(fold), json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(w[0] for w in waiting), mark + 1))
        yield pd.DataFrame(made, columns=names)

    # Milliseconds are taken before the rows reach Python, where times follow the session zone.
    slim = df.select(*dict.fromkeys([*keys, ts, idx, *uses]), F.unix_millis(ts).alias("__ms"))
    return slim.groupBy(*keys).applyInPandasWithState(
        run, out_schema, "fold string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def budget_step(max_bytes: int, max_sends: int):
    """Budget with a latch, by running totals over all sends asked for so far; a bound of 0 is none.

    A send is allowed while all sends up to it keep to both bounds and those before it reached none of them: a send
    that lands on a bound is the last one.
    """
    bounds = [(i, bound) for i, bound in enumerate((max_bytes, max_sends)) if bound]

    def step(state, size: int):
        before = state or [0, 0]
        after = [before[0] + int(size), before[1] + 1]
        allowed = all(after[i] <= bound and before[i] < bound for i, bound in bounds)
        return (allowed,), after

    return step


def spacing_step(spacing: float, memory: int = 4):
    """Keep an item when it is at least ``spacing`` after each of the last kept ones."""

    def step(state, t: float):
        kept = state or []
        if any(t - other < spacing for other in kept):
            return None, kept
        return (), [*kept, float(t)][-memory:]

    return step

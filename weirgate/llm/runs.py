"""Streaming over a partition that is sorted by (s, salt, id): rows that share their (s, salt), each with the first of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def shared_rows(batches: Iterator[pa.RecordBatch], names: list[str], previous: bool = False) -> Iterator[pa.RecordBatch]:
    """s, salt, names.., first_names..: of each run of one (s, salt) that has several rows; of runs with salt > 0 also if they have one row,
    as other salts hold other rows of that s. names are integer columns. previous: also prev_names.., of the last row of the run
    that has another id (names has id), or the row's own if there is none before it. One row is held back between batches, so that runs may be of any length."""
    held: dict[str, pa.Array] | None = None
    first: dict[str, np.ndarray] = {}  # of the held row's run
    prev: dict[str, np.ndarray] = {}  # of the held row
    joined = False  # whether that run began before the held row

    for rows in batches:
        if not rows.num_rows:
            continue
        kinds = {c: rows.schema.field(c).type for c in ["s", "salt", *names]}
        x = {c: np.asarray(rows.column(c)) for c in kinds}
        x = {c: np.concatenate([held[c], v]) for c, v in x.items()} if held else x
        n = len(x["s"])
        same = (x["s"][1:] == x["s"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
        before = np.concatenate([[bool(held) and joined], same])
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(n), 0))
        lead = {c: x[c][begin] for c in names}
        if before[0]:
            lead = {c: np.where(begin == 0, first[c], v) for c, v in lead.items()}
        last: dict[str, np.ndarray] = {}
        if previous:
            fresh = np.concatenate([[True], ~same | (x["id"][1:] != x["id"][:-1])])
            lies = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # first row of that id in the run
            inner = np.concatenate([[False], same])[lies]
            last = {c: np.where(inner, x[c][np.where(inner, lies - 1, np.arange(n))], x[c]) for c in names}
            if prev:  # rows of the held row's id and run
                last = {c: np.where(lies == 0, np.where(prev["id"] == x["id"][0], v, prev[c]), v) for c, v in last.items()}
        keep = np.flatnonzero(before[:-1] | same | (x["salt"][:-1] > 0))
        yield _batch(x, lead, last, keep, kinds)
        held, first, joined = {c: v[-1:] for c, v in x.items()}, {c: v[-1:] for c, v in lead.items()}, bool(before[-1])
        prev = {c: v[-1:] for c, v in last.items()}
    if held and (joined or held["salt"][0] > 0):
        yield _batch(held, first, prev, np.zeros(1, int), kinds)


def _batch(x: dict[str, np.ndarray], lead: dict[str, np.ndarray], last: dict[str, np.ndarray], keep: np.ndarray, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    own = {c: pa.array(v[keep], kinds[c]) for c, v in x.items()}
    firsts = {f"first_{c}": pa.array(v[keep], kinds[c]) for c, v in lead.items()}
    return pa.RecordBatch.from_pydict(own | firsts | {f"prev_{c}": pa.array(v[keep], kinds[c]) for c, v in last.items()})

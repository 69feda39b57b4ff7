"""Page-wise kernels over rows that are partitioned and sorted by page: streamed, so no group is built by the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that goes back, at least (but for the last of a task).
OUT_ROWS = 20_000


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def page_kernel(fn: Callable[[int, int, list[dict]], Iterator[tuple]], schema: pa.Schema):
    """A mapInArrow function that calls fn with the rows of each page (doc_id and page_no come first, and sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["doc_id"], row["page_no"])
                if at != key:
                    if own:
                        out.extend(fn(*key, own))
                    key, own = at, []
                own.append(row)
            if len(out) >= OUT_ROWS:
                yield to_batch(out, schema)
                out = []
        if own:
            out.extend(fn(*key, own))
        if out:
            yield to_batch(out, schema)

    return run

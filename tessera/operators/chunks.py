"""Writing rows to a store in chunks that shrink where the store refuses them, on the executors, with an account of what was done."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

STATS = "partition int, items long, written long, chunks long, retries long, reductions long, skipped long, last_size int, errors array<string>"


def write_in_chunks(
    rows: DataFrame, write: Callable[[pd.DataFrame], None], size: int = 200, least: int = 10, attempts: int = 3,
    may_pass: Callable[[Exception], bool] = lambda e: True, pause: float = 0.1,
) -> DataFrame:
    """One row of :data:`STATS` a partition; writing happens when the result is read, once.

    ``write`` is given a chunk of at most ``size`` rows. An error that ``may_pass`` halves the chunk, down to ``least`` rows, and the
    rows are tried again; at that size, and for other errors, ``attempts`` are made, with a growing pause, before the chunk is
    skipped and accounted for. Every ten chunks that went well the size grows by half again, up to ``size``. A partition holds one Arrow batch at
    a time. A task that runs again writes its rows again, so ``write`` should be a merge by key.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        s = dict(items=0, written=0, chunks=0, retries=0, reductions=0, skipped=0)
        errors, now = [], size
        for part in parts:
            s["items"] += len(part)
            at, failed = 0, 0
            while at < len(part):
                chunk = part.iloc[at : at + now]
                try:
                    write(chunk)
                except Exception as e:
                    s["retries"] += 1
                    if may_pass(e) and now > least:
                        now, failed = max(now // 2, least), 0
                        s["reductions"] += 1
                        continue
                    failed += 1
                    if failed < attempts:
                        time.sleep(pause * failed)
                        continue
                    errors.append(str(e)[:300])
                    s["skipped"] += len(chunk)
                else:
                    s["written"] += len(chunk)
                    s["chunks"] += 1
                    if now < size and s["chunks"] % 10 == 0:
                        now = min(size, max(now + 1, now * 3 // 2))
                at, failed = at + len(chunk), 0
        yield pd.DataFrame([{"partition": TaskContext.get().partitionId(), **s, "last_size": now, "errors": errors}])

    return rows.mapInPandas(run, STATS)

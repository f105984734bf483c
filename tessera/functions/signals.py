"""Signals of titles as a table: kind, names, threshold, direction, detail, hour and date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.functions.titles import parse

SCHEMA = "id long, kind string, names array<string>, threshold double, direction string, detail string, hour int, year int, month int, day int"


def read_signals(markets: DataFrame) -> DataFrame:
    """A row for every market whose title can be read; columns id, title, close_time and created_at are used."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, title, close, made in zip(part["id"], part["title"], part["close_time"], part["created_at"]):
                close, made = (x.to_pydatetime() if x is not None and not pd.isna(x) else None for x in (close, made))
                p = parse(title if isinstance(title, str) else None, close, made)
                if p:
                    out.append((i, *(p[k] for k in ("kind", "names", "threshold", "direction", "detail", "hour", "year", "month", "day"))))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            for c in ("hour", "year", "month", "day"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    return markets.select("id", "title", "close_time", "created_at").mapInPandas(run, SCHEMA)

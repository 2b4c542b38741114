"""Small helpers for fixtures."""

from __future__ import annotations

import datetime as dt


def at(seconds: float, base: dt.datetime = dt.datetime(2026, 3, 18, 12)) -> dt.datetime:
    return base + dt.timedelta(seconds=seconds)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)

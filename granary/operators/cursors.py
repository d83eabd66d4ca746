"""Cursors: rows of a query in batches, on the driver, one partition at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


class Cursor:
    """OPEN, FETCH n, CLOSE. Each fetch goes on where the last one ended; at most one partition of the result is held."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self.rows = None
        self.fetched = 0

    def open(self) -> Cursor:
        self.rows = self.df.toLocalIterator()
        return self

    def fetch(self, want: int = 1) -> list[Row]:
        """Up to want further rows; none once all are fetched."""
        if self.rows is None:
            raise ValueError("the cursor is not open")
        out = []
        for row in self.rows:
            out.append(row)
            if len(out) == want:
                break
        self.fetched += len(out)
        return out

    def close(self) -> None:
        self.rows = None

    def __enter__(self) -> Cursor:
        return self.open()

    def __exit__(self, *_: object) -> None:
        self.close()

"""Nested transactions as a stack of staged states; states are immutable DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Staged:
    """Named tables under change.  Reads see the innermost frame that staged a table.

    begin() opens a frame, commit() folds it into the one below, abort() forgets it.  What
    is left in the outermost frame is what a database publishes, all tables at once.
    """

    def __init__(self, tables: dict[str, DataFrame]):
        self._base = dict(tables)
        self._frames: list[dict[str, DataFrame | None]] = [{}]

    def __getitem__(self, name: str) -> DataFrame:
        for frame in reversed(self._frames):
            if name in frame:
                if frame[name] is None:
                    raise KeyError(name)
                return frame[name]
        return self._base[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self._frames[-1][name] = df

    def __delitem__(self, name: str) -> None:
        self[name]
        self._frames[-1][name] = None

    def __contains__(self, name: str) -> bool:
        try:
            self[name]
        except KeyError:
            return False
        return True

    def fork(self, name: str, new: str) -> None:
        """Another name for the present state of a table; neither sees the other's changes."""
        self[new] = self[name]

    def begin(self) -> None:
        self._frames.append({})

    def commit(self) -> None:
        if len(self._frames) == 1:
            raise RuntimeError("no inner transaction is open")
        top = self._frames.pop()
        self._frames[-1].update(top)

    def abort(self) -> None:
        if len(self._frames) == 1:
            self._frames[0].clear()
        else:
            self._frames.pop()

    @property
    def changes(self) -> dict[str, DataFrame | None]:
        """What the outermost frame staged; None is a table that goes."""
        if len(self._frames) > 1:
            raise RuntimeError("an inner transaction is open")
        return dict(self._frames[0])

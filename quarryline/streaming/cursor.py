"""A streaming source for interfaces that page by cursor.

An interface gives, for a cursor (None at the beginning), the rows of a page and the
cursor of the next page, or None where no page follows yet.  The stream's offset is a
cursor and the number of rows of its page that are delivered, so a stream that stops
between pages, or inside the last one, goes on from its checkpoint and neither loses
nor repeats a row.  The driver follows the cursors only; the rows of a page are fetched
by the task that the page is dealt to.  Pages must not change but by rows added to the
last one, and how many pages there are is never asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

Fetch = Callable[[str | None], tuple[list[tuple], str | None]]
#: Pages that one batch takes at most.
PAGES = 1000


@dataclass
class Part(InputPartition):
    """Rows ``first`` to ``last`` (exclusive; -1 for all) of the page at a cursor."""

    cursor: str | None
    first: int
    last: int


def cursor_source(name: str, schema: str, fetch: Fetch, pages: int = PAGES) -> type[DataSource]:
    """A data source to register with ``spark.dataSource.register`` and to read as a stream by its name."""

    class Reader(DataSourceStreamReader):
        def __init__(self) -> None:
            self.at: dict = self.initialOffset()

        def initialOffset(self) -> dict:
            return {"cursor": "", "row": 0}

        def _ahead(self, offset: dict) -> tuple[dict, bool]:
            """The offset after the page at this one, and whether a page follows it."""
            rows, after = fetch(offset["cursor"] or None)
            return ({"cursor": after, "row": 0}, True) if after else ({"cursor": offset["cursor"], "row": len(rows)}, False)

        def latestOffset(self) -> dict:
            more = True
            for _ in range(pages):
                self.at, more = self._ahead(self.at)
                if not more:
                    break
            return dict(self.at)

        def partitions(self, start: dict, end: dict) -> list[Part]:
            parts, at = [], dict(start)
            while at["cursor"] != end["cursor"]:
                parts.append(Part(at["cursor"] or None, at["row"], -1))
                at, more = self._ahead(at)
                if not more:
                    raise ValueError(f"the pages after {start['cursor']!r} do not lead to {end['cursor']!r}")
            if at["row"] < end["row"]:
                parts.append(Part(at["cursor"] or None, at["row"], end["row"]))
            # After a restart the checkpoint is ahead of a reader that begins anew.
            self.at = dict(end)
            return parts

        def read(self, partition: Part) -> Iterator[tuple]:
            rows, _ = fetch(partition.cursor)
            yield from rows[partition.first : None if partition.last < 0 else partition.last]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema) -> Reader:
            return Reader()

    return Source

"""Queries that go on: an opaque token names a query's state, which is kept in a shared folder.

The state is a small JSON file; what a query has found lies beside it as tables. A token says
nothing about either. Canceled, expired, stale and changed queries are errors, never other answers.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession

#: Milliseconds after which an untouched query is over, queries that one call retires, and bytes of a token. Work and page limits of a call.
IDLE_MS, RETIRED_AT_ONCE, MAX_TOKEN, MAX_WORK, MAX_PAGE = 30 * 60_000, 50, 128, 50, 50
#: Rows that are read ahead of a query's calls.
AHEAD_ROWS = 2048
_TOKEN = re.compile(r"([a-z]+)-v1:([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")


class QueryError(ValueError):
    """Why a continuation is not possible: invalid, canceled, stale, expired or changed."""


@dataclass
class Answer:
    """One call's share of a query: `complete` when nothing is left, else `next_cursor` goes on."""

    results: list
    revision: str
    next_cursor: str | None
    complete: bool
    work_units: int
    diagnostics: list = field(default_factory=list)


def check_limits(work_budget: int, page_size: int) -> None:
    if not 1 <= work_budget <= MAX_WORK or not 1 <= page_size <= MAX_PAGE:
        raise QueryError(f"a call has 1 to {MAX_WORK} units of work and 1 to {MAX_PAGE} results")


class Ahead:
    """Rows in order, read some way ahead of the calls that take them, so that not every call asks Spark.

    What was read for one query is held, AHEAD_ROWS rows at most; a call that goes on elsewhere reads anew.
    """

    def __init__(self) -> None:
        self.of, self.start, self.rows, self.at, self.ended = None, None, [], {}, False

    def after(self, query: str, last: object, count: int, key: Callable[[Row], object], read: Callable[[int], list[Row]]) -> list[Row]:
        """The `count` rows behind the one with key `last`, fewer at the end; read(n) gives the first n of them."""
        place = (0 if last == self.start else self.at.get(last)) if self.of == query else None
        if place is None or (len(self.rows) - place < count and not self.ended):
            # The first call reads what it takes: it may be the only one.
            size = max(count, AHEAD_ROWS) if self.of == query else count
            rows = read(size)
            self.of, self.start, self.rows, self.ended, place = query, last, rows, len(rows) < size, 0
            self.at = {key(row): n for n, row in enumerate(rows, 1)}
        return self.rows[place : place + count]


class Store:
    """States of one kind of query below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, clock=lambda: int(time.time() * 1000)) -> None:
        self.spark, self.folder, self.kind, self.clock = spark, folder.rstrip("/"), kind, clock
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(self.folder))

    def tables(self, name: str) -> str:
        """Where a query's tables lie."""
        return f"{self.folder}/{name}"

    def token(self, name: str) -> str:
        return f"{self.kind}-v1:{name}"

    def _state(self, name: str) -> str:
        return f"{self.folder}/{name}.json"

    def save(self, name: str, state: dict) -> None:
        out = self.files.create(self.path(self._state(name)), True)
        out.write(bytearray(json.dumps({**state, "updated": self.clock()}).encode()))
        out.close()

    def begin(self, state: dict) -> str:
        name = str(uuid.uuid4())
        self.save(name, {**state, "canceled": False})
        return name

    def name_of(self, token: str) -> str:
        found = _TOKEN.fullmatch(token) if len(token.encode()) <= MAX_TOKEN else None
        if not found or found[1] != self.kind:
            raise QueryError("invalid: no such query")
        return found[2]

    def read(self, name: str) -> dict:
        if not self.files.exists(self.path(self._state(name))):
            raise QueryError("invalid: no such query")
        file = self.files.open(self.path(self._state(name)))
        state = bytes(file.readAllBytes()).decode()
        file.close()
        return json.loads(state)

    def resume(self, token: str, revision: str, signature: str | None = None) -> tuple[str, dict]:
        """(name, state) of a query that may go on."""
        name = self.name_of(token)
        state = self.read(name)
        for wrong, why in (
            (state["canceled"], "canceled"), (state["revision"] != revision, "stale: the collection has changed"),
            (state["updated"] < self.clock() - IDLE_MS, "expired"), (signature is not None and state.get("signature") != signature, "changed: not the query that began"),
        ):
            if wrong:
                raise QueryError(why)
        return name, state

    def cancel(self, token: str) -> None:
        name = self.name_of(token)
        self.save(name, {**self.read(name), "canceled": True})

    def retire(self) -> int:
        """Remove canceled and expired queries, so many at once at most; how many went."""
        gone = 0
        for status in self.files.listStatus(self.path(self.folder)):
            file = status.getPath().getName()
            if file.endswith(".json") and gone < RETIRED_AT_ONCE:
                state = self.read(file[:-5])
                if state["canceled"] or state["updated"] < self.clock() - IDLE_MS:
                    self.files.delete(self.path(self.tables(file[:-5])), True)
                    self.files.delete(status.getPath(), False)
                    gone += 1
        return gone

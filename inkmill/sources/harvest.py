"""S-22..S-25, S-28, S-29, R-03: paged listings as a data source whose offset survives restarts.

The pages come from a ``fetch`` function that the caller names as ``module:function``: it takes a token ("" for the first page), the option
``argument`` if given, and one of the option ``credentials`` if given, and returns (records, next token or None). Nothing here opens a connection.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from inkmill.sources.paths import open_input

SCHEMA = "token string, ordinal int, record string"


class RateLimited(Exception):
    """Raised by a fetch whose credential has no calls left for ``wait`` seconds."""

    def __init__(self, wait: float = 0.0):
        super().__init__(f"no calls left for {wait} s")
        self.wait = wait


class Rotation:
    """S-29: calls with one credential after the other; a credential without calls left rests, and if all rest, the one that is ready first is waited for."""

    def __init__(self, credentials: list[str], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if not credentials:
            raise ValueError("no credentials")
        self.ready = {c: float("-inf") for c in credentials}
        self.clock, self.sleep = clock, sleep

    def call(self, fetch: Callable, *arguments):
        while True:
            credential = min(self.ready, key=self.ready.get)
            wait = self.ready[credential] - self.clock()
            if wait > 0:
                self.sleep(wait)
            try:
                return fetch(*arguments, credential)
            except RateLimited as e:
                self.ready[credential] = self.clock() + max(e.wait, 1e-3)


def _fetcher(options) -> Callable:
    """The function that ``fetch`` names, given the ``argument`` option if there is one, and a credential of ``credentials`` if there are any."""
    module, _, function = options["fetch"].partition(":")
    fetch = getattr(importlib.import_module(module), function)
    if options.get("argument"):
        fetch = partial(_with_argument, fetch, options["argument"])
    if options.get("credentials"):
        return partial(Rotation(options["credentials"].split(",")).call, fetch)
    return fetch


def _with_argument(fetch, argument, token, *credential):
    return fetch(token, argument, *credential)


def pages(fetch, token: str = "", retries: int = 3, pause: float = 0.0) -> Iterator[tuple[str, list[str], str | None]]:
    """(token, records, next token) of each page; a page that fails is tried again ``retries`` times, with pauses that double."""
    while token is not None:
        for left in range(retries, -1, -1):
            try:
                records, following = fetch(token)
                break
            except OSError:
                if not left:
                    raise
                time.sleep(pause * 2 ** (retries - left))
        yield token, records, following
        token = following


def landed(token: str, folder: str, *credential: str) -> tuple[list[str], str | None]:
    """S-22..S-25: the pages that lie in ``folder`` as ``<token>.json``, each ``{"type": ..., "records": [...], "next": ...}``; the first is page 0. A page of type
    ``empty`` ends the listing; a page may name the only credential that it answers to."""
    with open_input(f"{folder}/{token or '0'}.json") as f:
        page = json.loads(f.read())
    if credential and page.get("credential") not in (None, *credential):
        raise RateLimited(0.001)
    if page.get("type") == "empty":
        return [], None
    return page["records"], page.get("next")


class PagedSource(DataSource):
    """``spark.read.format("paged").option("fetch", "module:function")``, and ``readStream`` likewise: a page a batch."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for token, records, _ in pages(_fetcher(self.options)):
            for i, r in enumerate(records):
                yield token, i, r


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"token": "", "done": False}

    def read(self, start: dict):
        if start["done"]:
            return iter(()), start
        token, records, following = next(pages(_fetcher(self.options), start["token"]))
        return iter([(token, i, r) for i, r in enumerate(records)]), {"token": following or token, "done": following is None}

    def readBetweenOffsets(self, start: dict, end: dict):
        token = start["token"]
        if start == end or start["done"]:
            return iter(())
        _, records, _ = next(pages(_fetcher(self.options), token))
        return iter([(token, i, r) for i, r in enumerate(records)])

    def commit(self, end: dict) -> None:
        pass

"""JSON services that answer page by page, as a Spark data source.

A page has `items` (null: none) and `next_cursor` (null: the last page). A page without items, a cursor that is no text or
that came before, and more than MAX_PAGES pages are errors: a scan never ends early without saying so.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import CANDIDATES

MAX_PAGES, ATTEMPTS, WAITS, TIMEOUT = 1000, 3, (1.0, 4.0), 30.0


class BadPage(ValueError):
    """An answer that isn't a page of items."""


def get(url: str, token: str = "", attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A GET request, tried again after failed connections and server errors; requests that write never come here."""
    for k in range(attempts):
        try:
            asked = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
            with urllib.request.urlopen(asked, timeout=TIMEOUT) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code < 500 or k + 1 == attempts:
                raise
        except OSError:
            if k + 1 == attempts:
                raise
        sleep(WAITS[min(k, len(WAITS) - 1)])
    raise AssertionError


def items(fetch: Callable[[str | None], dict]) -> Iterator[dict]:
    """The items of all pages; fetch gets a cursor, None for the first page."""
    cursor, seen = None, set()
    for _ in range(MAX_PAGES):
        page = fetch(cursor)
        if not isinstance(page, dict) or "items" not in page:
            raise BadPage("a page has no items")
        if page["items"] is not None and not isinstance(page["items"], list):
            raise BadPage("items is no list")
        yield from page["items"] or ()
        cursor = page.get("next_cursor")
        if cursor is None:
            return
        if not isinstance(cursor, str) or not cursor:
            raise BadPage(f"the cursor {cursor!r} is no text")
        if cursor in seen:
            raise BadPage(f"the cursor {cursor!r} came before")
        seen.add(cursor)
    raise BadPage(f"more than {MAX_PAGES} pages")


def candidate(item: dict, seq: int) -> tuple:
    """An item as a candidate row. Fields of a wrong type are errors: a text "false" must not become a treatment."""
    key, treatment = item.get("key"), item.get("treatment")
    if not isinstance(key, str):
        raise BadPage(f"the key {key!r} is no text")
    if not isinstance(treatment, bool):
        raise BadPage(f"the treatment of {key!r} is no boolean")
    reason, status, blocked = item.get("reason") or "", item.get("status") or "", item.get("blocked_by") or []
    if not isinstance(reason, str) or not isinstance(status, str) or not isinstance(blocked, list) or not all(isinstance(b, str) for b in blocked):
        raise BadPage(f"a field of {key!r} has a wrong type")
    return key, reason, treatment, status, blocked, seq


class CandidateSource(DataSource):
    """Format "candidates": options url, token and staleness (sent with the request, so the service filters)."""

    @classmethod
    def name(cls) -> str:
        return "candidates"

    def schema(self):
        return CANDIDATES

    def reader(self, schema):
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]  # a cursor gives pages one after another

    def read(self, partition):
        base, token, staleness = self.options["url"], self.options.get("token", ""), self.options.get("staleness", "")

        def fetch(cursor):
            asked = {k: v for k, v in (("staleness", staleness), ("cursor", cursor)) if v}
            return get(base + ("?" + urllib.parse.urlencode(asked) if asked else ""), token)

        for seq, item in enumerate(items(fetch)):
            yield candidate(item, seq)


def candidates(spark: SparkSession, url: str, token: str = "", staleness: str = "") -> DataFrame:
    spark.dataSource.register(CandidateSource)
    return spark.read.format("candidates").options(url=url, token=token, staleness=staleness).load()


def flag_keys(flags: DataFrame, archived: bool = True) -> DataFrame:
    """Keys of flags (key, archived, seq): all, or those alive in their order of arrival."""
    return flags.select("key").distinct() if archived else flags.where(~F.coalesce("archived", F.lit(False))).orderBy("seq").select("key", "seq")

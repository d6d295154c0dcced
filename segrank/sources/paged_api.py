"""A paged JSON source over HTTP as a Spark data source: one partition for each page, filter and columns sent to the server."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from segrank.functions.guards import IncompletePullError, SourceError

# Fixed values
PAGE_ROWS, RETRIES, BACKOFF_S, TIMEOUT_S = 50_000, 4, 2.0, 120


def clean_token(raw: str | None) -> str | None:
    """A trimmed token; None if blank."""
    return (raw or "").strip() or None


@dataclass(frozen=True)
class ApiTable:
    """A table of the API: filter (where) and columns (select) are applied by the server."""

    key: str
    dataset: str
    base: str
    where: str | None = None
    select: tuple[str, ...] = ()
    geometry: str | None = None

    @property
    def url(self) -> str:
        return f"{self.base.rstrip('/')}/{self.dataset}.json"


def http_get(url: str, token: str | None) -> tuple[int, str]:
    """Status and body."""
    request = urllib.request.Request(url, headers={"X-App-Token": token} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


def request_json(url: str, params: dict, token: str | None = None, get: Callable[[str, str | None], tuple[int, str]] = http_get, sleep: Callable[[float], None] = time.sleep):
    """Parsed JSON; 429, 5xx and broken connections are tried again with growing pauses, other errors fail at once."""
    full = f"{url}?{urllib.parse.urlencode(params)}"
    why = ""
    for n in range(RETRIES + 1):
        try:
            status, body = get(full, token)
        except OSError as e:
            status, body, why = 0, "", str(e)
        if status == 200:
            return json.loads(body)
        if status and status != 429 and status < 500:
            raise SourceError(f"{url}: status {status}")
        why = why or f"status {status}"
        if n < RETRIES:
            sleep(BACKOFF_S * 2**n)
    raise SourceError(f"{url}: {why} after {RETRIES + 1} tries")


def count_rows(table: ApiTable, token: str | None = None, get=http_get, sleep=time.sleep) -> int:
    """The server's count of rows under the table's filter."""
    answer = request_json(table.url, {"$select": "count(*) AS n"} | ({"$where": table.where} if table.where else {}), token, get, sleep)
    try:
        return int(next(iter(answer[0].values())))
    except (LookupError, TypeError, ValueError, StopIteration) as e:
        raise SourceError(f"{table.url}: no count in the answer") from e


def page_params(table: ApiTable, page: int, size: int) -> dict:
    params = {"$limit": size, "$offset": page * size, "$order": ":id"}
    if table.where:
        params["$where"] = table.where
    if table.select:
        params["$select"] = ",".join(table.select)
    return params


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, table: ApiTable, schema: StructType, token: str | None, size: int, get=http_get):
        self.table, self.schema, self.token, self.size, self.get = table, schema, token, size, get

    def pushFilters(self, filters):
        """Comparisons of top-level columns with numbers and texts go to the server; the rest stays with Spark."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        terms = [self.table.where] if self.table.where else []
        for f in filters:
            sign = signs.get(type(f))
            if sign and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                value = "'" + f.value.replace("'", "''") + "'" if isinstance(f.value, str) else str(f.value)
                terms.append(f"{f.attribute[0]} {sign} {value}")
            yield f  # the server's typing may differ, so Spark tests again
        self.table = ApiTable(self.table.key, self.table.dataset, self.table.base, " AND ".join(f"({t})" for t in terms) or None, self.table.select, self.table.geometry)

    def partitions(self):
        n = count_rows(self.table, self.token, self.get)
        return [Page(i) for i in range((n + self.size - 1) // self.size)] or [Page(0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        names = self.schema.fieldNames()
        for row in request_json(self.table.url, page_params(self.table, partition.number, self.size), self.token, self.get):
            yield tuple(None if row.get(c) is None else row[c] if isinstance(row[c], str) else json.dumps(row[c]) for c in names)


class PagedSource(DataSource):
    """spark.read.format("paged_api").options(base=, dataset=, columns="a,b", where=, token=, page_rows=).load(); all columns are strings."""

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema: StructType) -> PagedReader:
        o = self.options
        table = ApiTable(o.get("key", o["dataset"]), o["dataset"], o["base"], o.get("where"), tuple(o["columns"].split(",")))
        return PagedReader(table, schema, clean_token(o.get("token")), int(o.get("page_rows", PAGE_ROWS)))


def fetch_pages(table: ApiTable, token: str | None = None, size: int = PAGE_ROWS, get=http_get, sleep=time.sleep) -> list[dict]:
    """All rows on the driver, for small tables; no rows, or another number than counted, is an error."""
    expected = count_rows(table, token, get, sleep)
    if not expected:
        raise SourceError(f"{table.url} has no rows")
    rows: list[dict] = []
    for page in range((expected + size - 1) // size):
        rows += request_json(table.url, page_params(table, page, size), token, get, sleep)
    if len(rows) != expected:
        raise IncompletePullError(f"{table.url}: {len(rows)} rows of {expected}")
    return rows


def columns_of(table: ApiTable, token: str | None = None, get=http_get, sleep=time.sleep, rows: int = 1000) -> tuple[str, ...]:
    """The selected columns; if none are, all that the first rows have (the server leaves out empty ones)."""
    return table.select or tuple(sorted({c for r in request_json(table.url, page_params(table, 0, rows), token, get, sleep) for c in r}))


def load(spark: SparkSession, table: ApiTable, token: str | None = None, size: int = PAGE_ROWS) -> DataFrame:
    """The table by the data source, one partition a page; snapshots.pull_table() holds what was written against count_rows()."""
    spark.dataSource.register(PagedSource)
    options = {"base": table.base, "dataset": table.dataset, "columns": ",".join(columns_of(table, token)), "page_rows": str(size)}
    options |= ({"where": table.where} if table.where else {}) | ({"token": token} if token else {})
    return spark.read.format("paged_api").options(**options).load()

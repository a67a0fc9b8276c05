"""A data source for datasets that an HTTP API gives in pages.

    spark.dataSource.register(PagedRows)
    spark.read.format("paged_rows").option("url", base).option("dataset", name).load()

The driver asks for the list of splits and for each split's number of rows, and plans a partition for each run of pages. Tasks
fetch their own pages, with retries, so a lost executor costs its pages alone. Filters on config, split and row_idx leave out
splits and pages before anything is fetched. A split that isn't ready, a page without rows before the end, and a number of rows
that changes while it is read are errors: a scan is whole or fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from factgrid.sources.http import ATTEMPTS, TIMEOUT, WAIT, api

#: row is the row's JSON; truncated_cells names the columns that the API cut.
SCHEMA = "config string, split string, row_idx long, row string, truncated_cells array<string>"
_ARROW = pa.schema([("config", pa.string()), ("split", pa.string()), ("row_idx", pa.int64()), ("row", pa.string()), ("truncated_cells", pa.list_(pa.string()))])
# fixed value: rows of a page
PAGE = 100


@dataclass
class Pages(InputPartition):
    """Rows start..end of a split, of which the API said that it has total."""

    config: str
    split: str
    start: int
    end: int
    total: int


class PagedRows(DataSource):
    """Options: url, dataset, page (rows asked for at a time), pages (pages of a partition), attempts, timeout, wait."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.dataset = options["url"], options["dataset"]
        self.page, self.pages = int(options.get("page", PAGE)), int(options.get("pages", 1))
        self.how = {"attempts": int(options.get("attempts", ATTEMPTS)), "timeout": float(options.get("timeout", TIMEOUT)), "wait": float(options.get("wait", WAIT))}
        self.among: dict[str, list[set]] = {"config": [], "split": []}
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of configs and splits, and bounds of row_idx; gives back the rest."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in self.among and isinstance(f, (EqualTo, In)):
                self.among[name].append(set(f.value) if isinstance(f, In) else {f.value})
            elif name == "row_idx" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(x for x in (self.high, f.value + (not isinstance(f, LessThan))) if x is not None)
            else:
                yield f

    def _rows(self, config: str, split: str, offset: int, length: int) -> dict:
        return api(self.url, "rows", **self.how, dataset=self.dataset, config=config, split=split, offset=offset, length=length)

    def partitions(self) -> list[Pages]:
        listed = api(self.url, "splits", **self.how, dataset=self.dataset)
        if listed.get("pending") or listed.get("failed"):
            raise ValueError("the dataset has splits that are pending or failed")
        if not listed.get("splits"):
            raise ValueError("the dataset has no splits")
        out, step = [], self.page * self.pages
        for s in listed["splits"]:
            config, split = s["config"], s["split"]
            if all(config in x for x in self.among["config"]) and all(split in x for x in self.among["split"]):
                total = self._rows(config, split, 0, 1)["num_rows_total"]
                end = total if self.high is None else min(total, self.high)
                first = self.low // step * step  # the same runs of pages whatever the filter
                out += [Pages(config, split, max(at, self.low), min(at + step, end), total) for at in range(first, end, step)]
        return out

    def read(self, part: Pages) -> Iterator[pa.RecordBatch]:
        at = part.start
        while at < part.end:
            page = self._rows(part.config, part.split, at, min(self.page, part.end - at))
            rows = page["rows"][: part.end - at]
            if page["num_rows_total"] != part.total:
                raise ValueError(f"{part.config}/{part.split} had {part.total} rows, and now has {page['num_rows_total']}")
            if not rows:
                raise ValueError(f"{part.config}/{part.split} gave no rows at {at} of {part.total}")
            columns = [[part.config] * len(rows), [part.split] * len(rows), [r["row_idx"] for r in rows], [json.dumps(r["row"], ensure_ascii=False) for r in rows], [r.get("truncated_cells") or [] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
            at += len(rows)


def read_rows(spark: SparkSession, url: str, dataset: str, **options: object) -> DataFrame:
    """The rows of SCHEMA; filters on it reach the API."""
    spark.dataSource.register(PagedRows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged_rows").options(url=url, dataset=dataset, **options).load()

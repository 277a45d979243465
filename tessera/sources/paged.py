"""Landed response pages as a data source: `spark.read.format("pages")` and `spark.readStream.format("pages")`.

A folder holds one folder a page, `page=N`, with the response's body in a file; pages are numbered in the order they were landed.
Bodies are JSON (a list of objects somewhere inside), CSV with a header, RSS, or catalogue JSON (column names beside rows
of values).  A batch read deals pages over partitions; a stream's offset is the last page read, so a resumed stream takes
each page once.  A walk follows every page's own link to the next one instead, in one partition, as a live source would.

Options: path; form (json, csv, rss, catalogue); items (dots lead to the list, json only; `data` in catalogues);
next (dots lead to the next page's number; a walk begins at the first page); pages_per_partition (16).
Fields are taken by column name.  Missing ones are null, values that do not fit their column fail the read; structures go into string columns
as JSON.  Empty folders give no rows.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from datetime import date, datetime
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_PAGE = re.compile(r"/page=(\d+)/[^/_.][^/]*$")


class Pages(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


def at_path(value, path: str):
    """What dots lead to; None where a step is missing."""
    for step in filter(None, path.split(".")):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def items_of(body: str, form: str, items: str = "") -> list[dict]:
    """The items of a page's body, fields by name."""
    if form == "csv":
        return list(csv.DictReader(io.StringIO(body)))
    if form == "rss":
        return [{child.tag.rsplit("}", 1)[-1]: child.text for child in item} for item in ElementTree.fromstring(body).iter("item")]
    found = json.loads(body)
    if form == "catalogue":
        names = [c["fieldName"] for c in found["meta"]["view"]["columns"]]
        return [dict(zip(names, row, strict=True)) for row in at_path(found, items or "data") or []]
    return at_path(found, items) or []


class _Reader:
    def __init__(self, schema: StructType, options: dict):
        self.options = options
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.each = int(options.get("pages_per_partition", 16))

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.options["path"])

    def files(self, after: int = -1, upto: int | None = None) -> list[tuple[int, str]]:
        """(page, file) in order of pages; files of one page in order of name."""
        from pyarrow import fs

        store, path = self.store()
        found = [(int(m[1]), i.path) for i in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if i.is_file and (m := _PAGE.search(i.path))]
        return sorted((n, p) for n, p in found if n > after and (upto is None or n <= upto))

    def dealt(self, files: list[tuple[int, str]]) -> list[InputPartition]:
        names = [p for _, p in files]
        return [Pages(names[at : at + self.each]) for at in range(0, len(names), self.each)]

    def body(self, file: str) -> str:
        with self.store()[0].open_input_stream(file) as f:
            return f.read().decode()

    def value(self, value, kind: str):
        """A field's value as its column's type; empty text is null but in string columns."""
        if value is None or (value == "" and kind != "string"):
            return None
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if kind in ("int", "bigint", "smallint"):
            return int(value)
        if kind in ("double", "float"):
            return float(value)
        if kind == "boolean":
            return value if isinstance(value, bool) else str(value).lower() == "true"
        if kind == "timestamp":
            return datetime.fromisoformat(value)
        return date.fromisoformat(value) if kind == "date" else value

    def rows(self, body: str) -> Iterator[tuple]:
        for item in items_of(body, self.options.get("form", "json"), self.options.get("items", "")):
            yield tuple(self.value(item.get(name), kind) for name, kind in self.fields)


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        files = self.files()
        # no partitions would be read as one that is None
        return (self.dealt(files) if "next" not in self.options else [Pages([p for _, p in files])]) if files else [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        if "next" not in self.options:
            for file in partition.files:
                yield from self.rows(self.body(file))
            return
        by_page = {int(_PAGE.search(f)[1]): f for f in partition.files}
        page, seen = min(by_page, default=None), set()
        while page is not None and page not in seen:  # a source that links back ends the walk
            seen.add(page)
            if page not in by_page:
                raise ValueError(f"page {page} is linked to but was not landed")
            body = self.body(by_page[page])
            yield from self.rows(body)
            following = at_path(json.loads(body), self.options["next"])
            page = None if following is None else int(following)


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max((n for n, _ in self.files()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.dealt(self.files(start["page"], end["page"]))

    def read(self, partition: Pages) -> Iterator[tuple]:
        for file in partition.files:
            yield from self.rows(self.body(file))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, dict(self.options))


def read_pages(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").schema(schema).options(path=path, **options).load()


def stream_pages(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("pages").schema(schema).options(path=path, **options).load()


# -- landing -------------------------------------------------------------------------------------


def land(df: DataFrame, path: str, page: Column, form: str, order: str, last: int | None = None) -> None:
    """Write rows as pages of a form under `path`, as a collector would leave them; page: the number of a row's page.

    JSON pages link to the next number, but for page `last`.  A page's rows are gathered, so pages should be small.
    """
    names = df.columns
    wide = df.withColumn("_page", page.cast("int"))
    if form == "csv":
        item = F.to_csv(F.struct(*names))
    elif form == "rss":
        plain = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        item = F.concat(F.lit("<item>"), *(F.concat(F.lit(f"<{c}>"), plain(c), F.lit(f"</{c}>")) for c in names), F.lit("</item>"))
    elif form == "catalogue":
        item = F.to_json(F.array(*(F.col(c).cast("string") for c in names)))
    else:
        item = F.to_json(F.struct(*names))
    rows = wide.select("_page", F.struct(F.col(order).alias("o"), item.alias("x")).alias("i")).groupBy("_page").agg(F.transform(F.array_sort(F.collect_list("i")), lambda s: s["x"]).alias("x"))
    listed = F.concat(F.lit("["), F.array_join("x", ","), F.lit("]"))
    if form == "csv":
        body = F.concat(F.lit(",".join(names) + "\n"), F.array_join("x", "\n"))
    elif form == "rss":
        body = F.concat(F.lit("<rss><channel>"), F.array_join("x", ""), F.lit("</channel></rss>"))
    elif form == "catalogue":
        columns = ",".join(f'{{"fieldName":"{c}"}}' for c in names)
        body = F.concat(F.lit('{"meta":{"view":{"columns":[' + columns + ']}},"data":'), listed, F.lit("}"))
    else:
        following = F.when(F.col("_page") == last, F.lit("null")).otherwise((F.col("_page") + 1).cast("string")) if last is not None else F.lit("null")
        body = F.concat(F.lit('{"response":{"objects":'), listed, F.lit('},"meta":{"next":'), following, F.lit("}}"))
    rows.select(body.alias("value"), F.col("_page").alias("page")).write.mode("append").partitionBy("page").text(path)


# -- rosters -------------------------------------------------------------------------------------

OFFICES = "array<struct<type:string,tel:string,postal:string>>"


def roster(people: DataFrame, offices: str = "offices") -> DataFrame:
    """(name, party, office, riding, place, phone, address): one row an office of each person, one with nulls if there is none.

    people: name, party_name, elected_office, district_name and, as JSON text, their offices.  Blank values are null; the
    place of an office counts from 1; people whose offices are no list have none.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    listed = F.from_json(F.col(offices), OFFICES)
    out = people.select(blank("name").alias("name"), blank("party_name").alias("party"), blank("elected_office").alias("office"), blank("district_name").alias("riding"), F.posexplode_outer(listed).alias("at", "o"))
    phone = F.nullif(F.regexp_replace(F.coalesce(F.col("o.tel"), F.lit("")), "[^0-9]", ""), F.lit(""))
    return out.select("name", "party", "office", "riding", (F.col("at") + 1).alias("place"), phone.alias("phone"), blank(F.col("o.postal")).alias("address"))

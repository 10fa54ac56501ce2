"""Connectors: rows of outside systems as DataFrames, by the name of their kind.

What leaves the machine is a function that the caller gives (``fetch``), so a
connector is the shape of the data: templates with bound values, paging, the
unwrapping of answers, and which tables and columns may be shown.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import rules

# Where an answer keeps its rows.
WRAPPERS = ("data", "results", "items", "records")


def csv_rows(spark: SparkSession, path: str, identifier: str | None = None, value: str | None = None) -> DataFrame:
    """Rows of CSV files with a header, all strings; with an identifier column, those whose trimmed value is equal."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows if identifier is None or value is None else rows.filter(F.trim(F.col(f"`{identifier}`")) == value)


def bound(template: str, user: str) -> tuple[str, dict[str, str]]:
    """A query template with ``{{user_id}}`` or ``{{user_identifier}}`` as a named parameter, and its value: never pasted into the text, quoted or not."""
    text = template
    for mark in ("{{user_id}}", "{{user_identifier}}"):
        text = text.replace(f"'{mark}'", ":user").replace(f'"{mark}"', ":user").replace(mark, ":user")
    return text, {"user": user} if text != template else {}


def sql_rows(spark: SparkSession, template: str, user: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A template over tables that Spark knows (or that are given by name), with the user's id bound."""
    text, values = bound(template, user)
    return spark.sql(text, args=values, **(tables or {}))


def jdbc_rows(spark: SparkSession, url: str, template: str, user: str, **options: str) -> DataFrame:
    """The same over JDBC: Spark's source takes no parameters, so the value goes in as a SQL string literal with its quotes doubled."""
    text, values = bound(template, user)
    if values and ("\\" in user or "\0" in user):
        raise ValueError("an identifier has no backslash")
    query = text.replace(":user", "'" + user.replace("'", "''") + "'") if values else text
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def document_query(template: str, user: str) -> dict:
    """A document store's template (database, collection, filter, projection) with the user's id in as JSON text."""
    inner = json.dumps(user)[1:-1]
    out = json.loads(template.replace("{{user_id}}", inner).replace("{{user_identifier}}", inner))
    if not isinstance(out, dict) or not out.get("collection"):
        raise ValueError("a template names its collection")
    return out


#: Comparisons of a document filter.
COMPARISONS = {
    "$eq": lambda c, v: c.eqNullSafe(F.lit(v)), "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(v), "$nin": lambda c, v: ~c.isin(v) | c.isNull(), "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
}


def document_filter(given: dict) -> Column:
    """A document filter as a condition: equalities and ``COMPARISONS`` of fields (``a.b`` is a nested one), all of which must hold, and ``$and`` / ``$or`` / ``$nor`` of lists of filters.  Null never compares."""
    out = F.lit(True)
    for name, wanted in given.items():
        if name in ("$and", "$or", "$nor"):
            parts = [document_filter(x) for x in wanted]
            any_of = reduce(lambda x, y: x | y, parts, F.lit(False))
            out = out & (reduce(lambda x, y: x & y, parts, F.lit(True)) if name == "$and" else any_of if name == "$or" else ~any_of)
            continue
        if name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        tests = wanted if isinstance(wanted, dict) and any(k.startswith("$") for k in wanted) else {"$eq": wanted}
        for operator, value in tests.items():
            if operator not in COMPARISONS:
                raise ValueError(f"unknown operator {operator}")
            out = out & F.coalesce(COMPARISONS[operator](F.col(name), value), F.lit(False))
    return out


def document_rows(collection: DataFrame, query: dict) -> DataFrame:
    """A collection with a query's filter and projection."""
    collection = collection.filter(document_filter(query.get("filter") or {}))
    kept = [k for k, v in (query.get("projection") or {}).items() if v and k in collection.columns]
    return collection.select(*kept) if kept else collection


def unwrapped(body: Column) -> Column:
    """JSON rows (strings) of an answer: a list's items; the first list under ``WRAPPERS`` of an object; else the object itself."""
    trimmed = F.ltrim(body)
    inner = [F.get_json_object(body, f"$.{w}") for w in WRAPPERS]
    lists = [F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")) for x in inner]
    whole = F.when(trimmed.startswith("["), F.from_json(body, "array<string>")).when(trimmed.startswith("{"), F.coalesce(*lists, F.array(body)))
    return F.coalesce(whole, F.array().cast("array<string>"))


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def paged(name: str, schema: str, fetch: Callable[[int], list[tuple]], pages: int) -> type[DataSource]:
    """A Spark data source of ``pages`` pages, each a partition that calls ``fetch(number)`` for its rows; register it with ``spark.dataSource.register``."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[Page]:
            return [Page(i) for i in range(pages)]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield from fetch(partition.number)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> Reader:
            return Reader()

    return Source


def all_pages(fetch: Callable[[str | None], tuple[list[dict], str | None]]) -> Iterator[dict]:
    """Rows of an interface that gives the next offset with each page, as many pages as there are; an offset that comes twice is an error, as it would never end.  For more than one reader can hold, see ``streaming.cursor``."""
    offset: str | None = None
    seen: set[str] = set()
    while True:
        rows, offset = fetch(offset)
        yield from rows
        if not offset:
            return
        if offset in seen:
            raise ValueError(f"offset {offset!r} came twice")
        seen.add(offset)


# The kinds of source, by how their rows come.
KINDS = {
    "mysql": "sql", "postgresql": "sql", "snowflake": "sql", "bigquery": "sql",
    "mongodb": "documents", "csv": "csv", "rest_api": "answer",
    "salesforce": "pages", "hubspot": "pages", "shopify": "pages", "google_sheets": "pages", "stripe": "pages", "slack": "pages",
    "notion": "pages", "airtable": "pages", "razorpay": "pages", "woocommerce": "pages", "gmail": "pages",
}

@dataclass
class Source:
    """What a connector is given.  ``tables`` are tables or collections by name, ``fetch`` gives the answer of an interface (a JSON text), or of a page by its cursor (rows, next cursor)."""

    kind: str
    template: str = ""
    url: str = ""
    path: str = ""
    identifier: str = "user_id"
    mapping: dict[str, str] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    schema: str = ""
    fetch: Callable | None = None


class Connector(ABC):
    """Rows of an outside system by the same calls, whatever its kind."""

    def __init__(self, spark: SparkSession, source: Source):
        self.spark, self.source = spark, source

    @abstractmethod
    def fetched(self, user: str | None) -> DataFrame:
        """The rows, for a user where the kind asks for one."""

    def rows(self, user: str | None = None) -> DataFrame:
        """The rows with mapped columns first under their new names."""
        found = self.fetched(user)
        first = [F.col(f"`{old}`").alias(new) for old, new in self.source.mapping.items() if old in found.columns]
        return found.select(*first, *(F.col(f"`{c}`") for c in found.columns if c not in self.source.mapping))

    def tested(self, user: str | None = None) -> tuple[bool, str]:
        """Whether rows can be had, and the error if not."""
        try:
            self.rows(user).limit(1).collect()
        except Exception as e:  # noqa: BLE001  what fails is what is asked
            return False, f"{type(e).__name__}: {e}"
        return True, ""

    def shown(self) -> DataFrame:
        """Tables and columns that may be shown."""
        return described(self.spark, self.source.tables)


class SqlConnector(Connector):
    def fetched(self, user: str | None) -> DataFrame:
        s = self.source
        return jdbc_rows(self.spark, s.url, s.template, user or "") if s.url else sql_rows(self.spark, s.template, user or "", s.tables)


class DocumentConnector(Connector):
    def fetched(self, user: str | None) -> DataFrame:
        query = document_query(self.source.template, user or "")
        return document_rows(self.source.tables[query["collection"]], query)


class CsvConnector(Connector):
    def fetched(self, user: str | None) -> DataFrame:
        return csv_rows(self.spark, self.source.path, self.source.identifier, user)


class _Listed(Connector):
    """Kinds whose rows come through ``fetch`` as JSON; with a user, those of the user."""

    def _of(self, rows: DataFrame, user: str | None) -> DataFrame:
        parsed = rows.select(F.from_json("row", self.source.schema).alias("r")).select("r.*")
        return parsed if user is None else parsed.filter(F.col(f"`{self.source.identifier}`").cast("string") == user)


class AnswerConnector(_Listed):
    def fetched(self, user: str | None) -> DataFrame:
        body = self.spark.createDataFrame([(self.source.fetch(),)], "body string")
        return self._of(body.select(F.explode(unwrapped(F.col("body"))).alias("row")), user)


class PagesConnector(_Listed):
    """Pages are followed by one reader, as their cursors ask; ``streaming.cursor`` reads them with a task for each."""

    def fetched(self, user: str | None) -> DataFrame:
        rows = [(json.dumps(r),) for r in all_pages(self.source.fetch)]
        return self._of(self.spark.createDataFrame(rows, "row string"), user)


CONNECTORS: dict[str, type[Connector]] = {"sql": SqlConnector, "documents": DocumentConnector, "csv": CsvConnector, "answer": AnswerConnector, "pages": PagesConnector}


def connector(spark: SparkSession, source: Source) -> Connector:
    """The connector of a source's kind; ValueError for kinds that are not known."""
    if source.kind not in KINDS:
        raise ValueError(f"unknown kind of source: {source.kind}; known are {sorted(KINDS)}")
    return CONNECTORS[KINDS[source.kind]](spark, source)


def described(spark: SparkSession, tables: dict[str, DataFrame], keys: DataFrame | None = None) -> DataFrame:
    """table, column, type, nullable, sensitive, is_key of all tables whose name is not blacklisted; ``keys`` (table, column) are the columns of primary keys, as a database's catalog lists them."""
    rows = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for f in df.schema.fields]
    out = spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")
    out = out.filter(~rules.table_blacklisted(F.col("table"))).withColumn("sensitive", rules.column_sensitive(F.col("column")))
    if keys is None:
        return out.withColumn("is_key", F.lit(False))
    flagged = keys.select("table", "column").distinct().withColumn("is_key", F.lit(True))
    return out.join(flagged, ["table", "column"], "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))


def required_tables(spark: SparkSession, dimensions: int, database: str = "default") -> None:
    """The tables of a document store, where they are not there yet."""
    kept = {"documents": "id STRING, filename STRING, metadata STRING, created_at TIMESTAMP", "chunks": "id STRING, document_id STRING, chunk_index INT, text STRING, created_at TIMESTAMP", "embeddings": f"chunk_id STRING, embedding ARRAY<FLOAT> COMMENT '{dimensions} dimensions', created_at TIMESTAMP"}
    for name, columns in kept.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")

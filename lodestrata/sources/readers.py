"""Scans of JSON, reports, feeds, HTML and SQLite files into DataFrames, and sinks."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def read_rows(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """JSON documents that are a list of rows, or an object with the list under `field`."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    bare = F.from_json("value", f"array<struct<{schema}>>")
    held = F.from_json("value", f"struct<{field}:array<struct<{schema}>>>")[field]
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(held)
    return text.select("file", F.explode(rows).alias("r")).select("file", "r.*")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reports of both versions: 1, a list of leads; 2, an envelope with schema_version and leads."""
    text = spark.read.text(path, wholetext=True)
    v2 = F.from_json("value", f"struct<schema_version:int,leads:array<struct<{schema}>>>")
    v1 = F.from_json("value", f"array<struct<{schema}>>")
    first = F.ltrim("value").startswith("[")
    return text.select(F.when(first, 1).otherwise(v2["schema_version"]).alias("version"), F.explode(F.when(first, v1).otherwise(v2["leads"])).alias("r")).select("version", "r.*")


def corpus_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, folder, sha256, length) of the files that a glob finds."""
    f = spark.read.format("binaryFile").load(pattern)
    return f.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.sha2("content", 256).alias("sha256"), "length")


def decode_body(body: Column, charset: Column) -> Column:
    """Text of a body: UTF-8 where that is valid, else the charset named, else GB18030."""
    named = F.lower(F.coalesce(charset, F.lit("")))
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).when(named.isin("iso-8859-1", "latin1"), F.decode(body, "ISO-8859-1")).otherwise(_gb18030(body))


def _gb(body: pd.Series) -> pd.Series:
    return body.map(lambda b: None if b is None else bytes(b).decode("gb18030", "replace"))


def _gb18030(body: Column) -> Column:
    return F.pandas_udf(_gb, "string")(body)


_FEED = "key string, title string, url string, published string, text string"


def parse_feed(xml: str | None) -> list[tuple[str, str, str, str]]:
    """(title, url, published, text) of the entries of an RSS or Atom document; none if it is broken."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    out = []
    for entry in root.iter():
        if local(entry) not in ("item", "entry"):
            continue
        got = {}
        for child in entry:
            value = (child.text or "").strip() or child.get("href") or ""
            got.setdefault(local(child), value)
        out.append((got.get("title", ""), got.get("link", ""), got.get("pubdate") or got.get("published") or got.get("updated") or "", got.get("description") or got.get("summary") or got.get("content") or ""))
    return out


def read_feeds(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """The entries of RSS and Atom documents."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(str(k), *e) for k, x in zip(pdf[key], pdf[xml], strict=True) for e in parse_feed(x)]
            yield pd.DataFrame(rows, columns=["key", "title", "url", "published", "text"])

    return docs.select(key, xml).mapInPandas(run, _FEED)


def read_json_feeds(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The items of JSON Feed documents."""
    items = F.from_json(text, "struct<items:array<struct<id:string,url:string,title:string,date_published:string,content_text:string,content_html:string>>>")["items"]
    return docs.select(F.col(key).cast("string").alias("key"), F.explode(items).alias("i")).select("key", "i.title", F.coalesce("i.url", "i.id").alias("url"), F.col("i.date_published").alias("published"), F.coalesce("i.content_text", "i.content_html").alias("text"))


class SqliteTable(DataSource):
    """format("lodestrata_sqlite"): a table of a SQLite file that every executor sees. Options: path,
    table, columns (name:type,…), partitions. Columns that the table lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "lodestrata_sqlite"

    def schema(self) -> str:
        return ", ".join(f"{c.split(':')[0]} {c.split(':')[1]}" for c in self.options["columns"].split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(dict(self.options), [f.name for f in schema.fields])


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, names: Sequence[str]):
        self.options, self.names = options, list(names)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("partitions", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n, table = int(self.options.get("partitions", "1")), self.options["table"]
        db = sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)
        try:
            present = {r[1] for r in db.execute(f'pragma table_info("{table}")')}
            columns = ", ".join(f'"{c}"' if c in present else "null" for c in self.names)
            yield from db.execute(f'select {columns} from "{table}" where rowid % {n} = {partition.value}')
        finally:
            db.close()


def read_sqlite(spark: SparkSession, path: str, table: str, columns: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("lodestrata_sqlite").options(path=path, table=table, columns=columns, partitions=str(partitions)).load()


def registry(spark: SparkSession, packs: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(packs: pack, alias; sources: pack, source, kind, enabled) of a registry of source packs."""
    aliases = [(p, a) for p, v in packs.items() for a in [p, *v.get("aliases", [])]]
    sources = [(p, s["id"], s.get("kind", "direct"), bool(s.get("enabled", True))) for p, v in packs.items() for s in v["sources"]]
    return spark.createDataFrame(aliases, "pack string, alias string"), spark.createDataFrame(sources, "pack string, source string, kind string, enabled boolean")


def registry_violations(sources: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(source, violation): one row for each broken rule; none means the registry is valid."""
    twice = sources.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source", F.lit("listed twice").alias("violation"))
    kind = sources.where(~F.col("kind").isin(*kinds)).select("source", F.lit("unknown kind").alias("violation"))
    blank = sources.where(F.trim("source") == "").select("source", F.lit("no id").alias("violation"))
    return twice.unionByName(kind).unionByName(blank)


def select_sources(packs: DataFrame, sources: DataFrame, topic: str) -> DataFrame:
    """The enabled sources of packs whose alias holds the topic or is held by it, each once."""
    t = F.lit(topic.lower())
    hit = packs.where(F.contains(F.lower("alias"), t) | F.contains(t, F.lower("alias"))).select("pack").distinct()
    return sources.where("enabled").join(F.broadcast(hit), "pack", "left_semi").groupBy("source").agg(F.min("pack").alias("pack"), F.min("kind").alias("kind"))


def valid_listing(listing: DataFrame, key: str, ident: str, url: str, title: str, host: str, counts: tuple[int, int], title_length: tuple[int, int]) -> DataFrame:
    """(key, ok, items): whether a page's listing has a likely number of items, ids and URLs that occur
    once, the host, and titles of a likely length."""
    g = listing.groupBy(key).agg(F.count("*").alias("items"), F.countDistinct(ident).alias("i"), F.countDistinct(url).alias("u"), F.bool_and(F.regexp_extract(url, "://([^/]+)", 1) == host).alias("h"), F.bool_and(F.length(title).between(*title_length)).alias("t"))
    n = F.col("items")
    return g.select(key, (n.between(*counts) & (F.col("i") == n) & (F.col("u") == n) & F.col("h") & F.col("t")).alias("ok"), "items")


def write_once(df: DataFrame, path: str) -> None:
    """A frozen snapshot: an error if it is there already."""
    df.write.mode("errorifexists").parquet(path)


def write_report(df: DataFrame, path: str, version: int = 2) -> None:
    """A JSON envelope for each row, with the schema version."""
    df.select(F.lit(version).alias("schema_version"), F.struct(*df.columns).alias("lead")).write.mode("overwrite").json(path)

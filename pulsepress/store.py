"""The article store: catalog tables with keyed ingest, queries and maintenance.

Tables are plain parquet tables of one catalog database. ``articles`` and ``mentions`` are
partitioned by the day they were collected, so inserts add files, updates rewrite the days they
touch, retention drops whole days and date filters skip the rest.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from datetime import date
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepress import schemas
from pulsepress.functions import dates
from pulsepress.operators import cleaning, ingest, labels, search, similarity, text_index, vector_index
from pulsepress.operators.filters import article_filter, in_days
from pulsepress.operators.joins import matching_keys
from pulsepress.operators.ordering import page
from pulsepress.operators.vector_index import Cells
from pulsepress.plans import queries
from pulsepress.plans.trends import mention_rollup, post_states, snapshots_per_day, trends_from_states
from pulsepress.plans.views import register_views
from pulsepress.sources import files, folders
from pulsepress.sources.scratch import session_settings


# Spark's name for the partition of rows without a value.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def _in_named_days(names: Iterable[str]) -> Column:
    return in_days([None if day == NO_DAY else date.fromisoformat(day) for day in names])


class Tables:
    """Catalog tables of one database: appending, replacing and reading them."""

    def __init__(self, spark: SparkSession, database: str, location: str | None = None):
        self.spark = spark
        self.database = database
        where = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
        self.recover()

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create(self, table: str, schema, partition: str | None = None, folders_by: Sequence[str] = ()) -> None:
        """Make a table when it is absent, by days or by columns of its own."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        if partition:
            columns += f", {partition} DATE"
        parts = [partition] if partition else list(folders_by)
        by = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({columns}) USING parquet{by}")

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def append(self, table: str, rows: DataFrame, balanced: bool = False) -> int:
        """Add rows by column name and return how many, counted while they are written."""
        rows = rows.select(*self.read(table).columns)
        counted, seen = self._counted(rows if balanced else self._balanced(rows))
        counted.write.insertInto(self.name(table))
        return seen()

    def overwrite_days(self, table: str, rows: DataFrame, balanced: bool = False) -> int:
        """Replace the days (folders) that occur in the rows."""
        rows = rows.select(*self.read(table).columns)
        counted, seen = self._counted(rows if balanced else self._balanced(rows))
        with session_settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            counted.write.insertInto(self.name(table), overwrite=True)
        return seen()

    def replace(self, table: str, rows: DataFrame) -> int:
        """Replace all content, which the rows may be computed from.

        A table with days goes through ``replace_days``. The rows of any other are written to a folder
        of their own, a version. The table's location in the catalog alone says which version is live,
        so one change of the catalog replaces them. Older versions, and those that a run ended early
        never made live, stay until ``vacuum``: who reads one can finish.
        """
        if table in schemas.DAY_PARTITIONED:
            return self.replace_days(table, rows, self.days(table))
        version = self._staged(table, rows)
        written = self.spark.read.schema(self.read(table).schema).parquet(version).count()  # from the footers
        self._point(table, version)
        return written

    def replace_days(self, table: str, rows: DataFrame, days: Sequence[str]) -> int:
        """Put ``rows`` in the place of the given days; other days that they belong to keep their own rows.

        The rows are evaluated once, into a folder that then holds all that the days touched will
        have. A note beside it names the days. From then on the change is certain: a run that ends
        early is finished by ``recover``, by the same steps over the same rows.
        """
        staged, layout = self._staged(table, rows), self.read(table).schema
        fresh = self.spark.read.schema(layout).parquet(staged)
        written, filled = fresh.count(), self._days_of(fresh)
        if more := filled - set(days):
            self._write(self.read(table).filter(_in_named_days(more)), staged, schemas.DAY, "append")
        self._note({"table": table, "staged": staged, "empty": sorted(set(days) - filled)})
        self.recover()
        return written

    def recover(self) -> int:
        """Finish the changes that are noted, and return how many there were."""
        notes = sorted(path for path, _ in folders.children(self.spark, self._notes) if path.endswith(".json"))
        for path in notes:
            self._apply(json.loads(folders.read_text(self.spark, path)))
            folders.remove(self.spark, path)
        return len(notes)

    def _apply(self, note: dict) -> None:
        table = note["table"]
        rows = self.spark.read.schema(self.read(table).schema).parquet(note["staged"])
        self.overwrite_days(table, rows)
        for day in note["empty"]:
            self._drop_day(table, day)

    def _note(self, note: dict) -> None:
        folders.write_text(self.spark, f"{self._notes}/{time.time_ns():020d}-{uuid.uuid4().hex}.json", json.dumps(note))

    @cached_property
    def _folder(self) -> str:
        return self.spark.catalog.getDatabase(self.database).locationUri.rstrip("/")

    @property
    def _notes(self) -> str:
        return f"{self._folder}/changes.notes"

    def _versions(self, table: str) -> str:
        return f"{self._folder}/{table}.versions"

    def _staged(self, table: str, rows: DataFrame) -> str:
        """A new folder with the rows, which are evaluated here and nowhere else."""
        path = f"{self._versions(table)}/{uuid.uuid4().hex}"
        self._write(self._balanced(rows.select(*self.read(table).columns)), path, schemas.DAY)
        return path

    @staticmethod
    def _write(rows: DataFrame, path: str, day: str, mode: str = "errorifexists") -> None:
        writer = rows.write.mode(mode)
        (writer.partitionBy(day) if day in rows.columns else writer).parquet(path)

    def once(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """The rows, evaluated and written once, and the folder they are in."""
        path = f"{self._folder}/batches.versions/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def observed(self, rows: DataFrame, **counts: Column):
        """The rows, and a function that gives counts taken while they are written."""
        seen = Observation()
        return rows.observe(seen, *[x.alias(name) for name, x in counts.items()]), lambda: seen.get

    def vacuum(self, hours: float = 24) -> int:
        """Remove versions that are not live and were last changed so long ago; returns how many.

        Nothing that a note names goes. ``hours`` has to be longer than any read or write takes.
        """
        noted = [path for path, _ in folders.children(self.spark, self._notes) if path.endswith(".json")]
        used = [json.loads(folders.read_text(self.spark, path))["staged"] for path in noted]
        used += [self._location(t.name) for t in self.spark.catalog.listTables(self.database) if t.tableType == "MANAGED"]
        old = time.time() - 3600 * hours
        removed = 0
        for group, _ in folders.children(self.spark, self._folder):
            if not group.endswith(".versions"):
                continue
            for path, changed in folders.children(self.spark, group):
                if changed <= old and not any(folders.same(self.spark, path, x) for x in used):
                    removed += folders.remove(self.spark, path)
        return removed

    def _location(self, table: str) -> str:
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(table)}")
        return described.filter("col_name = 'Location'").first()["data_type"]

    def _point(self, table: str, location: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name(table)} SET LOCATION '{location}'")
        self.spark.catalog.refreshTable(self.name(table))

    def _drop_day(self, table: str, day: str) -> None:
        value = "NULL" if day == NO_DAY else f"DATE '{day}'"
        self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({schemas.DAY} = {value})")

    @staticmethod
    def _days_of(rows: DataFrame) -> set[str]:
        """The different days of rows, by name; they are folders, so few."""
        found = rows.select(schemas.DAY).distinct().collect()
        return {NO_DAY if row[0] is None else str(row[0]) for row in found}

    def days(self, table: str) -> list[str]:
        """The stored days; one entry per day, so the list stays short."""
        rows = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()
        return [row["partition"].split("=", 1)[1] for row in rows]

    def drop_folders_of(self, table: str, days: Iterable[str]) -> None:
        """Drop all folders of some days of a table whose first folders are days."""
        wanted = set(days)
        for row in self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect() if wanted else ():
            parts = dict(x.split("=", 1) for x in row["partition"].split("/"))
            if parts.pop(schemas.DAY) in wanted:
                day = row["partition"].split("/")[0].split("=", 1)[1]
                value = "NULL" if day == NO_DAY else f"DATE '{day}'"
                rest = "".join(f", {name} = {x}" for name, x in parts.items())
                self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({schemas.DAY} = {value}{rest})")

    def drop_days(self, table: str, before: str) -> int:
        """Drop every day before a date; rows without a day stay. No data is read."""
        old = [d for d in self.days(table) if d != NO_DAY and d < before]
        for day in old:
            self._drop_day(table, day)
        return len(old)

    @staticmethod
    def _balanced(rows: DataFrame) -> DataFrame:
        """Few files per day: Spark gathers small days and splits large ones by size."""
        return rows.hint("rebalance", F.col(schemas.DAY)) if schemas.DAY in rows.columns else rows

    @staticmethod
    def _counted(rows: DataFrame):
        seen = Observation()
        return rows.observe(seen, F.count(F.lit(1)).alias("rows")), lambda: int(seen.get["rows"])


class ArticleStore:
    """Articles, publishers, mentions and related pairs with the queries over them.

    ``as_of`` of each call defaults to the current UTC time. Batches are DataFrames; ``order`` picks
    the row that counts when a batch repeats a key.
    """

    def __init__(self, spark: SparkSession, database: str = "press", location: str | None = None):
        self.spark = spark
        self.tables = Tables(spark, database, location)
        for table, schema in schemas.TABLES.items():
            self.tables.create(table, schema, schemas.DAY if table in schemas.DAY_PARTITIONED else None)
        self.tables.create("rejects", schemas.REJECTS)
        self.tables.create("post_states", schemas.POST_STATES.fields[:-1], schemas.DAY)

    def table(self, name: str) -> DataFrame:
        """A stored table with its own columns only."""
        return self.tables.read(name).select(*schemas.TABLES[name].fieldNames())

    # Reference labels

    def set_labels(self, categories: DataFrame | None = None, sentiments: DataFrame | None = None) -> None:
        """Replace the reference labels that are given."""
        for table, rows in (("categories_ref", categories), ("sentiments_ref", sentiments)):
            if rows is not None:
                self.tables.replace(table, ingest.align(rows, schemas.TABLES[table]))

    # Ingest

    # Word index

    def build_text_index(self) -> int:
        """Index the words of all articles; from then on every change of articles changes the index too."""
        columns = [f for f in text_index.POSTINGS if f.name not in (schemas.DAY, text_index.BUCKET)]
        layout = [*columns, text_index.POSTINGS[schemas.DAY], text_index.POSTINGS[text_index.BUCKET]]
        self.tables.create("postings", layout, folders_by=(schemas.DAY, text_index.BUCKET))
        return self.refresh_text_index()

    def refresh_text_index(self) -> int:
        """Index the days whose number of articles is not the one indexed, and return how many.

        So the index catches up when a run ended between a change of the articles and that of the index.
        """
        stored = self.tables.read("articles").filter("url IS NOT NULL").groupBy(schemas.DAY).agg(F.count(F.lit(1)).alias("n"))
        indexed = text_index.articles_per_day(self.tables.read("postings"))
        same_day = stored[schemas.DAY].eqNullSafe(indexed[schemas.DAY])
        both = stored.join(indexed, same_day, "full").filter(~F.col("n").eqNullSafe(F.col("articles")))
        days = both.select(F.coalesce(stored[schemas.DAY], indexed[schemas.DAY])).collect()
        self._index_days([row[0] for row in days])
        return len(days)

    @property
    def _indexed(self) -> bool:
        return self.tables.exists("postings")

    def _index_days(self, days: Sequence[date | None]) -> None:
        """Index some days anew. A day without articles loses its folders."""
        days = set(days)
        if not days:
            return
        articles = self.tables.read("articles").filter(in_days(days))
        rows, folder = self.tables.once(text_index.postings(articles))
        try:
            left = {row[0] for row in rows.filter(F.col("term") == text_index.ALL).select(schemas.DAY).distinct().collect()}
            self.tables.overwrite_days("postings", rows, balanced=True)
            self.tables.drop_folders_of("postings", [NO_DAY if d is None else str(d) for d in days - left])
        finally:
            folders.remove(self.spark, folder)

    def search_text(
        self, query: str | Sequence[str], limit: int = 10, offset: int = 0, columns: Sequence[str] | None = None, **filters
    ) -> DataFrame:
        """Articles with any word of the query, best first, with ``search_score``; filters as in ``query_latest``.

        With an index only the folders of the query's words are read, and articles of no others.
        """
        articles = self.tables.read("articles")
        wanted = list(columns or schemas.ARTICLES.fieldNames())
        rows = articles.filter(article_filter(**filters))
        if self._indexed:
            hits = text_index.indexed_search(self.tables.read("postings"), rows, query)
        else:
            hits = search.text_search(rows, query, rank_from=articles)
        return page(hits, search.by_search_score(), limit, offset).select(*wanted, "search_score")

    # Further searches and counts

    def similar_to(self, url: str, distance: float | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
        """Articles near a stored one that share a tag with it; none when it has no embedding or tags."""
        return search.similar_to(self.table("articles"), url, distance, limit, offset)

    def tag_counts(self, field: str, exclude: Sequence[str] = (), limit: int = 0, offset: int = 0, **filters) -> DataFrame:
        """How many of the filtered articles carry each element of an array field, most frequent first."""
        return search.tag_counts(self.table("articles").filter(article_filter(**filters)), field, exclude, limit, offset)

    def sample(self, size: int, seed: int = 0, **filters) -> DataFrame:
        """A random sample of the filtered articles, the same for the same seed."""
        return search.sample(self.table("articles").filter(article_filter(**filters)), size, seed)

    def clusters(self, eps: float = schemas.CLUSTER_EPS) -> DataFrame:
        """``url``, ``cluster_id`` and ``related`` of the articles that have similar ones."""
        return similarity.similar_clusters(self.table("articles"), eps)

    def mention_rollup(self, as_of=None, days_ago: int = 0, urls: Sequence[str] | None = None) -> DataFrame:
        """Totals of the highest counts of each post, per article."""
        return mention_rollup(self.table("mentions"), as_of or dates.now_utc(), days_ago, urls)

    # Batches

    def deduplicate(self, name: str, batch: DataFrame) -> DataFrame:
        return ingest.deduplicate(self.table(name), batch, schemas.KEYS.get(name, []))

    def store_articles(self, batch: DataFrame, as_of=None, order=None) -> int:
        as_of = as_of or dates.now_utc()
        return self._insert("articles", ingest.stamp(batch, as_of, "created", "collected"), order, as_of)

    def store_publishers(self, batch: DataFrame, as_of=None, order=None) -> int:
        as_of = as_of or dates.now_utc()
        return self._insert("publishers", ingest.stamp(batch, as_of, "collected"), order, as_of)

    def load(self, name: str, path: str, file_format: str = "parquet", as_of=None, **options) -> int:
        """Store the rows of parquet, json or csv files in a table, like a batch.

        Lines that cannot be read, or hold values of another type, go to ``rejects`` with their text.
        """
        if file_format == "parquet":
            batch = self.spark.read.parquet(path)
        else:
            readers = {"json": files.load_json, "csv": files.load_csv}
            batch = readers[file_format](self.spark, path, schemas.TABLES[name], cleaning.BROKEN, **options)
        stores = {
            "articles": self.store_articles,
            "publishers": self.store_publishers,
            "mentions": self.store_mentions,
            "related": self.store_related,
        }
        return stores[name](batch, as_of)

    def rejects(self, name: str | None = None) -> DataFrame:
        """Rows that were not stored: ``target``, ``at``, ``problems`` and ``content``, the row as JSON."""
        rows = self.tables.read("rejects")
        return rows.filter(F.col("target") == name) if name else rows

    def _accepted(self, name: str, batch: DataFrame, as_of) -> tuple[DataFrame, str]:
        """The rows of a batch that fit a table, written once, and their folder; the others become rejects.

        The batch is checked, written and its rejects are counted in one pass.
        """
        bad = F.size("problems") > 0
        rows, counts = self.tables.observed(cleaning.checked(batch, name), bad=F.count_if(bad))
        rows, folder = self.tables.once(rows)
        if counts()["bad"]:
            self.tables.append("rejects", cleaning.rejects(rows.filter(bad), name, as_of))
        return rows.filter(~bad).drop("problems", cleaning.BROKEN), folder

    def store_related(self, batch: DataFrame, as_of=None, order=None) -> int:
        return self._insert("related", batch, order, as_of or dates.now_utc())

    def store_mentions(self, batch: DataFrame, as_of=None) -> int:
        as_of = as_of or dates.now_utc()
        # Counts that the batch does not have start at 0.
        batch = batch.withColumns({c: F.lit(0) for c in schemas.COUNT_COLUMNS if c not in batch.columns})
        rows, folder = self._accepted("mentions", ingest.stamp(batch, as_of, "collected"), as_of)
        try:
            return self.tables.append("mentions", self._by_day("mentions", ingest.mention_rows(rows, as_of)))
        finally:
            folders.remove(self.spark, folder)

    def update_articles(
        self, batch: DataFrame, columns: Sequence[str] | None = None, nulls: str = "set", order=None
    ) -> int:
        """Update stored articles and return how many matched."""
        changed = [c for c in (columns or batch.columns) if c in schemas.ARTICLES.fieldNames()]
        batch, folder = self.tables.once(batch.select("url", *[c for c in changed if c != "url"]))
        try:
            return self._update_days(batch, changed, nulls, order)
        finally:
            folders.remove(self.spark, folder)

    def _update_days(self, batch: DataFrame, changed: Sequence[str], nulls: str, order) -> int:
        stored = self.tables.read("articles")
        touched = stored.join(matching_keys(stored, batch, ["url"]), "url", "left_semi")
        per_day = touched.groupBy(schemas.DAY).agg(F.count(F.lit(1)).alias("rows")).collect()
        if not per_day:
            return 0
        left = [row[schemas.DAY] for row in per_day]
        if "collected" in changed:
            # Rows may move, so the days they leave are replaced and those they come to are added to.
            days = stored.filter(in_days(left)).drop(schemas.DAY)
            rows = ingest.update(days, batch, ["url"], nulls=nulls, order=order)
            names = [NO_DAY if day is None else str(day) for day in left]
            self.tables.replace_days("articles", self._by_day("articles", rows), names)
            if self._indexed:
                now = self.tables.read("articles").join(matching_keys(self.tables.read("articles"), batch, ["url"]), "url", "left_semi")
                self._index_days([*left, *(row[0] for row in now.select(schemas.DAY).distinct().collect())])
        else:
            days = stored.filter(in_days(left))
            self.tables.overwrite_days("articles", ingest.update(days, batch, ["url"], nulls=nulls, order=order))
            if self._indexed and {"title", "summary", "regions", "entities", "categories"} & set(changed):
                self._index_days(left)
        return sum(row["rows"] for row in per_day)

    def update_embeddings(self, batch: DataFrame, order=None) -> int:
        """Set embeddings and the labels nearest to them."""
        rows = ingest.one_per_key(batch, ["url"], order)
        found = labels.label_sets(rows, self.tables.read("categories_ref"), self.tables.read("sentiments_ref"))
        return self.update_articles(found)

    def backfill_labels(self) -> int:
        waiting = self.table("articles").filter("embedding IS NOT NULL AND categories IS NULL")
        found = labels.label_sets(waiting, self.tables.read("categories_ref"), self.tables.read("sentiments_ref"))
        return self.update_articles(found, ["categories", "sentiments"])

    def update_publishers(self, batch: DataFrame, nulls: str = "set", order=None) -> int:
        stored = self.tables.read("publishers")
        matched = matching_keys(stored, batch, ["source"]).count()
        if matched:
            self.tables.replace("publishers", ingest.update(stored, batch, ["source"], nulls=nulls, order=order))
        return matched

    def link_similar(self, eps: float = schemas.CLUSTER_EPS) -> int:
        """Store the similar pairs that are not stored yet."""
        rows = similarity.new_related(self.tables.read("related"), self.table("articles"), eps)
        return self.tables.append("related", rows)

    def _insert(self, name: str, batch: DataFrame, order, as_of) -> int:
        batch, folder = self._accepted(name, batch, as_of)
        made = [folder]
        try:
            fresh = ingest.new_rows(self.table(name), batch, schemas.KEYS[name], order)
            rows = self._by_day(name, ingest.align(fresh, schemas.TABLES[name]))
            if name != "articles" or not self._indexed:
                return self.tables.append(name, rows)
            # Written once, as the index reads the new rows too.
            rows, folder = self.tables.once(rows)
            made.append(folder)
            stored = self.tables.append(name, rows)
            self.tables.append("postings", text_index.postings(rows), balanced=True)
            return stored
        finally:
            for folder in made:
                folders.remove(self.spark, folder)

    def _by_day(self, name: str, rows: DataFrame) -> DataFrame:
        """With the day column of a partitioned table."""
        return rows.withColumn(schemas.DAY, F.to_date("collected")) if name in schemas.DAY_PARTITIONED else rows

    # Queries

    def query_latest(self, **options) -> DataFrame:
        return queries.query_latest(self.tables.read("articles"), **options)

    def query_trending(self, **options) -> DataFrame:
        return queries.query_trending(self.tables.read("articles"), self.tables.read("trends"), **options)

    def query_aggregated(self, **options) -> DataFrame:
        tables = (self.tables.read(t) for t in ("articles", "trends", "related", "publishers"))
        return queries.query_aggregated(*tables, **options)

    def query_publishers(self, **options) -> DataFrame:
        return queries.query_publishers(self.tables.read("publishers"), **options)

    def query_mentions(self, **options) -> DataFrame:
        return queries.query_mentions(self.tables.read("mentions"), **options)

    def query_aggregated_mentions(self, **options) -> DataFrame:
        return queries.query_aggregated_mentions(self.tables.read("trends"), **options)

    def distinct_categories(self, limit: int = 0, offset: int = 0) -> DataFrame:
        return queries.distinct_labels(self.tables.read("categories_ref"), "category", limit, offset)

    def distinct_sentiments(self, limit: int = 0, offset: int = 0) -> DataFrame:
        return queries.distinct_labels(self.tables.read("sentiments_ref"), "sentiment", limit, offset)

    def distinct_entities(self, limit: int = 0, offset: int = 0) -> DataFrame:
        return queries.distinct_elements(self.table("articles"), "entities", "entity", limit, offset)

    def distinct_regions(self, limit: int = 0, offset: int = 0) -> DataFrame:
        return queries.distinct_elements(self.table("articles"), "regions", "region", limit, offset)

    def distinct_publishers(self, limit: int = 0, offset: int = 0) -> DataFrame:
        return queries.distinct_publishers(self.tables.read("publishers"), limit, offset)

    def count_rows(self, name: str, conditions: Sequence[str] | None = None) -> int:
        return queries.count_rows(self.table(name), conditions).first()["count"]

    def query(self, sql: str, args=None) -> DataFrame:
        """Ad-hoc SQL over the tables and the views ``trending_articles`` and ``aggregated_articles``."""
        register_views(self.spark, {name: self.table(name) for name in schemas.TABLES})
        return self.spark.sql(sql, args=args)

    # Maintenance

    def optimize(self, as_of=None, window: str = schemas.RETENTION_WINDOW) -> None:
        """Drop what is older than the window, recompute the trends, remove orphaned related pairs and old versions."""
        as_of = as_of or dates.now_utc()
        start = self.spark.range(1).select(dates.window_start(as_of, window).cast("string").alias("d")).first()["d"]
        for table in schemas.DAY_PARTITIONED:
            self.tables.drop_days(table, start)
        if self._indexed:
            self.refresh_text_index()
        articles, related = self.table("articles"), self.tables.read("related")
        self.refresh_states()
        self.tables.replace("trends", trends_from_states(articles, self.tables.read("post_states"), related, as_of))
        self.tables.replace("related", ingest.drop_orphans(related, articles))
        self.tables.vacuum()

    def refresh_states(self) -> int:
        """Bring the states of posts up to date and return how many days were read for it.

        A day is read again when its number of snapshots is not the one its state was made from, so
        late snapshots count. Numbers of rows come from the files' footers.
        """
        states = self.tables.read("post_states")
        stored = self.tables.read("mentions").groupBy(schemas.DAY).agg(F.count(F.lit(1)).alias("n"))
        known = snapshots_per_day(states)
        both = stored.join(known, stored[schemas.DAY].eqNullSafe(known[schemas.DAY]), "full")
        stale = both.filter(~F.col("n").eqNullSafe(F.col("snapshots")))
        days = [row[0] for row in stale.select(F.coalesce(stored[schemas.DAY], known[schemas.DAY])).collect()]
        if days:
            names = [NO_DAY if day is None else str(day) for day in days]
            self.tables.replace_days("post_states", post_states(self.tables.read("mentions").filter(in_days(days))), names)
        return len(days)

    def cleanup(self, min_files: int = 16) -> int:
        """Rewrite days of at least ``min_files`` files into few files; returns how many days."""
        rewritten = 0
        for table in schemas.DAY_PARTITIONED:
            rows = self.tables.read(table)
            files = rows.select(schemas.DAY, F.col("_metadata.file_path").alias("file")).distinct()
            many = files.groupBy(schemas.DAY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_files)
            days = [row[schemas.DAY] for row in many.collect()]
            if days:
                self.tables.overwrite_days(table, rows.filter(in_days(days)))
                rewritten += len(days)
        return rewritten


class VectorItemStore:
    """Tables of id, embedding and insert time, searched by distance, and static side tables."""

    def __init__(
        self,
        spark: SparkSession,
        database: str,
        id_columns: dict[str, str],
        location: str | None = None,
        **static_tables: DataFrame,
    ):
        self.tables = Tables(spark, database, location)
        self.id_columns = dict(id_columns)
        for table, id_column in self.id_columns.items():
            self.tables.create(table, schemas.vector_items(id_column))
        for table, rows in static_tables.items():
            if not self.tables.exists(table):
                self.set_table(table, rows)

    def set_table(self, table: str, rows: DataFrame) -> None:
        """Create or overwrite a static table."""
        rows.write.format("parquet").mode("overwrite").saveAsTable(self.tables.name(table))

    # Index

    def build_index(self, table: str, metric: str = "l2", **options) -> Cells:
        """Train cells and deal the stored items to them; from then on new items are dealt as well."""
        id_column = self.id_columns[table]
        items = self.tables.read(table).select(id_column, "embedding")
        cells = vector_index.train_cells(items, id_column, metric=metric, **options)
        layout = [*schemas.vector_items(id_column).fields[:2], T.StructField(vector_index.CELL, T.IntegerType())]
        name = self._index(table)
        if self.tables.exists(name):
            self.tables.spark.sql(f"DROP TABLE {self.tables.name(name)}")
        self.tables.create(name, T.StructType(layout), folders_by=[vector_index.CELL])
        self.tables.append(name, vector_index.indexed(items, cells), balanced=True)
        centres = [(i, x.tolist(), cells.probe, metric) for i, x in enumerate(cells.centres)]
        self.set_table(f"{table}_cells", self.tables.spark.createDataFrame(centres, self._CELLS))
        return self.cells(table)

    _CELLS = "cell int, centre array<double>, probe int, metric string"

    def _index(self, table: str) -> str:
        return f"{table}_by_cell"

    def cells(self, table: str) -> Cells:
        """The stored cells of a table with their numbers of rows."""
        rows = self.tables.read(f"{table}_cells").orderBy("cell").collect()
        cells = Cells(np.array([r["centre"] for r in rows]).reshape(len(rows), -1), rows[0]["probe"] if rows else 0)
        return vector_index.cell_rows(self.tables.read(self._index(table)), cells)

    def search_cells(
        self, table: str, embedding: Sequence[float], limit: int, cells: Cells | None = None, metric: str = "l2", probe: int | None = None
    ) -> DataFrame:
        """The nearest items among the cells near the query, with ``_distance``; see ``build_index``."""
        found = vector_index.nearest_in_cells(
            self.tables.read(self._index(table)), cells or self.cells(table), embedding, limit, metric, probe, self.id_columns[table]
        )
        return found.withColumnRenamed("distance", "_distance")

    def store(self, table: str, items: DataFrame, as_of=None, order=None) -> int:
        """Add items with a new id, stamped with one moment per batch; returns how many."""
        id_column = self.id_columns[table]
        schema = schemas.vector_items(id_column)
        moment = dates.as_datetime(as_of or dates.now_utc()).replace(microsecond=0).isoformat(sep=" ") + "+00:00"
        fresh = ingest.new_rows(self.tables.read(table), items, [id_column], order)
        rows = ingest.align(fresh.withColumn("ts", F.lit(moment).cast("timestamp")), schema)
        if not self.tables.exists(self._index(table)):
            return self.tables.append(table, rows)
        rows, folder = self.tables.once(rows)
        try:
            stored = self.tables.append(table, rows)
            placed = vector_index.indexed(rows.select(id_column, "embedding"), self.cells(table))
            self.tables.append(self._index(table), placed, balanced=True)
        finally:
            folders.remove(self.tables.spark, folder)
        return stored

    def search(self, table: str, embedding: Sequence[float], metric: str = "l2", **options) -> DataFrame:
        options["id_column"] = self.id_columns[table]
        return search.search_items(self.tables.read(table), embedding, metric, **options)

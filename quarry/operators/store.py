"""Mutations as new versions of tables: upsert, delete, cascade, and a store that writes them.

Every function takes tables and gives the table after the change; :class:`Store` keeps tables in partitions by
repository and overwrites those that a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarry import schemas


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of the same key. Of several new rows with one key the last by
    ``seq``, if there is such a column, else by all columns, wins."""
    order = [F.desc("seq")] if "seq" in new.columns else [F.desc(c) for c in new.columns]
    one = new.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    return old.join(one.select(key), key, "left_anti").select(*old.columns).unionByName(one.select(*old.columns))


def add_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by chunk id; a vector without chunk or repository id is an error."""
    checked = new.withColumn("chunk_id", F.when(F.col("chunk_id").isNull() | F.col("repo_id").isNull(), F.raise_error(F.lit("chunk_id and repo_id are required"))).otherwise(F.col("chunk_id")))
    return upsert(old, checked, "chunk_id")


def delete(rows: DataFrame, repo_id: str | None = None, ids: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Without those of the repository, of the ids, or of both together; without all if neither is given."""
    if ids is None:
        return rows.where(F.lit(False)) if repo_id is None else rows.where(~F.col("repo_id").eqNullSafe(repo_id))
    gone = ids.select(F.col(ids.columns[0]).alias(id_col)).distinct()
    if repo_id is None:
        return rows.join(gone, id_col, "left_anti").select(*rows.columns)
    mine = gone.withColumn("repo_id", F.lit(repo_id))
    return rows.join(mine, [id_col, "repo_id"], "left_anti").select(*rows.columns)


def cascade(tables: dict[str, DataFrame], repo_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the repositories: the repositories' rows, then everything that hangs on them."""
    gone = repo_ids.select(F.col(repo_ids.columns[0]).alias("__gone")).distinct()
    return {name: df.join(gone, F.col("id" if name == "repos" else "repo_id") == F.col("__gone"), "left_anti") for name, df in tables.items()}


def update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Set columns where a condition holds."""
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def set_counts(repos: DataFrame, chunks: DataFrame) -> DataFrame:
    """Repositories with their numbers of chunks and files, 0 where there are none."""
    n = chunks.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("f"))
    return repos.drop("chunk_count", "file_count").join(n, "id", "left").withColumns({"chunk_count": F.coalesce("n", F.lit(0)), "file_count": F.coalesce("f", F.lit(0))}).drop("n", "f")


def duplicates(repos: DataFrame, new: DataFrame) -> DataFrame:
    """New repositories whose (type, path) is there already (code 1002)."""
    return new.join(repos.select("type", "path").distinct(), ["type", "path"], "left_semi").select(*new.columns)


def next_messages(history: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages as rows of the history: in the order of their ``seq`` after each repository's last; errors
    carry no references."""
    last = history.groupBy("repo_id").agg(F.max("seq").alias("last"))
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("seq"))
    new = messages.withColumn("n", place).join(last, "repo_id", "left").withColumn("seq", F.col("n") + F.coalesce("last", F.lit(-1)))
    new = new.withColumn("references_json", F.when(F.col("role") == "error", F.lit(None)).otherwise(F.col("references_json")))
    return new.select(*history.columns)


def append_message(history: DataFrame, messages: DataFrame) -> DataFrame:
    """The history with the messages after it."""
    return history.unionByName(next_messages(history, messages))


_REFERENCE = "array<struct<chunk_id: string, file_path: string, snippet: string, score: double>>"


def parse_references(json: Column) -> Column:
    """``struct<references, retrieval_fusion>`` of a stored text: a bare array, or an object with an array;
    anything else is null. An unknown fusion mode is null."""
    body = F.trim(json)
    bare = F.from_json(F.when(body.startswith("["), body), _REFERENCE)
    whole = F.from_json(F.when(body.startswith("{"), body), f"struct<references: {_REFERENCE}, retrieval_fusion: string>")
    found = F.coalesce(bare, whole["references"])
    mode = F.when(whole["retrieval_fusion"].isin("weighted", "rrf") & whole["references"].isNotNull(), whole["retrieval_fusion"])
    return F.struct(found.alias("references"), mode.alias("retrieval_fusion"))


def serialize_references(references: Column, mode: Column) -> Column:
    return F.when(mode.isNull(), F.to_json(references)).otherwise(F.to_json(F.struct(references.alias("references"), mode.alias("retrieval_fusion"))))


#: Partitions that a change may name in its filter.
NAMED = 1000


class Store:
    """Tables of the service as Parquet, in partitions by repository.

    A change overwrites the partitions it has rows for (``partitionOverwriteMode=dynamic``) and leaves all others' files
    alone. Spark writes a partition's new files first and puts them in place when the job commits, so a partition may be
    read while it is replaced; a frame that was made before must be evaluated before. One change is of one table: the
    service's status column tells whether a repository's tables belong together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        mark = self._at(f"version={schemas.VERSION}")
        files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        others = [s.getPath().getName() for s in files.globStatus(self._at("version=*")) or []]
        if others not in ([], [mark.getName()]):
            raise ValueError(f"the store has schema {others[0]}, not {mark.getName()}")
        files.mkdirs(mark)

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _part(self, name: str, repo_id: str):
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return self._at(name, f"{schemas.PARTITIONS[name][0]}={escape(repo_id)}")

    def read(self, name: str, repo_id: str | None = None) -> DataFrame:
        """A table, or one repository's partition of it."""
        place = self._at(name) if repo_id is None else self._part(name, repo_id)
        if not self._files().exists(place):
            return self.spark.createDataFrame([], schemas.TABLES[name])
        rows = self.spark.read.schema(schemas.TABLES[name]).option("basePath", f"{self.path}/{name}").parquet(place.toString())
        return rows.select(*schemas.columns(name))

    def of(self, name: str, repo_ids: DataFrame) -> DataFrame:
        """The partitions of the repositories, a small set whose first column they are: the scan is pruned when it runs."""
        key = schemas.PARTITIONS[name][0]
        own = repo_ids.select(F.col(repo_ids.columns[0]).alias(key)).where(F.col(key) > "").distinct()  # a comparison makes it worth a subquery
        return self.read(name).join(F.broadcast(own), key, "left_semi").select(*schemas.columns(name))

    def _touched(self, name: str, keys: DataFrame) -> DataFrame:
        """The table's partitions that the keys name: in the filter if they are few."""
        key = schemas.PARTITIONS[name][0]
        own = keys.select(key).distinct()
        few = [r[0] for r in own.limit(NAMED + 1).collect()]
        rows = self.read(name)
        return rows.where(F.col(key).isin(few)) if len(few) <= NAMED else rows.join(own, key, "left_semi")

    def _write(self, name: str, rows: DataFrame, mode: str) -> int:
        """Write rows into their partitions; how many, counted as they are written."""
        wrong = schemas.broken(name)
        checked = rows.select(*schemas.columns(name)).where(F.when(wrong, F.raise_error(F.lit(f"rows of {name} break its constraints")).cast("boolean")).otherwise(True))
        if name in schemas.KEYS:
            key = schemas.KEYS[name]
            twice = rows.groupBy(key).count().where("count > 1")
            if twice.limit(1).count():
                raise ValueError(f"rows of {name} break its constraints: {key} is not unique")
        seen = Observation()
        checked = checked.observe(seen, F.count(F.lit(1)).alias("n"))
        if name == "segments":
            checked = checked.sortWithinPartitions("repo_id", "segment", "term")
        out = checked.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*schemas.PARTITIONS[name])
        out.parquet(f"{self.path}/{name}")
        return seen.get["n"]

    def replace(self, name: str, repo_id: str, rows: DataFrame) -> int:
        """A repository's rows of a table, instead of those there were; how many."""
        n = self._write(name, rows, "overwrite")
        if not n:  # nothing was written, so nothing was overwritten
            self._files().delete(self._part(name, repo_id), True)
        return n

    def overwrite(self, name: str, rows: DataFrame) -> int:
        """The partitions that rows are of, instead of what these had; how many rows."""
        return self._write(name, rows, "overwrite")

    def append(self, name: str, rows: DataFrame) -> int:
        return self._write(name, rows, "append")

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Rows replace those of the same key; only partitions that rows name are read and written. How many rows came."""
        rows = rows.persist()
        try:
            n = rows.count()
            if n:
                whole = upsert(self._touched(name, rows), rows, schemas.KEYS[name])
                self._write(name, whole, "overwrite")
            return n
        finally:
            rows.unpersist()

    def drop(self, name: str, repo_id: str) -> int:
        """A repository's partition goes; how many rows it had."""
        part = self._part(name, repo_id)
        if not self._files().exists(part):
            return 0
        n = self.read(name, repo_id).count()
        self._files().delete(part, True)
        return n

    def delete(self, name: str, ids: DataFrame, repo_id: str | None = None) -> int:
        """The rows of the ids, of one repository if it is given; how many went. Partitions without any of them stay as they
        are, those of which nothing is left go."""
        key, part = schemas.KEYS[name], schemas.PARTITIONS[name][0]
        gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
        hit = self.read(name, repo_id).join(gone, key, "left_semi").groupBy(part).count().persist()
        try:
            n = hit.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
            if n:
                before = self._touched(name, hit)
                left = before.join(gone, key, "left_anti").persist()
                emptied = [r[0] for r in hit.join(left.select(part).distinct(), part, "left_anti").select(part).collect()]
                if not left.isEmpty():
                    self._write(name, left, "overwrite")
                left.unpersist()
                for repo in emptied:
                    self._files().delete(self._part(name, repo), True)
            return n
        finally:
            hit.unpersist()

    def compact(self, name: str, repo_id: str) -> None:
        """One file for a repository's rows, which may have come one by one."""
        self._write(name, self.read(name, repo_id).coalesce(1), "overwrite")

"""The store: tables of a corpus, and mutations as DataFrame -> DataFrame.

Plain Parquet has no MERGE: a mutation gives the table's next state, and :class:`Store` writes it beside the old one and then switches
to it, so readers never see half a table and a failed write leaves the old state.  A table format with MERGE could do it in place.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id bigint, path string, filename string, format string, content_hash string, parse_method string, status string, metadata map<string,string>, language string, created_at timestamp, updated_at timestamp",
    "chunks": "id bigint, document_id bigint, parent_chunk_id bigint, content string, chunk_type string, heading string, page_number int, position_in_doc bigint, token_count bigint, metadata string, content_hash string",
    "embeddings": "chunk_id bigint, embedding array<float>",
    "chunk_terms": "chunk_id bigint, dl bigint, ts array<string>",
    "translations": "term string, language string, translation string",
    "entities": "id bigint, name string, name_en string, entity_type string, description string, metadata map<string,string>",
    "relationships": "source_entity_id bigint, target_entity_id bigint, relation_type string, weight double, description string, source_chunk_id bigint",
    "entity_chunks": "entity_id bigint, chunk_id bigint",
    "communities": "level int, community bigint, entity_ids array<bigint>, summary string",
    "images": "id bigint, chunk_id bigint, document_id bigint, page_number int, mime string, width int, height int, data binary",
    "query_log": "asked_at timestamp, question string, answer string, confidence double, rounds int, sources string, tokens bigint",
    "migrations": "version int, description string, applied_at timestamp",
}
STATUSES = ("pending", "processing", "ready", "error")
#: Ordered changes of the layout: (version, description, table, column, type).
MIGRATIONS = [
    (1, "first layout", None, None, None),
    (2, "English names of entities", "entities", "name_en", "string"),
    (3, "language of documents", "documents", "language", "string"),
    (4, "index of stems, translations of terms", None, None, None),
]


def last_wins(rows: DataFrame, keys: list[str], order: str, keep_blank: bool = True) -> DataFrame:
    """One row a key: the one of greatest ``order``. ``keep_blank=False`` takes each column's last value that isn't blank instead."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    if keep_blank:
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, order), order).alias("r"))
        return best.select(*keys, *[F.col("r")[c].alias(c) for c in [*rest, order]])
    solid = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))
    return rows.groupBy(*keys).agg(*[F.max_by(c, solid(c)).alias(c) for c in rest], F.max(order).alias(order))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; columns of ``keep`` stay as they were. One full join on the key."""
    o, n = old.alias("o"), new.alias("n")
    is_new = reduce(lambda a, b: a | b, [F.col(f"n.{k}").isNotNull() for k in keys])
    is_old = reduce(lambda a, b: a | b, [F.col(f"o.{k}").isNotNull() for k in keys])
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])

    def pick(c: str):
        if c in keys:
            return F.coalesce(f"n.{c}", f"o.{c}").alias(c)
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        if c in keep:
            return F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, on, "full").select(*[pick(c) for c in old.columns])


def set_where(df: DataFrame, condition, **values) -> DataFrame:
    """A point update: the columns get the values where the condition holds."""
    hit = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumns({c: F.when(hit, v if not isinstance(v, (str, int, float, bool)) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows whose key column is among the ids of ``gone`` (id); null keys stay."""
    ids = gone.select(F.col("id").alias("q_gone")).distinct()
    return {name: df.join(ids, F.col(key) == F.col("q_gone"), "left_anti") for name, (df, key) in tables.items()}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of every table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


CELLS = 1024


def numbered(df: DataFrame, key: str, start: int = 0, weight: str | None = None, name: str = "q_first") -> DataFrame:
    """Adds ``name``: ``start`` plus the weights (1 each by default) of all rows before, in the order of a hash cell and then of the key.

    Only the sums of ``CELLS`` cells meet in one place; within a cell rows are numbered where they are. Keys are distinct.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    celled = df.withColumn("q_cell", F.pmod(F.xxhash64(key), F.lit(CELLS)))
    sums = celled.groupBy("q_cell").agg(F.sum(w).alias("q_sum"))
    before = sums.select(F.col("q_cell").alias("q_c"), F.coalesce(F.sum("q_sum").over(W.orderBy("q_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("q_before"))
    inside = F.coalesce(F.sum(w).over(W.partitionBy("q_cell").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a fixed number of cells
    out = celled.withColumn("q_inside", inside).join(F.broadcast(before), F.col("q_cell") == F.col("q_c"))
    return out.withColumn(name, (F.col("q_before") + F.col("q_inside") + start).cast("bigint")).drop("q_cell", "q_c", "q_before", "q_inside")


def number_chunks(chunks: DataFrame, start: int = 1, document: str = "document_id") -> DataFrame:
    """Ids for chunks of (document, position_in_doc, parent_position), dense from ``start`` and consecutive within a document, and ids for parent positions; a
    parent that isn't there is null."""
    sizes = numbered(chunks.groupBy(document).agg(F.count(F.lit(1)).alias("q_n")), document, start, "q_n").drop("q_n")
    placed = chunks.join(sizes, document).withColumn("id", (F.col("q_first") + F.row_number().over(W.partitionBy(document).orderBy("position_in_doc")) - 1).cast("bigint")).drop("q_first")
    parents = placed.select(F.col(document).alias("q_d"), F.col("position_in_doc").alias("q_p"), F.col("id").alias("parent_chunk_id"))
    return placed.join(parents, (F.col(document) == F.col("q_d")) & (F.col("parent_position") == F.col("q_p")), "left").drop("q_d", "q_p", "parent_position")


def images_of(images: DataFrame, with_data: bool = False) -> DataFrame:
    """(chunk_id, images): the images of every chunk in the order of their ids; bytes are read only if wanted."""
    columns = ["id", "mime", "page_number", "width", "height", *(["data"] if with_data else [])]
    return images.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("images"))


def sample_chunks(chunks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` random chunks; the sample is the feature."""
    return chunks.orderBy(F.rand(seed)).limit(n)


def pending_migrations(version: int) -> list[tuple]:
    return [m for m in sorted(MIGRATIONS, key=lambda m: m[0]) if m[0] > version]


class Store:
    """Parquet tables under one folder; ``CURRENT`` in each names the state that counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.migrate()

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def current(self, name: str) -> list[str]:
        got = self._read_text(f"{self.folder}/{name}/CURRENT")
        return json.loads(got) if got else []

    def table(self, name: str) -> DataFrame:
        """A table; one that has never been written is empty. Columns that an older layout lacks are null."""
        paths = self.current(name)
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.folder}/{name}/{p}" for p in paths])

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        from pyspark.sql.types import StructType

        fields = StructType.fromDDL(SCHEMAS[name]).fields
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def replace(self, name: str, df: DataFrame) -> None:
        """The table's next state. The state before it is kept for those who still read it, and deleted by the replacement after."""
        old, part = self.current(name), uuid.uuid4().hex
        self._shaped(name, df).write.parquet(f"{self.folder}/{name}/{part}")
        self._write_text(f"{self.folder}/{name}/CURRENT", json.dumps([part]))
        older = json.loads(self._read_text(f"{self.folder}/{name}/PREVIOUS") or "[]")
        self._write_text(f"{self.folder}/{name}/PREVIOUS", json.dumps(old))
        for p in older:
            fs, path = self._fs(f"{self.folder}/{name}/{p}")
            fs.delete(path, True)

    def append(self, name: str, df: DataFrame) -> None:
        part = uuid.uuid4().hex
        self._shaped(name, df).write.parquet(f"{self.folder}/{name}/{part}")
        self._write_text(f"{self.folder}/{name}/CURRENT", json.dumps([*self.current(name), part]))

    def next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0] or 0) + 1

    def version(self) -> int:
        return self.table("migrations").agg(F.max("version")).first()[0] or 0

    def migrate(self) -> list[int]:
        """Apply what is missing, in order; what is there is skipped."""
        todo = pending_migrations(self.version())
        if todo:
            rows = self.spark.createDataFrame([(v, d) for v, d, *_ in todo], "version int, description string")
            self.append("migrations", rows.withColumn("applied_at", F.current_timestamp()))
        return [m[0] for m in todo]

    def delete_documents(self, ids: DataFrame, registry: bool = True) -> None:
        """Chunks, vectors, images, links and edges of documents go, and with ``registry`` the documents; entities stay. ``ids``: id."""
        chunks = self.table("chunks").join(ids.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_semi").select("id")
        left = cascade({"embeddings": (self.table("embeddings"), "chunk_id"), "chunk_terms": (self.table("chunk_terms"), "chunk_id"), "entity_chunks": (self.table("entity_chunks"), "chunk_id"), "relationships": (self.table("relationships"), "source_chunk_id")}, chunks)
        left |= cascade({"images": (self.table("images"), "document_id"), "chunks": (self.table("chunks"), "document_id")} | ({"documents": (self.table("documents"), "id")} if registry else {}), ids)
        # tables that depend on chunks come before them: a failure in between leaves no dangling rows
        for name in ("embeddings", "chunk_terms", "entity_chunks", "relationships", "images", "chunks", "documents"):
            if name in left:
                self.replace(name, left[name])

    def document(self, path: str | None = None, id: int | None = None) -> DataFrame:  # noqa: A002
        """The document of a path or an id; the filter goes down to the files."""
        docs = self.table("documents")
        return docs.where(F.col("path") == path) if path is not None else docs.where(F.col("id") == id)

    def chunks_of(self, document_id: int) -> DataFrame:
        """The chunks of a document by position."""
        return self.table("chunks").where(F.col("document_id") == document_id).orderBy("position_in_doc")

    def stats(self) -> DataFrame:
        return counts({t: self.table(t) for t in ("documents", "chunks", "embeddings", "entities", "relationships", "communities")})

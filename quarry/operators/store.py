"""Tables as Parquet snapshots: reading, appending, merging, cascading deletes and audit of changes.

A table's state is a list of parts, folders of Parquet files. One manifest names the parts of all tables. A change writes
its parts first and then a manifest of the next number, under a name of its own that is moved to its place if nothing is
there yet: so a change of several tables is there as a whole or not at all, readers always see one state, a crash leaves
the state before, and of two writers that began with the same state the second fails.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.context import AccessContext
from quarry.functions import text as X
from quarry.functions.models import embed
from quarry.operators.security import check_writes, secure
from quarry.schemas import KEYS, schema


def change_audit(before: DataFrame, after: DataFrame, table: str, key: list[str], actor: str, now: Column, request_id: str = "", row_pk: Column | None = None) -> DataFrame:
    """A row for each insert, update and delete between two states, with JSON images of the row. Unchanged rows have none."""
    pk = F.concat_ws("|", *(F.col(k).cast("string") for k in key)) if row_pk is None else row_pk
    columns = [c for c in before.columns if c in after.columns]

    def image(df: DataFrame, name: str) -> DataFrame:
        return df.select(pk.alias("row_pk"), F.to_json(F.struct(*columns)).alias(name))

    both = image(before, "old_data").join(image(after, "new_data"), "row_pk", "full_outer").where(~F.col("old_data").eqNullSafe(F.col("new_data")))
    action = F.when(F.col("old_data").isNull(), "INSERT").when(F.col("new_data").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(now.alias("ts"), F.lit(actor).alias("actor"), action.alias("action"), F.lit(table).alias("table_name"), "row_pk", F.lit(request_id).alias("request_id"), "old_data", "new_data")


def last_by_key(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Of the rows with one key the last by `at`; of equally late ones the greatest row."""
    others = [c for c in rows.columns if c not in key]
    newest = F.max(F.struct(F.col(at).alias("_at"), *others)).alias("_row")
    return rows.groupBy(*key).agg(newest).select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns))


#: How audit rows name a row where that isn't its key.
AUDIT_NAMES = {
    "entity_chunk": lambda: F.col("chunk_id").cast("string"),
    "entity_edge": lambda: F.concat(F.col("src_entity_id").cast("string"), F.lit("->"), F.col("dst_entity_id").cast("string"), F.lit(":"), F.col("edge_type")),
}


def cascade(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """docs, doc_versions, chunks and entity_chunk without some documents and all that hangs on them."""
    chunks = tables["chunks"].join(doc_ids, "doc_id", "left_anti")
    gone = tables["chunks"].join(doc_ids, "doc_id", "left_semi").select("chunk_id")
    out = {name: tables[name].join(doc_ids, "doc_id", "left_anti") for name in ("docs", "doc_versions") if name in tables}
    out["chunks"] = chunks
    if "entity_chunk" in tables:
        out["entity_chunk"] = tables["entity_chunk"].join(gone, "chunk_id", "left_anti")
    return tables | out


def new_version(doc_id: Column, number: Column, parser: str) -> tuple[Column, Column]:
    """(content hash, parser) of a further version."""
    return X.sha256(doc_id.cast("string"), number.cast("string")), F.lit(parser)


def chunk_rows(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Chunks (doc_id, version_id, chunk_index, chunk_text) with the application and classification of their documents."""
    return pieces.join(docs.select("doc_id", "app_id", "classification"), "doc_id").withColumn("chunk_hash", F.sha2("chunk_text", 256))


def update_chunks(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks with new texts (chunk_id, new_text, and new_embedding or not): trimmed and hashed anew; the vector stays if none is given."""
    new = changes.select("chunk_id", F.trim("new_text").alias("_text"), *([F.col("new_embedding").alias("_vector")] if "new_embedding" in changes.columns else []))
    both = chunks.join(new, "chunk_id", "left")
    changed = F.col("_text").isNotNull()
    out = both.withColumn("chunk_hash", F.when(changed, F.sha2("_text", 256)).otherwise(F.col("chunk_hash"))).withColumn("chunk_text", F.coalesce("_text", "chunk_text"))
    if "_vector" in both.columns:
        out = out.withColumn("embedding", F.coalesce("_vector", "embedding"))
    return out.select(*chunks.columns)


#: The column of a table that says when its row was changed last.
TOUCHED = {"entity": "updated_at", "entity_edge": "updated_at", "entity_summary": "last_updated_at"}
#: Manifests that are kept behind the present one.
KEPT_MANIFESTS = 50


def touch(before: DataFrame, after: DataFrame, key: list[str], column: str, now: Column) -> DataFrame:
    """The rows of after; those that are in before with other values get `now` as the time of their last change."""
    values = [c for c in after.columns if c in before.columns and c not in (*key, column)]
    old = before.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.struct(*values).alias("_old"))
    both = after.join(old, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], "left")
    changed = F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.struct(*values))
    return both.withColumn(column, F.when(changed, now).otherwise(F.col(column))).select(*after.columns)


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Transaction:
    """Reads of one state, and changes that are committed together."""

    def __init__(self, store: TableStore):
        self.store = store
        self.number, self.parts = store.state()

    def read(self, table: str, ctx: AccessContext | None = None) -> DataFrame:
        return self.store.rows(table, self.parts.get(table, []), ctx)

    def replace(self, table: str, rows: DataFrame, ctx: AccessContext | None = None) -> None:
        self.parts[table] = [self.store.write_part(table, rows, ctx)]

    def append(self, table: str, rows: DataFrame, ctx: AccessContext | None = None) -> None:
        self.parts[table] = [*self.parts.get(table, []), self.store.write_part(table, rows, ctx)]

    def merge(self, table: str, rows: DataFrame, ctx: AccessContext | None = None, now: Column | None = None) -> None:
        """Rows replace those with their key and are touched; others are added."""
        before = self.read(table)
        if table in TOUCHED:
            have = set(rows.columns)
            rows = rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))
            rows = touch(before, rows, KEYS[table], TOUCHED[table], F.current_timestamp() if now is None else now)
        kept = before.join(rows.select(*KEYS[table]), KEYS[table], "left_anti")
        self.parts[table] = [self.store.write_part(table, kept, None), self.store.write_part(table, rows, ctx)]

    def commit(self) -> None:
        self.store.publish(self.number + 1, self.parts)


def reviewed_chunks(chunks: DataFrame, changes: DataFrame, embedder=None) -> DataFrame:
    """Chunks with reviewed texts (chunk_id, new_text); with an embedder the vectors follow the texts, without one they stay."""
    if embedder is not None:
        changes = changes.withColumn("new_embedding", embed(embedder)(F.trim("new_text")))
    return update_chunks(chunks, changes)


class TableStore:
    """The persistent tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        """(Java path, its file system)."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(sc._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{self.root}/_state/{number:012d}"

    def _numbers(self) -> list[int]:
        folder, fs = self._path(f"{self.root}/_state")
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def state(self) -> tuple[int, dict[str, list[str]]]:
        """(number, parts of each table) of the present state; 0 where nothing was written yet."""
        numbers = self._numbers()
        if not numbers:
            return 0, {}
        text = "".join(r[0] for r in self.spark.read.option("wholetext", "true").text(self._manifest(numbers[-1])).collect())
        return numbers[-1], json.loads(text)

    def publish(self, number: int, parts: dict[str, list[str]]) -> None:
        """Make a state the present one, if it is the next one still."""
        sc = self.spark.sparkContext
        jvm = sc._jvm
        place, _ = self._path(self._manifest(number))
        stage, fs = self._path(f"{self.root}/_state/.{uuid.uuid4().hex}")
        out = fs.create(stage, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if self._numbers()[-1:] not in ([], [number - 1]):
            fs.delete(stage, False)
            raise Conflict(f"state {number} is not the next one")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(stage).toUri(), sc._jsc.hadoopConfiguration())
        try:  # without OVERWRITE, so it fails where the name is taken
            context.rename(fs.makeQualified(stage), fs.makeQualified(place), sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(stage, False)
            raise Conflict(f"state {number} was committed by another writer") from e
        for old in self._numbers()[: -KEPT_MANIFESTS - 1]:
            fs.delete(self._path(self._manifest(old))[0], False)

    def current(self, table: str) -> list[str]:
        """The parts of the present state; none where nothing was written yet."""
        return self.state()[1].get(table, [])

    def rows(self, table: str, parts: list[str], ctx: AccessContext | None = None) -> DataFrame:
        kind = schema(table)
        rows = self.spark.read.schema(kind).parquet(*(f"{self.root}/{table}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], kind)
        return rows if ctx is None else secure(rows, ctx)

    def read(self, table: str, ctx: AccessContext | None = None) -> DataFrame:
        """A table's current state; with a context, what it sees."""
        return self.rows(table, self.current(table), ctx)

    def write_part(self, table: str, rows: DataFrame, ctx: AccessContext | None) -> str:
        """Rows as a new part, in the table's schema; columns that aren't there are null. No state has it yet."""
        rows = check_writes(rows, ctx) if ctx is not None and "app_id" in rows.columns else rows
        have = set(rows.columns)
        shaped = rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table).fields))
        part = f"p-{uuid.uuid4().hex}"
        shaped.write.parquet(f"{self.root}/{table}/{part}")
        return part

    def begin(self) -> Transaction:
        return Transaction(self)

    def replace(self, table: str, rows: DataFrame, ctx: AccessContext | None = None) -> None:
        change = self.begin()
        change.replace(table, rows, ctx)
        change.commit()

    def append(self, table: str, rows: DataFrame, ctx: AccessContext | None = None, attempts: int = 10) -> None:
        """One more part. It depends on no other, so it is committed on top of whatever others commit meanwhile."""
        part = self.write_part(table, rows, ctx)
        for attempt in range(attempts):
            change = self.begin()
            change.parts[table] = [*change.parts.get(table, []), part]
            try:
                return change.commit()
            except Conflict:
                if attempt + 1 == attempts:
                    raise

    def merge(self, table: str, rows: DataFrame, ctx: AccessContext | None = None, now: Column | None = None) -> None:
        """Rows replace those with their key; others are added."""
        change = self.begin()
        change.merge(table, rows, ctx, now)
        change.commit()

    def compact(self, table: str) -> None:
        """One part in place of many."""
        change = self.begin()
        change.replace(table, change.read(table))
        change.commit()

    def audited(self, table: str, rows: DataFrame, actor: str, now: Column, request_id: str = "") -> None:
        """Replace a table and write down what changed, in one commit. Changed rows are touched."""
        change = self.begin()
        before, name = change.read(table), AUDIT_NAMES.get(table)
        if table in TOUCHED:
            rows = touch(before, rows, KEYS[table], TOUCHED[table], now.cast("timestamp"))
        changes = change_audit(before, rows, table, KEYS[table], actor, now, request_id, name() if name else None)
        change.append("audit_mutations", changes.withColumn("ts", F.col("ts").cast("timestamp")))
        change.replace(table, rows)
        change.commit()

    def delete_docs(self, doc_ids: DataFrame, ctx: AccessContext, jobs: DataFrame | None = None) -> int:
        """Delete documents that the context sees with all that hangs on them, in one commit; returns how many. jobs: rows
        of graph_job that are left for them in the same commit."""
        change = self.begin()
        seen = secure(change.read("docs"), ctx).join(doc_ids, "doc_id", "left_semi").select("doc_id").distinct()
        n = seen.count()
        names = ("docs", "doc_versions", "chunks", "entity_chunk")
        after = cascade({t: change.read(t) for t in names}, seen)
        for t in names:
            change.replace(t, after[t])
        if jobs is not None:
            change.append("graph_job", jobs)
        change.commit()
        return n

    def clear_app(self, app_id: str, object_root: str | None = None) -> int:
        """Delete all documents of an application and, where its objects lie below a root, those, too."""
        if object_root is not None:
            folder, fs = self._path(f"{object_root.rstrip('/')}/{app_id}")
            fs.delete(folder, True)
        docs = self.read("docs").where(F.col("app_id") == app_id)
        return self.delete_docs(docs.select("doc_id"), AccessContext(app_id, 3, role="admin"))

    def upsert_summary(self, rows: DataFrame, ctx: AccessContext | None = None, now: Column | None = None) -> None:
        """Summaries (app_id, entity_id, summary_text, ...), one an entity: the given ones replace those that are there."""
        stamped = rows.withColumn("last_updated_at", F.current_timestamp() if now is None else now.cast("timestamp"))
        self.merge("entity_summary", last_by_key(stamped, KEYS["entity_summary"], "last_updated_at"), ctx, now)

    def summary(self, ctx: AccessContext, entity_ids: DataFrame) -> DataFrame:
        """The summaries of some entities that the context sees."""
        return self.read("entity_summary", ctx).join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi")

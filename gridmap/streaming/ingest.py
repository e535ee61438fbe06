"""Process files as they arrive (Structured Streaming, file source).

``readStream`` over a folder with an explicit binary-file schema; every
micro-batch runs the same batch function (``foreachBatch``).  A batch writes
to a folder of its own (``epoch=<id>``) and replaces it when it is retried, so
with the stream's checkpoint each file's rows are there exactly once.  Of
duplicate uploads (same name and same content hash) the first one counts: the
stream keeps the keys it has seen as state (``first_uploads``), so that also
holds across batches and restarts; inside a batch the first path stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmap.sources.files import identity_columns

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def identify(batch: DataFrame) -> DataFrame:
    """Identity + content hash of newly arrived files (the batch function)."""
    cols = identity_columns("path")
    x = batch.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"),
                     *[v.alias(k) for k, v in cols.items()])
    first = x.groupBy("doc_name", "sha256").agg(F.min_by(F.struct(*[c for c in x.columns if c not in ("doc_name", "sha256")]), "path").alias("f"))
    return first.select("f.*", "doc_name", "sha256").select(*x.columns).withColumn("doc_id", F.xxhash64("path"))


def first_uploads(uploads: DataFrame, horizon: str | None = None, time_col: str = "uploaded_at") -> DataFrame:
    """The uploads of a stream (columns doc_name, content, ...) whose name and content hash did not come before, with ``sha256``.

    Every key that was seen is kept in the state store.  With ``horizon`` (such as '30 days', by ``time_col``) keys older than that
    are forgotten, so the state stays bounded; an upload repeated later than that counts as new.
    """
    keyed = uploads.withColumn("sha256", F.sha2("content", 256))
    if horizon is None:
        return keyed.dropDuplicates(["doc_name", "sha256"])
    return keyed.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["doc_name", "sha256"])


def run_batches(stream: DataFrame, out: str, checkpoint: str) -> str:
    """Writes a stream batch by batch into ``out``/epoch=<id> until all that is there has been processed; a retried batch replaces itself."""
    def sink(df: DataFrame, epoch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out


def ingest_folder(spark: SparkSession, src: str, out: str, checkpoint: str, batch_fn=identify,
                  available_now: bool = True, once: bool = True, horizon: str | None = None, files_per_batch: int | None = None,
                  bytes_per_batch: int = 256 << 20):
    """Run the stream until every file present has been processed; return ``out`` (parquet).

    ``once`` (default on): an upload of the same file name and content is processed once, also across batches and restarts;
    ``horizon``: see ``first_uploads``.  A micro-batch takes files of ``bytes_per_batch`` in all (or ``files_per_batch`` files, where
    given): each runs the whole batch function, so many small files belong into one.
    """
    limit = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", bytes_per_batch)
    stream = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
                   .option("recursiveFileLookup", "true").option(*limit).load(src))
    if once:
        names = stream.withColumn("doc_name", F.element_at(F.split("path", "/"), -1)).withColumn("uploaded_at", F.col("modificationTime"))
        stream = first_uploads(names, horizon).select("path", "modificationTime", "length", "content")

    def sink(df: DataFrame, epoch_id: int) -> None:
        batch_fn(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if available_now:
        q.awaitTermination()
    return out if available_now else q


def map_arrivals(batch: DataFrame) -> DataFrame:
    """Batch function running the whole mapping job on newly arrived delimited files and workbooks (first sheet).

    bytes -> charset (BOM / UTF-8 / Latin-1) -> text -> delimiter -> long cells -> ``map_documents``.
    """
    from gridmap.plans.pipeline import final_mapping, map_documents
    from gridmap.sources import delimited as DL
    from gridmap.sources import workbook as WB

    ids = identify(batch).where(F.col("file_type").isin("csv", "txt", "dat", "xlsx"))
    raw = batch.join(ids.select("path", "doc_id", "doc_name", "file_type"), "path")
    text = raw.where("file_type <> 'xlsx'").select("doc_id", DL.decode_bytes("content", DL.encoding_choice("content")).alias("text"))
    cells = DL.csv_grid(text.join(DL.sniff_delimiter(text), "doc_id")).select("doc_id", "row_idx", "col_idx", "value")
    books = WB.file_cells(raw.where("file_type = 'xlsx'"), all_sheets=False).where("row_idx is not null")
    cells = cells.unionByName(books.join(ids.select("path", "doc_id"), "path").select("doc_id", "row_idx", "col_idx", "value"))
    res = map_documents(cells, ids.select("doc_id", "doc_name", "file_type"))   # same lineage cuts as batch
    return final_mapping(res).join(ids.select("doc_id", "doc_name"), "doc_id")

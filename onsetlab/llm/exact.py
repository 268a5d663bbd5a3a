"""Exact deduplication as a stateful stream over disk-backed keyed state.

A slim table of keys (digest of the normalised text, identifier, content locator) is read as a
stream in several micro-batches. The stream's keyed state, in RocksDB and checkpointed to the shared
folder, has no watermark and so never expires: for each digest it retains the identifier and the locator
of the row that stays, and the number of rows; each micro-batch meets what the ones before have left.
Map-side partial aggregates go to the state, so a digest that holds a third of all rows costs one row
per task. A locator is a file and the place of the row in it; tables that are not read from Parquet
files are written first. The locators of all hits, rows of a digest that occurs again, name the rows
whose full bytes are then read again and checked: the least and the greatest normalised text of a
digest are equal only if all are, and both are formed before any shuffle. Rows of a digest that fails (a
collision) are grouped by the text itself.

Nulls, ties, odd rows: a null text counts as empty and all texts that are empty after normalising
form one class; of equal texts the row with the most code points stays, then the smallest doc_id
(null last), then the first locator, so exactly one row of a class is kept. An empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onsetlab.llm.text import SPACES, maybe_in, whole
from onsetlab.staging import new_path, staged

STATE = "spark.sql.streaming.stateStore."
STATE_STORE = {
    STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: else each sets aside megabytes of disk before it holds anything.
    STATE + "rocksdb.allowFAllocate": "false",
    STATE + "rocksdb.changelogCheckpointing.enabled": "true",
    # One bound for the memory of all stores of an executor; beyond it they work from disk.
    STATE + "rocksdb.boundedMemoryUsage": "true",
    STATE + "rocksdb.maxMemoryUsageMB": "192",
}
#: Micro-batches that the keys are read in.
BATCHES = 3
KEY = "digest string, n_chars bigint, doc_id bigint, file string, place bigint"
_best = ("n_chars", "doc_id", "file", "place")


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole(text), SPACES + "+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text, row (all columns of ``docs``) and the row's locator: file and place."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]
    try:
        return docs.select("doc_id", "text", F.struct("*").alias("row"), *place)
    except AnalysisException:  # not a plain read of Parquet files
        return staged(docs.select("doc_id", "text", F.struct("*").alias("row")), "dedup-rows").select("*", *place)


def _first() -> Column:
    """The row that stays is the least: most code points, then smallest doc_id (null last), then first locator."""
    return F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "place"))


def keyed_state(keys: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Stream a staged table of keys (``KEY``) through the keyed state; return it: one row per digest.

    Columns: digest, seen (rows), and best = (doc_id, file, place), the row that stays. The sink
    overwrites a micro-batch's folder when the batch is retried.
    """
    spark = keys.sparkSession
    files = keys.inputFiles()
    schema = "digest string, seen bigint, best struct<doc_id:bigint,file:string,place:bigint>, batch bigint"
    if not files:
        return spark.createDataFrame([], schema).drop("batch")
    out, log = new_path(spark, "dedup-state"), new_path(spark, "dedup-log")
    state = (
        spark.readStream.schema(KEY)
        .option("maxFilesPerTrigger", files_per_batch or -(-len(files) // BATCHES))
        .parquet(files[0].rsplit("/", 1)[0])
        .groupBy("digest")
        .agg(F.count("*").alias("seen"), _first().alias("top"))
    )
    best = F.struct("top.doc_id", "top.file", "top.place").alias("best")

    def write(batch: DataFrame, number: int) -> None:
        batch.select("digest", "seen", best).write.mode("overwrite").parquet(f"{out}/batch={number}")

    old = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        stream = (
            state.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(write)
        ).trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    updates = spark.read.schema(schema).parquet(out)  # of each digest the last micro-batch that met it holds
    return updates.groupBy("digest").agg(F.max_by(F.struct("seen", "best"), "batch").alias("s")).select("digest", "s.*")


def _locator() -> Column:
    return F.xxhash64("file", "place")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> DataFrame:
    """One row per document: doc_id, file and place (its locator), keep_id, group_size, kept, digest.

    ``digest`` maps the normalised text to a string; any function gives right results, a weak one
    only sends more rows through the check of full bytes.
    """
    return _decided(located(docs), digest, files_per_batch)


def _decided(rows: DataFrame, digest: Callable[[Column], Column], files_per_batch: int | None) -> DataFrame:
    size = F.char_length(whole("text")).cast("long").alias("n_chars")
    keys = staged(rows.select(digest(normalised("text")).alias("digest"), size, "doc_id", "file", "place"), "dedup-keys")
    state = staged(keyed_state(keys, files_per_batch), "dedup-seen")

    hits = staged(keys.join(state.filter("seen > 1").select("digest"), "digest").select(_locator().alias("k")), "dedup-hits")
    content = maybe_in(rows.select("text", "file", "place"), _locator(), hits).select(normalised("text").alias("content"))
    ends = content.groupBy(digest(F.col("content")).alias("digest")).agg(F.min("content").alias("least"), F.max("content").alias("most"))
    clash = staged(ends.filter("least <> most").select("digest"), "dedup-clash")

    best = [F.col("best")[c].alias(f"keep_{c}") for c in _best[1:]]
    found = keys.join(state, "digest").select("doc_id", "file", "place", "digest", *best, F.col("seen").alias("group_size"))
    if not clash.isEmpty():
        found = found.join(clash, "digest", "left_anti").unionByName(_by_content(rows, digest, clash))
    kept = (F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place"))
    return found.select("doc_id", "file", "place", F.col("keep_doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def _by_content(rows: DataFrame, digest: Callable[[Column], Column], clash: DataFrame) -> DataFrame:
    """The rows of colliding digests, grouped by the normalised text itself."""
    content = normalised("text")
    rows = rows.select(
        "doc_id", "file", "place", F.char_length(whole("text")).cast("long").alias("n_chars"),
        content.alias("content"), digest(content).alias("digest"),
    ).join(clash, "digest")
    best = rows.groupBy("digest", "content").agg(F.count("*").alias("group_size"), _first().alias("b"))
    return rows.join(best, ["digest", "content"]).select(
        "doc_id", "file", "place", "digest", *[F.col("b")[c].alias(f"keep_{c}") for c in _best[1:]], "group_size"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Only rows that may be dropped are shuffled."""
    rows = located(docs)
    gone = _decided(rows, sha256, None).filter("not kept").select(F.col("file").alias("f"), F.col("place").alias("p"))
    gone = staged(gone, "dedup-gone")
    locators = gone.select(F.xxhash64("f", "p").alias("k"))
    whole_rows = rows.select("row", "file", "place")
    sure = maybe_in(whole_rows, _locator(), locators, outside=True).select("row.*")
    maybe = maybe_in(whole_rows, _locator(), locators)
    rest = maybe.join(gone, (F.col("file") == F.col("f")) & (F.col("place") == F.col("p")), "left_anti")
    return sure.unionByName(rest.select("row.*"))


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST)
"""

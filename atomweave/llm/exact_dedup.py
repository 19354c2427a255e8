"""Exact deduplication as a stateful stream, with DataFrame functions only.

Arrivals (digest, length, identifier, locator; no text) go to a table in the shared folder, a part per batch, that a
streaming aggregation reads.  Its state lives in RocksDB under the checkpoint, never expires, and
holds one row per digest: the digest, the row that stays and the file and row where its content is.  On a hit the full
bytes are compared: those of the new rows with each other and with what stands at the locator.  A later call on the same
state folder goes on from there.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, exists, fresh_path, join_hot, likely_in, listed, removed, staged, unused

#: Characters that do not count: U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def normalised(text: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(column(text).cast("string"), F.lit("")), BLANK, "")


def sha256_of(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def located(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` can tell the file and the row that it comes from."""
    if "_metadata" in docs.columns:
        return False
    try:
        docs.select(FILE, POS)
    except AnalysisException:
        return False
    return True


FILE, POS = "_metadata.file_path", "_metadata.row_index"
BEST = "points int, last bigint, b int, p bigint, file string, col string"
CHANGED = f"digest string, best struct<{BEST.replace(' ', ':').replace(',:', ',')}>, n bigint, epoch long"
LOG = "batch int, sum string, name string, done boolean"
#: So many batches after the last time what the stream has put out is compacted.
COMPACT = 8


class StreamingExactDedup:
    """Keeps, of equal texts, the row with the most code points and then the smallest id.

    ``add(docs)`` takes a batch of rows and returns one row for each: ``id, keep_id, group_size,
    kept, digest``; earlier batches count towards groups.  A null text is an empty one; texts of any length are read
    whole.  A null id loses against any other; of fully equal rows with the same id the first of its file stays.  An empty table
    gives no rows.  Other columns of ``docs`` are not read.  Rows that don't come from Parquet files are
    written to the state folder first, so that their content can be found again; files have to stay as long as the state is used.

    A batch that failed is added again with the same rows, by this object or another one on the same state: it then counts once, however far
    it had come.  Another batch is refused until that is done.  With a ``name`` a batch that is already in is not counted again either.
    """

    def __init__(self, spark, state: str | None = None, digest=sha256_of):
        self.spark, self.digest = spark, digest
        self.root = state or fresh_path(spark, "exact")

    def _log(self) -> dict[int, dict]:
        """What the state folder says of each batch: its rows' sum, its name, and whether the stream has taken it in."""
        out: dict[int, dict] = {}
        if exists(self.spark, f"{self.root}/log"):
            for r in self.spark.read.schema(LOG).json(f"{self.root}/log/*").collect():  # two short rows a batch
                out[r.batch] = out.get(r.batch, {"done": False}) | {"sum": r.sum, "name": r.name, "done": r.done or out.get(r.batch, {}).get("done", False)}
        return out

    def _note(self, rows_sum: str, name: str | None, done: bool) -> None:
        row = self.spark.createDataFrame([(self.batch, rows_sum, name, done)], LOG)
        row.coalesce(1).write.mode("overwrite").json(f"{self.root}/log/batch-{self.batch}-{'done' if done else 'arrived'}")

    def _arrive(self, docs: DataFrame, id_col: str, text_col: str, name: str | None) -> tuple[DataFrame, str, bool]:
        """The table of arrivals, the sum of the batch's rows, and whether the batch is in already."""
        log = self._log()
        pending = [b for b, x in log.items() if not x["done"]]
        again = next((b for b, x in log.items() if name is not None and x["name"] == name), None)
        self.batch = again if again is not None else pending[0] if pending else max(log, default=-1) + 1
        known, path = log.get(self.batch), f"{self.root}/arrivals"
        own, schema = f"{self.root}/content/batch={self.batch}", f"digest string, points int, id long, file string, pos long, col string, batch int"
        kept = located(docs)
        if not kept and known is None:
            docs.select(column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text")).write.mode("overwrite").parquet(own)
        digest, points = self.digest(normalised(text_col)), F.coalesce(F.length(column(text_col).cast("string")), F.lit(0))
        if known is not None:
            given = self._sum(docs.select(digest.alias("digest"), points.alias("points"), column(id_col).cast("long").alias("id")))
            if given != known["sum"]:
                raise ValueError(f"batch {self.batch} is in with other rows" if known["done"] else "the last batch failed and has to be added again first")
        if not kept:
            docs, id_col, text_col = self.spark.read.schema("id long, text string").parquet(own), "id", "text"
        self.source = docs, text_col
        if known is not None:
            return self.spark.read.schema(schema).parquet(path), known["sum"], known["done"]
        rows = docs.select(self.digest(normalised(text_col)).alias("digest"), F.coalesce(F.length(column(text_col).cast("string")), F.lit(0)).alias("points"), column(id_col).cast("long").alias("id"), F.col(FILE).alias("file"), F.col(POS).alias("pos"), F.lit(text_col).alias("col"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={self.batch}")  # what an attempt without a note has left was never read
        arrived = self.spark.read.schema(schema).parquet(path)
        total = self._sum(arrived.where(F.col("batch") == self.batch))
        self._note(total, name, False)
        return arrived, total, False

    @staticmethod
    def _sum(rows: DataFrame) -> str:
        return str(tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("digest", "points", "id").cast("decimal(38,0)"))).first()))

    def _newest(self) -> DataFrame | None:
        """``digest, n`` and what stays of each digest so far."""
        if not exists(self.spark, f"{self.root}/state-out"):
            return None
        changed = self.spark.read.schema(CHANGED).parquet(f"{self.root}/state-out/e=*")
        newest = changed if len(listed(self.spark, f"{self.root}/state-out")) == 1 else changed.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "epoch").alias("s")).select("digest", "s.best", "s.n")
        keep = {"keep_id": F.bitwise_not("best.last"), "keep_batch": F.bitwise_not("best.b"), "keep_pos": F.bitwise_not("best.p"), "keep_file": F.col("best.file"), "keep_col": F.col("best.col")}
        return newest.select("digest", "n", *[c.alias(name) for name, c in keep.items()])

    def _before(self, mine: DataFrame) -> DataFrame | None:
        """What was known of the batch's digests before it came; written once, so that another try finds the same."""
        newest, path = self._newest(), f"{self.root}/before/batch={self.batch}"
        if newest is None:
            return None
        if not exists(self.spark, f"{path}/_SUCCESS"):
            newest.join(mine.select("digest").distinct(), "digest", "left_semi").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(newest.schema).parquet(path)

    def _consume(self, schema) -> None:
        """Run the stream over what has arrived since the last call."""
        conf, old = self.spark.conf, {}
        for k, v in STATE.items():
            old[k] = conf.get(k, None)
            conf.set(k, v)
        try:
            best = F.max(F.struct("points", F.bitwise_not("id").alias("last"), F.bitwise_not("batch").alias("b"), F.bitwise_not("pos").alias("p"), "file", "col"))
            state = self.spark.readStream.schema(schema).parquet(f"{self.root}/arrivals").groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
            out = f"{self.root}/state-out"

            def put(changed: DataFrame, epoch: int) -> None:
                changed.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/e={epoch}")

            state.writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
        finally:
            for k, v in old.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def _compact(self) -> None:
        """From time to time what the stream has put out is made one row per digest, so that a later batch doesn't read every change there was."""
        if self.batch and self.batch % COMPACT == 0:
            out = f"{self.root}/state-out"
            epochs = sorted(int(e) for e in listed(self.spark, out) for e in [e.removeprefix("e=")] if e.lstrip("-").isdigit())
            changed = self.spark.read.schema(CHANGED).parquet(*[f"{out}/e={e}" for e in epochs])
            if epochs[-1] < 0:
                return
            newest = changed.groupBy("digest").agg(F.max_by(F.struct("best", "n", "epoch"), "epoch").alias("s")).select("digest", "s.best", "s.n", "s.epoch")
            newest.write.mode("overwrite").parquet(f"{out}/e={-1 - epochs[-1]}")  # not found by the stream, which overwrites its own epoch only
            for e in epochs:
                removed(self.spark, f"{out}/e={e}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None) -> DataFrame:
        return self.add_located(docs, id_col, text_col, name).select("id", "keep_id", "group_size", "kept", "digest")

    def add_located(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str | None = None) -> DataFrame:
        """As ``add``, with the locators ``file, pos`` of the rows."""
        arrived, total, done = self._arrive(docs, id_col, text_col, name)
        mine = arrived.where(F.col("batch") == self.batch)
        before = self._before(mine)
        if not done:
            self._consume(arrived.schema)
            self._note(total, name, True)
            self._compact()
        groups = self._newest()
        if groups is None:  # nothing has ever arrived
            groups = mine.select("digest", F.lit(0).alias("n"), F.col("id").alias("keep_id"), F.col("batch").alias("keep_batch"), F.col("pos").alias("keep_pos"), F.col("file").alias("keep_file"), F.col("col").alias("keep_col"))
        differing = self._differing(mine, groups, before)
        own = mine.drop("col", "points")
        if differing is not None:
            own = own.join(differing, "digest", "left_anti")
        kept = (F.col("pos") == F.col("keep_pos")) & (F.col("file") == F.col("keep_file")) & (F.col("batch") == F.col("keep_batch"))
        rows = join_hot(own, groups.drop("keep_col"), "digest", "n").select("id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "digest", "file", "pos")
        if differing is not None:
            rows = rows.unionByName(self._apart(arrived, differing))
        return rows

    def _content(self, places: DataFrame) -> DataFrame:
        """``places`` (``file, pos, col`` and more) with the normalised text ``norm`` that stands there."""
        out = None
        files: dict[str, list[str]] = {}
        for r in places.select("file", "col").distinct().collect():  # files, not rows
            files.setdefault(r.col, []).append(unquote(r.file))
        for name, paths in files.items():
            text = self.spark.read.parquet(*paths).select(F.col(FILE).alias("file"), F.col(POS).alias("pos"), normalised(name).alias("norm"))
            found = places.where(F.col("col") == name).join(text, ["file", "pos"])
            out = found if out is None else out.unionByName(found)
        return places.withColumn("norm", F.lit("")).limit(0) if out is None else out

    def _differing(self, mine: DataFrame, groups: DataFrame, before: DataFrame | None) -> DataFrame | None:
        """Compare the full bytes of all rows of every digest that was hit again, and of the row that its locator names: digests with different texts, or None.

        The least and the greatest text of a digest are found before the shuffle, task by task.
        """
        source, text_col = self.source
        full = source.select(normalised(text_col).alias("norm")).withColumn("digest", self.digest(F.col("norm")))
        texts = likely_in(full, F.col("digest"), groups.where("n > 1"), F.col("digest"))
        known = None
        if before is not None:
            hit = before.select("digest", F.col("keep_file").alias("file"), F.col("keep_pos").alias("pos"), F.col("keep_col").alias("col"))
            texts = texts.unionByName(self._content(hit).select("norm", "digest"))
            if exists(self.spark, f"{self.root}/differing"):
                known = self.spark.read.parquet(f"{self.root}/differing").join(mine.select("digest").distinct(), "digest", "left_semi")
        other = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most")).where("least <> most").select("digest")
        if known is not None:
            other = other.union(known).distinct()
        if other.isEmpty():
            return None
        other = staged(other, "exact-differing")
        other.write.mode("append").parquet(f"{self.root}/differing")
        return other

    def _apart(self, arrived: DataFrame, differing: DataFrame) -> DataFrame:
        """The rows of digests that stand for several texts, over all batches: grouped by the whole text instead."""
        full = self._content(staged(arrived.join(differing, "digest", "left_semi"), "exact-apart"))
        best = F.max(F.struct("points", F.bitwise_not("id").alias("l"), F.bitwise_not("batch").alias("b"), F.bitwise_not("pos").alias("p"), "file"))
        groups = full.groupBy("norm").agg(best.alias("best"), F.count("*").alias("group_size"))
        kept = (F.col("pos") == F.bitwise_not("best.p")) & (F.col("file") == F.col("best.file")) & (F.col("batch") == F.bitwise_not("best.b"))
        rows = full.where(F.col("batch") == self.batch).join(groups, "norm")
        return rows.select("id", F.bitwise_not("best.l").alias("keep_id"), "group_size", kept.alias("kept"), "digest", "file", "pos")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One batch through a fresh state: ``id, keep_id, group_size, kept, digest`` for every row; see ``StreamingExactDedup``."""
    return StreamingExactDedup(docs.sparkSession).add(docs, id_col, text_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns whatever their names; of rows equal in id and text one stays."""
    if not located(docs):
        docs = staged(docs, "exact-rows")
    file, pos = unused(docs, "__kept_file"), unused(docs, "__kept_pos")
    stay = StreamingExactDedup(docs.sparkSession).add_located(docs, id_col, text_col).where("kept").select(F.col("file").alias(file), F.col("pos").alias(pos))
    return docs.join(stay, (F.col(FILE) == F.col(file)) & (F.col(POS) == F.col(pos)), "left_semi")

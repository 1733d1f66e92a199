"""Operator 4 - token counts as delta-maintained rollups.

``signed`` turns changes into signed rows: an insert adds a document and its tokens, a delete takes them away,
a revision takes the old count from its tokenizer version and adds the new one to its own.  A batch of changes
is aggregated by (source, lang, tokenizer) before it is shuffled and committed under its id: its deltas are written
under a fresh name and count once a marker with the id names them, so a batch is there whole or not at all, and an
id that is there is not applied again.  Totals are sums of deltas; ``compact`` folds committed batches into a base.

Defined results: null sources, languages and versions are groups of their own; a null count is no tokens; a
change of unknown or null kind changes nothing; totals with neither documents nor tokens are left out, and
negative ones (a delete before its insert) are shown as they are.  Other columns are ignored.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
#: The end mark of a marker.
END = " ok\n"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows (source, lang, tokenizer, n_docs, n_tokens) of changes (op, source, lang, tokenizer, n_tokens,
    old_tokenizer, old_tokens; the old ones matter for op = 'revise', a null old_tokenizer being the same one)."""
    new, old = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_tokens").cast("long"), F.lit(0))

    def row(tokenizer, n_docs: int, n_tokens):
        return F.struct(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokenizer.cast("string").alias("tokenizer"), F.lit(n_docs).cast("long").alias("n_docs"), n_tokens.alias("n_tokens"))

    version = F.col("tokenizer")
    kinds = F.when(F.col("op") == "insert", F.array(row(version, 1, new))).when(F.col("op") == "delete", F.array(row(version, -1, -new)))
    kinds = kinds.when(F.col("op") == "revise", F.array(row(version, 1, new), row(F.coalesce("old_tokenizer", "tokenizer"), -1, -old)))
    return changes.select(F.explode(kinds).alias("c")).select("c.*")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """The totals kept in one folder.

    ``data/<name>`` are tables under fresh names, which count only once a marker names them.  ``log/<batch>`` marks a
    committed batch and ``base/<number>`` a base (its totals and the ids folded into it).  A marker is one small file
    that is created exclusively and holds the table's name and an end mark; one without the end mark was left by a
    writer that died, counts as absent and may be written again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("data", "log", "base"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _read(self, marker: str) -> str | None:
        """What a marker names; None if it is not there or not whole."""
        path = self._path(f"{self.root}/{marker}")
        try:
            stream = self._fs.open(path)
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception.getClass().getName()):
                return None
            raise
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.removesuffix(END) if text.endswith(END) else None

    def _mark(self, marker: str, name: str) -> bool:
        """Create a marker; of several writers one wins.  A torn marker is replaced."""
        path = self._path(f"{self.root}/{marker}")
        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as error:
            if "AlreadyExists" not in str(error.java_exception.getClass().getName()):
                raise
            if self._read(marker) is not None:
                return False
            out = self._fs.create(path, True)
        out.write(bytearray((name + END).encode()))
        out.close()
        return True

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if not x.getPath().getName().startswith("."))

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.coalesce(1).write.parquet(f"{self.root}/data/{name}")
        return name

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _base(self) -> tuple[int, str | None]:
        """The latest whole base: its number and the name of its tables."""
        for number in sorted(map(int, self._names("base")), reverse=True):
            if name := self._read(f"base/{number:08d}"):
                return number, name
        return 0, None

    def _folded(self, base: str | None) -> DataFrame:
        """The ids in a base; they stay a table, since they are all that there ever were."""
        return self.spark.read.schema("batch string").parquet(f"{self.root}/data/{base}-ids") if base else self.spark.createDataFrame([], "batch string")

    def _state(self) -> tuple[int, str | None, dict[str, str]]:
        """One look at the folder: the base, and the committed batches that are not in it.  Markers are listed before
        the base, so a batch that is folded in between is in the base and left out here."""
        marked = {b: name for b in self._names("log") if (name := self._read(f"log/{b}"))}
        number, base = self._base()
        if base and marked:
            known = self.spark.createDataFrame([(b,) for b in marked], "batch string")
            for row in self._folded(base).join(known, "batch", "left_semi").distinct().collect():
                del marked[row.batch]
        return number, base, marked

    def committed(self) -> set[str]:
        _, base, marked = self._state()
        return {r.batch for r in self._folded(base).collect()} | set(marked)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if its id has been committed before."""
        if not batch or "/" in batch or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        done = lambda: self._read(f"log/{batch}") is not None or not self._folded(self._base()[1]).where(F.col("batch") == batch).isEmpty()
        if done():
            return False
        name = self._write(_sums(signed(changes)))
        if not done() and self._mark(f"log/{batch}", name):
            return True
        self._drop(f"data/{name}")
        return False

    def _sum(self, base: str | None, marked: dict[str, str]) -> DataFrame:
        parts = [f"{self.root}/data/{n}" for n in marked.values()] + ([f"{self.root}/data/{base}"] if base else [])
        rows = self.spark.read.schema(TOTALS).parquet(*parts) if parts else self.spark.createDataFrame([], TOTALS)
        return _sums(rows).where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        _, base, marked = self._state()
        return self._sum(base, marked)

    def compact(self) -> None:
        """Fold the committed batches into a new base.  Totals and ids come from one look at the folder, are written
        under a fresh name and count from the moment of their marker.  What the base before the last was made of is
        removed, so that readers who looked before this still find their tables."""
        number, base, marked = self._state()
        if not marked:
            return
        name = self._write(self._sum(base, marked))
        ids = self._folded(base).union(self.spark.createDataFrame([(b,) for b in sorted(marked)], "batch string"))
        ids.write.parquet(f"{self.root}/data/{name}-ids")
        if not self._mark(f"base/{number + 1:08d}", name):  # someone else's base came first
            self._drop(f"data/{name}")
            self._drop(f"data/{name}-ids")
            return
        if base:
            old = self._read(f"base/{number - 1:08d}") if number > 1 else None
            before = self._folded(base).join(self.spark.createDataFrame([(b,) for b in self._names("log")], "batch string"), "batch", "left_semi")
            for row in before.distinct().collect():
                self._drop(f"data/{self._read(f'log/{row.batch}')}")
                self._drop(f"log/{row.batch}")
            if old:
                self._drop(f"data/{old}")
                self._drop(f"data/{old}-ids")
                self._drop(f"base/{number - 1:08d}")

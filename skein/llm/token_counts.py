"""Token counts kept up to date by signed changes.

Totals by source, language and tokenizer version are sums of batch deltas: an insert adds a document
and its tokens, a delete takes both away, a revision adds the difference. Each batch writes one small
table, and then a numbered state that names all tables and batches which count: the file of the next
number is created without overwriting, which one writer can do, and the other starts from what the first
one wrote. So committing a batch again, or after a crash half way, changes nothing. compact() folds tables
into one without losing their batches; old tables go after the state that no longer names them stands.

Defined results: a null text has no tokens; null is a source (or language) of its own; rows alike count
once each; an empty batch commits and adds nothing; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import importlib
import json
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, table

#: Folder of the vocabulary files, and the two tokenizer versions that the query counts with.
TOKENIZERS = "/opt/tokenizers"
WORDS, PIECES = "words-1", "byte_bpe_50k"
KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
BATCHES = 4


@functools.cache
def encoder(folder: str = TOKENIZERS, name: str = PIECES):
    """The byte-level BPE of a vocabulary file; once per worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sys.path.append(folder.rsplit("/", 1)[0]) if "public_tokenizers" not in sys.modules else None
    pattern = importlib.import_module("public_tokenizers").PATTERN
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): a row for each document and tokenizer version; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            for version, n in ((WORDS, [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]), (PIECES, [len(enc.encode_ordinary(t)) for t in texts])):
                yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "lang": b["lang"], "tokenizer": version, "n_tokens": n})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(counts: DataFrame, old: str = "old_tokens") -> DataFrame:
    """counts with the number that was counted before in `old`."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("n_tokens") - F.col(old)).cast("long").alias("n_tokens"))


class Rollup:
    """Batch deltas in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, dict[str, list[str]]]:
        """(number, batches of each table) of the last state that is whole; the number is that of the last file."""
        where = self._path(f"{self.folder}/states")
        files = sorted((s.getPath() for s in self._fs.listStatus(where)), key=lambda p: p.getName(), reverse=True) if self._fs.exists(where) else []
        for file in files:
            lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
            stream = self._fs.open(file)
            try:
                told = lines.toString(stream, "UTF-8")
            finally:
                stream.close()
            if told.endswith("\n"):  # a writer that died half way leaves none
                return int(files[0].getName()), json.loads(told)
        return int(files[0].getName()) if files else 0, {}

    def _write(self, number: int, state: dict[str, list[str]]) -> bool:
        """Whether this call made the state of that number."""
        try:
            out = self._fs.create(self._path(f"{self.folder}/states/{number:012d}"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()
        return True

    def _change(self, table_name: str, change: Callable[[dict[str, list[str]]], dict[str, list[str]] | None]) -> bool:
        """Goes on to what `change` makes of the last state, until a state names the table; False if it makes nothing."""
        while True:
            number, state = self._state()
            new = change(state)
            if new is None:
                return False
            # a writer that took this one for dead has gone on without it: read again
            if self._write(number + 1, new) and table_name in self._state()[1]:
                return True

    def batches(self) -> set[str]:
        """Names of the batches that count, folded ones included."""
        return {b for names in self._state()[1].values() for b in names}

    def _table(self, delta: DataFrame) -> str:
        name = uuid.uuid4().hex
        delta.write.parquet(f"{self.folder}/tables/{name}")
        return name

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/tables/{name}"), True)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes; False, and no change, if that name was committed before. Names are letters, digits, - and _."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        name = self._table(changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
        won = self._change(name, lambda state: None if any(batch in x for x in state.values()) else state | {name: [batch]})
        if not won:
            self._drop(name)
        return won

    def totals(self) -> DataFrame:
        """One row per key that has documents or tokens left."""
        return self._sum(list(self._state()[1]))

    def _sum(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/tables/{n}" for n in names])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """Folds the tables that count into one that carries their batches; False if another writer folded them meanwhile."""
        old = self._state()[1]
        if len(old) < 2:
            return False
        name = self._table(self._sum(list(old)))
        carried = sorted(b for x in old.values() for b in x)
        won = self._change(name, lambda state: None if not old.keys() <= state.keys() else {k: v for k, v in state.items() if k not in old} | {name: carried})
        for n in old if won else [name]:
            self._drop(n)
        return won


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, inserted in BATCHES batches, one of which is committed twice, as after a lost reply.

    Batch 1 arrives with provisional counts, which a revision brings right; batch 2 arrives with the rows of
    batch 3 under a source that is not theirs, which a delete takes away. The batches are folded before the
    last load and after it, and what was folded commits no second time.
    """
    scratch = Scratch(spark, "tokens")
    counts = scratch.keep(counted(table(spark, sf_dir, "documents")), "counts")
    rollup = Rollup(spark, scratch.path("rollup"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
    batch = [counts.where(part == b) for b in range(BATCHES)]
    rough = batch[1].withColumns({"final": F.col("n_tokens"), "n_tokens": F.col("n_tokens") * 2 + 1})
    misfiled = batch[3].withColumn("source", F.concat(F.lit("misfiled "), F.coalesce("source", F.lit(""))))
    loads = {"load-0": inserts(batch[0]), "load-1": inserts(rough), "load-2": inserts(batch[2].union(misfiled))}
    fixes = {
        "revised-1": revisions(rough.withColumns({"old_tokens": F.col("n_tokens"), "n_tokens": F.col("final")})),
        "deleted-2": deletes(misfiled),
    }
    for name, changes in [*loads.items(), ("load-0", loads["load-0"]), *fixes.items()]:
        rollup.commit(name, changes)
    rollup.compact()
    for name, changes in [("load-3", inserts(batch[3])), ("deleted-2", fixes["deleted-2"])]:
        rollup.commit(name, changes)
    rollup.compact()
    return rollup.totals()


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of op10 in words, which SQL can count too."""
    return op10_token_counts(spark, sf_dir).where(F.col("tokenizer") == WORDS)


ORACLE = r"""
select source, lang, 'words-1' as tokenizer, count(*) as n_docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::bigint as n_tokens
from documents group by source, lang
"""

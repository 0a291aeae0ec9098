"""Replies that are asked for once: ordered concurrent calls, and a ledger of what was answered.

A ledger is a folder.  What a call is told is appended to a journal as the call returns and before the next is waited for;
the journal of ``BUNDLE_CALLS`` calls becomes one Parquet file when all have returned, so files stay few.  A task hands its
replies on itself, and no job reads back what it has written.  Prompts are dealt and sorted by their hash and cut into calls
from there, so a task that is run again cuts the same calls, finds their replies and pays for nothing twice.  A later job
with the same ledger asks only for prompts that no file answers.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from json.encoder import encode_basestring_ascii

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabfold.operators.joins import join_popular, popular
from tabfold.workspace import file_store, new_folder, stage

Complete = Callable[[list[str]], list[str]]

LEDGER_TYPE = "prompt_hash string, reply string, error string"
BATCH_ROWS = 64
#: Calls of one task that are open at a time.
CONCURRENCY = 4
#: Calls of a journal.
BUNDLE_CALLS = 256
CALLS, BUNDLE = ".json", ".parquet"
#: What a row without a prompt gets.
NO_PROMPT = "no prompt"

_KINDS = pa.schema([("prompt_hash", pa.string()), ("reply", pa.string()), ("error", pa.string())])


def _table(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * len(_KINDS)
    return pa.table([pa.array(column, pa.string()) for column in columns], schema=_KINDS)


def _line(rows: list[tuple]) -> bytes:
    """A call's rows as one line of JSON; objects put together by hand take a third of the encoder's time."""
    quoted = [["null" if value is None else encode_basestring_ascii(value) for value in row] for row in rows]
    fields = ",".join(f"{encode_basestring_ascii(name)}:%s" for name in _KINDS.names)
    return b"[%s]\n" % ",".join([f"{{{fields}}}" % tuple(row) for row in quoted]).encode()


def ask(complete: Complete, asked: list[str]) -> list[tuple[str | None, str | None]]:
    """Reply or error of each prompt; a failing call is halved down to the prompts that fail alone."""
    try:
        replies = list(complete(asked))
        if len(replies) != len(asked):
            raise ValueError("one reply per prompt expected")
        return [(reply, None) for reply in replies]
    except Exception as e:  # the user's function may fail in any way
        if len(asked) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(asked) // 2
        return ask(complete, asked[:half]) + ask(complete, asked[half:])


class _Journal:
    """What the calls of one bundle were told, by this attempt at the task and by others of the run.

    A folder named by the run and the bundle's prompts; each attempt has a file of its own there, which grows call by call,
    or one file a call where a store cannot show an open file.
    """

    def __init__(self, folder: str, name: str):
        self.store, path = file_store(folder)
        self.path, self.bundle = f"{path}/{name}", f"{path}/{name}{BUNDLE}"
        self.own, self.stream, self.lock = set(), None, threading.Lock()
        self.known, self.read = {}, {}

    def finished(self) -> list[tuple] | None:
        """The rows of the bundle once all calls have returned."""
        if self.store.get_file_info(self.bundle).type != fs.FileType.File:
            return None
        with self.store.open_input_file(self.bundle) as file:
            rows = pq.read_table(file)
        return list(zip(*(rows[field].to_pylist() for field in _KINDS.names)))

    def told(self, hashes: list[str]) -> list[tuple] | None:
        """The rows of a call that another attempt has made."""
        with self.lock:
            for info in self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True)):
                if info.path in self.own or info.size == self.read.get(info.path, 0):
                    continue
                self.read[info.path] = info.size
                with self.store.open_input_stream(info.path) as file:
                    whole = file.read().rpartition(b"\n")[0]  # an attempt may have died within a line
                for call in map(json.loads, whole.splitlines()):
                    self.known.update((row["prompt_hash"], tuple(row[field] for field in _KINDS.names)) for row in call)
        return [self.known[h] for h in hashes] if all(h in self.known for h in hashes) else None

    def note(self, rows: list[tuple]) -> None:
        line = _line(rows)
        with self.lock:
            if self.stream is None:
                if not self.own:
                    self.store.create_dir(self.path)
                name = f"{self.path}/{uuid.uuid4().hex}{CALLS}"
                self.own.add(name)
                self.stream = self.store.open_output_stream(name)
            self.stream.write(line)
            self.stream.flush()
            if self.store.type_name not in ("local", "hdfs"):
                self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None

    def finish(self, rows: list[tuple]) -> None:
        """One file takes the place of the journal."""
        # readers overlook a name with an underscore, so no half-written file counts
        draft = f"{self.path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
        pq.write_table(_table(rows), draft, filesystem=self.store)
        self.store.move(draft, self.bundle)
        try:
            self.store.delete_dir(self.path)
        except FileNotFoundError:  # another attempt at the task was faster, or made all calls
            pass


def _call(complete: Complete, hashes: list[str], asked: list[str], journal: _Journal) -> tuple[int, list[tuple]]:
    """Prompts paid for and replies of one call, which is not made if this run has made it."""
    rows = journal.told(hashes)
    if rows is not None:
        return 0, rows
    rows = [(h, *found) for h, found in zip(hashes, ask(complete, asked))]
    journal.note(rows)
    return len(asked), rows


def _task(complete: Complete, folder: str, batch_rows: int, concurrency: int, run: str, replies: bool = False):
    """Calls over a partition sorted by hash, at most ``concurrency`` open at a time, waited for in order.

    Gives the number of prompts paid for, or with ``replies`` what each was told.  Equal neighbours are asked for once.
    """

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
        hashes, asked, last = [], [], None
        for batch in batches:
            for h, p in zip(batch.column("prompt_hash").to_pylist(), batch.column("prompt").to_pylist()):
                if h == last:
                    continue
                last = h
                hashes.append(h)
                asked.append(p)
                if len(asked) == batch_rows:
                    yield hashes, asked
                    hashes, asked = [], []
        if asked:
            yield hashes, asked

    def bundled(bundle: list[tuple[list[str], list[str]]], pool: ThreadPoolExecutor) -> tuple[int, list[tuple]]:
        """A bundle's calls; when all have returned, one file takes the place of theirs."""
        name = hashlib.sha256(",".join([run, *(h for hashes, _ in bundle for h in hashes)]).encode()).hexdigest()
        journal = _Journal(folder, name)
        rows = journal.finished()
        if rows is not None:
            return 0, rows
        open_calls, done = deque(), []
        try:
            for hashes, asked in bundle:
                if len(open_calls) == concurrency:
                    done.append(open_calls.popleft().result())
                open_calls.append(pool.submit(_call, complete, hashes, asked, journal))
            done += [call.result() for call in open_calls]
        finally:
            journal.close()
        rows = [row for _, part in done for row in part]
        journal.finish(rows)
        return sum(n for n, _ in done), rows

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paid = 0
        with ThreadPoolExecutor(concurrency) as pool:
            cut = calls(batches)
            while bundle := list(islice(cut, BUNDLE_CALLS)):
                n, rows = bundled(bundle, pool)
                paid += n
                if replies:
                    yield from _table(rows).to_batches()
        if not replies:
            yield pa.RecordBatch.from_arrays([pa.array([paid], pa.int64())], ["paid"])

    return task


def scan_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """``prompt_hash, reply, error`` of every prompt in the ledger; a reply counts before an error."""
    store, path = file_store(folder)
    store.create_dir(path)
    # a task of a broken-off job may still finish a bundle; what it takes away meanwhile is asked for again
    files = spark.read.schema(LEDGER_TYPE).option("ignoreMissingFiles", True).option("recursiveFileLookup", True)
    rows = files.option("pathGlobFilter", f"*{BUNDLE}").parquet(folder)
    files = spark.read.schema(LEDGER_TYPE).option("ignoreMissingFiles", True).option("recursiveFileLookup", True)
    rows = rows.unionByName(files.option("pathGlobFilter", f"*{CALLS}").option("mode", "DROPMALFORMED").json(folder))
    rows = rows.where("prompt_hash IS NOT NULL AND (reply IS NOT NULL OR error IS NOT NULL)")
    best = F.max_by(F.struct("reply", "error"), F.struct(F.col("reply").isNotNull(), "reply", "error")).alias("best")
    return rows.groupBy("prompt_hash").agg(best).select("prompt_hash", "best.*")


def ask_once(
    df: DataFrame,
    complete: Complete,
    *,
    prompt: str = "prompt",
    batch_rows: int = BATCH_ROWS,
    concurrency: int = CONCURRENCY,
    parallelism: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Add ``reply`` and ``error``, one of them null, asking for each distinct prompt once.

    ``complete`` must bear calls from ``concurrency`` threads of a task.  ``parallelism`` is the number of tasks, by default
    the session's shuffle partitions.  ``ledger`` is a folder to keep; errors in it are asked for again by a later job.
    A row without a prompt has the error ``NO_PROMPT``.
    """
    spark = df.sparkSession
    folder = ledger or new_folder(spark, "ledger")
    tasks = parallelism or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = stage(df.withColumn("_hash", F.sha2(F.col(prompt).cast("binary"), 256)), "prompts")
    counts = named.where("_hash IS NOT NULL").groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows"))
    hot = stage(counts.where(popular(F.col("_rows"), named.count())).select("_hash", F.lit(True).alias("_hot")), "hot")
    texts = named.where("_hash IS NOT NULL").select("_hash", F.col(prompt).alias("prompt"))
    any_hot = not hot.isEmpty()
    if any_hot:
        # equal prompts meet in one task, except popular ones, of which one each travels
        few = texts.join(F.broadcast(hot.select("_hash")), "_hash", "left_semi").distinct()
        texts = texts.join(F.broadcast(hot.select("_hash")), "_hash", "left_anti").unionByName(few)
    asked = texts.withColumnRenamed("_hash", "prompt_hash")
    answered = None
    if ledger is not None:
        # written first: a task that is run again must cut the same calls though the ledger has grown
        answered = stage(scan_ledger(spark, folder).where("reply IS NOT NULL"), "answered")
        asked = asked.join(answered.select("prompt_hash"), "prompt_hash", "left_anti")
    else:
        store, path = file_store(folder)
        store.create_dir(path)
    dealt = asked.repartition(tasks, "prompt_hash").sortWithinPartitions("prompt_hash")
    work = _task(complete, folder, batch_rows, concurrency, uuid.uuid4().hex, replies=True)
    told = stage(dealt.mapInArrow(work, LEDGER_TYPE), "replies")
    if answered is not None:
        told = told.unionByName(answered)
    told = told.withColumnRenamed("prompt_hash", "_hash")
    if any_hot:
        met = join_popular(named, told.join(F.broadcast(hot), "_hash", "left"), ["_hash"], F.col("_hot"))
    else:
        met = named.join(told, "_hash")
    met = met.select(*df.columns, "reply", "error")
    nothing = F.lit(None).cast(T.StringType())
    without = named.where("_hash IS NULL").select(*df.columns, nothing.alias("reply"), F.lit(NO_PROMPT).alias("error"))
    return met.unionByName(without)

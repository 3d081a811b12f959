"""A crawl that goes on until it is done, and a crawl state kept from a stream of fetch results.

A state is a table of pages that is never rewritten; what fetches change is added beside it,
a row for each page and round, and the latest row of a page counts.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folioscope.operators.crawl import COLUMNS, STATE, queue, transition
from folioscope.operators.stats import first_of
from folioscope.sources.http import FETCHED
from folioscope.sources.store import manifest, read_store, upsert
from folioscope.storage import saved, work_dir


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Fetch results as they are added to a folder as Parquet files."""
    return spark.readStream.schema(FETCHED).parquet(path)


def latest(state: DataFrame, changes: DataFrame | None) -> DataFrame:
    """``state`` with the last of ``changes`` (its columns and round) of each page in place of its row."""
    if changes is None:
        return state.select(COLUMNS)
    last = first_of(changes, ["url"], [F.col("round").desc()]).select(COLUMNS)
    return state.select(COLUMNS).join(last.select("url"), "url", "left_anti").unionByName(last)


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The state under ``path``: state is the table it began with, changes what came since, up to round ``before`` if given."""
    state = spark.read.schema(STATE).parquet(f"{path}/state")
    try:
        changes = spark.read.schema(f"{STATE}, round long").parquet(f"{path}/changes")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return state
    return latest(state, changes if before is None else changes.where(F.col("round") < before))


def keep_state(fetches: DataFrame, path: str, checkpoint: str, now: int, interval: int) -> DataStreamWriter:
    """Adds what each batch of ``fetches`` changes to the state under ``path``.

    Only the pages of a batch are written. A batch that runs again reads the state before it and writes the same rows
    in place of its first ones. The writer is returned for the caller to start.
    """

    def apply(batch: DataFrame, number: int) -> None:
        one = saved(first_of(batch, ["url"], [F.col("status"), F.col("html"), F.col("error")]), "fetches")
        own = read_state(batch.sparkSession, path, number).join(one.select("url"), "url", "left_semi")
        transition(own, one, now, interval).write.mode("overwrite").parquet(f"{path}/changes/round={number}")

    return fetches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def crawl_round(state: DataFrame, fetch, now: int, interval: int, limit: int) -> DataFrame:
    """The state after one round: the due pages through ``fetch`` (state rows to fetch results), and back."""
    return transition(state, fetch(queue(state, now, limit)), now, interval)


def crawl(state: DataFrame, fetch, interval: int, max_documents: int | None = None, a_round: int = 10_000, clock: Callable[[], int] = lambda: int(time.time())) -> DataFrame:
    """The state after rounds of ``a_round`` pages, until no page is due or ``max_documents`` were fetched.

    ``fetch`` makes fetch results of state rows. A round writes the rows of its pages alone, so a crawl that stops is taken up from the
    state and them. Pages that fall due again while the crawl runs are fetched again.
    """
    spark = state.sparkSession
    folder, changes, done, number = f"{work_dir(spark)}/crawl-{uuid.uuid4().hex}", None, 0, 0
    while max_documents is None or done < max_documents:
        now = clock()
        limit = a_round if max_documents is None else min(a_round, max_documents - done)
        asked = saved(queue(latest(state, changes), now, limit).select(COLUMNS), "queue")
        n = asked.count()
        if not n:
            break
        transition(asked, saved(fetch(asked), "fetched"), now, interval).write.parquet(f"{folder}/round={number}")
        changes = spark.read.schema(f"{STATE}, round long").parquet(folder)
        done, number = done + n, number + 1
    return latest(state, changes)


def crawl_store(spark: SparkSession, path: str, fetch, interval: int, max_documents: int | None = None, a_round: int = 10_000, clock: Callable[[], int] = lambda: int(time.time())) -> int:
    """``crawl`` over the document store at ``path``, each round a version of it; the number of pages fetched is returned.

    What is due is told from the columns that say so; pages are read whole for the round's URLs alone. A crawl that stops goes
    on from the last whole round.
    """
    done = 0
    while max_documents is None or done < max_documents:
        now, base = clock(), manifest(path).version
        limit = a_round if max_documents is None else min(a_round, max_documents - done)
        due = saved(queue(read_store(spark, path, base, ["url", "status", "next_crawl_at"]), now, limit), "queue")
        n = due.count()
        if not n:
            break
        asked = saved(read_store(spark, path, base).join(F.broadcast(due.select("url")) if n <= 100_000 else due.select("url"), "url", "left_semi"), "asked")
        upsert(transition(asked, saved(fetch(asked), "fetched"), now, interval), path, base=base)
        done += n
    return done

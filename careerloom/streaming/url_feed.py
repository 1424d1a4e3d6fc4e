"""School-URL decisions over a growing folder of education files.

Two streams, each with an available-now trigger and a checkpoint of its own.

The *keeper* holds, per URL, its university once it is accepted, the rows that
wait for that, and the titles already examined.  A new row of an accepted URL
is passed on at once; otherwise it waits, and its title is handed out to be
examined, once.  The acceptance of a URL releases its rows and clears its
state.  State is read and written for the URLs of a batch only, so the work of
a batch does not depend on the batches before it, and nothing waits for ever in
a table that is read again.

The *examiner* matches the titles handed out, a batch at a time, and writes the
URLs it accepts to the folder that the keeper reads as its second input.

A replayed batch of the keeper is undone by its checkpoint and the commit log
of its sink; one of the examiner overwrites its own folder, and the keeper
ignores a second acceptance.  So a restart after a lost driver or executor
leaves nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from careerloom import schemas
from careerloom.functions import fixed_values as fx
from careerloom.operators.matching import fuzzy_match, matchable
from careerloom.sources.readers import exists

ACCEPTED = "school_url string, unitid long, instnm string, batch long"
#: What the keeper passes on: a row with its university, or a title to examine.
PASSED = "school_url string, title string, payload string, unitid long, instnm string, kind string"
#: Parts that the rows of one URL are dealt over, by a hash of the row: a URL may hold a large share of all rows.
PARTS = 8
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Keeper(StatefulProcessor):
    """State of one part of one URL: the accepted university, waiting rows, titles examined."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "unitid long, instnm string")
        self.waiting = handle.getListState("waiting", "title string, payload string")
        self.examined = handle.getMapState("examined", "title string", "once boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        url = key[0]
        fresh, offers = [], []
        for part in rows:
            is_row = part["kind"] == "row"
            fresh += list(part.loc[is_row, ["title", "payload"]].itertuples(index=False, name=None))
            offers += list(part.loc[~is_row, ["batch", "unitid", "instnm"]].itertuples(index=False, name=None))
        known = self.accepted.get()
        if known is None and offers:
            _, unit, name = min(offers)
            known = (int(unit), name)
            self.accepted.update(known)
            fresh = [*self.waiting.get(), *fresh]
            self.waiting.clear()
            self.examined.clear()
        if known is not None:
            out = [(url, *row, *known, "row") for row in fresh]
        else:
            if fresh:
                self.waiting.appendList(fresh)
            out = []
            for title in dict.fromkeys(title for title, _ in fresh):
                name = ("" if title is None else "=" + title,)
                if not self.examined.containsKey(name):
                    self.examined.updateValue(name, (True,))
                    out.append((url, title, None, None, None, "open"))
        if out:
            made = pd.DataFrame(out, columns=["school_url", "title", "payload", "unitid", "instnm", "kind"])
            yield made.astype({"unitid": "Int64"})

    def close(self) -> None:
        pass


def decided_urls(spark: SparkSession, out: str) -> DataFrame:
    """URLs accepted so far; each by the first batch of the examiner that accepted it."""
    path = f"{out}/accepted"
    if not exists(spark, path):
        return spark.createDataFrame([], ACCEPTED)
    first = spark.read.schema(ACCEPTED).parquet(path).groupBy("school_url").agg(F.min(F.struct("batch", "unitid", "instnm")).alias("f"))
    return first.select("school_url", "f.unitid", "f.instnm", "f.batch")


def accepted_rows(spark: SparkSession, out: str, schema: StructType = schemas.EDUCATION) -> DataFrame:
    """Education rows with an accepted URL and its university, over all batches."""
    passed = spark.read.schema(PASSED).parquet(f"{out}/passed").where("kind = 'row'")
    row = F.from_json("payload", schema).alias("row")
    taken = {"title", "school_url", "unitid", "instnm"}
    return passed.select("title", "school_url", "unitid", "instnm", row).select(
        "title", "school_url", "unitid", "instnm", *[f"row.{f.name}" for f in schema if f.name not in taken]
    )


def _keep(
    spark: SparkSession, source: str, out: str, checkpoint: str, schema: StructType, files_per_batch: int | None, generic_suffix: str
) -> None:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = matchable(reader.parquet(source), generic_suffix)
    payload = F.to_json(F.struct(*rows.columns))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = rows.select(
        "school_url", F.pmod(F.xxhash64(payload), F.lit(PARTS)).cast("int").alias("part"), F.lit("row").alias("kind"),
        "title", payload.alias("payload"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("unitid"), none("string", "instnm"),
    )
    accepted = spark.readStream.schema(ACCEPTED).parquet(f"{out}/accepted").select(
        "school_url", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit("accepted").alias("kind"),
        none("string", "title"), none("string", "payload"), "batch", "unitid", "instnm",
    )
    passed = rows.unionByName(accepted).groupBy("school_url", "part").transformWithStateInPandas(
        statefulProcessor=Keeper(), outputStructType=PASSED, outputMode="Append", timeMode="None"
    )
    provider = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        sink = passed.writeStream.format("parquet").partitionBy("kind").option("path", f"{out}/passed")
        sink.option("checkpointLocation", f"{checkpoint}/keeper").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, provider)


def _examine(spark: SparkSession, out: str, checkpoint: str, universities: DataFrame, tags: list[str], cutoff: float) -> None:
    def examine(batch: DataFrame, batch_id: int) -> None:
        pairs = batch.select("title", "school_url").distinct()
        best = fuzzy_match(universities, pairs, tags, cutoff, per="school_url").select("school_url", "unitid", "instnm")
        best.write.mode("overwrite").parquet(f"{out}/accepted/batch={batch_id}")

    opened = spark.readStream.schema(PASSED).parquet(f"{out}/passed").where("kind = 'open'")
    query = opened.writeStream.foreachBatch(examine).option("checkpointLocation", f"{checkpoint}/examiner")
    query.trigger(availableNow=True).start().awaitTermination()


def run_url_feed(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    universities: DataFrame,
    tags: list[str],
    cutoff: float = fx.MATCH_CUTOFF,
    schema: StructType = schemas.EDUCATION,
    files_per_batch: int | None = None,
    generic_suffix: str = fx.GENERIC_SCHOOL_URL_SUFFIX,
) -> None:
    """Process every new file of ``source`` once, then return: keep, examine what was opened, and keep the answers."""
    if not exists(spark, f"{out}/accepted"):
        spark.createDataFrame([], ACCEPTED).drop("batch").write.parquet(f"{out}/accepted/batch=-1")
    _keep(spark, source, out, checkpoint, schema, files_per_batch, generic_suffix)
    _examine(spark, out, checkpoint, universities, tags, cutoff)
    _keep(spark, source, out, checkpoint, schema, files_per_batch, generic_suffix)

"""Exactly-once admission as a stream: state per client in the state store, results by ``append``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronofold.cluster import materialise, shared_dir, ship
from chronofold.functions import codec
from chronofold.operators.admission import _FOLD, DECISION_SCHEMA, EXECUTE, _recursive, decide
from chronofold.sources.changelog import deliveries

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """A client's last accepted sequence and its digest; a batch's attempts are taken in order of ``pos``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "high long, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        high, digest = self.last.get() if self.last.exists() else (0, None)
        out = []
        for pos, request, own in sorted((r.pos, r.request_seq, r.digest) for part in rows for r in part.itertuples(index=False)):
            decision = decide(high, digest, request, own)
            if decision == EXECUTE:
                high, digest = int(request), own
            out.append((pos, key[0], request, decision, high))
        if digest is not None:
            self.last.update((high, digest))
        yield pd.DataFrame(out, columns=["pos", "client", "request_seq", "decision", "high_water"])

    def close(self) -> None:
        pass


def admit(attempts: DataFrame) -> DataFrame:
    """Decisions on a stream of attempts (DELIVERY_SCHEMA), client by client."""
    ship(attempts.sparkSession)
    digest = codec.command_digest(F.col("kind"), F.col("key"), F.col("value"))
    keyed = attempts.select("client", "pos", "request_seq", digest.alias("digest")).groupBy("client")
    return keyed.transformWithStateInPandas(statefulProcessor=Admission(), outputStructType=DECISION_SCHEMA, outputMode="append", timeMode="none")


def run_to_files(spark: SparkSession, source: str, sink: str, checkpoint: str, files_at_once: int = 1) -> None:
    """Take all files that ``source`` holds now; the file sink and the checkpoint make results exactly-once over restarts."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        schema = "pos long, client long, request_seq long, kind int, key string, value string"
        attempts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
        query = admit(attempts).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _stream_admission(s, d, cuts=3):
    """Deliveries in ``cuts`` files, in order, taken in two runs with a restart between."""
    root = shared_dir(s, "stream")
    rows = materialise(deliveries(s, d), "deliveries")
    top = rows.agg(F.max("pos")).first()[0] + 1
    for i in range(cuts):
        part = rows.where((F.col("pos") >= top * i // cuts) & (F.col("pos") < top * (i + 1) // cuts))
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        if i != 1:
            run_to_files(s, f"{root}/in", f"{root}/out", f"{root}/checkpoint")
    return s.read.schema(DECISION_SCHEMA).parquet(f"{root}/out")


QUERIES = {"stream_admission": _stream_admission}
ORACLE_SQL = {"stream_admission": _recursive(_FOLD + " SELECT pos, client, request_seq, decision, high_water FROM fold")}

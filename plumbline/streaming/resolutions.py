"""Decisions on conflicts as a stream: each updates the state of its product, and only that product's feeds are issued again.

The state of a product is its merged record and, for each attribute, the decision of the largest number. Only the state is
kept by Python; records are resolved and fed by expressions, as merge.resolve_records and feeds.map_to_all do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.feeds import map_to_all
from ..operators.merge import apply_winners

#: product: any text; seq: orders events; record: a merged record as JSON, or null; attribute and winner: a decision, or null.
EVENTS = "product string, seq long, record string, attribute string, winner int"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Resolutions(StatefulProcessor):
    """Folds a product's events into its state; gives (product, seq, record, winners) where a batch has changed it and a record is known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "seq long, record string")
        self.winners = handle.getMapState("winners", "attribute string", "seq long, winner int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.record.get() if self.record.exists() else None
        latest, changed, last = {}, False, -1
        for row in rows:  # in any order; what is kept is one row an attribute
            last = max(last, row.seq)
            if row.record is not None and (held is None or row.seq >= held[0]):
                held, changed = (row.seq, row.record), True
            if row.attribute is not None and (row.attribute not in latest or row.seq >= latest[row.attribute][0]):
                latest[row.attribute] = (row.seq, row.winner)
        for attribute, decision in latest.items():
            before = self.winners.getValue((attribute,)) if self.winners.containsKey((attribute,)) else None
            if before is None or decision[0] >= before[0]:
                self.winners.updateValue((attribute,), decision)
                changed = changed or before is None or before[1] != decision[1]
        if held is not None:
            self.record.update(tuple(held))
        if changed and held is not None:
            winners = {k[0]: v[1] for k, v in self.winners.iterator() if v[1] is not None}
            yield Row(product=key[0], seq=last, record=held[1], winners=winners)

    def close(self) -> None:
        pass


def changed(events: DataFrame) -> DataFrame:
    """(product, seq, record, winners) of the products that a batch of events (EVENTS) changes."""
    return events.groupBy("product").transformWithState(Resolutions(), "product string, seq long, record string, winners map<string, int>", "Update", "None")


def reissued(rows: DataFrame, record: StructType) -> DataFrame:
    """The feeds of changed products: (product, seq, the record's fields as resolved, three feeds and their issues).

    record: the schema of merge.merge_records. A decision on an attribute without a conflict, or of a specification that is
    not there, changes nothing; one with a null winner takes an earlier decision back.
    """
    fields = StructType([f for f in record.fields if f.name != "product"])
    parsed = rows.select("product", "seq", F.from_json("record", fields).alias("r"), "winners")
    return map_to_all(apply_winners(parsed.select("product", "seq", "r.*", "winners")).drop("winners"))


def follow(events: DataFrame, record: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Runs a stream of events; each batch's reissued feeds reach `handle` with the batch's number.

    After a restart on the same checkpoint the state is as the last whole batch left it, and a batch that was not finished comes again
    under its number.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    # the batch's changes are worked out once, though a handler may use them more often
    writer = changed(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda rows, k: handle(reissued(rows, record), k))
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged_as_events(merged: DataFrame, seq: int = 0) -> DataFrame:
    """Events of merged records, all of one number."""
    return merged.select(F.col("product").cast("string").alias("product"), F.lit(seq).cast("long").alias("seq"), F.to_json(F.struct(*(c for c in merged.columns if c != "product")), {"ignoreNullFields": "false"}).alias("record"), F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("int").alias("winner"))

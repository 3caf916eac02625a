"""Change feed over a stream of batch rows, late rows included."""

from __future__ import annotations

import bisect
import itertools
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rolescope.session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# A shelf of more events than this is cut, between blocks, into shelves of half as many.
SHELF_EVENTS = 128

_EVENT = "struct<block:string,place:string,sign:string,told:boolean,row:string>"


def shelved(events: list[list], most: int) -> list[list[list]]:
    """The events of a shelf, in order, as the shelves they are kept in: a block is never cut."""
    if len(events) <= most:
        return [events]
    parts: list[list[list]] = [[]]
    for _, block in itertools.groupby(events, key=lambda event: event[0]):
        held = list(block)
        if parts[-1] and len(parts[-1]) + len(held) > most // 2:
            parts.append([])
        parts[-1].extend(held)
    return parts


class Changes(StatefulProcessor):
    """The events of one key, on shelves of neighbouring blocks; a micro-batch reads and writes only the shelves that its
    events fall into, and the neighbouring shelf where an event lies at a shelf's edge.

    A call to the state costs far more than an event in it, so a key of few events has one shelf. An event is held as its
    block, a sortable place and its signature; its JSON text is kept until it is told. Shelves bear the name of their
    first block, the first one of a key has none, and they are listed in one small value per key.
    """

    def __init__(self, plain: bool):
        #: Signatures are equal only as texts; else (fractions, nested values) their parsed values count.
        self.plain = plain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shelves = handle.getValueState("shelves", "shelves array<string>")
        self.events = handle.getMapState("shelved", "shelf string", f"events array<{_EVENT}>")

    def _held(self, shelf: str) -> list[list]:
        return [list(event) for event in self.events.getValue((shelf,))[0]]

    def _differ(self, one: str, other: str) -> bool:
        return one != other and (self.plain or json.loads(one) != json.loads(other))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        stored = self.shelves.get()
        seen = stored is not None
        listed = list(stored[0]) if seen else [""]
        fresh: dict[str, list[list]] = {}
        arrived: set[str] = set()
        for part in rows:
            for block, place, sign, row in zip(part["block"], part["place"], part["sign"], part["row"], strict=True):
                shelf = listed[bisect.bisect_right(listed, block) - 1]
                fresh.setdefault(shelf, []).append([block, place, sign, None, row])
                arrived.add(place)
        # Per shelf the stored and the new events; new ones are not marked yet as told or not.
        merged = {shelf: sorted((self._held(shelf) if seen else []) + events, key=lambda event: event[:2])
                  for shelf, events in fresh.items()}
        out: list[tuple[str, str]] = []

        def edge(shelf: str, step: int) -> tuple[str, list] | None:
            """The nearest event on the shelf before or after, and its shelf."""
            at = bisect.bisect_left(listed, shelf) + step
            if not 0 <= at < len(listed):
                return None
            if listed[at] not in merged:
                merged[listed[at]] = self._held(listed[at])
            return listed[at], merged[listed[at]][-1 if step < 0 else 0]

        def tell(event: list, before: list | None) -> None:
            event[3] = before is None or self._differ(before[2], event[2])
            if event[3]:
                out.append((event[4], "update" if seen or before is not None else "snapshot"))
                event[4] = None

        changed = set(fresh)
        for shelf in sorted(fresh):
            earlier = edge(shelf, -1)
            before = earlier[1] if earlier else None
            for event in merged[shelf]:
                # a stored event is told late only where a new one has come before it
                if event[3] is None or (not event[3] and before is not None and before[1] in arrived):
                    tell(event, before)
                before = event
            later = edge(shelf, 1)
            if later and later[0] not in fresh and not later[1][3] and before[1] in arrived:
                tell(later[1], before)
                changed.add(later[0])
        added = []
        for shelf in changed:
            for number, part in enumerate(shelved(merged[shelf], SHELF_EVENTS)):
                name = part[0][0] if number else shelf
                self.events.updateValue((name,), ([tuple(event) for event in part],))
                if number:
                    added.append(name)
        if added or not seen:
            self.shelves.update((sorted(listed + added),))
        if out:
            yield pd.DataFrame(out, columns=["row", "kind"], dtype=object)


def _plain(kind: T.DataType) -> bool:
    """Equal values of that type have equal JSON texts."""
    return isinstance(kind, T.AtomicType) and not isinstance(kind, (T.FloatType, T.DoubleType))


def stream_changes(events: DataFrame, key: str, order: Sequence[str], signature: Sequence[str], block: Column,
                   feed: str, checkpoint: str) -> StreamingQuery:
    """Write to ``feed`` every event that differs from the key's event before it, in ``order``, as ``kind`` says.

    A key's first event is its snapshot, once; all others are updates. A late event takes its place among
    the stored ones: it is told if it differs from the one before it, and the one after it is told if only
    now it differs. What was told stays. So the feed holds every event that differs from its predecessor
    after any micro-batch.

    State is kept per key in blocks, so ``block`` must be a text that grows with ``order``; a micro-batch
    touches only shelves of some ``SHELF_EVENTS`` events, in whole blocks, that its events fall into or border on.
    A checkpoint of the layout before shelves, one entry per block, cannot be resumed. The columns of ``order`` are cast to text
    that sorts alike: whole numbers and times are padded. Repeated rows are equal neighbours and told once.
    """
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [field.name for field in events.schema.fields]
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.coalesce(block.cast("string"), F.lit("")).alias("block"),
        F.concat_ws("|", *[sortable(events, name) for name in order]).alias("place"),
        (F.to_json(F.struct(*signature)) if signature else F.lit("")).alias("sign"),
        F.to_json(F.struct(*names)).alias("row"))
    plain = all(_plain(events.schema[name].dataType) for name in signature)
    told = rows.groupBy("key").transformWithStateInPandas(
        Changes(plain), "row string, kind string", outputMode="Append", timeMode="None")
    out = told.select(F.from_json("row", events.schema).alias("_row"), "kind").select("_row.*", "kind")
    return out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(feed)


def sortable(rows: DataFrame, name: str) -> Column:
    """A column as text that sorts like it, nulls first."""
    kind, value = rows.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.IntegralType):
        # shifted past the least long, so that all are positive
        text = F.lpad((value.cast("decimal(38,0)") + F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("string"), 20, "0")
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.lit("+"), text), F.lit("!"))

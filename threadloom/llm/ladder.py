"""A change feed of leaderboards: a stream of amounts, each board's ten best items by revenue, and a row per change of rank."""

from __future__ import annotations

import contextlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from threadloom.llm.shared import shared_dir, shared_table

#: Arrow batches whose amounts are summed before they leave a task.
SUMMED = 16
DELTA = "board int, item_id long, arrival_day long, batch int, revenue double, listed boolean"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: each would set aside 4 MB for its manifest
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # all stores of an executor together
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # each batch is a query of its own, whose stores no later one uses: else they would stay open until the next maintenance
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def band_of(revenue: float) -> int:
    """Two bands an octave; 0 for what can't be on a board."""
    return 1 + math.floor(2 * math.log2(revenue)) if revenue >= 1 else 1 if revenue > 0 else 0


class Ladder:
    """Items in revenue bands, beside every item's revenue."""

    def __init__(self, size: int):
        self.size = size
        self.bands: dict[int, set[int]] = {}
        self.revenue: dict[int, float] = {}
        self.changed: set[int] = set()

    def load(self, band: int, items: bytes, revenues: bytes) -> None:
        ids = np.frombuffer(items, np.int64).tolist()
        self.bands[band] = set(ids)
        self.revenue.update(zip(ids, np.frombuffer(revenues, np.float64).tolist(), strict=True))

    def stored(self, band: int) -> tuple[bytes, bytes]:
        ids = sorted(self.bands[band])
        return np.array(ids, np.int64).tobytes(), np.array([self.revenue[i] for i in ids], np.float64).tobytes()

    def add(self, item: int, amount: float) -> None:
        old = self.revenue.get(item)
        new = (old or 0.0) + amount
        self.revenue[item] = new
        a, b = None if old is None else band_of(old), band_of(new)
        if a != b:
            if a is not None:
                self.bands[a].discard(item)
                self.changed.add(a)
            self.bands.setdefault(b, set()).add(item)
        self.changed.add(b)

    def top(self) -> dict[int, float]:
        """The best items and their revenues: the highest occupied bands, until there are enough."""
        out: dict[int, float] = {}
        for band in sorted(self.bands, reverse=True):
            if not band or len(out) == self.size:
                break
            best = heapq.nsmallest(self.size - len(out), ((-self.revenue[i], i) for i in self.bands[band]))
            out.update((i, -r) for r, i in best)
        return out


class BandLadder(StatefulProcessor):
    """State of one shard of one board: a MapState of revenue bands to their items and revenues. After each arrival day, rows for
    the items that came to the shard's best, changed their revenue there or left."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bands = handle.getMapState("bands", "band int", "items binary, revenues binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        board = int(key[0])
        late = timerValues.getCurrentWatermarkInMs()  # of all earlier batches; Spark itself drops by the batch before the last
        parts = [p for r in rows if len(p := r[r["counted"] & (r["day"] * 86_400_000 > late)])]
        if not parts:
            return
        sums = pd.concat(parts).groupby(["arrival_day", "batch", "item_id"], as_index=False)["amount"].sum()
        ladder = Ladder(self.size)
        for (band,), (items, revenues) in self.bands.iterator():
            ladder.load(band, bytes(items), bytes(revenues))
        out: list[tuple] = []
        listed = ladder.top()
        for (day, batch), of_day in sums.groupby(["arrival_day", "batch"]):
            for item, amount in zip(of_day["item_id"].tolist(), of_day["amount"].tolist(), strict=True):
                ladder.add(item, amount)
            now = ladder.top()
            out += [(board, i, day, batch, r, True) for i, r in now.items() if listed.get(i) != r]
            out += [(board, i, day, batch, ladder.revenue[i], False) for i in listed if i not in now]
            listed = now
        for band in ladder.changed:
            if ladder.bands.get(band):
                self.bands.updateValue((band,), ladder.stored(band))
            elif self.bands.containsKey((band,)):
                self.bands.removeKey((band,))
        if out:
            yield pd.DataFrame(out, columns=["board", "item_id", "arrival_day", "batch", "revenue", "listed"])

    def close(self) -> None:
        pass


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Amounts of equal keys summed within a task, so that a frequent item is a few rows in the shuffle."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        keys = [n for n in table.column_names if n != "amount"]
        got = table.group_by(keys).aggregate([("amount", "sum")])
        yield from pa.table({n: got["amount_sum" if n == "amount" else n] for n in table.column_names}).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if len(held) == SUMMED:
            yield from flush(held)
            held = []
    if held:
        yield from flush(held)


@contextlib.contextmanager
def _conf(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def change_feed(events: DataFrame, *, batches: int = 12, size: int = 10, late_days: int = 8, shards: int = 8) -> DataFrame:
    """board, arrival_day, item_id, batch, change (enter, exit, move), old_rank, new_rank, revenue.

    events: board int, item_id long, day long (of the event, since 1970), arrival_day long, batch int (1 to `batches`, not
    falling with arrival_day), amount double. The batches are written under spark.checkpoint.dir and fed in order to a streaming
    query that is started anew for each, on one checkpoint. Events more than `late_days` days before the latest day of all
    earlier batches are dropped; that day counts every event, those without a board or item too, which count nowhere else.
    An arrival day's board is the `size` items of the highest positive revenues so far, ties to the smaller item_id; a row
    comes for each item whose rank differs from the board before. Days before 1970 are late from the start.

    A board's items are dealt to `shards` keys of state, and only a shard's best items leave the state (`size` a day at most), so
    that no task sees a board's whole; amounts are summed in each task before they are shuffled. The shards' best are merged by
    board and day. `shards` should follow the number of items (one for some 16,000): it bounds what one key holds in memory.
    Repeated events count each; a null amount counts 0; no events, or none with a board, give no rows."""
    spark = events.sparkSession
    folder = f"{shared_dir(spark)}/ladder-{uuid.uuid4().hex}"
    staged = f"{folder}/staged"
    counted = F.col("board").isNotNull() & F.col("item_id").isNotNull()
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731  nulls would make floats of pandas columns, keys too
    events.select(whole("board"), whole("item_id"), counted.alias("counted"), "day", "arrival_day", F.coalesce("amount", F.lit(0.0)).alias("amount"), "batch").write.partitionBy("batch").parquet(staged)
    schema = "board int, item_id long, counted boolean, day long, arrival_day long, amount double, batch int"
    source = spark.read.schema(schema).parquet(staged)
    for b in range(1, batches + 1):
        source.where(F.col("batch") == b).drop("batch").write.parquet(f"{folder}/fed/batch={b}")
        with _conf(spark, STREAM_CONF):
            feed = spark.readStream.schema(schema).parquet(f"{folder}/fed")
            deltas = (
                feed.mapInArrow(_summed, schema)
                .withColumn("at", F.timestamp_seconds(F.col("day") * 86400))
                .withWatermark("at", f"{late_days} days 1 millisecond")
                .withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int"))
                .groupBy("board", "shard")
                .transformWithStateInPandas(BandLadder(size), outputStructType=DELTA, outputMode="append", timeMode="EventTime")
            )
            run = deltas.writeStream.format("parquet").option("path", f"{folder}/deltas").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    return board_changes(shared_table(spark.read.schema(DELTA).parquet(f"{folder}/deltas"), "deltas"), size=size)


def board_changes(deltas: DataFrame, *, size: int = 10) -> DataFrame:
    """The rows of change_feed from the shards' deltas: for every board and day on which anything changed, the best of what the
    shards list then, held against the day before. Nothing is gathered by board; days are numbered by board (their number
    follows the calendar, not the events)."""
    days = deltas.groupBy("board").agg(F.sort_array(F.collect_set("arrival_day")).alias("days"))
    after = Window.partitionBy("board", "item_id").orderBy("arrival_day")
    spans = deltas.withColumn("until", F.lead("arrival_day").over(after)).where("listed").join(days, "board")
    at = lambda day: F.array_position("days", F.col(day)).cast("int")
    first, end = at("arrival_day"), F.coalesce(at("until"), F.size("days") + 1)
    daily = spans.select("board", "item_id", "revenue", F.explode(F.sequence(first, end - 1)).alias("k"), "days")
    daily = daily.select("board", "item_id", "revenue", "k", F.element_at("days", F.col("k")).alias("arrival_day"))
    best = Window.partitionBy("board", "k").orderBy(F.desc("revenue"), "item_id")
    boards = shared_table(daily.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size), "boards")
    now = boards.select("board", "item_id", "k", F.col("rank").alias("new_rank"), "revenue")
    old = boards.select("board", "item_id", (F.col("k") + 1).alias("k"), F.col("rank").alias("old_rank"))
    both = now.join(old, ["board", "item_id", "k"], "full").where(~F.col("old_rank").eqNullSafe(F.col("new_rank")))
    dated = both.join(days, "board").where(F.col("k") <= F.size("days")).withColumn("arrival_day", F.element_at("days", F.col("k")))
    # an item that left has the revenue of its shard's last word on it
    gone = dated.where("new_rank IS NULL").alias("g").join(deltas.alias("d"), (F.col("g.board") == F.col("d.board")) & (F.col("g.item_id") == F.col("d.item_id")) & (F.col("d.arrival_day") <= F.col("g.arrival_day")))
    gone = gone.groupBy("g.board", "g.item_id", "g.arrival_day", "g.old_rank").agg(F.max_by("d.revenue", "d.arrival_day").alias("revenue")).withColumn("new_rank", F.lit(None).cast("int"))
    rows = dated.where("new_rank IS NOT NULL").select("board", "item_id", "arrival_day", "old_rank", "new_rank", "revenue").unionByName(gone)
    batch = deltas.groupBy("board", "arrival_day").agg(F.max("batch").alias("batch"))
    change = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return rows.join(batch, ["board", "arrival_day"]).select("board", "arrival_day", "item_id", "batch", change.alias("change"), "old_rank", "new_rank", F.col("revenue").cast("long").alias("revenue"))


def sale_events(lines: DataFrame, vendors: DataFrame, items: DataFrame, *, first_day: int = 19723, batches: int = 12, span: int = 180) -> DataFrame:
    """The events of change_feed from sale lines: a nation's board, the line's item, its shipping day (or one derived from the
    line's hash), its arrival day and batch, its amount in cents, negative when returned.

    Null amounts follow from quantity and price, else count 0; lines without a nation or items row keep a null board. Of repeated
    vendors the least nation counts, of repeated items the least price. Keys of a third of the lines are joined by plain equal
    joins, which adaptive execution splits."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]
    h = F.crc32(F.concat_ws(",", *text).cast("binary"))
    day = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")).cast("long"), first_day + h % 150)
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    delay = (h % 7 + F.when(h % 5 == 0, 20).otherwise(0)).cast("int")
    own = F.floor(F.col("amount") * 100 + 0.5).cast("double") * sign
    quantity = F.when(F.col("amount").isNull(), F.col("quantity") * sign)
    lines = lines.select("item_id", "vendor_id", day.cast("int").alias("day"), delay.alias("delay"), own.alias("own"), quantity.alias("quantity"))
    nation = vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    price = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").alias("known")).agg(F.min("price").alias("price"))
    # vendors and items grow with the lines: they aren't broadcast at any size; written, each is a plain side of a join, whose
    # large keys adaptive execution can split
    nation, price = shared_table(nation, "nations").hint("merge"), shared_table(price, "prices").hint("merge")
    joined = lines.join(nation, "vendor_id", "left").join(price, F.col("item_id") == F.col("known"), "left")
    joined = joined.withColumn("day", F.col("day").cast("long")).withColumn("arrival_day", F.col("day") + F.col("delay"))
    cents = F.coalesce("own", (F.col("quantity") * F.floor(F.col("price") * 100 + 0.5)).cast("double"))
    cents = F.when(F.isnan(cents), 0.0).otherwise(cents)
    batch = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("arrival_day") - first_day) * batches / span))).cast("int")
    board = F.when(F.col("known").isNotNull(), F.col("nation_id"))
    return joined.select(board.alias("board"), "item_id", "day", "arrival_day", cents.alias("amount"), batch.alias("batch"))

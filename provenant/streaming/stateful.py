"""First funding kept in keyed state (an extension of the batch operator).

Per address the state holds the earliest positive transfer's time and, for each
block at that time, how many there are and the least of them: a few numbers,
however long the history.  Rows may come in any order; one that is earlier
corrects what was said before.  Every change of an address's answer is a row of
the result with a rising version, so the last version is the answer.

With ``late`` an answer is final once the watermark has passed its time: the
state then shrinks to a mark, later rows change nothing, and a final row says so.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.funding import as_edges

#: Batches after which the written changes are folded into one snapshot.
FOLD = 16
_NEEDED = ("to_address", "from_address", "value", "ts", "block", "tx")


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch only the rows at their address's least time: a hot receiver's history shrinks before it is shuffled."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        least = table.group_by("to_address", use_threads=False).aggregate([("ts", "min")])
        joined = table.append_column("_row", pa.array(range(table.num_rows))).select(["to_address", "ts", "_row"]).join(least, "to_address")
        rows = joined.filter(pc.equal(joined["ts"], joined["ts_min"]))["_row"]
        yield from table.take(rows).combine_chunks().to_batches()


def _absorb(state: tuple | None, frame: pd.DataFrame) -> tuple | None:
    """(time, {block: (number, least (tx, from, value))}) after some rows."""
    if frame.empty:
        return state
    least = frame["ts"].min()
    if state is not None and state[0] < least:
        return state
    blocks = dict(state[1]) if state is not None and state[0] == least else {}
    for block, tx, giver, value in frame.loc[frame["ts"] == least, ["block", "tx", "from_address", "value"]].itertuples(index=False, name=None):
        n, first = blocks.get(block, (0, None))
        row = (tx, giver, value)
        blocks[block] = (n + 1, row if first is None or row < first else first)
    return least, blocks


def _answer(state: tuple) -> tuple:
    """(time, block, number in the block, tx, from, value): of blocks at one time the one of the least transaction."""
    block, (n, (tx, giver, value)) = min(state[1].items(), key=lambda b: (b[1][1][0], b[0]))
    return state[0], block, n, tx, giver, value


def first_funding_changes(transfers: DataFrame, late: str | None = None) -> DataFrame:
    """(to_address, version, final, ts, block, n, first (tx, from_address, value)): changes of the earliest block of each address.

    Without ``late`` nothing is final and rows of any age are taken.  Rows
    without an address, time or positive value are no transfers.
    """
    kind = dict(transfers.dtypes)
    rows = transfers.select(*_NEEDED).filter("value > 0 AND to_address IS NOT NULL AND ts IS NOT NULL")
    rows = rows.mapInArrow(_earliest, rows.schema)
    if late:
        rows = rows.withWatermark("ts", late)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, final, held = state.get[0], state.get[1], pickle.loads(state.get[2]) if state.exists else None  # noqa: S301
        before = None if held is None else _answer(held)
        if state.hasTimedOut:
            state.update((version + 1, True, held_bytes(held)))
            yield out(key, version + 1, True, before)
            return
        if final:
            return
        for frame in frames:
            held = _absorb(held, frame)
        if held is None:
            return
        now = _answer(held)
        if now != before:
            version += 1
        state.update((version, False, held_bytes(held)))
        if late:
            state.setTimeoutTimestamp(max(int(held[0].timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if now != before:
            yield out(key, version, False, now)

    def held_bytes(held: tuple) -> bytes:
        return pickle.dumps(held)

    def out(key: tuple, version: int, final: bool, answer: tuple) -> pd.DataFrame:
        ts, block, n, tx, giver, value = answer
        return pd.DataFrame({"to_address": [key[0]], "version": [version], "final": [final], "ts": [ts], "block": [block], "n": [n], "tx": [tx], "from_address": [giver], "value": [value]})

    def start(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not state.exists:
            state.update((0, False, pickle.dumps(None)))
        return update(key, frames, state)

    schema = f"to_address {kind['to_address']}, version long, final boolean, ts {kind['ts']}, block {kind['block']}, n long, tx {kind['tx']}, from_address {kind['from_address']}, value {kind['value']}"
    timeout = GroupStateTimeout.EventTimeTimeout if late else GroupStateTimeout.NoTimeout
    changed = rows.groupBy("to_address").applyInPandasWithState(start, schema, "version long, final boolean, held binary", "update", timeout)
    return changed.select("to_address", "version", "final", "ts", "block", "n", F.struct("tx", "from_address", "value").alias("first"))


def _last(changes: DataFrame) -> DataFrame:
    newest = Window.partitionBy("to_address").orderBy(F.desc("version"))
    return changes.withColumn("_i", F.row_number().over(newest)).filter("_i = 1").drop("_i")


def _folders(spark: SparkSession, table_dir: str) -> tuple[int, list[tuple[int, str]]]:
    """(last batch of the newest whole snapshot or -1, (batch, folder) of what is not in it), and the older ones' paths by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return -1, []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    whole = [int(n.split("=")[1]) for n in names if n.startswith("upto=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/{n}/_SUCCESS"))]
    upto = max(whole, default=-1)
    return upto, sorted((int(n.split("=")[1]), n) for n in names if n.startswith("batch=") and int(n.split("=")[1]) > upto)


def write_changes(changes: DataFrame, table_dir: str, checkpoint_dir: str, **trigger) -> StreamingQuery:
    """Writes each batch's changes below ``table_dir``; read with :func:`current_edges`.

    Every ``FOLD`` batches all but the last versions go: a snapshot is written,
    and folders that are in it are deleted once it is whole.  A repeated batch
    replaces itself.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table_dir}/batch={batch_id}")
        if batch_id % FOLD != FOLD - 1:
            return
        upto, rest = _folders(spark, table_dir)
        paths = [*([f"upto={upto}"] if upto >= 0 else []), *[n for b, n in rest if b <= batch_id]]
        if upto < batch_id:
            _last(spark.read.schema(batch.schema).parquet(*[f"{table_dir}/{n}" for n in paths])).write.mode("overwrite").parquet(f"{table_dir}/upto={batch_id}")
            where = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
            files = where.getFileSystem(spark._jsc.hadoopConfiguration())
            for n in paths:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/{n}"), True)

    stream = changes.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint_dir)
    return stream.trigger(**(trigger or {"availableNow": True})).start()


def current_edges(spark: SparkSession, table_dir: str) -> DataFrame:
    """First-funding edges after the batches so far, as the batch operator returns them."""
    upto, rest = _folders(spark, table_dir)
    paths = [*([f"upto={upto}"] if upto >= 0 else []), *[n for _, n in rest]]
    return as_edges(_last(spark.read.parquet(*[f"{table_dir}/{n}" for n in paths])))

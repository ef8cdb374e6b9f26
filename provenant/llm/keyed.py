"""Documents under an order key, and flags that travel back to them.

Operators that decide on parts of documents (byte runs, chunks) find the parts
in one pass over the texts, decide on them elsewhere, and apply the decisions
in a second pass.  ``k`` orders documents (their id, a null one last) and ``c``
is a checksum of the text, so rows that share an id but not a text stay apart
and repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Order key of a null id: after all others.
LAST = 2**63 - 1


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, c, text); a null text is empty.  Ids are whole numbers (packed arrays hold them); others are an error."""
    if (kind := dict(docs.dtypes)[id_col]) not in INTEGERS:
        raise TypeError(f"{id_col} is {kind}: number the documents first, see operators.numbering")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("k"),
        F.crc32(text.cast("binary")).alias("c"),
        text.alias("text"),
    )


def distinct_rows(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(keyed rows with each (k, c) once, whether any k has several c).

    Where no k repeats, which a count of the ids alone tells, these are ``rows``
    as they are.  Repeats are dropped by partial aggregations, so a row that
    comes very often is no hot key.
    """
    twice = materialize(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k"), "repeated-ids")
    if twice.isEmpty():
        release(twice)
        return rows, False
    some = rows.join(twice, "k", "left_semi")
    clash = not some.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").isEmpty()
    return rows.join(twice, "k", "left_anti").unionByName(some.dropDuplicates(["k", "c"])), clash


def once(rows: DataFrame) -> DataFrame:
    """Keyed rows with each (k, c) once."""
    return distinct_rows(rows)[0]


def with_flags(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds ``flags`` (an array of packed decisions, null for none) to each keyed row.

    The documents are the streamed side of a shuffled hash join: texts move
    once and are not sorted.
    """
    gathered = flags.groupBy("k", "c").agg(F.collect_list("flags").alias("flags"))
    return rows.join(gathered.hint("shuffle_hash"), ["k", "c"], "left")


#: Bytes of text that a task takes, whatever the session's shuffle partitions are.
TASK = 32 << 20


def buckets(rows: DataFrame, bytes_each: int) -> tuple[int, int]:
    """(parts of about ``bytes_each`` bytes of text, tasks for them): both follow the input, so a part never grows with it."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    return max(16, -(-total // bytes_each)), tasks


def unflag(column: pa.Array, row: int, dtype: np.dtype) -> np.ndarray:
    """The decisions of one row as one array."""
    got = column[row].as_py()
    return np.frombuffer(b"".join(got), dtype) if got else np.empty(0, dtype)


def doc_id(k: str = "k"):
    return F.when(F.col(k) != LAST, F.col(k)).alias("doc_id")


def per_owner(k: np.ndarray, c: np.ndarray, packed: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """Groups the rows of a structured array by (k, c)."""
    if not len(k):
        return [], [], []
    order = np.lexsort((c, k))
    k, c, packed = k[order], c[order], packed[order]
    cut = np.flatnonzero((k[1:] != k[:-1]) | (c[1:] != c[:-1])) + 1
    start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)]))
    return k[start].tolist(), c[start].tolist(), [packed[a:b].tobytes() for a, b in zip(start, end, strict=True)]

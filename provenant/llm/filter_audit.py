"""Interaction audit of corpus filters by Walsh-Hadamard parities.

Every document gets a mask of the filters it fails.  What leaves the tasks is
not masks but parity sums: for each subset of filters, part and label, the sum
over documents of +1 or -1 as an even or odd number of the subset's filters
fails.  These 32 numbers are the Walsh-Hadamard transform of the counts of the
32 masks, so they add up over any division of the rows, have one size whatever
the input, and invert exactly (in whole numbers) to the counts.  Orders of the
filters and Shapley values are then evaluated on the counts alone.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .keyed import INTEGERS, LAST
from .shared import byte_slices, lean, renamed_free

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
#: Filter D's characters (fixed values).
MARKS = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5


def _failed(text: bytes, capitals: int, points: int, marked: bool) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # splits bytes on exactly space and the controls 9 to 13
    n = len(words)
    return (n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | marked << 3


def _sums(data: np.ndarray, offsets: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Number of bytes of each document that are marked in ``hit`` (a table of 256)."""
    total = np.concatenate(([0], np.cumsum(hit[data], dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _table(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], bool)


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(k, part, mask, digest): filters A to D of whole texts, and a 128-bit name of the text.

    One pass over the texts; a batch's bytes are counted at once and nothing
    but 40 bytes a document goes on.  Null texts are empty, null parts the
    empty string.
    """
    if (kind := dict(docs.dtypes)[id_col]) not in INTEGERS:
        raise TypeError(f"{id_col} is {kind}: number the documents first, see operators.numbering")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("k"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("digest"), text.alias("text")
    )
    capital, starts, mark = _table(lambda b: 65 <= b <= 90), _table(lambda b: b & 0xC0 != 0x80), _table(lambda b: b in MARKS)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = np.zeros(batch.num_rows, np.int32)
            for first, offsets, data in byte_slices(batch.column("text"), 1 << 20):
                counted = zip(*(_sums(data, offsets, t).tolist() for t in (capital, starts, mark)), strict=True)
                for i, (capitals, points, marks) in enumerate(counted):
                    masks[first + i] = _failed(data[offsets[i] : offsets[i + 1]].tobytes(), capitals, points, marks > 0)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("part"), pa.array(masks), batch.column("digest")], names=["k", "part", "mask", "digest"])

    return rows.mapInArrow(lean(judge), "k long, part string, mask int, digest binary")


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(k, part, mask) of every row, with filter E: a row with a smaller id has the same text.

    A null id is larger than all others; rows that share an id are not copies
    of each other.  The least id of each text comes from a partial aggregation,
    and only texts under several ids are joined back, so a text that a third of
    all rows hold is one row on the other side.
    """
    rows = materialize(text_masks(docs, id_col, text_col, part_col), "masks")
    order = F.coalesce("k", F.lit(LAST))
    several = rows.groupBy("digest").agg(F.min(order).alias("least"), F.max(order).alias("most")).filter("least < most").select(F.col("digest").alias("_d"), "least")
    copy = F.coalesce(order > F.col("least"), F.lit(False))
    return rows.join(several, F.col("digest") == F.col("_d"), "left").select("k", "part", F.col("mask").bitwiseOR(F.when(copy, F.lit(16)).otherwise(F.lit(0))).alias("mask"))


def _odd(bits: Column) -> Column:
    return F.bit_count(bits) % 2 == 1


def parity_sums(masks: DataFrame) -> DataFrame:
    """(part, w_all, w_good, w_toxic): 32 signed sums each, of rows (part, mask, good, toxic)."""
    weight = {"all": "1L", "good": "CAST(good AS LONG)", "toxic": "CAST(toxic AS LONG)"}
    sums = [f"sum(if(bit_count(mask & {s}) % 2 = 1, -{w}, {w}))" for w in weight.values() for s in range(CELLS)]
    parts = [f"array({', '.join(sums[i * CELLS : (i + 1) * CELLS])})" for i in range(len(weight))]
    return masks.groupBy("part").agg(*[F.expr(x).alias(f"w_{label}") for x, label in zip(parts, LABELS, strict=True)])


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, n_all, n_good, n_toxic): counts of the 32 masks; the transform is its own inverse but for the factor 32."""

    def invert(w: str) -> Column:
        cell = lambda m: F.aggregate(
            F.transform(w, lambda x, s: F.when(_odd(s.bitwiseAND(m)), -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
        )
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.shiftright(cell(m), 5))

    return sums.select("part", *[invert(f"w_{label}").alias(f"n_{label}") for label in LABELS])


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, mask of the filters before, bit of this one) of all orders."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    Null texts are empty (they fail A, and E if another one has a smaller id);
    null parts are the empty string; a null id has no label and comes last;
    a document is good or toxic if any of its labels says 1; repeated rows
    count each; other columns are not looked at; no documents give no rows, and
    no labels nothing lost.
    """
    plain = renamed_free(docs, id_col, text_col, part_col)
    flags = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("g"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("t"))
        .filter("_id IS NOT NULL AND (g OR t)")
        .groupBy("_id")
        .agg(F.max("g").alias("g"), F.max("t").alias("t"))
    )
    with scratch() as keep:
        masks = failure_masks(plain, id_col, text_col, part_col).join(flags, F.col("k") == F.col("_id"), "left")
        masks = masks.select("part", "mask", F.coalesce("g", F.lit(False)).alias("good"), F.coalesce("t", F.lit(False)).alias("toxic"))
        cells = keep(materialize(mask_cells(parity_sums(masks)), "cells"))
    steps = ", ".join(f"struct('{o}' AS filter_order, {s} AS step, {b} AS before, {f} AS bit)" for o, s, b, f in orders())
    rows = cells.select("*", F.inline(F.expr(f"array({steps})")))
    masks_of = F.sequence(F.lit(0), F.lit(CELLS - 1))
    fails, earlier = (lambda m: m.bitwiseAND(F.col("bit")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)

    def total(label: str, test, share=None) -> Column:
        count = lambda m: F.get(f"n_{label}", m) if share is None else F.get(f"n_{label}", m) * share(m)
        return F.aggregate(masks_of, F.lit(0).cast("long"), lambda a, m: a + F.when(test(m), count(m)).otherwise(F.lit(0).cast("long")))

    here = lambda m: fails(m) & ~earlier(m)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("all", here).alias("removed"),
        total("all", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("all", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        # a document that fails n filters is removed by each of them in 120 / n orders
        total("all", fails, lambda m: (F.lit(120) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters over every source."""
    return audit(docs, labels)


#: The same result in DuckDB's SQL.
ORACLE = """
WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT t, min(coalesce(doc_id, 9223372036854775807)) AS least FROM base GROUP BY 1),
flags AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
fails AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(b.doc_id, 9223372036854775807) > least] AS f
    FROM base b JOIN firsts USING (t) LEFT JOIN flags l ON l.doc_id = b.doc_id),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM fails GROUP BY 1, 2),
letters AS (SELECT unnest(range(1, 6)) AS i),
perms AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT array_to_string(list_transform(p, lambda x: chr((64 + x)::INTEGER)), '') AS filter_order, s.i::INTEGER AS step, p[s.i] AS own, p[1:s.i - 1] AS prev FROM perms, letters s),
judged AS (SELECT part, filter_order, step, n, g, x, f[own] AS bad, len(list_filter(prev, lambda q: f[q])) > 0 AS gone, len(list_filter(f, lambda q: q)) AS k FROM cells, steps)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bad AND k = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * (120 // greatest(k, 1))) FILTER (bad), 0)::BIGINT AS shapley
FROM judged GROUP BY 1, 2, 3
"""

__all__ = ["ORACLE", "audit", "failure_masks", "mask_cells", "op13_filter_audit", "parity_sums"]

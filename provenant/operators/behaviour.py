"""Behaviour features of an address: messages sent, transactions out and in, their join.

Messages are shuffled once for both of their blocks.  Transactions are dealt
once, by address, to tasks of a bounded mean number of rows, and joined with
the addresses that are asked for when there is one row of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import double_sum, epoch_seconds, mean_of, safe_divide


def home_interactions(messages: DataFrame, home: str) -> DataFrame:
    """Distinct messages that each address sent from its home chain."""
    return (
        messages.filter(F.col("source_chain") == home)
        .groupBy(F.col("sender_wallet").alias("addr"))
        .agg(F.count_distinct("tx_hash").alias("n_eth_interactions"))
    )


#: What is counted distinct of a message: a letter and its column.
_IDS = {"t": "tx_hash", "s": "source_contract", "d": "destination_contract", "c": "source_chain", "e": "destination_chain", "p": "project"}
_NAMES = {"t": "txs", "s": "source_contracts", "d": "dest_contracts", "c": "source_chains", "e": "dest_chains", "p": "projects"}
#: Halves that a message is dealt in, and cells by which the messages of addresses are counted.
_HALVES, _CELLS = ("tce", "spd"), 1 << 16
#: Messages of a cell, beyond four times the mean, from which its addresses count as crowded.
CROWDED = 100_000


def _measures(applies: Column, home: Column) -> list[Column]:
    """Numbers of rows, money and times where ``applies``, over all messages and over those to the home chain."""
    out = []
    for block, those in (("all", applies), ("home", applies & home)):
        only = lambda c, those=those: F.when(those, F.col(c))
        out += [F.count_if(those).alias(f"{block}_rows")]
        out += [f(only(c)).alias(f"{block}_{n}_{c}") for c in ("swap", "dropped") for n, f in (("max", F.max), ("min", F.min), ("sum", F.sum))]
        out += [F.min(only("at")).alias(f"{block}_first"), F.max(only("at")).alias(f"{block}_last")]
    return out


def _merged() -> list[Column]:
    """The sums of the partial results of :func:`_measures`, and whether a message went to the home chain."""
    out = []
    for block, prefix in (("all", "l0"), ("home", "l0_to_eth")):
        rows = F.sum(f"{block}_rows").cast("double")
        for column, name in (("swap", "stargate_swap"), ("dropped", "native_drop_usd")):
            out.append(F.max(f"{block}_max_{column}").cast("double").alias(f"{prefix}_max_{name}"))
            out.append(F.try_divide(F.sum(f"{block}_sum_{column}").cast("double"), rows).alias(f"{prefix}_avg_{name}"))
        first, last = F.min(f"{block}_first"), F.max(f"{block}_last")
        out += [
            F.min(f"{block}_min_swap").cast("double").alias(f"{prefix}_min_stargate_swap"),
            first.alias(f"earliest_{prefix}_tx_time"), last.alias(f"latest_{prefix}_tx_time"), (last - first).alias(f"{prefix}_tx_time_span"),
        ]
    return [*out, (F.sum("home_rows") > 0).alias("sent_home")]


def _of_few(rows: DataFrame) -> DataFrame:
    """The wide row of addresses with a bounded number of messages.

    A message is dealt by address in two halves, each with three of its ids, so
    it is shuffled about once; an id keeps its type where its place has one in
    both halves.  The ids of an address and half meet in one task, where sets of
    a bounded size count them.
    """
    kind = {k: rows.schema[f"_{k}"].dataType for k in _IDS}
    common = [a.simpleString() if (a := kind[x]) == kind[y] else "string" for x, y in zip(*_HALVES, strict=True)]
    ids = lambda half: [F.col(f"_{k}").cast(common[i]).alias(f"id{i}") for i, k in enumerate(half)]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("swap", "dropped", "at")]
    halves = F.array(
        F.struct(F.lit(0).alias("half"), *ids(_HALVES[0]), "swap", "dropped", "at"), F.struct(F.lit(1).alias("half"), *ids(_HALVES[1]), *none)
    )
    dealt = rows.select("addr", "from_home", "to_home", F.inline(halves)).repartition("addr", "half")
    size = lambda i, also=None: F.size(F.collect_set(f"id{i}" if also is None else F.when(F.col(also), F.col(f"id{i}")))).cast("long")
    counts = [size(i).alias(f"n{i}") for i in range(3)] + [size(i, "to_home").alias(f"home_n{i}") for i in range(3)]
    met = dealt.groupBy("addr", "half").agg(*counts, size(0, "from_home").alias("from_n0"), *_measures(F.col("half") == 0, F.col("to_home")))
    total = lambda half, c: F.sum(F.when(F.col("half") == half, F.col(c)).otherwise(F.lit(0).cast("long")))
    place = {k: (h, i) for h, half in enumerate(_HALVES) for i, k in enumerate(half)}
    counts = [total(0, "from_n0").alias("n_eth_interactions")]
    counts += [total(place[k][0], f"n{place[k][1]}").alias(f"n_l0_{n}") for k, n in _NAMES.items()]
    counts += [total(place[k][0], f"home_n{place[k][1]}").alias(f"n_l0_to_eth_{n}") for k, n in _NAMES.items() if k != "e"]
    return met.groupBy("addr").agg(*counts, *_merged())


def _of_many(rows: DataFrame) -> DataFrame:
    """The wide row of addresses with any number of messages.

    The first aggregation is by address, kind of id and id: it counts an id once
    and keeps whether any of its messages came from or went to the home chain;
    hashing the id spreads an address that sends a large part of all messages.
    The second adds up per address.  Money and times travel with the message's
    own id.
    """
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").cast("string").alias("id")) for k in _IDS]))
    each = rows.select("addr", "from_home", "to_home", "swap", "dropped", "at", kinds)
    measures = _measures(F.col("kind") == "t", F.col("to_home"))
    once = each.groupBy("addr", "kind", "id").agg(F.bool_or("from_home").alias("from_home"), F.bool_or("to_home").alias("to_home"), *measures)
    distinct = lambda kind, also=None: F.count_if((F.col("kind") == kind) & F.col("id").isNotNull() & (F.lit(True) if also is None else F.col(also)))
    counts = [distinct("t", "from_home").alias("n_eth_interactions")]
    counts += [distinct(k).alias(f"n_l0_{n}") for k, n in _NAMES.items()]
    counts += [distinct(k, "to_home").alias(f"n_l0_to_eth_{n}") for k, n in _NAMES.items() if k != "e"]
    return once.groupBy("addr").agg(*counts, *_merged())


def message_blocks(messages: DataFrame, home_source: str, home_destination: str, crowded: int = CROWDED) -> DataFrame:
    """One row per address with a message from its home chain: variety, money and time over all messages and over those to the home chain.

    ``messages`` should be a written table (or columns of one): it is read once to count messages
    by cells of addresses, and once more for the result.  Addresses of cells
    with many messages (more than ``crowded`` and four times the mean) take
    :func:`_of_many`, all others :func:`_of_few`; the results are the same.
    Addresses without a message to the home chain have nulls in that block.
    """
    rows = messages.select(
        F.col("sender_wallet").alias("addr"),
        F.coalesce(F.col("source_chain") == home_source, F.lit(False)).alias("from_home"),
        F.coalesce(F.col("destination_chain") == home_destination, F.lit(False)).alias("to_home"),
        F.coalesce("swap_usd", F.lit(0)).alias("swap"),
        F.coalesce("drop_usd", F.lit(0)).alias("dropped"),
        epoch_seconds("ts").alias("at"),
        *[F.col(c).alias(f"_{k}") for k, c in _IDS.items()],
    ).filter("addr IS NOT NULL")
    cell = F.pmod(F.xxhash64("addr"), F.lit(_CELLS))
    counted = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # of one number for each cell
    full = [r[0] for r in counted.select("cell", "n", total.alias("total")).filter(F.col("n") > crowded + 4 * F.col("total") / _CELLS).select("cell").collect()]
    if full:
        wide = _of_few(rows.filter(~cell.isin(full))).unionByName(_of_many(rows.filter(cell.isin(full))))
    else:
        wide = _of_few(rows)
    wide = wide.filter("n_eth_interactions > 0")
    there = lambda c: F.when(F.col("sent_home"), c)
    return wide.withColumns(
        {c: there(F.col(c)) for c in wide.columns if c.startswith("n_l0_to_eth")}
        | {
            "n_l0_dest_chain_per_source_chain": safe_divide(F.col("n_l0_dest_chains"), F.col("n_l0_source_chains")),
            "n_l0_project_per_source_chain": safe_divide(F.col("n_l0_projects"), F.col("n_l0_source_chains")),
            "n_l0_to_eth_project_per_source_chain": there(safe_divide(F.col("n_l0_to_eth_projects"), F.col("n_l0_to_eth_source_chains"))),
        }
    )


def _to_home(name: str) -> bool:
    return "l0_to_eth" in name


def message_features(blocks: DataFrame) -> DataFrame:
    """The block over all messages."""
    return blocks.select(*[c for c in blocks.columns if not _to_home(c) and c != "sent_home"])


def message_home_features(blocks: DataFrame) -> DataFrame:
    """The block over messages to the home chain, without destination chains, of the addresses that have any."""
    return blocks.filter("sent_home").select("addr", *[c for c in blocks.columns if _to_home(c)])


#: Transactions of a task that counts them: their hash tables take some hundred bytes for each.
TASK_ROWS = 500_000


def _dealt(txs: DataFrame, key: str, rows: int | None) -> DataFrame:
    """``txs`` by ``key``, not null: with their number ``rows``, in tasks of :data:`TASK_ROWS`, however small they are when compressed."""
    txs = txs.filter(F.col(key).isNotNull())
    if rows is None:
        return txs.repartition(key)
    return txs.repartition(max(txs.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), key)


def outbound_features(txs: DataFrame, addresses: DataFrame, until, rows: int | None = None) -> DataFrame:
    """Transactions sent up to and including ``until``; ``rows`` is their number, or a bound of it."""
    own = _dealt(txs.filter(F.col("ts") <= until), "from_address", rows).groupBy(F.col("from_address").alias("addr")).agg(
        F.count("*").alias("num_transactions"),
        F.min("block").alias("earliest_tx_block_out"),
        F.max("block").alias("latest_tx_block_out"),
        (F.max("block") - F.min("block")).alias("tx_block_span"),
        F.max("value").cast("double").alias("max_tx_value_out"),
        F.min("value").cast("double").alias("min_tx_value_out"),
        double_sum("value").alias("total_tx_value_out"),
        mean_of("value").alias("avg_tx_value_out"),
        F.max("fee").cast("double").alias("max_tx_fee_out"),
        F.min("fee").cast("double").alias("min_tx_fee_out"),
        F.count_distinct("to_address").alias("out_degree"),
    )
    return own.join(addresses.select("addr"), "addr", "left_semi")


def inbound_features(txs: DataFrame, addresses: DataFrame, before, rows: int | None = None) -> DataFrame:
    """Transactions received strictly before ``before``; ``rows`` is their number, or a bound of it."""
    own = _dealt(txs.filter(F.col("ts") < before), "to_address", rows).groupBy(F.col("to_address").alias("addr")).agg(
        F.count("*").alias("num_transactions_in"),
        F.min("block").alias("earliest_tx_block_in"),
        F.max("block").alias("latest_tx_block_in"),
        F.max("value").cast("double").alias("max_tx_value_in"),
        F.min("value").cast("double").alias("min_tx_value_in"),
        double_sum("value").alias("total_tx_value_in"),
        mean_of("value").alias("avg_tx_value_in"),
        F.count_distinct("from_address").alias("in_degree"),
    )
    return own.join(addresses.select("addr"), "addr", "left_semi")


_IN_COUNTS = ["num_transactions_in", "earliest_tx_block_in", "latest_tx_block_in", "in_degree"]
_IN_VALUES = ["max_tx_value_in", "min_tx_value_in", "total_tx_value_in", "avg_tx_value_in"]


def behaviour_master(blocks: DataFrame, outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    """Both message blocks with a left star join on ``addr``; inbound measures default to 0, the others stay null."""
    out = blocks.drop("sent_home")
    for part in (outbound, inbound):
        out = out.join(part, "addr", "left")
    out = out.withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in _IN_COUNTS} | {c: F.coalesce(c, F.lit(0.0)) for c in _IN_VALUES}
    )
    span_out = F.col("latest_tx_block_out") - F.col("earliest_tx_block_out")
    span_in = F.col("latest_tx_block_in") - F.col("earliest_tx_block_in")
    return out.withColumns(
        {
            "time_span_out": span_out,
            "out_degree_per_block_out": safe_divide(F.coalesce("out_degree", F.lit(0)), span_out),
            "tx_value_per_block_out": safe_divide(F.coalesce("total_tx_value_out", F.lit(0.0)), span_out),
            "time_span_in": span_in,
            "indegree_per_block_in": safe_divide(F.col("in_degree"), span_in),
            "tx_value_per_block_in": safe_divide(F.col("total_tx_value_in"), span_in),
            "possible_triangles": F.col("in_degree") * F.col("out_degree"),
        }
    )

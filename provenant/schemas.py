"""Explicit schemas of the tabular extracts; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MESSAGES = _struct(
    ("sender_wallet", _S), ("source_chain", _S), ("destination_chain", _S), ("project", _S),
    ("source_contract", _S), ("destination_contract", _S), ("stargate_swap_usd", _D),
    ("native_drop_usd", _D), ("source_transaction_hash", _S), ("source_timestamp_utc", _TS),
)
TRANSACTIONS = _struct(
    ("from_address", _S), ("to_address", _S), ("block_number", _L),
    ("block_timestamp", T.TimestampNTZType()), ("value", _D), ("tx_fee", _D),
)
TRANSFERS = _struct(("from_address", _S), ("to_address", _S), ("block_timestamp", _TS))
TRACES = _struct(
    ("to_address", _S), ("from_address", _S), ("value", T.DecimalType(38, 0)),
    ("block_timestamp", _TS), ("block_number", _L), ("transaction_hash", _S),
)
LABELS = _struct(("address", _S), ("label_type", _S))
PROVISIONS = _struct(
    ("activated_address", _S), ("gas_provider", _S), ("gas_provision_amount", _S),
    ("first_gas_provision_time", _TS), ("block_number", _L), ("tx_hash", _S),
)
EXCHANGE = _struct(("to_address", _S), ("cex_in_count", _L), ("dex_in_count", _L))
INTERACTORS = _struct(("addr", _S))
TRUTH = _struct(
    ("address", _S), ("reward address1", _S), ("reward address2", _S),
    ("commonwealth report link", _S), ("github issue", _S), ("timestamp", _TS), ("allocation", _D),
)

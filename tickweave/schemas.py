"""Schemas of message logs, snapshots and the canonical book."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columns of the vendor's message logs, by type.
LONG_COLUMNS = ["receipttimestamp", "exchangetimestamp", "exchange_timestamp", "sourcetimestamp", "sequencenumber", "matchid", "tradereferencenumber"]
STRING_COLUMNS = ["f", "side", "orderreferencenumber", "previousorderreferencenumber", "maintainpriority", "admindelete", "aggressorside", "printable"]
DOUBLE_COLUMNS = ["price", "previousprice", "quantity", "previousquantity", "newquantity", "pairedquantity", "oldprice", "newprice"]

#: Message type -> (rank on equal clocks, replay code or None, quantity column).
MESSAGE_TYPES: dict[str, tuple[int, str | None, str]] = {
    "mt_add_order": (0, "ADD", "quantity"),
    "mt_cancel_order": (1, "CANCEL", "previousquantity"),
    "mt_modify_order": (2, "MODIFY", "quantity"),
    "mt_trade": (3, "TRADE", "quantity"),
    "mt_price_level_update": (4, "LEVEL_SET", "quantity"),
    "mt_modify_price_level": (5, "LEVEL_SET", "quantity"),
    "mt_delete_price_level": (6, "LEVEL_DEL", "quantity"),
    "mt_trade_break": (7, None, "quantity"),
    "mt_trade_correction": (8, None, "newquantity"),
    "mt_order_imbalance": (9, None, "pairedquantity"),
}

#: Clock -> timestamp columns, the first one present is taken.
CLOCKS = {"receipt": ["receipttimestamp"], "exchange": ["exchangetimestamp", "exchange_timestamp", "sourcetimestamp"]}

#: Strings that stand for a missing value.
NULL_TOKENS = ["", "nan", "<NA>", "None", "NaN", "null", "NULL"]

#: Rows of the replay: one order-book event each.
EVENTS = T.StructType(
    [
        T.StructField("f", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("side", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("ref", T.StringType()),
        T.StructField("prev_ref", T.StringType()),
        T.StructField("maintain", T.BooleanType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("arrival", T.LongType()),
    ]
)


def canonical_schema(root: str, levels: int) -> T.StructType:
    """The wide book: one row a grid point."""
    fields = [T.StructField("ts", T.TimestampType())]
    for side in ("bid", "ask"):
        for k in range(1, levels + 1):
            fields += [T.StructField(f"{root}_{side}price_{k}", T.DoubleType()), T.StructField(f"{root}_{side}quantity_{k}", T.DoubleType())]
    return T.StructType([*fields, *(T.StructField(f"{root}_{n}", T.DoubleType()) for n in ("mid", "nbbo_bid", "nbbo_ask"))])

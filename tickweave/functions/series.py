"""What a row of the tape says about its own sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def declared_sign(how: str, aggressor: Column | None = None, side: Column | None = None, buy_label: str = "Bid") -> Column:
    """The sign that a row states itself, or null: then the tick rule decides.

    By "side" only the two labels say something: ``buy_label`` a buy, the opposite one a sell.
    """
    if how == "aggressor" and aggressor is not None:
        a = F.lower(F.trim(aggressor))
        return F.when(a == "buy", 1).when(a == "sell", -1)
    if how == "side" and side is not None:
        s = F.trim(side)
        return F.when(s == buy_label, 1).when(s == ("Ask" if buy_label == "Bid" else "Bid"), -1)
    return F.lit(None).cast("int")

"""Futures calendar: third Fridays, contract codes, front months, expiries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quarterly month codes, point values and lots.
MONTH_CODES = {"F": 1, "G": 2, "H": 3, "J": 4, "K": 5, "M": 6, "N": 7, "Q": 8, "U": 9, "V": 10, "X": 11, "Z": 12}
QUARTERLY = ["H", "M", "U", "Z"]
POINT_VALUES = {"ES": 50.0, "MES": 5.0, "NQ": 20.0, "MNQ": 2.0, "RTY": 50.0, "M2K": 5.0}
LOTS = {"direct": 100.0, "futures": 1.0}


def third_friday(year: Column, month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, month, F.lit(1)), 1), "FRI"), 14)


def _front(as_of: Column, rollover_days: int, chosen) -> Column:
    """chosen(code, year, expiry) of the first quarterly contract that expires ``rollover_days`` or more after the date."""
    found = F.lit(None)
    for ahead in (1, 0):
        year = F.year(as_of) + ahead
        for code in reversed(QUARTERLY):
            expiry = third_friday(year, F.lit(MONTH_CODES[code]))
            found = F.when(F.to_date(as_of) <= F.date_sub(expiry, rollover_days), chosen(code, year, expiry)).otherwise(found)
    return found


def front_month(symbol: Column, as_of: Column, rollover_days: int = 8) -> Column:
    """The front contract's code, like ESH0."""
    return _front(as_of, rollover_days, lambda code, year, _: F.concat(symbol, F.lit(code), (year % 10).cast("string")))


def front_expiry(as_of: Column, rollover_days: int = 8) -> Column:
    """The front contract's expiry."""
    return _front(as_of, rollover_days, lambda code, year, expiry: expiry)


def contract_expiry(code: Column, ref_year: Column) -> Column:
    """Third Friday of a contract like ESH0, in the decade of ref_year; raises on an unknown month."""
    month = F.lit(None).cast("int")
    for letter, m in MONTH_CODES.items():
        if letter in QUARTERLY:
            month = F.when(code.substr(F.length(code) - 1, F.lit(1)) == letter, m).otherwise(month)
    month = F.coalesce(month, F.raise_error(F.concat(F.lit("bad contract month: "), code)).cast("int"))
    year = F.floor(ref_year / 10).cast("int") * 10 + F.substring(code, -1, 1).cast("int")
    return third_friday(year, month)


def futures_root(product: Column) -> Column:
    return F.upper(product.substr(F.lit(1), F.length(product) - 2))


def canonical_root(product: Column, product_type: str) -> Column:
    if product_type not in LOTS:
        raise ValueError(f"product type {product_type!r}")
    return futures_root(product) if product_type == "futures" else F.upper(product)


def default_lot(product_type: str) -> float:
    return LOTS[product_type]


def point_value(root: Column) -> Column:
    """Money that one point of a future's price is worth; null for a root without one."""
    pairs = [F.lit(x) for k, v in POINT_VALUES.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.upper(root))


def notional(root: Column, price: Column, contracts: Column) -> Column:
    """price * contracts in money: times the point value of a future, as it is for anything else."""
    return price * contracts * F.coalesce(point_value(root), F.lit(1.0))

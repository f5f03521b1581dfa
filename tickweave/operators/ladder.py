"""From level changes to the consolidated book on a time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.operators.ordering import ORDER

EPS = 1e-9
#: Grid points that are pruned together.
SPAN = 60


def grid_index(column: str, g0_ns: int | str, step_ns: int) -> Column:
    """The first grid point at which a change is visible (at or after it), in integers. g0_ns: a number or a column."""
    x = f"({column} - {g0_ns if isinstance(g0_ns, str) else f'{g0_ns}L'})"
    return F.expr(f"greatest(0L, {x} div {step_ns}L + if({x} > 0 and pmod({x}, {step_ns}L) > 0, 1L, 0L))")


def intervals(changes: DataFrame, g0_ns: int | str, step_ns: int, points: int) -> DataFrame:
    """f, side, price, qty, lo, hi: grid points lo .. hi - 1 at which a level stands. g0_ns: the first point, of all or a column."""
    placed = changes.withColumn("gi", grid_index("eff_ts", g0_ns, step_ns)).where(F.col("gi") < points)
    last = placed.groupBy("f", "side", "price", "gi").agg(F.max(F.struct("eff_ts", *ORDER, "sub", "level"))["level"].alias("qty"))
    w = Window.partitionBy("f", "side", "price").orderBy("gi")
    out = last.withColumn("hi", F.coalesce(F.lead("gi").over(w), F.lit(points).cast("long")))
    return out.where(F.col("qty") > EPS).select("f", "side", "price", "qty", F.col("gi").alias("lo"), "hi")


def better(side: str = "side", price: str = "price") -> Column:
    """A number that is smaller for a better price."""
    return F.when(F.col(side) == "Bid", -F.col(price)).otherwise(F.col(price))


def standing(spans: DataFrame, n: int, keys: list[str], span: int = SPAN) -> DataFrame:
    """The best ``n`` levels of each (keys, side) at each grid point: gi, side, keys, price, qty.

    Stretches are first cut into spans of the grid. A level that stands through a
    whole span keeps any level with n such better ones out of the top n there, so
    those never become rows of the grid.
    """
    key = [*keys, "side"]
    cut = spans.withColumn("_span", F.explode(F.sequence((F.col("lo") / span).cast("long"), ((F.col("hi") - 1) / span).cast("long"))))
    cut = cut.withColumns({"lo": F.greatest("lo", F.col("_span") * span), "hi": F.least("hi", (F.col("_span") + 1) * span), "rank_price": better()})
    w = Window.partitionBy(*key, "_span")
    whole = F.col("hi") - F.col("lo") == span
    nth = F.sum(F.when(whole, 1).otherwise(0)).over(w.orderBy("rank_price").rowsBetween(Window.unboundedPreceding, 0))
    counted = cut.withColumn("nth", nth).withColumn("bound", F.min(F.when(whole & (F.col("nth") == n), F.col("rank_price"))).over(w))
    kept = counted.where(F.col("bound").isNull() | (F.col("rank_price") <= F.col("bound")))
    rows = kept.withColumn("gi", F.explode(F.sequence("lo", F.col("hi") - 1)))
    top = Window.partitionBy(*key, "gi").orderBy("rank_price")
    return rows.withColumn("k", F.row_number().over(top)).where(F.col("k") <= n).select("gi", *key, "price", "qty")


def ladder(spans: DataFrame, depth: int, round_lot: float | Column = 100.0, odd_lots: bool = True, by: list[str] = ()) -> DataFrame:
    """(by,) gi, side, level, price, qty: the consolidated book, venues' sizes summed by price. ``by``: columns that tell books apart."""
    own = spans if odd_lots else spans.where(F.col("qty") >= round_lot)
    each = standing(own, depth, [*by, "f"])
    summed = each.groupBy(*by, "gi", "side", "price").agg(F.sum("qty").alias("qty"))
    w = Window.partitionBy(*by, "gi", "side").orderBy(better())
    return summed.withColumn("level", F.row_number().over(w)).where(F.col("level") <= depth).select(*by, "gi", "side", "level", "price", "qty")


def nbbo(spans: DataFrame, round_lot: float | Column = 100.0, by: list[str] = ()) -> DataFrame:
    """(by,) gi, nbbo_bid, nbbo_ask: the best price of any venue that shows a round lot there."""
    best = standing(spans.where(F.col("qty") >= round_lot), 1, [*by, "f"])
    return best.groupBy(*by, "gi").agg(F.max(F.when(F.col("side") == "Bid", F.col("price"))).alias("nbbo_bid"), F.min(F.when(F.col("side") == "Ask", F.col("price"))).alias("nbbo_ask"))


def top_of_book(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by,) gi, bid1, ask1, mid, locked_or_crossed, crossed of a ladder."""
    one = lambda s: F.max(F.when((F.col("side") == s) & (F.col("level") == 1), F.col("price")))
    top = rows.groupBy(*by, "gi").agg(one("Bid").alias("bid1"), one("Ask").alias("ask1"))
    b, a = F.col("bid1"), F.col("ask1")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return top.select(*by, "gi", "bid1", "ask1", ((b + a) / 2).alias("mid"), flag(b >= a - EPS).alias("locked_or_crossed"), flag(b > a + EPS).alias("crossed"))


def grid(spark, points: int) -> DataFrame:
    return spark.range(points).select(F.col("id").alias("gi"))


def crossed_rate(spans: DataFrame, points: int, round_lot: float | Column = 100.0, odd_lots: bool = True, by: list[str] = ()) -> DataFrame:
    """(by,) points, crossed, locked_or_crossed, rate over the whole grid; with ``by`` only books that show any level."""
    top = top_of_book(ladder(spans, 1, round_lot, odd_lots, by), by)
    got = top.groupBy(*by).agg(F.coalesce(F.sum("crossed"), F.lit(0)).alias("crossed"), F.coalesce(F.sum("locked_or_crossed"), F.lit(0)).alias("locked_or_crossed"))
    return got.select(*by, F.lit(points).cast("long").alias("points"), "crossed", "locked_or_crossed", (F.col("crossed") / points).alias("rate"))


def book_cells(root: str, depth: int, of: Column | None = None) -> list[Column]:
    """Aggregates that make a ladder's rows the canonical columns of a book; ``of``: which rows are this book's."""
    cells = []
    for side, name in (("Bid", "bid"), ("Ask", "ask")):
        for k in range(1, depth + 1):
            at = (F.col("side") == side) & (F.col("level") == k)
            at = at if of is None else at & of
            cells += [F.max(F.when(at, F.col("price"))).alias(f"{root}_{name}price_{k}"), F.coalesce(F.max(F.when(at, F.col("qty"))), F.lit(0.0)).alias(f"{root}_{name}quantity_{k}")]
    return cells


def book_names(root: str, depth: int) -> list[str]:
    return [f"{root}_{side}{what}_{k}" for side in ("bid", "ask") for k in range(1, depth + 1) for what in ("price", "quantity")]


def book_mid(root: str) -> Column:
    return ((F.col(f"{root}_bidprice_1") + F.col(f"{root}_askprice_1")) / 2).alias(f"{root}_mid")


def wide_book(spark, rows: DataFrame, best: DataFrame, root: str, depth: int, points: int, g0_us: int, step_us: int) -> DataFrame:
    """The canonical wide book: a missing level has a null price and quantity 0."""
    names = book_names(root, depth)
    pivoted = rows.groupBy("gi").agg(*book_cells(root, depth))
    full = grid(spark, points).join(pivoted, "gi", "left").join(best, "gi", "left").fillna(0.0, [c for c in names if "quantity" in c])
    ts = F.timestamp_micros(F.lit(g0_us) + F.col("gi") * step_us)
    return full.select(ts.alias("ts"), *names, book_mid(root), F.col("nbbo_bid").alias(f"{root}_nbbo_bid"), F.col("nbbo_ask").alias(f"{root}_nbbo_ask"))


def validate(recon: DataFrame, snapshot: DataFrame, root: str, depth: int, tol: float = 1e-6) -> DataFrame:
    """field, n, match_rate, mean_abs_diff of the fields of two wide books at shared times."""
    fields = [f"{root}_bidprice_1", f"{root}_askprice_1", f"{root}_mid", *(f"{root}_{s}price_{k}" for k in range(2, depth + 1) for s in ("bid", "ask"))]
    fields = [f for f in fields if f in recon.columns and f in snapshot.columns]
    both = recon.select("ts", *[F.col(f).alias(f"a_{f}") for f in fields]).join(snapshot.select("ts", *[F.col(f).alias(f"b_{f}") for f in fields]), "ts")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])).alias("x")
    long = both.select(pairs).select("x.*").where("a is not null and b is not null")
    near = (F.abs(F.col("a") - F.col("b")) <= tol * F.greatest(F.lit(1.0), F.abs("b"))).cast("double")
    return long.groupBy("field").agg(F.count("*").alias("n"), F.avg(near).alias("match_rate"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"))

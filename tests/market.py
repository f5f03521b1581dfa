"""Message logs for the tests, always written to CSV files and read back."""

import csv
import datetime as dt
import os
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd

NY = ZoneInfo("America/New_York")


def ns(date, clock, ms=0):
    day = dt.datetime.strptime(date, "%Y%m%d")
    h, m, *s = map(int, clock.split(":"))
    return int(dt.datetime(day.year, day.month, day.day, h, m, *(s or [0]), tzinfo=NY).timestamp()) * 10**9 + ms * 10**6


def write_log(root, date, product, by_type):
    """by_type: message type -> list of dicts."""
    for kind, rows in by_type.items():
        folder = os.path.join(root, date, product, kind)
        os.makedirs(folder, exist_ok=True)
        names = list(dict.fromkeys(k for r in rows for k in r))
        with open(os.path.join(folder, "part.csv"), "w", newline="") as f:
            w = csv.DictWriter(f, names)
            w.writeheader()
            w.writerows(rows)
    return str(root)


def multi_venue(date="20250423"):
    """The orders of four venues at the open, and what happens to them two seconds later."""
    t0 = ns(date, "09:30")
    t2 = t0 + 2 * 10**9
    row = lambda t, **k: {"receipttimestamp": t, **k}
    add = lambda f, side, p, q, r: row(t0, f=f, side=side, price=p, quantity=q, orderreferencenumber=r)
    return {
        "mt_add_order": [
            add("bats_edgx", "Bid", 536.60, 150, "b1"), add("bats_edgx", "Bid", 536.50, 40, "b2"), add("bats_edgx", "Ask", 536.70, 200, "b3"),
            add("xdp_arca_integrated", "Bid", 536.65, 300, "a1"), add("xdp_arca_integrated", "Ask", 536.72, 100, "a2"),
            add("total_view", "Bid", 536.60, 50, "n1"), add("total_view", "Ask", 536.68, 300, "n2"),
        ],
        "mt_modify_order": [row(t2, f="total_view", side="Ask", price=536.69, quantity=100, previousprice=536.68, previousquantity=300, orderreferencenumber="n3", previousorderreferencenumber="n2", maintainpriority="false")],
        "mt_cancel_order": [row(t2, f="xdp_arca_integrated", side="Bid", price=536.65, previousquantity=300, orderreferencenumber="a1")],
        "mt_trade": [row(t2, f="bats_edgx", side="Bid", price=536.70, quantity=50, orderreferencenumber="b3", aggressorside="Sell")],
        "mt_price_level_update": [row(t0, f="iex_deep", side="Bid", price=536.66, quantity=500), row(t2, f="iex_deep", side="Bid", price=536.66, quantity=0)],
    }


#: The disordered log. Per cycle, feed and side one order: (type, milliseconds after
#: its add, whether at the improved price, quantity column); clocks put the cancel before the modify.
ORDER_LIFE = [("mt_add_order", 0, False, "quantity"), ("mt_modify_order", 300, True, "quantity"), ("mt_cancel_order", 100, False, "previousquantity")]
#: Cycles, seconds between them, first one; middle price, swing, cycles a radian, tick; size.
CYCLES, EVERY_S, FIRST_S, MID, SWING, PER_RADIAN, TICK, SIZE = 400, 6, 1, 470, 4, 60, 0.01, 200
VENUES, BOOK_SIDES = ["bats_edgx", "total_view"], [("Bid", -1), ("Ask", 1)]


def out_of_order(date="20240103", cycles=CYCLES, sequence=True):
    """Two feeds whose clocks put each cancel before the modify that it follows in sequence."""
    open_ns = ns(date, "09:30")
    # One row an order: the grid of cycles, venues and sides; all else is arithmetic on it.
    grid = pd.MultiIndex.from_product([range(cycles), range(2), range(2)], names=["cycle", "venue", "side"]).to_frame(index=False)
    sign = grid["side"].map(lambda k: BOOK_SIDES[k][1])
    price = (MID + SWING * np.sin(grid["cycle"] / PER_RADIAN) + sign * TICK * (1 + grid["venue"])).round(2)
    started = open_ns + (EVERY_S * grid["cycle"] + FIRST_S) * 10**9
    base = pd.DataFrame({"f": grid["venue"].map(lambda k: VENUES[k]), "side": grid["side"].map(lambda k: BOOK_SIDES[k][0]), "orderreferencenumber": [f"R{k:08d}" for k in grid.index]})
    out = {}
    for nth, (kind, after_ms, improved, quantity) in enumerate(ORDER_LIFE):
        rows = base.assign(receipttimestamp=started + after_ms * 10**6, price=(price - sign * TICK).round(2) if improved else price, **{quantity: SIZE})
        if improved:
            rows = rows.assign(previousorderreferencenumber=rows["orderreferencenumber"], previousprice=price, previousquantity=SIZE)
        if sequence:
            rows = rows.assign(sequencenumber=1 + nth + len(ORDER_LIFE) * (2 * grid["cycle"] + grid["side"]))
        out[kind] = rows.to_dict("records")
    out["mt_trade"] = [{"receipttimestamp": open_ns, "f": "none", "side": "Bid", "price": 1.0, "quantity": 0, "orderreferencenumber": "x", **({"sequencenumber": 1} if sequence else {})}]
    return out


def tape(date, start="09:30", n=60, futures=True, price=550.0):
    t0 = ns(date, start)
    return {"mt_trade": [{"receipttimestamp": t0 + k * 10**9, "f": "x", "price": round(price + 0.01 * (k % 5), 2), "quantity": 1 + k % 3, "aggressorside": ("Buy" if k % 9 < 5 else "Sell") if futures else "", "side": "Bid" if k % 9 < 5 else "Ask", "printable": "NonPrintable" if not futures and k % 7 == 0 else "Printable", "matchid": k} for k in range(n)]}

"""The diagnosis of a session: all checks, the report and the verdict."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.operators import checks, replay_checks
from tickweave.operators.replay_checks import Replay
from tickweave.plans.sessions import Window
from tickweave.schemas import MESSAGE_TYPES
from tickweave.sources import lake as lakes
from tickweave.sources import messages as src
from tickweave.staging import scratch, staged


def as_checked(msgs: DataFrame, price_scale: float = 1.0) -> DataFrame:
    """Typed messages in the columns that the checks read."""
    return msgs.select("message_type", "f", "side", (F.col("price") * price_scale).alias("price"), src.quantity(F.col("message_type")).alias("qty"), F.col("orderreferencenumber").alias("ref"), F.col("sequencenumber").alias("seq"), "ts_ns", "arrival")


def replayed(msgs: DataFrame, date: str, window: Window = Window(), price_scale: float = 1.0, order_by: str = "sequence") -> Replay:  # noqa: B008
    """The replay of a session's messages that the checks and the report share."""
    g0, step, points = window.of(date)
    return Replay.of(src.replay_events(msgs, price_scale), g0 * 1000, step * 1000, points, order_by)


def diagnose(msgs: DataFrame, date: str, window: Window = Window(), price_scale: float = 1.0, order_by: str = "sequence", replay: Replay | bool = True, ab: bool = False, failures: dict[str, str] | None = None, exact: bool = True) -> DataFrame:  # noqa: B008
    """All findings of a session's messages, the worst first. replay: whether to replay, or replayed(). exact: whether medians are."""
    msgs = staged(msgs, "messages")  # read once: logs are text
    g0, step, points = window.of(date)
    lo, hi = g0 * 1000, (g0 + step * (points - 1)) * 1000
    found = checks.frame_findings(as_checked(msgs, price_scale), lo, hi, list(failures or {}), exact)
    if replay is True:
        replay = replayed(msgs, date, window, price_scale, order_by)
    if replay:
        found = found.unionByName(replay.findings())
    if ab:
        found = found.unionByName(replay_checks.check_ordering(replay_checks.ordering_ab(src.replay_events(msgs, price_scale), lo, step * 1000, points)))
    return checks.ranked(found)


def shown(value, name: str, tz: str) -> str:
    """A value of the report; names of clocks end in _ns or are ``born``."""
    if value is not None and (name == "born" or name.endswith("_ns")):
        return dt.datetime.fromtimestamp(value // 10**9, ZoneInfo(tz)).strftime("%H:%M:%S")
    return "?" if value is None else f"{value:.6g}" if isinstance(value, float) else f"{value:,}" if isinstance(value, int) else str(value)


def report(found: DataFrame, replay: Replay | None = None, tz: str = "America/New_York") -> tuple[str, int]:
    """(text, exit code). Findings are a few rows, one for each check and feed; so are the details of a replay."""
    rows = found.collect()
    one = checks.verdict(found).first()
    lines = [f"[{r['severity']:<6}] {r['kind']} {r['check']} {r['subject']}: {r['message']} ({r['value']:.6g})" for r in rows]
    for title, few in replay.details() if replay else []:
        lines += [f"{title}: " + ", ".join(f"{k}={shown(v, k, tz)}" for k, v in r.asDict().items()) for r in few.collect()] or [f"{title}: none"]
    return "\n".join([*lines, f"verdict: {one['verdict']} (data {one['data']}, code {one['code']})"]), one["rc"]


def main(spark: SparkSession, argv: list[str]) -> int:
    """``diagnose --root R --date YYYYMMDD --product P``: prints (or writes) the report, returns the verdict's code."""
    import argparse

    p = argparse.ArgumentParser(prog="tickweave diagnose")
    for name in ("root", "date", "product"):
        p.add_argument(f"--{name}", required=name != "root", default=None)
    p.add_argument("--clock", choices=["receipt", "exchange"], default="receipt")
    p.add_argument("--order-by", choices=["sequence", "clock"], default="sequence")
    p.add_argument("--start", default="09:30")
    p.add_argument("--end", default="16:00")
    p.add_argument("--step", type=int, default=1)
    p.add_argument("--price-scale", type=float, default=1.0)
    p.add_argument("--format", default="csv")
    p.add_argument("--no-replay", action="store_true")
    p.add_argument("--ab", action="store_true")
    p.add_argument("--sketched", action="store_true", help="medians from sketches")
    p.add_argument("--messages", help="saved messages to read instead")
    p.add_argument("--lake", help="lake to read from; with --root, new files are landed there first")
    p.add_argument("--save-messages", help="folder to save the messages to")
    p.add_argument("--out", help="file for the report")
    a = p.parse_args(argv)
    with scratch(spark):
        return _main(spark, a)


def _main(spark: SparkSession, a) -> int:
    if a.messages:
        msgs, failures = src.load(spark, a.messages), {}
    elif a.lake:
        if a.root:
            lakes.land(spark, a.root, a.lake, f"{a.lake}-taken", [f"{a.date}/{a.product}"], a.format)
        msgs = lakes.read(spark, a.lake, [a.date], [a.product], clock=a.clock)
        absent = lakes.failures(spark, a.lake, [(a.date, a.product, t) for t in MESSAGE_TYPES])  # a few types
        failures = {r["message_type"]: r["reason"] for r in absent.collect()}
    else:
        msgs, failures = src.messages(spark, a.root, a.date, a.product, None, a.clock, a.format, "empty")
    if a.save_messages:
        src.save(msgs, a.save_messages)
    needed = {"mt_add_order", "mt_cancel_order", "mt_trade"}
    window, msgs = Window(a.start, a.end, a.step), staged(msgs, "messages")
    replay = None if a.no_replay else replayed(msgs, a.date, window, a.price_scale, a.order_by)
    found = staged(diagnose(msgs, a.date, window, a.price_scale, a.order_by, replay or False, a.ab, {k: v for k, v in failures.items() if k in needed}, not a.sketched), "findings")
    text, rc = report(checks.ranked(found), replay)
    print(text)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as file:
            file.write(text + "\n")
    return rc

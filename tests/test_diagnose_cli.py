"""The command line: logs, a lake, saved messages, the report's file and the exit code."""

import pytest

from tests.market import multi_venue, write_log
from tickweave.plans.diagnose import main

ARGS = ["--date", "20250423", "--product", "SPY", "--end", "09:31"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write_log(tmp_path_factory.mktemp("cli"), "20250423", "SPY", multi_venue())


def test_logs_lake_and_saved_messages_say_the_same(spark, root, tmp_path, capsys):
    texts = []
    for name, source in (("logs", ["--root", root, "--save-messages", str(tmp_path / "saved")]), ("lake", ["--root", root, "--lake", str(tmp_path / "lake")]), ("again", ["--lake", str(tmp_path / "lake")]), ("saved", ["--messages", str(tmp_path / "saved")])):
        rc = main(spark, [*ARGS, *source, "--out", str(tmp_path / f"{name}.txt")])
        text = (tmp_path / f"{name}.txt").read_text()
        assert text in capsys.readouterr().out and "verdict: " in text and "replay: " in text
        texts.append((rc, text))
    assert texts[0] == texts[1] == texts[2] == texts[3]


def test_without_replay_and_what_is_missing(spark, root, tmp_path):
    assert main(spark, [*ARGS, "--root", root, "--no-replay"]) in (0, 2, 3)
    nothing = write_log(tmp_path, "20250423", "SPY", {"mt_add_order": multi_venue()["mt_add_order"]})
    out = tmp_path / "report"
    assert main(spark, [*ARGS, "--root", nothing, "--lake", str(tmp_path / "lake"), "--out", str(out)]) in (2, 3)
    assert "could not be read" in out.read_text() and "mt_cancel_order" in out.read_text()
    with pytest.raises(SystemExit):
        main(spark, ["--root", root])

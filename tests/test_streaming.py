"""The streaming validator: files that come late, twice, after a restart or never."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from sluice.streaming import scopes as W

SHA = "a" * 40
CANON = "inherits: /\nwindow_start: 2024-01-01\nwindow_end: 2024-12-31\n\nGoverns [[Term]].\n"
VOCAB = "# VOCAB\n- [[Term]]: defined\n"
CLAIMS = json.dumps([{"text": "x", "terms": ["Term"], "evidence_commit": SHA, "evidence_date": "2024-06-01"}])
FILES = {"CANON.md": CANON, "VOCAB.md": VOCAB, "README.md": "# README\n", "claims.json": CLAIMS}


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def events(scope, minute, *names, **content):
    return [(scope, n, content.get(n.split(".")[0], FILES.get(n)), at(minute)) for n in names or FILES]


@pytest.fixture
def replay(spark, tmp_path):
    ledger = spark.createDataFrame([(0, SHA, "2024-06-01")], "pos long, sha string, committed_date string")
    folder, home = f"file://{tmp_path}/in", f"file://{tmp_path}/home"

    def send(rows):
        """Rows arrive as files of their own, and a new run goes on from the last one's state."""
        spark.createDataFrame(rows, W.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        W.run(spark, folder, ledger, home, "30 minutes")
        try:
            return {r["scope"]: (r["ts"], r["whole"], r["T"]) for r in spark.read.parquet(f"{home}/verdicts").collect()}
        except Exception:  # noqa: BLE001 - no batch yet
            return {}

    send.home = home
    return send


def test_scopes_are_judged_once_whole_across_restarts(spark, replay):
    got = replay(events("a", 0) + events("b", 1, "CANON.md", "VOCAB.md") + events("c", 2, "content.md") + events("d", 3, "CANON.md", "VOCAB.md", "claims.json"))
    assert got == {"a": (at(0), True, False)}
    # b is whole now; d gets a file again, whose later form counts, and a's late file changes nothing
    got = replay(events("b", 8, "README.md", "claims.json") + events("d", 9, "CANON.md", CANON="no front matter") + events("a", 4, "CANON.md", CANON="changed"))
    assert got == {"a": (at(0), True, False), "b": (at(8), True, False)}
    got = replay(events("d", 2, "CANON.md") + events("d", 12, "README.md"))  # an older form comes late
    assert got["d"] == (at(12), True, True) and "c" not in got
    got = replay([("", "", None, at(100))])
    got = got if "c" in got else replay([("", "", None, at(101))])
    assert got["c"] == (at(2), False, True) and len(got) == 4
    rows = {(r["window_start"], r["arm"]): (r["n"], r["rejected"], r["reject_rate"]) for r in W.rates(spark, replay.home, "10 minutes").collect()}
    assert rows[(at(0), "T")] == (3, 1, 0.333) and rows[(at(10), "T")] == (1, 1, 1.0) and rows[(at(10), "T-Evidence")] == (1, 1, 1.0)


def test_claims_are_looked_up_in_the_ledger(replay):
    bad = json.dumps([{"text": "x", "terms": [], "evidence_commit": "b" * 40, "evidence_date": "2024-06-01"}])
    got = replay(events("a", 0) + events("b", 1, claims=bad) + events("c", 1, claims="{") + [(None, "CANON.md", "x", at(1)), ("d", None, "x", at(1))])
    assert {k: v[2] for k, v in got.items()} == {"a": False, "b": True, "c": False}


def test_a_lost_batch_replaces_its_output(spark, replay, tmp_path):
    """The verdicts of a batch that is run again stand once."""
    replay(events("a", 0))
    replay(events("b", 5))
    commits = sorted(int(p.name) for p in (tmp_path / "home/state/commits").iterdir() if p.name.isdigit())
    (tmp_path / f"home/state/commits/{commits[-1]}").unlink()  # as if the driver was lost before it had noted the batch
    (tmp_path / f"home/state/commits/.{commits[-1]}.crc").unlink(missing_ok=True)
    got = replay(events("c", 6))
    out = spark.read.parquet(f"{replay.home}/verdicts")
    assert set(got) == {"a", "b", "c"} and out.count() == out.select("scope").distinct().count()


def test_rates_of_nothing_are_empty(spark, replay):
    replay([("", "", None, at(0))])
    replay(events("a", 1))
    assert W.rates(spark, replay.home).agg(F.sum("n")).first()[0] == 4


def test_a_batch_is_one_gathering_without_python(spark, replay, tmp_path):
    """No Python call or state store entry a scope: what is held is a table, of those whose time isn't over."""
    replay(events("a", 0) + events("b", 1, "CANON.md") + events("c", 60, "CANON.md") + events("d", 119) + events("e", 120, "README.md"))
    assert not (tmp_path / "home/state/state").exists()
    rows = spark.createDataFrame(events("f", 121) + events("e", 125, "CANON.md") + events("c", 89, "VOCAB.md") + events("c", 100, "VOCAB.md"), W.EVENTS)
    now = W.gathered(rows, spark.read.schema(W.SCOPES).parquet(f"{replay.home}/scopes/0"), "30 minutes")
    plan = W.judged(W.let_go(now, "30 minutes"), spark.createDataFrame([], "sha string"))._jdf.queryExecution().executedPlan().toString()
    assert "HashPartitioning" in plan or "hashpartitioning" in plan
    assert not any(word in plan for word in ("Pandas", "Python", "Arrow"))
    held = {r["scope"]: (r["ts"], r["gone"], None if r["gone"] else {f["name"]: f["ts"] for f in r["files"]}) for r in now.collect()}
    assert held == {  # a and b are let go and forgotten, d's files as well; c's last file but one is too late
        "c": (at(100), False, {"CANON.md": at(60), "VOCAB.md": at(100)}), "d": (at(119), True, None),
        "e": (at(125), False, {"README.md": at(120), "CANON.md": at(125)}), "f": (at(121), False, dict.fromkeys(FILES, at(121))),
    }


def test_files_from_before_1970_and_without_a_time(replay):
    old = at(-60 * 24 * 365 * 60)  # 1964
    got = replay([(s, n, c, old) for s, n, c, _ in events("a", 0)] + [("b", n, c, None) for _, n, c, _ in events("b", 0)])
    assert got == {"a": (old, True, False)}


def test_waiting_does_not_depend_on_the_time_zone(spark, replay):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        replay(events("a", 0, "CANON.md", "VOCAB.md"))
        assert replay(events("a", 20, "README.md", "claims.json")) == {"a": (at(20), True, False)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

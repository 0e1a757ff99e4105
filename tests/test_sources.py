"""Readers on written files, the live scoreboard, and the package without its optional part."""

import json
import os
import shutil
import subprocess
import sys

from willowfold.sources import cricket
from willowfold.streaming import scoreboard

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HEAD = ",".join(c.split()[0] for c in cricket.DELIVERIES.split(","))


def test_deliveries_and_info(spark, tmp_path):
    ball = lambda n, wides="", out="": f"11,2025/26,2025-10-01,,1,{n},{n},A,B,S,N,W,1,0,{wides},,,,,,{out},,,,F1,,"
    (tmp_path / "11.csv").write_text("\n".join([HEAD, ball("0.1"), ball("0.10", wides="1"), ball("1.1", out="caught")]) + "\n")
    info = ["team,A", "team,B", "gender,male", "match_type,T20", "date,2025/10/01", "winner,A", "winner_runs,12", "player,A,S", "player,B,W", "registry,people,S,p1", "registry,people,W,p2"]
    (tmp_path / "11_info.csv").write_text("version,2.1.0\n" + "".join(f"info,{x}\n" for x in info))
    rows = cricket.read_deliveries(spark, str(tmp_path)).orderBy("over_no", "ball_no").collect()
    assert [(r.ball, r.over_no, r.ball_no, r.wides) for r in rows] == [("0.1", 0, 1, None), ("0.10", 0, 10, 1), ("1.1", 1, 1, None)]
    assert rows[0].venue is None and rows[2].wicket_type == "caught" and rows[0].fielder_1 == "F1"
    matches, players, registry = cricket.read_match_info(spark, str(tmp_path))
    (m,) = matches.collect()
    assert (m.match_id, m.gender, m.teams, m.winner_runs, str(m.date)) == ("11", "male", ["A", "B"], 12, "2025-10-01")
    assert sorted(map(tuple, registry.collect())) == [("11", "S", "p1"), ("11", "W", "p2")] and players.count() == 2
    cricket.compact_deliveries(cricket.read_deliveries(spark, str(tmp_path)), matches, str(tmp_path / "compact"))
    back = spark.read.parquet(str(tmp_path / "compact"))
    assert back.count() == 3 and {(r.match_type, r.gender, r.year) for r in back.collect()} == {("T20", "male", 2025)}


def test_snapshot_formats(spark, tmp_path):
    role2 = [True, 50, 1278, 1779, 46, 38.7, 139.2, 78.4, 93.3, 85.8, 101.0, 99.0, 60.0, 40.0, 50.0, [[10, 120.0, 1, 2, 55.0], [5, 1, 1, 1, None], [0, 0, 0, 0, None]], ["x", "y"]]
    role3 = [False, 6, 32, 24, 0, None, 75.0, None, None, None, 120.5, 400.6, None, None, None, [[32, 61.0], [0, None], [0, None]]]
    two = {"format": 2, "meta": {}, "players": [["a", "Ann", "", "Japan", True, True, 57, ["b"], [], role2, None, [1, 0, 2]]]}
    three = {"format": 3, "meta": {}, "players": [["b", "Bob", "ボブ", "X", False, 9, role3, role3]]}
    for name, doc in (("2.json", two), ("3.json", three)):
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=False))
    rows = {(r.player_id, r.role): r for r in cricket.read_snapshot(spark, str(tmp_path)).collect()}
    assert set(rows) == {("a", "bat"), ("b", "bat"), ("b", "bowl")}
    a, b = rows["a", "bat"], rows["b", "bowl"]
    assert (a.eligible, a.balls, a.avg_or_econ, a.squad, a.matches, a.is_focus) == (True, 1278, 38.7, True, 57, True)
    assert a.phases["early"].pct == 55.0 and a.phases["middle"].balls == 5 and a.phases["middle"].pct is None
    assert (b.eligible, b.avg_or_econ, b.adj_y, b.matches, b.squad, b.name_local) == (False, None, 400.6, 9, None, "ボブ")
    assert b.phases["early"].balls == 32 and b.phases["early"].pct == 61.0


def test_rank_history_and_venues(spark, tmp_path):
    (tmp_path / "ranks").mkdir()
    (tmp_path / "ranks/a.json").write_text('{"gender":"women","date":"2025-12-28","rank":34,"matches":20,"note":"n"}\n{"gender":"men","date":"2025-12-28","rank":42}\n')
    got = {r.gender: (str(r.date), r["rank"], r.note) for r in cricket.read_rank_history(spark, str(tmp_path / "ranks")).collect()}
    assert got == {"women": ("2025-12-28", 34, "n"), "men": ("2025-12-28", 42, None)}
    (tmp_path / "venues").mkdir()
    (tmp_path / "venues/a.json").write_text('{"n":"V","p":"P","lat":35.5,"lon":139,"u":["m"]}\n')
    (v,) = cricket.read_venues(spark, str(tmp_path / "venues")).collect()
    assert (v.n, v.lat, v.lon, v.u, v.c) == ("V", 35.5, 139.0, ["m"], None)


def test_live_scoreboard_drops_replays_and_resumes(spark, tmp_path):
    ball = lambda n, runs: (1, 1, 0, n, runs, False, True)
    put = lambda rows: spark.createDataFrame(rows, scoreboard.DELIVERY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: scoreboard.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put([ball(1, 4), ball(2, 1)])
    run()
    put([ball(2, 1), ball(3, 6)])
    run()
    (row,) = scoreboard.latest(spark, str(tmp_path / "out")).collect()
    assert (row.score, row.balls) == (11, 3)


def test_package_works_without_the_corpus_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "willowfold"), tmp_path / "willowfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)

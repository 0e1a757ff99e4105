"""Stores and indexes: what they read, and that they say what a scan says."""

import datetime as dt
import itertools
import random
import re
from functools import reduce

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from willowfold.functions import nested
from willowfold.operators import incremental, name_index, serve, totals, venue_index, venues
from willowfold.operators.deliveries import delivery_flags
from willowfold.plans import queries
from willowfold.sources import store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df):
    """The plan as it ended, after the rows were made."""
    df.collect()
    return plan(df).split("Initial Plan")[0]


def balls(spark, n=600):
    rng = random.Random(1)
    rows = [(i // 20, 1 + i % 2, rng.randint(0, 9), 100 + rng.randint(0, 9), i % 20, rng.choice([0, 1, 4, 6]), 0, 0, rng.choice([None] * 9 + ["bowled"]), f"T{i % 3}", f"T{(i + 1) % 3}") for i in range(n)]
    schema = "match_id long, innings int, striker int, bowler int, over_no int, runs_off_bat int, wides int, noballs int, wicket_type string, batting_country string, bowling_country string"
    return delivery_flags(spark.createDataFrame(rows, schema).withColumn("extras", F.lit(0)))


def matches(spark, n=30):
    rows = [(i, "T20" if i % 4 else "ODI", "male" if i % 3 else "female", dt.date(2020 + i % 5, 1 + i % 12, 1 + i % 28)) for i in range(n)]
    return spark.createDataFrame(rows, "match_id long, match_type string, gender string, date date")


def test_scope_reads_its_folders_only(spark, tmp_path):
    matches(spark).write.parquet(str(tmp_path / "matches"))
    path, dated = str(tmp_path / "store"), spark.read.parquet(str(tmp_path / "matches"))
    store.write_store(balls(spark), dated, path)
    scope = {"start": dt.date(2021, 1, 1), "end": dt.date(2022, 12, 31)}
    got = store.read_scope(spark, path, dated, **scope)
    text = ran(got)
    assert re.search(r"PartitionFilters: \[[^\]]*match_type[^\]]*T20", text) and re.search(r"PartitionFilters: \[[^\]]*gender[^\]]*male", text)
    assert "dynamicpruning" in text.lower()
    want = balls(spark).join(dated.where("match_type = 'T20' and gender = 'male' and year(date) in (2021, 2022)").select("match_id", "date"), "match_id")
    columns = ["match_id", "date", "innings", "striker", "bowler", "over_no", "total_runs"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    # of the 5 x 3 folders with matches the scan opened those two years' only
    files = sum(len(list((tmp_path / "store" / f"match_type=T20/gender=male/year={y}").glob("*.parquet"))) for y in (2021, 2022))
    scans = [n for n in _nodes(got) if n.nodeName().startswith("Scan parquet") and n.metrics().contains("numFiles") and "year" in n.toString()]
    assert [n.metrics().apply("numFiles").value() for n in scans if "match_type" in n.toString()] == [files]
    assert store.read_scope(spark, path, dated, start=dt.date(1990, 1, 1), end=dt.date(1990, 2, 1)).count() == 0


def _nodes(df):
    """All nodes of the plan that ran."""
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        found.append(node)
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_buckets_need_no_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        chain = queries.bucketed_chain(spark, SF, 4)
        assert "Exchange" not in plan(chain) and "Window" in plan(chain) and "SortMergeJoin" in plan(chain)
        assert "Exchange" not in ran(chain)
        assert chain.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_loads_equal_the_whole(spark, tmp_path):
    path, every = str(tmp_path / "cells"), balls(spark)
    m = F.col("match_id")
    now = {i: None for i in range(30)}  # which version of a match counts: None, or the runs added to each ball

    def changed(k):
        return every.withColumn("runs_off_bat", F.col("runs_off_bat") + k)

    def expected():
        parts = [(every if k == 0 else changed(k)).where(m.isin([i for i, v in now.items() if v == k])) for k in {v for v in now.values() if v is not None}]
        return reduce(lambda a, b: a.unionByName(b), parts)

    steps = [(range(0, 12), 0, []), (range(12, 20), 0, []), ([3, 7, 15], 2, []), ([25], 0, [4, 7]), ([7, 4], 5, []), ([], 0, [0, 25]), ([9], 3, [9])]
    for number, (given, k, gone) in enumerate(steps):
        own = (every if k == 0 else changed(k)).where(m.isin(list(given)))
        removed = spark.createDataFrame([(i,) for i in gone], "match_id long") if gone else None
        for _ in range(1 + number % 2):  # a load that is written again is one load
            incremental.load(own, totals.role_cells, path, number, removed)
        now |= {i: None for i in gone} | {i: k for i in given}
        got = incremental.current(spark, path)
        want = totals.role_cells(expected())
        assert rows_of(got.select(want.columns)) == rows_of(want)
    incremental.compacted(spark, path, str(tmp_path / "one"))
    assert rows_of(incremental.current(spark, str(tmp_path / "one")).select(want.columns)) == rows_of(want)
    # the sixth load read what it was given only: a new folder of its own, none of the others changed
    assert sorted(p.name for p in (tmp_path / "cells/cells").iterdir() if p.is_dir()) == [f"load={i}" for i in range(7)]


NAMES = ["Ann Lee", "anna", "Banana", "選手12", "選手", "12", "", "a", "B b", "naan", "NAN", "ａｂｃ", "Ýr", "x" * 50 + "yz"]


def test_grams_find_what_a_scan_finds(spark, tmp_path):
    rows = [(i, n, n.upper(), f"C{i % 3}", True) for i, n in enumerate(NAMES * 3)]
    players = spark.createDataFrame(rows, "player long, display_name string, latin_name string, country string, is_focus boolean")
    text = name_index.searched("display_name", "latin_name", "country")
    path = str(tmp_path / "grams")
    name_index.write_grams(players, text, path, buckets=8)
    for q in ["a", "A", "an", "ana", "anan", "nana", "banana c", "選", "選手", "選手1", "手12", "2 12", "zz", " ", "", "xyz", "x" * 40, "c1", "ý", "ab", "ａｂ", "NAAN NAAN C"]:
        got = name_index.find(spark, path, players, text, q, buckets=8)
        assert rows_of(got.select("player")) == rows_of(serve.search_players(players, q).select("player")), q
    found = name_index.find(spark, path, players, text, "anan", buckets=8)
    read = [n.metrics().apply("numFiles").value() for n in (found.collect(), _nodes(found))[1] if n.nodeName().startswith("Scan parquet")]
    folders = {hash_ for hash_ in (tmp_path / "grams").glob("bucket=*")}
    assert sum(read) < sum(len(list(f.glob("*.parquet"))) for f in folders)
    assert "PushedFilters: [In(gram" in plan(found).replace("IsNotNull(gram), ", "")


def test_pages_equal_offsets(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.random() < 0.2, rng.random() < 0.5, rng.choice([None, 1.0, 2.0, 3.5])) for i in range(300)]
    table = spark.createDataFrame(rows, "player long, is_focus boolean, eligible boolean, raw_overall double").repartition(3)
    path, order = str(tmp_path / "pages"), name_index.directory_order()
    name_index.write_pages(table, order, path, parts=6)
    every = [r.player for r in table.orderBy(*order, "player").collect()]
    for offset, limit in [(0, 1), (0, 60), (59, 3), (120, 60), (290, 60), (299, 1), (300, 5), (1000, 5), (0, 1000)]:
        page = name_index.page(spark, path, order, offset, limit)
        got = page.collect()
        assert [r.player for r in got] == every[offset : offset + limit] and {r.total for r in got} <= {300}
        if limit <= 3 and got:
            assert len({p for p in page.inputFiles()}) >= 1
            parts = [n.metrics().apply("numPartitions").value() for n in _nodes(page) if n.nodeName().startswith("Scan parquet")]
            assert sum(parts) <= 2
    name_index.write_pages(table.limit(0), order, str(tmp_path / "none"), parts=6)
    assert name_index.page(spark, str(tmp_path / "none"), order, 0, 5).count() == 0


def test_bitmaps_equal_filters(spark):
    rng = random.Random(3)
    rows = [(i * 1700, f"Ground {i % 7}", rng.choice(["A", "B", None]), f"c{i % 4}", "x", 1.0, 2.0, rng.choice([None, [], ["match"], ["match", "indoor"], ["indoor", "indoor"]])) for i in range(120)]
    table = spark.createDataFrame(rows, "number long, n string, p string, c string, a string, lat double, lon double, u array<string>")
    bitmaps = venue_index.facet_bitmaps(table).cache()
    assert bitmaps.select("bucket").distinct().count() > 5
    for text, prefecture, uses in itertools.product(["", "ground 3", "C1", "none"], ["", "A"], [(), ("match",), ("indoor", "match")]):
        got = venue_index.counts_under(bitmaps, venue_index.selected(bitmaps, table, text, prefecture, uses))
        shown = venues.venue_search(table.withColumn("u", F.array_distinct("u")), text, prefecture, uses)
        want = venues.facet_counts(shown).where("facet <> 'all' or value = 'venues'").where("value is not null")
        assert rows_of(got) == rows_of(want.select("facet", "value", "n").where("n > 0")), (text, prefecture, uses)


def test_boxes_skip_row_groups(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"v{i}", rng.choice(["A", "B"]), rng.uniform(24, 46), rng.uniform(122, 146)) for i in range(6000)] + [("edge", "A", 35.0, 135.0), ("null", "A", None, 1.0), ("pole", "B", 90.0, 180.0), ("low", "B", -90.0, -180.0)]
    table = spark.createDataFrame(rows, "n string, p string, lat double, lon double")
    path = tmp_path / "curve"
    venue_index.write_curve(table, str(path), group_bytes=4096)
    for box in [(35.0, 35.0, 135.0, 135.0), (30.0, 31.0, 130.0, 131.5), (-90.0, 90.0, -180.0, 180.0), (0.0, 1.0, 0.0, 1.0), (45.9, 90.0, 145.0, 180.0)]:
        got = venue_index.in_box(spark, str(path), *box)
        want = table.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
        assert rows_of(got) == rows_of(want), box
    groups = [g for f in path.glob("*.parquet") for g in (lambda m: [m.row_group(i) for i in range(m.num_row_groups)])(pq.ParquetFile(f).metadata)]

    def meets(group):
        stats = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        return all(stats[c].has_min_max and stats[c].min <= high and stats[c].max >= low for c, low, high in (("lat", 30.0, 31.0), ("lon", 130.0, 131.5)))

    assert len(groups) >= 12 and sum(map(meets, groups)) <= len(groups) / 3
    box = venue_index.in_box(spark, str(path), 30.0, 31.0, 130.0, 131.5)
    box.collect()
    read = sum(n.metrics().apply("numOutputRows").value() for n in _nodes(box) if n.nodeName().startswith("Scan parquet"))
    assert read <= sum(g.num_rows for g in groups if meets(g)) < 6000


def test_near_points_are_near_on_the_curve(spark):
    points = spark.createDataFrame([(0.0, 0.0), (0.001, 0.001), (89.99, 179.99), (-90.0, -180.0), (90.0, 180.0)], "lat double, lon double")
    keys = [r.k for r in points.select(venue_index.curve_key(F.col("lat"), F.col("lon")).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[3] == 0 and keys[4] == (1 << 32) - 1 and keys[2] > keys[0]


# Chains of names that one value goes by.
CHAINS = {
    "latin": ["display_name", "displayName", "name", "player_name"], "local": ["name_ja", "displayNameJa"], "country": ["country", "team", "nation", "national_team"],
    "id": ["id", "player_id", "registry_id"], "matches": ["matches", "match_count", "games"],
}


def test_alias_chains(spark):
    rng = random.Random(5)
    values = ["x", "", None, 0, 7, 2.5, "3", "y z", [1], True]
    import json

    rows = []
    for i in range(200):
        names = rng.sample([n for chain in CHAINS.values() for n in chain], rng.randint(0, 9))
        rows.append((i, json.dumps({n: rng.choice(values) for n in names})))
    rows += [(1000, None), (1001, "no json"), (1002, "[]"), (1003, "null"), (1004, "7")]

    def first(text, paths):
        try:
            row = json.loads(text)
        except (TypeError, ValueError):
            return None
        for p in paths:
            value = row
            for step in p.split("."):
                value = value.get(step) if isinstance(value, dict) else None
            if value not in (None, "") or value is False or value == 0 and value != "":
                return value
        return None

    def shown(value):
        return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))

    table = spark.createDataFrame(rows, "i int, t string").withColumn("v", nested.parsed(F.col("t")))
    got = table.select("i", "t", *[nested.first_path(F.col("v"), chain).alias(n) for n, chain in CHAINS.items()], nested.first_number(F.col("v"), CHAINS["matches"], F.lit(-1.0)).alias("number")).collect()
    for r in got:
        for name, chain in CHAINS.items():
            assert r[name] == shown(first(r.t, chain)), (r.t, name)
        try:
            number = float(shown(first(r.t, CHAINS["matches"])))
        except (TypeError, ValueError):
            number = -1.0
        assert r.number == number, r.t
    deep = spark.sql("""select try_parse_json('{"a":{"b":[{"c":""},{"c":"z"}]},"d":5}') as v""")
    assert deep.select(nested.first_path(F.col("v"), ["a.b.c", "a.b[0].c", "d.e", "a.b[7].c", "a.b[1].c"])).first()[0] == "z"



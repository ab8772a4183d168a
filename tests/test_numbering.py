"""Numbering, suffixes, first-wins."""

import random

from pyspark.sql import functions as F

from conftest import rows
from graphloom.operators.numbering import first_wins, label_duplicates, number_rows, repeat_rows, running_last, suffix_duplicates, top_n


def sample(spark, n=400):
    random.seed(1)
    # One group holds most of the rows.
    data = [(random.choice("aaaaab"), i, random.choice([None, i])) for i in range(n)]
    random.shuffle(data)
    return data, spark.createDataFrame(data, "g string, o int, v int").repartition(4).cache()


def test_number_rows(spark):
    data, df = sample(spark)
    expected = []
    for g in "ab":
        expected += [(g, o, i + 1) for i, o in enumerate(sorted(o for k, o, _ in data if k == g))]
    assert rows(number_rows(df, ["g"], ["o"]), "g", "o", "seq") == sorted(expected, key=repr)


def test_number_rows_with_null_group(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("x", 5)], "g string, o int")
    assert rows(number_rows(df, ["g"], ["o"]), "o", "seq") == [(1, 1), (2, 2), (5, 1)]


def test_running_last(spark):
    data, df = sample(spark)
    expected = []
    for g in "ab":
        last = None
        for _, o, v in sorted((d for d in data if d[0] == g), key=lambda d: d[1]):
            last = v if v is not None else last
            expected.append((g, o, last))
    found = running_last(df, ["g"], ["o"], {"last": F.col("v")})
    assert rows(found, "g", "o", "last") == sorted(expected, key=repr)


def greedy(names):
    used, out = set(), []
    for name in names:
        candidate, n = name, 2
        while candidate in used:
            candidate, n = f"{name}_{n}", n + 1
        used.add(candidate)
        out.append(candidate)
    return out


def test_suffix_duplicates_matches_greedy_probing(spark):
    random.seed(4)
    data, expected = [], []
    for g in range(25):
        names = [random.choice(["a", "b", "a_2", "a_3", "a_2_2", "b_2"]) for _ in range(random.randint(1, 14))]
        data += [(f"g{g}", i, n) for i, n in enumerate(names)]
        expected += [(f"g{g}", i, n) for i, n in enumerate(greedy(names))]
    df = spark.createDataFrame(data, "g string, o int, base string").coalesce(2)
    found = suffix_duplicates(df, "base", ["g"], ["o"], "id")
    assert rows(found, "g", "o", "id") == sorted(expected, key=repr)


def test_label_duplicates(spark):
    df = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("g", 3, "y"), ("g", 4, "x")], "g string, o int, l string")
    assert rows(label_duplicates(df, "l", ["g"], ["o"], "shown"), "o", "shown") == [(1, "x"), (2, "x (2)"), (3, "y"), (4, "x (3)")]


def test_first_wins_keeps_whole_rows(spark):
    df = spark.createDataFrame([("k", 2, "late", 1.5), ("k", 1, "early", None), ("j", 9, "only", 0.5)], "key string, o int, text string, x double")
    assert rows(first_wins(df, ["key"], ["o"])) == [("j", 9, "only", 0.5), ("k", 1, "early", None)]


def test_top_n(spark):
    df = spark.createDataFrame([("g", i) for i in range(10)], "g string, o int")
    assert rows(top_n(df, ["g"], [F.desc("o")], 3), "o", "rank") == [(7, 3), (8, 2), (9, 1)]


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 3)], "k string, n long")
    expected = [("a", i) for i in range(1, 8)] + [("b", 1)] + [("c", i) for i in range(1, 4)]
    for chunk in (100, 3):
        assert rows(repeat_rows(df, "n", chunk=chunk), "k", "copy") == expected


def test_stage_tables_live_in_the_session_folder(spark):
    from graphloom.storage import StageTables, work_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert work_dir(spark).startswith(named)
    stage = StageTables(spark, "t")
    df, seen = stage.put(spark.range(5).filter("id > 9"), "empty", n=F.count(F.lit(1)))
    assert seen == {"n": 0} and df.count() == 0
    stage.append(spark.range(2), "log", 0)
    stage.append(spark.range(3), "log", 1)
    assert rows(stage.log("log").groupBy("round").count()) == [(0, 2), (1, 3)]


def test_stage_tables_can_be_dropped(spark):
    from graphloom.storage import StageTables, drop_stages

    first = StageTables(spark, "gone")
    stored, _ = first.put(spark.range(3), "rows")
    assert stored.count() == 3
    drop_stages(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(first.root)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert StageTables(spark, "again").put(spark.range(2), "rows")[0].count() == 2


def test_small_groups_need_one_shuffle(spark, capsys):
    """Groups of ordinary size are numbered without a second shuffle of their rows."""
    _, df = sample(spark)
    number_rows(df, ["g"], ["o"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_large_groups_are_spread(spark):
    data, df = sample(spark)
    expected = []
    for g in "ab":
        expected += [(g, o, i + 1) for i, o in enumerate(sorted(o for k, o, _ in data if k == g))]
    for most in (1, 100):
        assert rows(number_rows(df, ["g"], ["o"], most=most), "g", "o", "seq") == sorted(expected, key=repr)
    plain = rows(running_last(df, ["g"], ["o"], {"last": F.col("v")}), "g", "o", "last")
    assert rows(running_last(df, ["g"], ["o"], {"last": F.col("v")}, most=100), "g", "o", "last") == plain


def test_one_large_group_is_stored_once(spark):
    """The sorted rows replace the unsorted ones and hold no column that only gave their order."""
    import os

    from graphloom import storage

    df = spark.range(3_000).select(F.lit("g").alias("g"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    before = set(os.listdir(storage.work_dir(spark)))
    found = number_rows(df, ["g"], ["o"], most=100, keep=["g", "v"])
    made = {d: os.listdir(f"{storage.work_dir(spark)}/{d}") for d in set(os.listdir(storage.work_dir(spark))) - before}
    assert sorted(len(tables) for tables in made.values()) == [0, 1] and found.columns == ["g", "v", "seq"]
    expected = [r["v"] for r in df.orderBy("o").collect()]
    assert [r["v"] for r in found.orderBy("seq").collect()] == expected and found.count() == 3_000

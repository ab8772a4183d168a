import os

from pyspark.sql import functions as F

from graphloom.session import apply_runtime_settings
from graphloom.storage import StageTables


def test_tables_that_unfold_are_not_broadcast(spark, capsys):
    """A file of a few MB that unfolds to ten times as much must not be gathered by the driver."""
    apply_runtime_settings(spark)
    rows = spark.range(400_000).select(
        F.concat(F.lit("model of the part "), (F.col("id") % 4_000).cast("string")).alias("model_id"), F.xxhash64("id").alias("ordinal")
    )
    stored, _ = StageTables(spark, "unfold").put(rows.coalesce(1), "rows")
    size = sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in stored.inputFiles())
    assert 600_000 < size < 10 * 2**20
    stored.join(stored.withColumnRenamed("ordinal", "other"), "model_id").explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_bucketed_tables_are_joined_and_numbered_where_they_are(spark, capsys):
    """Tables of many small models are shuffled once, when they are stored."""
    from graphloom.operators.model.relationships import infer_relationships
    from graphloom.operators.numbering import number_rows
    from graphloom.session import keep_buckets

    apply_runtime_settings(spark)
    i = F.col("id")
    model = F.concat(F.lit("p"), (i % 50).cast("string")).alias("model_id")
    navs = spark.range(2_000).select(
        model, i.alias("ordinal"), F.concat(F.lit("e"), (i % 7).cast("string")).alias("entity"), F.concat(F.lit("e"), (i % 5).cast("string")).alias("target"),
        F.concat(F.lit("n"), i.cast("string")).alias("nav"), (i % 3 == 0).alias("is_collection"), (i % 4 == 0).alias("is_nullable"),
    )
    names = navs.select("model_id", F.explode(F.array("entity", "target")).alias("name")).distinct()
    entities = names.withColumn("is_owned", F.lit(False))

    def derived(by):
        stage = StageTables(spark, "small")
        tables = [stage.put(t, n, by)[0] for t, n in ((entities, "entities"), (navs, "navs"))]
        found = infer_relationships(*tables)
        return number_rows(found, ["model_id"], ["ordinal", "src", "dst", "rel_type"], by=by)

    expected = sorted(map(tuple, derived(None).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keep_buckets(spark)
        rows = derived("model_id")
        rows.explain()
        plan = capsys.readouterr().out
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 3
        assert sorted(map(tuple, rows.collect())) == expected and expected
    finally:
        apply_runtime_settings(spark)


def test_the_orders_model_stays_in_its_buckets(spark, capsys, monkeypatch):
    """Tables of customers with few orders are shuffled once; larger ones go the general way, to the same rows."""
    from graphloom.operators.model import owned as MO
    from graphloom.queries import models as Q

    sf = "/root/testdata/sf0.001"
    try:
        apply_runtime_settings(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        by = Q.orders_by(spark, sf)
        assert by == "model_id"
        entities, properties = Q.stored_order_model(spark, sf, by)
        MO.drawn_boxes(entities, properties, "mirror", by)[1].explain()
        plan = capsys.readouterr().out
        assert "Exchange" not in plan and "SortMergeJoin" in plan

        def drawn(mode):
            found = sorted(map(tuple, Q._erd(apply_runtime_settings(spark), sf, mode).collect()))
            return found, Q.orders_by(spark, sf)

        small = {mode: drawn(mode) for mode in MO.MODES}
        monkeypatch.setattr(Q, "MOST_ENTITIES", 10)
        for mode in MO.MODES:
            assert drawn(mode) == (small[mode][0], None) and small[mode][0] and small[mode][1] == by
    finally:
        apply_runtime_settings(spark)


def test_type_boxes_stay_in_their_buckets(spark, capsys):
    """Types, members and edges of a part are moved once; their ids and boxes are found where they are."""
    from graphloom.plans import lines as L
    from graphloom.queries import types as Q

    try:
        apply_runtime_settings(spark)
        types, members, _ = Q.corpus(spark, "/root/testdata/sf0.001", "graph_id")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ids = L.type_node_ids(types, "graph_id")
        members.join(ids, ["graph_id", "full_name"]).explain()
        plan = capsys.readouterr().out
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        general = L.type_node_ids(types)
        assert sorted(map(tuple, ids.collect()), key=repr) == sorted(map(tuple, general.select(*ids.columns).collect()), key=repr)
    finally:
        apply_runtime_settings(spark)

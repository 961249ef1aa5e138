"""The joined lines behind ``flows``: rows as plain joins give them, from the same plan at any size."""

from datetime import date

from flowguard.session import scratch_path
from flowguard.sources import fixtures


def _tables(spark, at):
    lines = [(k, p, 1, n, 1.0 * i, 10.0 + i, 0.05, 0.02, f, "F", date(1995, 1, 1 + i))
             for i, (k, p, n, f) in enumerate([(1, 1, 1, "N"), (1, 2, 2, "R"), (1, 1, 1, "N"), (2, 1, 3, "A"), (None, 1, 1, "N"), (2, None, 1, "N"), (3, 1, 1, "R"), (4, 9, 1, "A"), (5, 1, 1, "A")])]
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
              "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date")
    made = {
        "lineitem": spark.createDataFrame(lines, schema),
        "orders": spark.createDataFrame([(1, 1, 5.0, "1-URGENT"), (2, 1, 6.0, "5-LOW"), (2, 2, 6.5, "5-LOW"), (3, None, 7.0, "5-LOW"), (None, 1, 1.0, "x"), (4, 1, 1.0, "x"), (5, 77, 1.0, "x")],
                                        "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"),
        "part": spark.createDataFrame([(1, 3, 9.0), (2, 4, 8.0), (1, 5, 7.0), (None, 1, 1.0)], "p_partkey long, p_size int, p_retailprice double"),
        "customer": spark.createDataFrame([(1, 100.0, "BUILDING"), (2, 200.0, None), (None, 1.0, "x")], "c_custkey long, c_acctbal double, c_mktsegment string"),
    }
    for name, df in made.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return made


def test_joined_lines_are_those_of_plain_joins(spark, tmp_path):
    t = _tables(spark, tmp_path)
    l, o, p, c = t["lineitem"], t["orders"], t["part"], t["customer"]
    plain = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey).join(c, o.o_custkey == c.c_custkey)
    got = fixtures._flows_joined(spark, str(tmp_path))
    want = sorted(tuple(r) for r in plain.select(*got.columns).collect())
    assert len(want) == 9 and sorted(tuple(r) for r in got.collect()) == want


def test_lines_are_shuffled_twice_and_never_broadcast(spark, tmp_path):
    _tables(spark, tmp_path)
    plan = fixtures._flows_joined(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning(l_") == 2


def test_tables_by_split_are_written_without_a_sort(spark, tmp_path):
    from flowguard.session import prepare

    prepare(spark)
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) >= 3  # folders of a split
    path = scratch_path(spark, "by-split")
    rows = [(i, ("train", "val", "test")[i % 3]) for i in range(30)]
    spark.createDataFrame(rows, "i long, split string").write.partitionBy("split").parquet(path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("i", "split").collect()) == rows


def test_labels_come_from_the_lines_without_a_written_table(spark, tmp_path):
    _tables(spark, tmp_path)
    key = (spark.sparkContext.applicationId, str(tmp_path), "flows")
    got = fixtures.flow_labels(spark, str(tmp_path))
    assert key not in fixtures._memo
    read = got._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in read and "o_totalprice" not in read  # keys and flags only
    want = sorted(tuple(r) for r in fixtures.build_flows(spark, str(tmp_path)).select("class1", "class2", "class3").collect())
    assert len(want) == 9 and sorted(tuple(r) for r in got.collect()) == want
    flows = fixtures.flows(spark, str(tmp_path))
    again = fixtures.flow_labels(spark, str(tmp_path))
    assert sorted(tuple(r) for r in again.collect()) == want and again.inputFiles() and set(again.inputFiles()) == set(flows.inputFiles())

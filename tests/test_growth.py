"""Work that has to be dealt out, and tables that must not go to the driver, however small they are stored."""

from pyspark.sql import functions as F

from sievewright.functions.scanner import scan, scanned
from sievewright.operators import mentions, relational, resolve
from sievewright.plans import predicted, remove, slices, symbols
from sievewright.plans.fold import fold
from sievewright.sources.config import Accessor


def _files(spark, n):
    source = F.concat(F.lit("if (isEnabled('k')) { a("), "id", F.lit("); } else { log(KEY); }"))
    return spark.range(n, numPartitions=1).select(F.lit("k").alias("flag"), F.lit("k").alias("code_key"), F.lit(True).alias("treatment"), F.col("id").cast("string").alias("path"), F.lit("ts").alias("language"), source.alias("before"))


def test_folds_of_a_table_in_one_part_run_in_many_tasks(spark):
    done = remove.folded(_files(spark, 400), [Accessor("isEnabled")]).withColumn("task", F.spark_partition_id())
    assert done.select("task").distinct().count() > 4
    assert done.where(F.col("after") == F.concat(F.lit("a("), "path", F.lit(");"))).count() == 400


def test_predicted_blocks_of_a_table_in_one_part_run_in_many_tasks(spark):
    found = predicted.spans(_files(spark, 400), [Accessor("isEnabled")]).withColumn("task", F.spark_partition_id())
    assert found.count() == 400 and found.select("task").distinct().count() > 4


def test_a_fold_leaves_remembered_tokens_as_they_were():
    source = "const v = isEnabled('k') ? a : b;"
    for _ in range(2):
        assert fold(source, "k", True, [Accessor("isEnabled")]).after == "const v = a;"
    assert [t.text for t in scanned(source, language="ts")[0]] == [t.text for t in scan(source)[0]]


def test_cut_tables_are_not_broadcast_by_their_stored_size(spark):
    rows = spark.range(200_000).select(F.col("id"), F.repeat(F.lit("same"), 50).alias("text"))
    a, b = relational.checkpointed(rows), relational.checkpointed(rows.withColumnRenamed("text", "other"))
    assert "BroadcastHashJoin" not in a.join(b, "id")._jdf.queryExecution().executedPlan().toString()


def test_a_constant_that_many_files_begin_with_meets_its_ends_alone(spark):
    rows = [(k, "The x") for k in range(3)] + [(7, "lone word"), (8, "")]
    files = spark.createDataFrame(rows, "path long, content string")
    constants = files.select("path", F.regexp_extract("content", "[A-Za-z0-9_]+", 0).alias("name"))
    got = {r.path: r.elsewhere for r in mentions.elsewhere(constants, files).collect()}
    assert got == {0: True, 1: True, 2: True, 7: False, 8: False}
    unread = files.union(spark.createDataFrame([(9, None)], "path long, content string"))
    assert all(r.elsewhere for r in mentions.elsewhere(constants, unread).collect())


def test_an_empty_name_is_mentioned_nowhere(spark):
    files = spark.createDataFrame([(1, ""), (2, "a b")], "path long, content string")
    declared = files.select("path", F.lit("m").alias("module"), F.lit("").alias("owner"), F.when(F.col("path") == 1, "").otherwise("a").alias("name"), F.lit("k").alias("key"))
    out = resolve.resolve(declared, declared.select("path", "module", "owner", "name", F.lit(True).alias("removable")), files)
    assert sorted(r.path for r in out["deletable"].collect()) == [1, 2]


def test_the_first_owner_of_a_tie_is_that_of_the_first_row(spark, tmp_path):
    import duckdb

    rows = [(5, 1, 1, 9), (5, 1, 1, 3), (6, 2, 1, 4), (6, 1, 2, 8)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, slices.QUERIES["first_owners"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.execute(f"set threads = 1; create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
        assert got == sorted(c.execute(slices.ORACLE["first_owners"]).fetchall()) == [(5, 9), (6, 8)]


def test_files_of_one_directory_look_for_a_module_once(spark):
    """What may stand for a module's name is listed by directory, not by file, and means the same for each file."""
    asked = [(f"src/o{k}{e}", t) for k in range(50) for e, t in ((".ts", "../flags/c"), (".py", "flags.c"))] + [("/a.ts", "./b"), ("a.ts", "./b"), ("src/deep/x.ts", "../o1"), ("src/deep/x.py", "..flags.c"), ("src/o1.ts", "bare"), ("src/o2.ts", None)]
    files = [(p,) for p in ("flags/c.ts", "flags/c/index.ts", "flags/c.py", "src/flags/c.py", "/b.ts", "b.js", "src/o1.ts")]
    asked, files = spark.createDataFrame(asked, "path string, target string"), spark.createDataFrame(files, "path string")
    got = {(r.path, r.target): r.module for r in symbols.module_files(asked, files).collect()}
    want = {(f"src/o{k}{e}", t): m for k in range(50) for e, t, m in ((".ts", "../flags/c", "flags/c.ts"), (".py", "flags.c", "src/flags/c.py"))}
    assert got == want | {("/a.ts", "./b"): "/b.ts", ("a.ts", "./b"): "b.js", ("src/deep/x.ts", "../o1"): "src/o1.ts", ("src/deep/x.py", "..flags.c"): "src/flags/c.py"}
    listed = symbols.tried_modules(asked.where("target is not null")).groupBy("directory", "python", "target", "rank").count()
    assert listed.where("count > 1").isEmpty() and listed.where("directory = 'src/' AND NOT python AND target = '../flags/c'").count() == 11

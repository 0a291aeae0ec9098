import os

from tabfold import workspace


def test_staged_tables_live_in_the_shared_folder(spark):
    folder = workspace.shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    path = workspace.new_folder(spark, "x")
    assert path.startswith(folder + "/") and path != workspace.new_folder(spark, "x")


def test_stage_freezes_values(spark):
    staged = workspace.stage(spark.range(20).selectExpr("id", "rand() r"), "random")
    assert sorted(staged.collect()) == sorted(staged.collect())
    assert "Scan parquet" in staged._jdf.queryExecution().toString() or staged.inputFiles()


def test_drop_staged(spark, tmp_path):
    own = workspace._own_folder(spark)
    other = os.path.join(workspace.shared_folder(spark), "kept.txt")
    with open(other, "w") as f:
        f.write("not ours")
    staged = workspace.stage(spark.range(3), "gone")
    assert staged.count() == 3 and os.path.isdir(own)
    assert workspace.drop_staged(spark) and not os.path.exists(own) and os.path.exists(other)
    assert not workspace.drop_staged(spark)

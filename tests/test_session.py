from types import SimpleNamespace

import pytest

from tastewright.session import drop_written_table, use_checkpoint_folder, written_table


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, folder=None, **conf):
    return SimpleNamespace(
        sparkContext=Context(master, folder),
        conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
    )


def test_folder_named_by_the_cluster():
    spark = session("yarn", spark_checkpoint_dir="hdfs:///shared")
    use_checkpoint_folder(spark)
    assert spark.sparkContext.folder == "hdfs:///shared"


def test_folder_already_set_stays():
    spark = session("yarn", "hdfs:///mine", spark_checkpoint_dir="hdfs:///shared")
    use_checkpoint_folder(spark)
    assert spark.sparkContext.folder == "hdfs:///mine"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        use_checkpoint_folder(session("spark://host:7077"))


def test_local_fallback():
    spark = session("local[2]")
    use_checkpoint_folder(spark)
    assert spark.sparkContext.folder


def test_written_table(spark):
    table, path = written_table(spark.range(5))
    assert table.count() == 5
    drop_written_table(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)

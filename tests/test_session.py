import pytest

from tessella import session


class Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class Conf:
    def __init__(self, folder=None):
        self.folder = folder

    def get(self, _, default=None):
        return self.folder or default


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = Context(master), Conf(folder)


def test_shared_folder_is_named_by_the_cluster():
    assert session.shared_folder(Session("spark://host", "hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session("spark://host"))
    one = session.shared_folder(Session("local[2]"))
    assert one.startswith("file://") and one == session.shared_folder(Session("local[2]"))


def test_written_tables_are_read_back_and_discarded(spark):
    df = session.materialise(spark.range(5), "range")
    assert df.count() == 5 and df.written_at.startswith(session.shared_folder(spark))
    session.discard(df)
    place = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

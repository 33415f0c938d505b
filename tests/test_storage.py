from worldfold import storage


def test_scratch_deletes_what_is_not_kept(spark):
    df = spark.range(3)
    with storage.scratch(spark):
        gone = storage.written(df, "gone")
        with storage.scratch(spark):
            stays = storage.kept(df, "stays")
        assert stays.count() == gone.count() == 3
        out = storage.kept(stays, "out")
    assert out.count() == 3 and storage.exists(spark, out.inputFiles()[0])
    assert not any(storage.exists(spark, x) for x in (gone.inputFiles()[0], stays.inputFiles()[0]))


def test_a_folder_of_its_own_only_where_none_is_named(spark, monkeypatch):
    named = storage.shared_dir(spark)
    assert named == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    own = storage.shared_dir(Session())
    assert own != named and own == storage.shared_dir(Session())

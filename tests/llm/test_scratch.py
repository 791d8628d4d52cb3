import pytest

from strandworks.llm import scratch


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Elsewhere:
    """A session of a cluster without a shared folder."""

    conf = Conf({"spark.sql.warehouse.dir": "file:/here/warehouse"})

    class sparkContext:  # noqa: N801
        master = "yarn"

        @staticmethod
        def getConf():
            return Conf()


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        scratch.shared_dir(Elsewhere)
    Elsewhere.sparkContext.master = "local[4]"
    assert scratch.shared_dir(Elsewhere) == "file:/here/warehouse/_shared"


def test_scratch_tables_are_removed(spark):
    scratch.forget_all(spark)
    kept = scratch.keep(spark.range(10), "ten")
    assert kept.count() == 10
    assert scratch.forget_all(spark) == 1 and scratch.forget_all(spark) == 0
    with pytest.raises(Exception):
        spark.read.schema("id long").parquet(kept.inputFiles()[0]).collect()

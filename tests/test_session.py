"""The checkpoint folder comes from the session; a set value is never replaced."""

import os

from evstat import session


def test_configured_checkpoint_dir_is_honoured(spark):
    conf = spark.conf.get("spark.checkpoint.dir", None)
    got = session.checkpoint_dir(spark)
    if conf:
        assert got == conf
    assert session.checkpoint_dir(spark) == got  # stable across calls
    assert session.scratch_path(spark, "x/y") == f"{got.rstrip('/')}/x/y"
    assert session.reliable_checkpoint(spark.range(10)).count() == 10
    assert spark.sparkContext.getCheckpointDir()


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self):
        self.conf, self.sparkContext = _Conf(), _Context()


def test_unset_checkpoint_dir_gets_one_scratch_folder_without_touching_conf():
    fake = _Session()
    first = session.checkpoint_dir(fake)
    assert os.path.isdir(first) and fake.sparkContext.dir == first
    assert session.checkpoint_dir(fake) == first  # made once per context

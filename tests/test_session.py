"""The shared checkpoint folder is read from the session, not invented."""

from shelfmark.session import checkpoint_dir


def test_checkpoint_dir_is_stable(spark):
    first = checkpoint_dir(spark)
    assert first and checkpoint_dir(spark) == first
    assert spark.sparkContext.getCheckpointDir() is not None

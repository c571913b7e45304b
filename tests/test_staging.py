"""Staged tables and their removal."""

import os

import pytest

from offermarket import staging


def test_staged_tables_go_with_the_application(spark):
    kept = staging.shared_dir(spark)
    with staging.cleared(spark):
        df = staging.stage(spark.range(10), "numbers")
        assert df.count() == 10
        folder = staging.application_folder(spark)
        assert folder.startswith(kept) and os.path.isdir(folder)
    assert not os.path.exists(folder) and os.path.isdir(kept)
    staging.clear(spark)
    assert staging.stage(spark.range(3), "numbers").count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(Session())

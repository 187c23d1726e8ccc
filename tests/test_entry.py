import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from offsetlake.functions import workspace
from offsetlake.functions.schema import LogError


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_text_operators_or_a_library_of_theirs():
    """The log queries are there all the same."""
    for missing in ("zstandard", "corpus_pipeline", "offsetlake.llm"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q = set(e.queries()); assert q == set(e.oracle_sql()) and len(q) > 50 and 'pipeline' not in q"
        subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


class _Cluster:
    """A session of a cluster that names no folder."""

    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_has_to_name_its_folder():
    with pytest.raises(LogError):
        workspace.checkpoint_dir(_Cluster)

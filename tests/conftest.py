import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ferrywake.session import session

    s = session(
        "local[4]",
        **{
            "spark_sql_shuffle_partitions": "4",
            "spark_ui_enabled": "false",
            "spark_ui_showConsoleProgress": "false",
            "spark_driver_memory": "4g",
            "spark_checkpoint_dir": f"file://{tmp_path_factory.mktemp('shared')}",
            "spark_sql_warehouse_dir": f"file://{tmp_path_factory.mktemp('warehouse')}",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

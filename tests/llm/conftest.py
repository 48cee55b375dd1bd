import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures_llm import COLUMNS, hard_rows  # noqa: E402


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, columns=COLUMNS):
        return spark.createDataFrame(rows, columns)

    return make


@pytest.fixture(scope="session")
def hard(frame):
    """With extra columns whose names clash with what operators use inside."""
    from pyspark.sql import functions as F

    names = "size target score fp piece start kind __len n leaf label view held_out __row_key __file_key __doc __copies __copy __gone n_lines n_dropped copies copy end range cut m0 f0 mask_file mask_part text_hash id len pfx sha keep big __id __text gone block word c"
    return frame(hard_rows()).withColumns({c: F.lit(f"own {c}") for c in names.split()})


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])

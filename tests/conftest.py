import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paroxys.session import local_session

    session = local_session(
        8,
        "tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sequences(spark):
    """Two recordings of 0/1 decisions and scores, one of them much longer, one tiny."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for user, length in ((1, 400), (2, 37), (3, 2)):
        level = np.repeat(rng.random(length // 4 + 1), 4)[:length]
        prob = np.clip(level + rng.normal(0, 0.1, length), 0, 1)
        for k in range(length):
            rows.append((user, k, int(rng.random() < 0.35), float(prob[k]), int(prob[k] >= 0.5)))
    return spark.createDataFrame(rows, "user_id bigint, k bigint, y int, prob double, pred int")

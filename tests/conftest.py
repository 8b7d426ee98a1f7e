import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tallyspark.plans.session import local_session, ship

    session = local_session(
        4, 4, **{"spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.driver.memory": "4g"}
    )
    ship(session)
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(DATA).is_dir():
        pytest.skip("no test data here")
    return DATA

import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from reprise.llm.common import ship

    ship(spark)

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegauge.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Three series of windows with missing days, one of them long; values are integers."""
    import datetime as dt
    import random

    rng = random.Random(5)
    rows = []
    for name, days, share in (("a", 6, 0.9), ("b", 3, 0.4), ("c", 1, 1.0)):
        level = 50
        for day in range(days):
            if name == "a" and day in (2, 3):
                continue
            for slot in range(144):
                if rng.random() < share:
                    level += rng.randint(-3, 3)
                    start = dt.datetime(2024, 3, 1) + dt.timedelta(days=day, minutes=10 * slot)
                    rows.append((name, start, start + dt.timedelta(hours=1), float(level), float(rng.randint(0, 4))))
    rng.shuffle(rows)
    return spark.createDataFrame(
        rows, "protocol string, window_start timestamp_ntz, window_end timestamp_ntz, x double, y double"
    ).cache()

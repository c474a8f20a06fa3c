import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from laurel.session import local_session

    session = local_session("4", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def noms(spark):
    """A small nomination table with ties, no-winner contests and repeated people."""
    rows = [
        # period, category, cat_group, person, work, score, won
        (1, "A", "acting", "Ann Lee", "W1", 9.0, 1),
        (1, "A", "acting", "Bob Ray", "W2", 8.0, 1),
        (1, "A", "acting", "Cy Young Jr.", "W3", 7.0, 0),
        (1, "S", "series", "", "W1", 5.0, 1),
        (1, "S", "series", "", "W4", 4.0, 0),
        (2, "A", "acting", "Ann Lee", "W1", 6.0, 0),
        (2, "A", "acting", "Ann Lee", "W2", 5.0, 1),
        (2, "A", "acting", "Dot", "W4", 4.0, 0),
        (2, "B", "acting", "Bob Ray", "W2", 9.0, 0),
        (2, "B", "acting", "Ann Lee", "W5", 8.0, 0),
        (2, "S", "series", "", "W1", 5.0, 0),
        (2, "S", "series", "", "W2", 3.0, 1),
        (3, "A", "acting", "Ann Lee", "W2", 6.0, 1),
        (3, "S", "series", "", "W2", 6.0, 1),
    ]
    out = spark.createDataFrame(
        rows, "period int, category string, cat_group string, person string, work string, score double, won int"
    )
    from laurel.sources.tables import candidate_name

    return out.withColumn("candidate", candidate_name()).cache()

import pytest

from mediacat.llm.shared import BATCH_ROWS, bound_batches

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def session(spark):
    own = spark.newSession()
    own.conf.unset(ARROW_ROWS)
    return own


def test_batches_are_bounded_where_the_session_sets_no_size(session):
    bound_batches(session)
    assert session.conf.get(ARROW_ROWS) == str(BATCH_ROWS)


@pytest.mark.parametrize("rows", ["7", "20000"])
def test_a_size_that_the_session_sets_stays(session, rows):
    session.conf.set(ARROW_ROWS, rows)
    bound_batches(session)
    assert session.conf.get(ARROW_ROWS) == rows

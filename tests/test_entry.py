import __spark_entry__ as e
import compare


def test_registered():
    assert len(e.queries()) >= 30 and set(e.oracle_sql()) <= set(e.queries())


def test_same_as_sql(spark, monkeypatch):
    monkeypatch.setattr(compare, "D", "/root/testdata/sf0.001")
    from lariat.plans.queries import SQL

    assert compare.main(list(SQL)) == 0


def test_entry(spark):
    assert e.entry(spark).count() > 0

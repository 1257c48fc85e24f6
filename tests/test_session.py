import pytest

from flowloom import session


def test_tables_are_written_and_cleaned(spark):
    session.clean(spark)
    df = session.cut(spark.range(5))
    assert df.count() == 5 and session.clean(spark) == 1 and session.clean(spark) == 0


def test_small_tables_are_marked_for_broadcast(spark):
    assert "rightHint=(strategy=broadcast)" in spark.range(9).join(session.small(spark.range(3)), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in spark.range(9).join(session.small(spark.range(3), rows=2), "id")._jdf.queryExecution().optimizedPlan().toString()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "yarn"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class None_:
                            @staticmethod
                            def isDefined():
                                return False

                        return None_

                return Inner

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())

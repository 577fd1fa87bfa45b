"""The shared folder."""

import pytest

from feedlake import session


class _Context:
    master = "spark://host:7077"

    class _jsc:
        @staticmethod
        def sc():
            class Sc:
                @staticmethod
                def getCheckpointDir():
                    class Missing:
                        @staticmethod
                        def isDefined():
                            return False

                    return Missing

            return Sc


class _Session:
    sparkContext = _Context

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        session.shared_dir(_Session)

import random

import pytest

SEGMENT = "uid string, actions array<array<smallint>>, src_trace string, split string, skip int, trace string, id bigint, codes string"
EPISODE = "uid string, staged_no bigint, batch_no int, fingerprint string, actions array<bigint>, source_trace string, action_steps int, level int, task string, no string, same string"


def vector(code):
    return [code >> i & 1 for i in range(9)] if code is not None else None


@pytest.fixture(scope="session")
def make(spark):
    """Builders of small tables; the extra columns clash with names used inside the operators."""

    class Make:
        @staticmethod
        def segments(rows):
            return spark.createDataFrame([(u, [vector(c) for c in a] if a is not None else None, t, s, 3, "x", 1, "y") for u, a, t, s in rows], SEGMENT)

        @staticmethod
        def episodes(rows):
            return spark.createDataFrame([(u, n, b, f, a, t, s, lv, k, "x", "y") for u, n, b, f, a, t, s, lv, k in rows], EPISODE)

        @staticmethod
        def published(rows):
            return spark.createDataFrame(rows, "fingerprint string, batch_no int, fp string")

        @staticmethod
        def documents(rows):
            return spark.createDataFrame([(i, t, s, "w", 5) for i, t, s in rows], "doc_id bigint, text string, source string, words string, template int")

    return Make


@pytest.fixture
def rng():
    return random.Random(5)

"""Calls to a provider: retries, errors of their own, refusals, limits."""

import asyncio

from pyspark.sql import functions as F

from quillon.operators import provider
from quillon.operators.provider import Fake, Gate, answered, classified, extracted


def one(text, tries=3, valid=classified, gate=None, seconds=5.0, fake=None):
    return asyncio.run(answered(fake or Fake(), text, valid, tries, seconds, gate))


def test_retries_and_errors():
    assert one("type: x") == ('{"document_type": "x", "confidence": 0.9}', None, 1)
    assert one("type: x fail: 2")[1:] == (None, 3) and one("type: x fail: 3")[1:] == ("ConnectionError: call 3", 3)
    assert one("bad", 1)[1:] == ("ValueError: the answer holds no object", 1) and one("odd")[1:] == ("RuntimeError: broken", 1)
    assert one("type: x wild")[1].startswith("ValueError: not a confidence") and one("nothing")[1] == "ValueError: the answer names no type"
    assert one("type: x", valid=extracted)[1] == "ValueError: the answer has no fields"


def test_a_slow_call_is_ended():
    class Slow:
        async def ask(self, text):
            await asyncio.sleep(60)

    assert one("x", 2, seconds=0.05, fake=Slow())[1:] == ("TimeoutError: ", 2)


def test_refusals():
    now = [0.0]
    gate, fake = Gate(2, 60, lambda: now[0]), Fake()
    ask = lambda text: one(text, 1, gate=gate, fake=fake)[1:]
    assert ask("bad")[1] == 1 and ask("type: x") == (None, 1) and ask("bad")[1] == 1 and ask("never")[1] == 1
    assert ask("type: x") == ("refused: too many failures", 0)
    now[0] = 59.9
    assert ask("type: x")[1] == 0
    now[0] = 60.0
    assert ask("type: x") == (None, 1) and ask("bad")[1] == 1 and ask("type: x")[1] == 1


def test_rows(spark):
    rows = spark.createDataFrame([(1, "type: x"), (2, None), (3, "type: y " + "z" * 50_000), (4, "type: z fail: 1"), (None, "type: n")], "id long, text string").repartition(2)
    got = {r.id: (r.answer and r.answer[19:20], r.error, r.calls) for r in provider.asked(rows, "id", F.col("text"), Fake, retries=1).collect()}
    assert got == {1: ("x", None, 1), 2: (None, "ValueError: the answer names no type", 2), 3: ("y", None, 1), 4: ("z", None, 2), None: ("n", None, 1)}
    assert provider.asked(rows.limit(0), "id", F.col("text"), Fake).count() == 0

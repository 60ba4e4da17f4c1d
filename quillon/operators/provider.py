"""Calls to a provider of answers, such as a language model (SRC-21, UDF-07, FN-81, FN-82): asynchronous, in Arrow batches, with a retry
budget for each row.  A row whose calls all fail has an error instead of an answer, and the job goes on."""

from __future__ import annotations

import asyncio
import json
import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import head_and_tail


class Provider(Protocol):
    """One is made for each task, and closed after it if it has a close()."""

    async def ask(self, text: str) -> str: ...


#: What may go well when it is tried again.
AGAIN = (TimeoutError, ConnectionError, ValueError, KeyError, TypeError)


def body(text: str) -> dict:
    """FN-81: the object in an answer, from the first { to the last }, code fences aside."""
    found = re.search(r"\{.*\}", text or "", re.DOTALL)
    if not found:
        raise ValueError("the answer holds no object")
    return json.loads(found[0])


def classified(answer: dict) -> None:
    """FN-82: a classification names a type, and its confidence lies between 0 and 1."""
    if not answer.get("document_type"):
        raise ValueError("the answer names no type")
    confidence = answer.get("confidence")
    if not isinstance(confidence, (int, float)) or isinstance(confidence, bool) or not 0 <= confidence <= 1:
        raise ValueError(f"not a confidence: {confidence}")


def extracted(answer: dict) -> None:
    """FN-82: an extraction has an object of fields."""
    if not isinstance(answer.get("fields"), dict):
        raise ValueError("the answer has no fields")


class Gate:
    """Refuses calls for `wait` seconds after `most` rows in a row have failed; a task's own."""

    def __init__(self, most: int, wait: float, now: Callable[[], float] = time.monotonic):
        self.most, self.wait, self.now, self.failures, self.until = most, wait, now, 0, 0.0

    def open(self) -> bool:
        if self.failures >= self.most:
            if self.now() < self.until:
                return False
            self.failures = 0
        return True

    def record(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1
        if self.failures >= self.most:
            self.until = self.now() + self.wait


async def answered(provider: Provider, text: str | None, valid: Callable[[dict], None], tries: int, seconds: float, gate: Gate | None) -> tuple[str | None, str | None, int]:
    """(answer as JSON, error, calls made) for one text."""
    error, calls = None, 0
    while calls < tries:
        if gate and not gate.open():
            return None, "refused: too many failures", calls
        calls += 1
        try:
            found = body(await asyncio.wait_for(provider.ask(text), seconds))
            valid(found)
        except Exception as e:  # noqa: BLE001  a row's failure is its own
            error = f"{type(e).__name__}: {e}"
            if not isinstance(e, AGAIN):
                break
        else:
            if gate:
                gate.record(True)
            return json.dumps(found, ensure_ascii=False), None, calls
    if gate:
        gate.record(False)
    return None, error, calls


def asked(
    rows: DataFrame, key: str, text: Column, make: Callable[[], Provider], valid: Callable[[dict], None] = classified, retries: int = 2,
    at_once: int = 16, seconds: float = 60.0, most_chars: int = 8000, failures: int | None = None, wait: float = 60.0,
) -> DataFrame:
    """SRC-21: key, answer (JSON that `valid` takes), error and calls of each row.  Long texts keep their head and tail.  A task has
    `at_once` calls under way; each is ended after `seconds`; a row is tried `retries` more times; with `failures` a task's calls are
    refused for `wait` seconds after so many rows in a row have failed.  Calls cost, so write the result before it is read twice: a
    plan that is run again, and a task that is tried again, asks again."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        provider, gate = make(), Gate(failures, wait) if failures else None

        async def every(texts):
            free = asyncio.Semaphore(at_once)

            async def one(t):
                async with free:
                    return await answered(provider, t, valid, retries + 1, seconds, gate)

            return await asyncio.gather(*map(one, texts))

        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    got = asyncio.run(every(part.column(1).to_pylist()))
                    columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, "answer", "error", "calls"])
        finally:
            if hasattr(provider, "close"):
                provider.close()

    short = head_and_tail(F.coalesce(text, F.lit("")), most_chars)
    return rows.select(key, short.alias("_text")).mapInArrow(run, f"`{key}` {kind}, answer string, error string, calls int")


class Fake:
    """A provider for tests and queries: answers by rules on the text, and fails a text's first calls if it says so.

    `type: x` gives that type with confidence .9, `fail: n` fails the first n calls, `bad` gives no object, `never` isn't reached,
    `wild` gives a confidence beyond 1, `odd` raises what isn't tried again."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    async def ask(self, text: str) -> str:
        n = self.calls[text] = self.calls.get(text, 0) + 1
        fails = re.search(r"fail: (\d+)", text)
        if fails and n <= int(fails[1]):
            raise ConnectionError(f"call {n}")
        if "never" in text:
            raise TimeoutError("no answer")
        if "odd" in text:
            raise RuntimeError("broken")
        if "bad" in text:
            return "I can't say."
        kind = re.search(r"type: (\S+)", text)
        return "```json\n" + json.dumps({"document_type": kind[1] if kind else None, "confidence": 1.5 if "wild" in text else 0.9}) + "\n```"

"""Model judges: prompts are sent from tasks through a client that can be exchanged, with retries and checks of the answer."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.session import ship


class Client(Protocol):
    """Gives a model's answer and why it ended; raises what may be tried again."""

    def ask(self, key: int, prompt: str, attempt: int) -> tuple[str, str]: ...


@dataclass
class Endpoint:
    """A chat-completion service over HTTP."""

    url: str
    model: str
    headers: dict[str, str] | None = None
    timeout: float = 300.0

    def ask(self, key: int, prompt: str, attempt: int) -> tuple[str, str]:
        payload = {"model": self.model, "messages": [{"role": "user", "content": prompt}]}
        request = urllib.request.Request(self.url.rstrip("/") + "/chat/completions", json.dumps(payload).encode(), {"Content-Type": "application/json", **(self.headers or {})})
        with urllib.request.urlopen(request, timeout=self.timeout) as handle:
            choice = json.load(handle)["choices"][0]
        return choice["message"]["content"], choice.get("finish_reason") or ""


@dataclass
class Stub:
    """Judges by a rule, without a network: every seventh answer is cut off, and each fifth but one fails once."""

    def ask(self, key: int, prompt: str, attempt: int) -> tuple[str, str]:
        if key % 5 == 1 and attempt == 1:
            raise ConnectionError("busy")
        return json.dumps({"keep": 300 <= len(prompt) <= 20000 and "password" not in prompt}), "length" if key % 7 == 0 else "stop"


def one(client: Client, key: int, prompt: str, attempts: int, wait: float) -> tuple[int, str, int, str | None, str | None]:
    """(key, state, attempts, answer, error): an answer counts only if it ended by itself and is a JSON object."""
    error = None
    for attempt in range(1, attempts + 1):
        try:
            answer, reason = client.ask(key, prompt, attempt)
            if reason != "stop":
                raise ValueError(f"incomplete answer: {reason}")
            if not isinstance(json.loads(answer), dict):
                raise ValueError("the answer is no object")
            return key, "done", attempt, answer, None
        except Exception as e:  # what a client raises is its own; the last error is kept with the row
            error = f"{type(e).__name__}: {e}"[:4000]
            if attempt < attempts and wait:
                time.sleep(min(30.0, wait * 2 ** (attempt - 1)))
    return key, "error", attempts, None, error


def asked(prompts: DataFrame, client: Client, attempts: int = 3, wait: float = 1.0, at_once: int = 8) -> DataFrame:
    """``prompts(key long, prompt)`` to ``(key, state, attempts, answer, error)``, a row for each; ``at_once`` requests run at a time in a task.

    Answers come in the order of the prompts. A task that is run again
    asks again; write the result once and join what is pending to it, as
    ``journal_resume`` does.
    """
    ship(prompts.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("state", pa.string()), ("attempts", pa.int32()), ("answer", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                rows = list(pool.map(lambda x: one(client, x[0], x[1], attempts, wait), zip(*(c.to_pylist() for c in batch.columns), strict=True)))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    return prompts.select("key", "prompt").mapInArrow(run, "key long, state string, attempts int, answer string, error string")

"""Models as injected functions over columns: embedding, generation, judging.

No model comes with the library. ``Model`` wraps any function from a list of texts
to a list of answers and runs it in Arrow batches; ``stub`` answers by hash, so the
operators around a model can be run and tested without one.
"""

from __future__ import annotations

import asyncio
import hashlib
import json
import time
from collections.abc import Awaitable, Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.jsonfix import recover

Batch = Callable[[Sequence[str]], list]


def halving(fn: Batch, items: Sequence, retry: Callable[[Exception], bool]) -> list:
    """``fn`` over the items; after a failure that ``retry`` accepts, over halves, down to single items."""
    try:
        return list(fn(items))
    except Exception as e:  # what a model raises is its own
        if len(items) <= 1 or not retry(e):
            raise
    mid = len(items) // 2
    return halving(fn, items[:mid], retry) + halving(fn, items[mid:], retry)


def out_of_memory(e: Exception) -> bool:
    """Failures that smaller batches may avoid."""
    low = str(e).lower()
    return any(x in low for x in ("out of memory", "cuda", "cublas", "device-side assert"))


@dataclass(frozen=True)
class Retry:
    """Tries of a call: transient failures free what ``release`` can free and wait, an empty answer is asked once more without thinking."""

    attempts: int = 2
    wait: float = 0.8
    transient: tuple[str, ...] = ("503", "timed out", "timeout")
    release: Callable[[], None] | None = None

    def __post_init__(self):
        if self.attempts < 1:
            raise ValueError("at least one attempt is needed")

    def call(self, fn: Callable[[str, bool | None], str], prompt: str, think: bool | None = None) -> str:
        for left in range(self.attempts - 1, -1, -1):
            try:
                answer = fn(prompt, think)
                break
            except Exception as e:
                if not left or not any(x in str(e).lower() for x in self.transient):
                    raise
                if self.release:
                    self.release()
                time.sleep(self.wait)
        return answer if (answer or "").strip() or think is False else fn(prompt, False)


def structured(fn: Callable[[str, int | None], str], prompt: str, budgets: Sequence[int | None], recovery: str | None = None, most: int = 6000) -> str | None:
    """JSON from a model: with growing budgets, then by asking it to rewrite its last answer as JSON."""
    raw = ""
    for budget in budgets:
        raw = fn(prompt, budget) or ""
        if (found := recover(raw)) is not None:
            return found
    return recover(fn(recovery.replace("{text}", raw[:most]), None)) if recovery and raw.strip() else None


@dataclass(frozen=True)
class Model:
    fn: Batch
    batch: int = 64
    kind: str = "string"

    def column(self, c: Column, on_error: object = None, fail: bool = False) -> Column:
        """The answers; an item whose call fails gives ``on_error``, or ends the job with ``fail``."""
        fn, batch = self.fn, self.batch

        @F.pandas_udf(self.kind)
        def run(texts: pd.Series) -> pd.Series:
            out: list = []
            for i in range(0, len(texts), batch):
                some = texts.iloc[i : i + batch].tolist()
                try:
                    out += halving(fn, some, lambda e: not fail or out_of_memory(e))
                except Exception:
                    if fail:
                        raise
                    for t in some:
                        try:
                            out += list(fn([t]))
                        except Exception:
                            out.append(on_error)
            return pd.Series(out, index=texts.index, dtype=object)

        return run(c)


async def in_flight(ask: Callable[[str], Awaitable], prompts: Sequence[str], most: int, timeout: float | None = None, on_error: object = None, fail: bool = False) -> list:
    """Answers in the prompts' order, with at most so many calls open at a time; a call that fails or exceeds its time gives ``on_error``, or ends all with ``fail``."""
    gate = asyncio.Semaphore(max(1, most))

    async def one(prompt: str) -> object:
        async with gate:
            try:
                return await asyncio.wait_for(ask(prompt), timeout)
            except Exception:
                if fail:
                    raise
                return on_error

    tasks = [asyncio.ensure_future(one(p)) for p in prompts]
    try:
        return list(await asyncio.gather(*tasks))
    finally:
        for t in tasks:
            t.cancel()


@dataclass(frozen=True)
class Concurrent:
    """A model that is asked one prompt a call, with many calls open in a task: an event loop over each Arrow batch.

    It stands wherever a ``Model`` does. Calls that block run in threads of the loop, as many as may be open.
    """

    ask: Callable[[str], Awaitable]
    concurrency: int = 16
    timeout: float | None = None
    kind: str = "string"

    def answers(self, prompts: Sequence[str], on_error: object = None, fail: bool = False) -> list:
        async def run() -> list:
            asyncio.get_running_loop().set_default_executor(ThreadPoolExecutor(max(1, self.concurrency)))
            return await in_flight(self.ask, prompts, self.concurrency, self.timeout, on_error, fail)

        return asyncio.run(run())

    def column(self, c: Column, on_error: object = None, fail: bool = False) -> Column:
        answers = self.answers

        @F.pandas_udf(self.kind)
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(answers(texts.tolist(), on_error, fail), index=texts.index, dtype=object)

        return run(c)


def stub(prefix: str = "answer") -> Model:
    return Model(lambda texts: [f"{prefix} {hashlib.sha1((t or '').encode()).hexdigest()[:12]}" for t in texts])


def stub_judge() -> Model:
    """Judges of a kind: an item is fine if it shares a word with what it is held against."""

    def one(prompt: str) -> str:
        asked = json.loads(prompt[prompt.index("{") :])
        known = set((asked.get("against") or "").lower().split())
        return json.dumps({"verdicts": [{"verdict": "yes" if known & set(x.lower().split()) else "no", "reason": ""} for x in asked["items"]]})

    return Model(lambda prompts: [one(p) for p in prompts])


def stub_embedding(size: int = 64) -> Model:
    def fn(texts: Sequence[str]) -> list:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in (t or "").split():
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % size] += 1 if h[4] & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return Model(fn, kind="array<float>")

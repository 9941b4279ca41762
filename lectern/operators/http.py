"""Adapters for models behind a local HTTP server: chat, image description, embedding.

They are plain functions for ``models.Model`` and ``models.Retry``; a connection is
made per call in the worker, and nothing here is imported by the operators.
"""

from __future__ import annotations

import asyncio
import base64
import json
import re
import urllib.error
import urllib.request
from collections.abc import Awaitable, Callable, Sequence
from dataclasses import dataclass

from ..config import merged_options
from ..functions.text import token_budget
from .models import Concurrent, Model, Retry, structured

RECOVERY = "The text below should have been JSON of this schema, but cannot be read as such. Write what it says as one JSON value of the schema; add nothing around it.\n\nSchema: {schema}\n\nText: {text}"


@dataclass(frozen=True)
class Server:
    """A chat server: ``POST /api/chat`` with messages, ``POST /api/embed`` with inputs."""

    base_url: str
    model: str
    timeout: float | None = 180
    options: tuple[tuple[str, object], ...] = ()

    def post(self, path: str, payload: dict) -> dict:
        request = urllib.request.Request(self.base_url.rstrip("/") + path, json.dumps(payload).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310  the address is the caller's
                return json.load(reply)
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"status {e.code}: {e.read()[:500].decode(errors='replace')}") from e

    def chat(self, messages: Sequence[dict], think: bool | None = None, schema: dict | None = None, **options) -> tuple[str, str]:
        """Content and thinking of the answer; options that are null are left to the server."""
        payload = {"model": self.model, "messages": list(messages), "stream": False, "options": merged_options(dict(self.options), options)}
        payload |= merged_options({"think": think, "format": schema})
        message = self.post("/api/chat", payload).get("message") or {}
        return message.get("content") or "", message.get("thinking") or ""

    def ask(self, prompt: str, think: bool | None = None, **options) -> str:
        return self.chat([{"role": "user", "content": prompt}], think, **options)[0]

    async def ask_async(self, prompt: str, think: bool | None = None, **options) -> str:
        """``ask`` without holding the event loop."""
        return await asyncio.to_thread(self.ask, prompt, think, **options)

    def describe(self, prompt: str, image: bytes) -> str:
        return self.chat([{"role": "user", "content": prompt, "images": [base64.b64encode(image).decode()]}])[0]

    def release(self) -> None:
        """Asks the server to unload the model; failures do not matter."""
        try:
            self.post("/api/generate", {"model": self.model, "keep_alive": 0})
        except (OSError, RuntimeError, ValueError):
            pass

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return self.post("/api/embed", {"model": self.model, "input": list(texts)})["embeddings"]


def chat_model(server: Server, retry: Retry = Retry(), think: bool | None = None, batch: int = 1) -> Model:
    return Model(lambda prompts: [retry.call(server.ask, p or "", think) for p in prompts], batch)


def concurrent_chat_model(server: Server, retry: Retry = Retry(), think: bool | None = None, concurrency: int = 16, timeout: float | None = None) -> Concurrent:
    """``chat_model`` with so many calls open in each task; ``timeout`` bounds a prompt with all its tries."""
    return Concurrent(lambda prompt: asyncio.to_thread(retry.call, server.ask, prompt or "", think), concurrency, timeout)


def concurrent_judge(*args, concurrency: int = 16, timeout: float | None = None, **options) -> Concurrent:
    """``judge`` as a model with so many calls open in each task."""
    return Concurrent(judge_async(*args, **options), concurrency, timeout)


def embedding_model(server: Server, batch: int = 64) -> Model:
    return Model(server.embed, batch, "array<float>")


def judge(server: Server, schema: dict, attempts: int = 2, base: int = 256, factor: float = 2.0, most: int = 512, recover: bool = True, think: bool | None = None) -> Callable[[str], str | None]:
    """A function from a prompt to JSON text: first with the server's budget, then with growing ones, then by rewriting."""
    budgets = [token_budget(base, i, max(1.0, factor), most) for i in range(max(0, attempts) + 1)]
    text = RECOVERY.replace("{schema}", json.dumps(schema, ensure_ascii=False)) if recover else None

    def ask(prompt: str, budget: int | None) -> str:
        content, thought = server.chat([{"role": "user", "content": prompt}], think, schema, num_predict=budget)
        return content if re.search(r"\S", content) else thought

    return lambda prompt: structured(ask, prompt, budgets, text)


def judge_async(*args, **options) -> Callable[[str], Awaitable[str | None]]:
    """``judge`` for an event loop."""
    one = judge(*args, **options)
    return lambda prompt: asyncio.to_thread(one, prompt)

"""Remote model clients: embeddings, chat and pairwise scoring, with their settings.

Clients are plain picklable objects; operators ship them to executors, where each batch
makes its calls.  Nothing here is used unless a caller configures it.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, replace

RETRIES = 3
LONGEST_WAIT = 4.0


class ProviderError(RuntimeError):
    """A call that failed for good, or a reply of the wrong shape."""


def post_json(url: str, key: str, body: dict, timeout: float, retries: int = RETRIES, send: Callable | None = None, wait: Callable = time.sleep) -> dict:
    """One POST; waits 1, 2, 4 ... seconds between tries. Client errors other than 429 are not tried again."""
    request = urllib.request.Request(
        url, json.dumps(body, ensure_ascii=False).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, method="POST"
    )
    last: Exception | None = None
    for attempt in range(retries):
        try:
            with (send or urllib.request.urlopen)(request, timeout=timeout) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as error:
            if 400 <= error.code < 500 and error.code != 429:
                raise ProviderError(f"request refused with status {error.code}") from error
            last = error
        except (OSError, ValueError) as error:
            last = error
        if attempt + 1 < retries:
            wait(min(2.0**attempt, LONGEST_WAIT))
    raise ProviderError(f"request failed after {retries} tries: {last}")


@dataclass(frozen=True)
class Endpoint:
    """Where and how to call: read from the environment by ``from_env``."""

    base_url: str
    api_key: str
    model: str
    timeout: float = 60.0
    retries: int = RETRIES

    @staticmethod
    def from_env(prefix: str, model: str | None = None) -> "Endpoint":
        """``{prefix}_BASE_URL``, ``{prefix}_API_KEY`` and ``{prefix}_MODEL``; ProviderError if one is missing or a placeholder."""
        got = {name: os.environ.get(f"{prefix}_{name}", "").strip() for name in ("BASE_URL", "API_KEY", "MODEL")}
        got["MODEL"] = model or got["MODEL"]
        for name, value in got.items():
            if not value or value.lower().startswith(("your-", "changeme", "<")):
                raise ProviderError(f"{prefix}_{name} is not set")
        return Endpoint(got["BASE_URL"].rstrip("/"), got["API_KEY"], got["MODEL"])

    def with_model(self, model: str) -> "Endpoint":
        return replace(self, model=model)


class EmbeddingClient:
    """Texts to vectors over an ``/embeddings`` endpoint."""

    def __init__(self, endpoint: Endpoint, send: Callable | None = None):
        self.endpoint, self.model, self.send = endpoint, endpoint.model, send

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        e = self.endpoint
        reply = post_json(f"{e.base_url}/embeddings", e.api_key, {"model": e.model, "input": list(texts)}, e.timeout, e.retries, self.send)
        rows = reply.get("data")
        if not isinstance(rows, list) or len(rows) != len(texts):
            raise ProviderError("the reply has another number of vectors than texts")
        vectors = [[float(x) for x in row["embedding"]] for row in sorted(rows, key=lambda r: r.get("index", 0))]
        if len({len(v) for v in vectors}) != 1 or not vectors[0]:
            raise ProviderError("the reply's vectors have no common length")
        return vectors


class ChatClient:
    """Messages to a reply over a ``/chat/completions`` endpoint; a model may have an address of its own."""

    def __init__(self, endpoint: Endpoint, base_urls: dict[str, str] | None = None, send: Callable | None = None):
        self.endpoint, self.base_urls, self.send = endpoint, base_urls or {}, send

    def complete(self, model: str, messages: list[dict], response_format: dict | None = None, temperature: float = 0.0) -> str:
        e = self.endpoint
        body = {"model": model, "messages": messages, "temperature": temperature}
        if response_format:
            body["response_format"] = response_format
        reply = post_json(f"{self.base_urls.get(model, e.base_url)}/chat/completions", e.api_key, body, e.timeout, e.retries, self.send)
        try:
            text = reply["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as error:
            raise ProviderError("the reply holds no message") from error
        if not isinstance(text, str) or not text.strip():
            raise ProviderError("the reply's message is empty")
        return text.strip()


class PairScorer:
    """Scores of (question, passage) pairs by a local cross-encoder; needs the optional ``sentence_transformers``."""

    def __init__(self, model: str, batch_size: int = 16):
        self.model, self.batch_size, self._loaded = model, batch_size, None

    def __getstate__(self):
        return {**self.__dict__, "_loaded": None}

    def __call__(self, questions: list[str], passages: list[str]) -> list[float]:
        if self._loaded is None:
            try:
                from sentence_transformers import CrossEncoder
            except ImportError as error:
                raise ProviderError("the optional package sentence_transformers is not installed") from error
            self._loaded = CrossEncoder(self.model)
        return [float(s) for s in self._loaded.predict(list(zip(questions, passages)), batch_size=self.batch_size)]


MAX_TURNS, MAX_CHARS = 8, 6000


def clean_payload(payload: dict, books: list[str]) -> dict:
    """A chat request's checked fields: message, image_data, book_id, mode, history. ProviderError names what is wrong."""
    kinds = {"message": (str, ""), "image_data": (str, None), "book_id": (str, None), "mode": (str, "hybrid")}
    out = {}
    for name, (kind, default) in kinds.items():
        value = payload.get(name, default)
        if name == "book_id":
            value = value or None
        if value is not None and not isinstance(value, kind):
            raise ProviderError(f"{name} must be text")
        out[name] = value
    if out["mode"] not in ("bm25", "dense", "hybrid"):
        raise ProviderError("mode must be bm25, dense, or hybrid")
    if out["book_id"] is not None and out["book_id"] not in books:
        raise ProviderError(f"unknown book_id {out['book_id']!r}; available: {', '.join(books)}")
    turns = payload.get("history")
    said = [t for t in (turns if isinstance(turns, list) else [])[-MAX_TURNS:] if isinstance(t, dict)]
    out["history"] = [
        {"role": t["role"], "content": t["content"].strip()[:MAX_CHARS]}
        for t in said
        if t.get("role") in ("user", "assistant") and isinstance(t.get("content"), str) and t["content"].strip()
    ]
    return out

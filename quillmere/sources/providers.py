"""Language-model and embedding providers: a deterministic one for offline use, and an OpenAI-style HTTP client with retries."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

RETRY_CODES = {429, 502, 503, 504}


class Provider(Protocol):
    def chat(self, prompt: str) -> str: ...
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Deterministic:
    """No network: embeddings are signed sums over word hashes, answers are the prompt's first source and its content."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    def chat(self, prompt: str) -> str:
        m = re.search(r"--- Source 1: ([^\n|]+?)(?: \|[^\n]*)? ---\n(.*?)\n\n(?=--- Source 2: |\nQuestion: )", prompt, re.S)
        return f"{m.group(2)} ({m.group(1)})" if m else "This was not found."


@dataclass
class OpenAIStyle:
    """Chat and embeddings of any server with the OpenAI JSON interface; network errors and codes 429, 502, 503 and 504 are tried again."""

    base_url: str
    model: str
    embedding_model: str = ""
    api_key: str = ""
    prefix: str = "/v1"
    tries: int = 7
    wait: float = 2.0
    sleep: Callable[[float], None] = time.sleep
    headers: dict[str, str] = field(default_factory=dict)
    #: Tokens of the last reply, prompt and answer, as the server counts them.
    used: int | None = None

    def post(self, path: str, body: dict) -> dict:
        data = json.dumps(body).encode()
        head = {"Content-Type": "application/json", **self.headers} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.base_url.rstrip("/") + self.prefix + path, data, head), timeout=300) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code not in RETRY_CODES or n + 1 == self.tries:
                    raise
                pause = self.wait * 2**n
                if e.code == 429:
                    after = e.headers.get("Retry-After", "")
                    pause += float(after) if after.isdigit() else 5.0 * 2**n
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if n + 1 == self.tries:
                    raise
                pause = self.wait * 2**n
            self.sleep(pause)
        raise RuntimeError("unreachable")

    def chat(self, prompt: str) -> str:
        got = self.post("/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}]})
        self.used = (got.get("usage") or {}).get("total_tokens")
        return got["choices"][0]["message"]["content"]

    def see(self, prompt: str, images: list[tuple[str, bytes]]) -> str:
        """A reply to a prompt with images (MIME type, bytes), sent as data URLs."""
        parts = [{"type": "text", "text": prompt}] + [{"type": "image_url", "image_url": {"url": f"data:{mime};base64,{base64.b64encode(data).decode()}"}} for mime, data in images]
        return self.post("/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": parts}]})["choices"][0]["message"]["content"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        rows = self.post("/embeddings", {"model": self.embedding_model or self.model, "input": texts})["data"]
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


@dataclass
class OllamaNative(OpenAIStyle):
    """Embeddings by the native interface of a local server; not tried again."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        self.tries = 1
        old, self.prefix = self.prefix, ""
        try:
            return self.post("/api/embed", {"model": self.embedding_model or self.model, "input": texts})["embeddings"]
        finally:
            self.prefix = old


#: Name -> (default address, path prefix).
SERVERS = {
    "custom": ("", "/v1"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/openai", ""),
    "groq": ("https://api.groq.com/openai", "/v1"),
    "lmstudio": ("http://localhost:1234", "/v1"),
    "ollama": ("http://localhost:11434", "/v1"),
    "openai": ("https://api.openai.com", "/v1"),
    "openrouter": ("https://openrouter.ai/api", "/v1"),
    "xai": ("https://api.x.ai", "/v1"),
}


def provider(name: str, model: str = "", base_url: str = "", api_key: str = "", embedding_model: str = "") -> Provider:
    """A provider by name; ``deterministic`` needs nothing."""
    if name == "deterministic":
        return Deterministic()
    if name not in SERVERS:
        raise ValueError(f"unknown provider {name!r}; there are deterministic, {', '.join(SERVERS)}")
    address, prefix = SERVERS[name]
    if not (base_url or address):
        raise ValueError("a custom provider needs an address")
    kind = OllamaNative if name == "ollama" else OpenAIStyle
    return kind(base_url or address, model, embedding_model, api_key, prefix)

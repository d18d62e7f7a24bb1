"""Models behind one interface: a deterministic offline one, and ones that are asked over HTTP."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from typing import Protocol

from lorekeep.sources.schemas import CATEGORIES

# Requests and tokens a minute, the window and what is waited beyond it, retries and their first wait,
# tokens reserved for an answer and expected of one, and the most calls at once.
RPM, TPM, WINDOW_S, EXTRA_S, RETRIES, WAIT_S, RESERVE, EXPECTED, MOST_CALLS = 5, 30_000, 60, 0.1, 3, 5.0, 10_000, 3_000, 5
SAFE_CHUNK, TEMPERATURE, MOST_OUT, REPETITION, TOP_P = 8192, 0.3, 8192, 1.1, 0.9


class Provider(Protocol):
    is_local: bool

    def complete(self, prompt: str) -> str: ...

    def complete_structured(self, prompt: str, schema: dict) -> dict: ...


def max_concurrent(tpm: int = TPM) -> int:
    """Calls at once that the token budget allows: from 1 to MOST_CALLS."""
    return max(1, min(MOST_CALLS, tpm // (SAFE_CHUNK + EXPECTED)))


def safe_chunk_size() -> int:
    return SAFE_CHUNK


def estimate_tokens(prompt: str) -> int:
    return len(prompt) // 4 + RESERVE


class RateLimit:
    """Fixed windows of requests and tokens; one for each task, with its share of the budget."""

    def __init__(self, rpm: int = RPM, tpm: int = TPM, clock=time.monotonic, sleep=time.sleep):
        self.rpm, self.tpm, self.clock, self.sleep = max(1, rpm), max(1, tpm), clock, sleep
        self.began, self.requests, self.tokens = clock(), 0, 0

    def wait_needed(self, tokens: int) -> float:
        gone = self.clock() - self.began
        if gone >= WINDOW_S:
            self.began, self.requests, self.tokens, gone = self.clock(), 0, 0, 0.0
        full = self.requests >= self.rpm or (self.requests > 0 and self.tokens + tokens > self.tpm)
        return WINDOW_S - gone + EXTRA_S if full else 0.0

    def take(self, tokens: int) -> None:
        if (wait := self.wait_needed(tokens)) > 0:
            self.sleep(wait)
            self.began, self.requests, self.tokens = self.clock(), 0, 0
        self.requests += 1
        self.tokens += tokens


_limits: dict[tuple[int, int], RateLimit] = {}


def process_limit(rpm: int, tpm: int) -> RateLimit:
    """This process's one limit for such a budget, whichever tasks and calls it runs in turn."""
    if (rpm, tpm) not in _limits:
        _limits[rpm, tpm] = RateLimit(rpm, tpm)
    return _limits[rpm, tpm]


def with_retries(call, retriable, tries: int = RETRIES, wait: float = WAIT_S, sleep=time.sleep):
    """call() again after failures that are retriable, with doubling waits; the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            if k + 1 == tries or not retriable(e):
                raise
            sleep(wait * 2**k)


class Offline:
    """Rules instead of a model: one fact for each user line of a rendered chunk, told by its first sentence."""

    is_local = True

    def complete(self, prompt: str) -> str:
        return json.dumps(self.complete_structured(prompt, {}))

    def complete_structured(self, prompt: str, schema: dict) -> dict:
        out, conv = [], ""
        for line in prompt.split("\n"):
            if line.startswith("ID: "):
                conv = line[4:]
            elif m := re.match(r"\[User(?: \((\d{4}-\d\d-\d\d)\))?\]: (.+)", line):
                first = re.split(r"(?<=[.!?])\s", m[2])[0]
                out.append({"fact": first, "category": CATEGORIES[len(out) % len(CATEGORIES)], "source_convo_id": conv, "source_timestamp": 0.0, "source_quote": first[:60]})
        return {"facts": out}


class Chat:
    """A chat-completions server, local (any HTTP error is tried again) or remote (only 429 is); answers are JSON by schema."""

    def __init__(self, url: str, model: str, key: str | None = None, is_local: bool = True, limit: RateLimit | None = None, timeout: float = 600):
        self.url, self.model, self.key, self.is_local, self.limit, self.timeout = url, model, key, is_local, limit, timeout

    def _post(self, prompt: str, schema: dict | None) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": TEMPERATURE, "max_tokens": MOST_OUT, "top_p": TOP_P, "repetition_penalty": REPETITION}
        if schema is not None:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})

        def call() -> dict:
            if self.limit:
                self.limit.take(estimate_tokens(prompt))
            with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), head), timeout=self.timeout) as r:
                return json.loads(r.read())

        retriable = (lambda e: isinstance(e, urllib.error.URLError)) if self.is_local else (lambda e: isinstance(e, urllib.error.HTTPError) and e.code == 429)
        return with_retries(call, retriable)

    def _answer(self, prompt: str, schema: dict | None) -> str:
        got = self._post(prompt, schema)
        choices = got.get("choices") or []
        if not choices:
            if self.is_local:
                return ""
            raise RuntimeError("the answer is empty")
        message, why = choices[0].get("message") or {}, choices[0].get("finish_reason")
        text = message.get("content")
        if not self.is_local:
            if message.get("refusal"):
                raise RuntimeError("the model refused")
            if why == "length":
                raise RuntimeError("the answer was cut off")
            if not isinstance(text, str) or not text.strip():
                raise RuntimeError("the answer has no text")
        return text or ""

    def complete(self, prompt: str) -> str:
        return self._answer(prompt, None)

    def complete_structured(self, prompt: str, schema: dict) -> dict:
        text = self._answer(prompt, schema)
        if not text:
            return {}
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            near = text[max(0, e.pos - 100) : e.pos + 100]
            raise RuntimeError(f"the answer is not JSON at {e.pos}: {near!r}") from e


#: Providers by name: make(options) -> Provider. Register another here.
PROVIDERS = {"offline": lambda **_: Offline(), "local": lambda **o: Chat(is_local=True, **o), "api": lambda **o: Chat(is_local=False, **o)}


def get_provider(choice: str, **options) -> Provider:
    if choice not in PROVIDERS:
        raise ValueError(f"unknown provider: {choice}")
    return PROVIDERS[choice](**options)

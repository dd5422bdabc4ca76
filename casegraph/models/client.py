"""A chat model behind an HTTP interface: token, one retry with a fresh token, and column functions over it.

A client is made once in each task, from a picklable factory, and its token is read there; no token stands in a plan, an
argument or a log line. A task has several calls under way, in bounded number; their answers keep the order of the rows,
and a call that fails is its row's error alone.
"""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


class TokenError(RuntimeError):
    """There is no usable token."""


class Unauthorised(RuntimeError):
    """The service refuses a token."""


@dataclass(frozen=True)
class TokenFile:
    """The token in a JSON file, read anew each time."""

    path: str
    key: str = "access_token"

    def __call__(self) -> str:
        try:
            values = json.loads(Path(self.path).read_text(encoding="utf-8"))
        except FileNotFoundError as e:
            raise TokenError(f"there is no token file {self.path}") from e
        except (OSError, ValueError):  # the error's text might hold what the file holds
            raise TokenError(f"token file {self.path} can't be read as JSON") from None
        token = values.get(self.key) if isinstance(values, dict) else None
        if not isinstance(token, str) or not token.strip():
            raise TokenError(f"token file {self.path} holds no {self.key}")
        return token.strip()


@dataclass
class TokenList:
    """Tokens one after the other, for tests."""

    tokens: list[str]
    used: int = 0

    def __call__(self) -> str:
        if self.used >= len(self.tokens):
            raise TokenError(f"{len(self.tokens)} tokens were given and one more is asked for")
        self.used += 1
        return self.tokens[self.used - 1]


def post_json(url: str, token: str, body: dict) -> dict:
    """POST of a JSON body with the standard library; a 401 is Unauthorised."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    request = Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
    try:
        with urlopen(request) as answer:
            return json.load(answer)
    except HTTPError as e:
        if e.code == 401:
            raise Unauthorised(str(e)) from e
        raise


@dataclass(frozen=True)
class Calls:
    """Calls of a task at a time, tries of each, further tries of all calls of a task together, and seconds before a
    second try, doubled before each more."""

    width: int = 8
    tries: int = 3
    budget: int = 50
    pause: float = 1.0

    def __post_init__(self):
        if self.width < 1 or self.tries < 1 or self.budget < 0 or self.pause < 0:
            raise ValueError(f"no way to call: {self}")


def in_order(items: Iterable, work: Callable[[Any], Any], width: int) -> Iterator:
    """`work` of each item in their order, of `width` items at a time; no more items than that are taken ahead."""
    with ThreadPoolExecutor(width) as pool:
        under_way: deque[Future] = deque()
        for item in items:
            under_way.append(pool.submit(work, item))
            if len(under_way) == width:
                yield under_way.popleft().result()
        while under_way:
            yield under_way.popleft().result()


class Asker:
    """Calls of one task: tried again within the budget, but for tokens that are refused. `ask` gives (reply, error)."""

    def __init__(self, make_client: Callable[[], Callable[..., str]], how: Calls):
        self._make, self._client, self._how, self._left = make_client, None, how, how.budget
        self._lock = threading.Lock()

    def client(self) -> Callable[..., str]:
        with self._lock:
            self._client = self._client or self._make()
            return self._client

    def ask(self, call: Callable[[Callable[..., str]], Any]) -> tuple[Any, str | None]:
        for k in range(self._how.tries):
            try:
                return call(self.client()), None
            except Exception as e:
                if k + 1 == self._how.tries or isinstance(e, (Unauthorised, TokenError)) or not self._again():
                    return None, f"{type(e).__name__}: {e}"
                time.sleep(self._how.pause * 2**k)
        raise AssertionError

    def _again(self) -> bool:
        with self._lock:
            self._left -= 1
            return self._left >= 0


@dataclass
class ChatClient:
    """Chat completions of a model at `url`, an address that ends in /v1."""

    url: str
    model: str
    token: Callable[[], str]
    post: Callable[[str, str, dict], dict] = post_json
    _now: str | None = field(default=None, repr=False)
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def _instead_of(self, refused: str | None) -> str:
        """The token now, a fresh one if it is still the refused one: of many calls refused at once one asks for it."""
        with self._lock:
            if self._now == refused:
                self._now = self.token()
            return self._now

    def __call__(self, messages: list[dict[str, Any]], max_tokens: int, temperature: float = 0.0, extra: dict[str, Any] | None = None) -> str:
        """The reply's trimmed text, empty if it has none. A refused token is replaced once; a second refusal is an error."""
        body = {"model": self.model, "messages": messages, "max_tokens": max_tokens, "temperature": temperature} | (extra or {})
        fresh = self._now is None
        where, token = f"{self.url.rstrip('/')}/chat/completions", self._now or self._instead_of(None)
        try:
            answer = self.post(where, token, body)
        except Unauthorised:
            try:
                answer = self.post(where, self._instead_of(token), body)
            except Unauthorised as e:
                raise Unauthorised(f"the service refuses a fresh token as well{' (the first was fresh too)' if fresh else ''}: the credential is likely wrong") from e
        return (answer["choices"][0]["message"].get("content") or "").strip()


#: What a model function gives of each row: its reply, or the error of the call.
ANSWER = StructType().add("reply", StringType()).add("error", StringType())


def _answers(asker: Asker, prompts: Iterable[str], max_tokens: int, temperature: float, width: int) -> pd.DataFrame:
    one = lambda prompt: asker.ask(lambda client: client([{"role": "user", "content": prompt}], max_tokens, temperature))
    return pd.DataFrame(list(in_order(prompts, one, width)), columns=["reply", "error"], dtype=object)


def asked_of(make_client: Callable[[], Callable[..., str]], prompt: str, max_tokens: int, temperature: float = 0.0, how: Calls | None = None):
    """A model for `replies.classify`: a function of a column of texts to one of ANSWERs. `{text}` in the prompt is the text."""
    how = how or Calls()

    @F.pandas_udf(ANSWER)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        asker = Asker(make_client, how)
        for text in batches:
            yield _answers(asker, (prompt.replace("{text}", t or "") for t in text), max_tokens, temperature, how.width)

    return ask


def asked_by_type(make_client: Callable[[], Callable[..., str]], prompts: dict[str, str], max_tokens: int, temperature: float = 0.0, how: Calls | None = None):
    """A model for `replies.extract_fields`: texts and document types to ANSWERs, each type by its own prompt."""
    how = how or Calls()

    @F.pandas_udf(ANSWER)
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        asker = Asker(make_client, how)
        for text, kind in batches:
            yield _answers(asker, (prompts[k].replace("{text}", t or "") for t, k in zip(text, kind, strict=True)), max_tokens, temperature, how.width)

    return ask

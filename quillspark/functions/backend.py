"""Pluggable text generation: an injected callable behind an Arrow column function.

A backend is any picklable callable (system, messages) -> reply.  Replies that
ask for tools are served from a registry until a plain text comes back or the
limit of rounds is met, which gives null.  Nothing here calls a network; the
backends below are deterministic.
"""

from __future__ import annotations

import inspect
import json
import time
import typing
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tool rounds before a generation is given up (a fixed value).
MAX_ROUNDS = 64


@dataclass
class Reply:
    """A text, or tool calls (name, arguments)."""

    text: str | None = None
    calls: list[tuple[str, dict]] = field(default_factory=list)


@dataclass
class RuleJudge:
    """Scores a text by its length and checksum: the same text gets the same verdict."""

    suite: str = "personality"

    def __call__(self, system: str, messages: list[dict]) -> Reply:
        text = messages[-1]["content"]
        score = 1 + (zlib.crc32(f"{self.suite}|{text}".encode()) + len(text)) % 5
        return Reply(json.dumps({"score": score, "justification": f"{len(text.split())} words"}))


@dataclass
class Scripted:
    """Gives its replies in turn, by the number of replies and tool results so far."""

    replies: list[Reply]

    def __call__(self, system: str, messages: list[dict]) -> Reply:
        return self.replies[min(sum(m["role"] != "user" for m in messages), len(self.replies) - 1)]


class Tools:
    """Named callables of strings (UDF03); an unknown name in a selection is an error."""

    def __init__(self, known: dict[str, Callable]):
        self.known = known

    def select(self, names: list[str]) -> Tools:
        if missing := [n for n in names if n not in self.known]:
            raise KeyError(f"unknown tools: {', '.join(missing)}")
        return Tools({n: self.known[n] for n in names})

    def call(self, name: str, arguments: dict) -> str:
        """A result, or the error as text, for the model to see."""
        if name not in self.known:
            return f"Error: unknown tool {name}"
        try:
            return str(self.known[name](**arguments))
        except Exception as e:
            return f"Error: {e}"

    def schemas(self) -> list[dict]:
        return [tool_schema(f, name) for name, f in self.known.items()]


JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def tool_schema(f: Callable, name: str | None = None) -> dict:
    """JSON schema of a callable from its signature and docstring (UDF04)."""
    hints, props, required = typing.get_type_hints(f), {}, []
    for p in inspect.signature(f).parameters.values():
        kind = hints.get(p.name, str)
        kind = next((a for a in typing.get_args(kind) if a is not type(None)), kind) if type(None) in typing.get_args(kind) else kind
        props[p.name] = {"type": JSON_TYPES.get(typing.get_origin(kind) or kind, "string")}
        if p.default is inspect.Parameter.empty:
            required.append(p.name)
    return closed({"name": name or f.__name__, "description": inspect.getdoc(f) or "", "parameters": {"type": "object", "properties": props, "required": required}})


def closed(schema):
    """The schema with no further properties allowed at any depth (JSN03)."""
    if isinstance(schema, list):
        return [closed(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: closed(v) for k, v in schema.items()}
    if out.get("type") == "object":
        out["additionalProperties"] = False
    return out


def backoff(attempt: int, jitter: float = 0.0, first: float = 2.0, cap: float = 60.0) -> float:
    """Seconds before another attempt: doubled each time, within a quarter either way, capped (MTH05)."""
    return min(cap, first * 2**attempt) * (1 + 0.25 * max(-1.0, min(1.0, jitter)))


def with_retries(f: Callable, tries: int = 5, sleep: Callable[[float], None] = time.sleep):
    """The result of a call, tried again after transient errors (STM10); None when all fail."""
    for attempt in range(tries):
        try:
            return f()
        except (TimeoutError, ConnectionError):
            if attempt + 1 < tries:
                sleep(backoff(attempt))
    return None


def converse(backend: Callable, system: str, user: str, tools: Tools | None = None, rounds: int = MAX_ROUNDS) -> tuple[str | None, list[dict]]:
    """The final text and the log of tool calls; None if the rounds run out (UDF02, PRJ47)."""
    messages, log = [{"role": "user", "content": user}], []
    for _ in range(rounds):
        reply = backend(system, messages)
        if not reply.calls:
            return reply.text, log
        for name, arguments in reply.calls:
            result = (tools or Tools({})).call(name, arguments)
            log.append({"name": name, "arguments": json.dumps(arguments), "result": result})
            messages.append({"role": "tool", "content": result})
    return None, log


def generate(backend: Callable, system: Column, user: Column, tools: Tools | None = None) -> Column:
    """A struct of text and tool-call log for each row (UDF01)."""

    @F.pandas_udf("text string, calls array<struct<name:string,arguments:string,result:string>>")
    def run(systems: pd.Series, users: pd.Series) -> pd.DataFrame:
        out = [converse(backend, s or "", u or "", tools) for s, u in zip(systems, users)]
        return pd.DataFrame({"text": [t for t, _ in out], "calls": [c for _, c in out]})

    return run(system, user)


def batch_size(total: int, low: int = 8, high: int = 10) -> int:
    """Of the sizes allowed, that whose last batch is fullest; the larger one of equals (MTH04)."""
    return max(range(low, high + 1), key=lambda n: ((total - 1) % n + 1 if total else 0, n))

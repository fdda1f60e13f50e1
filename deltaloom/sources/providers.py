"""Reviewers that answer prompts: recorded answers, a command, an HTTP service.

A provider is a function from ``(key, prompt)`` to ``(key, response)`` rows;
prompts are answered where the rows are.
"""

from __future__ import annotations

import json
import os
import shlex
import subprocess
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import ANSWER_BYTES, SHELL_CHARACTERS
from . import caches

Provider = Callable[[DataFrame], DataFrame]
_ANSWER = "key string, response string, error string"


def _each(ask: Callable[[str], str]) -> Provider:
    """A provider that asks once for each row; an answer that fails is null with its error."""

    def run(frames):
        for f in frames:
            rows = []
            for key, prompt in zip(f["key"], f["prompt"]):
                try:
                    answer = ask(prompt)
                    if len(answer.encode()) > ANSWER_BYTES:
                        raise ValueError("the answer is too long")
                    rows.append((key, answer, None))
                except Exception as e:  # one row's failure is that row's answer
                    rows.append((key, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["key", "response", "error"])

    return lambda prompts: prompts.select("key", "prompt").mapInPandas(run, _ANSWER)


def recorded(cassettes: DataFrame, strict: bool = True) -> Provider:
    """Answers from a table ``(key, response)``."""
    return lambda prompts: caches.replay(prompts.select("key"), cassettes, strict=strict)


def plain_arguments(command: str) -> list[str]:
    """A command's words; characters that a shell reads raise an error."""
    if bad := [c for c in SHELL_CHARACTERS if c in command]:
        raise ValueError(f"{bad[0]} is not allowed in a command")
    return shlex.split(command)


def command(line: str, timeout: int = 600) -> Provider:
    """A program that reads the prompt and writes the answer."""
    words = plain_arguments(line)
    return _each(lambda prompt: subprocess.run(words, input=prompt, capture_output=True, text=True, check=True, timeout=timeout).stdout)


def http(url: str, model: str, key_variable: str | None = None, timeout: int = 600) -> Provider:
    """A service that takes ``{"model", "prompt"}`` and gives ``{"response"}``; its key is read from the environment where it is asked."""

    def ask(prompt: str) -> str:
        head = {"Content-Type": "application/json"}
        if key_variable:
            head["Authorization"] = f"Bearer {os.environ[key_variable]}"
        request = urllib.request.Request(url, json.dumps({"model": model, "prompt": prompt}).encode(), head)
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.loads(r.read(ANSWER_BYTES + 1))["response"]

    return _each(ask)


@dataclass
class Settings:
    """What a configuration says of a reviewer: kind ``recorded``, ``command`` or ``http`` and what that kind needs."""

    kind: str = "recorded"
    target: str = ""
    model: str = ""
    key_variable: str | None = None


def create(settings: Settings, cassettes: DataFrame | None = None) -> Provider:
    """The provider that the settings name; an unknown kind, or one without what it needs, raises an error."""
    if settings.kind == "recorded" and cassettes is not None:
        return recorded(cassettes)
    if settings.kind == "command" and settings.target:
        return command(settings.target)
    if settings.kind == "http" and settings.target:
        return http(settings.target, settings.model, settings.key_variable)
    raise ValueError(f"no reviewer of kind {settings.kind!r} with these settings")

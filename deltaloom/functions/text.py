"""Text scalars: token budgets, redaction, line differences, JSON in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c

# fixed values: prefixes of keys in the order in which they are replaced
KEY_PREFIXES = (("sk-ant-", "[REDACTED_ANTHROPIC_KEY]"), ("sk-proj-", "[REDACTED_OPENAI_KEY]"), ("sk-", "[REDACTED_API_KEY]"), ("AIza", "[REDACTED_GEMINI_KEY]"))


def estimate_tokens(text) -> Column:
    return F.ceil(F.octet_length(_c(text)) / 4).cast("long")


_KEY = r"[\p{L}\p{N}_-]"
#: letters from which on a string with a key's prefix is taken for a key
KEY_LETTERS = 10


def redact(text) -> Column:
    """The first 500 bytes (whole characters) with key-like tokens of ten letters or more replaced.

    Prefix after prefix; where a token with the prefix is too short to be a
    key, what stands from there on is left alone for that prefix.
    """
    out = F.when(F.octet_length(_c(text)) <= 500, _c(text)).otherwise(_byte_prefix(_c(text), 500))
    for prefix, name in KEY_PREFIXES:
        rest = KEY_LETTERS - len(prefix)
        short = rf"{prefix}{_KEY}{{0,{rest - 1}}}(?!{_KEY})"
        head = F.regexp_extract(out, rf"(?s)^(.*?)(?:{short}.*)?$", 1)
        tail = F.substr(out, F.length(head) + 1)
        out = F.concat(F.regexp_replace(head, rf"{prefix}{_KEY}{{{rest},}}", F.lit(name)), tail)
    return out


def truncate(text, budget: int) -> Column:
    """Cut to ``4 * budget`` bytes at the last line end, with a note; whole characters only."""
    t = _c(text)
    limit = 4 * budget
    note = f"\n\n... [truncated: input exceeded {budget} token budget]"
    head = _byte_prefix(t, limit)
    cut = F.when(F.contains(head, F.lit("\n")), F.regexp_extract(head, r"(?s)^(.*)\n[^\n]*$", 1)).otherwise(head)
    return F.when(t.isNull() | (F.octet_length(t) <= limit), t).otherwise(F.concat(cut, F.lit(note)))


def _byte_prefix(t: Column, limit: int) -> Column:
    """The longest prefix of whole characters of at most ``limit`` bytes."""
    raw = t.cast("binary")
    # a character has at most four bytes, so the cut goes back by at most three
    tries = [F.substring(raw, 1, limit - k) for k in range(4)]
    out = F.lit("")
    for x in reversed(tries):
        out = F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")).otherwise(out)
    return out


def _lines(text: Column) -> Column:
    """As a reader of lines sees them: no empty line behind a last line end."""
    return F.split(F.regexp_replace(text, "\n$", ""), "\n")


def line_diff(old, new) -> dict[str, Column]:
    """``added``: the new lines that the old text has nowhere, in order and repeated; ``removed``: how many the other way.

    A line is found by sorting both sides' distinct lines once (``array_except``), and counted by their sizes.
    """
    a, b = _lines(_c(old)), _lines(_c(new))
    fresh, gone = F.array_except(b, a), F.array_except(a, b)
    added = F.when(F.size(fresh) == 0, F.array().cast("array<string>")).when(F.size(F.array_intersect(a, b)) == 0,
        b).otherwise(F.filter(b, lambda x: F.array_contains(fresh, x)))
    removed = F.when(F.size(gone) == 0, 0).when(F.size(F.array_intersect(a, b)) == 0, F.size(a)).otherwise(F.size(F.filter(a, lambda x: F.array_contains(gone, x))))
    return {"added": added, "removed": removed.cast("long")}


def html_escape(text) -> Column:
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_in(text) -> Column:
    """The JSON object in an answer: inside a code fence, else from the first to the last brace."""
    t = _c(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(bare != "", bare)


# fixed values: characters that a plain command does not have
SHELL_CHARACTERS = ("`", "$", "|", ";", "&", "<", ">")
#: bytes of an answer that are read
ANSWER_BYTES = 10 << 20


def is_plain_command(command) -> Column:
    """Whether a command that fetches a key has no character that a shell reads."""
    out = F.lit(True)
    for x in SHELL_CHARACTERS:
        out = out & ~F.contains(_c(command), F.lit(x))
    return out


def fits(answer) -> Column:
    return F.octet_length(_c(answer)) <= ANSWER_BYTES


def flat_schema(schema: dict) -> dict:
    """A JSON schema with its ``$defs`` put where they are referred to, and no property beyond those named.

    A definition that refers to itself raises an error.
    """
    defs = schema.get("$defs") or schema.get("definitions") or {}

    def walk(node, within=()):
        if isinstance(node, list):
            return [walk(x, within) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            name = node["$ref"].rsplit("/", 1)[-1]
            if name in within:
                raise ValueError(f"{name} refers to itself")
            return walk(defs[name] | {k: v for k, v in node.items() if k != "$ref"}, (*within, name))
        out = {k: walk(v, within) for k, v in node.items() if k not in ("$defs", "definitions")}
        return out | {"additionalProperties": False} if out.get("type") == "object" and "properties" in out else out

    return walk(schema)

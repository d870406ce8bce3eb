"""Tolerant reading of model output that should be a JSON object."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame

STATUSES = ("strict", "recovered", "failed", "no_response")
_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_FENCE = re.compile(r"^```[\w-]*\s*\n?(.*?)\n?```$", re.S)
_KEY = re.compile(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)")
_TRAILING = re.compile(r",(\s*[}\]])")
_CLOSERS = {"{": "}", "[": "]"}


def _balanced(s: str) -> str:
    """``s`` with an open string and open brackets closed, and closers nobody opened dropped."""
    out, stack, quoted, skip = [], [], False, False
    for c in s:
        if quoted:
            skip, quoted = (not skip and c == "\\"), not (c == '"' and not skip)
        elif c == '"':
            quoted = True
        elif c in _CLOSERS:
            stack.append(_CLOSERS[c])
        elif c in "}]":
            if not stack or stack.pop() != c:
                continue
        out.append(c)
    return "".join(out) + '"' * quoted + "".join(reversed(stack))


def recover(raw: str | None) -> tuple[str, str | None]:
    """(status, canonical JSON of the object or None)."""
    text = _THINK.sub("", raw or "").strip()
    if m := _FENCE.match(text):
        text = m[1].strip()
    if not text:
        return "no_response", None

    def done(value: object, status: str) -> tuple[str, str | None]:
        if not isinstance(value, dict):
            return "failed", None
        return status, json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    try:
        return done(json.loads(text), "strict")
    except ValueError:
        pass
    start = text.find("{")
    if start < 0:
        return "failed", None
    body = text[start:]
    last = body.rfind("}")
    for part in ([body[: last + 1]] if last > 0 else []) + [body]:
        for fix in (lambda s: s, lambda s: _KEY.sub(r'\1"\2"\3', s), lambda s: _KEY.sub(r'\1"\2"\3', s.replace("'", '"'))):
            try:
                return done(json.loads(_TRAILING.sub(r"\1", _balanced(fix(part)))), "recovered")
            except ValueError:
                continue
        try:
            return done(ast.literal_eval(part), "recovered")
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
    return "failed", None


def recover_json(rows: DataFrame, text: str, status: str = "parse_status", value: str = "parsed") -> DataFrame:
    """Adds the parse status and the canonical JSON object of a text column."""
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [recover(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s for s, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], names=[*b.schema.names, status, value])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields)}, {status} string, {value} string")

"""JSON of models and logs: tolerant reading, canonical form and hashes, redaction at any depth.

Each rule works on one value; ``columns`` at the end give them as Arrow-batched column functions.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from typing import Any

from millrace.functions.markup import batch
from millrace.functions.text import SECRET_NAMES

# Normalised keys whose values are replaced, and keys that are left out.
FORBIDDEN_KEYS = frozenset(
    "accesstoken apikey authtoken authorization chainofthought cookie credential idtoken password refreshtoken secret sessiontoken token thoughts".split()
)
DROPPED_KEYS = frozenset(("reasoning", "reasoningcontent"))

_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_BEARER = re.compile(r"\bbearer\s+[A-Za-z0-9._~+/-]+=*", re.I)
_SECRET = re.compile(rf"\b({'|'.join(SECRET_NAMES)})\s*[:=]\s*(?!\[REDACTED\])([^\s,;]+)", re.I)


def _spans(text: str, opening: str, closing: str) -> Iterator[str]:
    """Balanced stretches from each opening mark, strings left alone."""
    for start in (m.start() for m in re.finditer(re.escape(opening), text)):
        depth, quoted, skip = 0, False, False
        for at in range(start, len(text)):
            char = text[at]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = char == "\\", char != '"'
            elif char == '"':
                quoted = True
            elif char == opening:
                depth += 1
            elif char == closing:
                depth -= 1
                if not depth:
                    yield text[start : at + 1]
                    break
        return


def tolerant(text: str | None) -> Any:
    """The JSON in an answer: inside a code fence, the whole, the outermost object, then the outermost list; None if there is none."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S | re.I)
    for candidate in ([fenced[1]] if fenced else []) + [text, *_spans(text, "{", "}"), *_spans(text, "[", "]")]:
        try:
            return json.loads(candidate.strip())
        except ValueError:
            continue
    return None


def tolerant_list(text: str | None) -> list[Any]:
    """The list in an answer; of one that was cut off, its whole objects and strings."""
    if not text:
        return []
    found = tolerant(text)
    if isinstance(found, list):
        return found
    start = text.find("[")
    if start < 0:
        return []
    out, rest = [], text[start + 1 :]
    reader = json.JSONDecoder()
    while (rest := rest.lstrip(" \t\r\n,")) and rest[0] != "]":
        try:
            value, used = reader.raw_decode(rest)
        except ValueError:
            break
        out.append(value)
        rest = rest[used:]
    return out


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, no escapes; not-a-number is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_hash(text: str | None) -> str | None:
    """Hash of the canonical form of a JSON text; null if it can't be read."""
    if text is None:
        return None
    try:
        return "sha256:" + hashlib.sha256(canonical(json.loads(text)).encode()).hexdigest()
    except ValueError:
        return None


def call_fingerprint(text: str | None) -> str | None:
    """Hash of a tool call's name and arguments; null unless it is an object with both, free of not-a-number."""
    call = tolerant(text)
    if not isinstance(call, dict) or not isinstance(call.get("arguments"), dict):
        return None
    try:
        return "sha256:" + hashlib.sha256(canonical({"name": call.get("name"), "arguments": call["arguments"]}).encode()).hexdigest()
    except ValueError:
        return None


def redacted_text(text: str) -> str:
    return _SECRET.sub(lambda m: f"{m[1]}=[REDACTED]", _BEARER.sub("Bearer [REDACTED]", _THINK.sub("", text)))


def redacted_value(value: Any) -> Any:
    """Texts redacted, values of forbidden keys replaced, reasoning left out, at any depth."""
    if isinstance(value, str):
        return redacted_text(value)
    if isinstance(value, list):
        return [redacted_value(v) for v in value]
    if isinstance(value, dict):
        plain = {k: re.sub(r"[^a-z0-9]", "", k.lower()) for k in value}
        return {k: "[REDACTED]" if plain[k] in FORBIDDEN_KEYS else redacted_value(v) for k, v in value.items() if plain[k] not in DROPPED_KEYS}
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return value


def redacted_json(text: str | None) -> str | None:
    """A JSON text redacted at any depth; text that is no JSON is redacted as text."""
    if text is None:
        return None
    try:
        return json.dumps(redacted_value(json.loads(text)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return redacted_text(text)


TYPES = ("text", "number", "boolean", "date", "select")


def proposed_columns(proposed: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Checked column proposals: snake-case keys, each once, unknown types text; without name or description they are left out."""
    out: list[dict[str, Any]] = []
    taken: set[str] = set()
    for column in proposed:
        name, description = str(column.get("name") or column.get("key") or "").strip(), str(column.get("description") or "").strip()
        key = re.sub(r"[^a-z0-9]+", "_", str(column.get("key") or name).lower()).strip("_")
        if not key or not description:
            continue
        key = f"col_{key}" if key[0].isdigit() else key
        if key in taken:
            continue
        taken.add(key)
        kind = str(column.get("type") or "").lower()
        out.append({"key": key, "name": name or key, "type": kind if kind in TYPES else "text", "description": description, "required": bool(column.get("required"))})
    return out


to_content_hash = batch(content_hash, "string")
to_fingerprint = batch(call_fingerprint, "string")
to_redacted_json = batch(redacted_json, "string")
to_list = batch(lambda text: [canonical(v) for v in tolerant_list(text)], "array<string>")

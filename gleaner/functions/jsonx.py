"""JSON: schema inference, lenient parsing, and readers of model responses."""

from __future__ import annotations

import json
import re

FLAGS = {
    "reasoning": ("analyze", "compare", "explain", "why"), "code": ("code", "function", "implement", "script"), "structured": ("extract", "json", "list"),
    "steps": ("first", "next", "step", "then"), "vision": ("image", "picture", "screenshot", "visual"), "audio": ("audio", "speech", "voice"),
}


def flag(d, text: str, name: str) -> str:
    return "(" + " or ".join(f"instr(lower({text}), '{w}') > 0" for w in FLAGS[name]) + ")"


def loads(s: str):
    return json.loads(s)


def dumps(v) -> str:
    return json.dumps(v, sort_keys=True, ensure_ascii=False)


def infer_schema(v) -> dict:
    """JSON Schema of one value: arrays by their first element, all fields of an object required."""
    if isinstance(v, bool):
        return {"type": "boolean"}
    if isinstance(v, int):
        return {"type": "integer"}
    if isinstance(v, float):
        return {"type": "number"}
    if isinstance(v, str):
        return {"type": "string"}
    if v is None:
        return {"type": "null"}
    if isinstance(v, list):
        return {"type": "array", "items": infer_schema(v[0]) if v else {}}
    return {"type": "object", "properties": {k: infer_schema(x) for k, x in v.items()}, "required": sorted(v)}


def merge_schemas(schemas: list[dict]) -> dict:
    """Of several: a field is required only if required in all; differing types become oneOf (repeats kept)."""
    if not schemas:
        return {}
    if all(s == schemas[0] for s in schemas):
        return schemas[0]
    if all(s.get("type") == "object" for s in schemas):
        names = sorted({k for s in schemas for k in s["properties"]})
        return {"type": "object", "properties": {k: merge_schemas([s["properties"][k] for s in schemas if k in s["properties"]]) for k in names}, "required": [k for k in names if all(k in s["required"] for s in schemas)]}
    return {"oneOf": schemas}


def confidence(examples: int) -> float:
    return 0.0 if examples == 0 else 0.5 if examples == 1 else 0.7 if examples < 4 else 0.9


def last_code_block(s: str) -> str | None:
    """The last fence marked json that isn't empty (an unclosed one runs to the end), else the last fence of any kind."""
    for pattern in (r"```json\s*\n?(.*?)(?:```|\Z)", r"```[a-zA-Z]*\s*\n?(.*?)(?:```|\Z)"):
        found = [m.strip() for m in re.findall(pattern, s, re.S) if m.strip()]
        if found:
            return found[-1]
    return None


def last_balanced(s: str, opening: str) -> str | None:
    """The last balanced {...} or [...] outside strings."""
    closing = {"{": "}", "[": "]"}[opening]
    best, depth, start, quoted, escaped = None, 0, -1, False, False
    for i, c in enumerate(s):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
            continue
        if c == '"' and depth:
            quoted = True
        elif c == opening:
            if not depth:
                start = i
            depth += 1
        elif c == closing and depth:
            depth -= 1
            if not depth:
                best = s[start : i + 1]
    return best


def repair_braces(s: str) -> str:
    """Drops closing braces that close nothing, and closes what is open at the end; strings are left alone."""
    out, stack, quoted, escaped = [], [], False, False
    for c in s:
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack[-1] != c:
                continue
            stack.pop()
        out.append(c)
    return "".join(out) + ('"' if quoted else "") + "".join(reversed(stack))


def quote_bare_words(s: str) -> str:
    """Quotes values that are bare words (not true, false, null or numbers)."""
    return re.sub(r'(:\s*|[\[,]\s*)([A-Za-z_][\w./-]*)(?=\s*[,}\]])', lambda m: m[0] if m[2] in ("true", "false", "null") else f'{m[1]}"{m[2]}"', s)


def parse_lenient(s: str):
    """First that parses: the text, braces repaired, the last code block, the last object, the last array, bare words quoted; else None."""
    block = last_code_block(s) or ""
    tries = [s, repair_braces(s), block, repair_braces(block), last_balanced(s, "{") or "", last_balanced(s, "[") or ""]
    for t in [*tries, *(quote_bare_words(t) for t in tries)]:
        try:
            v = json.loads(t)
        except ValueError:
            continue
        if isinstance(v, (dict, list)):
            return v
    return None


def tail(s: str, most: int, mark: str = "...") -> str:
    """The last `most` bytes on a character border, with a mark when cut."""
    b = s.encode()
    return s if len(b) <= most else mark + b[-most:].decode(errors="ignore")


def assistant_content(root: dict) -> str | None:
    """Text of a model response: choices, then content blocks, then output_text."""
    for choice in root.get("choices") or []:
        c = (choice.get("message") or choice.get("delta") or {}).get("content")
        if isinstance(c, str) and c:
            return c
        if isinstance(c, list):
            return "\n".join(x.get("text", "") for x in c if x.get("text")) or None
        break
    blocks = [x.get("text", "") for x in root.get("content") or [] if isinstance(x, dict) and x.get("type") == "text"]
    return "\n".join(blocks) or root.get("output_text")


def thinking_content(root: dict) -> str | None:
    found = [x.get("thinking", "") for x in root.get("content") or [] if isinstance(x, dict) and x.get("type") == "thinking"]
    if found:
        return "\n".join(found)
    first = (root.get("choices") or [{}])[0]
    return (first.get("message") or {}).get("reasoning_content")


def usage(root: dict) -> dict[str, int]:
    u = root.get("usage") or {}
    return {"prompt": int(u.get("prompt_tokens", u.get("input_tokens", 0)) or 0), "completion": int(u.get("completion_tokens", u.get("output_tokens", 0)) or 0), "calls": 1}


def tool_calls(root: dict) -> list[dict]:
    calls = ((root.get("choices") or [{}])[0].get("message") or {}).get("tool_calls")
    if calls:
        return [{"id": c.get("id"), "name": (c.get("function") or {}).get("name"), "arguments": (c.get("function") or {}).get("arguments")} for c in calls]
    return [{"id": c.get("id"), "name": c.get("name"), "arguments": c.get("input")} for c in root.get("content") or [] if isinstance(c, dict) and c.get("type") == "tool_use"]


def refine(current: dict, examples: list) -> dict:
    """A generated schema (schema, name, examples, confidence) merged with the schema of more examples."""
    merged = merge_schemas([current["schema"], merge_schemas([infer_schema(x) for x in examples])] if examples else [current["schema"]])
    n = current["examples"] + len(examples)
    return {**current, "schema": merged, "examples": n, "confidence": 0.5 if n <= 2 else 0.7 if n <= 5 else 0.85 if n <= 10 else 0.95}

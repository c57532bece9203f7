"""Raw HTTP headers and status lines: SQL text for a dialect."""

from __future__ import annotations


def content_length(d, raw: str) -> str:
    """Number of the content-length line; null without one."""
    v = d.get(raw, "(?im)^content-length[ ]*:[ ]*([0-9]+)")
    return f"case when {v} <> '' then cast({v} as bigint) end"


def content_type(d, raw: str) -> str:
    v = d.get(raw, r"(?im)^content-type[ ]*:[ ]*([^\r\n]*)")
    return f"case when {v} <> '' then trim({v}) end"


def status(d, line: str) -> str:
    """Of `HTTP/x.y NNN`; null if malformed."""
    v = d.get(line, "^HTTP/[0-9][.][0-9] ([0-9][0-9][0-9])")
    return f"case when {v} <> '' then cast({v} as int) end"


def status_class(d, status: str) -> str:
    return f"case when {status} between 100 and 199 then 'info' when {status} between 200 and 299 then 'success' when {status} between 300 and 399 then 'redirect' when {status} between 400 and 499 then 'client' when {status} between 500 and 599 then 'server' end"


def without_prefix(d, name: str, prefix: str = "zz-proxied-") -> str:
    """A header name as it was before a proxy prefixed it; null for others."""
    return f"case when {name} like '{prefix}%' then substr({name}, {len(prefix) + 1}) end"

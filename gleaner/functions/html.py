"""Native measures of HTML text. Lengths are bytes. All are plain expressions over one column."""

from __future__ import annotations

SPA = r'(?i)(data-reactroot|data-v-|__next|id="app"|id="root"|ng-app|v-app)'
VISUAL = r"(?i)<(canvas|embed|iframe|object|video)"


def tags(d, h: str, *names: str) -> str:
    return d.count(h, f"(?i)<({'|'.join(names)})")


def dynamic(d, h: str) -> str:
    return d.has(h, SPA)


def visual(d, h: str) -> str:
    return d.has(h, VISUAL)


def visible(d, h: str) -> str:
    """Bytes outside tags, scripts and styles that aren't white space."""
    bare = d.sub(h, r"(?is)<script.*?</script[^>]*>|<style.*?</style[^>]*>|<[^>]*>", "")
    return d.bytes(d.sub(bare, r"[ \t\n\r\f]", ""))


def tag_bytes(d, h: str, tag: str) -> str:
    return d.total(d.every(h, f"(?is)<{tag}.*?</{tag}>"))


def data_bytes(d, h: str) -> str:
    return d.total(d.every(h, r"""data:[^"')]*"""))


def sizes(d, h: str, full: bool) -> dict[str, str]:
    """svg, script, style and data bytes: measured, or guessed from counts."""
    if full:
        return {"svg": tag_bytes(d, h, "svg"), "script": tag_bytes(d, h, "script"), "style": tag_bytes(d, h, "style"), "data": data_bytes(d, h)}
    return {"svg": f"5000 * {tags(d, h, 'svg')}", "script": f"10000 * {tags(d, h, 'script')}", "style": f"2000 * {tags(d, h, 'style')}", "data": f"5000 * {d.count(h, 'data:')}"}


def ratio(a: str, b: str) -> str:
    return f"case when ({b}) > 0 then cast(cast({a} as double) / ({b}) as float) else cast(0 as float) end"


def thin(text: str, text_ratio: str) -> str:
    return f"({text} < 200 or {text_ratio} < cast(0.05 as float))"


def needs_screenshot(d, h: str, text: str) -> str:
    """The quick test: visual tags, a short page, or a scripted page with little text."""
    return f"({visual(d, h)} or {d.bytes(h)} < 1000 or ({dynamic(d, h)} and {text} < 200))"


#: Ladder on columns of an analysis (see plans.html): first that holds.
RECOMMENDED = "case when cleanable_ratio > 0.5 then 'aggressive' when svg_bytes > 50000 or data_bytes > 50000 then 'slim' when is_dynamic or is_thin then 'minimal' else 'default' end"

SAVINGS = {
    "minimal": "script_bytes + style_bytes", "default": "script_bytes + style_bytes + {half}", "slim": "cleanable_bytes", "aggressive": "cleanable_bytes + {tenth}", "raw": "0", "auto": "0"}


def savings(d, profile: str) -> str:
    return SAVINGS[profile].format(half=d.div("data_bytes", "2"), tenth=d.div("html_bytes", "10"))


def sniff(d, h: str) -> str:
    return d.has(f"lower(substr({h}, 1, 1024))", "(<!doctype html|<html|<document)")


def empty_body(d, h: str) -> str:
    """Nothing worth keeping: empty, blank, a bare skeleton, or an empty body in under 2 KiB."""
    t = f"trim(both ' \\t\\n\\r\\u000c' from {h})" if d.name == "spark" else d.sub(h, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")
    return f"({t} = '' or {t} in ('<html></html>', '<html><head></head><body></body></html>') or ({t} like '<%' and {d.bytes(t)} <= 2048 and {d.has(t, '(?is)<body[^>]*>[ \\t\\n\\r\\f]*</body>')}))"


def content_class(d, ct: str) -> str:
    m = f"lower(trim({d.get(ct, '^([^;]*)')}))"
    rules = [("text/html", "Html"), ("text/xml", "Xml"), ("text/plain", "PlainText"), ("text/css", "WebAsset"), ("text/javascript", "WebAsset"), ("application/xhtml", "Html"), ("application/xml", "Xml"), ("application/json", "Json"), ("application/javascript", "WebAsset"), ("image/", "Media"), ("video/", "Media"), ("application/pdf", "Binary"), ("application/zip", "Binary"), ("application/octet-stream", "Binary"), ("font/", "Unknown")]
    return "case " + " ".join(f"when {m} like '{p}%' then '{c}'" for p, c in rules) + " else 'Unknown' end"


def quality(d, h: str, status: str, asset: str, antibot: str) -> str:
    """0 to 100 from status, length, a body tag, a body that isn't empty, and no block page (antibot: null)."""
    n = d.bytes(h)
    ok = f"({status} between 200 and 299)"
    base = f"case when {status} = 200 then 30 when {ok} then 20 when {status} between 300 and 399 then 5 else 0 end + case when {h} is null then 0 else case when {n} > 0 then 5 else 0 end + case when {n} > 512 then 10 else 0 end + case when {n} > 4096 then 10 else 0 end"
    rest = f" + case when {asset} then case when {n} > 0 and {ok} then 25 else 0 end else case when {d.has(h, '<(body|BODY)')} then 15 else 0 end + case when {empty_body(d, h)} then 0 else 10 end end end"
    return f"cast(least(100, {base}{rest} + case when {antibot} is null then 20 else 0 end) as bigint)"


def normalised(d, h: str) -> str:
    """For signatures: without script, style, iframe, base and noscript, and with attributes other than id, class and data-* dropped."""
    s = d.sub(h, r"(?is)<script.*?</script>|<style.*?</style>|<iframe.*?</iframe>|<noscript.*?</noscript>|<base[^>]*>", "")
    return d.sub(s, r"""(?i)[ ]+(href|src|alt|title|rel|type|lang|charset|content|name|style|width|height|target|action|method|value|role|onclick)=("[^"]*"|'[^']*'|[^ >]+)""", "")


def signature(d, h: str) -> str:
    """md5 of the normalised text; null when empty (so empty pages aren't one another's copies)."""
    n = normalised(d, h)
    if d.name == "spark":  # normalised once
        return f"get(transform(array({n}), n -> case when n <> '' then md5(n) end), 0)"
    return f"case when {n} <> '' then md5({n}) end"


def title(d, h: str) -> str:
    return d.get(h, r"(?is)<title[^>]*>(.*?)</title>")


def hrefs(d, h: str) -> str:
    return d.every(h, r"""(?i)<a[^>]*?[ ]href=["']([^"']*)["']""", 1)


def tag_span(d, h: str, tag: str) -> str:
    """From the first opening of a tag to its last closing; empty if there is none."""
    return d.get(h, f"(?s)(<{tag}.*</{tag}>)")

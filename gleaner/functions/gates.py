"""Which pages, hosts and bodies pass: scopes, caps, kinds of bodies, combined block-page tests. SQL text for a dialect."""

from __future__ import annotations

from gleaner.functions import blocks, urls


def text_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def within_bytes(d, body: str, most: int) -> str:
    """A page of at most that many bytes."""
    return f"({d.bytes(body)} <= {most})"


def external(d, host: str, domains: list[str]) -> str:
    """A host that counts as the crawl's own: one of the set, whatever the case of its letters, or any where the set holds `*`."""
    return "true" if "*" in domains else f"(lower({host}) in {text_list(sorted({x.lower() for x in domains}))})"


def name_of(d, host: str) -> str:
    """The label before the last one: `b` of a.b.test."""
    return d.get(f"lower({host})", "([^.]+)[.][^.]+$")


def in_scope(d, host: str, base: str, subdomains: bool, tlds: bool) -> str:
    """The base host; its subdomains; hosts of its name under another top-level domain."""
    h, tests = f"lower({host})", [f"lower({host}) = '{base}'"]
    if subdomains:
        tests.append(f"{h} like '%.{base}'")
    if tlds:
        labels = base.split(".")
        tests.append(f"({name_of(d, host)} = '{labels[-2] if len(labels) > 1 else base}'" + ("" if subdomains else f" and {h} like '{'.'.join(labels[:-1])}.%' and {h} not like '{'.'.join(labels[:-1])}.%.%'") + ")")
    return "(" + " or ".join(tests) + ")"


#: How the stock refusals of two web servers end and begin.
SERVER_ENDS = ["to use an ErrorDocument to handle " "the request.</p>", "</body></html>"]
SERVER_BEGINS = ["<html><head>" "<title>403 Forbidden" "</title></head>", "<body>", "<center>" "<h1>403 Forbidden</h1>" "</center>", "<hr><center>" "openresty</center>"]


def hard_forbidden(d, body: str) -> str:
    """A refusal that no retry can help."""
    nl = "'\\n'" if d.name == "spark" else "chr(10)"
    glue = lambda lines: "concat_ws(" + nl + ", " + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + ")"
    ends, begins = ("endswith", "startswith") if d.name == "spark" else ("ends_with", "starts_with")
    return f"({ends}({body}, {glue(SERVER_ENDS)}) or {begins}({body}, {glue(SERVER_BEGINS)}))"


def skip_backend(d, url: str, more: list[str]) -> str:
    """An asset by its URL, or by one of more endings (of two letters at least)."""
    ending = f"lower({d.get(url, '[.]([^.]*)$')})"
    extra = [x.lower() for x in more if len(x) >= 2]
    return f"({urls.media_url(d, url)}" + (f" or {ending} in {text_list(extra)})" if extra else ")")


def vendor(d, subject: str, headers: str, url: str, body: str) -> str:
    """Vendor of a block page: by TLS subject, headers, URL and body, in that order; null if none tells."""
    return f"coalesce(case when {subject} = 'challenges.cloudflare.com' then 'Cloudflare' end, {blocks.from_headers(d, headers)}, {blocks.from_url(d, url)}, {blocks.from_body(d, body)})"


def vendor_or_custom(d, builtin: str, url: str, body: str, url_marks: list[str], body_marks: list[str]) -> str:
    """The built-in answer, else `Custom` where a mark of the caller is in the URL, or in a body below 30,000 bytes."""
    has = lambda s, ms: " or ".join(f"instr({s}, '{m}') > 0" for m in ms) or "false"
    return f"coalesce({builtin}, case when {has(url, url_marks)} or ({d.bytes(body)} < 30000 and ({has(body, body_marks)})) then 'Custom' end)"


def crawlable_class(kind: str) -> str:
    """Classes of content_class() whose links are followed."""
    return f"({kind} in ('Html', 'Xml'))"


#: First bytes (hexadecimal) of common binary formats: PDF, GIF, PNG, JPEG, ZIP, GZIP, RIFF, OGG, ID3, ELF, wasm, bzip2, 7z, woff.
MAGIC = ["25504446", "47494638", "89504E47", "FFD8FF", "504B0304", "1F8B", "52494646", "4F676753", "494433", "7F454C46", "0061736D", "425A68", "377ABCAF271C", "774F4646", "774F4632"]


def head_hex(d, body: str) -> str:
    """First bytes after leading white space, as hexadecimal digits."""
    return d.sub(f"substr(hex({body}), 1, 512)", "^((09|0A|0B|0C|0D|20))*", "")


def binary_body(d, body: str) -> str:
    h = head_hex(d, body)
    return "(" + " or ".join(f"{h} like '{m}%'" for m in MAGIC) + ")"


def xml_body(d, body: str) -> str:
    return f"({head_hex(d, body)} like '3C3F786D6C%')"


def with_sitemap(whitelist: list[str] | None, custom: str | None = None, ignore: bool = False) -> tuple[list[str] | None, bool, bool]:
    """The whitelist with sitemap.xml and the caller's own path, if it isn't empty, and which of the two were added, so that it can be undone."""
    if not whitelist or (ignore and whitelist is None):
        return whitelist, False, False
    out = list(whitelist)
    default = "sitemap.xml" not in out
    if default:
        out.append("sitemap.xml")
    own = custom is not None and custom not in out
    if own:
        out.append(custom)
    return out, default, own


def base_href(d, html: str) -> str:
    """href of the first base element; null without one."""
    found = d.get(html, r"""(?is)<base\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""")
    return f"nullif({found}, '')"


def normal_key(description: str) -> str:
    """Key of a selector cache: trimmed, in lower case."""
    return f"lower(trim({description}))"

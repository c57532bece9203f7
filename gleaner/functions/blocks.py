"""Detection of block and challenge pages, as a measure of data quality."""

from __future__ import annotations

import re

from pyspark.sql import Column

#: Literals by vendor; the leftmost in a text wins, then the first in the list.
URL_MARKS = [
    ("Cloudflare", ["/cdn-cgi/challenge-platform", "/cdn-cgi/bm/cv/"]), ("DataDome", ["datadome.co", "dd-api.io"]), ("PerimeterX", ["perimeterx.net", "px-captcha"]),
    ("ArkoseLabs", ["arkoselabs.com", "funcaptcha"]), ("Kasada", ["kasada.io"]), ("FingerprintJS", ["fingerprint.com", "fpjs.io"]), ("Imperva", ["incapsula", "imperva", "/_Incapsula_Resource"]),
    ("RadwareBotManager", ["radwarebotmanager"]), ("Reblaze", ["reblaze.com"]), ("CHEQ", ["cheq.ai"]), ("AlibabaTMD", ["_____tmd_____/punish"]), ("HCaptcha", ["hcaptcha.com"]),
    ("GeeTest", ["api.geetest.com", "geevisit.com"]), ("QueueIt", ["queue-it.net"]), ("DDoSGuard", ["ddos-guard.net"]), ("Sucuri", ["sucuri.net"]),
]
BODY_MARKS = [
    ("Cloudflare", ["cf-error-code", "block_headline", "challenge-platform", "cf-challenge", "Attention Required! | Cloudflare"]), ("PerimeterX", ["Access to this page has been denied", "perimeterx", "px-captcha", "/captcha/captcha.js?a=c"]),
    ("DataDome", ["DataDome"]), ("ArkoseLabs", ["funcaptcha"]), ("Imperva", ["Request unsuccessful. Incapsula incident ID", "_Incapsula_Resource"]), ("AlibabaTMD", ["_____tmd_____", "x5secdata"]),
    ("AkamaiBotManager", ["ak_bmsc"]), ("DDoSGuard", ["ddos-guard", "DDoS-Guard"]), ("generic", ["verify you are human", "prove you're not a robot"]), ("Sucuri", ["Sucuri Website Firewall"]),
    ("Kasada", ["kpsdk"]), ("Vercel", ["Vercel Security Checkpoint"]), ("Wordfence", ["Generated by Wordfence"]), ("AwsWaf", ["aws-waf-token"]),
]
HEADER_MARKS = [
    ("Cloudflare", ["cf-mitigated", "cf-ray", "cf-chl-bypass"]), ("DataDome", ["x-datadome", "x-captcha-endpoint"]), ("PerimeterX", ["pxhd", "x-perimeterx"]), ("AkamaiBotManager", ["x-akamaibot"]),
    ("Imperva", ["x-iinfo", "x-imperva-id"]), ("Reblaze", ["x-reblaze-uuid"]), ("Sucuri", ["x-sucuri-id"]),
]


def quoted(mark: str) -> str:
    return "".join("[" + c + "]" if c in ".?|+*()!" else c for c in mark)


def any_mark(marks: list[str]) -> str:
    """A pattern of one group for the leftmost mark, at one place the first in the list. Most places are told by one letter; marks of the same first letter share its test."""
    if any(a != b and b.startswith(a) for a in marks for b in marks):  # their order tells
        return "(" + "|".join(map(quoted, marks)) + ")"
    firsts = list(dict.fromkeys(m[0] for m in marks))
    return f"(?=[{''.join(map(re.escape, firsts))}])(" + "|".join(f"{quoted(c)}(?:{'|'.join(quoted(m[1:]) for m in marks if m[0] == c)})" for c in firsts) + ")"


def first_mark(d, text: str, marks: list) -> str:
    """Vendor of the leftmost mark; null without one. Spark looks the found mark up in a map, so that the text is searched once."""
    if d.name == "spark":
        ordered = list(dict.fromkeys(m for _, ms in marks for m in sorted(ms, key=len, reverse=True)))
        vendors: dict[str, str] = {}
        for v, ms in marks:
            for m in ms:
                vendors.setdefault(m, v)
        pairs = ", ".join("'" + m.replace("'", "\\'") + f"', '{v}'" for m, v in vendors.items())
        return f"try_element_at(map({pairs}), {d.get(text, any_mark(ordered))})"
    found = d.get(text, "(" + "|".join(quoted(m) for _, ms in marks for m in sorted(ms, key=len, reverse=True)) + ")")
    return f"case {found} " + " ".join(f"when {d.lit(m)} then '{v}'" for v, ms in marks for m in ms) + " end"


def from_url(d, url: str) -> str:
    return first_mark(d, url, URL_MARKS)


def from_body(d, body: str) -> str:
    """Looks at the first 30,000 characters, where interstitials put their marks; `generic` means found, vendor unknown."""
    return first_mark(d, f"substr({body}, 1, 30000)", BODY_MARKS)


def from_headers(d, headers: str) -> str:
    """Vendor by the names of a header map (lower-case)."""
    has = (lambda k: f"map_contains_key({headers}, '{k}')") if d.name == "spark" else (lambda k: f"len(map_extract({headers}, '{k}')) > 0")
    return "case " + " ".join(f"when {' or '.join(has(k) for k in ks)} then '{v}'" for v, ks in HEADER_MARKS) + " end"


SOFT = r"(?i)(access denied|403 forbidden|zugriff verweigert|acceso denegado|acc.s refus|accesso negato|acesso negado|toegang geweigerd)"


def soft_block(d, body: str) -> str:
    """A small page (8 KiB at most) that says in its head that access was denied."""
    return f"({d.bytes(body)} <= 8192 and {d.has(f'substr({body}, 1, 2048)', SOFT)})"


def captcha(d, body: str) -> str:
    return d.has(body, "(?i)(g-recaptcha|h-captcha|hcaptcha[.]com|geetest|px-captcha|incapsula|leminnow)")


def smart_fallback(d, status: str, body: str) -> str:
    """Whether to ask another backend: by status, an empty body, or pairs of challenge words in the first 4 KiB."""
    low = f"lower(substr({body}, 1, 4096))"
    has = lambda w: f"instr({low}, '{w}') > 0"
    pairs = [("captcha", "challenge"), ("cloudflare", "challenge-platform"), ("access denied", "automated"), ("akamai", "bot manager")]
    alone = ["cf-browser-verification", "please verify you are a human", "bot detection", "distil_r_captcha", "_imperva"]
    words = " or ".join([*(f"({has(a)} and {has(b)})" for a, b in pairs), *(has(w) for w in alone)])
    return f"({status} in (403, 429, 503) or {status} >= 500 or {body} = '' or {words})"


RETRY = (408, 429, 500, 502, 503, 504, 507, 508, 598, 599)


def retryable(status: Column) -> Column:
    return status.isin(*RETRY)


BINARY = sorted(f"application/{x}" for x in "pdf zip gzip x-gzip octet-stream wasm x-tar x-bzip2 x-7z-compressed x-rar-compressed vnd.ms-fontobject x-font-ttf x-font-woff".split())


def binary_type(d, ct: str) -> str:
    m = f"trim({d.get(ct, '^([^;]*)')})"
    return f"({d.has(m, '^(audio|font|image|video)/')} or {m} in ({', '.join(repr(x) for x in BINARY)}))"

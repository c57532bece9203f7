"""Functions on URLs: each gives the SQL text for a dialect; wrap with dialect.column for a Column.

All are plain expressions (code generation, pushdown below joins). Null in, null out, unless said otherwise.
"""

from __future__ import annotations

AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/]*)"
HIGH = ("article", "item", "page", "product")
LOW = ("cookie", "disclaimer", "legal", "privacy", "terms")
MEDIA = sorted(
    "3g2 3gp 7z aac abw aiff apng arc avi avif azw bin bmp bz bz2 cda csv doc docx eot eps epub flac flv gif gz heic heif ico ics jar jpeg jpg m4a m4v md mid midi mkv mov mp3 mp4 mpeg mpkg odp ods odt oga ogg ogv ogx opus otf pdf png ppt pptx rar rtf svg swf tar tif tiff ts ttf txt vsd wav weba webm webmanifest webp wmv woff woff2 xap xls xlsx yaml yml zip".split()
)


def root(d, u: str) -> str:
    """Scheme and authority with a single slash; null where there is no scheme."""
    return f"case when {d.has(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+')} then concat({d.get(u, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)')}, '/') end"


def flip_scheme(d, u: str) -> str:
    return f"case when {u} like 'http://%' then concat('https://', substr({u}, 8)) when {u} like 'https://%' then concat('http://', substr({u}, 9)) end"


def strip_www(d, u: str) -> str:
    return f"case when {d.has(u, '^[^:]*://www[.]')} then concat({d.get(u, '^([^:]*://)www[.]')}, {d.get(u, '^[^:]*://www[.](.*)')}) end"


def last_segment(d, p: str) -> str:
    return d.get(p, "([^/]*)$")


def path_with_query(d, u: str) -> str:
    return f"case when {d.has(u, '^[^/]*//[^/]*/')} then {d.get(u, '^[^/]*//[^/]*(/.*)$')} else '/' end"


def authority(d, u: str) -> str:
    return d.get(u, "//([^/]*)")


def host(d, u: str) -> str:
    """Lower-cased by the caller where wanted; empty without a scheme."""
    return d.get(u, "://([^/:]*)")


def path(d, u: str) -> str:
    rest = d.get(u, "://[^/]*(/.*)$")
    cut = f"case when instr({rest}, '?') > 0 then substr({rest}, 1, instr({rest}, '?') - 1) when instr({rest}, '#') > 0 then substr({rest}, 1, instr({rest}, '#') - 1) else {rest} end"
    return f"case when instr({u}, '://') = 0 then {u} when {rest} = '' then '/' else {cut} end"


def robots_path(d, u: str) -> str:
    rest = d.sub(u, "^https?://", "")
    return f"case when instr({rest}, '/') = 0 then '/' else {d.get(rest, '^[^/]*(/[^?]*)')} end"


def crawlable(d, u: str) -> str:
    return d.has(u, "^(https?|file|ftp)://")


def force_https(d, u: str) -> str:
    return f"case when instr({u}, '://') > 0 then concat('https://', substr({u}, instr({u}, '://') + 3)) else concat('https://', {u}) end"


def media_path(d, p: str) -> str:
    ext = f"lower({d.get(p, '[.]([^.]*)$')})"
    return f"(instr({p}, '.') > 0 and {ext} in ({', '.join(repr(x) for x in MEDIA)}))"


def media_url(d, u: str) -> str:
    p = d.get(u, "^[^?#]*?://[^/?#]*(/[^?#]*)")
    return f"({p} <> '' and {media_path(d, p)})"


def depth(d, u: str) -> str:
    return d.size(f"filter(split({path(d, u)}, '/'), x -> x <> '')") if d.name == "spark" else f"len(list_filter(string_split({path(d, u)}, '/'), lambda x: x <> ''))"


def score(d, u: str, level: str) -> str:
    p = f"lower({path(d, u)})"
    words = " ".join([*(f"+ case when instr({p}, '{w}') > 0 then 50 else 0 end" for w in HIGH), *(f"- case when instr({p}, '{w}') > 0 then 200 else 0 end" for w in LOW)])
    return f"cast(greatest(0, least(2000, 1000 - 100 * ({level}) {words})) as bigint)"


def cache_key(d, u: str, method: str = "'GET'", auth: str | None = None, namespace: str | None = None) -> str:
    parts = [method, "':'", u]
    if auth:
        parts += ["':'", auth]
    if namespace:
        parts += ["'::ns='" if not auth else "':ns='", namespace]
    return f"concat({', '.join(parts)})"


def domain_pattern(d, u: str) -> str:
    return f"concat({d.get(u, '^([^/]*(?:/[^/]*){0,2})')}, '/*')"


def trie_path(d, u: str) -> str:
    """The place of a URL in a path tree: its segments without those that hold a dot."""
    p = path(d, u)
    return f"array_join(filter(split({p}, '/'), x -> x <> '' and instr(x, '.') = 0), '/')" if d.name == "spark" else f"array_to_string(list_filter(string_split({p}, '/'), lambda x: x <> '' and instr(x, '.') = 0), '/')"


def glob(d, text: str, pattern: str) -> str:
    """`*` stands for any text; without one, equality. The pattern is a constant."""
    if "*" not in pattern:
        return f"({text} = {d.lit(pattern)})"
    quoted = "".join(".*" if c == "*" else f"[{c}]" if c in ".+?()|{}$" else "\\" + c if c in "[]^\\" else c for c in pattern)
    return d.has(text, f"(?s)^{quoted}$")


IGNORED = ("about", "blob", "callto", "data", "file", "geo", "intent", "javascript", "mailto", "market", "sms", "tel", "viber", "whatsapp")


def href_class(d, h: str) -> str:
    """skip (the base stands for it), absolute or relative."""
    return f"case when {h} is null then null when {h} in ('', '#', 'javascript:void(0);') then 'skip' when {h} like '/%' then 'relative' when {d.get(h, '^([^:]*):')} in ({', '.join(repr(x) for x in IGNORED)}) then 'skip' when {d.has(h, '^(https?|ftp|wss?)://')} then 'absolute' else 'relative' end"


def resolve(d, root_url: str, h: str) -> str:
    """Absolute URL of an href against a root URL (ending in a slash), without its fragment: the native path for absolute and rooted hrefs; others are joined to the root."""
    kind = href_class(d, f"trim({h})")
    bare = d.sub(f"trim({h})", "#.*$", "")
    scheme = d.get(root_url, "^([a-zA-Z][a-zA-Z0-9+.-]*:)")
    return f"case {kind} when 'skip' then {root_url} when 'absolute' then {bare} else case when {bare} like '//%' then concat({scheme}, {bare}) when {bare} like '/%' then concat({root_url}, substr({bare}, 2)) else concat({root_url}, {d.sub(bare, '^([.]/)+', '')}) end end"

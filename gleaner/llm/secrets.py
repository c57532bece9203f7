"""Secret scans, with DataFrame functions only.

Method: candidate strings (maximal runs of a character class) are scanned with a sliding window whose Shannon
entropy is kept up to date by incremental counts: a character that enters or leaves changes one count, and the
sum of c*log2(c) by one table difference. Sums are integers (micro-bits), so results don't depend on the order
of additions. Classes: `hex` and `base64`. A candidate is suppressed by the allow-list (UUIDs, words joined by
separators, strings of letters alone or digits alone, and any patterns of the caller), or when a base span
already holds it. Base spans (assign, access, hex) come from patterns and always stay.

Positions are code points, ends exclusive. They come from one lazy pass `(gap)(match|end)`: the lengths of the
pieces add up to the positions, so no imperative code is needed; texts without a match pay one search only.

Defined results. Null text counts as empty: no spans. Repeated rows and null ids: each row by itself. Spans are
sorted by start, then kind in the order assign, access, hex, entropy_hex, entropy_base64, then end; spans of different
kinds may overlap or be equal, and all are told. A window with exactly the least entropy of its class counts. A long
text, a long candidate and many matches cost time in proportion to their length (telling which candidates a base span
holds: a binary search for each). Extra columns, of any name, are kept by `scan` and `redact` and left
aside by `report`. Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, so asking for the least length inside the pattern drops the same matches as asking afterwards.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
WINDOW = 24
#: class: (candidate pattern, alphabet, least bits a character in some window)
CLASSES = {
    "entropy_hex": (r"[0-9A-Fa-f]{24,}", "0123456789abcdefABCDEF", 3.0),
    "entropy_base64": (r"[A-Za-z0-9+/_=-]{24,}", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 4.0),
}
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^([A-Za-z]{1,15}|[0-9]{1,8})([-_/=]+([A-Za-z]{1,15}|[0-9]{1,8}))*[-_/=]*$",
)
MICRO = 1_000_000
TABLE = [0] + [round(c * math.log2(c) * MICRO) for c in range(1, WINDOW + 2)]


def most_sum(bits: float) -> int:
    """A window has at least `bits` a character where its sum of c*log2(c) (micro-bits) is at most this."""
    return round((WINDOW * math.log2(WINDOW) - WINDOW * bits) * MICRO)


#: Counts are kept in longs, PACK of them in each: a window holds no more than WINDOW of one character.
COUNT_BITS = 5
PACK = 60 // COUNT_BITS


def least_window_sum(s: Column, alphabet: str) -> Column:
    """Least sum of c*log2(c) over the windows of s, by incremental counts."""
    codes = F.transform(F.split(s, ""), lambda x: F.position(x, F.lit(alphabet)) - 1)
    # Each character with the one that leaves as it enters: the accumulator, which is copied at each step, stays small.
    moves = F.arrays_zip(codes.alias("code"), F.concat(F.array_repeat(F.lit(-1), WINDOW), codes).alias("leaving"))
    table = F.array(*[F.lit(x).cast("long") for x in TABLE])
    counts = F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // PACK))
    zero = F.struct(counts.alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(2**62).cast("long").alias("least"), F.lit(0).alias("i"))

    def place(code: Column) -> Column:
        return (code % PACK) * COUNT_BITS

    def count(acc: Column, code: Column) -> Column:
        word = F.get(acc["n"], F.floor(code / PACK).cast("int"))
        return F.call_function("shiftright", word, place(code)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1).cast("long")).cast("int")

    def one(code: Column, j: Column) -> Column:
        """One of that character, in word j."""
        return F.when(F.floor(code / PACK) == j, F.call_function("shiftleft", F.lit(1).cast("long"), place(code))).otherwise(F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        code, leaving = x["code"], x["leaving"]
        a = count(acc, code)
        b = count(acc, leaving) + F.when(leaving == code, 1).otherwise(0)
        added = acc["sum"] + F.get(table, a + 1) - F.get(table, a)
        total = F.when(leaving < 0, added).otherwise(added + F.get(table, b - 1) - F.get(table, b))
        n = F.transform(acc["n"], lambda c, j: c + one(code, j) - F.when(leaving < 0, F.lit(0).cast("long")).otherwise(one(leaving, j)))
        least = F.when(acc["i"] >= WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(n.alias("n"), total.alias("sum"), least.alias("least"), (acc["i"] + 1).alias("i"))

    # The zipped array has WINDOW elements more than there are characters: nothing enters there.
    return F.aggregate(F.filter(moves, lambda x: x["code"].isNotNull()), zero, step, lambda acc: acc["least"])


#: Running sums go in runs of this many, so a text of many matches doesn't copy a growing array at each.
RUN = 256


def running(lengths: Column) -> Column:
    """Sums of what comes before each element."""
    none = F.expr("cast(array() as array<int>)")

    def scan_from(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), none.alias("all"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda b: F.slice(lengths, b * RUN + 1, F.lit(RUN)))
    starts = scan_from(F.transform(runs, lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)), F.lit(0))
    return F.flatten(F.transform(F.arrays_zip(runs.alias("xs"), starts.alias("at")), lambda z: scan_from(z["xs"], z["at"])))


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, kind, end, match, value)."""
    whole = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    parts = [F.regexp_extract_all(text, whole, F.lit(g)) for g in ([1, 2] if not value_group else [1, 2, 2 + value_group])]
    gaps = F.transform(parts[0], F.length)
    before = running(F.zip_with(gaps, parts[1], lambda g, m: g + F.length(m)))
    zipped = F.arrays_zip(before.alias("at"), gaps.alias("gap"), parts[1].alias("m"), parts[-1].alias("v"))

    def span(x: Column) -> Column:
        start = x["at"] + x["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("m"), x["v"].alias("v"))

    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,m:string,v:string>>)")
    return F.when(text.rlike(pattern), F.transform(F.filter(zipped, lambda x: x["m"] != ""), span)).otherwise(empty)


def inside(x: Column, spans: Column) -> Column:
    """Whether one of the spans, which are sorted and don't overlap, holds x: by binary search for the last that begins no later."""
    zero = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        going, below = acc["low"] < acc["high"], F.get(spans, mid)["start"] <= x["start"]
        return F.struct(F.when(going & below, mid + 1).otherwise(acc["low"]).alias("low"), F.when(going & ~below, mid).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int"))
    return F.aggregate(steps, zero, step, lambda acc: F.coalesce(F.get(spans, acc["low"] - 1)["end"] >= x["end"], F.lit(False)))


#: Where a run of 24 characters of a class begins; characters of hex are characters of base64, too.
RUN24 = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24}"


def may_hold(t: Column) -> Column:
    """Whether any pattern matches. What a match must hold is looked for first, as one pass of all patterns over every text costs the most here."""
    assigned = (t.contains("=") | t.contains(":")) & t.rlike(ASSIGN)
    return assigned | (t.contains("AKIA") & t.rlike(ACCESS)) | t.rlike(RUN24)


def scan(docs: DataFrame, text_col: str = "text", allow: tuple[str, ...] = (), out: str = "secret_spans") -> DataFrame:
    """docs with `out`: array of (start, kind, end), sorted; kind is a position in KINDS."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,m:string,v:string>>)")
    maybe, *base, hexes, base64 = fresh(docs, "maybe", "assign", "access", "base", "hex", "b64")
    some = docs.withColumn(maybe, may_hold(t))
    for name, spans in zip(base, (F.filter(spans_of(t, ASSIGN, 0, 2), lambda x: F.length(x["v"]) >= 6), spans_of(t, ACCESS, 1), spans_of(t, HEX, 2)), strict=True):
        some = some.withColumn(name, F.when(F.col(maybe), spans).otherwise(empty))
    allowed = [*ALLOW, *allow]

    def kept(kind: str) -> Column:
        pattern, alphabet, bits = CLASSES[kind]

        def keep(x: Column) -> Column:
            ok = F.lit(True)
            for name in base:
                ok = ok & ~inside(x, F.col(name))
            for p in allowed:
                ok = ok & ~x["m"].rlike(p)
            return F.when(ok, least_window_sum(x["m"], alphabet) <= most_sum(bits)).otherwise(F.lit(False))

        return F.filter(spans_of(t, pattern, KINDS.index(kind)), keep)

    some = some.withColumn(hexes, F.when(F.col(maybe), kept("entropy_hex")).otherwise(empty))
    # A base64 candidate that an entropy_hex span already holds isn't told again.
    b64 = F.filter(kept("entropy_base64"), lambda x: ~inside(x, F.col(hexes)))
    some = some.withColumn(base64, F.when(F.col(maybe), b64).otherwise(empty))
    every = F.transform(F.array_sort(F.concat(*base, hexes, base64)), lambda x: F.struct(x["start"], x["kind"], x["end"]))
    return some.withColumn(out, every).drop(maybe, *base, hexes, base64)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    s = scan(docs.select("doc_id", "text"), allow=allow)
    def count(kind: int) -> Column:
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    base = F.filter("secret_spans", lambda x: x["kind"] < 3)
    return s.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark` (overlapping spans by one); other texts stay as they are. n_chars, where there is one, follows."""
    (spans,) = fresh(docs, "spans")
    s = scan(docs, out=spans)
    t = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        apart = x["start"] >= acc["at"]
        done = F.when(apart, F.concat(acc["done"], F.substr(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["done"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), done.alias("done"))

    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["done"], F.substr(t, acc["at"] + 1, F.length(t))))
    dirty = F.size(spans) > 0
    out = s.withColumn("text", F.when(dirty, clean).otherwise(t))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dirty, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(spans)


def _runs(pattern: str, kind: int, value: str = "") -> str:
    """DuckDB: rows (rid, start, kind, end, m, v) of the matches of a pattern."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, s + len(gap) AS st, {kind} AS kind, s + len(gap) + len(m) AS en, m FROM (
      SELECT rid, gap, m, coalesce(sum(len(gap) + len(m)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
        SELECT rid, unnest(g) AS gap, unnest(ms) AS m, unnest(range(len(g))) AS i FROM (SELECT rid, regexp_extract_all(t, '(?s)(.*?)({p}|\\z)', 1) AS g, regexp_extract_all(t, '(?s)(.*?)({p}|\\z)', 2) AS ms FROM d WHERE regexp_matches(t, '{p}')))) WHERE m <> ''"""


def oracle() -> str:
    entropy = []
    for kind, (pattern, _, bits) in CLASSES.items():
        k = KINDS.index(kind)
        allow = " AND ".join("NOT regexp_matches(m, '" + a.replace("'", "''") + "')" for a in ALLOW)
        entropy.append(f"""c{k} AS (SELECT DISTINCT * FROM ({_runs(pattern, k)}) AS x WHERE {allow}),
w{k} AS (SELECT rid, st, kind, en, min(total) AS least FROM (SELECT rid, st, kind, en, w, sum(f) AS total FROM (
   SELECT rid, st, kind, en, w, CAST(round(count(*) * log2(count(*)) * 1000000) AS BIGINT) AS f FROM (SELECT rid, st, kind, en, w, substr(m, w + j, 1) AS ch FROM (SELECT *, unnest(range(1, len(m) - {WINDOW} + 2)) AS w FROM c{k}), range({WINDOW}) AS u(j)) GROUP BY rid, st, kind, en, w, ch) GROUP BY rid, st, kind, en, w) GROUP BY rid, st, kind, en),
e{k} AS (SELECT rid, st, kind, en FROM w{k} WHERE least <= {most_sum(bits)} AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = w{k}.rid AND base.st <= w{k}.st AND base.en >= w{k}.en))""")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT rid, st, kind, en FROM ({_runs(ASSIGN, 0)}) AS x WHERE len(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6
  UNION ALL SELECT rid, st, kind, en FROM ({_runs(ACCESS, 1)}) AS x UNION ALL SELECT rid, st, kind, en FROM ({_runs(HEX, 2)}) AS x),
{", ".join(entropy)},
al AS (SELECT * FROM base UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 WHERE NOT EXISTS (SELECT 1 FROM e3 WHERE e3.rid = e4.rid AND e3.st <= e4.st AND e3.en >= e4.en)),
j AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][kind + 1] || ':' || st || ':' || en, ',' ORDER BY st, kind) FILTER (kind < 3) AS b,
  string_agg(['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][kind + 1] || ':' || st || ':' || en, ',' ORDER BY st, kind) AS spans FROM al GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (rid)
"""

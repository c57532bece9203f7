"""robots.txt: a line parser for whole files (they are small) and rules as rows."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(text: str) -> list[dict]:
    """Entries in order: agents, rules (path, allowed), delay, rate. A blank line ends an entry; rules before any agent are ignored; a comment line isn't blank."""
    entries: list[dict] = []
    now: dict | None = None
    ruled = False
    for raw in text.split("\n"):
        if raw == "":
            if now and (ruled or now["delay"] is not None or now["rate"]):
                entries.append(now)
                now, ruled = None, False
            continue
        line = raw.split("#", 1)[0].strip()
        if ":" not in line:
            continue
        key, value = (x.strip() for x in line.split(":", 1))
        key, value = key.lower(), unquote(value)
        if key == "user-agent":
            if now and ruled:
                entries.append(now)
                now, ruled = None, False
            now = now or {"agents": [], "rules": [], "delay": None, "rate": None}
            now["agents"].append(value.lower())
        elif now is None:
            continue
        elif key in ("allow", "disallow"):
            now["rules"].append((value, key == "allow" or value == ""))
            ruled = True
        elif key == "crawl-delay" and value.replace(".", "", 1).isdigit():
            now["delay"], ruled = float(value), True
        elif key == "request-rate" and value.count("/") == 1 and all(x.strip().isdigit() for x in value.split("/")):
            a, b = value.split("/")
            now["rate"], ruled = (int(a), int(b)), True
    if now:
        entries.append(now)
    return entries


def rule_matches(rule: str, path: str) -> bool:
    """`*`, the root, a prefix ending in `/` or `*`, else equality (so /dir doesn't match /dir/x)."""
    if rule in ("*", "/"):
        return True
    if rule.endswith("*"):
        return path.startswith(rule[:-1])
    return path.startswith(rule) if rule.endswith("/") else path == rule


def agent_matches(agents: list[str], agent: str) -> bool:
    name = agent.split("/", 1)[0].lower()
    return any(a != "*" and a in name for a in agents)


def can_fetch(entries: list[dict], agent: str, path: str, strict: bool = True) -> bool:
    """strict: the agent's own entry decides alone. Otherwise (parity): what it doesn't allow is asked of `*`, and without such an entry is allowed."""

    def ask(e: dict) -> bool | None:
        return next((ok for rule, ok in e["rules"] if rule_matches(rule, path)), None)

    own = next((e for e in entries if agent_matches(e["agents"], agent)), None)
    star = next((e for e in entries if "*" in e["agents"]), None)
    if strict:
        got = ask(own if own else star) if own or star else None
        return True if got is None else got
    if own and ask(own) in (True, None):
        return True
    got = ask(star) if star else None
    return True if got is None else got


def crawl_delay(entries: list[dict], agent: str) -> float | None:
    """Of the first entry for the agent, even if it has none; `*` only where no entry matched."""
    own = next((e for e in entries if agent_matches(e["agents"], agent)), None)
    return own["delay"] if own else next((e["delay"] for e in entries if "*" in e["agents"]), None)


def request_rate(entries: list[dict], agent: str) -> tuple | None:
    own = next((e for e in entries if agent_matches(e["agents"], agent)), None)
    return own["rate"] if own else None


def access(status):
    """What a robots.txt response says before any rule: none (401, 403), all (other 4xx), rules (200), else all (nothing read)."""
    return F.when(status.isin(401, 403), "none").when(status.between(400, 499), "all").when(status == 200, "rules").otherwise("all")


def allowed(urls: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """urls with `allowed`: the first rule (least line) of the host that matches the path; none: allowed.

    rules: (rule_host, line, rule, allow), a table by host, joined on the host alone, so no pair of unrelated rows is made.
    """
    by_host = rules.groupBy("rule_host").agg(F.array_sort(F.collect_list(F.struct("line", "rule", "allow"))).alias("_rules"))  # a file's rules: few
    j = urls.join(by_host, F.col(host) == F.col("rule_host"), "left")
    first = F.get(F.filter("_rules", lambda x: matching(x["rule"], F.col(path))), F.lit(0))["allow"]
    return j.select(*urls.columns, F.coalesce(first, F.lit(True)).alias("allowed"))


ENTRY = "array<struct<agents:array<string>,rules:array<struct<rule:string,allow:boolean>>,delay:double,requests:long,seconds:long>>"


def parsed(files: DataFrame, key: str = "host", text: str = "text") -> DataFrame:
    """(key, entries) of robots.txt files: parse() over each whole file, which is small; a null text has no entries."""
    from collections.abc import Iterator

    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                found = parse(t) if isinstance(t, str) else []
                rows.append((k, [{"agents": e["agents"], "rules": [{"rule": r, "allow": a} for r, a in e["rules"]], "delay": e["delay"], "requests": (e["rate"] or (None, None))[0], "seconds": (e["rate"] or (None, None))[1]} for e in found]))
            yield pd.DataFrame(rows, columns=[key, "entries"])

    return files.select(key, text).mapInPandas(run, f"{key} {kind}, entries {ENTRY}")


def matching(rule, path):
    """Whether a rule matches a path, as rule_matches()."""
    prefix = F.substring(rule, F.lit(1), F.length(rule) - 1)
    return rule.isin("*", "/") | (rule.endswith("*") & path.startswith(prefix)) | (rule.endswith("/") & path.startswith(rule)) | (path == rule)


def own_entry(entries, agent):
    """The first entry that names the agent, by the part of its name before a slash, in any case of letters; null if none does."""
    name = F.lower(F.substring_index(agent, "/", 1))
    return F.get(F.filter(entries, lambda e: F.exists(e["agents"], lambda a: (a != "*") & F.contains(name, a))), F.lit(0))


def star_entry(entries):
    return F.get(F.filter(entries, lambda e: F.array_contains(e["agents"], "*")), F.lit(0))


def verdicts(requests: DataFrame, files: DataFrame, host: str = "host", path: str = "path", agent: str = "agent", strict: bool = True) -> DataFrame:
    """requests with allowed, delay, requests and seconds by the entries of their host; every row of requests comes back once.

    One row a host is joined (few and small: a parsed file each), so nothing is multiplied or grouped. Hosts without a
    file: allowed, no delay.
    """
    e = files.select(F.col("host").alias("_rhost"), F.col("entries").alias("_entries"))
    j = requests.join(e, F.col(host) == F.col("_rhost"), "left").withColumn("_own", own_entry(F.col("_entries"), F.col(agent))).withColumn("_star", star_entry(F.col("_entries")))
    p = F.col(path)

    def ask(entry):
        return F.get(F.filter(entry["rules"], lambda r: matching(r["rule"], p)), F.lit(0))["allow"]

    own, star = F.col("_own"), F.col("_star")
    if strict:
        allowed_now = F.coalesce(F.when(own.isNotNull(), ask(own)).otherwise(ask(star)), F.lit(True))
    else:
        allowed_now = F.when(own.isNotNull() & F.coalesce(ask(own), F.lit(True)), True).otherwise(F.coalesce(ask(star), F.lit(True)))
    delay = F.when(own.isNotNull(), own["delay"]).otherwise(star["delay"])
    return j.select(*requests.columns, allowed_now.alias("allowed"), delay.alias("delay"), own["requests"].alias("requests"), own["seconds"].alias("seconds"))


def allowed_by_patterns(requests: DataFrame, files: DataFrame, host: str = "host", path: str = "path", agent: str = "agent") -> DataFrame:
    """The pattern variant: refused where some agent line (or `*`) is found in the agent and some Disallow path, as a pattern, in the path; Allow lines don't count."""
    patterns = F.filter(F.flatten(F.transform("entries", lambda e: F.transform(F.filter(e["rules"], lambda r: ~r["allow"]), lambda r: r["rule"]))), lambda r: r != "")
    agents = F.flatten(F.transform("entries", lambda e: e["agents"]))
    e = files.select(F.col("host").alias("_rhost"), patterns.alias("_patterns"), agents.alias("_agents"))
    j = requests.join(e, F.col(host) == F.col("_rhost"), "left")
    named = F.exists("_agents", lambda a: (a == "*") | ((a != "*") & F.rlike(F.lower(F.col(agent)), a)))
    barred = F.exists("_patterns", lambda r: F.rlike(F.col(path), r))
    return j.select(*requests.columns, (~F.coalesce(named & barred, F.lit(False))).alias("allowed"))

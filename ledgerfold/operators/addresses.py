"""Addresses that tool calls reached: URL arguments, commands that talk to the network, opened pages and search results.

All in column expressions: a command's lines are arrays of what each assigns and names, and the variables that network lines use are followed
by a fold over them, so no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: an address in a text.
URL = r"""(?i)\b(?:https?|wss?|ftp)://[^\s"'<>`\\|{}^\[\]]+"""
#: Fixed value: a line that talks to the network.
NETWORK = (
    r"""(?i)(?:^|[\s;&|(`$"'=])(?:curl|wget|xh|aria2c|lynx|w3m|websocat|grpcurl|git\s+(?:clone|fetch|pull|push|ls-remote|submodule|remote\s+(?:add|set-url)))\s"""
    r"""|(?:^|[;&|(]\s*)(?:open|xdg-open)\s+['"]?(?:https?|wss?)://"""
    r"""|urlopen\(|urllib\.request|\brequests\.(?:get|post|put|patch|delete|head|request|Session)\b|\bhttpx\.|\baiohttp\b|\bfetch\(|\baxios\b"""
    r"""|\bhttps?\.(?:get|request)\(|\.goto\(|webbrowser\.open|Invoke-(?:WebRequest|RestMethod)|\bnew\s+WebSocket\("""
)
#: Fixed value: the variable a line assigns.
ASSIGNED = r"^\s*(?:(?:export|local|readonly|const|let|var)\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*:?="
#: Fixed value: the page a tool says it opened.
OPENED = r"(?m)^Web search completed for: (\S+)"
#: Names of arguments that hold addresses.
URL_KEYS = ("url", "urls", "uri", "href", "link", "target_url", "page_url", "website")

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_ARGUMENT = rf'(?is)(?<!\\)"(?:{"|".join(URL_KEYS)})"\s*:\s*({_TEXT}|\[(?:[^\]"]++|{_TEXT})*+\])'


def reaches_out(line: Column) -> Column:
    """Whether a line talks to the network."""
    return line.rlike(NETWORK)


def clean_url(raw: Column) -> Column:
    """An address without the punctuation behind it; null where it isn't one with a literal host."""
    tidy = F.regexp_replace(F.trim(raw), r"""[.,:;!?)'"]+$""", "")
    host = host_of(tidy)
    return F.when((host != "") & ~host.endswith(":") & ~host.rlike(r"[$%{}<>()]"), tidy)


def host_of(url: Column) -> Column:
    """Host and port of a network address, lower case; empty for other texts."""
    authority = F.regexp_extract(url, r"(?i)^(?:https?|wss?|ftp)://([^/?#]*)", 1)
    return F.lower(F.regexp_extract(authority, r"([^@]*)$", 1))


def argument_urls(arguments: Column) -> Column:
    """Texts under address-named arguments of a JSON text at any depth, lists of them included, in the order they are written."""
    values = F.regexp_extract_all(arguments, F.lit(_ARGUMENT), F.lit(1))
    texts = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(f"(?s){_TEXT}"), F.lit(0))))
    return F.filter(F.transform(texts, lambda t: F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0))), lambda t: t.isNotNull())


def command_urls(command: Column) -> Column:
    """Addresses on lines that talk to the network and on lines that assign variables such lines use, directly or through others.

    A line that ends in a backslash, an open parenthesis or a comma goes on in the next one.
    """
    lines = F.split(F.regexp_replace(command, r"([\\(,][ \t\r]*)\n", "$1 "), "\n")
    read = F.transform(lines, lambda x: F.struct(x.alias("text"), reaches_out(x).alias("out"), F.regexp_extract(x, ASSIGNED, 1).alias("sets")))
    kept = F.filter(read, lambda x: x["out"] | (x["sets"] != ""))
    named = lambda x: F.regexp_extract_all(x["text"], F.lit(_NAME), F.lit(0))
    begun = F.array_distinct(F.flatten(F.transform(F.filter(kept, lambda x: x["out"]), named)))
    sets = F.filter(kept, lambda x: ~x["out"])
    # a round reaches what one more assignment names; there are no more rounds than assignments
    rounds = F.when(F.size(sets) > 0, F.sequence(F.lit(1), F.size(sets))).otherwise(F.array().cast("array<int>"))
    used = F.aggregate(rounds, begun, lambda names, _: F.array_union(names, F.flatten(F.transform(F.filter(sets, lambda x: F.array_contains(names, x["sets"])), named))))
    hit = F.transform(F.filter(kept, lambda x: x["out"] | F.array_contains(used, x["sets"])), lambda x: F.regexp_extract_all(x["text"], F.lit(URL), F.lit(0)))
    some = command.contains("://") & command.rlike(NETWORK.replace("(?:^|", "(?:(?m:^)|"))
    return F.when(some, F.flatten(hit)).otherwise(F.array().cast("array<string>"))


def tool_urls(calls: DataFrame) -> DataFrame:
    """A row per address of (call_id, category, arguments JSON, command, result): position, url, host, source.

    An address counts once per call, by where it is read first: arguments, commands, opened pages, and for web tools the results' other links. All of
    a call's addresses are given out, however many.
    """
    cols = [F.col(c).cast("string").alias(c) for c in ("call_id", "category", "arguments", "command", "result")]
    rows = calls.select(*cols).withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    sources = {
        "input": argument_urls(F.col("arguments")), "command": command_urls(F.col("command")), "result": F.regexp_extract_all("result", F.lit(OPENED), F.lit(1)),
        "search_result": F.when(F.col("category") == "web", F.regexp_extract_all("result", F.lit(URL), F.lit(0))),
    }
    tagged = lambda urls, name: F.transform(F.coalesce(urls, none), lambda u: F.struct(clean_url(u).alias("url"), F.lit(name).alias("source")))
    each = [tagged(urls, name) for name, urls in sources.items()]
    found = rows.select("row", "call_id", F.posexplode(F.concat(*each)).alias("at", "x")).select("row", "call_id", "at", "x.*").where("url is not null")
    first = found.groupBy("row", "call_id", "url").agg(F.min(F.struct("at", "source")).alias("f")).select("row", "call_id", "url", "f.*")
    place = F.row_number().over(Window.partitionBy("row").orderBy("at")) - 1
    return first.select("call_id", place.alias("position"), "url", host_of(F.col("url")).alias("host"), "source")

import fnmatch
import random
import re

from ledgerfold.llm import queries, urls


def plain_canonical(host, path):
    """The canonical form step by step, a character or segment at a time."""
    host = host.split("@")[-1]
    if ":" in host and all(c in "0123456789" for c in host[host.rindex(":") + 1 :]):
        host = host[: host.rindex(":")]
    while host.endswith("."):
        host = host[:-1]
    out, i = "", 0
    while i < len(path):
        code = path[i + 1 : i + 3]
        if path[i] == "%" and re.fullmatch("[0-9a-fA-F]{2}", code) and chr(int(code, 16)) in urls.UNRESERVED:
            out, i = out + chr(int(code, 16)), i + 3
        else:
            out, i = out + path[i], i + 1
    out = "".join(c.lower() if c.isascii() else c for c in out)
    if "//" not in out and "/." not in out:
        return host, out
    kept, parts = [], [x for i, x in enumerate(out.split("/")) if x or i == out.count("/")]
    for x in parts:
        kept = kept[:-1] if x == ".." else kept if x == "." else [*kept, x]
    return host, "/" + "/".join(kept) + ("/" if kept and parts[-1] in (".", "..") else "")


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    rest = re.split("[?#]", rest)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fit = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fit, key=lambda r: len(r.text), default=None)
    chost, cpath = plain_canonical(host, path)
    bad = any(fnmatch.fnmatchcase(f".{chost}", a) and fnmatch.fnmatchcase(cpath, b) for a, b in urls.BLOCK_GLOBS)
    return host, path, rule and rule.text, rule.verdict if rule else "block" if bad else "allow"


def test_query(spark, data):
    p = spark.read.parquet(f"{data}/pages.parquet").toPandas()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in queries.op9_url_filters(spark, data).collect()}
    assert got == {i: brute(u) for i, u in zip(p["page_id"], p["url"], strict=True)}


def test_awkward_urls(spark):
    bad = [
        "http://u:p@casino.org:8080/x", "http://h./%63asino/a", "http://h/a/./b/../../login", "http://h//x//y.EXE", "http://h/a/..", "http://h/../..", "http://h/.hidden/x", "http://ads.example.org/a", "http://badsite.org/loginx",
        None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7x", "https://a.b.example.net/de/8", "x://com/en/", "http://evil.org/x.com/en/", "http://notexample.com/en/7", "ftp://h?q=/en/", "http://é.ORG/es/#f", "http://a://b.com/en/", "http://h/" + "a" * 5000 + ".zip", "http://com/en",
    ]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(bad)] + [(0, bad[4], "x", "y")], "page_id long, url string, host string, rule string")
    got = urls.judge_urls(df, queries.URL_RULES).collect()
    assert sorted(tuple(map(str, (r["host"], r["path"], r["rule"], r["verdict"]))) for r in got) == sorted(tuple(map(str, brute(u))) for u in [*bad, bad[4]])
    assert urls.judge_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_automaton_against_globs():
    rng = random.Random(2)
    pick = lambda n, stars: "".join(rng.choice("ab*" if stars else "ab") for _ in range(rng.randint(0, n)))
    globs = [(pick(6, True), pick(30, True)) for _ in range(40)]
    texts = [(pick(7, False).encode(), pick(40, False).encode()) for _ in range(300)]
    got = urls.Automaton(globs).match(texts)
    for row, (h, p) in zip(got, texts, strict=True):
        assert row.tolist() == [fnmatch.fnmatchcase(h.decode(), a) and fnmatch.fnmatchcase(p.decode(), b) for a, b in globs]


def test_urls_of_any_length():
    auto = urls.Automaton(list(urls.BLOCK_GLOBS))
    long_ = b"/" + b"a" * 600_000
    texts = [(b".h", b"/x")] * 3000 + [(b".h", long_), (b".h", long_ + b".zip"), (b".casino.org", long_)]
    got = auto.match(texts).any(1)
    assert got.tolist() == [False] * 3001 + [True, True] and auto.words > 16
    assert all(auto._match_one(*t) == auto.match([t] * 9)[0].tolist() for t in [(b".ads.x", b"/login/a.zip"), (b".h", b""), (b".", b"/cgi-bin")])

"""Reached addresses: which lines count, variables, arguments, results."""

import json

from pyspark.sql import functions as F

from ledgerfold.operators import addresses as A


def urls(spark, command):
    return spark.createDataFrame([(command,)], "c string").select(A.command_urls(F.col("c")).alias("u")).first()["u"]


def test_lines_that_reach_out(spark):
    yes = ["git  remote add up https://a.example/x", "cd x; git clone https://a.example/y", "open 'https://a.example'", "r = requests.get(URL)", "await fetch(url)", "Invoke-WebRequest https://a.example", "x=$(curl -s y)", "axios(x)"]
    no = ["git status", "echo curl", "reopen https://a.example", "cat fetch.txt", "git remote -v", "prefetch(x)", "xaxiosy", "my_requests.get_all(x)", "libcurl https://a.example"]
    got = {r["x"]: r["y"] for r in spark.createDataFrame([(x,) for x in yes + no], "x string").select("x", A.reaches_out(F.col("x")).alias("y")).collect()}
    assert [x for x in yes if not got[x]] == [] and [x for x in no if got[x]] == []


def test_variables_are_followed(spark):
    assert urls(spark, 'H=https://svc.example.org\nU="$H/api"\nwget -qO- "$U"') == ["https://svc.example.org"]
    assert urls(spark, 'echo "open https://example.com in a browser"') == []
    assert urls(spark, "A=https://a.example\nB=https://b.example\nexport C = $A\ncurl $C https://c.example") == ["https://a.example", "https://c.example"]
    assert urls(spark, "curl \\\n  https://a.example/x \\\n  -o y\ngit log https://no.example") == ["https://a.example/x"]
    assert urls(spark, "A=$B\nB=$A\nB=https://loop.example\ncurl $A") == ["https://loop.example"]
    assert len(urls(spark, "\n".join(f"curl https://a.example/{i}" for i in range(80)))) == 80
    assert urls(spark, None) == []


def test_clean(spark):
    rows = {"https://Example.com/a).": ("https://Example.com/a", "example.com"), "https://${HOST}/api": (None, ""), "https://u:p@H.example:8080/x": ("https://u:p@H.example:8080/x", "h.example:8080"), "ftp://": (None, ""), "no": (None, "")}
    long_ = "https://a.example/" + "p" * 5000
    rows[long_] = (long_, "a.example")
    got = spark.createDataFrame([(r,) for r in rows], "x string").select("x", A.clean_url(F.col("x")).alias("u"), A.host_of(A.clean_url(F.col("x"))).alias("h")).collect()
    assert {r["x"]: (r["u"], r["h"] or "") for r in got} == rows


def test_calls(spark):
    nested = json.dumps({"action": {"type": "x", "Url": "https://one.example/\"q\""}, "urls": ["https://two.example", "https://three.example/a,b"], "prompt": 'see "url": "https://no.example"', "link": {"x": 1}})
    calls = [
        ("a", "web", nested, None, "Web search completed for: https://one.example/p\nhttps://two.example, (https://four.example)."),
        ("b", "shell", None, "curl https://x.example; curl https://x.example", "https://unseen.example"), ("c", "web", "not json", None, None),
    ]
    df = spark.createDataFrame(calls, "call_id string, category string, arguments string, command string, result string")
    got = [(r["call_id"], r["position"], r["host"], r["source"]) for r in A.tool_urls(df).orderBy("call_id", "position").collect()]
    assert got == [
        ("a", 0, "one.example", "input"), ("a", 1, "two.example", "input"), ("a", 2, "three.example", "input"), ("a", 3, "one.example", "result"), ("a", 4, "four.example", "search_result"), ("b", 0, "x.example", "command"),
    ]
    assert "Python" not in A.tool_urls(df)._jdf.queryExecution().toString()

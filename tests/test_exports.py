"""Records of exports against plain parsing, however the file is cut into byte ranges."""

import json
import random

import pytest

from ledgerfold.sources import transcripts
from ledgerfold.sources.exports import json_records


def wild(seed, n):
    rng = random.Random(seed)
    bits = ['"', "\\", "{", "}", "}{", '\\"', "[", "]", ",", "\n", "é", "日本", "plain text ", '{"a": 1}', "\\\\"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    thing = lambda d: {text(): rng.choice([text(), rng.random(), None, [text(), {}], thing(d - 1) if d else {}]) for _ in range(rng.randint(0, 4))}
    return [thing(3) for _ in range(n)]


@pytest.mark.parametrize("cut", ["64", "1000", "128m"])
@pytest.mark.parametrize("indent", [None, 1])
def test_arrays_and_lists(spark, tmp_path, cut, indent):
    held = {"array.json": wild(1, 40), "listed.json": wild(2, 30), "one.json": wild(3, 1), "empty.json": [], "none.json": []}
    for name, records in held.items():
        whole = {"workspaces": records} if name in ("listed.json", "none.json") else records[0] if name == "one.json" else records
        (tmp_path / name).write_text(json.dumps(whole, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    saved = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = json_records(spark, str(tmp_path))
        got = {}
        for r in df.collect():
            got.setdefault(r["file"].rsplit("/", 1)[-1], {})[r["number"]] = json.loads(r["record"])
        for name, records in held.items():
            found = got.get(name, {})
            if name == "none.json":
                assert not found or list(found.values()) == [{"workspaces": []}]
                continue
            assert [found[i] for i in sorted(found)] == records and sorted(found) == list(range(len(records))), name
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_one_export_is_many_tasks(spark, tmp_path):
    node = lambda i: {"message": {"id": f"m{i}", "author": {"role": "user"}, "create_time": float(i), "content": {"parts": ["say {" + "x" * 300]}}}
    (tmp_path / "c.json").write_text(json.dumps([{"conversation_id": f"c{i}", "title": "t", "mapping": {"a": node(i)}} for i in range(400)]))
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = transcripts.read_chatgpt(spark, str(tmp_path / "c.json"))
        assert sorted(r["native_id"] for r in got.collect()) == sorted(f"m{i}" for i in range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)

import re

from ledgerfold.llm import licenses, queries
from tests.llm.helpers import AWKWARD, docs

LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def brute(text):
    w = re.findall(licenses.WORD, (text or "").translate(LOWER))
    at = sorted((i, v) for p, v in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({v for _, v in at}))


def shape(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = {r["doc_id"]: r for r in queries.op8_license_scans(spark, sf).collect()}
    assert len(got) == len(d)
    for i, t in zip(d["doc_id"], d["text"], strict=True):
        r = got[i]
        assert shape(r) == brute(t) and 0 <= r["score"] <= 1
        labels = set(filter(None, r["labels"].split(",")))
        assert set(filter(None, r["base_labels"].split(","))) <= labels
        assert ("cc-by-nc" in labels) == ("CC BY-NC 4.0" in t)


def test_templates_need_their_key_phrases(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
        "permission charge person obtaining copy software associated documentation granted hereby", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met",
        "MIT-License and mit/LICENSE", "nothing of that kind", "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(6)] == ["mit", "", "bsd", "mit", "", "apache,cc-by-nc"]
    assert got[3]["n_base"] == 2 and got[3]["score"] >= 0.5 and got[0]["base_labels"] == "" and got[0]["score"] == 1.0


def test_awkward_rows(spark):
    rows = [*AWKWARD, "MIT license", "MIT license", (3, "MIT license")]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    assert sorted(map(str, map(shape, got))) == sorted(str(brute(t[1] if isinstance(t, tuple) else t)) for t in rows)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def test_common_notices_keep_their_labels(spark):
    """A notice in 1 %, a third, half and all of the files is found in each of them."""
    for every in (100, 3, 2, 1):
        texts = [f"file {i} text " + (BSD if i % every == 0 else "of no licence") for i in range(300)]
        got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
        assert all(got[i] == ("bsd" if i % every == 0 else "") for i in range(300)), every
    texts = [f"file {i} licensed under CC BY-NC 4.0" if i % 3 else f"file {i}" for i in range(300)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert all(got[i] == ("cc-by-nc" if i % 3 else "") for i in range(300))


def test_a_file_with_several_notices(spark):
    texts = [f"{MIT} and so on. {BSD}. Licensed under CC BY-NC 4.0. This is free and unencumbered software released into the public domain.", "nothing"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {0: "bsd,cc-by-nc,mit,unlicense", 1: ""}


def test_words_are_those_of_the_pattern(spark):
    texts = ["", "é-È_x2 \u212a K\x00a", "İ ß 日本 license", "a  b\t\n c", "--", "x" * 5000]
    got = {r["doc_id"]: r["n_words"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t)[0] for t in texts]

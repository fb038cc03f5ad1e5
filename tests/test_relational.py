"""The relational source against the store's own rows, by ranges and by changed sessions."""

import sqlite3

import pytest

from ledgerfold.sources import relational as R
from ledgerfold.sources.transcripts import pick_message_field


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "store #1.db")
    db = sqlite3.connect(path)
    db.execute('CREATE TABLE sessions(id TEXT PRIMARY KEY, status TEXT, "odd name" REAL)')
    db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, session_id TEXT, content TEXT, full_message TEXT, text TEXT, sent_at TEXT, cancelled_at TEXT, raw BLOB)")
    db.execute("CREATE INDEX by_session ON messages(session_id, sent_at)")
    for s in range(12):
        db.execute("INSERT INTO sessions VALUES (?, 'open', ?)", (f"s{s}", s / 2))
    for i in range(1, 1001):
        row = (i * 3, f"s{i % 11}", f"c{i}", "longer " + str(i) if i % 2 else None, "", f"2026-01-01T00:{i % 60:02d}", None, b"\x00\xff")
        db.execute("INSERT INTO messages VALUES (?,?,?,?,?,?,?,?)", row)
    db.execute("INSERT INTO messages(id, session_id, content) VALUES (9001, NULL, 'lost')")
    db.commit()
    return path, db


def test_ranges_hold_every_row_once(spark, store):
    path, db = store
    df = R.read_table(spark, path, "messages", rows=500)
    assert df.rdd.getNumPartitions() == 18
    got = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())
    assert got == sorted((r[0], *r) for r in db.execute("SELECT * FROM messages").fetchall())
    assert R.read_table(spark, path, "sessions").select("`odd name`").agg({"odd name": "sum"}).first()[0] == 33.0
    picked = pick_message_field(df.where("row_id = 3"), ["content", "full_message", "text"]).first()
    assert (picked["text"], picked["text_field"]) == ("longer 1", "full_message")
    db.execute("CREATE TABLE empty(a INT)")
    db.commit()
    assert R.read_table(spark, path, "empty").collect() == []


def test_second_read_takes_changed_sessions_only(spark, store):
    path, db = store
    signals = lambda: R.session_signals(spark, path, "messages", "session_id", ("sent_at", "cancelled_at"), "sessions", rows=500)
    first = spark.createDataFrame(signals().collect(), signals().schema)
    assert {r["session_id"]: r["messages"] for r in first.collect()} == dict(db.execute("SELECT s.id, count(m.id) FROM sessions s LEFT JOIN messages m ON m.session_id = s.id GROUP BY 1").fetchall())
    read = lambda changed: R.read_sessions(spark, path, "messages", "session_id", changed)
    assert read(R.changed_sessions(signals(), None)).count() == 1000
    assert R.changed_sessions(signals(), first).count() == 0
    db.execute("INSERT INTO messages(id, session_id, content) VALUES (9100, 's3', 'new')")
    db.execute("UPDATE messages SET cancelled_at = 'x' WHERE id = 3")  # of s1
    db.execute("UPDATE sessions SET status = 'done' WHERE id = 's5'")
    db.execute("INSERT INTO messages(id, session_id, content) VALUES (9200, 'fresh', 'new')")
    db.commit()
    changed = R.changed_sessions(signals(), first)
    assert {r["session_id"] for r in changed.collect()} == {"s1", "s3", "s5", "fresh"}
    got = sorted(r["id"] for r in read(changed).collect())
    assert got == sorted(r[0] for r in db.execute("SELECT id FROM messages WHERE session_id IN ('s1', 's3', 's5', 'fresh')").fetchall())

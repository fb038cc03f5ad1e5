"""Simple commands, programs and flags of shell lines against tables of expected rows."""

import json

from pyspark.sql import functions as F

from ledgerfold.operators import shell

CASES = [
    ("pushd build && git --git-dir ../.git log -3 | tail -1", "git", "log", "vcs", 3, True, False, False),
    ("MODE=ci nice cargo build --release 2>&1", "cargo", "build", "build", 1, False, False, False),
    ("yarn run lint:fix >> lint.log", "yarn", "run lint:fix", "test", 1, False, True, False),
    ("perl -pi -e 's/x/y/' notes.md", "perl", "-e", "file-write", 1, False, False, False),
    ("printf 'a; b' ; grep -c 'x|y' notes.md", "grep", "", "search", 2, False, False, False),
    ("tee conf.ini <<'END'\nkey = a | b\nEND\nstat conf.ini", "tee", "", "file-write", 2, False, False, True),
    ("env LANG=C python3.12 -m pytest -q tests", "python3.12", "-m pytest", "test", 1, False, False, False),
    ("while true; do kubectl get pods; done", "kubectl", "get", "container", 3, False, False, False),
    ("timeout 5 ping -c1 host.example", "ping", "", "network", 1, False, False, False),
    ("sudo -E systemctl restart web &", "systemctl", "restart", "process", 1, False, False, False),
    ("uv pip install duckdb", "uv", "pip", "package", 1, False, False, False),
    ("cd /srv/app && git -C lib status --short | head -5", "git", "status", "vcs", 3, True, False, False),
    ("A=1 timeout 30 go test ./... 2>&1", "go", "test", "test", 1, False, False, False),
    ("npm run build > out.log", "npm", "run build", "build", 1, False, True, False),
    ("sed -i '' 's/a/b/' x.go", "sed", "", "file-write", 1, False, False, False),
    ("sed -n '1,20p' x.go", "sed", "", "read", 1, False, False, False),
    ("git commit -m \"$(cat <<'EOF'\nMend it; don't break\n\nSigned-off: x\nEOF\n)\" && git push", "git", "commit", "vcs", 2, False, False, True),
    ("cat > out.txt <<EOF\none && two\nEOF\nls -la", "cat", "", "read", 2, False, True, True),
    ("paste <<A <<B\nx | y\nA\nz && w\nB\ngrep q f", "paste", "", "other", 2, False, False, True),
    ("sudo -n /usr/bin/lsof -i :3000 &", "lsof", "", "process", 1, False, False, False),
    ("if [ -f a ]; then cat a; fi", "cat", "", "read", 3, False, False, False),
    ("(cd x; make -j 4 all) && echo ok", "cd", "", "shell", 2, False, False, False),
    ("echo $(ls | wc -l); ./run.sh", "run.sh", "", "run", 2, False, False, False),
    ("# a note | with bars\nrg 'x' # tail; note", "rg", "", "search", 1, False, False, False),
    ("node -e \"a && b\" ; echo 'it''s'", "node", "-e", "run", 2, False, False, False),
    ("pnpm --filter web exec vitest", "pnpm", "exec vitest", "run", 1, False, False, False),
    ("X=1 Y=2", "", "", "other", 1, False, False, False),
    ("env", "env", "", "shell", 1, False, False, False),
    ("echo a\\;b '<<' c\nls", "ls", "", "list", 2, False, False, False),
    ("diff <(sort a) <(sort b) || true", "diff", "", "read", 2, False, False, False),
    ("cmd &> all.log; kill -9 1 2>/dev/null", "cmd", "", "other", 2, False, True, False),
    ("python -", "python", "stdin", "run", 1, False, False, False),
    ("git", "git", "", "vcs", 1, False, False, False),
]


def test_lines(spark):
    df = spark.createDataFrame([(str(i), c[0]) for i, c in enumerate(CASES)], "call_id string, command string")
    got = {}
    for r in shell.shell_commands(df).collect():
        got.setdefault(int(r["call_id"]), []).append(r)
    for i, (line, program, sub, category, n, pipe, redirect, heredoc) in enumerate(CASES):
        rows = sorted(got[i], key=lambda r: r["position"])
        assert [r["position"] for r in rows] == list(range(n)), (line, [r["text"] for r in rows])
        p = next(r for r in rows if r["is_primary"])
        assert (p["program"], p["subcommand"], p["category"]) == (program, sub, category), line
        assert (p["has_pipe"], p["has_redirect"], p["has_heredoc"]) == (pipe, redirect, heredoc), line


def test_operators_texts_and_background(spark):
    df = spark.createDataFrame([("a", "x && y || z | w ; v & u\nt"), ("b", "sleep 10 &"), ("c", "go test 2>&1"), ("d", None), ("e", "  \n ")], "call_id string, command string")
    rows = shell.shell_commands(df).orderBy("call_id", "position").collect()
    assert [(r["operator"], r["text"]) for r in rows if r["call_id"] == "a"] == [("", "x"), ("&&", "y"), ("||", "z"), ("|", "w"), (";", "v"), ("&", "u"), (";", "t")]
    assert {r["call_id"]: r["is_backgrounded"] for r in rows} == {"a": True, "b": True, "c": False}


def test_long_lines_stay_linear(spark):
    line = "; ".join(f"echo \"{'q' * 50}\\\"{i}\"" for i in range(20_000))
    got = shell.shell_commands(spark.createDataFrame([("a", line)], "call_id string, command string"))
    assert got.agg(F.count(F.lit(1)), F.max("position")).first() == (20_000, 19_999)


def test_commands_of_calls(spark):
    j = json.dumps
    script = 'const cmds = ["go vet ./...", "echo \\"a]\\""]; await tools.exec_command({cmd:"ls -la"}); run({cmd: `git status`})'
    calls = [
        ("text", "Bash", j({"command": "ls | wc"}), None), ("cmd", "exec_command", j({"cmd": "pwd"}), None), ("bash", "shell", j({"command": ["bash", "-lc", "git pull && make"]}), None),
        ("words", "shell", j({"command": ["rg", "-n", "x"]}), None), ("script", "exec", script, None), ("other", "Read", j({"command": "ls"}), None), ("none", "shell", j({"x": 1}), None),
        ("ran", "exec", script, j({"commands": [{"command": "echo start", "exit_code": 0}, {"command": "", "exit_code": 9}, {"command": "go test ./...", "exit_code": 1, "duration_ms": 250.0}]})),
    ]
    lines = shell.call_commands(spark.createDataFrame(calls, "call_id string, tool string, input string, details string"))
    found = {}
    for r in lines.orderBy("call_id", "line").collect():
        found.setdefault(r["call_id"], []).append(r["command"])
    assert found == {
        "text": ["ls | wc"], "cmd": ["pwd"], "bash": ["git pull && make"], "words": ["rg -n x"], "script": ["go vet ./...", 'echo "a]"', "ls -la", "git status"], "ran": ["echo start", "go test ./..."],
    }
    rows = shell.shell_commands(lines).orderBy("call_id", "position").collect()
    ran = [(r["operator"], r["program"], r["exit_code"], r["duration_ms"], r["is_primary"]) for r in rows if r["call_id"] == "ran"]
    assert ran == [("", "echo", 0, None, False), ("script", "go", 1, 250, True)]


def test_no_python_worker(spark):
    df = spark.createDataFrame([("a", "ls")], "call_id string, command string")
    plan = shell.shell_commands(df)._jdf.queryExecution().toString()
    assert "MapIn" not in plan and "Python" not in plan

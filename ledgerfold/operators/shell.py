"""Shell command lines of tool calls: their simple commands, programs, actions and flags, in column expressions.

A line is cut into lexemes by one pattern (quoted texts, escapes, operators, parentheses, words). The depth of parentheses at a lexeme is
a running sum held at zero or above, the number of its simple command is a running count of the control operators outside of them, and a simple
command is the lexemes of one number put together. Everything is a reading of the text; nothing is evaluated.

Scale: lexemes carry a row id and a position; windows are as long as one line's lexemes, and no lexeme leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import text as T

#: Programs that set the shell up.
SETUP = ("for", "while", "until", "if", "case", "select", "[", "[[", "test", "cd", "pwd", "pushd", "popd", "export", "set", "unset", "source", ".", "true", ":", "echo", "printf", "sleep", "trap", "shopt", "local", "declare", "alias")
#: Words of the shell that stand before a command.
KEYWORDS = ("then", "do", "else", "elif", "!", "{", "(", "done", "fi", "esac", "}")
#: Programs that run the command after them, with the number of plain arguments they take themselves.
WRAPPERS = {"sudo": 0, "time": 0, "nohup": 0, "command": 0, "exec": 0, "env": 0, "timeout": 1, "gtimeout": 1, "nice": 0, "caffeinate": 0, "stdbuf": 0, "xcrun": 0}

#: What programs do.
PROGRAMS = {
    "read": ("cat", "head", "tail", "less", "more", "nl", "bat", "wc", "file", "stat", "xxd", "hexdump", "od", "strings", "jq", "yq", "awk", "cut", "sort", "uniq", "column", "tr", "diff", "cmp", "md5", "shasum", "sha256sum", "base64", "plutil", "readlink", "realpath"),
    "search": ("grep", "rg", "ag", "ack", "find", "fd", "locate", "mdfind", "egrep", "fgrep"),
    "list": ("ls", "tree", "du", "df", "pwd", "eza", "exa"),
    "vcs": ("git", "gh"),
    "build": ("make", "tsc", "esbuild", "swiftc", "xcodebuild", "gradle", "mvn", "cmake", "ninja", "vite", "webpack", "rollup"),
    "test": ("pytest", "jest", "vitest", "playwright", "mocha"),
    "package": ("brew", "pip", "pip3", "uv", "poetry", "conda", "apt", "apt-get", "rustup"),
    "file-write": ("mv", "cp", "rm", "mkdir", "touch", "chmod", "ln", "tee", "patch", "rsync", "unzip", "zip", "tar", "rmdir", "install"),
    "network": ("curl", "wget", "ssh", "scp", "nc", "ping", "http", "dig", "nslookup"),
    "process": ("ps", "kill", "pkill", "pgrep", "lsof", "top", "open", "osascript", "launchctl", "systemctl", "killall", "wait", "jobs", "screencapture"),
    "run": ("node", "ruby", "perl", "bash", "sh", "zsh", "tsx", "ts-node", "java", "npx", "bunx", "pnpx"),
    "database": ("sqlite3", "psql", "mysql", "redis-cli", "duckdb"),
    "container": ("docker", "kubectl", "helm", "podman"),
    "cloud": ("gcloud", "aws", "terraform", "vercel", "firebase", "supabase"),
    "shell": ("cd", "pushd", "popd", "export", "set", "unset", "source", ".", "true", ":", "echo", "printf", "sleep", "which", "type", "env", "date", "whoami", "test", "[", "[[", "command", "trap", "exit", "hostname", "uname", "sw_vers", "id", "tput"),
}

#: Programs whose first operand names the action.
SUBCOMMANDS = ("git", "go", "npm", "pnpm", "yarn", "bun", "cargo", "docker", "kubectl", "gh", "brew", "pip", "pip3", "uv", "poetry", "make", "gcloud", "aws", "terraform", "swift", "deno", "npx", "bunx", "pnpx", "rustup", "conda", "apt", "apt-get", "systemctl", "launchctl", "claude", "codex", "gradle", "mvn", "dotnet", "helm", "firebase", "vercel", "supabase", "prisma", "turbo", "nx", "just", "task", "defaults", "security", "diskutil", "hdiutil")
#: Global options of such programs that take a value.
OPTION_VALUES = {
    "git": ("-C", "-c", "--git-dir", "--work-tree"),
    "npm": ("--prefix", "-w", "--workspace"),
    "pnpm": ("-C", "--dir", "--filter", "-F"),
    "yarn": ("--cwd",),
    "make": ("-C", "-f", "-j"),
    "docker": ("-H", "--context"),
    "cargo": ("--manifest-path",),
    "gh": ("-R", "--repo"),
}
#: Programs whose action may run a named script.
SCRIPTED = ("npm", "pnpm", "yarn", "bun")
#: Language tools, whose action or script tells what they do.
LANGUAGE_TOOLS = ("go", "cargo", "npm", "pnpm", "yarn", "bun", "deno", "swift", "dotnet")
ACTIONS = {
    "test": ("test", "vet", "lint"),
    "build": ("build", "compile", "generate"),
    "package": ("install", "i", "ci", "add", "get", "mod", "remove", "update", "upgrade", "uninstall"),
    "file-write": ("fmt", "format"),
}

#: Tools that run shell commands.
SHELL_TOOLS = ("bash", "shell", "exec_command", "exec", "local_shell", "run", "container.exec", "run_command", "execute_command")
#: How scripts write the commands they run: a list, a quoted text, a template.
_STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
SCRIPT_LIST = r'\bcmds\s*=\s*\[((?:[^\]"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)\]'
SCRIPT_TEXT = r'\bcmd"?\s*:\s*' + _STRING
SCRIPT_TEMPLATE = r'\bcmd"?\s*:\s*`([^`]*)`'

LINES = "call_id string, line int, command string, exit_code long, duration_ms long"
_HEREDOC = r"(?<!<)<<(?!<)-?[ \t]*['\"\\]?{name}['\"]?"
_DELIMITER = r"([^\s;|&)'\"\\]+)"
_LEXEME = "|".join(
    (
        r"'[^']*+(?:'|\z)", r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)', r"`[^`]*+(?:`|\z)", r"\\.", r"(?<!\S)#[^\n]*+",
        r"<<<", r"<<-?", r"\d*>&\d*", r"<&\d*", r"&>>?", r">>?", r"<", r"&&", r"\|\|", r"[|;&\n()]", r"[^\S\n]++", r"[^\s'\"`\\<>&|;()#]++", r"#", r"\\",
    )
)
_WORD = r"""\d*[<>]|(?:'[^']*+'?|"[^"]*+"?|\\.|[^\s'"\\<>])++"""
_CONTROLS = ("&&", "||", ";", "|", "&", "\n")


def _decoded(literal: Column) -> Column:
    """The text of a JSON string's inside; the inside itself where it is none."""
    return F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), literal, F.lit('"]')), "array<string>"), F.lit(0)), literal)


def script_commands(script: Column) -> Column:
    """Commands that a script runs: those of lists first, then quoted ones, then templates."""
    inside = F.flatten(F.transform(F.regexp_extract_all(script, F.lit(SCRIPT_LIST), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(_STRING), F.lit(1))))
    quoted = F.concat(inside, F.regexp_extract_all(script, F.lit(SCRIPT_TEXT), F.lit(1)))
    return F.concat(F.transform(quoted, _decoded), F.regexp_extract_all(script, F.lit(SCRIPT_TEMPLATE), F.lit(1)))


def call_commands(calls: DataFrame) -> DataFrame:
    """Command lines of (call_id, tool, input, details), JSON texts or a script: (call_id, line, command, exit_code, duration_ms).

    Executions listed in the details come first; else a shell tool's ``command`` or ``cmd``, a text or a list of words (of ``sh -c text`` the text); else
    the commands its script names. Other calls have none.
    """
    run = F.from_json(F.get_json_object("details", "$.commands"), "array<struct<command:string,exit_code:double,duration_ms:double>>")
    listed = F.filter(run, lambda x: F.coalesce(x["command"], F.lit("")) != "")
    given = F.coalesce(F.get_json_object("input", "$.command"), F.get_json_object("input", "$.cmd"))
    words = F.when(given.startswith("["), F.from_json(given, "array<string>"))
    wrapped = (F.size(words) >= 3) & F.get(words, F.lit(1)).isin("-lc", "-c") & F.get(words, F.lit(0)).endswith("sh")
    line = F.when(words.isNull(), given).when(wrapped, F.element_at(words, -1)).otherwise(F.array_join(words, " "))
    bare = F.when(~F.ltrim("input").startswith("{"), script_commands(F.col("input")))
    texts = F.when(F.coalesce(line, F.lit("")) != "", F.array(line)).otherwise(bare)
    plain = F.transform(texts, lambda t: F.struct(t.alias("command"), F.lit(None).cast("double").alias("exit_code"), F.lit(None).cast("double").alias("duration_ms")))
    lines = F.when(F.size(listed) > 0, listed).when(F.lower("tool").isin(*SHELL_TOOLS), plain)
    out = calls.select(F.col("call_id").cast("string").alias("call_id"), F.posexplode(lines).alias("line", "x"))
    return out.select("call_id", "line", "x.command", F.col("x.exit_code").cast("long").alias("exit_code"), F.col("x.duration_ms").cast("long").alias("duration_ms"))


def without_heredocs(line: Column) -> Column:
    """A line without the bodies of its heredocs (up to two on one line); an unended one goes to the end."""
    one, other = (_HEREDOC.format(name=_DELIMITER) for _ in range(2))
    body = lambda n: rf"(?:(?s:.*?)^[ \t]*\{n}[ \t]*$|(?s:.*)\z)"
    quoted = r"((?<!\w)'[^']*+')"
    two = rf"(?m){quoted}|({one}[^\n]*?{other}[^\n]*\n){body(3)}\n{body(4)}(?:\n|\z)"
    single = rf"(?m){quoted}|({one}[^\n]*\n){body(3)}(?:\n|\z)"
    done = F.regexp_replace(line, F.lit(two), F.lit("$1$2"))
    return F.when(line.contains("<<"), F.when(done != line, done).otherwise(F.regexp_replace(line, F.lit(single), F.lit("$1$2")))).otherwise(line)


def words_of(text: Column) -> Column:
    """The words of a simple command without quotes, up to the first redirection."""
    raw = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    cut = F.filter(F.transform(raw, lambda w, i: F.when(w.rlike(r"^\d*[<>]$"), i)), lambda i: i.isNotNull())
    kept = F.slice(raw, F.lit(1), F.coalesce(F.get(cut, F.lit(0)), F.size(raw)))
    return F.transform(kept, lambda w: F.regexp_replace(w, F.lit(r"""'([^']*)'?|"([^"]*)"?|\\(.)"""), F.lit("$1$2$3")))


def _base(word: Column) -> Column:
    return F.regexp_extract(word, r"([^/]*)/*$", 1)


def _indexed(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))


def program_at(words: Column) -> Column:
    """Where the program stands behind keywords, assignments, and wrappers with their options and arguments; -1 without one."""
    n = F.size(words)
    state = lambda at, options, left, env: F.struct(at.alias("at"), options.alias("options"), left.alias("left"), env.alias("env"))
    no, none, zero = F.lit(False), F.lit(-1), F.lit(0)

    def step(acc: Column, x: Column) -> Column:
        w, base = x["w"], _base(x["w"])
        option = acc["options"] & (w.startswith("-") | (acc["env"] & w.contains("=")))
        passed = w.isin(*KEYWORDS) | w.rlike(r"^[A-Za-z_]\w*=")
        takes = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for pair in WRAPPERS.items() for v in pair)), base), zero)
        wraps = base.isin(*WRAPPERS) & (x["i"] < n - 1)
        ways = F.when((acc["at"] >= 0) | option, acc).when(acc["left"] > 0, state(none, no, acc["left"] - 1, no))
        return ways.when(passed, state(none, no, zero, no)).when(wraps, state(none, F.lit(True), takes, base == "env")).otherwise(state(x["i"], no, zero, no))

    return F.aggregate(_indexed(words), state(none, no, zero, no), step, lambda acc: acc["at"])


def _first(words: Column, test) -> Column:
    """The first (word, index) that passes, null without one."""
    return F.get(F.filter(_indexed(words), test), F.lit(0))


def _operand_at(words: Column, valued: Column) -> Column:
    """Index of the first word that is no option and no option's value; -1 without one."""
    start = F.struct(F.lit(-1).alias("at"), F.lit(False).alias("skip"))

    def step(acc: Column, x: Column) -> Column:
        dash = x["w"].startswith("-")
        found = F.struct(x["i"].alias("at"), F.lit(False).alias("skip"))
        return F.when(acc["at"] >= 0, acc).when(acc["skip"], start).when(dash, F.struct(F.lit(-1).alias("at"), F.array_contains(valued, x["w"]).alias("skip"))).otherwise(found)

    return F.aggregate(_indexed(words), start, step, lambda acc: acc["at"])


INTERPRETERS = ("node", "ruby", "perl", "bash", "sh", "zsh", "tsx", "ts-node")


def subcommand(program: Column, rest: Column) -> Column:
    """The module, script or action after a program; empty without one."""
    python = program.rlike(r"^python(?:3(?:\.\d+)?)?$")
    n = F.size(rest)
    module = _first(rest, lambda x: ((x["w"] == "-m") & (x["i"] < n - 1)) | (x["w"] == "-c") | ~x["w"].startswith("-") | (x["w"] == "-"))
    of_python = F.when(module["w"] == "-m", F.concat(F.lit("-m "), F.get(rest, module["i"] + 1))).when(module["w"] == "-c", "-c").when(module["w"] == "-", "stdin").otherwise(_base(module["w"]))
    script = _first(rest, lambda x: x["w"].isin("-e", "-c") | ~x["w"].startswith("-"))
    of_interpreter = F.when(script["w"].isin("-e", "-c"), script["w"]).otherwise(_base(script["w"]))
    options = F.create_map(*(v for p, names in OPTION_VALUES.items() for v in (F.lit(p), F.array(*map(F.lit, names)))))
    at = _operand_at(rest, F.coalesce(F.element_at(options, program), F.array().cast("array<string>")))
    action, after = F.get(rest, at), F.get(rest, at + 1)
    runs = action.isin("run", "exec", "x") & program.isin(*SCRIPTED) & ~after.startswith("-")
    of_tool = F.when(at >= 0, F.when(F.coalesce(runs, F.lit(False)), F.concat_ws(" ", action, after)).otherwise(action))
    found = F.when(python, of_python).when(program.isin(*INTERPRETERS), of_interpreter).when(program.isin(*SUBCOMMANDS), of_tool)
    return F.coalesce(found, F.lit(""))


def category(program: Column, sub: Column, text: Column, words: Column) -> Column:
    """What a simple command does, by its program, action or script."""
    verb, script = F.substring_index(sub, " ", 1), F.when(sub.contains(" "), F.substring_index(sub, " ", -1)).otherwise("")
    in_place = F.exists(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: w.startswith("-i") | (w == "--in-place"))
    tests = verb.isin(*ACTIONS["test"]) | script.startswith("test") | script.startswith("lint") | script.isin("typecheck", "check")
    builds = verb.isin(*ACTIONS["build"]) | script.startswith("build")
    language = F.when(tests, "test").when(builds, "build").when(verb.isin(*ACTIONS["package"]), "package").when(verb.isin(*ACTIONS["file-write"]) | script.isin("format", "fmt"), "file-write").otherwise("run")
    known = F.element_at(F.create_map(*(F.lit(v) for name, programs in PROGRAMS.items() for p in programs for v in (p, name))), program)
    edits = text.contains(" -pi") | text.contains(" -i")
    return (
        F.when(program == "", "other").when(program == "git", F.when(sub == "grep", "search").otherwise("vcs")).when(program == "sed", F.when(in_place, "file-write").otherwise("read"))
        .when((program == "perl") & edits, "file-write").when(program.isin(*LANGUAGE_TOOLS), language)
        .when(program.startswith("python"), F.when(sub.isin("-m pytest", "-m unittest"), "test").when(sub == "-m pip", "package").otherwise("run"))
        .when(known.isNotNull(), known).when(text.startswith("./") | text.startswith("/"), "run").otherwise("other")
    )


def shell_commands(lines: DataFrame) -> DataFrame:
    """A row per simple command of (call_id, command) lines: position, operator, text, program, subcommand, category, is_primary, flags.

    ``lines`` may have ``line`` (a call's lines in order), ``exit_code`` and ``duration_ms``, which a line's only simple command takes over; call_id tells
    calls apart. Positions run through a call, the first command of a later line has the operator ``script``, flags hold for the whole
    call, and the primary command is the first that does more than set the shell up. Null and blank commands give no row.
    """
    has = lines.columns
    extra = {"line": "int", "exit_code": "long", "duration_ms": "long"}
    rows = lines.select(F.col("call_id").cast("string").alias("call_id"), *((F.col(c) if c in has else F.lit(0 if c == "line" else None)).cast(t).alias(c) for c, t in extra.items()), F.col("command").cast("string").alias("command"))
    tokens = F.regexp_extract_all(without_heredocs(F.col("command")), F.lit(f"(?s){_LEXEME}"), F.lit(0))
    t = F.col("t")
    rows = rows.where("command is not null").withColumn("row", F.monotonically_increasing_id())
    lex = rows.select("row", "call_id", "line", "exit_code", "duration_ms", F.posexplode(tokens).alias("i", "t"))
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lex = lex.withColumn("sum", F.sum(F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).over(upto))
    lex = lex.withColumn("top", (F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto))) == 0)
    control = F.col("top") & t.isin(*_CONTROLS)
    before = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = lex.withColumns({"control": control, "segment": F.coalesce(F.count(F.when(control, 1)).over(before), F.lit(0)), "operator": F.last(F.when(control, F.when(t == "\n", ";").otherwise(t)), ignorenulls=True).over(before)})
    heredoc = t.isin("<<", "<<-") | (t.startswith('"') & t.rlike(r"(?<!<)<<(?!<)"))
    comment = F.col("top") & t.startswith("#") & ~t.isin("#")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~control & ~comment, F.struct("i", "t")))), lambda x: x["t"]), "")
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    parts = seen.groupBy("row", "call_id", "line", "exit_code", "duration_ms", "segment").agg(
        F.trim(said, F.lit(" \t\r\n")).alias("text"), F.min(F.when(F.col("segment") > 0, F.col("operator"))).alias("operator"), flag(control & (t == "|")).alias("pipe"),
        flag(F.col("top") & t.isin(">", ">>")).alias("redirect"), flag(heredoc).alias("heredoc"), flag(control & (t == "&")).alias("background"),
    )
    words = parts.withColumn("words", words_of(F.regexp_replace("text", r"^[({ ]+", "")))
    words = words.withColumn("at", program_at(F.col("words")))
    program = F.regexp_replace(F.lower(_base(F.get("words", F.col("at")))), r"\)$", "")
    words = words.withColumn("program", F.when(F.col("at") >= 0, program).otherwise(""))
    rest = F.when(F.col("at") >= 0, F.slice("words", F.col("at") + 2, F.greatest(F.size("words"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    words = words.withColumn("subcommand", F.when(F.col("program") == "", "").otherwise(subcommand(F.col("program"), rest)))
    words = words.withColumn("category", category(F.col("program"), F.col("subcommand"), F.col("text"), words_of(F.col("text"))))
    call, line = Window.partitionBy("call_id"), Window.partitionBy("row")
    flags = {f"{name}": F.bool_or(c).over(call) for name, c in (("has_pipe", F.col("pipe")), ("has_redirect", F.col("redirect")), ("has_heredoc", F.col("heredoc")), ("is_backgrounded", F.col("background")))}
    full = words.withColumns(flags).where("text <> ''")
    order = Window.partitionBy("call_id").orderBy("line", "row", "segment")
    place = F.row_number().over(order) - 1
    full = full.withColumns({"position": place, "own": F.row_number().over(line.orderBy("segment")) - 1, "n": F.count(F.lit(1)).over(line), "last_line": F.max("line").over(call), "first_line": F.min("line").over(call)})
    works = (F.col("program") != "") & ~F.col("program").isin(*SETUP)
    # of each line the first command that works, else its first; of a call the first such that works, else that of the last line
    full = full.withColumn("chosen", F.coalesce(F.min(F.when(works, F.col("own"))).over(line), F.lit(0)) == F.col("own"))
    good = F.col("chosen") & (F.col("program") != "") & (works | (F.col("line") == F.col("last_line")))
    primary = F.min(F.when(good, F.col("position"))).over(call)
    alone = F.col("n") == 1
    return full.withColumn("primary", F.coalesce(primary, F.lit(0))).select(
        "call_id", "position", F.when((F.col("own") == 0) & (F.col("line") > F.col("first_line")), "script").otherwise(F.coalesce("operator", F.lit(""))).alias("operator"), T.clip(F.col("text"), 500).alias("text"),
        "program", "subcommand", "category", (F.col("position") == F.col("primary")).alias("is_primary"), *flags, F.when(alone, F.col("exit_code")).alias("exit_code"), F.when(alone, F.col("duration_ms")).alias("duration_ms"),
    )

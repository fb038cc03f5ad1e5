"""Text rules as built-in expressions: tool names and outcomes, failure signatures, templates, snippets, paths, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tool names by what they do.
TOOL_CATEGORIES = {
    "command": ("bash", "shell", "exec_command", "exec", "local_shell", "run", "write_stdin", "bashoutput", "killshell", "killbash", "run_command", "execute_command", "container.exec"),
    "read": ("read", "view_image", "notebookread", "ls", "view", "read_file", "open_file", "list_dir", "list_directory"),
    "search": ("grep", "glob", "search", "find", "codebase_search", "file_search", "grep_search"),
    "edit": ("edit", "write", "multiedit", "notebookedit", "apply_patch", "applypatch", "str_replace_editor", "create_file", "edit_file"),
    "web": ("webfetch", "websearch", "web_search", "web__run", "fetch", "browser", "web.run", "js", "js_reset"),
    "agent": ("task", "agent", "spawn_agent", "delegate", "workflow", "explore", "send_message", "wait", "wait_agent", "list_agents", "followup_task", "interrupt_agent", "close_agent", "sendmessage", "taskoutput"),
    "plan": ("todowrite", "todoread", "taskcreate", "taskupdate", "tasklist", "taskget", "taskstop", "update_plan", "enterplanmode", "exitplanmode", "enterworktree", "exitworktree"),
    "user": ("askuserquestion", "request_user_input", "request_user_input_async"),
    "meta": ("toolsearch", "skill", "get_skill", "request_plugin_install", "slashcommand"),
}

#: Needles of failures the harness imposed, first match wins.
HARNESS_ERRORS = (
    ("user_rejected", "the user doesn't want to proceed"), ("user_rejected", "user rejected"), ("user_rejected", "was rejected by the user"),
    ("user_rejected", "user denied"), ("user_rejected", "permission to use"), ("hook_blocked", "pretooluse"), ("hook_blocked", "blocked by hook"),
    ("hook_blocked", "hook error"), ("hook_blocked", "hook returned"), ("interrupted", "interrupted by user"), ("interrupted", "[request interrupted"),
    ("timeout", "command timed out"), ("timeout", "timed out after"),
)

#: Needles of the tools' own failures, first match wins.
TOOL_ERRORS = (
    ("file_not_read", "file has not been read yet"), ("file_not_read", "read it first"), ("edit_no_match", "string to replace not found"),
    ("edit_no_match", "found multiple matches"), ("edit_no_match", "old_string"), ("file_too_large", "exceeds maximum allowed"),
    ("invalid_input", "inputvalidationerror"), ("invalid_input", "input validation"), ("permission_denied", "permission denied"),
    ("permission_denied", "operation not permitted"), ("permission_denied", "eacces"), ("file_not_found", "no such file or directory"),
    ("file_not_found", "file does not exist"), ("file_not_found", "enoent"), ("file_not_found", "file not found"), ("timeout", "timed out"),
)

#: Programs whose exit code 1 means "nothing found" or "differs".
BENIGN_EXIT_1 = ("grep", "rg", "ag", "egrep", "fgrep", "diff", "cmp", "test", "[", "[[")


#: How tools print exit codes and times.
EXIT_CODE = r"(?m)^(?:Exit code:? |Process exited with code |exit status )(-?\d+)"
WALL_TIME = r"Wall time:? ([0-9.]+) seconds"


def tool_category(name: Column, kind: Column) -> Column:
    """What a tool does, across providers."""
    low = F.lower(name)
    pairs = [x for k, v in TOOL_CATEGORIES.items() for n in v for x in (F.lit(n), F.lit(k))]
    web = low.contains("chrome") | low.contains("browser") | low.contains("playwright")
    listed = F.element_at(F.create_map(*pairs), low)
    out = F.when(low.startswith("mcp__"), F.when(web, "web").otherwise("mcp"))
    return out.when((kind == "delegation") | low.startswith("collab__"), "agent").otherwise(F.coalesce(listed, F.lit("other")))


def mcp_server(name: Column) -> Column:
    """The server of an ``mcp__server__tool`` name, else null."""
    return F.when(F.lower(name).startswith("mcp__"), F.element_at(F.split(name, "__"), 2))


def first_needle(text: Column, needles: tuple[tuple[str, str], ...]) -> Column:
    """The kind of the first needle, in the listed order, that the text contains; null without any."""
    out = F.lit(None).cast("string")
    for kind, needle in reversed(needles):
        out = F.when(text.contains(needle), kind).otherwise(out)
    return out


def tool_outcome(content: Column, is_error: Column, details: Column, has_result: Column, program: Column, category: Column) -> Column:
    """Struct (status, error_type, exit_code, truncated, interrupted) of a call from its result text and JSON details."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(details, f"$.{p}") for p in paths])
    text = F.coalesce(content, F.lit(""))
    printed = F.regexp_extract(text, EXIT_CODE, 1)
    exit_code = F.coalesce(get("exitCode", "exit_code").cast("long"), F.when(printed != "", printed).cast("long"))
    state = F.lower(F.coalesce(get("status"), F.lit("")))
    cut = F.coalesce(get("interrupted") == "true", F.lit(False))
    timed = get("timedOutAfterMs").isNotNull()
    benign = F.coalesce((exit_code == 1) & program.isin(*BENIGN_EXIT_1), F.lit(False))
    bad_exit = F.coalesce(exit_code != 0, F.lit(False)) & ~benign
    failed = (F.coalesce(is_error, F.lit(False)) & ~benign) | cut | timed | (state.isin("failed", "declined", "error") & ~benign) | bad_exit
    head = F.lower(F.substring(text, 1, 2000))
    harness = first_needle(head, HARNESS_ERRORS)
    silent = F.coalesce(is_error & (category == "command") & program.isNotNull() & (program != ""), F.lit(False))
    kind = (
        F.when(timed, "timeout").when(cut, "interrupted").when(harness.isNotNull(), harness).when(bad_exit | silent, "nonzero_exit")
        .when(state == "declined", "user_rejected").otherwise(F.coalesce(first_needle(head, TOOL_ERRORS), F.lit("tool_error")))
    )
    truncated = F.coalesce(get("persistedOutputPath") != "", F.lit(False)) | F.coalesce(get("truncated") == "true", F.lit(False))
    for mark in ("<persisted-output>", "Output truncated", "tokens truncated", "[... truncated"):
        truncated = truncated | text.contains(mark)
    return F.struct(
        F.when(~has_result, "no_result").when(failed, "error").otherwise("ok").alias("status"), F.when(has_result & failed, kind).alias("error_type"),
        F.when(has_result, exit_code).alias("exit_code"), (has_result & truncated).alias("truncated"), (has_result & (cut | (failed & (harness == "interrupted")))).alias("interrupted"),
    )


def tool_duration(content: Column, details: Column, started: Column, ended: Column) -> Column:
    """Struct (duration_ms, source): a reported field, the printed wall time, else the gap between timestamps."""
    field = F.coalesce(*[F.get_json_object(details, f"$.{k}").cast("double") for k in ("durationMs", "duration_ms", "totalDurationMs")])
    wall = F.regexp_extract(F.coalesce(content, F.lit("")), WALL_TIME, 1)
    reported = F.coalesce(F.when(field >= 0, field.cast("long")), F.when(wall != "", F.round(wall.cast("double") * 1000).cast("long")))
    gap = F.unix_millis(ended) - F.unix_millis(started)
    gap = F.when(gap >= 0, gap)
    return F.struct(F.coalesce(reported, gap).alias("duration_ms"), F.when(reported.isNotNull(), "reported").when(gap.isNotNull(), "timestamps").alias("source"))


def patch_lines(patch: Column) -> Column:
    """Struct (added, removed): lines of a patch that begin with one + or -, not its headers."""
    lines = F.split(F.coalesce(patch, F.lit("")), "\n")
    count = lambda c: F.size(F.filter(lines, lambda x: x.startswith(c) & ~x.startswith(c * 3)))
    return F.struct(count("+").alias("added"), count("-").alias("removed"))


#: Arguments that name a call's file, in the order they are read, and the tools whose input is a patch.
PATH_KEYS = ("file_path", "notebook_path", "path", "filePath")
PATCH_TOOLS = ("apply_patch", "applypatch")


def patch_text(name: Column, arguments: Column) -> Column:
    """The patch of a patch tool's call: its ``patch`` or ``input`` argument, or the whole input where that is no JSON object."""
    named = F.coalesce(F.get_json_object(arguments, "$.patch"), F.get_json_object(arguments, "$.input"))
    return F.when(F.lower(name).isin(*PATCH_TOOLS), F.when(F.ltrim(arguments).startswith("{"), named).otherwise(arguments))


def call_path(name: Column, arguments: Column) -> Column:
    """File path of a call, up to 500 characters: a path argument of its JSON, else a patch tool's first file header."""
    named = F.coalesce(*[F.nullif(F.get_json_object(arguments, f"$.{k}"), F.lit("")) for k in PATH_KEYS])
    header = F.regexp_extract(patch_text(name, arguments), r"(?m)^\*\*\* (?:Update|Add|Delete) File: (.+)$", 1)
    return clip(F.trim(F.coalesce(named, F.when(header != "", header))), 500)


def estimated_tokens(text: Column, images: Column | None = None) -> Column:
    """ceil(bytes / 4) + 1500 per image."""
    return (F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4) + 1500 * (F.coalesce(images, F.lit(0)) if images is not None else F.lit(0))).cast("long")


def masked(text: Column, limit: int = 180) -> Column:
    """A failure text without identifiers, paths, spans of time and long numbers, so that equal failures read the same."""
    for pattern, to in (
        (r"\b[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<id>"),
        (r"\b[0-9a-f]{8,}\b", "<id>"),
        (r"(~|/)[^\s'\"()\[\]{}:,]*/[^\s'\"()\[\]{}:,]+", "<path>"),
        (r"\b\d+(\.\d+)?\s*(ms|s|sec|secs|seconds?|minutes?|mins?|hours?|h|m)\b", "<n> $2"),
        (r"\b\d{3,}\b", "<n>"),
        (r"\s+", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return clip(F.trim(text), limit)


def failure(text: Column) -> Column:
    """Struct (error_class, signature, attribution) of a workflow failure text; nulls for a blank one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    first = F.trim(F.element_at(F.split(t, "\n"), 1))
    has = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: low.contains(x))
    agent = F.lower(F.regexp_extract(first, r"(?i)^(codex|claude) exited with code (-?\d+)", 1))
    agent_code = F.regexp_extract(first, r"(?i)^(codex|claude) exited with code (-?\d+)", 2)
    rest = F.split(F.regexp_replace(t, r"(?i)^(codex|claude) exited with code (-?\d+)", ""), "\n")
    said = F.filter(F.transform(rest, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[: ]+", ""))), lambda x: (x != "") & ~F.lower(x).rlike("^reading (additional input|prompt) from stdin"))
    exit_text = F.concat(agent, F.lit(" exited with code "), agent_code, F.when(F.size(said) > 0, F.concat(F.lit(": "), said[0])).otherwise(""))
    script = F.regexp_extract(t, r"(?i)script exited with code (-?\d+)", 1)
    codes = F.array_distinct(F.regexp_extract_all(first, F.lit(r"\b[a-z]+(?:_[a-z]+)+\b"), F.lit(0)))
    contract = F.when(first.rlike(r"^[a-z]+(_[a-z]+)+\b"), F.array_join(codes, ": ")).otherwise(first)
    rules = [
        (first.rlike(r"(?i)^worker \S+ died"), "worker_died", F.lit("worker died"), "infrastructure"),
        (has("execution interrupted by process restart"), "process_restart", F.lit("execution interrupted by process restart"), "infrastructure"),
        (has("stuck from previous run"), "stuck_previous_run", F.lit("stuck from previous run"), "infrastructure"),
        (has("rate limit", "rate_limit", "429", "overloaded", "quota"), "rate_limited", masked(first), "provider"),
        (low.startswith("contract_repair_exhausted") | has("invalid shape declaration", "missing_output_fields", "missing output field", "invalid_output_type", "marker_missing", "handoff marker"), "output_contract", masked(contract), "contract"),
        (agent != "", "executor_exit", masked(exit_text), "configuration"),
        (script != "", "script_exit", F.concat(F.lit("script exited with code "), script), "script"),
        (has("timed out", "timeout"), "timeout", masked(first), "agent"),
        (low == "runtime_error", "unexplained", F.lit("runtime_error without a recorded reason"), "agent"),
        (t != "", "other", masked(first), "agent"),
    ]
    out = F.lit(None).cast("struct<error_class:string,signature:string,attribution:string>")
    for condition, name, signature, owner in reversed(rules):
        out = F.when(condition, F.struct(F.lit(name).alias("error_class"), signature.alias("signature"), F.lit(owner).alias("attribution"))).otherwise(out)
    return out


def disposition(error: Column, is_final: Column, human_followup: Column, outcome: Column) -> Column:
    """What became of an attempt: error, retried (not the last one), escalated to a person, advanced or open."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(filled(error), "error").when(~is_final, "retried").when(human_followup, "escalated").when(filled(outcome), "advanced").otherwise("open")


#: Openings of injected user-role text and their sources, of session files, of those flagged as meta, and of rollouts.
CLAUDE_INJECTED = (
    ("<task-notification>", "task_notification"), ("<local-command-stdout>", "command_output"), ("<local-command-stderr>", "command_output"),
    ("[Request interrupted by user", "interruption"),
)
CLAUDE_META = (("[Image:", "image_note"), ("Base directory for this skill", "skill"), ("<local-command-caveat>", "command_caveat"))
CODEX_INJECTED = (
    ("<environment_context>", "environments.environment_context"), ("<recommended_plugins>", "plugins.recommendations"), ("<turn_aborted>", "turn_aborted"),
    ("<user_instructions>", "user_instructions"), ("# AGENTS.md instructions", "user_instructions"), ("Warning: apply_patch was requested via exec_command", "harness_warning"),
)
INJECTED = CLAUDE_INJECTED + CODEX_INJECTED


def _opened(text: Column, openings: tuple[tuple[str, str], ...]) -> Column:
    t = F.trim(text, F.lit(" \t\n\r\f\v"))
    out = F.lit(None).cast("string")
    for opening, source in reversed(openings):
        out = F.when(t.startswith(opening), source).otherwise(out)
    return out


def injected_source(text: Column) -> Column:
    """The harness source of injected user-role text by its opening alone; null for what a person or parent agent wrote."""
    return _opened(text, INJECTED)


def claude_injected(text: Column, event: Column) -> Column:
    """The harness source of a session file's user event (JSON): its origin, flags, then the text's opening; null for a person's or parent agent's."""
    origin = F.get_json_object(event, "$.origin.kind")
    flag = lambda name: F.get_json_object(event, f"$.{name}") == "true"
    return (
        F.when(origin == "task-notification", "task_notification").when(origin == "peer", "peer_message").when(flag("isCompactSummary"), "compaction_summary")
        .when(flag("isMeta"), F.coalesce(_opened(text, CLAUDE_META), F.lit("harness"))).otherwise(_opened(text, CLAUDE_INJECTED))
    )


def codex_injected(text: Column, item_kind: Column) -> Column:
    """The harness source of a rollout's user content block: its kind, unless a user's, else the text's opening."""
    return F.when(item_kind.startswith("user."), F.lit(None).cast("string")).when(item_kind != "", item_kind).otherwise(_opened(text, CODEX_INJECTED))


def sender(originator: Column, entrypoint: Column, source: Column | None = None) -> Column:
    """The automation that sent user-role input; null for interactive input. A rollout's ``source`` "exec" is one too."""
    scripted = originator == "codex_exec" if source is None else (F.coalesce(originator == "codex_exec", F.lit(False)) | (source == "exec"))
    return F.when(scripted, "automation:codex-exec").when(entrypoint == "sdk-cli", "automation:claude-sdk-cli")


#: Attachment references, and tags of text a harness puts before what a person typed.
ATTACHMENT = r"@⟦[^⟧\n]*⟧\([^)\n]*\)|(?:/[^\s]*)?\.context/attachments/(?:[A-Za-z0-9_-]+/)?[^\n]*?\.(?:md|txt|png|jpe?g|gif|webp|pdf|json|csv|log|html|zip)\b|\(image attachment\)"
HARNESS_TAGS = ("system_instruction", "system-reminder", "environment_context", "user_instructions", "recommended_plugins")


def without_harness(text: Column) -> Column:
    """Text after its leading harness-tagged blocks."""
    tags = "|".join(HARNESS_TAGS)
    return F.trim(F.regexp_replace(text, rf"(?s)^(\s*<({tags})>.*?</\2>)+", ""))


def template_key(text: Column) -> Column:
    """What repeated prompts have in common: no harness blocks, attachments as @, white space and case ignored."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(without_harness(text), ATTACHMENT, "@"), r"\s+", " ")))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(words: Column, k: int = 8) -> Column:
    """A hash of each run of ``k`` words, in order; none for fewer words. The words are named once, so the work is linear in them."""

    def hashed(w: Column) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(k)), " ")))

    return F.transform(F.array(words), hashed)[0]


def snippet(text: Column, needle: Column, before: int = 90, after: int = 130) -> Column:
    """The text around the first place of ``needle`` (any case), with ellipses where it is cut; its start without one."""
    at = F.greatest(F.lit(1), F.instr(F.lower(text), F.lower(needle)))
    start = F.greatest(F.lit(1), at - before)
    end = F.least(F.length(text), at + F.length(needle) - 1 + after)
    body = F.substring(text, start, end - start + 1)
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


def clip(text: Column, n: int) -> Column:
    """At most n characters, with an ellipsis where cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


#: Words that stand for one concept.
CONCEPT_WORDS = {
    "failure": ("bug", "bugs", "error", "errors", "crash", "broken", "fail", "failed"),
    "repair": ("fix", "fixed", "resolve", "resolved"),
    "build": ("implement", "implemented", "create", "created"),
    "speed": ("performance", "slow", "latency"),
    "delete": ("remove", "removed", "cleanup", "reclaim"),
    "auth": ("authentication", "authorization"),
    "db": ("database", "sqlite"),
    "session": ("conversation", "thread"),
    "worktree": ("workspace",),
    "repo": ("repository",),
    "validation": ("test", "tests", "verify", "verified"),
}
CONCEPTS = {w: concept for concept, words in CONCEPT_WORDS.items() for w in words}


def concept_word(word: Column) -> Column:
    """A word's concept, else the word without the endings ing, ed and s, in that order."""
    low = F.lower(word)
    listed = F.element_at(F.create_map(*[F.lit(x) for kv in CONCEPTS.items() for x in kv]), low)
    bare = low
    for ending in ("ing$", "ed$", "s$"):
        bare = F.regexp_replace(bare, ending, "")
    return F.coalesce(listed, bare)


def search_terms(query: str) -> tuple[list[str], list[str]]:
    """(words, phrases) of a query: quoted runs of several words are phrases, everything else is words."""
    parts = query.split('"')
    quoted = parts[1 : len(parts) - (len(parts) % 2 == 0) : 2]
    plain = [p for i, p in enumerate(parts) if i % 2 == 0 or p not in quoted]
    phrases = [" ".join(q.lower().split()) for q in quoted if len(q.split()) > 1]
    words = [w for p in [*plain, *(q for q in quoted if len(q.split()) == 1)] for w in p.lower().split()]
    return words, phrases


def stable_id(namespace: str, *parts: Column) -> Column:
    """A stable id of namespaced parts."""
    return F.sha1(F.concat_ws("\x1f", F.lit(namespace), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pull_requests(text: Column) -> Column:
    """Array of (host, owner, repo, number) of the pull-request links in a text, each once."""
    links = F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[\w.-]+/[\w.-]+/[\w.-]+/pull/\d+"), F.lit(0)))
    part = lambda x, i: F.regexp_extract(x, r"https?://([\w.-]+)/([\w.-]+)/([\w.-]+)/pull/(\d+)", i)
    return F.transform(links, lambda x: F.struct(part(x, 1).alias("host"), part(x, 2).alias("owner"), part(x, 3).alias("repo"), part(x, 4).cast("long").alias("number")))


def clean_path(path: Column) -> Column:
    """A path without empty, ``.`` and resolvable ``..`` parts; ``.`` for none."""
    rooted = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        up = part == ".."
        popped = F.slice(kept, F.lit(1), F.size(kept) - 1)
        stuck = (F.size(kept) == 0) | (F.element_at(kept, -1) == "..")
        return F.when(~up, F.concat(kept, F.array(part))).when(F.size(kept) == 0, F.when(rooted, kept).otherwise(F.array(part))).when(stuck, F.concat(kept, F.array(part))).otherwise(popped)

    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def relative_path(path: Column, *roots: Column) -> Column:
    """A path below the first root that holds it, or a relative path that stays inside; null for others."""
    clean = clean_path(F.trim(path))
    below = F.lit(None).cast("string")
    for root in reversed(roots):
        base = clean_path(root)
        inside = F.when(clean == base, ".").when(base == "/", clean.substr(F.lit(2), F.length(clean))).when(clean.startswith(F.concat(base, F.lit("/"))), clean.substr(F.length(base) + 2, F.length(clean)))
        below = F.coalesce(F.when(F.coalesce(root, F.lit("")) != "", inside), below)
    out = F.when(clean.startswith("/"), below).when(~clean.isin(".", "..") & ~clean.startswith("../"), clean)
    return F.when(F.trim(path) != "", out)


def changed_files(name: Column, arguments: Column, root: Column, second_root: Column | None = None) -> Column:
    """Array of (path, status) an edit, write or patch call changes, relative to the work's root or else to the second one.

    Paths outside of both are left out; an edit is "modified", a write "written".
    """
    low = F.lower(name)
    roots = [root] if second_root is None else [root, second_root]
    one = F.coalesce(F.nullif(F.get_json_object(arguments, "$.file_path"), F.lit("")), F.get_json_object(arguments, "$.path"))
    single = F.array(F.struct(one.alias("path"), F.when(low == "write", "written").otherwise("modified").alias("status")))
    heads = F.regexp_extract_all(patch_text(name, arguments), F.lit(r"(?m)^\*\*\* (?:Update|Add|Delete) File: .+$"), F.lit(0))
    kind = lambda h: F.when(h.startswith("*** Add"), "added").when(h.startswith("*** Delete"), "deleted").otherwise("modified")
    many = F.transform(heads, lambda h: F.struct(F.regexp_replace(h, r"^\*\*\* \w+ File: ", "").alias("path"), kind(h).alias("status")))
    none = F.array().cast("array<struct<path:string,status:string>>")
    found = F.when(low.isin("edit", "write", "multiedit") & one.isNotNull(), single).when(low.isin(*PATCH_TOOLS), F.coalesce(many, none)).otherwise(none)
    return F.filter(F.transform(found, lambda f: F.struct(relative_path(f["path"], *roots).alias("path"), f["status"].alias("status"))), lambda f: f["path"].isNotNull())


def repository_name(remote: Column, location: Column) -> Column:
    """Repository name from its remote URL, else from a worktree path: the folder before ``.worktrees`` or the last one."""
    url = F.regexp_extract(F.coalesce(remote, F.lit("")), r"([^/:]+?)(?:\.git)?/?$", 1)
    tree = F.regexp_extract(F.coalesce(location, F.lit("")), r"([^/]+)/\.?worktrees?/", 1)
    last = F.regexp_extract(F.coalesce(location, F.lit("")), r"([^/]+)/?$", 1)
    return F.coalesce(F.when(url != "", url), F.when(tree != "", tree), F.when(last != "", last))


def session_status(total: Column, classified: Column) -> Column:
    """Struct (status, unclassified) of a session's reported tokens."""
    rest = F.greatest(F.lit(0), total - F.coalesce(classified, F.lit(0)))
    return F.struct(F.when(total.isNull(), "unavailable").when(rest > 0, "reported-partial").otherwise("reported-reconciled").alias("status"), F.coalesce(rest, F.lit(0)).alias("unclassified"))

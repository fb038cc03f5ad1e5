"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed side by side into one bit vector of 64-bit words. Reading one symbol moves every
rule at once: ``state = ((state << 1) & mask[symbol]) | (state & loops)``, where a carry crosses word borders and
``loops`` marks the states before a ``*``. A batch of URLs is simulated column by column, so the inner loop is
numpy over (urls, words) and its length is that of the longest URL of a slice of similar lengths, bounded in symbols.

Listed rules are matched on host and path as they stand; the method's own globs on the canonical URL. The work is one pass over
the rows, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.session import lean

#: Stands between host and path; no byte of a URL equals it, so ``*`` cannot slip a host part into the path.
BORDER = 256
#: Fills the tail of shorter URLs; it leaves every state as it is.
PAD = 257
#: Most symbols of a slice, padding included.
SLICE = 1 << 18

#: The method's own rule table is made of these lists by ``block_globs``: words that a host may hold, hosts with all their
#: subdomains by first label, path segments, and endings of files that are no pages.
HOST_WORDS = ("cheap-pills", "casino", "porn", "viagra", "cialis", "xxxvideo", "sexcam", "escort-girls", "payday-loan", "replica-watch", "torrentz", "warez", "keygen", "clickbank", "adserver", "popunder")
FIRST_LABELS = ("ads", "adclick", "tracker", "tracking", "pixel", "banners", "doubleclick", "sponsor", "affiliate", "telemetry")
SEGMENTS = ("casino", "porn", "viagra", "cialis", "warez", "keygen", "crack", "torrent", "wp-login.php", "xmlrpc.php", "cgi-bin", "phpmyadmin", "checkout", "add-to-cart", "login", "signin", "logout", "password-reset", "calendar-feed", "print-view")
ENDINGS = tuple(
    "exe zip rar 7z tar gz tgz bz2 xz iso dmg apk msi deb rpm jar bin dll so bat cab pkg img vhd "
    "jpg jpeg png gif bmp tif tiff webp ico svg psd mp3 wav flac ogg m4a mp4 avi mkv mov wmv webm flv "
    "woff woff2 ttf eot css js map swf doc xls ppt sqlite parquet torrent".split()
)


def block_globs(host_words=HOST_WORDS, first_labels=FIRST_LABELS, segments=SEGMENTS, endings=ENDINGS) -> tuple[tuple[str, str], ...]:
    """(host glob, path glob) pairs that block a canonical URL; hosts are matched with a dot before them."""
    out = [(f"*{w}*", "*") for w in host_words]
    out += [(f".{label}.*", "*") for label in first_labels]
    for word in segments:
        out += [("*", f"*/{word}"), ("*", f"*/{word}/*")]
    return tuple(out + [("*", f"*.{e}") for e in endings])


BLOCK_GLOBS = block_globs()
#: Characters that mean the same escaped or not.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"
_ESCAPED = re.compile("%(" + "|".join(f"{ord(c):02X}" for c in UNRESERVED) + ")", re.I)


def canonical(host: str, path: str) -> tuple[str, str]:
    """The host without user, port and final dots, and the path in lower case with unreserved escapes read, empty and dot segments taken out."""
    host = host.rpartition("@")[2]
    host = re.sub(r":[0-9]*$", "", host).rstrip(".")
    path = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), path)
    path = re.sub("[A-Z]+", lambda m: m[0].lower(), path)
    if "//" in path or "/." in path:
        kept: list[str] = []
        last = ""
        for last in re.sub("/+", "/", path).split("/")[1:]:
            if last == "..":
                kept[-1:] = []
            elif last != ".":
                kept.append(last)
        path = "/" + "/".join(kept)
        if last in (".", "..") and not path.endswith("/"):
            path += "/"
    return host, path


@dataclass(frozen=True)
class Rule:
    """A rule on a host with all its subdomains and on the start of the path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> tuple[str, str]:
        return f"*.{self.host}", f"{self.path}*"


class Automaton:
    """Multiword Shift-And over (host glob, path glob) pairs; only ``*`` is special."""

    def __init__(self, globs: list[tuple[str, str]]):
        symbols: list[list[int]] = []
        loops: list[list[bool]] = []
        for host, path in globs:
            own: list[int] = []
            loop = [False]
            for c in [*host.encode(), BORDER, *path.encode()]:
                if c == ord("*"):
                    loop[-1] = True
                else:
                    own.append(c)
                    loop.append(False)
            symbols.append(own)
            loops.append(loop)
        n_bits = sum(len(s) + 1 for s in symbols)
        self.words = max(1, -(-n_bits // 64))
        self.mask = np.zeros((PAD + 1, self.words), np.uint64)
        self.loops, self.start = np.zeros((2, self.words), np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for own, loop in zip(symbols, loops, strict=True):
            bit = lambda i, at=at: ((at + i) // 64, np.uint64(1 << (at + i) % 64))
            w, b = bit(0)
            self.start[w] |= b
            for i, c in enumerate(own):
                w, b = bit(i + 1)
                self.mask[c, w] |= b
            for i, stays in enumerate(loop):
                if stays:
                    w, b = bit(i)
                    self.loops[w] |= b
            self.final.append(bit(len(own)))
            at += len(own) + 1

    def match(self, texts: list[tuple[bytes, bytes]]) -> np.ndarray:
        """A boolean row per (host, path) with a column per glob.

        Pairs are read in slices of similar lengths that hold at most ``SLICE`` symbols with their padding; a pair too long for
        any slice is read on its own, with the masks as whole numbers.
        """
        out = np.zeros((len(texts), len(self.final)), bool)
        sizes = np.array([len(h) + len(p) + 1 for h, p in texts])
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            most = np.arange(1, min(1024, len(order) - at) + 1) * sizes[order[at : at + 1024]]
            part = order[at : at + max(1, int(np.searchsorted(most, SLICE, side="right")))]
            at += len(part)
            if len(part) < 8:
                for i in part.tolist():
                    out[i] = self._match_one(*texts[i])
                continue
            codes = np.full((len(part), int(sizes[part].max())), PAD, np.int16)
            for row, i in enumerate(part):
                h, p = texts[i]
                codes[row, : sizes[i]] = [*h, BORDER, *p]
            state = np.tile(self.start, (len(part), 1))
            for col in range(codes.shape[1]):
                c = codes[:, col]
                moved = state << np.uint64(1)
                moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
                state = np.where((c == PAD)[:, None], state, (moved & self.mask[c]) | (state & self.loops))
            for k, (w, b) in enumerate(self.final):
                out[part, k] = (state[:, w] & b) != 0
        return out

    @cached_property
    def _whole(self) -> tuple[list[int], int, int]:
        """Masks by symbol, loops and start as whole numbers."""
        join = lambda words: sum(int(w) << 64 * i for i, w in enumerate(words))
        return [join(m) for m in self.mask], join(self.loops), join(self.start)

    def _match_one(self, host: bytes, path: bytes) -> list[bool]:
        mask, loops, state = self._whole
        for c in (*host, BORDER, *path):
            state = state << 1 & mask[c] | state & loops
        return [bool(state >> 64 * w & int(b)) for w, b in self.final]


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path up to the query or fragment; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def judge_urls(pages: DataFrame, rules: list[Rule], block_globs: tuple[tuple[str, str], ...] = BLOCK_GLOBS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The longest rule that fits decides (by the length of host and path together, then the earlier rule); where none
    fits, ``rule`` is null and the verdict is block if one of ``block_globs`` matches the canonical URL, else allow. Listed rules are
    matched on host and path as they stand. A null URL or one without ``://`` has an empty host and path, which no listed rule fits;
    it is allowed unless a glob matches the empty pair. Repeated rows are judged alike, URLs of any length are read whole, extra columns
    are ignored, an empty table gives an empty result.
    """
    lean(pages.sparkSession)
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    listed = [rules[i] for i in ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, by_glob = Automaton([r.glob for r in listed]), Automaton(list(block_globs))
        raw = lambda pairs: [(f".{h}".encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass")) for h, p in pairs]
        for b in batches:
            parts = [split_url(u) for u in b["url"].to_pylist()]
            hit = by_rule.match(raw(parts)) if listed else np.zeros((len(parts), 0), bool)
            first = [next((r for r, ok in zip(listed, row, strict=True) if ok and host), None) for row, (host, _) in zip(hit, parts, strict=True)]
            open_ = [i for i, r in enumerate(first) if r is None]
            bad = set(np.array(open_, int)[by_glob.match(raw([canonical(*parts[i]) for i in open_])).any(1)].tolist()) if open_ else set()
            names = [r.text if r else None for r in first]
            verdicts = [r.verdict if r else "block" if i in bad else "allow" for i, r in enumerate(first)]
            cols = [b["page_id"], pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")

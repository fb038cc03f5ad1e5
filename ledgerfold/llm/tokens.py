"""Token ids of the public word-level BPE vocabulary for whole batches of texts.

The vocabulary's split pattern never joins letters across white space, so a text's ids are those of its
white-space-separated words one after another. Arrow splits a batch into words and finds the distinct ones and their distinct parts; new parts are
encoded together, in one call of a byte-pair encoder built from the same file, and numpy lays the ids of all words out
again. Words outside the plain range below go through the file's own tokenizer, so ids always equal those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Latin text and common punctuation: NFC leaves it alone and Python lowers it as the tokenizer does.
_OTHER = re.compile("[^\x00-įŒœ‐-‧€]|<\\|")
#: The split pattern over lowered words of that range.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-įœ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s0-9a-z\xaa\xb5\xba\xdf-\xf6\xf8-įœ\xb2\xb3\xb9\xbc-\xbe]+")
#: Characters at which Arrow and ``str.split`` part words and the pattern does not.
_CONTROL = "[\x1c-\x1f]"
#: Longer words go through the file's own tokenizer.
LONG = 200
_LETTER, _DIGIT, _MARK, _BREAK = range(4)
#: How many ids are laid out at a time.
SPAN = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kinds() -> np.ndarray:
    """What the split pattern takes each character of the plain range for; a line feed stands between words."""
    table = np.full(0x2100, _MARK, np.uint8)
    for lo, hi in ((0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xDF, 0xF6), (0xF8, 0x12F), (0x153, 0x153)):
        table[lo : hi + 1] = _LETTER
    for lo, hi in ((0x30, 0x39), (0xB2, 0xB3), (0xB9, 0xB9), (0xBC, 0xBE)):
        table[lo : hi + 1] = _DIGIT
    table[10] = _BREAK
    return table


KINDS = _kinds()


def spaced_parts(lowered: str) -> str:
    """Lowered words, each ended by a line feed, with a space after every part that the split pattern makes of them."""
    chars = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
    kind = KINDS[chars]
    last = (kind[:-1] != _BREAK) & ((kind[:-1] != kind[1:]) | (kind[:-1] == _DIGIT))
    shift = np.zeros(len(chars), np.int64)
    shift[1:] = np.cumsum(last)
    out = np.full(len(chars) + int(last.sum()), 32, np.uint32)
    out[np.arange(len(chars)) + shift] = chars
    return out.tobytes().decode("utf-32-le")


class WordEncoder:
    """Ids of texts by way of their distinct words; ids of up to ``limit`` parts of words (or one batch's) are kept."""

    def __init__(self, path: str, limit: int = 400_000):
        self.path = path
        self.limit = limit
        self.place: dict[str, int] = {}
        self.pool: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        # A word's last letter and its end mark are one symbol. The mark is a space byte, which no word holds;
        # binding it to the last byte ranks before all merges.
        tokens = {raw(t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i for t, i in vocab.items()}
        ends = [t for t in tokens if len(t) == 2 and t[1:] == b" "]
        singles = {bytes([b]): i for i, b in enumerate(range(256))}
        ranks = singles | {t: 256 + i for i, t in enumerate(ends)}
        for t, _ in sorted(tokens.items(), key=lambda x: x[1]):
            ranks.setdefault(t, len(ranks))
        self.id_of_rank = np.array([tokens.get(t, 0) for t in ranks], np.uint16)
        self.bpe = tiktoken.Encoding("words", pat_str="[^ \n]+ |\n", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self) -> Tokenizer:
        """The file's own tokenizer, loaded when a text first needs it."""
        return Tokenizer.from_file(self.path)

    def _plainly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint16) for t in texts]

    def _parts(self, parts: list[str]) -> np.ndarray:
        """Places of the parts' ids in the pool; parts not met since the pool was last emptied are encoded in one call."""
        if len(self.place) + len(parts) > self.limit:
            self.place.clear()
            self.pool, self.starts, self.sizes = [], [], []
        missing = [p for p in parts if p not in self.place]
        if missing:
            ranks = self.bpe.encode_to_numpy(" \n".join(missing) + " \n", disallowed_special=())
            stop = np.flatnonzero(ranks == 10)
            sizes = np.diff(np.r_[-1, stop]) - 1
            begun = sum(map(len, self.pool))
            self.pool.append(self.id_of_rank[ranks[ranks != 10]])
            self.starts.append(np.cumsum(sizes) - sizes + begun)
            self.sizes.append(sizes)
            self.place.update(zip(missing, range(len(self.place), len(self.place) + len(missing)), strict=True))
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each) for words without white space."""
        blob = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py() + "\n"
        apart = np.zeros(len(words), bool)
        if "'" in blob or _OTHER.search(blob) or len(words) and pc.max(pc.utf8_length(words)).as_py() > LONG:
            rough = pc.match_substring_regex(words, "'|<\\||[^\x00-\u012f\u0152\u0153\u2010-\u2027\u20ac]")
            apart = pc.or_(rough, pc.greater(pc.utf8_length(words), LONG)).to_numpy(zero_copy_only=False)
            plain = words.filter(pa.array(~apart))
            blob = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), "\n")[0].as_py() + "\n" * (len(plain) > 0)
        rest = words.filter(pa.array(apart)).to_pylist()
        quoted = {i: _PARTS.findall(w.lower()) for i, w in enumerate(rest) if len(w) <= LONG and not _OTHER.search(w)}
        # a word is its parts in a row, a line feed after the last
        listed = pc.split_pattern(pa.array([spaced_parts(blob.lower()).replace("\n", "\n ")]), " ").flatten() if blob else pa.array([], pa.string())
        listed = listed.slice(0, max(0, len(listed) - 1))
        coded = pa.concat_arrays([listed, pa.array([p for parts in quoted.values() for p in (*parts, "\n")], pa.string())]).dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        border = names.index("\n") if "\n" in names else -1
        slots = self._parts([p if i != border else "" for i, p in enumerate(names)])
        parts = coded.indices.to_numpy()
        flat, starts, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.pool, self.starts, self.sizes))
        starts, sizes = starts[slots], sizes[slots]
        ends = np.flatnonzero(parts == border)
        steps = np.r_[0, np.cumsum(sizes[parts])]
        per_word = np.diff(np.r_[0, steps[ends + 1]])
        whole = self._plainly([w for i, w in enumerate(rest) if i not in quoted])
        flat = np.concatenate([spread(flat, starts, sizes, parts).astype(np.uint16), *whole])
        per_word = np.concatenate([per_word, np.array([len(w) for w in whole], np.int64)]).astype(np.int64)
        if not rest:
            return flat, per_word
        at = np.flatnonzero(apart)
        told = np.array([i in quoted for i in range(len(rest))], bool)
        back = np.empty(len(words), np.int64)
        back[np.concatenate([np.flatnonzero(~apart), at[told], at[~told]])] = np.arange(len(words))
        return spread(flat, np.cumsum(per_word) - per_word, per_word, back), per_word[back]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint16, number of ids of each); null texts are empty, ``end`` closes each text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _CONTROL)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = lists.flatten().dictionary_encode()
        flat, sizes = self._words(coded.dictionary)
        codes = coded.indices.to_numpy()
        per_text = np.diff(lists.offsets.to_numpy())
        # texts with control characters and the end ids are words of their own, after the last of each text
        special = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        whole = self._plainly([texts[i].as_py() for i in special.tolist()])
        ends = [] if end is None else [np.array([end], np.uint16)]
        n = len(sizes)
        flat = np.concatenate([flat, *whole, *ends])
        sizes = np.concatenate([sizes, np.array([len(w) for w in (*whole, *ends)], np.int64)]).astype(np.int64)
        after = np.cumsum(per_text)
        codes = np.insert(codes.astype(np.int64), after[special], n + np.arange(len(special)))
        per_text[special] += 1
        if end is not None:
            codes = np.insert(codes, np.cumsum(per_text), len(sizes) - 1)
            per_text = per_text + 1
        steps = np.r_[0, np.cumsum(sizes[codes])]
        edges = np.r_[0, np.cumsum(per_text)]
        return spread(flat, np.cumsum(sizes) - sizes, sizes, codes), np.diff(steps[edges])


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[starts[c] : starts[c] + sizes[c]]`` of all codes in a row."""
    out = np.empty(int(sizes[codes].sum()), flat.dtype)
    at = 0
    for i in range(0, len(codes), SPAN):
        c = codes[i : i + SPAN]
        n = sizes[c]
        first = np.cumsum(n) - n
        take = np.repeat(starts[c] - first, n) + np.arange(int(n.sum()))
        out[at : at + len(take)] = flat[take]
        at += len(take)
    return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

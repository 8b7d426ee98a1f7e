"""Sub-word encoding by space-bounded segments, with a bounded cache.

A byte-level BPE vocabulary whose pre-tokens start at a space (` ?\\p{L}+`, ...) never merges across a space that a
non-space follows. So a text may be cut before each such space, and the ids of the text are the ids of the segments
in order. Segments repeat, so most of a corpus is answered from a cache.

A vocabulary file may list special tokens (`<|endoftext|>`). The tokenizer as loaded takes their strings in a text for
these tokens and cuts the text around them before anything else; so does `SegmentEncoder`. The same vocabulary as a file
of ranks has no special tokens: `SegmentCounts` and the counts made from it take such strings as ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import filterfalse

import numpy as np

#: Before a space that a non-space follows. The control characters 1C-1F count as spaces in some engines only.
CUT = re.compile(r"(?<!^)(?= [^\s\x1c-\x1f\x85])")
ODD = re.compile(r" (?=[\s\x1c-\x1f\x85])| $")
SPACE = re.compile(r"\s")
#: Segments that are encoded as one text.
PACKED = 256
#: Characters that a worker's cache may hold.
CACHE_CHARS = 20_000_000

_loaded: dict[str, object] = {}


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A `tokenizers` tokenizer as its file has it."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def special_strings(tokenizer) -> re.Pattern | None:
    """What finds the strings that the tokenizer cuts out of a text before all else; None if there are none.

    Only tokens that stand for exactly their string can be cut out here.
    """
    added = list(tokenizer.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("added tokens that reach beyond their string")
    names = sorted((t.content for t in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def load_ranks(path: str):
    """A `tiktoken` encoding from a file of ranks: counts what the tokenizer of the same vocabulary does, several times faster."""
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _loaded[path]


def segments(text: str) -> list[str]:
    """Segments of a whole text; joined they are the text."""
    if ODD.search(text):
        return [x for x in CUT.split(text) if x]
    parts = text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]] if parts[0] else [" " + x for x in parts[1:]]


class SegmentEncoder:
    """Ids (little-endian unsigned 32-bit) of segments, cached up to CACHE_CHARS characters.

    `whole` is keyed by segments, `spaced` by words that stand for the segment with one space in front.
    """

    def __init__(self, path: str):
        self.path, self.chars = path, 0
        self.special = special_strings(load_tokenizer(path))
        self.whole: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _read(self, into: dict[str, bytes], missing: list[str], lead: str) -> None:
        """Encode segments. Those without white space of their own go many to a text, a line end between two: that is a
        token by itself there, and nothing merges across it."""
        read = load_tokenizer(self.path).encode_batch_fast
        line = read(["\n"], add_special_tokens=False)[0].ids
        plain = [x for x in missing if x and not SPACE.search(x)] if len(line) == 1 and lead else []
        for k in range(0, len(plain), PACKED * 8):
            parts = [plain[j : j + PACKED] for j in range(k, min(k + PACKED * 8, len(plain)), PACKED)]
            for part, got in zip(
                parts, read([lead + ("\n" + lead).join(p) for p in parts], add_special_tokens=False), strict=True
            ):
                ids = np.array(got.ids, np.uint32)
                cuts = np.flatnonzero(ids == line[0])
                starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
                if len(starts) != len(part):
                    raise ValueError("a line end was not a token of its own")
                raw = ids.tobytes()
                into.update((x, raw[4 * i : 4 * j]) for x, i, j in zip(part, starts, ends, strict=True))
                self.chars += sum(map(len, part))
        rest = [x for x in missing if x not in into] if plain else missing
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            got = read([lead + x for x in part] if lead else part, add_special_tokens=False)
            into.update(zip(part, [array("I", e.ids).tobytes() for e in got], strict=True))
            self.chars += sum(map(len, part))

    def learn(self, whole: set[str], spaced: set[str] = frozenset()) -> None:
        """Put what the caches lack into them; they are emptied first if they hold too much."""
        if self.chars > CACHE_CHARS:
            self.whole, self.spaced, self.chars = {}, {}, 0
        self._read(self.whole, list(filterfalse(self.whole.__contains__, whole)), "")
        self._read(self.spaced, list(filterfalse(self.spaced.__contains__, spaced)), " ")

    def _batches(self, texts: list[str]):
        """For 256 texts at a time: lists of (segments looked up whole, words looked up spaced)."""
        for k in range(0, len(texts), 256):
            cut = []
            for x in texts[k : k + 256]:
                if not x:
                    cut.append(((), ()))
                elif self.special and self.special.search(x):
                    cut.append(([y for part in self.special.split(x) for y in self._around(part)], ()))
                elif ODD.search(x):
                    cut.append((segments(x), ()))
                else:
                    parts = x.split(" ")
                    cut.append(((parts[0],) if parts[0] else (), parts[1:]))
            self.learn(set().union(*(c[0] for c in cut)), set().union(*(c[1] for c in cut)))
            yield cut

    def _around(self, part: str) -> list[str]:
        """A special string as it is, and the text between two of them in segments."""
        return [part] if self.special.fullmatch(part) else segments(part) if part else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        out = []
        for cut in self._batches(texts):
            whole, spaced = self.whole.__getitem__, self.spaced.__getitem__
            out += [b"".join(map(whole, a)) + b"".join(map(spaced, b)) for a, b in cut]
        return out


class SegmentCounts(dict):
    """Segment -> number of its tokens, kept up to CACHE_CHARS characters."""

    def __init__(self, path: str):
        super().__init__()
        self.read, self.chars = load_ranks(path).encode_ordinary, 0

    def __missing__(self, segment: str) -> int:
        if self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        self.chars += len(segment)
        n = self[segment] = len(self.read(segment))
        return n


_kept: dict[str, object] = {}


def encoder_for(path: str) -> SegmentEncoder:
    """The encoder of this worker process: its cache serves one task after the other."""
    if path not in _kept:
        _kept[path] = SegmentEncoder(path)
    return _kept[path]


def counts_for(path: str) -> SegmentCounts:
    """The counts of this worker process."""
    if path not in _kept:
        _kept[path] = SegmentCounts(path)
    return _kept[path]

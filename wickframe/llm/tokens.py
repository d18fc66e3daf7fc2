"""Whole-text token ids by the tokenizers library, through a cache of space-led chunks.

A byte-level BPE tokenizer of this kind always cuts before a space between two characters that are not white space.
So a text is the concatenation of such chunks, and each distinct chunk needs to be encoded once."""

from __future__ import annotations

import gc
import os
import re
import sys
import types
from array import array

import numpy as np
import pyarrow as pa

from wickframe.llm.common import runs, utf8

DEFAULT_FILE = "byte_bpe_50k.json"
#: Chunks kept in memory by a worker.  The cache fills with the first, mostly frequent, ones; others are encoded anew.
CACHE = 600_000
#: Bytes of text that are encoded at once.
RUN = 2 << 20
#: White space other than space and line end, by Python's or Unicode's definition.
_OTHER = "\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0                　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)

#: Marks that the tokenizer never joins to letters before them.
_MARKS = ",.;:!?"


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Cache(dict):
    """Ids by word.  A word that isn't there is noted, and found to be None."""

    def __init__(self):
        self.missed: set[str] = set()

    def __missing__(self, word: str) -> None:
        self.missed.add(word)


class Encoder:
    """encode(texts) -> one uint32 array for each text, equal to Tokenizer.encode(text, add_special_tokens=False).ids.
    Special-token strings in a text are read as the library reads them by default."""

    def __init__(self, path: str, cache: int = CACHE):
        # the tasks of an executor take all its cores: threads of the library's own would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = cache
        self.led = _Cache()  # the ids of " x", by x
        self.bare = _Cache()  # the ids of x
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        self.line = self._ids(["\n"])[0]
        self.line_id = int(np.frombuffer(self.line, np.uint32)[0])
        self.starts = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # tokens that begin with a space
        for token, k in self.tokenizer.get_vocab().items():
            self.starts[k] = token.startswith("\u0120")
        self.marks = dict(zip(_MARKS, self._ids(list(_MARKS)), strict=True))

    @classmethod
    def of_worker(cls, path: str, cache: int = CACHE) -> Encoder:
        """One encoder for all tasks that a Python worker runs, with at most so many chunks of each kind kept."""
        store = sys.modules.setdefault("_wickframe_worker", types.ModuleType("_wickframe_worker"))
        encoders = store.__dict__.setdefault("encoders", {})
        if (path, cache) not in encoders:
            encoders[path, cache] = cls(path, cache)
            gc.freeze()  # the cache is much to walk through
            gc.set_threshold(50_000, 20, 50)
        return encoders[path, cache]

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 4096):  # an Encoding is large
            out += [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _many(self, words: list[str], led: bool) -> dict[str, bytes]:
        """The ids of each x, or of " x" if led.  Words of letters and digits go many to a text: led ones each begin
        with a token that begins with a space, and no other token does; others stand on lines of their own."""
        easy = [x for x in words if x.isalnum()]
        groups = [easy[i : i + 500] for i in range(0, len(easy), 500)]
        out = {}
        for i in range(0, len(groups), 16):
            part = groups[i : i + 16]
            texts = [" " + " ".join(g) if led else "\n" + "\n".join(g) for g in part]
            for group, e in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                raw, cuts = ids.tobytes(), (np.flatnonzero(self.starts[ids] if led else ids == self.line_id) * 4).tolist()
                skip = 0 if led else 4
                out.update(zip(group, [raw[a + skip : b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)], strict=True))
        hard = [x for x in words if not x.isalnum()]
        out.update(zip(hard, self._ids([" " + x for x in hard] if led else hard), strict=True))
        return out

    @staticmethod
    def _plain(t: str) -> bool:
        """Whether every space and line end stands between two characters that are not white space, and no other
        white space occurs."""
        if "  " in t or "\n\n" in t or "\n " in t or " \n" in t or t[:1] in " \n" or t[-1:] in " \n":
            return False
        return not any(c in t for c in _OTHER)

    def _found(self, cache: _Cache, led: bool) -> dict[str, bytes]:
        """The ids of the words that cache has missed; it keeps them if it has room.  A mark after letters is a token
        of its own, so such a word is made of the two."""
        missed, cache.missed = cache.missed, set()
        if not missed:
            return {}
        marked = [x for x in missed if x[-1:] in self.marks and x[:-1].isalpha()]
        plain = missed.difference(marked)
        plain.update({x[:-1] for x in marked if x[:-1] not in cache})
        new = self._many(list(plain), led)
        for x in marked:
            base = x[:-1]
            new[x] = (new.get(base) or cache[base]) + self.marks[x[-1]]
        if len(cache) < self.most:
            cache.update(new)
        return new

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lines, n_lines = [], []  # of a line, its first word and the others
        for t in texts:
            if self._plain(t):
                split = [x.split(" ") for x in t.split("\n")]
                n_lines.append(len(split))
                lines += split
            else:
                head, *rest = self.cut.split(t)
                n_lines.append(1)
                lines.append([head, *(x[1:] for x in rest)])
        heads = [x.pop(0) for x in lines]
        first = [*map(self.bare.__getitem__, heads)]
        led = self.led.__getitem__
        ids = [[*map(led, x)] for x in lines]
        bare_new, led_new = self._found(self.bare, False), self._found(self.led, True)
        made = []
        for head, word, x, words in zip(first, heads, ids, lines, strict=True):
            for k in range(x.count(None)):
                at = x.index(None, at + 1 if k else 0)
                x[at] = led_new[words[at]]
            made.append((bare_new[word] if head is None else head) + b"".join(x))
        out, at = [], 0
        for n in n_lines:
            out.append(np.frombuffer(made[at] if n == 1 else self.line.join(made[at : at + n]), np.uint32))
            at += n
        return out


def batches(batch: pa.RecordBatch, most: int = RUN):
    """(ids, texts) of runs of a batch's rows (doc_id, text) with about that many bytes; null is empty."""
    _, offsets = utf8(batch.column(1))
    for i, j in runs(offsets, most):
        part = batch.slice(i, j - i)
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]

"""Token ids of texts by a public tokenizer file, fast where tokens never cross white space.

For files that lower-case, drop white space and encode each word by itself, equal
white-space-free chunks have equal ids. They are kept in a bounded memo; chunks not yet in it are
encoded together, by merging pairs in all words at once on arrays. Chunks with characters
outside a range in which normalisation is the identity, those in which a special token may stand, and all other files, go
to the library, used as it comes: a special token's string in a text is that token.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

#: The one description of a file's steps before the model for which chunks stand alone.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
#: The same as SPLIT in lower-cased plain text.
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
LIMIT = 600_000
NONE = np.int32(1 << 30)


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next unused one from 256."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """``encode(texts)``: the ids of each text as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        self.chunks = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") == SPLIT
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix")
            and not (model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"))
        )
        # special tokens without white space around or in them are found inside a chunk
        added = spec.get("added_tokens") or []
        self.chunks = self.chunks and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or set(x["content"]) & set(" \t\n\r\x0b\x0c") for x in added)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in added)).search if added else None
        if not self.chunks:
            return
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        signs = byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int32)
        self.last = np.array([vocab[s + end] for s in signs], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        pairs = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._table(pairs)
        self.memo: dict[str, bytes] = {}

    def _table(self, pairs: np.ndarray) -> None:
        """An open hash table from a pair to its rank."""
        size = 1 << 20
        self.slots, self.ranks = np.full(size, 0xFFFFFFFF, np.uint32), np.full(size, NONE, np.int32)
        order = np.arange(len(pairs))
        at = self._slot(pairs)
        while len(order):
            free = self.slots[at[order]] == 0xFFFFFFFF
            placed, first = np.unique(at[order[free]], return_index=True)
            chosen = order[free][first]
            self.slots[placed], self.ranks[placed] = pairs[chosen], chosen
            order = np.setdiff1d(order, chosen, assume_unique=True)
            at[order] = np.where(self.slots[at[order]] != 0xFFFFFFFF, (at[order] + 1) % size, at[order])

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE if there is no such merge or no second symbol."""
        pairs = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) & np.uint32(0xFFFF))
        at = self._slot(pairs)
        found = self.slots[at]
        out = np.where(found == pairs, self.ranks[at], NONE)
        todo = np.flatnonzero((found != pairs) & (found != 0xFFFFFFFF))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            found = self.slots[at[todo]]
            hit = found == pairs[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found != 0xFFFFFFFF)]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of byte words of similar length, by merging the best pair of each word until none has any."""
        size, width = np.array([len(w) for w in words]), max(map(len, words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        s = self.inner[raw]
        s[np.arange(len(s)), size - 1] = self.last[raw[np.arange(len(s)), size - 1]]
        s[np.arange(width) >= size[:, None]] = -1
        out: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        r = self._rank(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(s), width - 1) if width > 1 else np.full((len(s), 1), NONE)
        cols, pcols = np.arange(width), np.arange(r.shape[1])
        while True:
            j = r.argmin(1)
            best = r[np.arange(len(r)), j]
            done = best == NONE
            if done.any():
                ready = s[done]
                used = ready >= 0
                flat, ends = ready[used].astype("<u4").tobytes(), (4 * used.sum(1).cumsum()).tolist()
                for k, lo, hi in zip(row[done].tolist(), [0, *ends], ends, strict=False):
                    out[k] = flat[lo:hi]
                live = ~done
                s, r, row, j, best = s[live], r[live], row[live], j[live], best[live]
            if not len(row):
                return out
            every = np.arange(len(row))
            s = np.take_along_axis(s, np.minimum(cols + (cols > j[:, None]), width - 1), 1)
            s[:, -1] = -1
            s[every, j] = self.made[best]
            r = np.take_along_axis(r, np.minimum(pcols + (pcols > j[:, None]), len(pcols) - 1), 1)
            r[:, -1] = NONE
            right = np.minimum(j + 1, width - 1)
            new = self._rank(s[every, j], np.where(j + 1 < width, s[every, right], -1))
            inside = j < r.shape[1]
            r[every[inside], j[inside]] = new[inside]
            left = j > 0
            r[every[left], j[left] - 1] = self._rank(s[every[left], j[left] - 1], s[every[left], j[left]])

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids of chunks into the memo."""
        find, plain = PLAIN_WORDS.findall, PLAIN.fullmatch
        simple = [c for c in chunks if len(c) <= 48 and plain(c)]
        if self.special and (own := [c for c in simple if self.special(c)]):
            simple = list(set(simple).difference(own))
        other = list(set(chunks).difference(simple)) if len(simple) < len(chunks) else []
        # words are found in all chunks at once: a blank is in no word
        split = [[c] if c.isalpha() else find(c) for c in " \n".join(simple).lower().split(" \n")]
        new = sorted(set(chain.from_iterable(split)), key=len)
        coded = [w.encode() for w in new]
        known: dict[str, bytes] = {}
        i = 0
        while i < len(new):
            top = max(4, len(new[i]) * 3 // 2)
            k = min(i + 20_000, bisect_right(new, top, lo=i, key=len))
            known.update(zip(new[i:k], self._merge(coded[i:k]), strict=True))
            i = k
        get, memo = known.__getitem__, self.memo
        for c, w in zip(simple, split, strict=True):
            memo[c] = get(w[0]) if len(w) == 1 else b"".join(map(get, w))
        for c, e in zip(other, self.library.encode_batch_fast(other, add_special_tokens=False) if other else [], strict=True):
            memo[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.chunks:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        # str.split() also parts at four control characters that aren't white space to the library
        parts = [ASCII_SPACE.split(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        if len(self.memo) > LIMIT:
            self.memo.clear()
        new = set(chain.from_iterable(parts)) - self.memo.keys()
        if new:
            self._learn(list(new))
        return [b"".join(map(self.memo.__getitem__, p)) for p in parts]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)

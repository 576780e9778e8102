"""Byte-level BPE with a memory-mapped minimal acyclic transducer as its lexicon.

The frequent words of the corpus are counted over all rows, encoded once, and compiled into a minimal acyclic
automaton (equal suffixes share states). Numbers on its edges add up to a word's index, whose entry in an id table is
the transducer's output. The file lies in the shared folder; workers memory-map it and look up the distinct words of a
slice all at once. Words that it lacks are merged exactly, so the lexicon decides speed and never the result.

A slice of texts becomes ids without a Python loop over words or ids: Arrow finds the distinct units between blanks and
repeats what belongs to each, as it does with the bytes and the decimal digits of ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.shared import arrow_mapped, byte_sizes, cut, shared_dir, slices, worker_tool

#: Fixed value: the pattern that cuts a text into words before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points that the installed regex module counts as letters or numbers and the tokenizers library, with
#: older Unicode tables, does not.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 "
    "1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F "
)
#: At most so many words are compiled (about 9 MB of automaton); rarer ones are merged when met.
LEXICON_WORDS = 200_000
#: Units between blanks that a worker remembers before it starts afresh; and bytes of those that it doesn't remember and of words that are merged by themselves.
REMEMBERED, LONG = 400_000, 64
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 200_000
#: Text bytes that are handled at once.
SLICE_BYTES = 1 << 21
#: White space as the pattern and any of its engines see it; and a blank inside of it, where units don't stand alone.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
APART = rf"{SPACE} (?:{SPACE}|\z)"


def _byte_chars() -> dict[str, int]:
    """Printable character -> byte of byte-level vocabularies: Latin-1's printable characters stand for themselves, other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

#: No merge; and the mask of an id below its merge's rank.
NEVER, ID = 1 << 62, (1 << 20) - 1


class Merges:
    """The vocabulary and merge rules of a tokenizer file, with exact encoding of single words."""

    def __init__(self, text: str):
        spec = json.loads(text)
        chars = _byte_chars()
        raw = lambda token: bytes(chars[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = {i: raw(t) for t, i in vocab.items() if t not in self.special} | {i: t.encode() for t, i in self.special.items()}
        self.single = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.symbol = np.array(self.single, dtype=np.int64)
        self._hash(np.array([a << 20 | b for a, b in self.pairs], dtype=np.int64), np.array([rank << 20 | new for rank, new in self.pairs.values()], dtype=np.int64))

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A table by open addressing of pairs and what they merge to: ordered by rank, the id in the low bits."""
        self.bits = 4 + max(1, keys.size).bit_length()
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.full(1 << self.bits, NEVER, dtype=np.int64)
        slot = self._slot(keys)
        while keys.size:
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(keys.size, dtype=bool)
            left[put] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _ranks(self, ids: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the symbols ``at`` and those after them merge to; NEVER at the end of a word (``of``) too."""
        after = np.minimum(at + 1, ids.size - 1)
        keys = np.where((after > at) & (of[after] == of[at]), ids[at] << 20 | ids[after], -2)
        slot = self._slot(keys)
        there, out = self.keys[slot], self.values[slot]
        out[there != keys] = NEVER
        open_ = np.flatnonzero((there != keys) & (there >= 0) & (keys >= 0))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has: in a word the pair of lowest rank, leftmost first, merges until none is left.

        All words merge a pair at a time together; long ones go by themselves.
        """
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        long_ = np.flatnonzero(lens > LONG).tolist()
        alone = [np.array(self._long([self.single[b] for b in words[i]]), dtype=np.int64) for i in long_]
        done = [(np.array([i]), np.array([x.size]), x) for i, x in zip(long_, alone)]
        own = np.flatnonzero((lens > 0) & (lens <= LONG))
        n = lens[own]
        ids = self.symbol[np.frombuffer(b"".join([words[i] for i in own.tolist()]), dtype=np.uint8)]
        of = np.repeat(np.arange(own.size), n)
        rank = self._ranks(ids, of, np.arange(ids.size))
        while own.size:
            best = np.minimum.reduceat(rank, np.cumsum(n) - n)
            ready = best == NEVER
            if ready.any():
                gone = ready[of]
                done.append((own[ready], n[ready], ids[gone]))
                ids, rank, own, n, best = ids[~gone], rank[~gone], own[~ready], n[~ready], best[~ready]
                if not own.size:
                    break
                of = np.repeat(np.arange(own.size), n)
            hit = np.flatnonzero(rank == best[of])
            hit = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])]
            ids[hit] = best & ID
            stay = np.ones(ids.size, dtype=bool)
            stay[hit + 1] = False
            ids, rank, of, n = ids[stay], rank[stay], of[stay], n - 1
            hit -= np.arange(hit.size)  # each word before lost a symbol
            before = hit[np.flatnonzero(of[hit[1:] - 1] == of[hit[1:]]) + 1] - 1
            again = np.concatenate([hit, before, hit[:1] - 1 if hit[0] > 0 else hit[:0]])
            rank[again] = self._ranks(ids, of, again)
        counts = np.zeros(len(words), dtype=np.int64)
        for i, k, _ in done:
            counts[i] = k
        begin, flat = np.cumsum(counts) - counts, np.empty(int(counts.sum()), dtype=np.int32)
        for i, k, x in done:
            _spread(flat, begin[i], x, np.cumsum(k) - k, k)
        return flat, counts

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over linked neighbours, in n log n steps."""
        pairs, n = self.pairs, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*p, i) for i, pair in enumerate(zip(ids, ids[1:])) if (p := pairs.get(pair))]
        heap = [(rank, i, new) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or pairs.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (p := pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (p[0], a, p[1]))
        return [i for i in ids if i >= 0]


class Lexicon:
    """A minimal acyclic transducer from words to id sequences, as flat arrays.

    ``keys`` holds state * 256 + byte of every edge in ascending order, ``target`` where it leads and ``skip`` the
    words that come before in the state; ``accepts`` marks final states. Ids of word k: ``ids[start[k]:start[k + 1]]``.
    """

    ARRAYS = [("keys", np.int64), ("target", np.int32), ("skip", np.int32), ("accepts", np.uint8), ("start", np.int32), ("ids", np.int32)]

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compiled(cls, words: dict[bytes, list[int]]) -> Lexicon:
        """Adds the words in byte order; what can't change any more is replaced by an equal state that exists (Daciuk's construction)."""
        order = sorted(w for w in words if w)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path, last = [0], b""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                same = known.setdefault((final[state], tuple(edges[state].items())), state)
                if same != state:
                    edges[state] = None  # an equal state exists
                edges[path[-1]][last[len(path) - 1]] = same

        for word in order:
            common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            settle(common)
            for byte in word[common:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][byte] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = word
        settle(0)
        number, queue = {0: 0}, [0]  # states that are in use, by first visit
        for state in queue:
            for to in edges[state].values():
                if to not in number:
                    number[to] = len(queue)
                    queue.append(to)
        counts: dict[int, int] = {}
        stack = [0]
        while stack:
            state = stack[-1]
            if missing := [t for t in edges[state].values() if t not in counts]:
                stack += missing
            else:
                counts[stack.pop()] = final[state] + sum(counts[t] for t in edges[state].values())
        rows = []
        for state in queue:
            before = int(final[state])
            for byte, to in edges[state].items():
                rows.append((number[state] * 256 + byte, number[to], before))
                before += counts[to]
        table = np.array(rows or np.zeros((0, 3)), dtype=np.int64)
        lens = np.array([len(words[w]) for w in order], dtype=np.int32)
        return cls({"keys": table[:, 0].copy(), "target": table[:, 1].astype(np.int32), "skip": table[:, 2].astype(np.int32), "accepts": np.array([final[s] for s in queue], dtype=np.uint8), "start": np.concatenate([[0], np.cumsum(lens)]).astype(np.int32), "ids": np.array([i for w in order for i in words[w]], dtype=np.int32)})

    def packed(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, n), dtype=t).tobytes() for n, t in self.ARRAYS]
        parts = [p + b"\0" * (-len(p) % 8) for p in parts]
        return np.array([getattr(self, n).size for n, _ in self.ARRAYS], dtype=np.int64).tobytes() + b"".join(parts)

    @classmethod
    def over(cls, buffer) -> Lexicon:
        """Views of a packed lexicon; nothing is copied."""
        sizes, at, arrays = np.frombuffer(buffer, np.int64, len(cls.ARRAYS)), 8 * len(cls.ARRAYS), {}
        for n, (name, kind) in zip(sizes, cls.ARRAYS):
            arrays[name] = np.frombuffer(buffer, kind, n, at)
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        return cls(arrays)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls.over(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, -1 where it is not in the lexicon: all words walk the automaton together, a byte at a time."""
        found = np.full(len(words), -1, dtype=np.int64)
        if not words or not self.keys.size:
            return found
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(lens) - lens
        alive = np.flatnonzero(lens > 0)
        state, index = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for depth in range(int(lens.max())):
            key = state[alive] * 256 + text[start[alive] + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            ok = self.keys[edge] == key
            alive, edge = alive[ok], edge[ok]
            state[alive] = self.target[edge]
            index[alive] += self.skip[edge]
            done = lens[alive] == depth + 1
            ends = alive[done]
            ends = ends[self.accepts[state[ends]] == 1]
            found[ends] = index[ends]
            alive = alive[~done]
            if not alive.size:
                break
        return found


class Encoder:
    """Ids of whole texts. Special tokens' strings become their ids, as in the file's own library.

    A text is cut at single blanks. A unit (a blank and what follows up to the next one) has the same ids wherever it
    stands, unless white space surrounds a blank; texts where it does, or with special tokens, are cut by the pattern.
    Units are counted off by Arrow, so Python sees the distinct ones of a slice only, and remembers their ids.
    """

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon, self.units = merges, lexicon, {}
        newer = "".join("-".join(rf"\U{int(c, 16):08X}" for c in r.split("-")) for r in NEWER.split())
        self.pieces, self.newer = regex.compile(PIECES), re.compile(f"[{newer}]")
        letters, numbers = rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]"
        self.older = regex.compile(PIECES.replace(r"[^\s\p{L}\p{N}]", rf"[^\s||{letters}||{numbers}]").replace(r"?\p{L}", f"?{letters}").replace(r"?\p{N}", f"?{numbers}"), regex.V1)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None

    def words(self, text: str) -> list[str]:
        """The pieces of a text that are merged by themselves; special tokens have a NUL before them."""
        cut = lambda x: (self.pieces if x.isascii() or not self.newer.search(x) else self.older).findall(x)
        if self.special is None or not any(s in text for s in self.merges.special):
            return cut(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += ["\0" + part] if i % 2 else cut(part)  # no word begins with NUL and goes on with a letter or sign of its own
        return out

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        raw = [w.encode() for w in words]
        special = {i: self.merges.special[w[1:]] for i, w in enumerate(words) if w[0] == "\0" and w[1:] in self.merges.special}
        at = self.lexicon.find(raw)
        hit, other = np.flatnonzero(at >= 0), [i for i in np.flatnonzero(at < 0).tolist() if i not in special]
        merged, each = self.merges.encoded([raw[i] for i in other])
        lens, other = np.ones(len(words), dtype=np.int64), np.array(other, dtype=np.int64)
        lens[hit] = self.lexicon.start[at[hit] + 1] - self.lexicon.start[at[hit]]
        lens[other] = each
        begin, flat = np.cumsum(lens) - lens, np.empty(int(lens.sum()), dtype=np.int32)
        _spread(flat, begin[hit], self.lexicon.ids, self.lexicon.start[at[hit]], lens[hit])
        _spread(flat, begin[other], merged, np.cumsum(each) - each, each)
        for i, x in special.items():
            flat[begin[i]] = x
        return flat, lens

    def packed(self, units: list[str], whole: set[int]) -> list[bytes]:
        """The ids of each unit, as the bytes of 32-bit numbers. Those that have white space beyond a first blank, and special tokens, are named by ``whole``."""
        known = self.units
        out = list(map(known.get, units))
        fresh = [i for i, x in enumerate(out) if x is None]
        if not fresh:
            return out
        if len(known) > REMEMBERED:
            known.clear()
        special = {"\0" + x for x in self.merges.special}
        plain, rest = [i for i in fresh if i not in whole], [i for i in fresh if i in whole]
        # The pattern is run once over all units: a line end between units is a piece of its own.
        pieces = self.words("\n".join([units[i] for i in plain]))
        lists = [[u] if (u := units[i]) in special else self.words(u) for i in rest]
        seen = dict.fromkeys(chain(pieces, chain.from_iterable(lists)))
        seen.pop("\n", None)
        flat, lens = self.ids_of([*seen, "\n"])
        for i, w in enumerate(seen):
            seen[w] = i
        seen["\n"] = len(seen)
        data, ends = flat.tobytes(), 4 * np.cumsum(lens)
        begin = ends - 4 * lens
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(seen), [None, pa.py_buffer(np.concatenate([begin, ends[-1:]])), pa.py_buffer(data)])
        which = np.fromiter(map(seen.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        apart = np.flatnonzero(which == len(seen) - 1)
        got, upto = _taken(table, which)
        got, line = got.to_pybytes(), 4 * int(lens[-1])
        starts, stops = [0, *upto[apart + 1].tolist()], [*(upto[apart + 1] - line).tolist(), int(upto[-1])]
        made = dict(zip(plain, (got[a:b] for a, b in zip(starts, stops))))
        made |= {i: b"".join([data[begin[k] : ends[k]] for k in map(seen.__getitem__, words)]) for i, words in zip(rest, lists)}
        for i, x in made.items():
            out[i] = x
            if len(units[i]) <= LONG:
                known[units[i]] = x
        return out

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without nulls), one after the other, and how many each has."""
        odd = pc.match_substring_regex(texts, APART)
        for s in self.merges.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ") if odd.any() else pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        tokens = lists.flatten().dictionary_encode()
        distinct, which, first = tokens.dictionary.to_numpy(zero_copy_only=False).tolist(), tokens.indices.to_numpy().astype(np.int64), at[:-1]
        whole = set(np.flatnonzero(pc.match_substring_regex(tokens.dictionary, rf"\A\z|{SPACE}").to_numpy(zero_copy_only=False)).tolist())
        heads, head = np.unique(which[first], return_inverse=True)  # a text's first unit has no blank
        which[first] = len(distinct) + head
        units, counts = [" " + x for x in distinct] + [distinct[i] for i in heads.tolist()], np.diff(at)
        whole |= {len(distinct) + k for k, i in enumerate(heads.tolist()) if i in whole}
        if odd.any():
            more: dict[str, int] = {}
            parts = np.split(which, at[1:-1])
            for i in np.flatnonzero(odd).tolist():
                words = self.words(texts[i].as_py())
                parts[i] = len(units) + np.fromiter((more.setdefault(w, len(more)) for w in words), dtype=np.int64, count=len(words))
                counts[i] = len(words)
            whole.update(range(len(units), len(units) + len(more)))
            which, units = np.concatenate(parts), [*units, *more]
        ids, ends = _taken(pa.array(self.packed(units, whole), pa.large_binary()), which)
        return np.frombuffer(ids, dtype=np.int32), np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]) // 4


def _taken(table: pa.Array, which: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """The entries ``which`` of a table of byte strings, one after the other, and where each ends (from 0)."""
    out = table.take(pa.array(which))
    _, ends, data = out.buffers()
    return data if data is not None else pa.py_buffer(b""), np.frombuffer(ends, dtype=np.int64, count=which.size + 1)


def _runs(table: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each run of ids the table's entries, joined."""
    data, ends = _taken(table, ids)
    ends = ends[np.concatenate([[0], np.cumsum(counts)])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), counts.size, [None, pa.py_buffer(ends), data])


def digests(column: pa.Array, less: int = 0) -> list[str]:
    """SHA-256 of each value of an array that ``_runs`` made, without its last ``less`` bytes."""
    _, ends, data = column.buffers()
    ends, data, sha = np.frombuffer(ends, dtype=np.int64, count=len(column) + 1).tolist(), memoryview(data or b""), hashlib.sha256
    return [sha(data[a : max(a, b - less)]).hexdigest() for a, b in zip(ends, ends[1:])]


def _spread(to: np.ndarray, to_at: np.ndarray, source: np.ndarray, at: np.ndarray, lens: np.ndarray) -> None:
    """Copies runs of ``source`` to runs of ``to``."""
    if lens.size:
        kind = np.int32 if max(to.size, source.size) < 1 << 31 else np.int64
        ends = np.cumsum(lens)
        step = np.arange(int(ends[-1]), dtype=kind)
        to[np.repeat((to_at - ends + lens).astype(kind), lens) + step] = source[np.repeat((at - ends + lens).astype(kind), lens) + step]


class Decoder:
    def __init__(self, merges: Merges):
        ids = range(max(merges.tokens) + 1)
        self.tokens = pa.array([merges.tokens.get(i, b"") for i in ids], pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in ids], pa.large_binary())

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of id runs; bytes that are not UTF-8 become replacement characters."""
        out = _runs(self.tokens, ids, counts)
        try:
            return out.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.large_string())

    def listed(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The ids of each run as decimal numbers with a comma after each."""
        return _runs(self.decimal, ids, counts)


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS, least: int = 4) -> list[str]:
    """The most frequent words (runs of letters) over all rows, ``most`` at most; words of equal counts come in together or not at all.

    Words are counted on the cluster. The driver sees how many words have each count, which gives the least count that
    fits, and then those words alone.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, seen = re.compile(r"[^\W\d_]+"), {}

        def out() -> pa.RecordBatch:
            words: dict[str, int] = {}
            for token, n in seen.items():
                for w in (token,) if token.isalpha() else letters.findall(token):
                    words[w] = words.get(w, 0) + n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for a, b in slices(byte_sizes(batch.column(0)), 4 * SLICE_BYTES):
                tokens, times = pc.value_counts(pc.split_pattern(batch.column(0).slice(a, b - a), " ").flatten()).flatten()
                for token, n in zip(tokens.to_numpy(zero_copy_only=False).tolist(), times.to_numpy().tolist()):
                    seen[token] = seen.get(token, 0) + n
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    texts = docs.select(F.col(f"`{text}`").cast("string").alias("t")).where("t IS NOT NULL")
    counts = cut(texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    # One row for each length of a count in bits and its three leading ones: a few hundred however large the corpus is.
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["s"], r["w"], r["low"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("w"), F.min("n").alias("low")).collect()), reverse=True)
    total, low = 0, None
    for _, words, begin in sizes:
        total += words
        if total > most:
            break
        low = begin
    return [] if low is None else [r["word"] for r in counts.where(F.col("n") >= low).select("word").collect()]


class Codec:
    """What a tokenizer file and a corpus need to encode and decode on the cluster."""

    def __init__(self, spark: SparkSession, tokenizer: str, words: Iterable[str] = ()):
        with open(tokenizer, encoding="utf-8") as f:
            text = f.read()
        merges = Merges(text)
        entries = [w for word in words for w in (word.encode(), b" " + word.encode())]
        flat, lens = merges.encoded(entries)
        ends = np.cumsum(lens).tolist()
        lexicon = Lexicon.compiled({w: flat[a:b].tolist() for w, a, b in zip(entries, [0, *ends], ends)})
        blob = lexicon.packed()
        self.path = f"{shared_dir(spark).rstrip('/')}/lexicon-{uuid.uuid4().hex}.bin"
        target, fs = _hadoop_path(spark, self.path)
        out = fs.create(target)
        out.write(bytearray(blob))
        out.close()
        self.local = fs.makeQualified(target).toUri().getPath() if fs.getScheme() == "file" else None
        # Bounded by the vocabulary file and by LEXICON_WORDS; the lexicon goes along only where the folder can't be mapped.
        self.parts = spark.sparkContext.broadcast((text, None if self.local else blob))

    def tools(self) -> tuple[Encoder, Decoder]:
        """Made once in a Python worker for each lexicon."""

        def build() -> tuple[Encoder, Decoder]:
            text, blob = self.parts.value
            merges = Merges(text)
            if blob is None:
                lexicon = Lexicon.mapped(self.local)
            else:
                area = mmap.mmap(-1, len(blob))
                area.write(blob)
                lexicon = Lexicon.over(area)
            return Encoder(merges, lexicon), Decoder(merges)

        return worker_tool(self.path, build)


def encode(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids of every whole text; a null or empty text has none.

    One row for every input row, repeated ones included; an empty table gives an empty result; an input column called
    like the ids is replaced. A text of any length is encoded whole; slices of about ``SLICE_BYTES`` bound what a worker
    holds besides.
    """

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        encoder = codec.tools()[0]
        for a, b in slices(byte_sizes(columns[0]), SLICE_BYTES):
            yield a, b, [id_lists(*encoder.encoded(_strings(columns[0].slice(a, b - a))))]

    return arrow_mapped(docs, [text], [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))


def _strings(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.string()), "")


def decode(docs: DataFrame, codec: Codec, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids; null or no ids give the empty text. Special tokens become their strings."""

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        decoder = codec.tools()[1]
        counts = pc.fill_null(pc.list_value_length(columns[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in slices(4 * counts, SLICE_BYTES):
            ids = columns[0].slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield a, b, [decoder.decoded(ids, counts[a:b]).cast(pa.string())]

    return arrow_mapped(docs, [ids], [T.StructField(decoded, T.StringType())], make)


def encode_and_decode(docs: DataFrame, codec: Codec, derived: list[T.StructField], derive: Callable[[Decoder, np.ndarray, np.ndarray, pa.Array], list], text: str = "text") -> DataFrame:
    """``docs`` with columns that ``derive`` makes, in the worker, from a slice's ids, how many each row has, and the decoded texts.

    Ids and decoded texts are those of ``encode`` and ``decode``; they need not go through the JVM where only what is
    derived from them is wanted. Null and empty texts have no ids and decode to the empty text; repeated rows stay; an
    empty table gives an empty result; an input column called like a derived one is replaced.
    """

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        encoder, decoder = codec.tools()
        for a, b in slices(byte_sizes(columns[0]), SLICE_BYTES):
            ids, counts = encoder.encoded(_strings(columns[0].slice(a, b - a)))
            yield a, b, [x if isinstance(x, pa.Array) else pa.array(x) for x in derive(decoder, ids, counts, decoder.decoded(ids, counts))]

    return arrow_mapped(docs, [text], derived, make)


def ids_and_digests(decoder: Decoder, ids: np.ndarray, counts: np.ndarray, texts: pa.Array) -> list:
    """The ids as they are, and the SHA-256 of each decoded text."""
    return [id_lists(ids, counts), digests(texts)]


def counts_and_digests(decoder: Decoder, ids: np.ndarray, counts: np.ndarray, texts: pa.Array) -> list:
    """How many ids, the SHA-256 of their decimals joined by commas, and that of the decoded text."""
    return [counts, digests(decoder.listed(ids, counts), less=1), digests(texts)]

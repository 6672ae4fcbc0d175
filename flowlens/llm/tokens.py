"""Tokenizer access inside tasks.

``Encoder`` gives the ids of whole texts by the ``tokenizers`` library. With a
byte-level pre-tokenizer a single space or line feed between two non-space
characters always starts a new piece, so a text is cut there and each distinct
cut is encoded once per worker process; a text holding any other run of white
space at a cut is encoded whole.

``PrefixBPE`` computes, for the same vocabulary, the token count of *every*
prefix by dynamic programming: the last token of a prefix is the one token
that ends there and is compatible with the last token before it, so
``count[i] = count[i - len(token)] + 1``.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from flowlens.llm.text import RELEASE, RELEASE_FOR_TOKENS

#: cuts remembered per worker process (bounds on memory, not on results; a step may add its own)
MEMO, COUNTED = 600_000, 500_000
#: a longer cut is not remembered
MEMO_CHARS = 64
#: characters that prefix counts are put together for at once
STEP_CHARS = 1 << 20
#: bytes of a part, and so at most tokens, whose counts fit 16 bits with one more for the space
SHORT_BYTES = 65_534
_MIXED_SPACE = re.compile(r"\s | \s")
_SPACES = re.compile(r"\s{2,}")
#: marks behind a word, one piece together; of each byte, whether a character starts with it
_MARKS = ".,;:!?"
_STARTS = bytes(b & 0xC0 != 0x80 for b in range(256))
#: fixed value: the splitting pattern of byte-level BPE vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(path: str) -> str:
    """A path as given, or the place of a public vocabulary of that name."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class _Cuts:
    """What was found for cuts of texts, remembered in one array. A class of it says
    what is found: ``_new`` for cuts, ``_alone`` for heads of texts, ``kind`` of numbers."""

    kind = "<u4"

    def forget(self) -> None:
        #: place of each remembered cut; what was found for place i is ``pool[begin[i]:begin[i + 1]]``.
        #: At place 0 there is nothing: a text with such a cut is taken whole
        self.memo: dict[str, int] = {}
        self.pool, self.begin = np.empty(1 << 10, dtype=self.kind), np.zeros(1 << 10, dtype=np.int64)
        self.asked, self.places = np.zeros(1 << 10, dtype=bool), 1

    def _store(self, found: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New places for what was found, each ending there."""
        old, n = self.places, self.places + len(ends)
        top = self.begin[old]
        self.pool = _room(self.pool, top + len(found))
        self.begin, self.asked = _room(self.begin, n + 1), _room(self.asked, n)
        self.pool[top:top + len(found)], self.begin[old + 1:n + 1], self.asked[old:n] = found, top + ends, False
        self.places = n
        return np.arange(old, n)

    def _known(self, cuts: list[str]) -> np.ndarray:
        """Places of distinct cuts, remembered or new; long ones are at the end."""
        if len(self.memo) >= MEMO:
            self._make_room()
        found = np.fromiter(map(self.memo.get, cuts, repeat(-1)), np.int64, len(cuts))
        self.asked[found[found >= 0]] = True
        new = np.flatnonzero(found < 0)
        if len(new):
            some = [cuts[i] for i in new.tolist()]
            long = np.fromiter(map(len, some), np.int64, len(some)) > MEMO_CHARS
            if long.any():
                new, some = np.append(new[~long], new[long]), [*compress(some, ~long), *compress(some, long)]
            short = len(some) - int(long.sum())
            if short:
                found[new[:short]] = at = self._new(some[:short])
                self.memo.update(zip(some, at.tolist()))
            self.kept = self.places
            if long.any():
                found[new[short:]] = self._new(some[short:])
        else:
            self.kept = self.places
        return found

    def _make_room(self) -> None:
        """Forget the cuts that were not asked for again since the last time, and the
        latest ones if the others fill more than half."""
        asked = self.asked.copy()
        asked[0] = False
        kept = [k for k, i in self.memo.items() if asked[i]][:MEMO // 2]
        at = np.fromiter(map(self.memo.__getitem__, kept), np.int64, len(kept))
        pool, begin = self.pool, self.begin
        self.forget()
        if kept:
            size = begin[at + 1] - begin[at]
            ends = size.cumsum()
            places = self._store(pool[np.repeat(begin[at] - (ends - size), size) + np.arange(ends[-1])], ends)
            self.memo = dict(zip(kept, places.tolist()))

    def _laid(self, parts: pa.Array):
        """Of lists of parts, a text each: first part of each text (and the end), what was found for
        all parts one after the other, end of each part in it, parts without a place, heads."""
        at = parts.offsets.to_numpy().astype(np.int64)  # of each text's first part; none is without a part
        coded = parts.flatten().dictionary_encode()
        code, head_at = coded.indices.to_numpy().astype(np.int64), at[:-1]
        heads = coded.dictionary.take(pa.array(code[head_at])).to_pylist()
        # a head follows no space: it gets a place of its own behind the distinct cuts
        n, first = len(coded.dictionary), dict.fromkeys(heads)
        first = dict(zip(first, range(n, n + len(first))))
        code[head_at] = np.fromiter(map(first.__getitem__, heads), np.int64, len(heads))
        used = np.zeros(n + len(first), dtype=bool)
        used[code] = True
        cuts = coded.dictionary.filter(pa.array(used[:n])).to_numpy(zero_copy_only=False).tolist()
        place = np.zeros(len(used), dtype=np.int64)
        place[used] = np.append(self._known(cuts), self._alone(list(first)))
        begin, size = self.begin[place], self.begin[place + 1] - self.begin[place]
        size = size[code]
        ends = size.cumsum()
        out = self.pool[np.repeat(begin[code] - (ends - size), size) + np.arange(ends[-1])]
        self.places = self.kept  # heads and long cuts are not remembered
        return at, out, ends, (place == 0)[code], heads


class Encoder(_Cuts):
    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as the machine's 32-bit integers; it must be little-endian")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                     and pre.get("use_regex") is True and not pre.get("add_prefix_space")
                     and len(self.lib.encode("\n", add_special_tokens=False).ids) == 1
                     and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"]
                                 for t in spec.get("added_tokens", [])))
        self.vocab_size = self.lib.get_vocab_size(with_added_tokens=True)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(added) or r"(?!)").search
        spaced = r"^\n?\Z|^[^\S\n]|^\n\s|\s\Z"
        self.spaced = re.compile(spaced).search
        self.odd = re.compile("|".join([spaced, *added])).search
        #: bytes of each id, where ids stand for bytes and leave none out
        self.bytes_of = None
        model = spec["model"]
        if model.get("type") == "BPE" and not any(
                model.get(x) for x in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            self.bytes_of = np.zeros(self.vocab_size + 1, dtype=np.int64)
            for token, i in self.lib.get_vocab(with_added_tokens=False).items():
                self.bytes_of[i] = len(token)
        self.mixed = re.compile("|".join([r"\s\s", *added])).search
        self.forget()

    def _library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return self._library(texts)
        out: list[bytes] = []
        for i in range(0, len(texts), 400):
            out.extend(self._cut(texts[i:i + 400]))
        return out

    def _alone(self, texts: list[str]) -> np.ndarray:
        """Places of texts encoded each by itself."""
        ids = self._library(texts)
        return self._store(np.frombuffer(b"".join(ids), dtype="<u4"),
                           np.cumsum([len(x) // 4 for x in ids], dtype=np.int64))

    def _new(self, cuts: list[str]) -> np.ndarray:
        """Places of the ids of each cut with what it is cut off by: the line feed
        it starts with, or else a space. None where white space at an end makes
        the pieces depend on the neighbours: such a text is encoded whole."""
        # a cut holds no space, and a line feed only where it starts
        joined = [(" " + " ".join(cuts[i:i + 256])).replace(" \n", "\n") for i in range(0, len(cuts), 256)]
        text = "".join(joined)
        if self.mixed(text + " "):
            plain, own, found = [], [], np.zeros(len(cuts), dtype=np.int64)
            for i, p in enumerate(cuts):
                if not self.odd(p):
                    plain.append(i)
                elif self.special(p) and not self.spaced(p):
                    own.append(i)
            if len(plain) < len(cuts):
                if plain:
                    found[plain] = self._new([cuts[i] for i in plain])
                if own:
                    found[own] = self._alone([p if p[0] == "\n" else " " + p for p in map(cuts.__getitem__, own)])
                return found
        if self.bytes_of is not None:
            # many cuts in one call: the bytes of the ids tell where each cut ends
            raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
            ids = np.frombuffer(b"".join(self._library(joined)), dtype="<u4")
            ends = np.append(np.flatnonzero((raw == 0x20) | (raw == 0x0A))[1:], len(raw))
            upto = self.bytes_of[ids].cumsum()
            at = np.searchsorted(upto, ends)
            if len(ends) == len(cuts) and at[-1] == len(ids) - 1 and (upto[at] == ends).all():
                return self._store(ids, at + 1)
        return self._alone([p if p[0] == "\n" else " " + p for p in cuts])

    def _cut(self, texts: list[str]) -> list[bytes]:
        parts = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        at, out, ends, lost, heads = self._laid(parts)
        stop = ends[at[1:] - 1].tolist()
        made = [out[a:b].tobytes() for a, b in zip([0, *stop], stop)]
        odd = np.logical_or.reduceat(lost, at[:-1]) if len(heads) else lost[:0]
        whole = [i for i, (bad, head, k) in enumerate(zip(odd.tolist(), heads, np.diff(at).tolist()))
                 if bad or k > 1 and head[-1:].isspace()]
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            made[i] = ids
        return made


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n``."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) * 5 // 4), dtype=a.dtype)
    out[:len(a)] = a
    return out


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; a task asks for it once."""
    for give_way in RELEASE_FOR_TOKENS:
        give_way()
    return _encoder(path)


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    found = Encoder(vocabulary_path(path))
    RELEASE.append(found.forget)
    return found


def _byte_chars() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies print it as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    chars.update({chr(256 + i): b for i, b in enumerate(rest)})
    return chars


def _long(part: str) -> bool:
    """A part may hold more tokens than 16 bits count: no token is less than a byte."""
    return 4 * len(part) > SHORT_BYTES and len(part.encode("utf-8")) > SHORT_BYTES


class _Table:
    """Small numbers by keys of 0 or more, many looked up at once; -1 for an unknown key."""

    def __init__(self, bits: int):
        self.shift, self.last, self.n = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        at = at[left]
        while len(left):
            at = at + 1 & self.last
            there, asked = self.keys[at], keys[left]
            hit = there == asked
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], at[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet; not to fill more than half."""
        self.n += len(keys)
        at = self._at(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys  # of those at one free slot the last has it
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], at[~mine] + 1 & self.last


class PrefixBPE(_Cuts):
    """Token counts of all prefixes of a text under a byte-level BPE vocabulary."""

    kind = "<u2"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        if (model.get("type") != "BPE" or spec.get("normalizer") is not None or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("ignore_merges")
                or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)):
            raise ValueError("prefix counts need a plain byte-level BPE vocabulary")
        chars = _byte_chars()
        vocab = model["vocab"]
        self.ids = {bytes(chars[c] for c in t): i for t, i in vocab.items() if all(c in chars for c in t)}
        size = max(vocab.values()) + 1
        self.rank = [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.merge: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            m, x, y = vocab[a + b], vocab[a], vocab[b]
            self.rank[m], self.left[m], self.right[m] = r, x, y
            self.merge[x << 20 | y] = r
        self.longest = max(map(len, self.ids))
        self.sound: dict[int, bool] = {}
        self._tables()
        self.forget()
        special = [re.escape(t["content"]) for t in added]
        self.special = re.compile("|".join(special)) if special else None
        self.lines = not any("\n" in t["content"] for t in added)
        self.split = regex.compile(PATTERN)
        self.odd = re.compile("|".join([r"\s\s", r"\s\Z", *special])).search

    def forget(self) -> None:
        super().forget()
        self.known: dict[bytes, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.fit = _Table(1)

    @property
    def pieces(self) -> dict[str, int]:
        """The remembered cuts."""
        return self.memo

    def _tables(self) -> None:
        """What ``_count`` looks up: tokens by their bytes from the last to the first (a
        step leads from a node and a byte to a node), ranks and sound tokens."""
        step: dict[int, int] = {}
        ends: list[int] = [-1]
        for data, t in self.ids.items():
            node = 0
            for byte in reversed(data):
                to = step.get(node << 8 | byte)
                if to is None:
                    to = step[node << 8 | byte] = len(ends)
                    ends.append(-1)
                node = to
            ends[node] = t
        self.token = np.array(ends, dtype=np.int64)
        self.steps, self.joins = (_Table(max(map(len, (step, self.merge))).bit_length() + 2) for _ in range(2))
        for table, known in ((self.steps, step), (self.joins, self.merge)):
            table.put(np.fromiter(known, np.int64, len(known)), np.fromiter(known.values(), np.int32, len(known)))
        self.ranks, self.lefts, self.rights = (np.array(x, dtype=np.int64) for x in (self.rank, self.left, self.right))
        self.whole = np.zeros(len(self.rank), dtype=bool)
        self.whole[list(self.ids.values())] = [self._sound(t) for t in self.ids.values()]

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """No merge of rank under ``limit`` joins a token ending with ``a`` and
        one starting with ``b``, at any step of their making."""
        rank, merge = self.rank, self.merge
        while True:
            r = merge.get(a << 20 | b)
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def _fitting(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Which tokens are sound and lie apart from the last token before them."""
        keys = last << 20 | token
        out = self.fit.get(keys)
        unknown = out < 0
        if unknown.any():
            new = np.unique(keys[unknown])
            a, b = new >> 20, new & (1 << 20) - 1
            ok, limit = self.whole[b], np.full(len(new), 1 << 60)
            open_ = np.flatnonzero(ok)
            a, b, limit = a[open_], b[open_], limit[open_]
            while len(open_):  # as in _apart, all at once
                r = self.joins.get(a << 20 | b)
                bad = (r >= 0) & (r < limit)
                ok[open_[bad]] = False
                ra, rb = self.ranks[a], self.ranks[b]
                first = ra > rb
                on = ~bad & (first | (rb >= 0))
                limit = np.where(first, ra, rb + 1)[on]
                a, b = np.where(first, self.rights[a], a)[on], np.where(first, b, self.lefts[b])[on]
                open_ = open_[on]
            if 2 * (self.fit.n + len(new)) > self.fit.last:
                self.fit = _Table(20)
            if 2 * len(new) <= self.fit.last:
                self.fit.put(new, ok.astype(np.int32))
            out[unknown] = ok[np.searchsorted(new, keys[unknown])]
        return out > 0

    def _sound(self, t: int) -> bool:
        """The bytes of token ``t`` alone encode to ``t``."""
        known = self.sound.get(t)
        if known is None:
            r = self.rank[t]
            known = r < 0 or (self._sound(self.left[t]) and self._sound(self.right[t])
                              and self._apart(self.left[t], self.right[t], r))
            self.sound[t] = known
        return known

    def _extend(self, data: bytes, upto: int, count: list[int], last: list[int]) -> None:
        """Extend the table to the prefix of ``upto`` bytes."""
        ids, fits, longest = self.ids, self.fits, self.longest
        for i in range(len(count), upto + 1):
            for start in range(i - 1, max(-1, i - longest - 1), -1):
                t = ids.get(data[start:i])
                if t is None:
                    continue
                if start:
                    key = last[start] << 20 | t
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) > 1_000_000:
                            fits.clear()
                        ok = fits[key] = self._sound(t) and self._apart(last[start], t, 1 << 60)
                else:
                    ok = self._sound(t)
                if ok:
                    count.append(count[start] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def piece(self, data: bytes) -> list[int]:
        """Token count of every byte prefix of one piece (index 0: empty).
        Pieces that begin alike share the table of their common prefix: a known
        prefix of n bytes has its n + 1 counts, a byte each, and the last tokens."""
        known = self.known
        short = k = min(len(data), 20)
        while k:
            v = known.get(data[:k])
            if v is not None:
                break
            k -= 1
        if not k:
            count, last = [0], [0]
        elif k == len(data):
            return list(v[:k + 1])
        else:
            count, last = list(v[:k + 1]), array("I", v[k + 1:]).tolist()
        if k < short:
            self._extend(data, short, count, last)
            counts, tokens = bytes(count), array("I", last).tobytes()
            for i in range(k + 1, short + 1):
                if len(known) > COUNTED:
                    known.clear()
                known[data[:i]] = counts[:i + 1] + tokens[:4 * i + 4]
        if short < len(data):
            self._extend(data, len(data), count, last)
        return count

    def _chars(self, s: str) -> list[int]:
        """Token count of every character prefix of one piece, from length 1."""
        count = self.piece(data := s.encode("utf-8"))
        if len(data) == len(s):
            return count[1:]
        return list(compress(count[1:], (data[1:] + b"a").translate(_STARTS)))

    def _pieces(self, s: str) -> list[str]:
        """The pieces of a text. A Latin word, with its space and marks behind it if
        any, needs no pattern."""
        core = s.rstrip(_MARKS)
        if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()) and max(core) < "\u0250":
            return [s] if len(core) == len(s) else [core, s[len(core):]]
        return self.split.findall(s)

    def _plain(self, s: str) -> list[int]:
        """Counts of every prefix of a text without special strings."""
        out, base = [0], 0
        for p in self._pieces(s):
            got = self._chars(p)
            if len(p) == 3 and p[0] == "'" and p[1:].isascii() and p in ("'re", "'ve", "'ll"):
                got[1] = 2  # cut inside, the apostrophe and the letter are two pieces
            out.extend([base + x for x in got])
            base += got[-1]
        for m in _SPACES.finditer(s):  # a prefix ending inside a run of white space has it as one piece
            a, b = m.span()
            if all(regex.match(r"\s", c) for c in m.group()):
                out[a + 1:b + 1] = [out[a] + x for x in self._chars(m.group())]
            else:
                for k in regex.finditer(r"\s{2,}", m.group()):
                    i, j = a + k.start(), a + k.end()
                    out[i + 1:j + 1] = [out[i] + x for x in self._chars(k.group())]
        return out

    def general(self, s: str) -> list[int]:
        """Counts of every prefix, special strings counted as one token each."""
        if self.special is None or not self.special.search(s):
            return self._plain(s)
        out, base, at = [0], 0, 0
        for m in self.special.finditer(s):
            a, b = m.span()
            part = self._plain(s[at:b - 1])  # inside the special string its characters are plain text
            out.extend([base + x for x in part[1:]])
            base += part[a - at] + 1
            out.append(base)
            at = b
        out.extend([base + x for x in self._plain(s[at:])[1:]])
        return out

    def _count(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token count of every byte prefix of many pieces, the table of ``_extend``
        filled for all of them at once, byte after byte."""
        count, last = np.zeros(len(raw), dtype=np.int64), np.zeros(len(raw), dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], -size[order]
        for i in range(int(-size[0]) if len(size) else 0):
            at = begin[:np.searchsorted(size, -i)] + i  # of the pieces with a byte more
            node = np.zeros(len(at), dtype=np.int64)
            for back in range(i + 1):
                node = self.steps.get(node << 8 | raw[at - back])
                on = node >= 0
                if not on.all():
                    at, node = at[on], node[on]
                token = self.token[node]
                some = np.flatnonzero(token >= 0)
                to, token = at[some], token[some]
                ok = self._fitting(last[to - back - 1], token) if back < i else self.whole[token]
                some, to, token = some[ok], to[ok], token[ok]
                last[to] = token
                count[to] = count[to - back - 1] + 1 if back < i else 1
                on = np.ones(len(at), dtype=bool)
                on[some] = False
                at, node = at[on], node[on]
                if not len(at):
                    break
        if not count.all():
            raise ValueError("the vocabulary lacks a byte")
        return count

    def _alone(self, texts: list[str]) -> np.ndarray:
        """Places of texts counted each by itself."""
        found = [self.general(t)[1:] for t in texts]
        return self._store(np.array([x for got in found for x in got], dtype="<u2"),
                           np.cumsum([len(got) for got in found], dtype=np.int64))

    def _new(self, cuts: list[str]) -> np.ndarray:
        """Places of the counts of each cut with what it is cut off by: the line feed
        it starts with, or else a space."""
        own = [p if p[:1] == "\n" else " " + p for p in cuts]
        text = "".join(own)
        if self.odd(text):  # white space at an end, or runs of it, or special strings
            odd = np.fromiter((self.odd(p) is not None for p in own), bool, len(own))
            if odd.any():
                found = np.zeros(len(cuts), dtype=np.int64)
                found[odd] = self._alone([*compress(own, odd)])
                if not odd.all():
                    found[~odd] = self._new([*compress(cuts, ~odd)])
                return found
        # pieces never span cuts; each distinct one is counted once
        coded = pa.array(self.split.findall(text), pa.large_string()).dictionary_encode()
        code, pieces = coded.indices.to_numpy(), coded.dictionary
        chars = pc.utf8_length(pieces).to_numpy()
        upto = chars[code].cumsum()
        ends = np.fromiter(map(len, own), np.int64, len(own)).cumsum()
        stop = np.searchsorted(upto, ends)
        if stop[-1] != len(code) - 1 or (upto[stop] != ends).any():
            return self._alone(own)
        _, offsets, data = pieces.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[:len(pieces) + 1]
        raw, size = np.frombuffer(data, dtype=np.uint8), np.diff(offsets)
        short = size <= MEMO_CHARS
        count = np.zeros(offsets[-1], dtype=np.int64)
        used = np.repeat(short, size)
        count[used] = self._count(raw[:offsets[-1]][used], (size[short].cumsum() - size[short]), size[short])
        for k in np.flatnonzero(~short).tolist():
            count[offsets[k]:offsets[k + 1]] = self.piece(raw[offsets[k]:offsets[k + 1]].tobytes())[1:]
        # a prefix of characters ends where the next byte starts one
        count = count[np.append((raw[1:offsets[-1]] & 0xC0) != 0x80, True)]
        after = chars.cumsum()
        for k, p in enumerate(pieces.filter(pc.and_(pc.equal(pc.binary_length(pieces), 3), pc.starts_with(
                pieces, "'"))).to_pylist()):
            if p in ("'re", "'ve", "'ll"):  # cut inside, the apostrophe and the letter are two pieces
                count[after[pc.index(pieces, p).as_py()] - 2] = 2
        total = count[after - 1][code]
        base = total.cumsum() - total
        base -= np.repeat(base[np.append(0, stop[:-1] + 1)], np.diff(stop, prepend=-1))
        n = chars[code]
        at = np.repeat((after - chars)[code] - (upto - n), n) + np.arange(upto[-1])
        return self._store((count[at] + np.repeat(base, n)).astype("<u2"), ends)

    def counts(self, text: str) -> np.ndarray:
        """int32 counts of the prefixes of 0, 1, ... len(text) characters."""
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """``counts`` of each text."""
        out: list = [None] * len(texts)
        step, parts, held = [], [], 0
        for i, text in enumerate(texts):
            if not _SPACES.search(text) and self.lines:
                # a line feed alone is a piece of its own: cut before it, too
                cut = text.replace("\n", " \n")
            elif _MIXED_SPACE.search(text):
                out[i] = np.asarray(self.general(text), dtype="<i4")
                continue
            else:
                cut = text
            if 4 * len(cut) > SHORT_BYTES and any(map(_long, cut.split(" "))):
                out[i] = np.asarray(self.general(text), dtype="<i4")
                continue
            step.append(i)
            parts.append(cut)
            held += len(cut)
            if held > STEP_CHARS:
                self._step(step, parts, out)
                step, parts, held = [], [], 0
        if step:
            self._step(step, parts, out)
        return out

    def _step(self, step: list[int], parts: list[str], out: list) -> None:
        at, inside, ends, _, _ = self._laid(pc.split_pattern(pa.array(parts, pa.large_string()), " "))
        sizes = np.diff(ends, prepend=0)
        total = np.zeros(len(ends), dtype=np.int64)
        some = sizes > 0
        total[some] = inside[ends[some] - 1]
        base = total.cumsum() - total
        base -= np.repeat(base[at[:-1]], np.diff(at))
        counts = inside + np.repeat(base.astype("<i4"), sizes)
        stop = ends[at[1:] - 1].tolist()
        for i, a, b in zip(step, [0, *stop], stop):
            out[i] = np.zeros(b - a + 1, dtype="<i4")
            out[i][1:] = counts[a:b]


@lru_cache(maxsize=4)
def prefix_bpe(path: str) -> PrefixBPE:
    found = PrefixBPE(vocabulary_path(path))
    RELEASE.append(found.forget)
    return found

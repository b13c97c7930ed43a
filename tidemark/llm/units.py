"""Token ids of whole texts with the tokenizers library, memoised by unit.

A unit is a stretch of text that the tokenizer treats independently of what stands around it, so the ids of a text are
those of its units, one after another; all ids come from the library.  A tokenizer that drops white space has what stands
between ASCII white space as units: no token holds white space, and no character is composed across it.  For a byte-level
tokenizer a unit starts at a space that stands before a character that is no white space: the pattern of such tokenizers
takes that space as the start of a token in every case.  Texts with a space before white space are cut at such places
only.

Texts are split and their units numbered in Arrow; only distinct units of a slice are looked up in Python, and those not
in the memo go through the library, many at a time: a text of many units is encoded and its ids are parted again where a
unit begins.  A text that holds the string of an added token (an end mark, say) goes to the library whole.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

_EDGE = re.compile(r" (?=\S)")
#: Latin letters that are one character each however they are normalised or folded, and punctuation that begins no contraction.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_ENDS = rf"^{_LETTERS}+[!-&(-/:-@\[-`{{-~][!-/:-@\[-`{{-~]*$"
_APART = r"^(?:$|[\s\x0b\x1c-\x1f\x{85}\p{Z}])"  # nothing, or white space first
#: A letter that stands between units of a text for the library; a unit that holds it goes through the library alone.
MARK = "ꙮ"
ENTRY = 220  # bytes that an entry of the memo takes besides its strings


class UnitEncoder:
    """Memo of two generations with at most `memo_bytes` each; `drops_space` tells the kind of the tokenizer."""

    def __init__(self, path: str, drops_space: bool, memo_bytes: int = 40 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.tokenizer.encode_special_tokens = True  # units hold no added token: texts with one don't come here
        self.path, self.whole = path, None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added, self.begin = "(?i)" + "|".join(map(re.escape, added)) if added else "", re.match(r"[^\w\s]*", os.path.commonprefix(added)).group()
        self.drops_space, self.memo_bytes, self.held = drops_space, memo_bytes, 0
        #: the tokenizer parts letters from "." and ",", and takes A-Z for a-z (its own file tells)
        tells = self.tokenizer.to_str().partition('"model"')[0]
        self.splits = "\\\\p{L}" in tells or '"ByteLevel"' in tells and '"use_regex":true' in tells
        self.folds = '"type":"Lowercase"' in tells
        if drops_space:
            self.mark = np.array(self.tokenizer.encode(MARK, add_special_tokens=False).ids, np.uint32)
        else:
            # ids of tokens that begin with the space, which byte-level tokenizers write so
            self.heads = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.heads[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "Ġ"]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def with_added(self, texts: pa.Array) -> list[int]:
        """Texts that may hold an added token's string, in whatever case."""
        if not self.added:
            return []
        some = np.flatnonzero(pc.match_substring(texts, self.begin).to_numpy(zero_copy_only=False))
        return some[pc.match_substring_regex(texts.take(pa.array(some)), self.added).to_numpy(zero_copy_only=False)].tolist() if len(some) else []

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """Ids as the library gives them for whole texts, added tokens included."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return [array("I", x.ids).tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self, ids: np.ndarray, units: list[str]) -> list[bytes]:
        """The ids of a text of units, parted where a unit begins."""
        if self.drops_space:
            at = np.flatnonzero(ids[: max(0, len(ids) - len(self.mark) + 1)] == self.mark[0])
            for k, one in enumerate(self.mark):
                at = at[ids[at + k] == one]
            first, stop = np.concatenate([[0], at + len(self.mark)]), np.append(at, len(ids))
        else:
            first = np.flatnonzero(self.heads[ids])
            stop = np.append(first[1:], len(ids))
        if len(first) != len(units):
            return self.library(units if self.drops_space else [" " + u for u in units])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((4 * first).tolist(), (4 * stop).tolist(), strict=True)]

    def _library_units(self, units: list[str], many: int = 1000) -> list[bytes]:
        """Ids of units, by the library: a text holds many of them, but one that is long, empty or holds the mark goes alone."""
        alone = [u for u in units if len(u) > 1000 or not u or MARK in u]
        own = dict(zip(alone, self.library(alone if self.drops_space else [" " + u for u in alone]), strict=True))
        rest = [u for u in units if u not in own] if own else units
        parts = [rest[i : i + many] for i in range(0, len(rest), many)]
        got: list[bytes] = []
        join = f" {MARK} ".join if self.drops_space else lambda part: " " + " ".join(part)
        if self.drops_space and self.folds:  # lower-case ASCII letters are one token stretch each: straight to the model
            tokens = self.tokenizer.model.tokenize
            plain = {u: array("I", [t.id for t in tokens(u)]).tobytes() for u in rest if u.isascii() and u.islower() and u.isalpha()}
            if plain:
                own.update(plain)
                rest = [u for u in rest if u not in plain]
                parts = [rest[i : i + many] for i in range(0, len(rest), many)]
        for x, part in zip(self.tokenizer.encode_batch_fast([join(p) for p in parts], add_special_tokens=False), parts, strict=True):
            got += self._parted(np.array(x.ids, np.uint32), part)
        if own:
            own.update(zip(rest, got, strict=True))
            return [own[u] for u in units]
        return got

    def _ids_of(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units (without the space that a byte-level tokenizer's units begin with)."""
        if self.held > self.memo_bytes:
            self.old, self.new, self.held = self.new, {}, 0
        new = self.new
        out = list(map(new.get, units))
        at = [k for k, v in enumerate(out) if v is None]
        if not at:
            return out
        names = [units[k] for k in at]
        got = list(map(self.old.get, names))
        fresh = [k for k, v in enumerate(got) if v is None]
        for k, v in zip(fresh, self._library_units([names[k] for k in fresh]), strict=True):
            got[k] = v
        new.update(zip(names, got, strict=True))
        self.held += ENTRY * len(names) + sum(map(len, names)) + sum(map(len, got))
        for k, v in zip(at, got, strict=True):
            out[k] = v
        return out

    def _values(self, units: pa.Array) -> pa.Array:
        """Ids of distinct units as bytes.  Letters and the ASCII punctuation behind them are independent of each other."""
        if not self.splits:
            return pa.array(self._ids_of(units.to_pylist()), pa.large_binary())
        ends = pc.match_substring_regex(units, _ENDS)
        some = units.filter(ends)
        core = pc.replace_with_mask(units, ends, pc.utf8_rtrim(some, string.punctuation))
        tail = pc.replace_with_mask(pa.repeat("", len(units)), ends, pc.replace_substring_regex(some, f"^{_LETTERS}+", ""))
        if self.folds:
            core = pc.if_else(pc.match_substring_regex(core, f"^{_LETTERS}+$"), pc.utf8_lower(core), core)
        core, tail = core.dictionary_encode(), tail.dictionary_encode()
        ends = tail.dictionary.to_pylist()  # these stand behind a letter: no space before them
        cores = pa.array(self._ids_of(core.dictionary.to_pylist()), pa.large_binary()).take(core.indices)
        tails = pa.array(self.library(ends), pa.large_binary()).take(tail.indices)
        return pc.binary_join_element_wise(cores, tails, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as little-endian unsigned 32-bit integers, where each text's begin and one end more)."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = self.with_added(texts)
        if not whole:
            return self._encode(texts)
        mask = np.zeros(len(texts), bool)
        mask[whole] = True
        ids, edges = self._encode(pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts))
        return self._put(whole, self.encode_whole(texts.take(pa.array(whole)).to_pylist()), ids, edges)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.ascii_split_whitespace(texts) if self.drops_space else pc.split_pattern(texts, " ")
        ends = pieces.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        numbered = pieces.flatten().dictionary_encode()
        units, at = numbered.dictionary, numbered.indices.to_numpy()
        loose: list[int] = []
        if self.drops_space:
            values = self._values(units)
        else:
            first = ends[:-1]
            apart = pc.match_substring_regex(units, _APART)
            bad = apart.to_numpy(zero_copy_only=False)[at]
            bad[first] = False
            if bad.any():
                loose = np.unique(np.searchsorted(ends, np.flatnonzero(bad), side="right") - 1).tolist()
            # a text's first unit has no space before it; of loose texts nothing is taken here
            heads, whose = np.unique(at[first], return_inverse=True)
            own = pa.array(self.library(units.take(pa.array(heads)).to_pylist()) + [b""], pa.large_binary())
            values = pa.concat_arrays([self._values(pc.if_else(apart, "a", units)), own])
            at = at.astype(np.int64)
            at[first] = len(units) + whose.ravel()
            if loose:
                at[np.repeat(np.isin(np.arange(len(texts)), loose), np.diff(ends))] = len(values) - 1
        flat = values.take(pa.array(at))
        edges = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[ends] // 4
        ids = np.frombuffer(flat.buffers()[2], np.uint32, int(edges[-1])) if edges[-1] else np.zeros(0, np.uint32)
        return self._with(texts, loose, ids, edges) if loose else (ids, edges)

    def _with(self, texts: pa.Array, loose: list[int], ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of texts with a space before white space in their (empty) places."""
        split = []
        for k in loose:
            head, *rest = _EDGE.split(texts[k].as_py())
            split.append((head, rest))
        units = list(dict.fromkeys(u for _, rest in split for u in rest))
        # a unit that holds a space has more than one token that begins with one
        odd = [u for u in units if " " in u]
        of = dict(zip(odd, self.library([" " + u for u in odd]), strict=True))
        even = [u for u in units if u not in of]
        of.update(zip(even, self._ids_of(even), strict=True))
        heads = self.library([h for h, _ in split])
        return self._put(loose, [first + b"".join(map(of.__getitem__, rest)) for (_, rest), first in zip(split, heads, strict=True)], ids, edges)

    def _put(self, places: list[int], got: list[bytes], ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and edges with those of some texts, which have none there, put in."""
        parts, sizes, last = [], np.diff(edges), 0
        for k, raw in zip(places, got, strict=True):
            parts += [ids[last : edges[k]], np.frombuffer(raw, np.uint32)]
            last, sizes[k] = edges[k], len(raw) // 4
        return np.concatenate([*parts, ids[last:]]), np.concatenate([[0], np.cumsum(sizes)])


def encoder(path: str, drops_space: bool) -> UnitEncoder:
    """The worker's encoder for a tokenizer file."""
    memo = worker_state().__dict__.setdefault("encoders", {})
    key = (path, drops_space)
    if key not in memo:
        memo[key] = UnitEncoder(path, drops_space)
    return memo[key]

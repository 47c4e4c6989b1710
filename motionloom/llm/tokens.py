"""Exact byte-level BPE ids for whole texts, through the `tokenizers` library.

The vocabulary's pre-tokenizer starts a new piece at a single space or line feed
between two non-space characters, whatever stands around it. So a text is cut
there, each distinct part is encoded once by the library, and ids are put together
by index. Other white space is never cut at and stays inside a part. A mark after
a letter is a piece of its own, so such a part is its stem's ids and the mark's.
A space with letters after it is one piece, so such parts go to the library in the
vocabulary's own characters, where they are told apart by the space's alone.

This holds for vocabularies that declare the byte-level pre-tokenizer with its usual
pattern, no normalizer, and added tokens without white space. What a file declares is
compared on load; texts go whole to the library where it declares anything else.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

#: Distinct parts a worker remembers before it forgets those it met once; bounds memory only.
CACHE_PARTS = 1_800_000

#: Marks that end a part, and are one token each.
MARKED = re.compile(rb"[ \n].*[A-Za-z][,.;:!?]", re.DOTALL).fullmatch

#: Parts that are one piece: a space and letters (ASCII, Latin-1 and Latin Extended-A).
PLAIN = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])+").fullmatch

#: New parts that the library gets as one text.
JOINED = 2000

#: Parts that may stand one after another in one text: cut at both ends by the rule of encode().
CUT = re.compile(rb"[ \n](?=[!-~\xc3-\xe0\xe4-\xff]).*(?<![\x00-\x20\x7f])(?<!\xc2.)(?<![\xe1-\xe3]..)", re.DOTALL).fullmatch


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def obeys_the_rule(file: dict) -> bool:
    """Whether a tokenizer file declares what the cut rule is made for."""
    before, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in file.get("added_tokens") or [])
    vocabulary = model.get("vocab") or {}
    return plain and added and file.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and all(m in vocabulary for m in ",.;:!?")


def written_bytes() -> dict[int, int]:
    """The character with which byte-level vocabularies write each byte."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in kept else next(others) for b in range(256)}


class PartEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        file = json.loads(self.library.to_str())
        self.whole = not obeys_the_rule(file)
        if self.whole:
            return
        self.pieces = None
        if not any(t["content"].isalpha() for t in file.get("added_tokens") or []):
            self.pieces = Tokenizer.from_file(path)
            self.pieces.pre_tokenizer = pre_tokenizers.Split("\u0120", "merged_with_next")
            self.characters = written_bytes()
        # the vocabulary writes each byte of a token as one character
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.mark = {m: vocabulary[chr(m)] for m in b",.;:!?"}
        self.reset()

    def reset(self) -> None:
        """Forget all parts."""
        self.entry: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, bool)

    def _forget(self) -> None:
        """Forget the parts that were not met again since the last time, or all if most were."""
        keep = np.flatnonzero(self.again[: len(self.entry)])
        if not 0 < len(keep) <= CACHE_PARTS // 2:
            return self.reset()
        parts, lens = list(self.entry), self.length[keep]
        at = np.repeat(self.start[keep] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        parts, flat = [parts[i] for i in keep.tolist()], self.ids[at]
        self.reset()
        self._append(parts, flat, lens, np.arange(len(parts)))

    def _library(self, text: bytes, plain: bool = False) -> np.ndarray:
        if plain:
            text = text.decode("ascii").replace(" ", "\u0120") if text.isascii() else text.decode("latin-1").translate(self.characters)
            return np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        return np.array(self.library.encode_batch_fast([text.decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)

    def _encoded(self, parts: list[bytes], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after another, and each part's number of ids.

        The parts are one text to the library; its ids' bytes tell where a part ends.
        Should an id reach over such an end, each part is encoded by itself.
        """
        ids = self._library(b"".join(parts), plain)
        reached = np.cumsum(self.bytes_of[ids])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        stop = np.searchsorted(reached, ends, "right")
        if len(reached) and stop[0] > 0 and reached[-1] == ends[-1] and (reached[stop - 1] == ends).all():
            return ids, np.diff(stop, prepend=0)
        each = [self._library(p) for p in parts]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _add(self, parts: list[bytes]) -> None:
        """Encode parts the cache lacks: stems first, then those that are a stem and a mark."""
        marked = [p for p in parts if p[-1] in self.mark and MARKED(p) and CUT(p)]
        apart = set(marked)
        stems = dict.fromkeys(p[:-1] for p in marked)
        self._store([p for p in dict.fromkeys(chain(stems, parts)) if p not in apart and p not in self.entry])
        if marked:
            of = np.fromiter((self.entry[p[:-1]] for p in marked), np.int64, len(marked))
            last = np.fromiter((self.mark[p[-1]] for p in marked), np.uint32, len(marked))
            lens = self.length[of] + 1
            ends = np.cumsum(lens)
            at = np.repeat(self.start[of] - (ends - lens), lens) + np.arange(int(ends[-1]))
            at[ends - 1] = 0
            flat = self.ids[at]
            flat[ends - 1] = last
            self._append(marked, flat, lens, np.arange(len(marked)))

    def _store(self, parts: list[bytes]) -> None:
        """Encode parts, those that are cut at both ends together, plain ones apart from others."""
        # 0: plain ASCII, 1: plain, 2: cut, 3: neither
        kind = np.fromiter(((0 if p.isascii() else 1) if self.pieces and PLAIN(p) else 2 if CUT(p) else 3 for p in parts), np.int8, len(parts))
        lens, flat = np.zeros(len(parts), np.int64), [np.zeros(0, np.uint32)]
        runs = [(k, which[i : i + n]) for k, n in ((0, JOINED), (1, JOINED), (2, JOINED), (3, 1)) for which in [np.flatnonzero(kind == k)] for i in range(0, len(which), n)]
        for k, run in runs:
            ids, lens[run] = self._encoded([parts[i] for i in run.tolist()], k < 2)
            flat.append(ids)
        if runs:
            self._append(parts, np.concatenate(flat), lens, np.concatenate([run for _, run in runs]))

    def _append(self, parts: list[bytes], flat: np.ndarray, lens: np.ndarray, order: np.ndarray) -> None:
        """Remember parts with their ids, which lie in this order."""
        k, n = len(self.entry), len(self.entry) + len(parts)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, max(2 * len(self.ids), self.used + len(flat)))
        if n > len(self.start):
            self.start, self.length, self.again = (np.resize(x, max(2 * len(x), n)) for x in (self.start, self.length, self.again))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[k + order] = self.used + np.cumsum(lens[order]) - lens[order]
        self.length[k:n] = lens
        self.again[k:n] = False
        self.used += len(flat)
        self.entry.update(zip(parts, range(k, n), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids."""
        if self.whole:
            each = [e.ids for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        if len(self.entry) > CACHE_PARTS:
            self._forget()
        texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        if not n or offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        data = texts.buffers()[2].slice(lo, hi - lo)
        b, offsets = np.frombuffer(data, np.uint8), offsets - lo
        cuts = np.flatnonzero((b == 0x20) | (b == 0x0A))
        cuts = cuts[(cuts >= 3) & (cuts < len(b) - 1)]
        # white space beyond ASCII ends in C2 xx or E1-E3 xx xx and begins with C2, E1, E2 or E3
        nxt, prev = b[cuts + 1], b[cuts - 1]
        fine = (nxt > 0x20) & (nxt != 0x7F) & (nxt != 0xC2) & ~((nxt >= 0xE1) & (nxt <= 0xE3)) & (prev > 0x20) & (prev != 0x7F)
        wide = prev >= 0x80
        lead = b[cuts - 3]
        fine &= ~(wide & ((b[cuts - 2] == 0xC2) | ((lead >= 0xE1) & (lead <= 0xE3))))
        begins = np.zeros(len(b) + 1, bool)
        begins[cuts[fine]] = True
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins[:-1])
        bounds = np.append(starts, len(b)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), data])
        coded = parts.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        found = map(self.entry.get, keys, repeat(-1))
        found = np.fromiter(found, np.int64, len(keys))
        self.again[found[found >= 0]] = True
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [keys[i] for i in missing.tolist()]
            self._add(new)
            found[missing] = np.fromiter(map(self.entry.__getitem__, new), np.int64, len(new))
        e = found[coded.indices.to_numpy()]
        lens = self.length[e]
        ends = np.cumsum(lens)
        at = np.repeat(self.start[e] - (ends - lens), lens)
        at += np.arange(len(at))
        first = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], ends])[first]
        return self.ids[at], np.diff(total)


@lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    """One encoder for each worker process."""
    return PartEncoder(path)

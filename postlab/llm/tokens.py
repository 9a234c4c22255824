"""Whole texts to token ids, with each distinct piece between spaces encoded once per worker.

A tokenizer that never joins characters across a space can be run on the pieces of a text. Two kinds are known here
by their file: those that drop white space, and byte-level ones that glue one space to the front of a word. All others
encode whole texts. Results are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postlab.llm.shingles import mixed

#: Bytes of the pieces a worker remembers with their ids; the memory is emptied when they are more. A piece is remembered
#: when it comes the second time; bits of a table of this size say what has come before.
REMEMBERED, SEEN = 20 << 20, 1 << 22
#: Pieces per call of the tokenizer, joined by a special token.
JOINED = 4096

#: Unicode white space, as the patterns of byte-level tokenizers see it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
RUNS = "[\\t\\n\\x0b\\x0c\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] | $"
#: A control character to cut at (texts that hold it are cut like those with runs), and line feeds next to white space.
_CUT = "\x1f"
_FEEDS = f"[{_SPACE}]\n|\n[{_SPACE}]"

#: Letters that are one code point, stay so under NFC, and are lowered each by itself.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_LATIN = f"^ ?[A-Za-z{_ACCENTED}]+$"
#: Punctuation behind a letter or digit begins a new piece in both kinds.
_TAIL = f"(?s)^(?P<core>.*[A-Za-z0-9{_ACCENTED}])(?P<tail>[!-/:-@\\[-`{{-~]+)$"

_ENCODERS: dict[str, "Encoder"] = {}


def relieve() -> None:
    """Give free memory back to the system at the end of a task: a reused worker idles while others work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):      # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a task per core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        special = [t for t in spec.get("added_tokens") or [] if t["special"] and not (t["lstrip"] or t["rstrip"])]
        if len(special) != len(spec.get("added_tokens") or []) or not special:
            self.kind = "whole"
        self.mark = special[0]["content"] if special else None
        self.mark_id = special[0]["id"] if special else None
        self.marks = "|".join(re.escape(t["content"]) for t in special) or "$.^"
        self.forget()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.space = byte_level.pre_tokenize_str(" ")[0][0]
        self.as_bytes = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in " " + _ACCENTED}
        # words of letters go to the model joined by the byte of a line feed, which none of them holds
        self.split = byte_level.pre_tokenize_str("\n")[0][0]
        self.single = Tokenizer(self.tokenizer.model)
        self.single.pre_tokenizer = pre_tokenizers.Split(self.split, "isolated")
        alone = self.single.encode(self.split, add_special_tokens=False).ids
        self.split_id = alone[0] if len(alone) == 1 else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.kind == "whole":
            return self._whole(texts)
        pieces, owner = self._split(texts)
        encoded = pieces.dictionary_encode()
        index = np.asarray(encoded.indices)
        starts, sizes, flat = self.pieces(encoded.dictionary, np.bincount(index, minlength=len(encoded.dictionary)))
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((starts[index] - (ends - lengths)).astype(np.int32), lengths) + np.arange(total, dtype=np.int32)
        counts = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
        return flat[at], counts

    def _whole(self, texts) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(rows), np.uint32)
        return flat, np.fromiter(map(len, rows), np.int64, len(rows))

    def _split(self, texts) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts in order, and the text each belongs to."""
        if self.kind == "words":
            lists = pc.ascii_split_whitespace(texts)
            return lists.flatten(), np.asarray(pc.list_parent_indices(lists))
        # a space belongs to the piece behind it; a line feed between other things is a piece
        mark = pc.replace_substring(texts, " ", f"{_CUT} ")
        feeds = pc.and_not(pc.match_substring(texts, "\n"), pc.match_substring_regex(texts, _FEEDS))
        lists = pc.split_pattern(pc.if_else(feeds, pc.replace_substring(mark, "\n", f"{_CUT}\n{_CUT}"), mark), _CUT)
        owner, glued = np.asarray(pc.list_parent_indices(lists)), lists.flatten()
        runs = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, f"{RUNS}|{_CUT}")))
        if not len(runs):
            return glued, owner
        # texts with runs of white space are cut before each run instead
        keep = ~np.isin(owner, runs)
        cut = [_PIECES.findall(t) for t in texts.take(pa.array(runs)).to_pylist()]
        more = pa.array(list(itertools.chain.from_iterable(cut)), pa.large_string())
        owner = np.concatenate((owner[keep], np.repeat(runs, [len(x) for x in cut])))
        order = np.argsort(owner, kind="stable")
        return pa.concat_arrays([glued.filter(pa.array(keep)), more]).take(pa.array(order)), owner[order]

    def forget(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ends, self.flat, self.seen = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(SEEN, bool)

    def pieces(self, pieces: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct piece start in an array of ids, how many they are, and that array. ``counts``: how often it comes."""
        if self.words.nbytes + self.ends.nbytes + self.flat.nbytes > REMEMBERED:
            self.forget()
        old = len(self.words)
        at = pc.index_in(pieces, value_set=self.words)
        missing = np.asarray(at.is_null())
        index = np.asarray(at.fill_null(0)).astype(np.int64)
        unknown = pieces.filter(pa.array(missing))
        # a word with a tail of punctuation is put together of the two
        cut = pc.extract_regex(unknown, _TAIL)
        plain = np.asarray(cut.is_null()) | np.asarray(pc.match_substring_regex(unknown, self.marks))
        tailed = cut.filter(pa.array(~plain))
        core, tail = pc.struct_field(tailed, "core"), pc.struct_field(tailed, "tail")
        parts = pa.concat_arrays([unknown.filter(pa.array(plain)), core, tail]).dictionary_encode()
        place = self._place(parts.dictionary)[np.asarray(parts.indices)]
        n, half = int(plain.sum()), len(core)
        at_core, at_tail = place[n:n + half], place[n + half:]
        sizes = np.diff(self.ends)
        both = np.stack((at_core, at_tail), axis=1).ravel()
        ids = self.flat[spans(self.ends[both], sizes[both])]
        own = np.empty(len(unknown), np.int64)
        own[plain], own[~plain] = place[:n], len(self.words) + np.arange(half)
        self._add(unknown.filter(pa.array(~plain)), sizes[at_core] + sizes[at_tail], ids)
        index[missing] = own
        ends, flat = self.ends, self.flat
        often = np.bincount(place, minlength=len(self.words)) + np.bincount(index[missing], weights=counts[missing] - 1, minlength=len(self.words)) > 1
        self._settle(old, often[old:])
        return ends[index], ends[index + 1] - ends[index], flat

    def _settle(self, old: int, often: np.ndarray) -> None:
        """Of what is new since ``old``, remember what came often or has come before."""
        start, sizes = int(self.ends[old]), np.diff(self.ends[old:])
        ids = self.flat[start:].astype(np.uint64)
        nth = np.arange(len(ids)) - np.repeat(self.ends[old:-1] - start, sizes)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(ids + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))))
        bit = mixed(total[self.ends[old + 1:] - start] - total[self.ends[old:-1] - start]) & np.uint64(SEEN - 1)
        keep = often | self.seen[bit]
        self.seen[bit] = True
        new = self.words.slice(old).filter(pa.array(keep))
        kept_ids = self.flat[spans(self.ends[old:-1][keep], sizes[keep])]
        self.words, self.ends, self.flat = self.words.slice(0, old), self.ends[:old + 1], self.flat[:start]
        self._add(new, sizes[keep], kept_ids)

    def _place(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces are remembered; new ones are learned."""
        at = pc.index_in(pieces, value_set=self.words)
        missing = np.asarray(at.is_null())
        index = np.asarray(at.fill_null(0)).astype(np.int64)
        index[missing] = len(self.words) + np.arange(int(missing.sum()))
        new = pieces.filter(pa.array(missing))
        self._add(new, *self._learn(new))
        return index

    def _add(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, ids))

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all ids. One run of Latin letters is a single word for the model, which saves the splitting."""
        spaced = self.kind == "spaced"
        single = np.asarray(pc.match_substring_regex(pieces, _LATIN if spaced else _LATIN.replace(" ?", "", 1)))
        if self.split_id is None:
            single[:] = False
        marked = ~single & np.asarray(pc.match_substring_regex(pieces, self.marks))
        rest = ~single & ~marked
        sizes, blobs = np.zeros(len(pieces), np.int64), []
        words = pieces.filter(pa.array(single)).to_pylist()
        words = [w if w.isascii() else w.translate(self.as_bytes) for w in (words if spaced else map(str.lower, words))]
        asked = [(self.single, self.split, self.split_id, [w.replace(" ", self.space) for w in words], single),
                 (self.tokenizer, self.mark, self.mark_id, pieces.filter(pa.array(rest)).to_pylist(), rest)]
        for tokenizer, mark, mark_id, texts, which in asked:
            found, counts = [], []
            for i in range(0, len(texts), JOINED):
                part = texts[i:i + JOINED]
                ids = np.array(tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == mark_id)
                counts.append(np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)
                found.append(np.delete(ids, cuts))
                if len(counts[-1]) != len(part):
                    raise ValueError("a piece holds the mark that joins pieces")
            sizes[which] = np.concatenate(counts) if counts else 0
            blobs.append(np.concatenate(found) if found else np.zeros(0, np.uint32))
        own = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces.filter(pa.array(marked)).to_pylist()]
        sizes[marked] = list(map(len, own))
        blobs.append(np.fromiter(itertools.chain.from_iterable(own), np.uint32))
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for which, ids in zip((single, rest, marked), blobs):
            out[spans((ends - sizes)[which], sizes[which])] = ids
        return sizes, out


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _kind(spec: dict) -> str:
    """``words``: white space is dropped; ``spaced``: one space is glued to a word; else ``whole``."""
    if (spec.get("model") or {}).get("type") != "BPE":
        return "whole"
    pre, normal = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and normal == "null":
        return "spaced"
    steps = pre.get("pretokenizers") or []
    if (pre.get("type") == "Sequence" and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["invert"]
            and steps[0]["behavior"] == "Removed" and "[^\\s" in json.dumps(steps[0]).replace("\\\\", "\\")
            and not steps[1]["add_prefix_space"] and not steps[1].get("use_regex", True)
            and set(re.findall(r'"type": "(\w+)"', normal)) <= {"Sequence", "NFC", "Replace", "Lowercase"}):
        return "words"
    return "whole"

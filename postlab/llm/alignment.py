"""Alignment of two tokenizers over whole texts, and how many documents hold each pair of linked ids.

Tokenizer A is a byte-level ``tokenizers`` file and reads the text behind one space; B is a ``sentencepiece`` model, which adds that space.
Offsets where tokens of both end cut them into groups; an A and a B token are linked where their bytes overlap. Between two neighbouring
ends of either side lies exactly one link, so links are found by merging the two lists of ends.

The fast path is an array from A id to the B id of the same bytes. A pair on it (all exact one-to-one groups are) is counted in a
vector as long as A's vocabulary; only the other pairs, from irregular groups, are exchanged. Neither tokenizer joins over a
single space, so each distinct word of a chunk (about 8 MB of texts) is encoded, cut into groups and linked once; a document
is the multiset of its words. Texts with runs of white space are words of their own. A chunk sends its distinct irregular pairs with the number
of its documents that hold them to buckets by hash, and gets back the counts of just its own pairs, so a frequent pair costs one entry per chunk.
The driver gets two numbers per A id. Chunks are stored once and move once.

Defined cases: texts that are null, empty, or whose A or B bytes, joined, differ from space and text have no tokens: zeros and no groups; equal
or null keys are documents of their own; extra columns are not kept; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postlab.llm.encoded import slices
from postlab.llm.shingles import mixed
from postlab.llm.store import stored
from postlab.llm.tokens import RUNS, encoder, relieve, spans

CHUNK = 8 << 20
#: Pairs that one bucket of the exchange gets; documents whose groups are written out at once; words per call of B; chunks per file.
ENTRIES, TOGETHER, WORDS, CHUNKS = 2_000_000, 256, 20_000, 1

_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


def aligner(a: str, b: str) -> "Aligner":
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def byte_of() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = encoder(a)
        if self.a.kind != "spaced":
            raise ValueError(f"{a}: not a byte-level tokenizer that keeps spaces")
        self.plain = Tokenizer.from_file(a)
        self.plain.encode_special_tokens = True                 # for words that hold the text of a special token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte, vocabulary = byte_of(), self.plain.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token if c in byte)
        self.b_bytes, same = [], {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        usual = [i for i in range(len(self.b_bytes)) if not (self.b.is_control(i) or self.b.is_unknown(i))]
        for i in sorted(usual, key=lambda i: not self.b.is_byte(i)):
            same[self.b_bytes[i]] = i
        self.same = np.array([same.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # B joins over a space only where a piece has one behind another character
        self.splits = not any(" " in x.lstrip(b" ").decode(errors="replace") for x in self.b_bytes)

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words with the space before them, and the text each belongs to; null and empty texts have none."""
        spaced = pc.binary_join_element_wise(_string(""), texts, _string(" "))
        runs = np.asarray(pc.match_substring_regex(spaced, RUNS)) | (not self.splits)
        real = np.asarray(pc.greater(pc.binary_length(texts), 0))
        cut, whole = np.flatnonzero(real & ~runs), np.flatnonzero(real & runs)
        lists = pc.split_pattern(texts.take(pa.array(cut)), " ")
        parts = lists.flatten()
        glued = pc.binary_join_element_wise(_string(""), parts, _string(" "))
        owner = np.concatenate((cut[np.asarray(pc.list_parent_indices(lists))], whole))
        order = np.argsort(owner, kind="stable")
        return pa.concat_arrays([glued, spaced.take(pa.array(whole))]).take(pa.array(order)), owner[order]

    def ids(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A for all words and how many each has, then those of B."""
        starts, n_a, flat = self.a.pieces(words, counts)
        marked = np.flatnonzero(np.asarray(pc.match_substring_regex(words, self.a.marks)))
        if len(marked):
            starts, n_a = starts.copy(), n_a.copy()
            own = [e.ids for e in self.plain.encode_batch(words.take(pa.array(marked)).to_pylist(), add_special_tokens=False)]
            n_a[marked] = list(map(len, own))
            starts[marked] = len(flat) + np.cumsum(n_a[marked]) - n_a[marked]
            flat = np.concatenate((flat, np.concatenate([np.array(x, np.uint32) for x in own])))
        a = flat[spans(starts, n_a)].astype(np.int64)
        n_b, b = np.zeros(len(words), np.int64), []
        for i in range(0, len(words), WORDS):
            got = self.b.encode([w[1:] for w in words.slice(i, WORDS).to_pylist()], num_threads=1)
            n_b[i:i + WORDS] = list(map(len, got))
            b.append(np.fromiter((x for w in got for x in w), np.int64, int(n_b[i:i + WORDS].sum())))
        return a, n_a, np.concatenate(b) if b else np.zeros(0, np.int64), n_b

    def good(self, words: pa.Array, a, n_a, b, n_b) -> np.ndarray:
        """Words whose bytes both tokenizers give back."""
        want = words.cast(pa.large_binary()).to_pylist()
        whole = b"".join(want)
        ok = np.ones(len(want), bool)
        for ids, n, table in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            got = [table[i] for i in ids.tolist()]
            if b"".join(got) == whole and np.array_equal(
                    np.add.reduceat(np.append([len(x) for x in got], 0), np.minimum(np.cumsum(n) - n, len(got))) * (n > 0), list(map(len, want))):
                continue
            at = 0
            for i, (k, w) in enumerate(zip(n.tolist(), want)):
                ok[i] &= b"".join(got[at:at + k]) == w
                at += k
        return ok


def _string(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _strings(counts: np.ndarray, values: pa.Array, between: str) -> pa.Array:
    """Values joined in runs of these sizes."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64()), values), _string(between))


class Linked:
    """Distinct words of a chunk with their groups and links; words that aren't given back have none."""

    def __init__(self, own: Aligner, words: pa.Array, counts: np.ndarray):
        a, n_a, b, n_b = own.ids(words, counts)
        self.good = own.good(words, a, n_a, b, n_b)
        n = len(words)
        word_a, word_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        a, word_a, b, word_b = a[self.good[word_a]], word_a[self.good[word_a]], b[self.good[word_b]], word_b[self.good[word_b]]
        end_a, end_b = np.cumsum(own.a_len[a]), np.cumsum(own.b_len[b])
        both, either = np.intersect1d(end_a, end_b, assume_unique=True), np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, either), np.searchsorted(end_b, either)
        self.word = word_a[at_a]                                # of each link
        self.a, self.b = a[at_a], b[at_b]
        self.n_a, self.n_b = (np.bincount(w, minlength=n) for w in (word_a, word_b))
        self.n_links = np.bincount(self.word, minlength=n)
        self.n_groups = np.bincount(word_a[np.searchsorted(end_a, both)], minlength=n)
        self.groups = self._written(a, word_a, np.searchsorted(both, end_a), b, np.searchsorted(both, end_b))

    def _written(self, a, word_a, group_a, b, group_b) -> pa.Array:
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        first_a, first_b = (np.diff(g, prepend=-1) > 0 for g in (group_a, group_b))
        new_word = np.diff(word_a, prepend=-1) > 0
        mark = np.concatenate((np.where(new_word, 0, np.where(first_a, 1, 2)), np.where(first_b, 3, 2)))
        marks = pa.array(["", ";", ",", "|"], pa.large_string()).take(pa.array(mark[order]))
        ids = pa.array(np.concatenate((a, b))[order]).cast(pa.large_string())
        return _strings(self.n_a + self.n_b, pc.binary_join_element_wise(marks, ids, _string("")), "")


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, which compress."""
    return np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def _unplanes(x: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


_CHUNK = ("chunk long, n_a binary, n_b binary, n_groups binary, n_links binary, sha256 array<string>, groups array<string>, held binary, words binary, "
          "times binary, links binary, refs binary, pairs binary, documents binary, vector array<long>")


def _chunks(docs: DataFrame, key: str, text: str, a: str, b: str, written: bool) -> DataFrame:
    """A row per chunk: numbers and groups per document, its words, their links, the distinct pairs and how many documents hold
    each; and a row per task with the vector of pairs on the fast path."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, seq = aligner(a, b), TaskContext.get().partitionId(), 0
        vector = np.zeros(len(own.same), np.int64)
        for batch in slices(batches, "text", CHUNK):
            texts = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            words, owner = own.words(texts)
            encoded = words.dictionary_encode()
            n, distinct, index = len(texts), len(encoded.dictionary), np.asarray(encoded.indices).astype(np.int64)
            linked = Linked(own, encoded.dictionary, np.bincount(index, minlength=distinct))
            del words
            alive = np.ones(n, bool)
            alive[owner[~linked.good[index]]] = False
            index, owner = index[alive[owner]], owner[alive[owner]]
            count = lambda per_word: np.bincount(owner, weights=per_word[index], minlength=n).astype(np.int64)  # noqa: E731,B023
            per_doc = np.bincount(owner, minlength=n)
            starts, shas, groups = np.concatenate(([0], np.cumsum(per_doc))), [], []
            for i in range(0, n, TOGETHER):
                own_words = index[starts[i]:starts[min(i + TOGETHER, n)]]
                for x in _strings(per_doc[i:i + TOGETHER], linked.groups.take(pa.array(own_words)), ";").to_pylist():
                    shas.append(hashlib.sha256(x.encode()).hexdigest() if x else "")
                    groups.append(x)
                if not written:
                    groups.clear()
            held, times = np.unique(owner * distinct + index, return_counts=True)
            doc, word = np.divmod(held, max(distinct, 1))
            pairs, refs = np.unique(linked.a << 32 | linked.b, return_inverse=True)
            documents, ends = np.zeros(len(pairs), np.int64), np.searchsorted(doc, np.arange(0, n + TOGETHER, TOGETHER))
            for i, j in zip(ends, ends[1:]):                    # no document lies in two blocks
                if len(pairs):
                    once = np.unique(_expanded(doc[i:j], word[i:j], linked.n_links, refs))
                    documents += np.bincount(once % len(pairs), minlength=len(pairs))
            fast = own.same[pairs >> 32] == pairs & 0xFFFFFFFF
            vector[pairs[fast] >> 32] += documents[fast]
            yield _row(batch["key"], [
                part << 20 | seq, *(_planes(count(getattr(linked, c)), 4) for c in ("n_a", "n_b", "n_groups", "n_links")), shas, groups if written else None,
                _planes(np.bincount(doc, minlength=n), 4), _planes(np.diff(word, prepend=0) & 0xFFFFFFFF, 4), _planes(times, 4),
                _planes(linked.n_links, 4), _planes(refs, 4), _planes(np.diff(pairs, prepend=0), 8), _planes(documents, 4), None])
            seq += 1
            del encoded, linked, index, owner, held, doc, word, times, refs
            relieve()
        yield _row(None, [-1 - part, *[None] * 13, vector.tolist()])

    def _expanded(doc, word, n_links, refs) -> np.ndarray:
        first = np.cumsum(n_links) - n_links
        return np.repeat(doc, n_links[word]) * (int(refs.max()) + 1) + refs[spans(first[word], n_links[word])]

    def _row(keys, values) -> pa.RecordBatch:
        own = pa.array([None], pa.list_(key_type)) if keys is None else pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([own, *(pa.array([v], t) for v, t in zip(values, types))], names)

    source = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = dict(source.dtypes)["key"]
    schema = _schema(f"keys array<{kind}>, {_CHUNK}")
    names, types, key_type = schema.names, schema.types[1:], schema.types[0].value_type
    return source.mapInArrow(made, f"keys array<{kind}>, {_CHUNK}")


def _schema(columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns))


def _irregular(row: dict, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a chunk, ascending, and which of them aren't on the fast path."""
    pairs = np.cumsum(_unplanes(row["pairs"], 8))
    return pairs, same[pairs >> 32] != pairs & 0xFFFFFFFF


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(pairs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _sent(chunks: DataFrame, same: np.ndarray, buckets: int) -> DataFrame:
    """Irregular pairs of each chunk and how many of its documents hold them, by bucket."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, odd = _irregular(row, same)
                pairs, documents = pairs[odd], _unplanes(row["documents"], 4)[odd]
                bucket = _bucket(pairs, buckets)
                own = [(i, np.flatnonzero(bucket == i)) for i in np.unique(bucket).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in own], pa.int32()), pa.array([row["chunk"]] * len(own), pa.int64()),
                     pa.array([_planes(np.diff(pairs[x], prepend=0), 8) for _, x in own], pa.binary()),
                     pa.array([_planes(documents[x], 4) for _, x in own], pa.binary())], ["bucket", "chunk", "pairs", "documents"])

    return chunks.select("chunk", "pairs", "documents").mapInArrow(made, "bucket int, chunk long, pairs binary, documents binary")


def _totals(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    pairs = [np.cumsum(_unplanes(r["pairs"], 8)) for r in rows]
    known, at = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([_unplanes(r["documents"], 4) for r in rows]), minlength=len(known)).astype(np.int64)
    return np.split(total[at], np.cumsum([len(p) for p in pairs])[:-1]), known, total


def _added(bucket: pa.Table) -> pa.Table:
    """Each chunk's pairs with their counts over all chunks; with the first of them, the highest count per A id."""
    rows = bucket.to_pylist()
    own, known, total = _totals(rows)
    ids, first = np.unique(known >> 32, return_index=True)
    tops = np.maximum.reduceat(total, first)
    n = len(rows)
    return pa.table({
        "bucket": bucket["bucket"], "chunk": bucket["chunk"], "counts": pa.array([_planes(x, 8) for x in own], pa.binary()),
        "ids": pa.array([ids.tolist()] + [None] * (n - 1), pa.list_(pa.int64())),
        "tops": pa.array([tops.tolist()] + [None] * (n - 1), pa.list_(pa.int64()))})


@dataclass
class Aligned:
    """``documents``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, where asked for).

    ``pairs()``: a_id, b_id, documents: how many documents hold the two linked, for all pairs.
    """

    documents: DataFrame
    fast: dict[int, int]
    same: np.ndarray
    sent: DataFrame

    def pairs(self) -> DataFrame:
        def made(bucket: pa.Table) -> pa.Table:
            _, known, total = _totals(bucket.to_pylist())
            return pa.table({"a_id": pa.array(known >> 32), "b_id": pa.array(known & 0xFFFFFFFF), "documents": pa.array(total)})

        rows = [(a, int(self.same[a]), n) for a, n in sorted(self.fast.items())]
        columns = "a_id long, b_id long, documents long"
        return self.sent.groupBy("bucket").applyInArrow(made, columns).union(self.documents.sparkSession.createDataFrame(rows, columns))


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> Aligned:
    """Align all whole texts. ``groups`` also gives each document's groups as ``a1,a2|b1;a3|b2,b3``."""
    kind = dict(docs.dtypes)[key]
    every = stored(_chunks(docs, key, text, a, b, groups), "align-chunks", CHUNKS)
    chunks = every.filter("chunk >= 0")
    vector = every.filter("chunk < 0").select(F.posexplode("vector").alias("a", "n")).filter("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    fast = {r.a: r.n for r in vector.collect()}
    same = aligner(a, b).same
    entries = chunks.agg(F.sum(F.length("documents") / 4)).first()[0] or 0
    buckets = max(1, int(entries // ENTRIES))
    sent = _sent(chunks, same, buckets)
    counted = stored(sent.groupBy("bucket").applyInArrow(
        _added, "bucket int, chunk long, counts binary, ids array<long>, tops array<long>"), "align-counts")
    highest = counted.filter("ids is not null").select(F.explode(F.arrays_zip("ids", "tops")).alias("x")).groupBy("x.ids").agg(F.max("x.tops").alias("n"))
    regular = np.zeros(len(same), np.int64)
    regular[list(fast)] = list(fast.values())
    best = regular.copy()
    for r in highest.collect():
        best[r.ids] = max(best[r.ids], r.n)

    def scored(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        out, own = [], counts.to_pylist()
        for row in chunk.to_pylist():
            pairs, odd = _irregular(row, same)
            n = np.where(odd, 0, regular[pairs >> 32])
            irregular, bucket = np.flatnonzero(odd), _bucket(pairs[odd], buckets)
            for r in own:
                n[irregular[bucket == r["bucket"]]] = _unplanes(r["counts"], 8)
            links, refs = _unplanes(row["links"], 4), _unplanes(row["refs"], 4)
            of_word = np.repeat(np.arange(len(links)), links)
            word_sum = np.zeros(len(links), np.int64)
            np.add.at(word_sum, of_word, n[refs])
            word_best = np.bincount(of_word, weights=(n == best[pairs >> 32])[refs], minlength=len(links)).astype(np.int64)
            held, times = _unplanes(row["held"], 4), _unplanes(row["times"], 4)
            word = np.cumsum(_unplanes(row["words"], 4)) & 0xFFFFFFFF
            doc = np.repeat(np.arange(len(held)), held)
            sums, bests = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
            np.add.at(sums, doc, word_sum[word] * times)
            np.add.at(bests, doc, word_best[word] * times)
            columns = {"key": pa.array(row["keys"], key_type)} | {c: pa.array(_unplanes(row[c], 4)) for c in ("n_a", "n_b", "n_groups", "n_links")}
            columns |= {"n_best": pa.array(bests), "count_sum": pa.array(sums), "groups_sha256": pa.array(row["sha256"], pa.string())}
            out.append(pa.table(columns | ({"groups": pa.array(row["groups"], pa.string())} if groups else {})))
        return pa.concat_tables(out) if out else empty.empty_table()

    columns = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (
        ", groups string" if groups else "")
    empty = _schema(columns)
    key_type = empty.types[0]
    needed = chunks.select("keys", "chunk", "n_a", "n_b", "n_groups", "n_links", "sha256", *["groups"] * groups, "held", "words", "times", "links", "refs", "pairs")
    documents = needed.groupBy("chunk").cogroup(counted.select("bucket", "chunk", "counts").groupBy("chunk")).applyInArrow(scored, columns)
    return Aligned(documents.withColumnRenamed("key", key), fast, same, sent)

"""Stupid-backoff language-model scores: n-gram count tables partitioned by hash, joined to the documents' n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mixed

BACKOFF = 0.4
#: A block of documents holds about so many characters, a partition of the count table the n-grams of two blocks.
BLOCK_CHARS = 8_000_000
#: What a document adds to its block besides its characters, so that rows without text fill blocks too.
ROW_CHARS = 32
#: A word that no other document holds counts as so many.
UNSEEN = 0.5

_COUNTED = "bucket int, block long, words binary, n_words binary, pairs binary, n_pairs binary, followers binary, nexts binary, n_nexts binary"
_ANSWERED = "block long, bucket int, total long, words binary, pairs binary, nexts binary"


def _pack(values: np.ndarray) -> bytes:
    """Bytes by place value, compressed."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def _blocks(batches, block_chars: int):
    """(block, ids, texts as UTF-8) of the rows as they come; the block's number tells its place and its content."""
    ids, texts, chars, nth = [], [], 0, 0

    def block():
        seal = xxhash.xxh3_64(f"{TaskContext.get().partitionId()}:{nth}".encode())
        for t in texts:
            seal.update(t)
        return seal.intdigest() >> 1, pa.concat_arrays(ids), texts

    for batch in batches:
        start = 0
        for i, t in enumerate(batch.column(1).to_pylist()):
            texts.append(t.encode("utf-8", "surrogatepass") if t else b"")
            chars += len(texts[-1]) + ROW_CHARS
            if chars >= block_chars:
                ids.append(batch.column(0).slice(start, i + 1 - start))
                yield block()
                ids, texts, chars, nth, start = [], [], 0, nth + 1, i + 1
        ids.append(batch.column(0).slice(start))
    if texts:
        yield block()


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and the place of each value among them."""
    out, at = np.unique(values, return_inverse=True)
    return out, at.astype(np.int32)


class _Grams:
    """The words of a block's documents, end to end, and the distinct words, pairs and triples of words among them.

    A triple is a pair and the word after it: in the sorted triples, those of a pair stand together, each as the
    number of its pair and 32 bits of the next word's hash.
    """

    def __init__(self, texts: list[bytes]):
        seen = WordHashes()
        words = [seen.of(t.lower().split()) for t in texts]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        every = np.concatenate([np.zeros(0, np.uint64), *words])
        self.pair_at = np.nonzero(self.doc[1:] == self.doc[:-1])[0].astype(np.int32)  # place of a pair's first word
        self.triple_at = np.nonzero(self.doc[2:] == self.doc[:-2])[0].astype(np.int32)
        del words
        self.words, self.word_of = _distinct(every)
        pairs = mixed(mixed(every[self.pair_at] + np.uint64(1)) + every[self.pair_at + 1] + np.uint64(2))
        self.pairs, self.pair_of = _distinct(pairs)
        pair_from = np.zeros(len(every), np.int32)
        pair_from[self.pair_at] = self.pair_of
        self.context_of = pair_from[self.triple_at]  # the pair that a triple begins with
        triples = (self.context_of.astype(np.uint64) << np.uint64(32)) | (mixed(every[self.triple_at + 2]) >> np.uint64(32))
        del every, pairs, pair_from
        self.triples, self.triple_of = _distinct(triples)


def _count(block_chars: int, buckets: int):
    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def of_batch(batches):
        """The distinct n-grams of each block by bucket of hashes, with their counts. A triple goes with its pair."""
        for block, _, texts in _blocks(batches, block_chars):
            g = _Grams(texts)
            n_words, n_pairs, n_triples = (np.bincount(x, minlength=len(kinds)).astype(np.uint32) for x, kinds in ((g.word_of, g.words), (g.pair_of, g.pairs), (g.triple_of, g.triples)))
            contexts = (g.triples >> np.uint64(32)).astype(np.int64)
            followers = np.bincount(contexts, minlength=len(g.pairs)).astype(np.uint32)
            word_ends, pair_ends = [0, *np.searchsorted(g.words, cuts), len(g.words)], [0, *np.searchsorted(g.pairs, cuts), len(g.pairs)]
            rows = []
            for bucket in range(buckets):
                w, p = slice(word_ends[bucket], word_ends[bucket + 1]), slice(pair_ends[bucket], pair_ends[bucket + 1])
                t = slice(*np.searchsorted(contexts, [p.start, p.stop]))
                rows.append((bucket, block, _pack_sorted(g.words[w]), _pack(n_words[w]), _pack_sorted(g.pairs[p]), _pack(n_pairs[p]), _pack(followers[p]), _pack(g.triples[t].astype(np.uint32)), _pack(n_triples[t])))
                if len(rows) == 64:
                    yield _batch(rows, _COUNTED)
                    rows = []
            if rows:
                yield _batch(rows, _COUNTED)

    return of_batch


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Number of each key among the distinct ones, and the packed totals of each list of keys."""
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(at, np.concatenate(counts)).astype(np.uint64)[at]
    ends = np.cumsum([0] + [len(k) for k in keys])
    return at, [_pack(totals[lo:hi]) for lo, hi in zip(ends, ends[1:])]


def _total(part: pa.Table) -> pa.Table:
    """One partition of the count table: sums over all blocks, given back to each block in the order of its hashes."""
    column = lambda name, read: [read(x) for x in part.column(name).to_pylist()]
    n_words = column("n_words", lambda x: _unpack(x, np.uint32))
    _, words = _sums(column("words", _unpack_sorted), n_words)
    pair_at, pairs = _sums(column("pairs", _unpack_sorted), column("n_pairs", lambda x: _unpack(x, np.uint32)))
    followers = np.concatenate(column("followers", lambda x: _unpack(x, np.uint32)))
    context, at, keys = np.repeat(pair_at, followers).astype(np.uint64) << np.uint64(32), 0, []
    for after in column("nexts", lambda x: _unpack(x, np.uint32)):
        keys.append(context[at : at + len(after)] | after)
        at += len(after)
    _, nexts = _sums(keys, column("n_nexts", lambda x: _unpack(x, np.uint32)))
    total = int(sum(int(n.sum()) for n in n_words))
    rows = list(zip(part.column("block").to_pylist(), part.column("bucket").to_pylist(), [total] * len(words), words, pairs, nexts))
    return pa.Table.from_batches([_batch(rows, _ANSWERED)])


def _others(at: np.ndarray, doc: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How often other documents hold each n-gram. at: its number among the block's distinct ones, doc: its document."""
    _, own, times = np.unique(doc.astype(np.int64) * len(totals) + at, return_inverse=True, return_counts=True)
    return (totals[at].astype(np.int64) - times[own]).astype(np.float64)


def _packed_texts(block_chars: int):
    def of_batch(batches):
        """A row a block: its ids, and its texts end to end, compressed."""
        for block, ids, texts in _blocks(batches, block_chars):
            lengths, raw = pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), b"".join(texts)
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([block]), ids, lengths, pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], ["block", "ids", "lengths", "texts"])

    return of_batch


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Log scores of the documents of a block."""
    ids, lengths = docs.column("ids").combine_chunks().flatten(), np.array(docs.column("lengths")[0].as_py(), np.int64)
    raw = pa.decompress(docs.column("texts")[0].as_py(), int(lengths.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum([0, *lengths])
    g = _Grams([raw[lo:hi] for lo, hi in zip(ends, ends[1:])])
    if docs.num_rows != 1 or not answers.num_rows:
        raise RuntimeError("a block of documents was counted with other rows than it is scored with: the input changes between reads")
    answers = answers.sort_by("bucket")
    totals = lambda name: np.concatenate([_unpack(x, np.uint64) for x in answers.column(name).to_pylist()])
    total = sum(answers.column("total").to_pylist())
    one = _others(g.word_of, g.doc, totals("words"))
    two = _others(g.pair_of, g.doc[g.pair_at], totals("pairs"))
    three = _others(g.triple_of, g.doc[g.triple_at], totals("nexts"))
    score = np.maximum(one, UNSEEN) / np.maximum(1, total - g.sizes[g.doc])
    _back_off(score, g.pair_at + 1, two, one[g.pair_at])
    pair_from = np.zeros(len(score))
    pair_from[g.pair_at] = two
    _back_off(score, g.triple_at + 2, three, pair_from[g.triple_at])
    logs = np.bincount(g.doc, np.log(score), len(lengths))
    return pa.table({"doc_id": ids, "n_words": g.sizes, "log_score": logs})


def _back_off(score: np.ndarray, at: np.ndarray, count: np.ndarray, context: np.ndarray) -> None:
    """Where the longer n-gram that ends at a place was seen, its share of its context; else BACKOFF times the score so far."""
    seen = count > 0
    score[at] = np.where(seen, count / np.where(seen, context, 1), BACKOFF * score[at])


def scores(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, log_score) of each row of docs under the trigram counts of all other rows.

    The score of a word is its count after the two words before it by the count of these, in the other
    documents; if they never hold it, BACKOFF times the score after one word, and then after none, by its share
    of all their words. log_score sums the natural logarithms.

    Rows form blocks in the order of the scan. A block's distinct words, pairs and triples of words go, sorted and
    packed, to the partitions of the count table by hash, a triple with its pair; the partition answers each block
    with its totals, and the block's texts, moved once and compressed, are scored. So a frequent n-gram is one
    entry a block, alike rows spread like others, and what moves grows with the text. There is one row for a block
    and partition; at corpora of many terabytes block_chars goes up with the executors' memory, so that a row
    stays kilobytes. Every step is a shuffle of one plan, so a lost executor costs only its part; a block carries
    a seal of its content, and input that reads differently the second time fails instead of giving other scores.

    Words are runs of anything but ASCII white space, A-Z in lower case. Null, empty and wordless texts have no
    words and log_score 0. Repeated rows count as other documents. Rows with a null doc_id are scored like others. Other columns are ignored; an empty table gives an empty result.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, chars // (2 * block_chars))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    texts = rows.mapInArrow(_packed_texts(block_chars), f"block long, ids array<{kind}>, lengths array<long>, texts binary")
    counted = rows.mapInArrow(_count(block_chars, buckets), _COUNTED)
    answered = counted.groupBy("bucket").applyInArrow(_total, _ANSWERED)
    return texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score, f"doc_id {kind}, n_words long, log_score double")

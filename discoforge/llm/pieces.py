"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is cut where no piece can span the cut, and in each part adjacent symbols merge by an agenda: of all
adjacent pairs that form a piece, the one with the highest score goes first, the leftmost of equal ones.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as SentencePiece writes it in pieces.
MARK = "▁"
PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Parts up to this length are kept with their ids: so many of late, and as many from before.
SHORT_CHARS, PARTS_KEPT = 40, 500_000


class DifferentIds(ValueError):
    """The library encodes a text in another way: the model isn't a merge-type vocabulary without symbols of its own."""


class Kept(dict):
    """Ids of parts, worked out when first asked for. Full, it becomes the older half, so frequent parts stay."""

    def __init__(self, ids_of):
        self.ids_of, self.older = ids_of, {}
        self.fresh: list[tuple[str, tuple[int, ...]]] = []  # worked out since the last check

    def __missing__(self, part: str) -> tuple[int, ...]:
        got = self.older.get(part)
        if got is None:
            got = tuple(self.ids_of(part))
            self.fresh.append((part, got))
        if len(part) <= SHORT_CHARS:
            if len(self) >= PARTS_KEPT:
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got


class Agenda:
    """Ids of texts by a vocabulary of scored pieces. Picklable by its model's bytes only; tasks build their own."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        falling = {x: n for n, x in enumerate(sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True))}
        #: Place of each piece by falling score; equal scores share one.
        self.ranks = {p: falling[lib.get_score(i)] for p, i in self.ids.items()}
        self.decimals = [str(i) for i in range(size)]
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = lib.unk_id()
        self.has_bytes = all(lib.is_byte(i) for i in self.bytes)
        #: A cut before a mark is safe if no piece holds a mark behind another character.
        self.cuts = not any(p[n] == MARK and p[n - 1] != MARK for p in self.ids for n in range(1, len(p)))
        self.kept = Kept(self.ids_of)

    def merged(self, part: str) -> list[str]:
        """The symbols that a part ends up with."""
        return self._merged_short(list(part)) if len(part) <= SHORT_CHARS else self._merged_long(list(part))

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list beside the symbols: the least rank of a pair is found by a scan, which is quicker while there are few."""
        rank, none = self.ranks.get, len(self.ids)
        agenda = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            whole = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(whole + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + whole, none)
        return symbols

    def _merged_long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, the symbols as a linked list: n log n for a part of any length."""
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        agenda = []

        def propose(left: int, right: int) -> None:
            found = self.ranks.get(symbols[left] + symbols[right])
            if found is not None:
                heapq.heappush(agenda, (found, left, right, len(symbols[left]) + len(symbols[right])))

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has merged with another meanwhile
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
                propose(left, after[left])
            if before[left] >= 0:
                propose(before[left], left)
        return [s for s in symbols if s]

    def ids_of(self, part: str) -> list[int]:
        out = []
        for symbol in self.merged(part):
            found = self.ids.get(symbol)
            if found is not None:
                out.append(found)
            elif self.has_bytes:
                out.extend(self.bytes[b] for b in symbol.encode("utf-8"))
            elif not out or out[-1] != self.unknown:  # neighbours without a piece are one unknown
                out.append(self.unknown)
        return out

    def parts(self, text: str) -> list[str]:
        """Runs of marks with what follows them, by the library's normal form of a text."""
        normal = self.library.normalize(text)
        return PART.findall(normal) if self.cuts else [normal] if normal else []

    def encode(self, text: str) -> list[int]:
        """Ids of a text."""
        return list(chain.from_iterable(map(self.kept.__getitem__, self.parts(text))))


    def check(self, whole: str = "") -> None:
        """Hold all parts worked out since the last check, and one whole text, against the library."""
        parts, self.kept.fresh = [x for x in self.kept.fresh if x[0] != MARK], []  # no text is a lone mark, a space at an end is
        texts = [part.removeprefix(MARK).replace(MARK, " ") for part, _ in parts]  # the library puts a mark in front
        if self.library.normalize(" x") != f"{MARK}{MARK}x":
            raise DifferentIds("the model doesn't put one mark in front of every text and keep all white space")
        for (part, own), ids in zip(parts, self.library.encode(texts, num_threads=1) if texts else ()):
            if list(own) != ids:
                raise DifferentIds(f"a part of {len(part)} characters is encoded in another way by the library")
        if whole and self.encode(whole) != self.library.encode(whole, num_threads=1):
            raise DifferentIds(f"a text of {len(whole)} characters is encoded in another way by the library")


@lru_cache(maxsize=2)
def _agenda(model: bytes) -> Agenda:
    return Agenda(model)


def _decoded_text(value) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def _encoded(model):
    def of_batches(batches):
        agenda = _agenda(model.value)
        for b in batches:
            rows = []
            for value in b.column(1):  # one text at a time: long ones don't add up
                ids = agenda.encode(_decoded_text(value))
                decoded = agenda.library.decode(ids, num_threads=1)
                rows.append((len(ids), hashlib.sha256(",".join(map(agenda.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
            agenda.check(next(map(_decoded_text, b.column(1)), ""))
            counts, of_ids, of_texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return of_batches


def _ids(model):
    def of_batches(batches):
        agenda = _agenda(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                ids = [agenda.encode(_decoded_text(v)) for v in part.column(1)]
                agenda.check(_decoded_text(part.column(1)[0]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return of_batches


def _texts(model):
    def of_batches(batches):
        library = _agenda(model.value).library
        for b in batches:
            texts = [None if ids is None else library.decode(ids, num_threads=1) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return of_batches


def _shared(docs: DataFrame, path: str):
    """The model's bytes as a broadcast: a vocabulary file, some hundred kilobytes whatever the input. Only the driver needs the file."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row by the model at path; a null text is empty and has no ids.

    Without begin and end ids and without sampling. In every Arrow batch each part worked out anew, and one whole
    text, is checked against the sentencepiece library; a difference raises DifferentIds, which models of another
    kind do (unigram, words, symbols of the user).
    Repeated and id-less rows are rows like others, texts of any length are encoded whole, other columns are
    ignored, and an empty table gives an empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_ids(_shared(docs, path)), f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text, no ids an empty one."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(_texts(_shared(rows, path)), f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encode and decode in one pass, ids don't leave the task.

    Nulls, empty and long texts, repeated rows and other columns as for encode.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_encoded(_shared(docs, path)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found

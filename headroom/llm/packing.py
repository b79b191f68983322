"""Packing of documents into sequences by dynamic programming over cuts.

Documents of a task keep their order and form one stream of tokens. A sequence is a window of the
stream; windows may be cut after a document (free), after a sentence, or inside a long
sentence (dearer). The cost of a window is its padding plus the price of the cut that ends it. As padding is
linear in the place where a window begins, the best predecessor of a cut is the least value of a
sliding window, which a monotone queue keeps at constant cost. Windows whose length is a power of two need
no padding and are tried as well.

The stream is cut in blocks of bounded size; the last windows of a block are decided again with the next.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from headroom.llm.common import batches_of

LENGTH = 4096
END = 2  # follows the tokens of every document
SENTENCE_CUT, WORD_CUT, SHORT = 8, 48, 64  # prices, in tokens of padding
GRID = 128  # a sentence may be cut at these steps from its beginning
LEAST_SHORT = 256  # shorter powers of two are not tried
BLOCK_TOKENS = 1_000_000
_AGAIN = 8  # windows decided again with the next block
_TEXT_BYTES = 1 << 21
_WORDS_KEPT = 600_000
_IDS_TOGETHER = 1 << 14  # words whose ids are taken at once: their arrays stay small
_SEGMENT = 1 << 22
_END_WORD = b" "  # no word of a text


def _class(test) -> str:
    """Characters up to U+00FF of a kind, for use inside brackets."""
    return "".join(f"\\x{i:02x}" for i in range(256) if test(chr(i)))


_LETTERS = _class(lambda c: unicodedata.category(c)[0] == "L")
_NUMBERS = _class(lambda c: unicodedata.category(c)[0] == "N")
_SPACES = r"\t\n\x0b\x0c\r\x20\x85\xa0"
#: How the vocabulary cuts a text: letters, single numbers, English endings, runs of other signs.
_PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACES}{_LETTERS}{_NUMBERS}]+".encode("latin-1"))
#: How the vocabulary's model writes the bytes of a character.
_SIGNS = {i: pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0] for i in range(256) if i != 32}
_LOWER = bytes(ord(chr(i).lower()) for i in range(256))
_CHUNK = re.compile(r"[^\x20\x09-\x0d]+")


def _cut(text: str) -> list[bytes | str]:
    """What the vocabulary encodes on its own: pieces in Latin-1, whole chunks between blanks where that is not enough.

    Up to U+00FF case and composition are settled per character, so the cut is a pattern over bytes.
    Chunks with other characters, or with what could be a special string, are left to the library.
    """
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        data = None
    if data is not None and b"<|" not in data:
        return _PIECES.findall(data.translate(_LOWER))
    out: list[bytes | str] = []
    for chunk in _CHUNK.findall(text):
        try:
            out += [chunk] if "<|" in chunk else _PIECES.findall(chunk.encode("latin-1").translate(_LOWER))
        except UnicodeEncodeError:
            out.append(chunk)
    return out


class _Numbers(dict):
    """Pieces by number; one that is asked for the first time gets the next."""

    def __missing__(self, piece: bytes | str) -> int:
        number = self[piece] = len(self)
        return number


class Words:
    """Token ids of texts by way of their pieces, each encoded once until the table is full and starts anew."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        names = self.tokenizer.get_vocab()
        ends = [i for name, i in names.items() if name.endswith("</w>") and name[:-4] and name[-5] in ".!?"]
        self.ends_sentence = np.zeros(max(names.values()) + 1, bool)
        self.ends_sentence[ends] = True
        self._clear()

    def _clear(self) -> None:
        self.number = _Numbers({_END_WORD: 0})
        self.pool, self.used, self.known = np.full(1 << 20, END, np.uint32), 1, 1
        self.starts, self.sizes = np.zeros(_WORDS_KEPT, np.int64), np.zeros(_WORDS_KEPT, np.int32)
        self.sizes[0] = 1

    def _learn(self, new: list[bytes | str]) -> None:
        """Pieces go to the model as they are; normalizer and patterns of the library would leave them unchanged."""
        pieces, chunks = [w for w in new if isinstance(w, bytes)], [w for w in new if isinstance(w, str)]
        tokenize, ids, sizes = self.tokenizer.model.tokenize, [], []
        for piece in b" ".join(pieces).decode("latin-1").translate(_SIGNS).split(" ") if pieces else ():
            found = tokenize(piece)
            ids += [token.id for token in found]
            sizes.append(len(found))
        for found in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
            ids += found.ids
            sizes.append(len(found))
        ids, size = np.array(ids, np.uint32), np.array(sizes)
        count, need = self.known + len(size), self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(need, np.uint32)])
        if count > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(count, x.dtype)]) for x in (self.starts, self.sizes))
        at = np.fromiter(map(self.number.__getitem__, [*pieces, *chunks]), np.int64, len(size))
        self.pool[self.used : need] = ids
        self.sizes[at] = size
        self.starts[at] = self.used + np.cumsum(size) - size
        self.known, self.used = count, need

    def _look_up(self, words: list[bytes | str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each word has."""
        if self.known >= _WORDS_KEPT:
            self._clear()
        at = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        if len(self.number) > self.known:
            self._learn(list(islice(self.number, self.known, None)))
        size, found = self.sizes[at], []
        for begin in range(0, len(at), _IDS_TOGETHER):
            own = size[begin : begin + _IDS_TOGETHER]
            total = np.cumsum(own)
            place = np.repeat(self.starts[at[begin : begin + _IDS_TOGETHER]] - total + own, own)
            place += np.arange(total[-1])
            found.append(self.pool[place])
        return np.concatenate(found), size

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text with the end mark; a null text is empty. Long texts are taken in segments."""
        if len(texts) == 1 and len(texts[0] or "") > _SEGMENT:
            text, found, begin = texts[0], [], 0
            while begin < len(text):
                cut = len(text)
                if cut - begin > _SEGMENT:
                    cut = max(text.rfind(blank, begin, begin + _SEGMENT) for blank in (" ", "\n"))
                    cut = cut if cut > begin else len(text)
                found.append(self._look_up([*_cut(text[begin:cut]), _END_WORD])[0][:-1])
                begin = cut
            return [np.concatenate([*found, np.array([END], np.uint32)])]
        words, ends = [], []
        for text in texts:
            words += _cut(text or "")
            words.append(_END_WORD)
            ends.append(len(words))
        ids, sizes = self._look_up(words)
        return np.split(ids, np.cumsum(sizes)[np.array(ends) - 1][:-1])


def _candidates(docs: list[np.ndarray], ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stream where a window may end, and the price of each, in order."""
    sizes = np.array([len(d) for d in docs])
    doc_ends = np.cumsum(sizes)
    stream = np.concatenate(docs)
    places = np.unique(np.concatenate([np.flatnonzero(ends_sentence[stream]) + 1, doc_ends]))
    gaps = np.diff(np.r_[0, places])
    steps = (gaps - 1) // GRID
    begins = np.repeat(places - gaps, steps)
    nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    inside = begins + nth * GRID
    prices = np.full(len(places), SENTENCE_CUT)
    prices[np.searchsorted(places, doc_ends)] = 0
    places, prices = np.r_[places, inside], np.r_[prices, np.full(len(inside), WORD_CUT)]
    order = np.argsort(places, kind="stable")
    return places[order], prices[order]


def cuts(places: np.ndarray, prices: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows of the cheapest cover of the stream up to its last place.

    Gaps between places are at most ``GRID``, so every place has a predecessor.
    """
    short = {}
    size = length // 2
    while size >= min(LEAST_SHORT, length // 2) and size > 0:
        at = np.searchsorted(places, places - size)
        hit = (places > size) & (places[np.minimum(at, len(places) - 1)] == places - size)
        for j in np.flatnonzero(hit):
            short.setdefault(int(j), []).append(int(at[j]))
        for j in np.flatnonzero(places == size):
            short.setdefault(int(j), []).append(-1)
        size //= 2
    where, price = places.tolist(), prices.tolist()
    best, came = [0] * len(where), [-1] * len(where)
    queue = deque([(0, 0, -1)])  # value of a beginning, its place, its number
    for j, (here, dear) in enumerate(zip(where, price)):
        while queue[0][1] < here - length:
            queue.popleft()
        value, _, chosen = queue[0]
        value += length - here
        for i in short.get(j, ()):
            other = SHORT + (best[i] if i >= 0 else 0)
            if other < value:
                value, chosen = other, i
        value += dear
        best[j], came[j] = value, chosen
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, j))
    ends, j = [], len(where) - 1
    while j >= 0:
        ends.append(where[j])
        j = came[j]
    return ends[::-1]


class _Packer:
    """The stream of one task: documents wait until their windows are settled."""

    def __init__(self, ends_sentence: np.ndarray, first_sequence: int):
        self.ends_sentence, self.sequence = ends_sentence, first_sequence
        self.waiting: list[list] = []  # doc_id, ids not yet placed, ids before those, all ids
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.waiting.append([doc_id, ids, 0, len(ids)])
        self.tokens += len(ids)

    def release(self, last: bool) -> list[tuple]:
        """Pieces of all windows, without the last few if more of the stream is to come."""
        ends = cuts(*_candidates([w[1] for w in self.waiting], self.ends_sentence)) if self.waiting else []
        if not last:
            ends = ends[:-_AGAIN]
        pieces, begin, doc = [], 0, 0
        for end in ends:
            offset = 0
            while begin + offset < end:
                name, ids, before, all_ids = self.waiting[doc]
                size = min(len(ids), end - begin - offset)
                own = ids[:size]
                pieces.append((name, before, size, zlib.crc32(own.astype("<u4").tobytes()), all_ids, self.sequence, offset, own))
                offset += size
                if size == len(ids):
                    doc += 1
                else:
                    self.waiting[doc] = [name, ids[size:], before + size, all_ids]
            begin = end
            self.sequence += 1
        self.waiting = self.waiting[doc:]
        self.tokens -= begin
        return pieces


_PIECE = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, vocabulary: str, with_ids: bool = False, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece, and ``ids`` on request.

    ``vocabulary`` is the text of a tokenizer file. Documents stay in the order of their task and
    are never shuffled; a null text has the end mark only. Rows are told apart by their place, so repeated and
    null ids are documents of their own. Sequence numbers are unique: the task's number and a count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        packer = _Packer(words.ends_sentence, TaskContext.get().partitionId() << 32)
        kinds = None

        def out(pieces: list) -> pa.RecordBatch:
            columns = list(zip(*pieces)) if pieces else [()] * 8
            arrays = [pa.array(columns[0], kinds)] + [pa.array(c, pa.int64()) for c in columns[1:7]]
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.uint32())).cast(pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", *_PIECE, *["ids"] * with_ids])

        for batch in batches:
            kinds = batch.schema.field("doc_id").type
            for part in batches_of(batch, "text", _TEXT_BYTES):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.ids(part.column("text").to_pylist())):
                    packer.add(doc_id, ids)
                if packer.tokens >= block_tokens:
                    yield out(packer.release(last=False))
        if kinds is not None:
            yield out(packer.release(last=True))

    fields = ", ".join(f"`{c}` bigint" for c in _PIECE) + ", ids array<bigint>" * with_ids
    return rows.mapInArrow(pack_task, f"doc_id {kind}, {fields}")


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()

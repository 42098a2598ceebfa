"""Vector bin packing of token sequences.

Each task cuts its documents into pieces: runs that fill a whole sequence stand alone, what is left over is packed. An
item has a vector (tokens, segments, loss-bearing tokens); a bin has a limit of its own for each. The dot-product
heuristic fills one bin at a time with the item whose vector has the largest dot product with what is still free. Pieces
of the emptiest bins are then cut to fill the others as far as every limit allows, and the last bins of a task are cut
into powers of two, which need no padding.

A document's first tokens (its prompt, for instruction data) bear no loss, its others do.

Everything stays in the task that reads a document: no shuffle, and at most `window` open items in memory.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Bound of the words whose ids a Python worker keeps, but for those of one round of texts.
WORDS_KEPT = 200_000
#: Those that stay beyond it, and when a task is done: the first ones met, which hold the frequent ones. A worker, with its
#: table, outlives the query.
WORDS_STAY = 100_000
#: Words of which regular expression engines agree what is a letter, a number or white space, and whose lower case is the
#: same one by one.
SIMPLE = r"\A[\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]+\z"
#: Pre-tokens that are encoded together, and texts or words in one call.
TOGETHER, CALL = 256, 4096
#: Bytes of Arrow batches whose texts are looked up together: a word is met once for each.
ROUND_BYTES = 2 << 20


def listed(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Consecutive ids as lists that end at `ends`."""
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids, pa.uint32()))


class WordIds:
    """Ids of texts as little-endian bytes, by a tokenizer whose pre-tokens never hold a space or a line feed.

    The different words of many texts are found by Arrow. They are cut into pre-tokens by the tokenizer's own pattern, and
    new pre-tokens are encoded many at a time, with spaces between them; as each ends in one token with the end-of-word
    mark, the ids come apart again. As they are cut and in lower case already, they go to the tokenizer's model alone.
    Whether a tokenizer is of this kind is asked of it on load, with every character of such words; others encode word by
    word, or text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        probe = "One two\nthree  4!"
        self.by_word = ids(probe) == [i for w in probe.replace("\n", " ").split(" ") for i in ids(w)]
        self.pattern, self.ends, self.model = self._splitter() if self.by_word and ids("\u00c0B c.") == ids("\u00e0b c.") else (None, None, None)
        if self.pattern:
            every = [chr(c) for c in range(0x21, 0x250) if not 0x7F <= c <= 0xA0]
            odd = ["it's 1st,ab.c'd -- \u00e9t\u00e9's n'ayant x2y (z) ' 't", *(f"{c} {c}{c} a{c}b 1{c}2 .{c}, {c}'{c}" for c in every)]
            if self.ids(odd) != [np.array(ids(x), "<u4").tobytes() for x in odd]:
                self.pattern = None
            self._clear()

    def _clear(self) -> None:
        self.words, self.found = pa.array([""]), pa.array([[]], pa.list_(pa.uint32()))

    def _splitter(self) -> tuple:
        """The pattern that cuts words into pre-tokens, which ids end one, and a tokenizer of the same model that
        cuts at spaces; three times None if there is no such pattern."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        spec = json.loads(self.tokenizer.to_str())
        pre, suffix = spec.get("pre_tokenizer") or {}, spec["model"].get("end_of_word_suffix")
        steps = pre.get("pretokenizers", [pre])
        splits = [x for x in steps if x.get("type") == "Split" and x.get("invert") and x.get("behavior") == "Removed" and "Regex" in x.get("pattern", {})]
        if not suffix or len(splits) != 1 or any(x.get("type") not in ("Split", "ByteLevel") for x in steps):
            return None, None, None
        pattern = splits[0]["pattern"]["Regex"]
        try:
            pc.match_substring_regex(pa.array(["a"]), pattern)
        except pa.ArrowInvalid:  # not a pattern of Arrow's
            return None, None, None
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith(suffix)
        model = Tokenizer(self.tokenizer.model)  # the same one, in memory as well
        model.pre_tokenizer = Sequence([WhitespaceSplit(), *(ByteLevel(x["add_prefix_space"], use_regex=x["use_regex"]) for x in steps if x["type"] == "ByteLevel")])
        return pattern, ends, model

    def _encoded_parts(self, parts: pa.StringArray) -> pa.ListArray | None:
        """The ids of each pre-token; None if they do not come apart."""
        if not len(parts):
            return self.found[:0]
        firsts = np.append(np.arange(0, len(parts), TOGETHER), len(parts)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(firsts, parts), " ").to_pylist()
        ids = [np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(joined, add_special_tokens=False)]
        last = [self.ends[x] for x in ids]
        if [np.count_nonzero(x) for x in last] != np.diff(firsts).tolist() or not all(x[-1] for x in last):
            return None
        return listed(np.concatenate(ids), np.flatnonzero(np.concatenate(last)) + 1)

    def _simple(self, words: pa.StringArray) -> pa.BooleanArray:
        return pc.and_not(pc.match_substring_regex(words, SIMPLE), pc.match_substring(words, "<|"))

    def _keep(self, words: pa.StringArray, found: pa.ListArray) -> None:
        self.words, self.found = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.found, found])

    def learn(self, words: pa.StringArray) -> None:
        """Puts new words into the table, each given once, and their pre-tokens, which are words as well."""
        if self.pattern:
            simple = self._simple(words)
            letters = pc.and_(simple, pc.utf8_is_alpha(words))  # each is one pre-token
            mixed = words.filter(pc.and_not(simple, letters))
            cut = pc.split_pattern(pc.ascii_rtrim(pc.replace_substring_regex(mixed, self.pattern, r"\0 "), " "), " ")
            parts = pa.concat_arrays([words.filter(letters), cut.flatten()]).unique()
            parts = parts.filter(pc.index_in(parts, self.words).is_null())
            found = self._encoded_parts(parts)
            if found is not None:
                self._keep(parts, found)
                got = self.found.take(pc.index_in(cut.flatten(), self.words))
                whole = listed(got.flatten().to_numpy(), got.offsets.to_numpy()[cut.offsets.to_numpy()[1:]])
                new = pc.index_in(mixed, parts).is_null()
                self._keep(mixed.filter(new), whole.filter(new))
                words = words.filter(pc.invert(simple))
        for i in range(0, len(words), CALL):  # offsets are not needed, which the fast call leaves out
            own = words[i : i + CALL]
            self._keep(own, pa.array([e.ids for e in self.tokenizer.encode_batch_fast(own.to_pylist(), add_special_tokens=False)], self.found.type))

    def forget(self) -> None:
        """Leaves the first WORDS_STAY words in the table."""
        if len(self.words) > WORDS_STAY:  # taken, as a slice would hold the whole table
            stay = pa.array(np.arange(WORDS_STAY))
            self.words, self.found = self.words.take(stay), self.found.take(stay)

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        own = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = own.flatten().dictionary_encode()
        words = coded.dictionary
        if self.pattern:  # in lower case there are fewer
            words = pc.if_else(self._simple(words), pc.utf8_lower(words), words)
        if len(self.words) > WORDS_KEPT:
            self.forget()
        at = pc.index_in(words, self.words)
        if at.null_count:
            self.learn(words.filter(at.is_null()).unique())
            at = pc.index_in(words, self.words)
        got = self.found.take(at.take(coded.indices))
        data, ends = got.flatten().to_numpy().astype("<u4").tobytes(), 4 * got.offsets.to_numpy().astype(np.int64)[own.offsets.to_numpy()]
        return [data[a:b] for a, b in pairwise(ends.tolist())]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@dataclass
class Piece:
    """Some of a document's ids. Those before `prompt` (counted from the document's begin) bear no loss."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int
    prompt: int = 1

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return min(self.length, max(0, self.start + self.length - self.prompt))

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens, self.prompt), Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens, self.prompt))

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of the first tokens fit what is free of both limits."""
        return min(self.length, tokens, max(0, self.prompt - self.start) + loss)


@dataclass
class Limits:
    tokens: int
    segments: int
    loss: int

    def free(self, own: list[Piece]) -> tuple[int, int, int]:
        return self.tokens - sum(p.length for p in own), self.segments - len(own), self.loss - sum(p.loss for p in own)


def place(vectors: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins of item numbers by the dot-product heuristic; each item alone must fit the limits."""
    demand = vectors / limits
    order = np.lexsort((np.arange(len(demand)), -demand.max(axis=1)))
    rest, bins = demand[order], []
    while len(order):
        own, free = [int(order[0])], 1 - rest[0]
        left = np.ones(len(order), bool)
        left[0] = False
        at = np.flatnonzero((rest <= free + 1e-12).all(axis=1) & left)
        while len(at):
            best = at[np.argmax(rest[at] @ free)]
            left[best] = False
            own.append(int(order[best]))
            free = free - rest[best]
            at = at[left[at] & (rest[at] <= free + 1e-12).all(axis=1)]
        bins.append(own)
        order, rest = order[left], rest[left]
    return bins


def filled(bins: list[list[Piece]], limits: Limits) -> tuple[list[list[Piece]], list[Piece]]:
    """Cuts the pieces of the emptiest bins to fill the others; gives the bins that no piece at hand can add to, and the
    pieces that are over."""
    rest = sorted(bins, key=lambda b: -sum(p.length for p in b))
    done: list[list[Piece]] = []
    loose: list[Piece] = []
    first = 0
    while first < len(rest):
        own = rest[first]
        first += 1
        tokens, segments, loss = limits.free(own)
        passed: list[Piece] = []
        while tokens and segments:
            if not loose and loss and first < len(rest):
                loose = rest.pop()
            if not loose:
                break
            piece = loose.pop()
            n = piece.fitting(tokens, loss)
            if not n:  # no loss-bearing token is free: only what is left of a prompt fits
                passed.append(piece)
                continue
            if n < piece.length:
                piece, over = piece.cut(n)
                loose.append(over)
            own.append(piece)
            tokens, segments, loss = tokens - n, segments - 1, loss - piece.loss
        loose += passed
        if tokens and segments and first >= len(rest):
            return done, own + loose
        done.append(own)
    return done, loose


def in_powers(pieces: list[Piece], limits: Limits) -> list[list[Piece]]:
    """Sequences within the limits whose lengths are powers of two of at most limits.tokens, the longest first."""
    queue, out = sorted(pieces, key=lambda p: p.length), []
    while queue:
        own: list[Piece] = []
        passed: list[Piece] = []
        tokens, segments, loss = limits.free(own)
        while queue and tokens and segments:
            piece = queue.pop()
            n = piece.fitting(tokens, loss)
            if n:
                piece, over = piece.cut(n)
                own.append(piece)
                tokens, segments, loss = tokens - n, segments - 1, loss - piece.loss
                if over.length:
                    passed.append(over)
            else:
                passed.append(piece)
        too_many = (limits.tokens - tokens) - (1 << (limits.tokens - tokens).bit_length() - 1)
        if tokens:
            while too_many:  # the last ones wait for another sequence
                piece = own.pop()
                keep, over = piece.cut(max(0, piece.length - too_many))
                too_many -= over.length
                passed.append(over)
                if keep.length:
                    own.append(keep)
        out.append(own)
        queue = sorted(queue + passed, key=lambda p: p.length)
    return out


def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of consecutive batches of ROUND_BYTES together, at least; null texts are empty ones."""
    own: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            own.append(batch)
        if own and (batch is None or sum(b.nbytes for b in own) >= ROUND_BYTES):
            ids, *texts = (pa.concat_arrays(x) for x in zip(*(b.columns for b in own), strict=True))
            yield [ids, *(x.cast(pa.string()).fill_null("") for x in texts)]
            own = []


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, segments: int = 512, loss: int | None = None, end_id: int = 1, window: int = 1024, prompt: str | None = None) -> DataFrame:
    """Pieces of the documents' ids (with end_id after each document) and their places in sequences.

    Columns: see SCHEMA. Null and empty texts are one piece holding end_id. Each row of docs is a document of its own,
    repeated ids included; a null doc_id stays null. Sequence ids are unique over all tasks. Extra columns are ignored,
    unless `prompt` names one: the text that comes before `text` in each document and bears no loss (null: none). A
    document's first token bears none in any case, as nothing predicts it.
    No sequence has more than `size` tokens, `segments` pieces or `loss` (size by default) loss-bearing tokens; the three
    limits hold apart from each other. A sequence is shorter than `size` only where another limit stops it, or as one of
    a task's last, whose length is then a power of two. With loss = size, as for plain documents, the loss limit cannot
    bind before the token limit.
    """
    small_batches(docs.sparkSession)
    limits = Limits(size, segments, size if loss is None else loss)
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("each limit must be 1 at least")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 33
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        open_items: list[Piece] = []

        def put(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for p in sequence:
                rows.append((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, number, offset, p.loss))
                offset += p.length
            number += 1

        def flush(last: bool) -> None:
            nonlocal open_items
            if not open_items:
                return
            vectors = np.array([(p.length, 1, p.loss) for p in open_items], float)
            bins = [[open_items[i] for i in own] for own in place(vectors, np.array([limits.tokens, limits.segments, limits.loss], float))]
            done, open_items = filled(bins, limits)
            for own in done:
                put(own)
            if last:
                for own in in_powers(open_items, limits):
                    put(own)
                open_items = []

        def batch_out() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for table in rounds(batches):
            found, *before = (words.ids(x) for x in table[1:])
            for doc_id, ids, asked in zip(table[0].to_pylist(), found, before[0] if prompt else repeat(b"", len(found)), strict=True):
                whole = Piece(doc_id, 0, asked + ids + end, len(asked + ids) // 4 + 1, max(1, len(asked) // 4))
                while (n := whole.fitting(limits.tokens, limits.loss)) < whole.length or n == limits.tokens:
                    one, whole = whole.cut(n)
                    if n == limits.tokens:
                        put([one])
                    else:
                        open_items.append(one)
                if whole.length:
                    open_items.append(whole)
                if len(open_items) >= window:
                    flush(False)
            yield batch_out()
        words.forget()
        flush(True)
        yield batch_out()

    return docs.select("doc_id", "text", *([F.col(prompt).alias("prompt")] if prompt else [])).mapInArrow(packed, SCHEMA)

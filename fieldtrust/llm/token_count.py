"""Exact token counts of a sentencepiece BPE vocabulary by a compiled finite-state transducer.

A BPE result is valid exactly when every two neighbouring tokens are what BPE makes of these two alone, so the last
token of each prefix can be found from the last tokens of shorter prefixes. The future of a prefix then depends only
on its suffixes that some piece continues and on the last token before each of them. These tuples are the states of a
deterministic transducer over characters; each transition carries the number of tokens that it adds, which may be
negative when a merge joins earlier tokens. States and transitions are compiled when a text first needs them.

No piece of such a vocabulary has a word mark after another character (checked on load), so a mark after another
character resets the transducer: the state map of everything from there on no longer depends on what came before. A
chunk of text is thus summed up as (open head, count, open tail); these maps compose associatively, and a long text is
cut into chunks whose maps are composed pairwise, as in a prefix scan. The maps of whole words are kept in a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrust.llm.common import small_batches

MARK = "▁"
#: Bounds of what a Python worker keeps; beyond them the tables start anew.
WORDS_KEPT, STATES_KEPT = 400_000, 200_000


class Transducer:
    """counts(text): tokens of `text` under the sentencepiece model at `path`, without begin and end tokens."""

    def __init__(self, path: str, chunk_chars: int = 65_536):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        # what the shortcuts rest on, asked of the model itself
        self.resets = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.dummy = model.encode("a", out_type=str)[0].startswith(MARK)
        self.bytes = len(model.encode("\U0010fffd")) >= 4
        if model.encode("a  b") == model.encode("a b") or len(model.encode("ÅÅ", out_type=str)) == 0:
            raise ValueError("only models that keep white space are supported")
        self.proper = {p[:n] for p in self.score for n in range(1, len(p))}
        self.chunk_chars = chunk_chars
        self.pairs: dict[tuple[str, str], bool] = {}
        self.made: dict[str, tuple[str, str] | None] = {}
        self.sides: dict[tuple[str, int], list[tuple[str, float]] | None] = {}
        self.words: dict[str, int] = {}
        self._start()

    def _start(self) -> None:
        #: State 0 is the start. A state: ((suffix, last token before it, tokens before it relative to all), ...).
        self.states: list[tuple] = [(("", "", 0),)]
        self.index = {self.states[0]: 0}
        self.steps: list[dict[str, tuple[int, int]]] = [{}]

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored neighbours that make a piece join, the leftmost of equals first."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            if len(parts) == 2:
                self.made[text] = (parts[0], parts[1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def side(self, token: str, right: int) -> list[tuple[str, float]] | None:
        """The symbols that stand at one end of a token while BPE builds it, each with the score of the merge that ends
        it; None unless every merge scores less than those that built its parts."""
        if (token, right) in self.sides:
            return self.sides[token, right]
        got: list[tuple[str, float]] | None = [(token, float("-inf"))]
        part, made_at = token, self.score.get(token, float("inf"))
        while got is not None and len(part) > 1:
            if part not in self.made and self.merged(part) != [part]:
                got = None
                break
            halves = self.made[part]
            if any(len(h) > 1 and self.score[h] <= made_at for h in halves):
                got = None
                break
            part = halves[right]
            got.append((part, made_at))
            made_at = self.score.get(part, float("inf"))
        self.sides[token, right] = got
        return got

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stand side by side in BPE results: no merge across their border comes first."""
        got = self.pairs.get((left, right))
        if got is not None:
            return got
        ends, begins = self.side(left, 1), self.side(right, 0)
        if ends is None or begins is None:
            got = self.merged(left + right) == [left, right]
        else:
            got = True
            score = self.score
            for x, x_ends in ends:
                for y, y_ends in begins:
                    s = score.get(x + y)
                    # of equal scores the left one goes first
                    if s is not None and s > x_ends and s >= y_ends and (len(x) == 1 or s < score[x]) and (len(y) == 1 or s < score[y]):
                        got = False
        if len(self.pairs) > WORDS_KEPT:
            self.pairs.clear()
        self.pairs[left, right] = got
        return got

    def weight(self, token: str) -> int:
        return 1 if token in self.score or not self.bytes else len(token.encode("utf-8", "surrogatepass"))

    def step(self, state: int, char: str) -> tuple[int, int]:
        """Compiles one transition: the next state and the number of tokens added."""
        last = added = None
        for suffix, before, tokens in self.states[state]:  # the longest suffix first
            token = suffix + char
            if (token in self.score or not suffix) and (not before or self.fits(before, token)):
                last, added = token, tokens + self.weight(token)
                break
        kept = [(s + char, b, n - added) for s, b, n in self.states[state] if s + char in self.proper]
        key = (*kept, ("", last, 0))
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][char] = got = (self.index[key], added)
        return got

    def run(self, text: str) -> int:
        """Tokens of a marked text that the transducer reads from its start."""
        if len(self.states) > STATES_KEPT:
            self._start()
        steps, state, count = self.steps, 0, 0
        for char in text:
            got = steps[state].get(char)
            if got is None:
                got = self.step(state, char)
            state = got[0]
            count += got[1]
        return count

    def word(self, word: str) -> int:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            got = self.words[word] = self.run(word)
        return got

    def chunk(self, marked: str) -> tuple[str, int, str] | tuple[str]:
        """The map of a chunk: (head that still needs what came before, tokens, tail that still needs what follows)."""
        parts = marked.split(MARK)
        # a mark run that follows another character starts anew; the run itself belongs to the next word
        firm = [i for i in range(1, len(parts)) if parts[i - 1]]
        if not self.resets or not firm:
            return (marked,)
        first, end = firm[0], firm[-1]
        head = MARK.join(parts[:first])
        inner = parts[first:end]
        if "" in inner:
            count, run = 0, MARK
            for p in inner:
                if p:
                    count += self.word(run + p)
                    run = MARK
                else:
                    run += MARK
        else:
            count = sum(map(self.word, [MARK + p for p in inner]))
        return (head, count, MARK + MARK.join(parts[end:]))

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; what lies open between them is mapped anew."""
        if len(a) == 1:
            between = self.chunk(a[0] + b[0])
            if len(b) == 1:
                return between
            if len(between) == 1:
                return (between[0], b[1], b[2])
            return (between[0], between[1] + self.word(between[2]) + b[1], b[2])
        between = self.chunk("x" + a[2] + b[0])  # after the x the tail's mark is a reset
        if len(b) == 1:
            return (a[0], a[1] + between[1], between[2])
        return (a[0], a[1] + between[1] + self.word(between[2]) + b[1], b[2])

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (MARK if self.dummy else "") + text.replace(" ", MARK)
        size = self.chunk_chars
        maps = [self.chunk(marked[i : i + size]) for i in range(0, len(marked), size)]
        while len(maps) > 1:  # neighbours compose side by side; an odd one waits
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        (got,) = maps
        if len(got) == 1:
            return self.run(got[0]) if len(got[0]) > 64 else self.word(got[0])
        return self.word(got[0]) + got[1] + self.word(got[2])


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each Python worker, kept between its tasks."""
    return Transducer(path)


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to docs, whatever other columns it has.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay repeated; an empty table gives an empty one.
    Columns of docs with the added names are replaced. No shuffle: each row is counted where it is read.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            n = [t.count(x) if x else 0 for x in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    out = docs.mapInArrow(counted, schema)
    return out.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})

"""How five document filters interact: what each removes, in every order, by part of the corpus.

Four filters look at a text alone; the fifth, identity to a text of a smaller id, is decided by radix tries:

1. Tasks test their texts and keep one lead row for each different text of a window (bounded in bytes), with the smallest id
   in the window: a text that fills a third of the corpus is shuffled a few times for each task.
2. Lead texts are range-partitioned by their first bytes. Prefixes that hold too much for a partition are extended, four
   times as long each time, until they do not: lengthening goes by hashes of the prefixes, and the ranges by the first bytes,
   the length and the hash. Equal texts always meet.
3. Each partition inserts its full texts into a compressed trie whose terminals hold the smallest id. A traversal gives the
   smallest id back to each window in which the text stood.
4. A document's failures are a mask of five bits. Masks are counted by part and label; all orders follow from the counts of
   the 32 masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrust.llm.common import BATCH_ROWS, BROADCAST_ROWS, passing, saved, small_batches

LETTERS = "ABCDE"
BITS = {c: 1 << i for i, c in enumerate(LETTERS)}
# the filters' limits
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 2
#: Bytes that a window holds, and that a trie should hold.
WINDOW_BYTES, TRIE_BYTES = 32 << 20, 32 << 20
#: Bytes of the first prefix, and how many times longer each next one is; a text weighs this much beside its bytes.
FIRST, LONGER, NODE = 32, 4, 256

_UPPER, _SYMBOLS, _INSIDE = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """The mask of the filters A to D that a text fails."""
    words = text.split()
    points = len(text.translate(None, _INSIDE))
    mask = BITS["A"] if len(words) < LEAST_WORDS else 0
    if 100 * len(set(words)) < LEAST_DISTINCT * len(words):
        mask |= BITS["B"]
    if 100 * (len(text) - len(text.translate(None, _UPPER))) > MOST_UPPER * points:
        mask |= BITS["C"]
    return mask | (BITS["D"] if len(text.translate(None, _SYMBOLS)) < len(text) else 0)


def prefix_hashes(text: bytes) -> list[int]:
    """Hashes of the text's prefixes of FIRST, FIRST * LONGER, ... bytes, and of all of it."""
    state, at, upto, out = xxhash.xxh64(), 0, FIRST, []
    while upto < len(text):
        state.update(text[at:upto])
        out.append(state.intdigest())
        at, upto = upto, upto * LONGER
    state.update(text[at:])
    return [x - (1 << 64) if x >> 63 else x for x in (*out, state.intdigest())]


class Trie:
    """A compressed trie of byte texts; each terminal has the smallest id inserted with its text and the pieces (windows'
    classes) that hold it."""

    def __init__(self) -> None:
        # a node: label, children by first byte, place of its terminal or -1
        self.root: list = [b"", {}, -1]
        self.least: list[int | None] = []
        self.pieces: list[list[int]] = []

    def insert(self, text: bytes, least: int | None, piece: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, -1]
            elif not text.startswith(child[0], at):
                label = child[0]
                same, over = 1, min(len(label), len(text) - at)  # the first `same` bytes agree, more than `over` do not
                while same < over:
                    middle = (same + over + 1) // 2
                    same, over = (middle, over) if text.startswith(label[:middle], at) else (same, middle - 1)
                inner = [label[:same], {label[same]: child}, -1]
                child[0] = label[same:]
                child = node[1][text[at]] = inner
            node, at = child, at + len(child[0])
        if node[2] < 0:
            node[2] = len(self.least)
            self.least.append(least)
            self.pieces.append([piece])
            return
        held = self.least[node[2]]
        self.least[node[2]] = held if least is None else least if held is None else min(held, least)
        self.pieces[node[2]].append(piece)

    def shared(self) -> Iterator[tuple[int, int | None]]:
        """(piece, smallest id) of the texts that stand in several pieces, by a traversal."""
        open_nodes = [self.root]
        while open_nodes:
            _, children, place = open_nodes.pop()
            open_nodes += children.values()
            if place >= 0 and len(self.pieces[place]) > 1:
                for piece in self.pieces[place]:
                    yield piece, self.least[place]


EXAMINED = "doc_id long, part string, mask int, piece long, least long, text binary, steps array<long>"


def examined(docs: DataFrame, window: int) -> DataFrame:
    """A row for each document: its mask of A to D, the piece (class of equal texts of its window) and the smallest id
    there; the piece's first row has the text and the hashes of its prefixes."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        held: list[tuple] = []  # doc_id, part, piece, whether it leads
        found: dict[bytes, int] = {}  # the window's texts and their pieces
        least: dict[int, int | None] = {}
        masks: dict[int, int] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            texts = {piece: text for text, piece in found.items()}
            for a in range(0, len(held), BATCH_ROWS):
                part = held[a : a + BATCH_ROWS]
                lead = [texts[p] if leads else None for _, _, p, leads in part]
                columns = [
                    pa.array([r[0] for r in part], pa.int64()),
                    pa.array([r[1] for r in part], pa.string()),
                    pa.array([masks[r[2]] for r in part], pa.int32()),
                    pa.array([r[2] for r in part], pa.int64()),
                    pa.array([least[r[2]] for r in part], pa.int64()),
                    pa.array(lead, pa.binary()),
                    pa.array([None if t is None else prefix_hashes(t) for t in lead], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "piece", "least", "text", "steps"])

        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, part, cell in zip(ids, parts, batch.column(1).cast(pa.binary()), strict=True):
                text = cell.as_py() or b""
                piece = found.get(text)
                leads = piece is None
                if leads:
                    piece = found[text] = first
                    first += 1
                    least[piece], masks[piece] = doc, own_failures(text)
                    size += len(text)
                elif doc is not None:
                    least[piece] = doc if least[piece] is None else min(least[piece], doc)
                held.append((doc, part or "", piece, leads))
                size += 64
                if size > window:
                    yield from flushed()
                    held, found, least, masks, size = [], {}, {}, {}, 0
        yield from flushed()

    return docs.select("doc_id", "text", "source").mapInArrow(tested, EXAMINED)


def with_range_key(texts: DataFrame, partitions: int) -> DataFrame:
    """texts (text, steps) with key columns p0, depth and h: the first bytes, and for prefixes that weigh more than a
    quarter of an even share, how often they were extended and the hash of the extended one.

    Each level has at most 4 * partitions such prefixes, so they are broadcast."""
    weighed = texts.select("steps", (F.octet_length("text") + NODE).alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0] or 0
    out, level = texts.withColumn("depth", F.lit(0)), 0
    while True:
        step = F.get("steps", F.lit(level))
        hot = saved(weighed.where(F.size("steps") > level + 1).groupBy(step.alias("hot")).agg(F.sum("weight").alias("weight")).where(F.col("weight") > total / (4 * partitions)).select("hot"), "hot")
        if hot.isEmpty():
            break
        weighed = weighed.where(F.size("steps") > level + 1).join(F.broadcast(hot), step == F.col("hot"), "left_semi")
        marked = hot.withColumnRenamed("hot", "_hot")
        reached = (F.col("depth") == level) & (F.size("steps") > level + 1)
        out = out.join(F.broadcast(marked), reached & (step == F.col("_hot")), "left").withColumn("depth", F.when(F.col("_hot").isNotNull(), level + 1).otherwise(F.col("depth"))).drop("_hot")
        level += 1
    h = F.when(F.col("depth") > 0, F.get("steps", F.col("depth"))).otherwise(F.lit(0).cast("long"))
    return out.withColumns({"p0": F.substring("text", 1, FIRST), "h": h})


def smallest_ids(texts: DataFrame, partitions: int) -> DataFrame:
    """piece, least: the smallest id of the piece's text in all pieces, of texts that stand in several. texts: piece,
    least, text, steps."""

    def inserted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            for piece, least, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(text, least, piece)
        out = list(trie.shared())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["piece", "least"])

    ranged = with_range_key(texts, partitions).repartitionByRange(partitions, "p0", "depth", "h")
    return ranged.select("piece", "least", "text").mapInArrow(inserted, "piece long, least long")


def masks(docs: DataFrame, window: int = WINDOW_BYTES, trie: int = TRIE_BYTES) -> DataFrame:
    """doc_id, part, mask (bits A to E) of each row of docs (doc_id, text, source).

    A null text is the empty one, a null source the part ''. Words are runs without ASCII white space. A row with a null
    doc_id is never a copy and makes none; rows of one doc_id with one text are no copies of each other."""
    small_batches(docs.sparkSession)
    base = saved(examined(docs, window), "examined")
    texts = base.where("text is not null").select("piece", "least", "text", "steps")
    size = texts.agg(F.sum(F.octet_length("text") + NODE)).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // trie))
    found = saved(smallest_ids(texts, partitions).withColumnRenamed("least", "_least"), "smallest")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    rows = base.select("doc_id", "part", "mask", "piece", "least").join(found, "piece", "left")
    copy = F.coalesce(F.col("doc_id") > F.coalesce("_least", "least"), F.lit(False))
    return rows.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, BITS["E"]).otherwise(0)).alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by mask, and those that a row of labels (doc_id, quality, toxic) marks."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic")).where("_good or _toxic")
    joined = masked.join(marked, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count(F.when(F.col("_good"), 1)).alias("good"), F.count(F.when(F.col("_toxic"), 1)).alias("toxic"))


def order_table(counts: DataFrame) -> DataFrame:
    """The audit of mask_counts: for each part, order and step the counts of the step's filter.

    Each count goes to the 80 pairs of a filter and the set of filters before it; orders look their steps up there."""
    pairs = [(before, bit) for bit in BITS.values() for before in range(32) if not before & bit]
    each = counts.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("before"), F.lit(b).alias("bit")) for p, b in pairs])).alias("_p")).select("part", "mask", "n", "good", "toxic", "_p.*")
    m, own = F.col("mask"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = m.bitwiseAND(F.col("before")) != 0
    total = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long")
    summed = each.groupBy("part", "before", "bit").agg(
        total("n", ~own & ~earlier).alias("kept"),
        total("n", own & ~earlier).alias("removed"),
        total("n", own & earlier).alias("redundant"),
        total("n", m == F.col("bit")).alias("unique_fails"),
        total("good", own & ~earlier).alias("good_lost"),
        total("toxic", own & ~earlier).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(own, F.col("n") * F.expr("120 div bit_count(mask)"))), F.lit(0)).cast("long").alias("shapley"),
    )
    orders = [(sum(BITS[c] for c in order[:i]), BITS[order[i]], "".join(order), i + 1) for order in permutations(LETTERS) for i in range(len(LETTERS))]
    steps = counts.sparkSession.createDataFrame(orders, "before int, bit int, filter_order string, step int")
    return summed.join(F.broadcast(steps), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, window: int = WINDOW_BYTES, trie: int = TRIE_BYTES) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part of
    docs (doc_id, text, source; other columns are ignored), all orders of the filters and their steps.

    Repeated rows count each; a document with several label rows is good or toxic if one says so; for nulls see masks().
    An empty table gives an empty table.
    """
    with passing(docs.sparkSession):
        counts = saved(mask_counts(masks(docs, window, trie), labels), "counts", lasting=True)
    return order_table(counts)

"""Line dedup by a tree of log templates.

A line is parsed at fixed depth: by its number of tokens, then by its first tokens; tokens with digits are variable
from the start. Two lines of a leaf that agree in 0.8 of their places belong to one template, and so do lines that a chain
of such pairs joins; the places where a template's lines differ are its variables. This does not depend on the order or
the number of the lines: small leaves are joined in one piece each, leaves of many lines through buckets of equal blocks
of tokens, of which two lines that agree share one, with the same result. Templates that recur across documents are
boilerplate and their lines are dropped.

A document that is a copy shares its lines with its copies and is left for document-level dedup. Copies are told from
boilerplate by what else stands in the documents: a document is apart from a template's others if more than a ninth of
its tokens (less would make it a near copy at 0.8) lies in lines that are clearly rarer than the template, both as
templates and by their three-token pieces, so that a changed word makes no line rare. Documents apart are counted by
their rarest lines, so copies among them count once; all others of the template count as one. Long lines (passages)
need fewer documents and a smaller distance. Short lines count too, but only equal ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fieldtrust.llm.buckets import block_rows, dealt, joined
from fieldtrust.llm.common import keep_ids, passing, saved, small_batches

#: Leading tokens that make a leaf.
DEPTH = 3
#: Leaves of more different lines are joined through buckets.
LEAF_ROWS = 1000
#: Rows that go to Python in one piece, about.
DEALT_ROWS = 2000
#: Percentage of equal places that joins two lines.
SIMILAR = 80
#: Lines of fewer tokens are no evidence of a template and are matched exactly; without a letter they stay.
LEAST_TOKENS = 4
#: A line without spaces in a script beyond PLAIN is taken by characters, from so many.
PLAIN, LEAST_CHARACTERS = "\u0e00", 10
#: Minima of three-token pieces that stand for a line.
SKETCH = 4
#: A document is apart if more than one in SHARE of its tokens lies in rarer lines: 1 - 2/9 over 1 is similarity 0.8.
SHARE = 9
#: Documents that count, and times the document's rarest lines, from which a template is dropped; the same for long lines.
DOCS, TIMES = 3, 3
LONG_TOKENS, LONG_DOCS, LONG_TIMES = 50, 2, 2
#: Dropped lines, all documents together, up to which their lists are broadcast; more are joined by a shuffle.
LISTED = 1_000_000

_DIGIT = re.compile(r"\d")
VARIABLE = "<*>"
LINES = "doc_id long, line_no int, n_tokens int, leaf long, template long, sketch array<long>"
TOKENS = "leaf long, template long, tokens binary"


def _hash(data: str | bytes) -> int:
    x = xxh3_64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def _names(tokens: list[str]) -> tuple[int, int]:
    """The names of a line's leaf and of the line itself."""
    return _hash(f"{len(tokens)} {' '.join(tokens[:DEPTH])}"), _hash(" ".join(tokens))


def masked(line: str) -> list[str]:
    """The tokens of a line, those with digits as variables; as they are where that would be more than half of them."""
    tokens = line.split()
    if len(tokens) == 1 and len(tokens[0]) >= LEAST_CHARACTERS and max(tokens[0]) >= PLAIN:
        tokens = list(tokens[0])
    if not _DIGIT.search(line):
        return tokens
    out = [VARIABLE if _DIGIT.search(t) else t for t in tokens]
    return out if 2 * out.count(VARIABLE) <= len(out) else tokens


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(tokens: list[str], lengths: list[int]) -> np.ndarray:
    """SKETCH minima of the three-token pieces of each line (the last pieces are shorter) of the lines' tokens, one line
    after another. Two zeros behind each line keep pieces within it."""
    n = np.array(lengths) + 2
    ends = np.cumsum(n)
    h = np.zeros(ends[-1], np.uint64)
    h[np.arange(len(tokens)) + 2 * np.repeat(np.arange(len(n)), n - 2)] = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    pieces = _mixed(h + _mixed(np.roll(h, -1) + _mixed(np.roll(h, -2))))
    out = np.empty((len(n), SKETCH), np.int64)
    for k in range(SKETCH):
        x = _mixed(pieces + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        x[ends - 1] = x[ends - 2] = np.uint64(0xFFFFFFFFFFFFFFFF)
        out[:, k] = np.minimum.reduceat(x, ends - n).view(np.int64)
    return out


def parsed_lines(docs: DataFrame) -> DataFrame:
    """LINES of docs, numbered from 0 among all lines of the text; short ones (a leaf each) only if they have a letter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, flat, lengths = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, line in enumerate((text or "").split("\n")):
                    t = masked(line)
                    if len(t) >= LEAST_TOKENS:
                        out.append((doc_id, i, len(t), *_names(t)))
                    elif any(map(str.isalpha, line)):
                        t = line.split()
                        same = _hash("= " + " ".join(t))
                        out.append((doc_id, i, len(t), same, same))
                    else:
                        continue
                    flat += t
                    lengths.append(len(t))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            minima = sketches(flat, lengths) if out else np.empty((0, SKETCH), np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * SKETCH, pa.int32()), pa.array(minima.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), sketch], names=[x.split()[0] for x in LINES.split(", ")])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(rows, LINES)


def line_tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """TOKENS of the wanted lines (doc_id, line_no): 32-bit hashes of their tokens, 0 for variable ones."""
    lists = saved(wanted.groupBy("doc_id").agg(F.collect_set("line_no").alias("line_nos")), "wanted")
    chosen = docs.select("doc_id", "text").join(F.broadcast(lists) if wanted.count() <= LISTED else lists, "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for text, line_nos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                for i in line_nos:
                    t = masked(lines[i]) if i < len(lines) else []
                    if len(t) < LEAST_TOKENS:  # another text of this doc_id
                        continue
                    if len(known) > 300_000:
                        known = {}
                    for x in t:
                        if x not in known:
                            known[x] = 0 if x == VARIABLE else (_hash(x) & 0xFFFFFFFF) or 1
                    out.append((*_names(t), np.array([known[x] for x in t], "<u4").tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            types = [pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])

    return chosen.select("text", "line_nos").mapInArrow(rows, TOKENS).dropDuplicates(["leaf", "template"])


def alike(lines: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which of some lines (rows of token hashes) agree with a line of that many tokens."""
    return 100 * (lines == line).sum(axis=1) >= SIMILAR * lines.shape[1]


def joined_lines(tokens: list[bytes], names: np.ndarray) -> np.ndarray:
    """For each line of a leaf the least name of those that a chain of agreeing lines joins to it."""
    owner = names.copy()
    # a leaf is named by a hash: lines of another length are other lines
    for n in {len(x) for x in tokens}:
        at = np.array([i for i, x in enumerate(tokens) if len(x) == n])
        lines, own = np.frombuffer(b"".join(tokens[i] for i in at), "<u4").reshape(len(at), -1), np.arange(len(at))
        for i in range(len(at) - 1):
            later = i + 1 + np.flatnonzero(own[i + 1 :] != own[i])
            near = later[alike(lines[later], lines[i])]
            if len(near):
                own[np.isin(own, own[near])] = own[i]
        for x in np.unique(own):
            owner[at[own == x]] = names[at[own == x]].min()
    return owner


def grown_leaves(pdf: pd.DataFrame) -> pd.DataFrame:
    """Joins the lines of the leaves that were dealt together, one leaf after another."""
    pdf = pdf.sort_values(["leaf", "template"])
    leaves, names, tokens = pdf["leaf"].to_numpy(), pdf["template"].to_numpy(), pdf["tokens"].to_list()
    starts = np.flatnonzero(np.concatenate(([True], leaves[1:] != leaves[:-1])))
    owners = [joined_lines(tokens[a:b], names[a:b]) for a, b in zip(starts, np.append(starts[1:], len(pdf)), strict=True)]
    return pd.DataFrame({"leaf": leaves, "template": names, "grown": np.concatenate(owners)})


def block_names(leaf: int, tokens: bytes) -> list[int]:
    """A name for each of the blocks into which the tokens after the leaf's are cut. Lines of n tokens that agree differ in
    at most n * (1 - SIMILAR) places; with one block more than that, one whole block is the same in both."""
    n = len(tokens) // 4
    blocks = n * (100 - SIMILAR) // 100 + 1
    ends = [4 * (DEPTH + (n - DEPTH) * k // blocks) for k in range(blocks + 1)]
    return [_hash(b"%d %d %d " % (leaf, n, k) + tokens[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def grown_by_blocks(full: DataFrame) -> DataFrame:
    """leaf, template, grown of the lines (TOKENS) of crowded leaves, as joined_lines gives them, through buckets."""
    lines = full.select(F.col("template").alias("node"), (F.octet_length("tokens") / 4).cast("long").alias("size"), "leaf", "tokens")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, node, size, tokens = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("leaf", "node", "size", "tokens"))
            out = [(b, n, k) for x, b, n, t in zip(leaf, node, size, tokens, strict=True) for k in block_names(x, t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 3)], names=["node", "size", "key"])

    keys = saved(lines.mapInArrow(named, "node long, size long, key long"), "keys")
    own = lines.select("node", "tokens")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(own.toDF("a", "left"), "a").join(own.toDF("b", "right"), "b").select("a", "b", "left", "right")

        def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, left, right = (c.to_pylist() for c in batch.columns)
                fit = [len(x) == len(y) and bool(alike(np.frombuffer(x, "<u4")[None], np.frombuffer(y, "<u4"))[0]) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([v for v, f in zip(c, fit, strict=True) if f], pa.int64()) for c in (a, b)], names=["a", "b"])

        return saved(both.mapInArrow(checked, "a long, b long"), "links")

    def in_blocks(split: DataFrame) -> DataFrame:
        return dealt(block_rows(split)).join(own, "node").groupBy("dealt").applyInPandas(lambda pdf: block_links(pdf), "a long, b long").distinct()

    found = joined(keys, 100, verified, in_blocks, more_hubs=1)
    return full.join(found, F.col("template") == F.col("node"), "left").select("leaf", "template", F.coalesce("component", "template").alias("grown"))


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the blocks that were dealt together, one for each pair of components that meets in a block."""
    links: set[tuple[int, int]] = set()
    for _, own in pdf.groupby(["key", "i", "j"], sort=True):
        own = own.drop_duplicates(["side", "node"]).sort_values(["side", "node"])
        node, component, side = own["node"].to_numpy(), own["component"].to_numpy().copy(), own["side"].to_numpy()
        lines = np.frombuffer(b"".join(own["tokens"]), "<u4").reshape(len(own), -1)
        alone = bool(own["alone"].iloc[0])
        for k in np.flatnonzero(side == 0):
            other = np.flatnonzero((np.arange(len(own)) > k if alone else side == 1) & (component != component[k]))
            for j in other[alike(lines[other], lines[k])]:
                if component[j] != component[k]:
                    links.add((int(max(node[k], node[j])), int(min(node[k], node[j]))))
                    component[component == component[j]] = component[k]
    return pd.DataFrame(sorted(links), columns=["a", "b"], dtype="int64")


def templates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """leaf, template, grown for the lines in leaves that hold several templates and several documents."""
    exact = saved(
        lines.select("leaf", "template", "doc_id", "line_no").groupBy("leaf", "template", "doc_id").agg(F.min("line_no").alias("line_no")).groupBy("leaf", "template").agg(F.min(F.struct("doc_id", "line_no")).alias("at")),
        "exact",
    )
    crowded = exact.groupBy("leaf").agg(F.count("*").alias("m"), F.min("at.doc_id").alias("lo"), F.max("at.doc_id").alias("hi")).where("m > 1 and (lo < hi)").select("leaf", "m")
    asked = saved(exact.join(crowded, "leaf").select("leaf", "template", "m", F.col("at.doc_id").alias("doc_id"), F.col("at.line_no").alias("line_no")), "asked")
    tokens = line_tokens(docs, asked.select("doc_id", "line_no"))
    full = saved(asked.select("leaf", "template", "m").join(tokens, ["leaf", "template"]), "full")
    few = full.where(F.col("m") <= LEAF_ROWS)
    # most leaves are small: many are handed to Python together
    together = F.pmod(F.xxhash64("leaf"), F.lit(max(1, few.count() // DEALT_ROWS)))
    out = few.withColumn("dealt", together).groupBy("dealt").applyInPandas(lambda pdf: grown_leaves(pdf), "leaf long, template long, grown long")
    many = full.where(F.col("m") > LEAF_ROWS)
    return out if many.isEmpty() else out.unionByName(grown_by_blocks(many.drop("m")))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, dropped: the numbers of the lines that go, for documents that lose any."""
    small_batches(docs.sparkSession)
    with passing(docs.sparkSession):
        lines = saved(parsed_lines(docs), "lines")
        grown = saved(templates(docs, lines), "grown")
        named = saved(lines.drop("sketch").join(grown, ["leaf", "template"], "left").withColumn("grown", F.coalesce("grown", "template")), "named")
        counts = named.select("leaf", "grown", "doc_id").distinct().groupBy("leaf", "grown").agg(F.count("*").alias("n")).where("n > 1")
        counted = saved(named.select("doc_id", "line_no", "n_tokens", "leaf", "grown").join(saved(counts, "counts"), ["leaf", "grown"], "left").withColumn("n", F.coalesce("n", F.lit(1))), "counted")
        shared = counted.where("n > 1")
        concerned = saved(shared.select("doc_id").distinct(), "concerned")
        apart = saved(rarest(keep_ids(lines, concerned, "doc_id"), keep_ids(counted, concerned, "doc_id")), "apart")
        rarer = F.when(F.col("n_tokens") >= LONG_TOKENS, F.lit(LONG_TIMES)).otherwise(F.lit(TIMES))
        beside = saved(shared.join(apart, "doc_id").withColumn("own", F.col("n") >= rarer * F.col("rare")), "beside")
        # the documents that are not apart have a null key together
        classes = beside.select("leaf", "grown", F.when(F.col("own"), F.col("key")).alias("key")).distinct().groupBy("leaf", "grown").agg(F.count("*").alias("classes"))
        least = F.when(F.col("n_tokens") >= LONG_TOKENS, F.lit(LONG_DOCS)).otherwise(F.lit(DOCS))
        # a document that is not apart may consist of boilerplate only: then most of the others are
        goes = (F.col("classes") >= least) & (F.col("own") | (F.col("classes") * TIMES >= F.col("n")))
        found = beside.join(saved(classes.where(F.col("classes") >= min(DOCS, LONG_DOCS)), "classes"), ["leaf", "grown"]).where(goes)
        return saved(found.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped")), "dropped", lasting=True)


def rarest(lines: DataFrame, counted: DataFrame) -> DataFrame:
    """doc_id, rare, key: how common the rarest lines are that hold more than one in SHARE of the document's tokens,
    and a name of the document by them (the least hash of their templates)."""
    pieces = lines.select("doc_id", "line_no", F.explode("sketch").alias("piece"))
    common = saved(pieces.select("piece", "doc_id").distinct().groupBy("piece").agg(F.count("*").alias("m")).where("m > 1"), "pieces")
    soft = pieces.join(common, "piece").groupBy("doc_id", "line_no").agg(F.max("m").alias("m"))
    each = counted.join(soft, ["doc_id", "line_no"], "left").select("doc_id", "n_tokens", F.greatest("n", F.coalesce("m", F.lit(1))).alias("n"), F.xxhash64("leaf", "grown").alias("key"))
    listed = each.groupBy("doc_id").agg(F.sum("n_tokens").alias("total"), F.array_sort(F.collect_list(F.struct("n", "n_tokens", "key"))).alias("ns"))
    start = F.struct(F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("rare"), F.lit(None).cast("long").alias("key"))

    def step(state: Column, x: Column) -> Column:
        more = (SHARE * state["tokens"] <= F.col("total")) | (state["rare"] == x["n"])
        key = F.when(more, F.least(state["key"], x["key"])).otherwise(state["key"])
        return F.struct((state["tokens"] + x["n_tokens"]).alias("tokens"), F.when(more, x["n"]).otherwise(state["rare"]).alias("rare"), key.alias("key"))

    at = F.aggregate("ns", start, step)
    return listed.select("doc_id", at["rare"].alias("rare"), at["key"].alias("key"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs with text cleaned, and n_lines, n_dropped and emptied added.

    Lines end at line feeds; kept ones are unchanged. Null texts stay null (no lines), texts without recurring lines
    stay as they are. emptied: lines were dropped and nothing but white space is left. Equal rows of a doc_id are treated alike; rows
    with a null doc_id are not counted and stay. Columns of docs with the added names are replaced; an empty table
    gives an empty one.
    """
    docs = docs.drop("n_lines", "n_dropped", "emptied", "dropped")
    lists = dropped_lines(docs)
    listed = lists.agg(F.sum(F.size("dropped"))).first()[0] or 0
    joined = docs.join(F.broadcast(lists) if listed <= LISTED else lists, "doc_id", "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("dropped", i)), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    out = joined.withColumns({"n_lines": F.coalesce(F.size(parts), F.lit(0)), "n_dropped": F.coalesce(F.size("dropped"), F.lit(0)), "cleaned": text})
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines"))).withColumn("n_dropped", F.when(F.col("dropped").isNull(), 0).otherwise(F.col("n_dropped")))
    emptied = (F.col("n_dropped") > 0) & ~F.rlike("cleaned", F.lit(r"[^\x20\x09-\x0D]"))
    return out.withColumn("emptied", F.coalesce(emptied, F.lit(False))).withColumn("text", F.col("cleaned")).select(*docs.columns, "n_lines", "n_dropped", "emptied")

"""Line de-duplication with a tree of log templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import BROADCAST, decoded, scratch, spread
from trackweave.llm.tokens import mixed, tokenised
from trackweave.llm.vectors import small_batches

#: Leading tokens on the path to a leaf, and share of equal tokens that joins a template.
DEPTH, ALIKE = 4, 0.75
#: A template recurs if so many unlike documents have it, and if they hold so many of
#: its tokens together.
UNLIKE, TOKENS = 2, 30
#: A document is a copy of another if this share of up to so many of its own token pairs
#: stands there, and if neither is over so many times as long.
COPY, PAIRS, LONGER = 0.5, 16, 2
#: Other documents that are compared with one in a row.
HOLDERS = 512
#: Distinct lines, and tokens in them, that are parsed at once; a fuller leaf is parsed in
#: blocks whose templates are then merged.
LEAF_LINES, LEAF_TOKENS = 4096, 1 << 22
class Templates:
    """Templates of one leaf, in the order they began.

    Lines are rows of token hashes, 0 where a token varies.  A line joins the template
    most like it, if ``ALIKE`` of the tokens agree; tokens that do not agree become
    variable fields.  Of two rows that agree so far, ``allowed`` tokens differ at most
    and none of the leading ones, so that one of ``allowed + 1`` runs of the others is
    equal in both: only templates that share a run are compared, and none is missed.
    """

    def __init__(self, tokens: int):
        self.known = np.empty((16, tokens), np.int32)
        self.began: list[int] = []
        self.allowed = tokens - int(np.ceil(ALIKE * tokens))
        self.ends = np.linspace(min(DEPTH, tokens), tokens, self.allowed + 2).astype(int)
        self.runs: dict[tuple[int, bytes], list[int]] = {}

    def add(self, row: np.ndarray, key: int) -> int:
        """The number of the template that ``row`` joins or, as ``key``, begins."""
        runs = [(b, row[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(self.ends, self.ends[1:])) if (row[lo:hi] != 0).all()]
        near = np.array(sorted(set().union(*(self.runs.get(r, ()) for r in runs))), np.int64)
        if len(near):
            agree = ((self.known[near] == row) & (row != 0)).sum(axis=1)
            best = int(agree.argmax())
            if len(row) - agree[best] <= self.allowed:
                at = int(near[best])
                self.known[at][self.known[at] != row] = 0
                return at
        at = len(self.began)
        if at == len(self.known):
            self.known = np.concatenate([self.known, np.empty_like(self.known)])
        self.known[at] = row
        self.began.append(key)
        for r in runs:
            self.runs.setdefault(r, []).append(at)
        return at


def _lines(keyed: DataFrame) -> DataFrame:
    """(id, doc, line, tokens, key, leaf, fresh, lines) of every line that has tokens.

    ``fresh`` is 1 for the document's first line of that key, else 0; ``lines`` is the
    number of such lines of the document, on the first of them, else 0.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in tokenised(decoded(batch.column(2))):
                found.append((part.text, part.line, part.count, *part.paths(DEPTH)))
            text, line, count, key, leaf = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.empty(0, np.int64) for k in range(5))
            with np.errstate(over="ignore"):
                _, first = np.unique(key * np.int64(0x5851F42D4C957F2D) + text, return_index=True)
            fresh = np.zeros(len(key), np.int32)
            fresh[first] = 1
            total = np.bincount(text, minlength=batch.num_rows)
            total = np.where(np.diff(text, prepend=-1) != 0, total[text], 0)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(line.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key), pa.array(leaf), pa.array(fresh), pa.array(total.astype(np.int32))],
                names,
            )

    names = ["id", "doc", "line", "tokens", "key", "leaf", "fresh", "lines"]
    rows = keyed.select("id", "doc", "raw")
    fields = [rows.schema["id"], T.StructField("doc", T.LongType())]
    fields += [T.StructField(n, T.LongType() if n in ("key", "leaf") else T.IntegerType()) for n in names[2:]]
    return rows.mapInArrow(each, T.StructType(fields))


def shared(keyed: DataFrame, lines: DataFrame, plain: bool, repeated: bool) -> DataFrame:
    """``(key, template, docs, keeper)`` of every line whose template several documents
    hold; ``keeper`` is the one with the smallest id.

    Equal lines are counted before any shuffle.  A leaf with several different lines
    is parsed as one row of about ``LEAF_LINES`` of them and ``LEAF_TOKENS`` token hashes;
    a fuller leaf as several, dealt by hash, whose templates are merged by the same rule.
    ``plain`` says whether documents are named by their ids, so that the smallest name is that
    of the smallest id, and ``repeated`` whether rows are alike in id and text.
    """
    store = scratch(keyed.sparkSession)
    keys = lines.groupBy("key", "leaf", "tokens").agg(
        F.sum("fresh").alias("docs"), F.min("doc" if plain else F.struct("id", "doc")).alias("first")
    )
    of_first = F.col("first") if plain else F.col("first.doc")
    keys = store.write(keys, "keys")
    leaves = keys.groupBy("leaf").agg(F.count("*").alias("n_leaf")).where("n_leaf > 1")
    blocks = F.ceil(F.col("n_leaf") / F.least(F.lit(LEAF_LINES), F.greatest(F.lit(1), F.floor(F.lit(LEAF_TOKENS) / F.col("tokens")))))
    several = (
        keys.join(leaves, "leaf").withColumn("blocks", blocks)
        .withColumn("node", F.when(F.col("blocks") == 1, F.col("leaf")).otherwise(F.xxhash64("leaf", F.pmod(F.xxhash64("key"), "blocks"))))
        .select("key", "node", F.when(F.col("blocks") > 1, F.col("leaf")).alias("merge"), of_first.alias("doc"))
    )
    wanted = several.groupBy("doc").agg(F.collect_list(F.struct("key", "node", "merge")).alias("wanted"))
    texts = keyed.select("doc", "raw").join(wanted, "doc")
    texts = texts.dropDuplicates(["doc"]) if repeated else texts

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            key, node, merge = lists.flatten().flatten()
            want = _apart(key.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())))
            at, rows = [], []
            for part in tokenised(decoded(batch.column("raw"))):
                there, line = np.unique(_apart(part.paths(DEPTH)[0], part.text), return_index=True)
                if len(there):
                    place = np.minimum(np.searchsorted(there, want), len(there) - 1)
                    hit = np.flatnonzero(there[place] == want)
                    at.append(hit)
                    rows += [part.row(i) for i in line[place[hit]].tolist()]
            at = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([key.take(at), node.take(at), merge.take(at), pa.array(rows, pa.list_(pa.int32()))], ["key", "node", "merge", "line"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, template) of each line; in a block also the leaf, and what the template became."""
        for batch in batches:
            for leaf, merge in zip(batch.column("lines"), batch.column("merge").to_pylist()):
                key, line = leaf.values.flatten()
                key, order = np.unique(key.to_numpy(), return_index=True)
                hashes = line.flatten().to_numpy().reshape(len(line), -1)[order]
                found = Templates(hashes.shape[1])
                at = [found.add(row, i) for i, row in enumerate(hashes)]
                became = [None] * len(key)
                if merge is not None:
                    for n, i in enumerate(found.began):
                        became[i] = found.known[n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(key[np.array(found.began)[at]]), pa.array([merge] * len(key), pa.int64()), pa.array(became, pa.list_(pa.int32()))], ["key", "template", "merge", "line"]
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, whole) of the blocks' templates, leaf after leaf."""
        leaf, found = None, None
        for batch in batches:
            part, whole = batch.column("part").to_pylist(), []
            for key, of, line in zip(part, batch.column("merge").to_pylist(), batch.column("line")):
                row = line.values.to_numpy()
                if of != leaf:
                    leaf, found = of, Templates(len(row))
                whole.append(found.began[found.add(row, key)])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(whole, pa.int64())], ["part", "whole"])

    leaf = texts.select("raw", "wanted").mapInArrow(pick, "key long, node long, merge long, line array<int>").groupBy("node", "merge").agg(F.collect_list(F.struct("key", "line")).alias("lines"))
    with small_batches(keyed.sparkSession, 64):
        parsed = store.write(leaf.select("lines", "merge").mapInArrow(parse, "key long, template long, merge long, line array<int>"), "templates")
    parts = parsed.where("line is not null").select(F.col("key").alias("part"), "merge", "line").repartition("merge").sortWithinPartitions("merge", "part")
    merged = store.write(parts.mapInArrow(merge, "part long, whole long"), "merged")
    parsed = parsed.join(merged, F.col("template") == F.col("part"), "left").select(F.col("key").alias("of"), F.coalesce("whole", "template").alias("template"))
    named = keys.join(parsed, F.col("key") == F.col("of"), "left").withColumn("template", F.coalesce("template", "key"))
    named = store.write(named.select("key", "template", "tokens", "docs", "first"), "named")
    held = named.groupBy("template").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= UNLIKE)
    return store.write(named.select("key", "template").join(held, "template").select("key", "template", "docs", of_first.alias("keeper")), "shared")


def _own_text(marked: DataFrame, texts: DataFrame, repeated: bool) -> DataFrame:
    """(doc, keeper, own, size) of every document and each keeper of some of its lines.

    ``own`` are the least hashes of the token pairs in the document's own text: of the
    lines that have another keeper or none, the rarest, held by at most twice as many
    documents as the least held of them.  So neither what the two share nor what many
    others hold tells them alike.  ``size`` counts the document's tokens.
    """
    collect = F.collect_set if repeated else F.collect_list
    lines = marked.groupBy("doc").agg(
        collect(F.struct("line", "docs", "keeper")).alias("lines"), F.max((F.col("keeper") != F.col("doc")).cast("int")).alias("other"),
    ).where("other = 1").select("doc", "lines")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            least: list[dict[int, list[int]]] = [{} for _ in docs]
            size = np.zeros(len(docs), np.int64)
            for part in tokenised(decoded(batch.column("raw"))):
                np.add.at(size, part.text, part.count)
                ends, hashes = part.least_pairs(PAIRS)
                hashes, at = hashes.tolist(), 0
                for text, line, end in zip(part.text.tolist(), part.line.tolist(), ends.tolist()):
                    least[text][line] = hashes[at:end]
                    at = end
            rows = []
            lists = batch.column("lines")
            marked_lines = list(zip(*(c.to_pylist() for c in lists.flatten().flatten())))
            ends = np.cumsum(np.diff(lists.offsets.to_numpy())).tolist()
            for n, (doc, begin, end) in enumerate(zip(docs, [0, *ends], ends)):
                marks = marked_lines[begin:end]
                known: dict[tuple, list[int]] = {}
                for keeper in {k for _, _, k in marks} - {None, doc}:
                    rest = [(line, often) for line, often, k in marks if k != keeper]
                    rarest = min((often for _, often in rest), default=0)
                    own = tuple(sorted(line for line, often in rest if often <= 2 * rarest))
                    if own not in known:
                        known[own] = sorted(set().union(*(least[n][line] for line in own)))[:PAIRS]
                    rows.append((doc, keeper, known[own], size[n]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()))], ["doc", "keeper", "own", "size"])

    rows = texts.join(lines, "doc")
    rows = (rows.dropDuplicates(["doc"]) if repeated else rows).select("doc", "raw", "lines")
    return rows.mapInArrow(each, "doc long, keeper long, own array<long>, size long")


def _apart(pairs: np.ndarray, row: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(pairs.view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _copies(own: DataFrame, texts: DataFrame) -> DataFrame:
    """(keeper, own, size) of documents that are copies of the keeper: their own text stands there."""
    groups = spread(own.distinct(), ["keeper"], F.struct("own", "size"), HOLDERS).groupBy("keeper", "sub").agg(F.collect_list(F.struct("own", "size")).alias("holders"))
    rows = groups.join(texts.withColumnRenamed("doc", "of"), F.col("keeper") == F.col("of")).select("keeper", "raw", "holders")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # pairs of a keeper's text, told apart by its row
            size, there = np.zeros(batch.num_rows, np.int64), [np.empty(0, np.uint64)]
            for part in tokenised(decoded(batch.column("raw"))):
                np.add.at(size, part.text, part.count)
                which, pairs = part.pairs()
                there.append(_apart(pairs, part.text[which]))
            holders = batch.column("holders")
            row = np.repeat(np.arange(batch.num_rows), np.diff(holders.offsets.to_numpy()))
            own, sizes = holders.flatten().flatten()
            width, lengths = np.diff(own.offsets.to_numpy()), sizes.to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(width)), width)
            found = np.isin(_apart(own.flatten().to_numpy(), row[of]), np.unique(np.concatenate(there)))
            like = np.bincount(of, found, len(width)) >= COPY * width
            like &= np.maximum(size[row], lengths) <= LONGER * np.minimum(size[row], lengths)
            at = pa.array(np.flatnonzero(like))
            yield pa.RecordBatch.from_arrays([batch.column("keeper").take(pa.array(row[like])), own.take(at), sizes.take(at)], ["keeper", "own", "size"])

    with small_batches(texts.sparkSession, 64):
        return scratch(texts.sparkSession).write(rows.mapInArrow(each, "keeper long, own array<long>, size long").distinct(), "copies")


def recurring(keyed: DataFrame, lines: DataFrame, plain: bool = False) -> DataFrame:
    """``(doc, line)`` of every line to drop: its template recurs, and its document is no
    copy of the keeper.

    Every holder is compared with the keeper alone, so work grows with the lines; holders
    with equal own text are compared once.
    """
    store = scratch(keyed.sparkSession)
    repeated = not plain and not lines.where("lines > 0").groupBy("doc").count().where("count > 1").isEmpty()
    several = shared(keyed, lines, plain, repeated)
    texts = keyed.where("raw is not null").select("doc", "raw")
    marked = lines.join(several.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left")
    marked = store.write(marked.select("doc", "line", "tokens", "template", "keeper", F.coalesce("docs", F.lit(1)).alias("docs")), "marked")
    own = store.write(_own_text(marked, texts, repeated), "own")
    unlike = own.join(_copies(own.select("keeper", "own", "size"), texts), ["keeper", "own", "size"], "left_anti").select("doc", "keeper", F.get("own", F.lit(0)).alias("sig"))
    apart = store.write(marked.where("keeper <> doc").join(unlike, ["doc", "keeper"]).select("doc", "line", "tokens", "template", "sig"), "apart")
    # the keeper is one, and copies of one document agree in the least pair of their own text;
    # documents without any, mere parts of the keeper, are one together
    often = store.write(
        apart.select("template", "tokens", F.coalesce("sig", F.lit(0)).alias("sig")).distinct().groupBy("template")
        .agg((F.count("*") + 1).alias("unlike"), F.max("tokens").alias("tokens"))
        .where((F.col("unlike") >= UNLIKE) & (F.col("unlike") * F.col("tokens") >= TOKENS)).select("template"),
        "often",
    )
    few = often.limit(BROADCAST + 1).count() <= BROADCAST
    return apart.join(F.broadcast(often) if few else often, "template").select("doc", "line")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines whose templates recur across documents.

    Lines are parsed by a tree of fixed depth: token count, then leading tokens, then
    the template in the leaf that agrees in ``ALIKE`` of the tokens.  Tokens with a
    digit, an ``@`` or ``://`` and tokens that vary within a template are variable
    fields.  A template recurs if ``UNLIKE`` or more documents have it that are no copies
    of each other and hold ``TOKENS`` of its tokens or more together.  The document with
    the smallest id keeps its lines, and so do copies of that document; all others lose
    theirs, so nothing is lost from the corpus.  A copy is told by its own text, the rarest
    of its lines that have another keeper: most of its token pairs stand in the keeper's
    text too.  A document whose own text is new is no copy, be it one word.  What only
    copies of one document share is not a template; those are left to near-duplicate stages.

    Null and empty texts stay as they are, lines without tokens are never dropped.
    Repeated rows (same id and text) count as several documents but are treated
    alike.  Bytes that are no UTF-8 count as the replacement character.  Ids may be of any
    type that can be ordered.  An empty table gives an empty result; all columns of ``docs``
    are kept.  Adds n_lines (lines with tokens) and n_dropped, in place of any columns so named.
    """
    store = scratch(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    # whole numbers that differ name documents by themselves, others do so with their text
    plain = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    plain = plain and docs.groupBy(F.col(id_col).alias("id")).count().where("count > 1 or id is null").isEmpty()
    doc = F.col(id_col).cast("long") if plain else F.xxhash64(id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("id"), doc.alias("doc"), F.col(text_col).cast("binary").alias("raw"))
    lines = store.write(_lines(keyed), "lines")
    drops = recurring(keyed, lines, plain).groupBy("doc").agg(F.collect_set("line").alias("drop"))
    count = lines.where("lines > 0").select("doc", "lines").distinct()
    drops = store.write(count.join(drops, "doc", "left").withColumnRenamed("doc", "of"), "drops")
    parts = docs.select(F.struct(*[c for c in columns if c != text_col], F.lit(0).alias("0")).alias("row"), doc.alias("doc"), F.split(text_col, "\n").alias("parts"))
    joined = parts.join(drops, F.col("doc") == F.col("of"), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drop"))
    text = F.array_join(F.when(F.col("drop").isNull(), F.col("parts")).otherwise(F.transform(stay, lambda i: F.get(F.col("parts"), i))), "\n")
    return joined.select(
        *[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns],
        F.coalesce("lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped"),
    )

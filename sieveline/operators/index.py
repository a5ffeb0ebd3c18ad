"""A stored inverted index: postings in blocks with bounds, so that a search reads only blocks that can hold a hit."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..shared import cut

#: Documents of a block, and parts that blocks are dealt into: what a replacement rewrites.
BLOCK_DOCS, PARTS = 128, 32
#: Texts counted at a time.
STEP = 1000
#: Pieces of a part, by block, that are sorted and written apart.
PIECES = 8
#: Blocks of each query that are scored before any is left out.
FIRST = 4
K1, B = 1.2, 0.75
#: What rounding to six digits may move a score by, and a little more.
SLACK = 2e-6

#: Postings of a term in a block: a document's place there, and from bit ``AT`` on its frequency. The term ``""``, which no text holds, has the block's documents.
PACKED = "term string, block long, n int, most_tf int, least_dl int, hits array<long>, ids array<long>, dls array<int>"
BLOCKS = PACKED + ", part int, gen int"
AT = 24


@dataclass
class Index:
    """An index under a folder: ``blocks``, by part and generation; ``manifest`` names each part's current one."""

    spark: SparkSession
    root: str

    def _parts(self) -> list[tuple[int, int]]:
        """Part and current generation: at most ``PARTS`` pairs."""
        at = f"{self.root}/manifest"
        if not _exists(self.spark, at):
            return []
        m = self.spark.read.schema("part int, gen int, version int").parquet(at)
        last = m.agg(F.max("version")).first()[0]
        return sorted((r["part"], r["gen"]) for r in m.where(F.col("version") == last).collect() if r["part"] >= 0)

    def _blocks(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], BLOCKS)
        paths = [f"{self.root}/blocks/part={p}/gen={g}" for p, g in parts]
        return self.spark.read.schema(BLOCKS).option("basePath", f"{self.root}/blocks").parquet(*paths)

    def blocks(self) -> DataFrame:
        return self._blocks(self._parts()).where("term <> ''")

    def docs(self) -> DataFrame:
        """``id, dl, block, part``."""
        return _documents(self._blocks(self._parts()))

    def _placed(self, docs: DataFrame, block_docs: int) -> DataFrame:
        """Documents (``id, text``) dealt into blocks of neighbours in length: the blocks' postings, and their documents.

        A text is counted where it is read; its words and their numbers, in one
        row, are dealt out once, and packed where the block's documents meet.
        """
        # tokens of the operators' text.tokens, found in Python: no word is a row, or goes there as one
        low = docs.select("id", F.lower("text").cast("binary").alias("text")).where("text is not null")
        counted = cut(low.mapInArrow(_counted, "id long, dl int, terms array<string>, tfs array<int>"), "counted")
        dealt = counted.repartitionByRange("dl", "id").sortWithinPartitions("dl", "id")
        return dealt.mapInArrow(lambda batches: _packed(batches, block_docs), PACKED)

    def add(self, docs: DataFrame, *, block_docs: int = BLOCK_DOCS) -> None:
        """Write documents (``id, text``) that the index does not hold yet: see :meth:`replace`."""
        self.replace(docs, None, block_docs=block_docs)

    def replace(self, docs: DataFrame, gone: DataFrame | None = None, *, block_docs: int = BLOCK_DOCS) -> None:
        """Put documents (``id, text``) in place of those of the same id, and take out the documents ``gone`` (``id``).

        Only parts that hold a replaced or removed document, or get a new one,
        are written again; the others stay as they are. Readers see the old
        parts until the new manifest is there, so a failed run changes nothing.
        Rows without an id are left out; of rows that repeat one, the first by text stays.
        """
        ship_package(self.spark)
        now = self._parts()
        version = max((g for _, g in now), default=-1) + 1
        docs = _single(docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "text"))
        new = self._placed(docs, block_docs)
        part = F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int")
        piece = F.pmod(F.xxhash64(F.lit(1), "block"), F.lit(PIECES))
        touched: set[int] = set()
        if now:
            out = docs.select("id") if gone is None else docs.select("id").unionByName(gone.select(F.col("id").cast("long").alias("id"))).distinct()
            held = self.docs()
            leave = cut(held.join(out, "id").groupBy("part", "block").agg(F.sort_array(F.collect_list("id")).alias("ids")), "leave")
            # blocks of this version are numbered behind all earlier ones
            new = cut(new.withColumn("block", F.col("block") + F.lit(held.agg(F.max("block")).first()[0] + 1)), "new")
            touched = {r[0] for r in new.where("term = ''").select(part.alias("part")).union(leave.select("part")).distinct().collect()}
        new = new.withColumn("part", part)
        if mine := [x for x in now if x[0] in touched]:
            # a block's documents that leave stand before its postings
            marks = leave.select("part", *[(F.array() if "array" in t else F.lit(None)).cast(t).alias(c) if c not in ("block", "ids") else F.col(c) for c, t in (x.split() for x in PACKED.split(", "))])
            both = self._blocks(mine).drop("gen").unionByName(new).unionByName(marks)
            new = both.repartition("part", piece).sortWithinPartitions("part", "block", "term").mapInArrow(_kept, PACKED + ", part int")
        else:
            new = new.repartition("part", piece)
        new = new.withColumn("gen", F.lit(version)).sortWithinPartitions("part", "gen")
        new.write.mode("append").partitionBy("part", "gen").parquet(f"{self.root}/blocks")
        left = self.spark.read.schema(BLOCKS).parquet(f"{self.root}/blocks").where((F.col("gen") == version) & (F.col("term") == "")) if _exists(self.spark, f"{self.root}/blocks") else None
        written = sorted(r[0] for r in left.select("part").distinct().collect()) if left is not None else []
        parts = [(p, g, version) for p, g in now if p not in touched] + [(p, version, version) for p in written]
        rows = self.spark.createDataFrame(parts or [(-1, version, version)], "part int, gen int, version int")
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def search(self, queries: DataFrame, k: int, *, first: int = FIRST) -> DataFrame:
        """``query_id, id, score, rank``: each query's best ``k`` by BM25 (ties to smaller ids). ``queries``: ``query_id, term``."""
        return self.searched(queries, k, first=first)[0]

    def searched(self, queries: DataFrame, k: int, *, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """:meth:`search`, and ``query_id, postings, read``: postings of each query's terms, and those in blocks that were read.

        A block's largest term frequency and smallest length bound what a term
        can add there. The blocks of largest bounds are scored first; a block
        whose bound is below the kth score so found cannot hold a hit, and its
        postings are not joined.
        """
        stats = self.docs().agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        terms = queries.distinct()
        # written, so that their size is known before blocks would be dealt out to meet them
        asked = cut(terms.select("term").distinct(), "terms")
        blocks = self.blocks().join(asked, "term", "left_semi")
        held = self._blocks(self._parts()).where("term = ''").select("block", "ids", "dls")
        mine = cut(blocks.select("term", "block", "n", "most_tf", "least_dl"), "heads")
        df = mine.groupBy("term").agg(F.sum("n").alias("df"))
        # one row of two numbers
        weighed = cut(terms.join(df, "term").join(F.broadcast(stats)).withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)), "weights")
        bound = F.col("idf") * _tf(F.col("most_tf"), F.col("least_dl"), F.col("avgdl"))
        bounds = mine.join(weighed, "term").groupBy("query_id", "block").agg(F.sum(bound).alias("bound"), F.sum("n").alias("n"))
        bounds = cut(bounds, "bounds")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
        before = cut(bounds.withColumn("r", place).where(F.col("r") <= first).select("query_id", "block", "n"), "first")
        best = cut(_scored(blocks, held, before, weighed), "best")
        floor = _top(best, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = bounds.join(before.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left")
        rest = cut(rest.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).select("query_id", "block", "n"), "rest")
        hits = _top(best.unionByName(_scored(blocks, held, rest, weighed)), k)
        read = before.unionByName(rest).groupBy("query_id").agg(F.sum("n").alias("read"))
        counts = bounds.groupBy("query_id").agg(F.sum("n").alias("postings")).join(read, "query_id")
        return hits, counts


def _scored(blocks: DataFrame, docs: DataFrame, asked: DataFrame, weighed: DataFrame) -> DataFrame:
    """Scores of the documents (``block, ids, dls``) of some blocks (``query_id, block``)."""
    on = ["query_id", "block"]
    asked = asked.select(*on)
    # blocks go to where their queries are, packed; a document's scores are added up there
    each = blocks.select("term", "block", "hits").join(weighed, "term").join(asked, on, "left_semi").join(asked.join(docs, "block"), on)
    at = lambda h: h.bitwiseAND(F.lit((1 << AT) - 1)).cast("int")
    hit = F.transform("hits", lambda h: F.struct(F.get("ids", at(h)).alias("id"), F.shiftright(h, AT).alias("tf"), F.get("dls", at(h)).alias("dl")))
    each = each.select(*on, "idf", "avgdl", F.explode(hit).alias("p"))
    part = F.col("idf") * _tf(F.col("p.tf"), F.col("p.dl"), F.col("avgdl"))
    return each.groupBy(*on, F.col("p.id").alias("id")).agg(F.round(F.sum(part), 6).alias("score")).drop("block")


def _tf(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's frequency counts; grows with it, and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _top(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def _single(docs: DataFrame) -> DataFrame:
    """One row an id; of rows that repeat one, the first by text. Only these are dealt out with their texts."""
    again = cut(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        return docs
    return docs.join(again, "id", "left_anti").unionByName(docs.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


def _documents(blocks: DataFrame) -> DataFrame:
    each = blocks.where("term = ''").select("block", "part", F.explode(F.arrays_zip("ids", "dls")).alias("d"))
    return each.select(F.col("d.ids").alias("id"), F.col("d.dls").alias("dl"), "block", "part")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of an id and its text in lower case to ``id, dl, terms, tfs``: distinct words, and how often each stands there."""
    words = re.compile(rb"[a-z0-9]+")
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            rows = batch.slice(start, STEP)
            counts = [Counter(words.findall(text.as_py())) for text in rows.column(1)]
            some = np.array([i for i, c in enumerate(counts) if c], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(counts[i]) for i in some])]).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string()))
            tfs = pa.ListArray.from_arrays(ends, pa.array([n for c in counts for n in c.values()], pa.int32()))
            dls = pa.array([counts[i].total() for i in some], pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(some)), dls, terms, tfs], names=["id", "dl", "terms", "tfs"])


def _packed(batches: Iterable[pa.RecordBatch], block_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_counted` in their order, to blocks of ``block_docs`` documents; a partition's are numbered from its number times 2**33."""
    number = TaskContext.get().partitionId() << 33
    held: list[pa.RecordBatch] = []
    rows = 0

    def block(docs: pa.Table) -> Iterator[pa.RecordBatch]:
        docs = docs.combine_chunks()
        ids, dls = docs.column("id").to_numpy(), docs.column("dl").to_numpy()
        lists, tfs = docs.column("terms").combine_chunks(), docs.column("tfs").combine_chunks().flatten().to_numpy()
        words = lists.flatten().dictionary_encode()
        doc, term = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), words.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        doc, term, tfs = doc[order], term[order], tfs[order]
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        yield _documents_row(number, ids, dls)
        yield _term_rows(words.dictionary.take(pa.array(term[heads])), pa.array(np.full(len(heads), number)), heads, doc, tfs, dls[doc])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= block_docs:
            docs = pa.Table.from_batches(held)
            for at in range(0, rows - rows % block_docs, block_docs):
                yield from block(docs.slice(at, block_docs))
                number += 1
            rest = docs.slice(rows - rows % block_docs)
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield from block(pa.Table.from_batches(held))


_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _documents_row(block: int, ids: np.ndarray, dls: np.ndarray, more: tuple = ()) -> pa.RecordBatch:
    """The row of :data:`PACKED` that holds a block's documents."""
    numbers = [pa.array([x], pa.int32()) for x in (len(ids), 0, int(dls.min()))]
    lists = [pa.array([[]], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([dls], pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([""]), pa.array([block], pa.int64()), *numbers, *lists, *more], names=_NAMES + ["part"] * len(more))


def _term_rows(terms: pa.Array, blocks: pa.Array, heads: np.ndarray, at: np.ndarray, tfs: np.ndarray, dls: np.ndarray, more: tuple = ()) -> pa.RecordBatch:
    """Rows of :data:`PACKED`: where each row's postings begin, and of each posting the document's place, frequency and length."""
    ends = np.append(heads, len(at))
    hits = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at | tfs.astype(np.int64) << AT))
    numbers = [np.diff(ends), np.maximum.reduceat(tfs, heads), np.minimum.reduceat(dls, heads)]
    # not null: Spark fills nulls of lists anew for every row that it sends to Python
    none = [pa.ListArray.from_arrays(pa.array(np.zeros(len(heads) + 1, np.int32)), pa.array([], t)) for t in (pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays([terms, blocks, *(pa.array(x.astype(np.int32)) for x in numbers), hits, *none, *more], names=_NAMES + ["part"] * len(more))


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, in order of block and term, without the documents that leave, which a row without a term names before its block's others."""
    block, leaving = None, None
    stay = place = lengths = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy()
        edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        for first, end in zip(edges.tolist(), [*edges[1:].tolist(), len(blocks)], strict=True):
            rows = batch.slice(first, end - first)
            if blocks[first] != block:
                block, leaving = int(blocks[first]), None
            if not rows.column("term")[0].is_valid:
                leaving, rows = rows.column("ids")[0].values.to_numpy(), rows.slice(1)
            if leaving is None:
                yield rows
                continue
            if rows.num_rows and rows.column("term")[0].as_py() == "":
                ids, lengths = (rows.column(c)[0].values.to_numpy() for c in ("ids", "dls"))
                stay = ~np.isin(ids, leaving)
                place = stay.cumsum() - 1
                if stay.any():
                    yield _documents_row(block, ids[stay], lengths[stay], (rows.column("part").slice(0, 1),))
                rows = rows.slice(1)
            if not rows.num_rows:
                continue
            hits = rows.column("hits").flatten().to_numpy()
            at, tfs = hits & (1 << AT) - 1, hits >> AT
            row = np.repeat(np.arange(rows.num_rows), rows.column("hits").value_lengths().to_numpy())
            keep = stay[at]
            at, tfs, row = at[keep], tfs[keep], row[keep]
            if len(row):
                heads = np.flatnonzero(np.diff(row, prepend=-1))
                terms, of, parts = (rows.column(c).take(pa.array(row[heads])) for c in ("term", "block", "part"))
                yield _term_rows(terms, of, heads, place[at], tfs, lengths[at], (parts,))


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)

"""N-gram Jaccard join by parity sketches.

A document is its set of word shingles. Every shingle flips one bit of a sketch, so that two sketches differ
in at most as many bits as the sets have shingles apart. Similarity over the threshold bounds that number by
``d = share * (a + b)`` for sizes a and b, and the join rests on it twice:

* Candidates. In each band of sizes (powers of two) the sketch is cut into more than ``d`` lanes of 2**20 bits,
  stored sparsely as one 64-bit word each: the XOR of the words of the bits set. A shingle apart spoils one
  lane, so all but d lanes agree (pigeonhole), and then the d + l least lane words of both documents have l in
  common. Only these are counted. A word that no other set has can't be shared; a document with fewer than l
  others has no partner, and the l - 1 most frequent of its words may go, since a shared one is left. So a
  passage that many documents quote, which fills a few lanes alike, makes no candidates. A document near its
  band's upper end joins in the next band as well. If it has too few lanes with shingles for the argument, it
  keeps all words and joins on every single shingle besides.
* Filter. A folded sketch of 1,024 bits has a Hamming distance that is no more than the sets' difference; pairs
  above d go before any text is fetched.

What is left is a graph of near sets. A word of two classes gives its pair; the classes of a longer list are dealt
into blocks, and the folded sketches of each two blocks are compared in numpy, which passes on a spanning forest
and not all pairs. The components of that graph are clusters. Every link lies inside one, and there each two
classes are compared once, block by block, by exact intersection where their sketches are near and nothing has
joined them yet; what leaves is again a spanning forest. So rows grow with the classes of a dense group, times its
blocks, and not with its pairs. A block holds about 1,024 classes, or more where a list would be dealt into more than
64 blocks, and, in clusters, about 8 MB of shingles at most beside its longest set.

Equal sets meet as one class, known by two 64-bit hashes. Of classes that agree in the first alone, each gets a
name of its own.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are their own component.
A text with fewer words than a shingle is one shingle. Rows that share an id keep their own rows and are
judged by their own texts. Empty tables give empty tables. Further columns don't take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import Workspace, add_columns, bound_batches, pieces, text_bytes
from lumenfold.llm.components import components
from lumenfold.llm.words import find_words, mix, windows

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_U = np.uint64
FOLDED = 1024
#: About how many classes make a block, and the most blocks; a group with more classes has larger blocks.
BLOCK, MOST_BLOCKS = 1024, 64
#: A group's pivots are its classes whose hash is least after each of these flips.
PIVOTS = tuple(int(v) for v in mix(np.arange(1, 9, dtype=np.uint64)).view(np.int64))
#: About the most shingles of a cluster's block (8 MB).
BLOCK_SHINGLES = 1 << 20
SIGNATURE = T.StructType(
    [
        T.StructField("cls", T.LongType()),
        T.StructField("other", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("folded", T.ArrayType(T.LongType())),
        T.StructField("bands", T.ArrayType(T.StructType([T.StructField("band", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]))),
    ]
)
_BANDS = pa.list_(pa.struct([("band", pa.int32()), ("need", pa.int32()), ("keys", pa.list_(pa.int64()))]))


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; linked at ``percent`` / 100 similarity or more."""

    words: int = 5
    percent: int = 80

    def apart(self, a: int, b: int) -> int:
        """The most shingles that linked sets of sizes a and b can have apart."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def apart_sql(self, a: str, b: str) -> str:
        return f"floor({100 - self.percent} * ({a} + {b}) / {100 + self.percent})"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    found = find_words(_LOWER[data], offsets)
    rolled, same = windows(found, words)
    n = len(offsets) - 1
    first = np.searchsorted(found.doc, np.arange(n + 1))
    sets = []
    for i in range(n):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= words:
            sets.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            whole = mix(np.array([hi - lo], _U))
            for h in found.hash[lo:hi]:
                whole = mix(whole * _U(0x9E3779B97F4A7C15) + h)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, _U))
    return sets


def lane_words(shingles: np.ndarray, band: int, lanes: int) -> np.ndarray:
    """The words of all lanes that hold a shingle, lane and band mixed in."""
    spread = mix(shingles ^ _U((band + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
    lane = ((spread >> _U(32)) * _U(lanes)) >> _U(32)
    bit = spread & _U((1 << 20) - 1)
    order = np.argsort(lane, kind="stable")
    lane = lane[order]
    first = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1])))
    place = (lane << _U(20)) | (_U(band) << _U(52))
    joined = np.bitwise_xor.reduceat(mix((place | bit[order]) + _U(1)), first)
    return mix(joined ^ mix(place[first] + _U(0x632BE59BD9B4E019)))


def join_keys(shingles: np.ndarray, join: Join) -> list[dict]:
    """For each band that this set joins in: how many words it must share, and its words."""
    n = len(shingles)
    most = 100 * n // join.percent
    out = []
    for band in range(n.bit_length() - 1, most.bit_length()):
        low, top = 1 << band, (2 << band) - 1
        widest = join.apart(top, top)
        need = 1 + join.apart(low, 100 * low // join.percent) // 4
        words = lane_words(shingles, band, widest + widest // 16 + need + 2)
        size = join.apart(n, min(most, top)) + need
        if len(words) >= size:
            keys = np.partition(words, size - 1)[:size]
        else:
            need, keys = 1, np.concatenate((words, mix(shingles ^ _U(0xA0761D6478BD642F))))
        out.append({"band": band, "need": need, "keys": np.unique(keys).view(np.int64)})
    return out


def fold(shingles: np.ndarray) -> np.ndarray:
    flips = np.bincount((mix(shingles + _U(0x2545F4914F6CDD1D)) % _U(FOLDED)).astype(np.int64), minlength=FOLDED)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def sign(documents: DataFrame, join: Join, keep: list[str]) -> DataFrame:
    """Class hashes, size, folded sketch and join keys of each text; nulls where there is no shingle."""

    def compute(texts: pa.Array) -> list:
        data, offsets = text_bytes(texts)
        cls, other, size, folded, bands = [], [], [], [], []
        for i, j in pieces(offsets):
            for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], join.words):
                size.append(len(s))
                cls.append(int((mix(s + _U(77)).sum() ^ np.bitwise_xor.reduce(mix(s))).view(np.int64)) if len(s) else None)
                other.append(int(mix(s + _U(0xB5297A4D3F84D5A7)).sum().view(np.int64)) if len(s) else None)
                folded.append(fold(s) if len(s) else None)
                bands.append(join_keys(s, join) if len(s) else None)
        return [pa.array(cls, pa.int64()), pa.array(other, pa.int64()), pa.array(size, pa.int64()), pa.array(folded, pa.list_(pa.int64())), pa.array(bands, _BANDS)]

    return add_columns(documents, ["text"], SIGNATURE, compute, keep)


def _hamming(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _sides(signed: DataFrame) -> DataFrame:
    """Each class once: size, folded sketch, the least and greatest of its second hashes, and one of its rows."""
    found = signed.where("cls is not null").groupBy("cls")
    return found.agg(
        F.first("n").alias("n"), F.first("folded").alias("folded"), F.min("other").alias("low"), F.max("other").alias("high"), F.min(F.struct("doc_id", "row")).alias("at")
    )


def _live_words(signed: DataFrame, work: Workspace) -> DataFrame:
    """(key, cls) of the lane words that can show a link."""
    rows = signed.where("cls is not null").select("cls", F.inline("bands")).select("cls", "band", "need", F.explode("keys").alias("key"))
    # Words that only a class's own copies share count too; they are left with one class and go with the lists.
    counts = work.save(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "counts")
    shared = work.save(rows.join(counts, "key").distinct(), "shared")
    by_set = Window.partitionBy("cls", "band")
    common_first = F.row_number().over(by_set.orderBy(F.desc("times"), "key"))
    kept = shared.withColumn("place", common_first).withColumn("words", F.count("*").over(by_set))
    return kept.where("words >= need and place >= need").select("key", "cls")


def _dealt(rows: DataFrame, group: str, blocks: Column, keep: list[str]) -> DataFrame:
    """Rows of each group side by side for each two of its blocks (i, j); ``own`` is a row's own block.

    A class's block comes from its hash, and each row is sent to every block that it is compared with.
    """
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    rows = rows.withColumn("blocks", blocks.cast("bigint")).withColumn("own", own)
    rows = rows.select(group, "own", *keep, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("with"))
    rows = rows.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))
    rows = rows.select(F.xxhash64(group, "i", "j").alias("both"), (F.col("i") == F.col("j")).alias("same"), "own", *keep, group, "i", "j")
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "own").drop(group, "i", "j")


def _blocks(m: Column, shingles: Column | None = None) -> Column:
    """So many blocks for a group of ``m`` classes, which hold so many shingles together where their sets go along."""
    by_classes = F.least(F.ceil(m / BLOCK), F.lit(MOST_BLOCKS))
    return by_classes if shingles is None else F.greatest(by_classes, F.ceil(shingles / BLOCK_SHINGLES))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, no group (of equal ``both``) cut."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("both").to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        open_from = int(np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[-1])
        if open_from or (waiting and waiting[-1].column("both")[-1].as_py() != ids[0]):
            yield pa.Table.from_batches([*waiting, batch.slice(0, open_from)])
            waiting = []
        waiting.append(batch.slice(open_from))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _near_sketches(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, join: Join) -> np.ndarray:
    """Whether sets of these sizes and sketches can be linked."""
    near = (100 + join.percent) * np.bitwise_count(a ^ b).sum(-1) <= (100 - join.percent) * (n_a + n_b)
    return near & (100 * np.minimum(n_a, n_b) >= join.percent * np.maximum(n_a, n_b))


def _comparer(rows: pa.Table, join: Join, exact: bool) -> Callable[[int, int], bool]:
    """Whether two near rows are joined: always, or with ``exact`` if their sets are linked."""
    sets = [np.frombuffer(s.as_buffer(), _U) for s in rows.column("set")] if exact else []

    def joins(p: int, q: int) -> bool:
        if not exact:
            return True
        shared = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
        return 100 * shared >= join.percent * (len(sets[p]) + len(sets[q]) - shared)

    return joins


def _round(rows: pa.Table, join: Join, exact: bool) -> pa.RecordBatch:
    """(of, cls, rep, member): each row of a block of members, and of the pivots before them, with the least pivot that it is joined with."""
    both, of, turn, cls, n = (rows.column(c).to_numpy() for c in ("both", "of", "turn", "cls", "n"))
    folded = rows.column("folded").combine_chunks().flatten().to_numpy().view(_U).reshape(len(cls), -1)
    joins, root = _comparer(rows, join, exact), np.arange(len(cls))
    none = np.iinfo(np.int64).max
    begins = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    for begin, end in zip(begins, np.append(begins[1:], len(cls))):
        for p in range(begin, begin + int((turn[begin:end] == 0).sum())):
            later = np.arange(p + 1, end)
            for q in later[_near_sketches(folded[p], folded[later], n[p], n[later], join)].tolist():
                if root[p] != root[q] and joins(p, q):
                    root[begin:end][root[begin:end] == root[q]] = root[p]
    rep = np.full(len(cls), none)
    np.minimum.at(rep, root[turn == 0], cls[turn == 0])
    rep = rep[root]
    return pa.RecordBatch.from_arrays([pa.array(of), pa.array(cls), pa.array(rep, mask=rep == none), pa.array(turn == 1)], names=["of", "cls", "rep", "member"])


def _settled(rows: DataFrame, group: str, keep: list[str], join: Join, exact: bool, work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """Edges that join the rows of each group with its pivots, and for rows(group, blocks, ``keep``) whether they are ``settled``: all those are one component.

    PIVOTS of a group's classes, by hash, go to each of its blocks, where every row is compared with them: rows move once, and
    pivots as often as there are blocks. Settled are the rows of the pivot that joins the most.
    """
    bound_batches(rows.sparkSession)
    chosen = rows.groupBy(group).agg(F.max("blocks").alias("blocks"), *(F.min(F.col("cls").bitwiseXOR(F.lit(x))).alias(f"p{k}") for k, x in enumerate(PIVOTS)))
    chosen = chosen.select(group, "blocks", F.explode(F.array_distinct(F.array(*(F.col(f"p{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(PIVOTS))))).alias("cls"))
    data = [c for c in keep if c != "cls"]
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    pivots = chosen.join(rows.select(group, *keep), [group, "cls"]).select(group, every, F.lit(0).alias("turn"), "cls", *data)
    members = rows.select(group, F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), F.lit(1).alias("turn"), "cls", *data)
    dealt = members.union(pivots).repartition(group, "block").sortWithinPartitions(group, "block", "turn")
    dealt = dealt.select(F.xxhash64(group, "block").alias("both"), F.col(group).alias("of"), "turn", "cls", *data)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            yield _round(table, join, exact)

    found = work.save(dealt.mapInArrow(compare, "of long, cls long, rep long, member boolean"), f"{name}-pivots")
    counts = found.where("member and rep is not null").groupBy("of", "rep").agg(F.count("*").alias("n"))
    main = counts.groupBy("of").agg(F.max_by("rep", F.struct("n", "rep")).alias("main"))
    told = found.where("member").join(main, "of", "left").select(F.col("of").alias(group), "cls", F.coalesce(F.col("rep") == F.col("main"), F.lit(False)).alias("settled"))
    edges = found.where("rep is not null and rep != cls").select(F.col("rep").alias("a"), F.col("cls").alias("b")).distinct()
    return edges, work.save(told, f"{name}-settled")


def _grouped(rows: DataFrame, group: str, keep: list[str], join: Join, exact: bool, work: Workspace, name: str) -> DataFrame:
    """(a, b): edges that span the near (or with ``exact`` the linked) classes of each group of rows(group, blocks, ``keep``).

    A group of one block is compared as it is. A larger one first meets its pivots; what they settle is one component, so only
    the rest is compared, with itself and with the settled, block by block. In a dense group that rest is small or nothing.
    """
    few = _spanning(_dealt(rows.where("blocks = 1"), group, F.col("blocks"), keep), join, exact)
    many = work.save(rows.where("blocks > 1"), f"{name}-many")
    edges, told = _settled(many, group, keep, join, exact, work, name)
    sizes = told.join(many.select(group, "cls", "n"), [group, "cls"]).groupBy(group).agg(
        F.count_if("settled").alias("s"), F.count_if(~F.col("settled")).alias("l"), F.sum(F.when(F.col("settled"), F.col("n"))).alias("n_s"), F.sum(F.when(~F.col("settled"), F.col("n"))).alias("n_l")
    )
    s, rest = (_blocks(F.col(c), F.col(f"n_{c}") if exact else None).cast("bigint") for c in "sl")
    sizes = sizes.where("l > 0").select(group, F.when(F.col("s") > 0, s).otherwise(0).alias("with_s"), rest.alias("with_l"))
    open_ = many.drop("blocks").join(told, [group, "cls"]).join(sizes, group)
    open_ = work.save(open_, f"{name}-open")
    own = {c: F.pmod(F.xxhash64("cls"), F.col(f"with_{c}")) for c in "sl"}

    def every(c: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"with_{c}") - 1))

    settled = open_.where("settled").withColumn("i", own["s"]).withColumn("j", every("l")).withColumn("own", F.lit(-1).cast("bigint"))
    loose = open_.where("not settled and with_s > 0").withColumn("j", own["l"]).withColumn("i", every("s")).withColumn("own", F.col("j"))
    both = settled.unionByName(loose).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "own")
    both = both.select(F.xxhash64(F.lit("settled"), group, "i", "j").alias("both"), F.lit(False).alias("same"), "own", *keep, "settled")
    left = _spanning(_dealt(open_.where("not settled"), group, F.col("with_l"), keep), join, exact)
    return few.union(edges).union(_spanning(both, join, exact)).union(left)


def _forest(rows: pa.Table, join: Join, exact: bool) -> pa.RecordBatch:
    """(a, b): edges that span the near classes of each group; with ``exact``, the linked ones by their ``set``.

    Each row is compared with the first, second, ... row after it while that is of the same group, and near ones are
    joined. In a group of two blocks, each block is joined by itself first, without a word, since (i, i) tells of
    that; only what is then joined across the two is told. The edges of a joined part are a star.
    """
    both, same, own, cls, n = (rows.column(c).to_numpy() for c in ("both", "same", "own", "cls", "n"))
    folded = rows.column("folded").combine_chunks().flatten().to_numpy().view(_U).reshape(len(cls), -1)
    joins, root = _comparer(rows, join, exact), np.arange(len(cls))
    if "settled" in rows.column_names:  # those are joined already, and come first in their group
        settled = np.flatnonzero(rows.column("settled").to_numpy())
        begins = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        root[settled] = begins[np.searchsorted(begins, settled, side="right") - 1]

    def merge(across: bool) -> None:
        at, step = np.flatnonzero(~same) if across else np.arange(len(cls)), 0
        while len(at):
            step += 1
            at = at[at + step < len(cls)]
            at = at[both[at] == both[at + step]]
            x = at[(root[at] != root[at + step]) & ((own[at] != own[at + step]) == across)]
            for k in range(0, len(x), 1 << 16):
                a, b = x[k : k + (1 << 16)], x[k : k + (1 << 16)] + step
                near = _near_sketches(folded[a], folded[b], n[a], n[b], join)
                for p, q in zip(a[near].tolist(), b[near].tolist()):
                    if root[p] != root[q] and joins(p, q):
                        root[root == root[q]] = root[p]

    def least(names: np.ndarray) -> np.ndarray:
        """The least of the names in each row's joined part."""
        out = np.full(len(cls), np.iinfo(np.int64).max)
        np.minimum.at(out, root, names)
        return out[root]

    merge(False)
    inner = least(cls)
    merge(True)
    ends = np.where(same, cls, inner)
    star = np.unique(np.stack([least(ends), ends]), axis=1)
    star = star[:, star[0] != star[1]]
    return pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], names=["a", "b"])


def _spanning(dealt: DataFrame, join: Join, exact: bool = False) -> DataFrame:
    """The edges of ``_forest`` over rows from ``_dealt``."""
    bound_batches(dealt.sparkSession)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            yield _forest(rows, join, exact)

    return dealt.mapInArrow(compare, "a long, b long")


def _near(words: DataFrame, side: DataFrame, join: Join, work: Workspace) -> DataFrame:
    """(a, b): edges whose components hold all pairs that share a live word and have near sketches."""
    lists = words.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("a"), F.max("cls").alias("b"))
    lists = work.save(lists.where("m > 1"), "lists")
    sketches = side.select("cls", "n", "folded")
    a, b = (side.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("folded").alias(f"f_{x}")) for x in "ab")
    two = lists.where("m = 2").select("a", "b").distinct().join(a, "a").join(b, "b")
    two = two.where(f"100 * least(n_a, n_b) >= {join.percent} * greatest(n_a, n_b)")
    two = two.where(_hamming("f_a", "f_b") <= F.expr(join.apart_sql("n_a", "n_b"))).select("a", "b")
    more = words.join(lists.where("m > 2").select("key", _blocks(F.col("m")).cast("bigint").alias("blocks")), "key").join(sketches, "cls")
    return work.save(two.union(_grouped(more, "key", ["cls", "n", "folded"], join, False, work, "words")).distinct(), "near")


def _sets(documents: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """(cls, set): the sorted shingle hashes of the wanted (cls, doc_id, row)."""

    def compute(texts: pa.Array) -> list:
        data, offsets = text_bytes(texts)
        found = (s for i, j in pieces(offsets) for s in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], join.words))
        return [pa.array([s.tobytes() for s in found], pa.binary())]

    rows = documents.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text").alias("_row"), "text")
    rows = rows.join(wanted, (F.col("_row") == F.col("row")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    made = add_columns(rows.select("cls", "text"), ["text"], T.StructType([T.StructField("set", T.BinaryType())]), compute, ["cls"])
    return made.groupBy("cls").agg(F.first("set").alias("set"))


def _links(documents: DataFrame, near: DataFrame, side: DataFrame, join: Join, work: Workspace) -> DataFrame:
    """(a, b): links that span each component of linked classes."""
    clusters = components(near, work, "clusters").withColumnRenamed("node", "cls")
    members = work.save(side.join(clusters, "cls").select("cls", "label", "n", "folded", "at.*"), "members")
    sizes = members.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    sets = _sets(documents, members.select("cls", "doc_id", "row"), join)
    blocks = _blocks(F.col("m"), F.col("shingles")).cast("bigint").alias("blocks")
    rows = work.save(members.select("cls", "label", "n", "folded").join(sets, "cls").join(sizes.select("label", blocks), "label"), "sets")
    return work.save(_grouped(rows, "label", ["cls", "n", "folded", "set"], join, True, work, "sets"), "links")


def classes(documents: DataFrame, join: Join, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, cls, n) of all rows, and (node, label) of the classes that link with others."""
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    signed = work.save(sign(rows, join, ["doc_id", "row"]), "signed")
    side = work.save(_sides(signed), "side")
    clash = side.where("low < high").select("cls", F.lit(True).alias("twice"))
    if clash.limit(1).count():
        told = signed.join(clash, "cls", "left").withColumn("cls", F.when(F.col("twice"), F.xxhash64("cls", "other")).otherwise(F.col("cls")))
        signed = work.save(told.drop("twice"), "told-apart")
        side = work.save(_sides(signed), "sides-apart")
    words = work.save(_live_words(signed, work), "words")
    work.drop("counts", "shared")
    links = _links(documents, _near(words, side, join, work), side, join, work)
    labels = components(links, work, "components")
    made = (f"{of}-{what}" for of in ("words", "sets") for what in ("pivots", "settled", "many", "open"))
    work.drop("words", "lists", "near", "members", "sets", "links", *made)
    return signed.select("doc_id", "row", "cls", "n"), labels


def _labelled(documents: DataFrame, join: Join, work: Workspace) -> DataFrame:
    """(doc_id, row, n, label) a row: the component itself, whatever the ids; null without shingles."""
    rows, labels = classes(documents.select("doc_id", "text"), join, work)
    named = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    return work.save(named.select("doc_id", "row", "n", "label"), "labelled")


def link(documents: DataFrame, join: Join | None = None) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) a row: the least id reachable by links."""
    work = Workspace(documents.sparkSession, "ngram-join")
    named = _labelled(documents, join or Join(), work)
    least = work.save(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")), "least")
    out = named.join(least, "label", "left")
    out = out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    out = work.save(out, "result")
    work.drop("signed", "side", "told-apart", "sides-apart", "labelled", "least")
    return out


def keep_one(documents: DataFrame, join: Join | None = None) -> DataFrame:
    """``documents``, all columns as they are, with one row of each component: that of the least (doc_id, row hash)."""
    joined = Workspace(documents.sparkSession, "ngram-join")
    linked = _labelled(documents, join or Join(), joined).where("label is not null")
    joined.drop("signed", "side", "told-apart", "sides-apart")
    mates = linked.groupBy("label").agg(F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("size"))
    mates = mates.where("size > 1")
    work = Workspace(documents.sparkSession, "keep-one")
    mates = work.save(mates, "mates")
    grouped = linked.join(mates, "label")
    losers = work.save(grouped.where(F.struct("doc_id", "row") != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")), "losers")
    rows = documents.select(F.struct("*").alias("own"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("hash"))
    on = (F.col("hash") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))
    left = rows.join(losers, on, "left_anti")
    # A winner may itself be repeated row for row; only then are rows told apart by a shuffle.
    again = grouped.where(F.struct("doc_id", "row") == F.col("best")).groupBy("doc_id", "row").count().where("count > 1")
    again = work.save(again.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")), "again")
    work.drop("mates")
    joined.drop("labelled")
    if again.limit(1).count():
        twice = left.join(again, on, "left_semi").dropDuplicates(["id", "hash"])
        left = left.join(again, on, "left_anti").union(twice)
    return left.select("own.*")

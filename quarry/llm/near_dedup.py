"""MinHash near-dedup with HyperMinHash sketches.

A document's set holds its distinct word shingles (64-bit hashes). The sketch has REGISTERS buckets; each stores, of the least
hash that falls there, the count of leading zeros (6 bits) and the next MANTISSA bits, two bytes in all. Empty buckets borrow
from others by a fixed random order, so any register of two sets agrees with a chance of their similarity. BANDS bands of ROWS
registers are the join keys: two sets with a similarity of 0.8 miss each other in all bands with a chance of 1.3e-7.

Documents with one set form a class, a node with a number of its own; the sets of classes that share a band are computed once, from
one of their documents. Classes that share a band are candidates; the collision-corrected similarity of the sketches prunes them and the full sets decide. In a band key of up to ALL_PAIRS classes all
pairs are candidates. In a larger one each class meets a leader instead, and after links have been joined to components, only
classes of other components meet the next leader; in keys that still hold several components after LEADERS rounds, those outside
the largest are compared with all by inverted lists, after a prefix filter, in a grid of parts of both sides with a bounded number
of sets and shingles, and only links leave the task. So a large group of near copies costs rows in proportion to its size, and no link is lost: a pair
left untested always lies in one component already.

Defined results: null, empty and blank texts have no set and link with nothing; a text of fewer words than a shingle is one
shingle; a row with a null doc_id belongs to the component of its text, and has a null component_id where no row of that has an id;
rows that repeat a doc_id are judged each by its text; an empty table gives no rows; extra columns are not read by
near_duplicates() and pass through keep(), whatever their names; very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.components import components

BANDS, ROWS, MANTISSA = 40, 5, 10
REGISTERS = BANDS * ROWS
ALL_PAIRS, LEADERS = 12, 3
EMPTY = np.uint16(0xFFFF)
_TRIES = 48
_DONORS = np.random.default_rng(20170801).integers(0, REGISTERS, (_TRIES, REGISTERS))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence where it is shorter."""
    words = common.words_of(common.lower_ascii(text)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = common.word_hashes(words)
    return np.unique(common.gram_hashes(h, min(n, len(h))))


def sketch(s: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted set of 64-bit hashes: the first of each bucket is its least."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(s):
        return out
    wide = (s >> np.uint64(32)) * np.uint64(REGISTERS)
    bucket, rest = (wide >> np.uint64(32)).astype(np.int64), (wide & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    bucket, rest = bucket[first], rest[first]
    bits = np.frexp(rest.astype(np.float64))[1]  # rest < 2 ** bits
    zeros = 32 - bits
    low = (rest << np.int64(1 + MANTISSA)) >> np.maximum(bits, 0) & ((1 << MANTISSA) - 1)  # the bits after the leading one
    out[bucket] = (zeros << MANTISSA | low).astype(np.uint16)
    own, gap = out.copy(), np.flatnonzero(out == EMPTY)
    for t in range(_TRIES):
        if not len(gap):
            return out
        given = own[_DONORS[t, gap]]
        out[gap] = given
        gap = gap[given == EMPTY]
    if len(gap):  # the next bucket with a value, round the circle
        at = np.searchsorted(bucket, gap) % len(bucket)
        out[gap] = own[bucket[at]]
    return out


def band_keys(registers: np.ndarray) -> list[int]:
    data = registers.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(data[k].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)]


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of rows of registers, less the agreements that compressed registers of different hashes are expected to show."""
    same = (a == b).mean(1)
    share = 4 * (n / np.maximum(m, 1)) / ((1 + n) / np.maximum(m, 1)) ** 2
    collide = np.minimum(0.169919487159739 * 2.0**-MANTISSA * np.minimum(share, 1), 0.5)
    return np.clip((same - collide) / (1 - collide), 0, 1)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the set, and the sketch of each row."""
    names = ["doc_id", "row_key", "text_key", "n_shingles", "set_key", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                size, key, sk = [], [], []
                for text in part.column(3):
                    s = shingles(text.as_py(), n)
                    size.append(len(s))
                    key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sk.append(sketch(s).tobytes() if len(s) else None)
                own = [pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sk, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *own], names)

    return docs.select("doc_id", *common.identity(), "text").mapInArrow(common.emptied(run), "doc_id long, row_key long, text_key long, n_shingles long, set_key binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                keys = [band_keys(np.frombuffer(x, np.uint16)) for x in part.column(1).to_pylist()]
                nodes = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array([x for ks in keys for x in ks], pa.int64()), pa.array(nodes, pa.int64())], ["key", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "key long, node long")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches do not rule them out: estimates five standard deviations under the threshold go."""
    c = classes.select("node", "sketch", "n_shingles")
    a = c.select(F.col("node").alias("a"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
    b = c.select(F.col("node").alias("b"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(x.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
            na, nb = x.column(4).to_numpy().astype(float), x.column(5).to_numpy().astype(float)
            margin = 2 / np.sqrt(np.minimum(np.minimum(na, nb), REGISTERS))  # five standard deviations
            ok = estimate(sa, sb, na, nb) >= percent / 100 - margin
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(ok))

    return sized.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets meet 100 * |A and B| >= percent * |A or B|."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = []
            for ia, ib in zip(x.column(2), x.column(3), strict=True):
                p, q = np.frombuffer(ia.as_buffer(), np.uint64), np.frombuffer(ib.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common_n = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common_n >= percent * (len(p) + len(q) - common_n))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(node, items): the full sets of classes (node, set_key, row_key, text_key), each from one of its documents."""
    names = ["node", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, node, items = b.slice(k, 256), [], []
                for i, key, text in zip(*part.columns, strict=True):
                    s = shingles(text.as_py(), n).tobytes()
                    if xxhash.xxh3_128_digest(s) == key.as_py():  # rows of one id are told apart by a hash of 64 bits only
                        node.append(i.as_py())
                        items.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(items, pa.binary())], names)

    rows = docs.select(*common.identity(), "text").join(classes, ["row_key", "text_key"]).select("node", "set_key", "text")
    return rows.mapInArrow(common.emptied(run), "node long, items binary").dropDuplicates(["node"])


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _leader_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each row of (key, node, comp) with the key's leader of this turn, where their components differ."""
    rank = F.xxhash64("node", F.lit(turn))
    lead = rows.groupBy("key").agg(F.min_by(F.struct("node", "comp"), rank).alias("lead")).select(F.col("key").alias("k"), F.col("lead.node").alias("leader"), F.col("lead.comp").alias("lead_comp"))
    met = rows.join(lead, rows.key == lead.k).filter("comp <> lead_comp")
    return met.select(*_ordered(F.col("node"), F.col("leader"))).distinct()


def _cross_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components within a key."""
    x, y = rows.alias("x"), rows.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


COUNTERS, PER_TASK, ITEMS_PER_TASK = 1 << 18, 2000, 1_000_000


def _counters(known: DataFrame) -> np.ndarray:
    """How often shingles occur in the sets, by their upper 18 bits; a fixed number of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            items = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64)  # a batch has a bounded size
            total += np.bincount((items >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        yield from common.parts_of_sum(total)

    return common.summed(known.select("items").mapInArrow(run, common.PARTS), COUNTERS)


def _narrowed(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows whose node may be linked with one of another component.

    In any one order of shingles, two sets that meet the threshold share one of the first n - ceil(n * percent / 100) + 1 of each.
    The order puts rare ones first, so what many sets have in common is not among them.
    """
    nodes = rows.groupBy("node").agg(F.min("comp").alias("comp"))
    known = nodes.join(sets.withColumnRenamed("node", "s"), F.col("node") == F.col("s")).select("node", "comp", "items")
    counters = rows.sparkSession.sparkContext.broadcast(_counters(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part, first = b.slice(k, 512), []
                for data in part.column(2):
                    s = np.frombuffer(data.as_buffer(), np.uint64)
                    first.append(s[np.lexsort((s, counters.value[(s >> np.uint64(46)).astype(np.int64)]))][: len(s) - -(-len(s) * percent // 100) + 1])
                n = [len(x) for x in first]
                node, comp = (np.repeat(part.column(c).to_numpy(), n) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(node), pa.array(comp)], ["item", "node", "comp"])

    prefix = common.materialise(known.mapInArrow(run, "item long, node long, comp long"), "prefixes")
    mixed = prefix.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("item")
    return rows.join(prefix.join(mixed, "item", "left_semi").select("node").distinct(), "node", "left_semi").select(*rows.columns)


def _open_links(rows: DataFrame, sets: DataFrame, percent: int, per_task: int = PER_TASK, per_items: int = ITEMS_PER_TASK) -> DataFrame:
    """Links between components within keys that hold several, tested on full sets where they lie; only links leave a task.

    The rows of a key outside its largest component are compared with all its rows. Both sides are dealt in parts of about per_task
    rows and per_items shingles, and a task has one part of each; an inverted list of a part's shingles gives all its intersections
    with a row at once.
    """
    rows = common.materialise(_narrowed(rows, sets, percent), "narrowed")
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("comp", "n").alias("main")).select(F.col("key").alias("k"), "main")
    known = rows.join(main, rows.key == main.k).join(sets.withColumnRenamed("node", "s"), F.col("node") == F.col("s"))
    known = known.select("key", "node", "comp", "items", (F.col("comp") != F.col("main")).alias("outside"))
    parts = lambda chosen: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(F.when(chosen, F.lit(1.0))), F.lit(0)) / per_task), F.ceil(F.coalesce(F.sum(F.when(chosen, F.length("items") / 8)), F.lit(0)) / per_items)).cast("int")
    dealt = known.groupBy("key").agg(parts(F.lit(True)).alias("parts"), parts(F.col("outside")).alias("probe_parts")).withColumnRenamed("key", "k")
    known = known.join(dealt, known.key == dealt.k)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = known.select("key", own("parts").alias("salt"), each("probe_parts").alias("probe_salt"), F.lit(False).alias("probe"), "node", "comp", "items")
    probe = known.filter("outside").select("key", each("parts").alias("salt"), own("probe_parts").alias("probe_salt"), F.lit(True).alias("probe"), "node", "comp", "items")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, asks = pdf[~pdf["probe"]], pdf[pdf["probe"]]
        found = []
        if len(own) and len(asks):
            lists = [np.frombuffer(x, np.uint64) for x in own["items"]]
            n = np.array([len(x) for x in lists])
            items, of = np.concatenate(lists), np.repeat(np.arange(len(n)), n)
            order = np.argsort(items, kind="stable")
            items, of = items[order], of[order]
            nodes, comps = own["node"].to_numpy(), own["comp"].to_numpy()
            for node, comp, data in zip(asks["node"], asks["comp"], asks["items"], strict=True):
                s = np.frombuffer(data, np.uint64)
                lo, hi = np.searchsorted(items, s, "left"), np.searchsorted(items, s, "right")
                size = hi - lo
                at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
                both = np.bincount(of[at], minlength=len(n))
                ok = (100 * both >= percent * (len(s) + n - both)) & (comps != comp)
                if ok.any():
                    found += _one_each(node, nodes[ok], comps[ok])
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return base.unionByName(probe).groupBy("key", "salt", "probe_salt").applyInPandas(run, "a long, b long").distinct()


def _one_each(node: int, nodes: np.ndarray, comps: np.ndarray) -> list[tuple[int, int]]:
    """One link to each component that the node is linked with: others of the same add nothing."""
    _, first = np.unique(comps, return_index=True)
    return [(min(node, x), max(node, x)) for x in nodes[first].tolist()]


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each row's profile, and (set_key, root) of each set."""
    rows = common.materialise(_profile(docs, n), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "row_key", "text_key")).alias("first")
    classes = rows.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), first, F.min("sketch").alias("sketch"), F.min("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_rows"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "set_key", "least", "first.row_key", "first.text_key", "sketch", "n_shingles", "n_rows")
    classes = common.materialise(classes, "classes")  # numbered once, in what is written
    links = _links(docs, classes, n, percent)
    roots = components(links)
    named = classes.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left")
    return rows, named.select("set_key", "least", "n_rows", "row_key", "text_key", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; documents of a component are linked by chains of similar sets."""
    rows, named = _components(common.documents(docs), n, percent)
    least = named.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    named = named.join(least, F.col("root") == F.col("r")).select("set_key", "n_rows", "component")
    total = rows.count()
    named = common.materialise(named, "components", rows=total)
    out = common.join_by_key(rows.select("doc_id", "n_shingles", "set_key"), named, "set_key", "n_rows", total, "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _links(docs: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    every = common.materialise(_bands(classes), "bands")
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    bands = common.materialise(every.join(shared, "key"), "shared-bands")
    common.release(every)
    size = bands.count()
    sets = common.materialise(_sets(docs, classes.join(bands.select("node").distinct(), "node", "left_semi").select("node", "set_key", "row_key", "text_key"), n), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        likely = common.materialise(_likely(pairs, classes, percent), "likely", rows=size)
        found = common.materialise(_confirmed(likely, sets, percent), "links", rows=size)
        common.release(likely)
        return found

    own = F.col("node").alias("comp")
    few = bands.filter(F.col("members") <= ALL_PAIRS).select("key", "node", own)
    many = common.materialise(bands.filter(F.col("members") > ALL_PAIRS).select("key", "node"), "large-bands", rows=size)
    links = confirm(_cross_pairs(few).unionByName(_leader_pairs(many.select("key", "node", own), 0)).distinct())
    if not many.take(1):
        return links
    for turn in range(1, LEADERS + 1):
        roots = components(links)
        now = many.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
        mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        open_rows = common.materialise(now.join(mixed, "key", "left_semi"), "open-bands", rows=size)
        if not open_rows.take(1):
            break
        new = confirm(_leader_pairs(open_rows, turn)) if turn < LEADERS else _open_links(open_rows, sets, percent)
        links = common.materialise(links.unionByName(new), "all-links", rows=size)
        common.release(open_rows)
    return links


def keep(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: of its least doc_id, any id before none.

    Rows without words all stay; of rows with equal doc_id and text one stays.
    """
    rows, named = _components(common.documents(docs), n, percent)
    # A class's first row is its best; of a component, the best of the classes' first rows.
    order = F.struct(F.col("least").isNull(), "row_key", "text_key")
    best = named.groupBy("root").agg(F.min(order).alias("first")).select("first.row_key", "first.text_key")
    kept = common.materialise(best.unionByName(rows.filter("set_key is null").select("row_key", "text_key").distinct()), "kept")
    out = common.kept_rows(docs, kept)
    if rows.filter("set_key is not null").groupBy("row_key", "text_key").count().filter("count > 1").take(1):
        blank = F.translate(F.coalesce("text", F.lit("")), common.SPACE, "") == ""
        out = out.filter(blank).unionByName(out.filter(~blank).dropDuplicates(["doc_id", "text"]))
    return out

"""Near duplicates with Order MinHash and banded alignment.

A text is the sequence of its five-word shingles, each labelled with its
occurrence number in the text.  For each of ``entries`` hash functions the
sketch takes the ``K`` smallest labelled shingles and keeps them in text order
as one key, so keys agree when texts share shingles in the same order.  That is
sparse for texts of fewer than ``SHORT`` shingles, so these, and texts that may
be similar to one, have their first shingles in the order of a hash as keys:
so many that similar texts always share one (prefix filtering).  Two
different texts are linked if the alignment of their shingle sequences, within
the band that the threshold allows, matches m of a and b shingles with
m / (a + b - m) of ``least`` or more.  Classes are the connected components of
the links; equal texts are one node from the start.

Candidates are texts with a common key.  A bucket of at most ``small`` texts
compares all of them.  In a larger one each text is first compared with one
leader, another one in each bucket, which joins most of a group of copies at a
cost that grows with its members.  What is then still of different classes is
compared pairwise, in blocks of at most about ``block`` texts dealt over many
tasks (:func:`apart`): texts of a bucket that are of one class already need no
comparison, and a bound by parity bits rules out most of the others before
any alignment.  So no link between texts with a common key is lost, whatever
the size of the bucket; blocks grow with the square of the texts of one bucket
that belong to different classes, but one task holds two blocks only.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped, written
from .text import bounded_batches, likely, table

SHINGLE, K = 5, 4
SHORT = 20
#: Least number of parity bits of a text; long texts have at least two for each shingle.
PARITY = 1024
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse below 2**bits."""
    up, down = np.full(1 << bits, _P, np.uint64), np.full(1 << bits, _P_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@functools.cache
def _factors(entries: int) -> np.ndarray:
    return _mix(np.arange(1, entries + 1, dtype=np.uint64) * _P) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Hashes of the labelled shingles in order; a text of fewer than five words is one shingle, one without words none."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(16, len(raw).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * down[starts])
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _P + words[i : i + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        first = np.concatenate([[True], ~same])
        at = np.arange(n)
        number = np.empty(n, np.uint64)
        number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
        h = np.where(number > 0, _mix(h + number * _P), h)
    return h


def keys(h: np.ndarray, entries: int, k: int, salt: int = 0) -> np.ndarray:
    """The sketch of labelled shingles: one key (int64) for each hash function."""
    k = min(k, len(h))
    values = (h + np.uint64(salt))[None, :] * _factors(entries)[:, None]
    at = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k] if k < len(h) else np.broadcast_to(np.arange(k), (entries, k)), axis=1)
    out = np.arange(entries, dtype=np.uint64) + np.uint64(salt)
    for i in range(k):
        out = _mix(out * _P + h[at[:, i]])
    return out.view(np.int64)


def sketch_of(h: np.ndarray, entries: int, least: float) -> np.ndarray:
    """The keys of a text: its sketch, if it is not short, and prefix shingles, if a short text may be similar."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    parts = [keys(h, entries, K)] if n >= SHORT else []
    if n * least <= SHORT:
        # similar texts share least * n shingles or more, so not all of those can come after the prefix
        parts.append(np.sort(_mix(h + _P))[: n - math.ceil(least * n - 1e-9) + 1].view(np.int64))
    return np.unique(np.concatenate(parts))


def parity(seq: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of shingles falls in each place: two texts differ in as many shingles as bits at least.

    The number of places is a power of two that grows with the text.
    """
    size = max(PARITY, 1 << (2 * len(seq) - 1).bit_length()) if len(seq) else PARITY
    return np.packbits((np.bincount(seq & np.uint32(size - 1), minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parity bits (texts by 64-bit words) over fewer places."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences of labelled shingles by banded alignment; 0 where it is below ``least``.

    Labelled shingles are unique in a text, so the best alignment is a longest
    increasing run of their places.  The band leaves out pairs that no
    alignment good enough can hold.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = least * (n + m) / (1 + least)
    _, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    # each alignment of `need` pairs leaves so many places of either text unmatched at most
    band = n + m - 2 * need
    inside = np.abs(i - j) <= band + 1e-9
    i, j = i[inside], j[inside]
    if len(i) < need - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        got = len(tails)
    else:
        got = len(j)
    return got / (n + m - got) if got >= need - 1e-9 else 0.0


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def sketched(docs: DataFrame, entries: int, least: float) -> DataFrame:
    """(doc_id, node, n, keys) of every document with a text: its digest, number of shingles and sketch."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("struct<n: int, keys: array<long>>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingles(t)
                rows.append((len(h), sketch_of(h, entries, least)))
            yield pd.DataFrame(rows, columns=["n", "keys"])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", _node(F.col("text")).alias("node"), sketch(F.col("text")).alias("s"))
    return written(rows.select("doc_id", "node", "s.n", "s.keys"), "neardup-sketches")


def sequences(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, n, seq, parity) of the texts ``needed`` (node, doc_id of one document that has it), made again from ``docs``.

    Only texts that have company are, so the other ones' sequences are never written.
    """

    @F.pandas_udf("struct<n: int, seq: binary, parity: binary>")
    def sequence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                seq = (shingles(t) >> np.uint64(32)).astype(np.uint32)
                rows.append((len(seq), seq.tobytes(), parity(seq).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "seq", "parity"])

    by = ["node", "doc_id"]
    texts, _ = likely(docs.where(F.col("text").isNotNull()).select("doc_id", _node(F.col("text")).alias("node"), "text"), by, needed, by)
    own = F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("t.node") == F.col("o.node"))
    rows = texts.alias("t").join(needed.alias("o"), own, "left_semi").dropDuplicates(["node"])
    return written(rows.select("node", sequence("text").alias("s")).select("node", "s.n", "s.seq", "s.parity"), "neardup-sequences")


def labels(docs: DataFrame, sketches: DataFrame, least: float = 0.8, small: int = 16, block: int = 2048) -> DataFrame:
    """(node, label) of the texts that are linked to others: the smallest node of each class."""
    bounded_batches(docs.sparkSession)
    one = written(sketches.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "neardup-nodes")
    # one row for each text; repeated rows of one id and text give the same keys
    own = F.col("s.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("s.node") == F.col("o.node"))
    entry = sketches.alias("s").join(one.alias("o"), own, "left_semi").where("n > 0").select("node", "n", F.explode("keys").alias("key"))
    rows = written(entry.distinct(), "neardup-keys")
    lead = F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "n"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), lead.alias("lead")).where("size > 1")
    held = written(rows.join(buckets.select("key", "size", F.col("lead.node").alias("lead"), F.col("lead.n").alias("nl")), "key"), "neardup-buckets")
    dropped(rows)
    seqs = sequences(docs, held.select("node").distinct().join(one, "node"))
    dropped(one)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            linked = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) > 0 for x, y in zip(df["seq_a"], df["seq_b"], strict=True)]
            yield df.loc[linked, ["a", "b"]]

    def links(pairs: DataFrame) -> DataFrame:
        side = lambda c: seqs.select(F.col("node").alias(c), F.col("seq").alias(f"seq_{c}"))
        return written(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(judge, "a binary, b binary"), "neardup-links")

    similar = lambda x, y: F.least(x, y) >= F.greatest(x, y) * least - 1e-9
    few, wide = held.where(F.col("size") <= small), held.where(F.col("size") > small).select("key", "node", "n", "size")
    left, right = (few.select("key", F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & similar("na", "nb")).select("a", "b")
    stars = held.where((F.col("size") > small) & (F.col("lead") != F.col("node")) & similar("n", "nl"))
    pairs = pairs.unionByName(stars.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")))
    done = written(pairs.distinct(), "neardup-pairs")
    edges, compared = links(done), [done]
    known = components(edges)
    dropped(edges)
    # at first the nearest text of another class, which joins nearly all that belong together, then every pair that is left
    for nearest in (True, False):
        more = written(apart(wide, known, seqs, least, block, nearest).join(done, ["a", "b"], "left_anti"), "neardup-pairs")
        compared.append(more)
        if more.isEmpty():
            continue
        edges = links(more)
        old, known = known, components(edges.unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        dropped(old, edges)
        done = done.unionByName(more)
    dropped(held, seqs, *compared)
    return known


def apart(wide: DataFrame, known: DataFrame, seqs: DataFrame, least: float, block: int, nearest: bool) -> DataFrame:
    """(a, b): pairs of texts of one bucket but of different classes that may be similar, each once.

    ``wide`` has the buckets (key, node, n, size), ``known`` the classes so
    far.  A bucket of one class has no such pair.  The others are cut into
    blocks, by a hash of the node; a task compares two blocks and gives, for
    each text outside its largest class, the pairs that length and parity do
    not rule out, or only the nearest by parity.
    """
    of = wide.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = of.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    of = written(of.join(several, "key"), "neardup-apart")
    texts = of.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.sort_array(F.collect_set("key")).alias("keys"))
    texts = texts.join(seqs.select("node", "parity"), "node")
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = of.select("key", "node", "size").join(texts, "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "label", "n", "keys", "parity")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[bytes, bytes]] = []
        own, x, y = df["own"].to_numpy(), int(df["x"].iloc[0]), int(df["y"].iloc[0])
        label = np.unique(np.array([v.hex() for v in df["label"]]), return_inverse=True)[1]
        n, node, keys, key = df["n"].to_numpy(np.int64), df["node"].to_numpy(), df["keys"].to_numpy(), df["key"].iloc[0]
        words = np.array([len(v) // 8 for v in df["parity"]])
        sets = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
        bits = {w: np.frombuffer(b"".join(df["parity"].iloc[at]), np.uint64).reshape(len(at), w) for w, at in sets.items()}
        # of each pair one text at least isn't of the largest class
        minor = label != np.bincount(label).argmax()
        for w, at in sets.items():
            for chunk in np.array_split(at[minor[at]], -(-int(minor[at].sum()) // 128)) if minor[at].any() else ():
                best = np.full(len(chunk), np.inf)
                mate = np.full(len(chunk), -1)
                own_bits = bits[w][np.searchsorted(at, chunk)]
                for v, to in sets.items():
                    if not 0.5 <= v / w <= 2:
                        continue
                    p, q = folded(own_bits, min(v, w)), folded(bits[v], min(v, w))
                    differ = np.zeros((len(p), len(q)), np.int64)
                    for k in range(p.shape[1]):
                        differ += np.bitwise_count(p[:, k, None] ^ q[None, :, k])
                    na, nb = n[chunk][:, None], n[to][None, :]
                    ok = (label[chunk][:, None] != label[to][None, :]) & (np.minimum(na, nb) >= np.maximum(na, nb) * least - 1e-9) & (differ <= (na + nb) * ((1 - least) / (1 + least)) + 1e-6)
                    if x != y:
                        ok &= own[chunk][:, None] != own[to][None, :]
                    if nearest:
                        share = np.where(ok, differ / (na + nb), np.inf)
                        col = share.argmin(1)
                        value = share[np.arange(len(chunk)), col]
                        mate, best = np.where(value < best, to[col], mate), np.minimum(best, value)
                    else:
                        # pairs of two minor texts come twice, and a pair has its place in the first bucket of both
                        for i, j in zip(*np.nonzero(ok & (~minor[to][None, :] | (chunk[:, None] < to[None, :]))), strict=True):
                            a, b = int(chunk[i]), int(to[j])
                            if np.intersect1d(keys[a], keys[b], assume_unique=True)[0] == key:
                                found.append((min(node[a], node[b]), max(node[a], node[b])))
                found += [(min(node[a], node[b]), max(node[a], node[b])) for a, b in zip(chunk.tolist(), mate.tolist(), strict=True) if b >= 0]
        return pd.DataFrame(found, columns=["a", "b"])

    out = written(rows.groupBy("key", "x", "y").applyInPandas(compare, "a binary, b binary").distinct(), "neardup-close")
    dropped(of)
    return out


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b).

    Large-star and small-star in turn until every component is a star around
    its smallest node, so rounds grow with the logarithm of its size and not
    with its diameter.  No result is returned before that: after ``rounds``,
    far more than any graph needs, it is an error.
    """
    # u is the larger end
    at = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    at = written(at.distinct(), "components-edges")
    for _ in range(rounds):
        # large-star: the larger neighbours of a node move to the smallest one around
        around = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = written(at.join(around, "v").select("u", F.col("m").alias("v")).distinct(), "components-large")
        # small-star: the smaller neighbours of a node, and the node, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components-edges")
        dropped(at, large)
        at = now
        several = at.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        if several.unionByName(at.select("u").join(at.select(F.col("v").alias("u")), "u", "left_semi")).isEmpty():
            break
    else:
        raise RuntimeError(f"components are not found after {rounds} rounds")
    label = written(at.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "components-labels")
    dropped(at)
    return label


def _labelled(docs: DataFrame, entries: int = 24, least: float = 0.8, **how) -> DataFrame:
    """``docs`` with ``_nd_label`` (the class; null for a null text) and ``class_id``."""
    sketches = sketched(docs.select("doc_id", "text"), entries, least)
    label = labels(docs.select("doc_id", "text"), sketches, least, **how)
    node = sketches.groupBy("node").agg(F.min("doc_id").alias("m"))
    node = written(node.join(label, "node", "left").select("node", "m", F.coalesce("label", "node").alias("label")), "neardup-labels")
    dropped(sketches, label)
    least_id = node.groupBy("label").agg(F.min("m").alias("class_id"))
    of = written(node.join(least_id, "label").select(F.col("node").alias("_nd_n"), F.col("label").alias("_nd_label"), F.col("class_id").alias("_nd_c")), "neardup-classes")
    dropped(node)
    rows = docs.withColumn("_nd_d", _node(F.col("text")))
    out = rows.join(of, rows["_nd_d"] == of["_nd_n"], "left")
    return out.withColumn("class_id", F.when(F.col("_nd_d").isNull(), F.col("doc_id")).otherwise(F.col("_nd_c")))


def classes(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with ``class_id``: the smallest doc_id of each document's class (null ids don't count; null if a class has no other).

    Equal texts, empty ones too, are of one class; a null text is alone.
    Texts without a word are linked to equal texts only, and texts of fewer
    than five words to texts of the same words.  Every row comes back,
    repeated rows too; a column class_id is replaced.
    """
    kept = [c for c in docs.columns if c != "class_id"]
    return _labelled(docs.select(*kept), **how).select(*kept, "class_id")


def result(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id; of rows with the same id one."""
    columns = docs.columns
    out = _labelled(docs)
    first = out.where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # null texts are alone, whatever their number
    alone, several = first.where(F.col("_nd_label").isNull()), first.where(F.col("_nd_label").isNotNull())
    return several.dropDuplicates(["_nd_label"]).unionByName(alone).select(*columns)

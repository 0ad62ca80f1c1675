r"""Line dedup with a suffix array over line-ID sequences.

A text is the sequence of its ``\n``-separated lines.  A run of lines that
occurs again at a later place (documents in the order of doc_id, null last,
then of the text's MD5; lines in their order) is deleted there, if it is long
enough: ``min_lines`` lines or ``min_words`` words from a line with a word on.
Runs are maximal: from every such line the longest run with an earlier copy.

The suffixes of all line sequences are ranked by distributed prefix doubling
(:func:`suffix_ranks`): a round sorts the distinct pairs (rank of the first
2**k lines, rank of the next 2**k) and so ranks prefixes of 2**(k+1) lines.
Lines that occur once can lie in no repeated run, so only the others take
part, and a pair that occurs once leaves the race; its place in the suffix
array is settled.  Rounds go on until no pair occurs twice, so as many as the
logarithm of the longest repeated run.  Suffixes of equal rank are a
longest-common-prefix interval of that depth.

The interval of any other depth n is named by the ranks of 2**k lines that
make it up.  :func:`longest` goes down from the widest intervals to the
narrowest: a suffix that is not the first of the interval of depth n + 2**k
around it goes into it, and one that is stays, for k from the top to 0.  The
first suffix of an interval goes along as its representative, so every later
one finds its longest common prefix with any earlier place, and no task holds
an interval: the first is an aggregate.

Pairs and intervals are distinct keys, aggregated before they are shuffled, so
a line that fills a third of the corpus is one key in the sort.  Positions find
their ranks by a join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import dropped, written
from .text import bounded_batches, likely, table, word_count

MIN_LINES, MIN_WORDS = 4, 50


def _digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, key, words): each line of each distinct (doc_id, text)."""
    base = docs.where(F.col("text").isNotNull()).select("doc_id", _digest(F.col("text")).alias("digest"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return base.select("doc_id", "digest", "pos", _digest(F.col("line")).alias("key"), word_count(F.col("line")).cast("int").alias("words"))


def _ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys with ``rank``, ascending in the order of ``by``: range partitions, each sorted, numbered one after another."""
    return keys.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def _place() -> Column:
    """Where a suffix begins, for comparison: null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.hex("digest").alias("t"), F.col("pos").alias("p"))


_DOC = ["doc_id", "digest"]


def _at(x: DataFrame, y: DataFrame, ahead: Column | int = 0) -> Column:
    """The place of ``y`` is ``ahead`` lines after that of ``x``."""
    return x["doc_id"].eqNullSafe(y["doc_id"]) & (x["digest"] == y["digest"]) & (x["pos"] + ahead == y["pos"])


def suffix_ranks(docs: DataFrame) -> list[DataFrame]:
    """Table k has (doc_id, digest, pos, rank) of the suffixes whose first 2**k lines occur elsewhere; table 0 has ``words`` of the line too.

    Ranks ascend with the lines' digests and are equal where those lines are.
    """
    every = written(lines_of(docs).distinct(), "lines-all")
    twice = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    ranks = written(_ranked(twice, ["key"]), "lines-rank")
    levels = [written(every.join(ranks, "key").select(*_DOC, "pos", "words", "rank"), "lines-level")]
    dropped(every, ranks)
    doc = Window.partitionBy(*_DOC).orderBy("pos")
    while True:
        half = 1 << (len(levels) - 1)
        ahead = F.first("rank").over(doc.rangeBetween(half, half))  # null if that suffix isn't there
        pairs = written(levels[-1].select(*_DOC, "pos", F.col("rank").alias("a"), ahead.alias("b")).where(F.col("b").isNotNull()), "lines-pairs")
        twice = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b")
        ranks = written(_ranked(twice, ["a", "b"]), "lines-rank")
        if ranks.isEmpty():
            dropped(pairs, ranks)
            return levels
        levels.append(written(pairs.join(ranks, ["a", "b"]).select(*_DOC, "pos", "rank"), "lines-level"))
        dropped(pairs, ranks)


def starts(levels: list[DataFrame], min_lines: int, min_words: int) -> DataFrame:
    """(doc_id, digest, pos, size, a, b): suffixes that begin with a word and with a repeated prefix that is long enough.

    ``size`` is the number of lines of the shortest such prefix, and the ranks
    of its first and its last 2**k lines, for the largest k that fits, name it.
    """
    doc = Window.partitionBy(*_DOC).orderBy("pos")
    ahead = lambda c, n: F.first(c).over(doc.rangeBetween(n, n))
    at = levels[0].select(*_DOC, "pos", "words", F.col("rank").alias("rank0"))
    for k in range(1, min_lines.bit_length()):
        if k < len(levels):
            x = levels[k]
            at = at.join(x, _at(at, x), "left").select(*[at[c] for c in at.columns], x["rank"].alias(f"rank{k}"))
        else:
            at = at.withColumn(f"rank{k}", F.lit(None).cast("long"))
    size, total = None, F.lit(0)
    for i in range(min_lines):
        total = total + (ahead("words", i) if i else F.col("words"))
        enough = total.isNotNull() if i + 1 == min_lines else total >= min_words
        size = F.when(enough, i + 1) if size is None else size.when(enough, i + 1)
    at = at.withColumn("size", F.when(F.col("words") > 0, size))
    first, second = F.lit(None).cast("long"), F.lit(None).cast("long")
    for n in range(1, min_lines + 1):
        k = n.bit_length() - 1
        shift = n - (1 << k)
        first = F.when(F.col("size") == n, F.col(f"rank{k}")).otherwise(first)
        second = F.when(F.col("size") == n, ahead(f"rank{k}", shift) if shift else F.lit(-1).cast("long")).otherwise(second)
    named = at.withColumns({"a": first, "b": second}).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    return named.select(*_DOC, "pos", "size", "a", "b")


def longest(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, pos, size): for each suffix that begins with a run that is long enough and has an earlier copy, the lines of the longest such run."""
    levels = suffix_ranks(docs)
    named = written(starts(levels, min_lines, min_words), "lines-named")
    groups = named.groupBy("size", "a", "b").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups.select("size", "a", "b", "first", F.monotonically_increasing_id().alias("state")), "lines-groups")
    begun = named.join(groups, ["size", "a", "b"]).select(*_DOC, "pos", "size", "state", (_place() > F.col("first")).alias("later"))
    # a suffix takes part from the widest interval that it lies in
    top = None
    for k, x in enumerate(levels):
        x = x.select(*_DOC, "pos", F.lit(k).alias("k"))
        top = x if top is None else top.unionByName(x)
    top = top.groupBy(*_DOC, "pos").agg(F.max("k").alias("top"))
    begun = written(begun.join(top, _at(begun, top)).select(*[begun[c] for c in begun.columns], "top"), "lines-begun")
    dropped(named, groups)
    rows: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        fresh = begun.where(F.col("top") == k).drop("top")
        now, x = (fresh if rows is None else fresh.unionByName(rows)), levels[k]
        now = written(now.join(x, _at(now, x, now["size"]), "left").select(*[now[c] for c in now.columns], x["rank"].alias("next")), "lines-next")
        groups = now.where(F.col("next").isNotNull()).groupBy(F.col("state").alias("_s"), F.col("next").alias("_n")).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # states are numbered by round, so that all are different
        number = (F.lit(k + 1).cast("long") * (1 << 56) + F.row_number().over(Window.partitionBy("_part").orderBy("_s", "_n")) * (1 << 12) + F.col("_part"))
        groups = written(groups.withColumn("_part", F.pmod(F.xxhash64("_s", "_n"), F.lit(1 << 12))).select("_s", "_n", "first", number.alias("_to")), "lines-groups")
        both = now.join(groups, (now["state"] == groups["_s"]) & (now["next"] == groups["_n"]), "left")
        deeper = F.struct((F.col("size") + (1 << k)).alias("size"), F.col("_to").alias("state"), F.col("later"))
        as_it_was = F.struct("size", "state", "later")
        as_first = F.struct((F.col("size") + (1 << k)).alias("size"), F.col("_to").alias("state"), F.lit(False).alias("later"))
        to = F.when(F.col("_to").isNull(), F.array(as_it_was)).when(_place() > F.col("first"), F.array(deeper)).otherwise(F.array(as_it_was, as_first))
        old, rows = rows, written(both.select(*_DOC, "pos", F.explode(to).alias("r")).select(*_DOC, "pos", "r.*"), "lines-rows")
        dropped(now, groups, *([old] if old is not None else []))
    dropped(begun, *levels)
    return rows.where("later").select(*_DOC, "pos", "size")


def runs(later: DataFrame) -> DataFrame:
    """(doc_id, digest, runs): each document's deleted runs, joined where they overlap or touch, as an ascending array of struct<first, last>."""
    before = Window.partitionBy(*_DOC).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*_DOC).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = later.withColumn("end", F.max(F.col("pos") + F.col("size")).over(before))
    rows = rows.withColumn("run", F.sum((F.col("end").isNull() | (F.col("pos") > F.col("end"))).cast("int")).over(so_far))
    spans = rows.groupBy(*_DOC, "run").agg(F.min("pos").alias("first"), (F.max(F.col("pos") + F.col("size")) - 1).alias("last"))
    return spans.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def deduped(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` without its later copies, and ``lines_deleted`` (int).

    A null or empty text stays as it is.  Rows equal in doc_id and text are
    one document and get the same text.  A text all of whose lines are deleted
    becomes empty.  A very long text takes time and memory in proportion to
    its lines.  Columns of the new names are replaced.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "lines_deleted"]
    gone = runs(longest(docs.select("doc_id", "text"), min_lines, min_words)).withColumnsRenamed({"doc_id": "_ld_i", "digest": "_ld_t"})
    gone = written(gone, "lines-runs")
    rows = docs.select(*kept).withColumn("_ld_d", _digest(F.col("text")))
    # only texts that may have a run are shuffled
    hit, rest = likely(rows, ["_ld_d", "doc_id"], gone, ["_ld_t", "_ld_i"])
    # the runs grow with the corpus, so the join is planned for that at every size
    hit = hit.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_ld_i")) & (F.col("_ld_d") == F.col("_ld_t")), "left")

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            out = []
            for t, s in zip(texts, spans, strict=True):
                if s is not None:
                    lines, left, at = t.split("\n"), [], 0
                    for r in s:
                        left += lines[at : r["first"]]
                        at = r["last"] + 1
                    t = "\n".join(left + lines[at:])
                out.append(t)
            yield pd.Series(out, dtype=object)

    n = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    hit = hit.select(*[cut("text", "runs").alias("text") if c == "text" else F.col(c) for c in kept], F.coalesce(n, F.lit(0)).alias("lines_deleted"))
    return rest.select(*kept, F.lit(0).alias("lines_deleted")).unionByName(hit)


def result(spark, sf_dir: str) -> DataFrame:
    return deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of long runs of lines; every document stays, with what is left of it (n_chars follows)."""
    out = deduped(docs)
    fresh = F.when(F.col("lines_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    return out.select(*[fresh if c == "n_chars" else F.col(c) for c in docs.columns])


#: The same without a suffix array: every prefix that occurs elsewhere is made one line longer, as long as it does.
ORACLE = f"""
WITH RECURSIVE docs AS (SELECT DISTINCT doc_id, text, md5(text) AS t FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, t, md5(raw) AS line, pos, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS words, raw AS l FROM (
  SELECT doc_id, t, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs)),
grown AS (
  SELECT doc_id, t, pos, 1 AS n, words, line AS name, count(*) OVER (PARTITION BY line) AS copies FROM lines WHERE words > 0
  UNION ALL
  SELECT g.doc_id, g.t, g.pos, g.n + 1, g.words + l.words, md5(g.name || l.line), count(*) OVER (PARTITION BY md5(g.name || l.line))
  FROM grown g JOIN lines l ON g.doc_id IS NOT DISTINCT FROM l.doc_id AND g.t = l.t AND l.pos = g.pos + g.n WHERE g.copies > 1),
later AS (SELECT *, row_number() OVER (PARTITION BY n, name ORDER BY doc_id NULLS LAST, t, pos) AS nth FROM grown),
gone AS (SELECT DISTINCT doc_id, t, unnest(range(pos, pos + n)) AS pos FROM later WHERE nth > 1 AND (n >= {MIN_LINES} OR words >= {MIN_WORDS})),
left_over AS (
  SELECT l.doc_id, l.t, array_to_string(list(l.l ORDER BY l.pos) FILTER (g.pos IS NULL), chr(10)) AS new, count(g.pos) AS deleted
  FROM lines l LEFT JOIN gone g ON l.doc_id IS NOT DISTINCT FROM g.doc_id AND l.t = g.t AND l.pos = g.pos GROUP BY ALL)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(new, '') END AS text, CAST(coalesce(deleted, 0) AS INTEGER) AS lines_deleted
FROM documents d LEFT JOIN left_over o ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND md5(d.text) = o.t
"""

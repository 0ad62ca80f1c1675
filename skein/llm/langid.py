"""Language identification with bit-sliced Bloom filters of character n-grams.

A slot of the filter holds one bit for each language.  Learning sets a
language's bit in the slots of the n-grams typical of it; a lookup ANDs the
slots of an n-gram and so returns every language that contains it.  For each
language the hits are counted (its popcount over the text), the share that
false positives explain is taken off, and the largest share wins.

Learning reads a bounded sample of whole labelled texts (``per_lang`` each);
prediction reads every whole text.  The filter has a fixed size
(``2**slot_bits`` bytes for every eight languages), so it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LETTER, bounded_batches, char_classes, code_points, drawn, fraction_of

N = 4
HASHES = 3
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that hold a letter, the end of each text's hashes, each text's letters.

    Texts are lower-cased, all but letters become blanks, and a blank stands
    before and after each text.
    """
    gap = "\0" * (N - 1)
    low = [t.lower() for t in texts]
    codes = code_points(gap + gap.join(low) + gap)
    letter = (char_classes()[codes] & LETTER) > 0
    codes = np.where(letter, codes, 0).astype(np.uint64)
    n = len(codes) - N + 1
    has, h = np.zeros(n, bool), np.zeros(n, np.uint64)
    for i in range(N):
        has |= letter[i : i + n]
        h += codes[i : i + n] * _ODD[i]
    h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    # a text's windows begin N - 1 places before it and end with it
    ends = np.cumsum([len(t) + N - 1 for t in low])
    kept, letters = np.concatenate([[0], np.cumsum(has)]), np.concatenate([[0], np.cumsum(letter)])
    return h[has], kept[np.minimum(ends, n)], np.diff(letters[np.concatenate([[0], np.minimum(ends, len(codes))])])


def slots(h: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    shift = np.uint64(64 - slot_bits)
    return [((h * m) >> shift).astype(np.int64) for m in _MIX[:HASHES]]


@dataclass
class LanguageFilter:
    """The filter: ``planes[p][slot]`` has the bits of languages 8p to 8p + 7."""

    langs: list[str]
    planes: list[np.ndarray]
    slot_bits: int
    fallback: str

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Share of each text's n-grams in each language without false positives; letters of each text."""
        h, ends, letters = grams(texts)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        n = np.maximum(ends - starts, 1)
        at, out = slots(h, self.slot_bits), np.zeros((len(texts), len(self.langs)))
        for i in range(len(self.langs)):
            plane, bit = self.planes[i // 8], np.uint8(1 << (i % 8))
            if i % 8 == 0:
                hit = plane[at[0]]
                for a in at[1:]:
                    hit &= plane[a]
            cum = np.concatenate([[0], np.cumsum((hit & bit) > 0)])
            false = np.count_nonzero(plane & bit) / len(plane)
            false **= HASHES
            out[:, i] = ((cum[ends] - cum[starts]) / n - false) / max(1 - false, 1e-9)
        return np.maximum(out, 0), letters

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        shares, letters = self.shares(texts)
        best = shares.argmax(1)
        total, top = shares.sum(1), shares.max(1)
        names = [("und" if not k else self.langs[b] if t > 0 else self.fallback) for k, b, t in zip(letters, best, top, strict=True)]
        score = np.where((letters > 0) & (total > 0), top / np.where(total > 0, total, 1), 0.0)
        return names, score.tolist()


def learn(docs: DataFrame, train: Column, per_lang: int = 1500, slot_bits: int = 21, least: int = 3, typical: float = 0.25, seed: int = 17) -> LanguageFilter:
    """Learns from rows of ``docs`` (text, lang) for which ``train`` holds.

    About ``per_lang`` texts of each language are read, drawn by a hash of the
    text.  An n-gram goes into a language's filter if the sample has it
    ``least`` times and its share there is ``typical`` of the largest share in
    any language.  Without a labelled row the filter knows no language.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageFilter([], [], slot_bits, "und")
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, fraction_of(counts[k], per_lang))]), F.col("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for lang, of in df.groupby("lang"):
                h, _, _ = grams(list(of["text"]))
                u, n = np.unique(h, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": u.view(np.int64), "n": n})

    got = rows.where(drawn(share, F.col("text"), seed=seed)).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow().to_pandas()
    planes = [np.zeros(1 << slot_bits, np.uint8) for _ in range((len(langs) + 7) // 8)]
    got["p"] = got["n"] / got.groupby("lang")["n"].transform("sum")
    got = got[got["p"] >= typical * got.groupby("gram")["p"].transform("max")]
    for i, lang in enumerate(langs):
        h = got.loc[got["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for at in slots(h, slot_bits):
            planes[i // 8][at] |= np.uint8(1 << (i % 8))
    return LanguageFilter(langs, planes, slot_bits, max(langs, key=lambda k: (counts[k], k)))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """``docs`` with ``lang_pred`` (``und`` for null text or one without a letter) and ``score`` (0 to 1).

    Columns of these names in ``docs`` are replaced.  Every row comes back,
    repeated rows too; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            names, scores, texts = [], [], [t or "" for t in texts]
            for part in pieces(texts):
                n, s = own.predict(part)
                names += n
                scores += s
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, predict(F.col("text")).alias("_p")).select(*kept, "_p.lang_pred", "_p.score")


def pieces(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of whole texts of about ``chars`` characters together."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def predicted(docs: DataFrame) -> DataFrame:
    """Every document's id, fold, language and score; learned from the rows of the other folds (a null id is never learned from)."""
    model = learn(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Keeps the documents whose language is known: not ``und``, with a score of ``min_score`` at least."""
    columns = docs.columns
    model = learn(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    out = identify(docs, model)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*columns)

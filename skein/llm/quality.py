"""Quality rules: counts of every text, and lines labelled by a linear-chain CRF.

The CRF has two labels, content (1) and boilerplate (0).  It is trained here
from a bounded sample of whole documents of the labels table.  The table says
how good a document is, not which of its lines are; those labels are latent
and found by expectation and maximisation (:func:`fit`): first each line is
scored by itself, by the quality of the documents that lines like it are in;
then Viterbi decoding, leaning towards the document's quality, labels every
line of the sample, and the chain is trained by gradient ascent on the log
likelihood, in turns.  So a good document may have boilerplate and a bad one
content.  As labelled documents are mostly of one kind throughout, a chain
trained on them would learn that labels never change; so it is trained on
texts spliced from stretches of one to eight lines of documents of both
qualities, as often the one as the other, as on pages that mix the two.  Viterbi decoding labels the lines of every
text, and the share of its words in content lines decides whether it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import DIGIT, LETTER, LOWER, PUNCT, SPACE, SYMBOL, UPPER, bounded_batches, char_classes, code_points, drawn, fraction_of

WINDOW = 8
FEATURES = 14


@dataclass
class Counts:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    line_words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES), np.float32))

    @property
    def failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    w = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        w = w * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def counted(text: str | None) -> Counts:
    """Counts and line features of a whole text; all 0 for null or an empty text."""
    if not text:
        return Counts()
    codes = code_points(text)
    cls = char_classes()[codes]
    solid = (cls & SPACE) == 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    starts = np.append(0, ends[:-1] + 1)

    def by_line(flag: np.ndarray) -> np.ndarray:
        cum = np.concatenate([[0], np.cumsum(flag)])
        return cum[ends] - cum[starts]

    words, chars, symbols = by_line(first), by_line(solid), by_line((cls & SYMBOL) > 0)
    seen: set[str] = set()
    dup = np.zeros(len(ends), bool)
    for i, line in enumerate(text.split("\n")):
        if words[i]:
            dup[i] = line in seen
            seen.add(line)
    letters = by_line((cls & LETTER) > 0)
    upper, lower, digit, punct = (by_line((cls & k) > 0) for k in (UPPER, LOWER, DIGIT, PUNCT))
    n, w, a = np.maximum(chars, 1), np.maximum(words, 1), np.maximum(letters, 1)
    last = codes[np.maximum(ends - 1, 0)]
    place = np.arange(len(ends))
    x = np.stack(
        [
            np.ones(len(ends)), symbols / n, upper / a, lower / n, digit / n, punct / w, np.log1p(words), chars / w / 10,
            np.isin(last, [ord(c) for c in ".!?:"]), dup, symbols / w, words == 0, (place == 0) | (place == len(ends) - 1), by_line((codes == 33) | (codes == 124)) / w,
        ],
        1,
    )
    return Counts(int(first.sum()), int(solid.sum()), int(((cls & SYMBOL) > 0).sum()), int(dup.sum()), repeated_words(text.encode("utf-8", "surrogatepass").split()), words, x.astype(np.float32))


@dataclass
class Crf:
    """``emit`` scores content against boilerplate; ``move[a, b]`` scores label b after a; ``begin`` the first."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def viterbi(self, x: np.ndarray, lean: float = 0.0) -> np.ndarray:
        """The best labels of a text's lines; ``lean`` is added to the score of content for each line."""
        score = (x @ self.emit + lean).tolist()
        if not score:
            return np.zeros(0, np.int8)
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.begin.tolist()
        b += score[0]
        back = []
        for s in score[1:]:
            from0, from1 = (b + m10 > a + m00), (b + m11 >= a + m01)
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00), (b + m11 if from1 else a + m01) + s
        now = b >= a
        out = [now]
        for step in reversed(back):
            now = step[now]
            out.append(now)
        return np.array(out[::-1], np.int8)


def train(sequences: list[tuple[np.ndarray, np.ndarray, float]], chain: bool = True, piece: int = 32, rounds: int = 120, l2: float = 1e-3, l2_chain: float = 1e-2) -> Crf:
    """Fits a CRF to texts' line features, the lines' labels and the texts' weights; without ``chain`` lines are independent.

    For training only, long texts are cut into pieces of ``piece`` lines.
    """
    parts = [(x[i : i + piece], y[i : i + piece], w) for x, y, w in sequences for i in range(0, len(x), piece)]
    size = max(len(x) for x, _, _ in parts)
    X = np.zeros((len(parts), size, FEATURES))
    valid, Y = np.zeros((len(parts), size), bool), np.zeros((len(parts), size), np.int8)
    for i, (x, y, _) in enumerate(parts):
        X[i, : len(x)], Y[i, : len(x)], valid[i, : len(x)] = x, y, True
    weight = np.array([w for _, _, w in parts])
    weight /= weight.sum()
    theta = np.zeros(FEATURES + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        emit, move, begin = theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :]
        s = np.stack([np.zeros(X.shape[:2]), X @ emit], 2)
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = begin + s[:, 0]
        for i in range(1, size):
            nxt = np.logaddexp(alpha[:, i - 1, 0, None] + move[0], alpha[:, i - 1, 1, None] + move[1]) + s[:, i]
            alpha[:, i] = np.where(valid[:, i, None], nxt, alpha[:, i - 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for i in range(size - 2, -1, -1):
            to = s[:, i + 1] + beta[:, i + 1]
            nxt = np.logaddexp(move[:, 0] + to[:, :1], move[:, 1] + to[:, 1:])
            beta[:, i] = np.where(valid[:, i + 1, None], nxt, 0.0)
        p = np.exp(alpha + beta - z[:, None, None]) * valid[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + move + (s + beta)[:, 1:, None, :] - z[:, None, None, None]) * valid[:, 1:, None, None]
        own = (np.arange(2) == Y[:, :, None]) * valid[:, :, None]
        g = np.zeros_like(theta)
        g[:FEATURES] = np.einsum("n,nt,ntf->f", weight, own[:, :, 1] - p[:, :, 1], X)
        g[FEATURES : FEATURES + 4] = (np.einsum("n,ntab->ab", weight, (own[:, :-1, :, None] * own[:, 1:, None, :]) - both)).ravel()
        g[FEATURES + 4 :] = weight @ (own[:, 0] - p[:, 0])
        g[:FEATURES] -= l2 * theta[:FEATURES]
        g[FEATURES:] = g[FEATURES:] - l2_chain * theta[FEATURES:] if chain else 0.0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Crf(theta[:FEATURES].copy(), theta[FEATURES : FEATURES + 4].reshape(2, 2).copy(), theta[FEATURES + 4 :].copy())


def spliced(sequences: list[tuple[np.ndarray, int]], labels: list[np.ndarray], piece: int = 32, most: int = 100_000, seed: int = 9) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Texts of ``piece`` lines from stretches of one to eight lines of good and bad documents, in equal parts; ``most`` lines at most."""
    rng = np.random.default_rng(seed)
    parts: tuple[list, list] = ([], [])
    for (x, quality), y in zip(sequences, labels, strict=True):
        i = 0
        while i < len(x):
            n = int(rng.integers(1, 9))
            parts[quality].append((x[i : i + n], y[i : i + n]))
            i += n
    order = [rng.permutation(len(p)) for p in parts]
    out, now, size, at, total = [], [], 0, [0, 0], min(most, 2 * max(sum(len(x) for x, _ in p) for p in parts))
    while total > 0:
        q = int(rng.integers(2))
        now.append(parts[q][order[q][at[q] % len(order[q])]])
        at[q] += 1
        size += len(now[-1][0])
        total -= len(now[-1][0])
        if size >= piece or total <= 0:
            out.append((np.concatenate([x for x, _ in now]), np.concatenate([y for _, y in now]), 1.0))
            now, size = [], 0
    return out


def fit(sequences: list[tuple[np.ndarray, int]], turns: int = 2, lean: float = 1.0) -> Crf | None:
    """Fits a CRF to texts' line features and their quality (1 good, 0 bad); None unless both occur.

    Both qualities weigh the same.  If a turn leaves one label only, the lines
    keep the labels that they had.
    """
    n = [sum(len(x) for x, y in sequences if y == k) for k in (0, 1)]
    if not all(n):
        return None
    labels = [np.full(len(x), y, np.int8) for x, y in sequences]
    crf = train([(x, own, 1 / n[y]) for (x, y), own in zip(sequences, labels, strict=True)], chain=False)
    for _ in range(turns):
        again = [crf.viterbi(x, lean if y else -lean) for x, y in sequences]
        if len({int(v) for own in again for v in np.unique(own)}) < 2:
            break
        labels = again
        crf = train(spliced(sequences, labels), piece=40)
    return crf


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 1024, seed: int = 5) -> Crf | None:
    """Trains on about ``max_docs`` labelled documents (half of each quality, if there are as many), drawn by a hash of doc_id.

    The drawn ids are broadcast: they are ``max_docs`` and a few, whatever the
    tables hold.  Rows with a null text, id or label are no examples, nor are
    texts of more than ``max_lines`` lines, so the features that come to the
    driver are bounded.  None if a quality is missing.
    """
    bounded_batches(docs.sparkSession)
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("quality") == 1, fraction_of(n[1], max_docs // 2)).otherwise(fraction_of(n[0], max_docs // 2))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(marked.where(drawn(share, F.col("doc_id"), seed=seed))), "doc_id")
    rows = rows.where(F.regexp_count("text", F.lit("\n")) < max_lines).select("doc_id", "text", "quality")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"doc_id": df["doc_id"], "quality": df["quality"], "x": [counted(t).features.tobytes() for t in df["text"]]})

    got = rows.mapInPandas(features, "doc_id long, quality int, x binary").toArrow().to_pandas().sort_values(["doc_id", "x"])
    return fit([(np.frombuffer(x, np.float32).reshape(-1, FEATURES), int(y)) for x, y in zip(got["x"], got["quality"], strict=True) if x])


def judged(docs: DataFrame, model: Crf | None, least: float = 0.5) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``content_share`` and ``kept``.

    A text is kept unless the base rules fail it or less than ``least`` of its
    words lie in content lines.  A null text has no words, so the rules fail
    it.  Without a model the base rules decide alone.  Columns of the new
    names are replaced; repeated rows all come back.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "content_share": "double"}

    @F.pandas_udf(f"struct<{', '.join(f'{k}: {v}' for k, v in kinds.items())}>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                c = counted(t)
                share = 1.0 if crf is None else float(c.line_words @ crf.viterbi(c.features)) / max(c.n_words, 1)
                rows.append((c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.failed, not c.failed and share >= least, share))
            yield pd.DataFrame(rows, columns=list(kinds))

    kept = [c for c in docs.columns if c not in kinds]
    return docs.select(*kept, judge(F.col("text")).alias("_q")).select(*kept, *[f"_q.{c}" for c in kinds])


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from ``labels`` and judges every document."""
    model = learn(docs, labels)
    return judged(docs.select("doc_id", "text"), model).drop("text")

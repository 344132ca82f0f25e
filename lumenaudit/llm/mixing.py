"""Mixing sources to target shares of all tokens.

Membership of a document in the sources is soft: a classifier over hashed token ids,
fitted on a bounded sample of labelled documents, gives a posterior from the text, and a
delivered label counts with a rate of ``label_noise`` errors. Documents of one delivered
source whose posteriors agree (in the likeliest source, and in its probability to a tenth)
have one rate. Their expected tokens of every source are summed where the documents are,
in one pass, and projected gradient steps on these sums fit the rates, between 0 and the
cap of the source, by least squares of expected against wanted tokens: the sums are exact,
so a step costs the same for any number of documents. The draw is stratified by rate and
token size, so that drawn totals follow the expected ones.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import cut, spread

FEATURES = 4096
PIECE = 200_000


@functools.cache
def _encoding(path: str | None):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """Ids of a text in a public tokenizer; very long texts are encoded in pieces that end at white space."""
    if not text:
        return np.zeros(0, np.int64)
    enc = _encoding(path)
    if len(text) <= PIECE:
        return np.array(enc.encode_ordinary(text), np.int64)
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            gap = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            end = gap if gap > at else end
        out.append(np.array(enc.encode_ordinary(text[at:end]), np.int64))
        at = end
    return np.concatenate(out)


class SourceClassifier:
    """Multinomial logistic regression over the square roots of hashed token frequencies."""

    def __init__(self, classes: int, rounds: int = 120, rate: float = 0.3, decay: float = 1e-4) -> None:
        self.classes, self.rounds, self.rate, self.decay = classes, rounds, rate, decay
        self.w = np.zeros((FEATURES, classes), np.float32)
        self.b = np.zeros(classes, np.float32)

    @staticmethod
    def features(ids: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(ids), FEATURES), np.float32)
        for k, i in enumerate(ids):
            if len(i):
                x[k] = np.sqrt(np.bincount(i % FEATURES, minlength=FEATURES) / len(i))
        return x

    def fit(self, ids: list[np.ndarray], y: np.ndarray) -> SourceClassifier:
        x, hot = self.features(ids), np.eye(self.classes, dtype=np.float32)[y]
        self.b = np.log(hot.mean(0) + 1e-3).astype(np.float32)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for t in range(1, self.rounds + 1):
            g = x.T @ (self.posterior_of(x) - hot) / max(1, len(x)) + self.decay * self.w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6) * 0.1
        return self

    def posterior_of(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, ids: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([self.posterior_of(self.features(ids[a : a + 256])) for a in range(0, len(ids), 256)]) if ids else np.zeros((0, self.classes), np.float32)


#: Parts of a posterior's largest probability, and of an octave of token sizes, that are told apart.
TENTHS, OCTAVE = 10, 4


class Mixture:
    """A fitted mixture: ``documents`` (``doc_id, source, tokens, rate, copies``), ``fit`` (what the rates give, before the draw) and ``report`` (with what was drawn)."""

    def __init__(self, documents: DataFrame, fit: DataFrame, report: DataFrame) -> None:
        self.documents, self.fit, self.report = documents, fit, report


def fit_rates(sums: np.ndarray, cap: np.ndarray, want: np.ndarray, held: np.ndarray, max_steps: int = 50_000, tolerance: float = 1e-9) -> tuple[np.ndarray, bool]:
    """(rate of each group of documents, did the steps settle): least squares of ``rate @ sums`` against ``want``, within 0..cap.

    Differences are relative to what a source holds or should hold. Accelerated projected
    gradient steps from rates in proportion to the wanted tokens.
    """
    scale = np.maximum(np.maximum(held, want), 1e-9)
    a, goal = sums / scale, want / scale
    mean = sums / np.maximum(sums.sum(1, keepdims=True), 1e-9)
    w = np.clip(mean @ (want / np.maximum(held, 1e-9)), 0, cap)
    size = np.linalg.norm(a, 2) ** 2 if a.size else 0.0
    if not size:
        return w, True
    v, t = w, 1.0
    for _ in range(max_steps):
        new = np.clip(v - a @ (v @ a - goal) / size, 0, cap)
        if np.abs(new - w).max() <= tolerance and np.abs(np.clip(new - a @ (new @ a - goal) / size, 0, cap) - new).max() <= tolerance:
            return new, True
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        # start anew where the last step went uphill
        if ((v - new) * (new - w)).sum() > 0:
            v, faster = new, 1.0
        else:
            v = new + (t - 1) / faster * (new - w)
        w, t = new, faster
    return w, False


def mix_sources(
    documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: float | str | None = None,
    sample_rows: int = 3000, sample_chars: int = 8_000_000, label_noise: float = 0.02, tokenizer: str | None = None, seed: int = 11,
) -> Mixture:
    """Fits and draws a mixture of ``size`` tokens: a number, None for as many as all documents have, or ``most``.

    ``most`` is the largest size at which every source that has documents reaches its share
    within its cap. At larger sizes some sources fall short, the others still get their
    share of the size, and the mixture is smaller than asked for.

    ``targets`` has ``source, target_share, max_repeats``; its rows are the classes (their
    number is the caller's, and only per-class numbers reach the driver). A document whose
    source is null or no class is placed by the classifier alone and capped like its most
    likely class. ``copies`` is the rate rounded down, and one more for the part of its
    stratum that the rest asks for, never above the cap. ``fit`` and ``report`` have one row
    per class: ``source, target_share, max_repeats, wanted_tokens, expected_tokens,
    expected_share, short`` (used as often as it may be, and still below what is wanted),
    ``settled`` (the gradient steps came to rest); the report also ``tokens`` (of
    delivered documents), ``drawn_tokens, drawn_share``.

    Only the classifier's sample is bounded (``sample_rows`` labelled rows chosen by a hash,
    ``sample_chars`` characters); token counts, posteriors and the fit cover all documents.
    To the driver come sums per delivered source, likeliest source, tenth of probability and
    quarter octave of size, whatever the number of documents. Null and empty texts have 0
    tokens; null ids and repeated ids are documents like any other; empty tables give a
    report of zeros.
    """
    spark = documents.sparkSession
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).orderBy("source").collect()
    names = [r["source"] for r in rows]
    share = np.array([float(r["s"] or 0) for r in rows])
    repeats = np.array([float(r["m"] or 0) for r in rows])
    k = len(names)
    place = {n: i for i, n in enumerate(names)}
    src = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("t"))
    total_rows = documents.count()
    if k == 0:
        raise ValueError("targets must name at least one source")

    # a bounded sample of labelled rows fits the classifier
    key = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(max(1, total_rows)))
    drawn = src.where(key < sample_rows).where(F.col("source").isin(names)).where(F.length("t") < sample_chars // 8).orderBy(F.xxhash64("doc_id", F.lit(seed))).limit(2 * sample_rows).collect()
    ids, y, chars = [], [], 0
    for r in drawn:
        chars += len(r["t"])
        if chars > sample_chars:
            break
        ids.append(token_ids(r["t"], tokenizer)), y.append(place[r["source"]])
    model = SourceClassifier(k)
    if ids:
        model.fit(ids, np.array(y))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(1).to_pylist()
            found = [token_ids(t.as_py(), tokenizer) for t in b.column(2)]
            q = model.posterior(found).astype(np.float64)
            known = np.array([place.get(s, -1) for s in given], int)
            on = known >= 0
            top = q.argmax(1) if len(q) else known
            tenth = np.minimum((q.max(1) * TENTHS).astype(int), TENTHS - 1) if len(q) else known
            p = q.copy()
            p[on] *= label_noise
            p[np.flatnonzero(on), known[on]] += 1 - label_noise
            n = np.array([len(f) for f in found], np.int64)
            part = (np.where(on, known, k) * k + top) * TENTHS + tenth
            sort = np.where(n > 0, 1 + np.floor(OCTAVE * np.log2(np.maximum(n, 1))), 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n), pa.array(part.astype(np.int32)), pa.array(sort.astype(np.int32)), pa.array(list(p.astype(np.float32)), pa.list_(pa.float32()))],
                names=["doc_id", "source", "tokens", "part", "sort", "p"],
            )

    table = cut(spread(src).mapInArrow(weigh, "doc_id long, source string, tokens long, part int, sort int, p array<float>"), "mixture")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents and expected tokens of every source, by part and size."""
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            code = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1)
            keys, back = np.unique(code, axis=0, return_inverse=True)
            n = b.column(0).to_numpy().astype(np.float64)
            p = b.column(3).flatten().to_numpy().reshape(-1, k).astype(np.float64)
            out = np.zeros((len(keys), k + 1))
            np.add.at(out, back.ravel(), np.concatenate([np.ones((len(n), 1)), p * n[:, None]], 1))
            for x, row in zip(map(tuple, keys.tolist()), out):
                held[x] = held[x] + row if x in held else row
        if held:
            v = np.array(list(held.values()))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.int32)) for c in zip(*held)), *(pa.array(c) for c in v.T)], names=["part", "sort", "n", *[f"s{i}" for i in range(k)]])

    columns = ", ".join(["n double", *[f"s{i} double" for i in range(k)]])
    summed = table.select("tokens", "part", "sort", "p").mapInArrow(partial, f"part int, sort int, {columns}").groupBy("part", "sort").agg(*[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in range(k)])])
    got = summed.orderBy("part", "sort").toArrow()
    part, sort, docs = (got.column(c).to_numpy() for c in ("part", "sort", "n"))
    cells = np.stack([got.column(f"s{i}").to_numpy() for i in range(k)], 1) if len(part) else np.zeros((0, k))
    parts, back = np.unique(part, return_inverse=True)
    sums = np.zeros((len(parts), k))
    np.add.at(sums, back, cells)
    own = parts // TENTHS // k
    cap = repeats[np.where(own < k, own, parts // TENTHS % k)] if len(parts) else np.zeros(0)

    held = sums.sum(0)
    if size == "most":
        reach = np.array([(cap[own == i, None] * sums[own == i])[:, i].sum() for i in range(k)])
        some = (share > 0) & (reach > 0)
        size = float((reach[some] / share[some]).min()) if some.any() else 0.0
    elif isinstance(size, str):
        raise ValueError(f"size={size!r}: a number of tokens, None or most")
    want = share * (held.sum() if size is None else float(size))
    rate, settled = fit_rates(sums, cap, want, held)
    expected = rate @ sums
    used = np.array([(rate[own == i] * sums[own == i].sum(1)).sum() >= 0.999 * (cap[own == i] * sums[own == i].sum(1)).sum() for i in range(k)], bool)
    short = used & (expected < 0.995 * want)

    # strata of one rate and like size: whole copies for all, one more for a part of them; the parts
    # of a source's strata are rounded together, in the order of size
    of = rate[back] if len(part) else np.zeros(0)
    whole = np.floor(of + 1e-9)
    loose = np.clip(of - whole, 0, None) * docs
    more = np.zeros(len(part), np.int64)
    rng = np.random.default_rng(seed)
    for o in np.unique(own):
        at = np.flatnonzero(own[back] == o)
        at = at[np.lexsort((part[at], sort[at]))]
        upto = np.floor(np.cumsum(loose[at]) + rng.random())
        more[at] = np.minimum(np.diff(np.r_[0, upto]), docs[at])
    strata = spark.createDataFrame([(int(a), int(b), float(r), int(w), int(m), int(n)) for a, b, r, w, m, n in zip(part, sort, of, whole, more, docs)], "part int, sort int, rate double, whole int, more long, docs long")
    # the plan has one row per stratum, a number that does not grow with the documents
    planned = table.select("doc_id", "source", "tokens", "part", "sort").join(F.broadcast(strata), ["part", "sort"])
    chosen = _draw(planned, seed + 1).select("doc_id", "source", "tokens", "rate", "copies")
    made = float(expected.sum())
    fit = spark.createDataFrame(
        [(n, float(share[i]), int(repeats[i]), float(want[i]), float(expected[i]), float(expected[i]) / made if made else None, bool(short[i]), settled) for i, n in enumerate(names)],
        "source string, target_share double, max_repeats int, wanted_tokens double, expected_tokens double, expected_share double, short boolean, settled boolean",
    )
    got = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"))
    everything = got.agg(F.sum("drawn_tokens").alias("all_drawn"))
    zero = F.lit(0).cast("long")
    # one row per class and one row of totals
    report = fit.join(got, "source", "left").crossJoin(F.broadcast(everything)).select(
        *fit.columns, F.coalesce("tokens", zero).alias("tokens"), F.coalesce("drawn_tokens", zero).alias("drawn_tokens"), (F.coalesce("drawn_tokens", zero) / F.nullif(F.col("all_drawn"), zero)).alias("drawn_share")
    )
    return Mixture(chosen, fit, report)


def _draw(planned: DataFrame, seed: int, ranges: int = 256) -> DataFrame:
    """Adds ``copies``: ``whole``, and one more for the ``more`` documents of each stratum with the smallest hash.

    Only strata that are drawn from in part are ordered, in ranges of the hash; running
    counts tell which ranges are taken whole, so a stratum of any size is no single task.
    """
    plain = planned.where((F.col("more") == 0) | (F.col("more") >= F.col("docs"))).withColumn("copies", F.col("whole") + F.when(F.col("more") > 0, 1).otherwise(0))
    open_ = planned.where((F.col("more") > 0) & (F.col("more") < F.col("docs"))).withColumn("h", F.xxhash64("doc_id", "tokens", F.lit(seed)))
    open_ = open_.withColumn("range", F.shiftrightunsigned("h", 64 - (ranges - 1).bit_length()))
    keys = ["part", "sort", "range"]
    before = F.sum("n").over(Window.partitionBy("part", "sort").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    per = open_.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy(*keys).orderBy("h", "doc_id")
    ranked = open_.join(per, keys).withColumn("r", F.row_number().over(order))
    ranked = ranked.withColumn("copies", F.col("whole") + F.when(F.col("before") + F.col("r") <= F.col("more"), 1).otherwise(0))
    return plain.unionByName(ranked.select(*plain.columns))

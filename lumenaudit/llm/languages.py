"""Languages of documents and of their stretches, with a confidence.

A bidirectional gated recurrent network over bytes labels every position. Positions are
pooled to words and words to stretches (the best path that pays for every change of
language), so names, numbers and single inserted words do not end a stretch; positions
are pooled over the document for its own probabilities. The network is fitted on a
bounded sample of labelled documents whose labels may be wrong: after a first round,
training pieces that contradict the network are dropped and the rest is fitted again.
Pieces are also shown as they look when decoded with a wrong charset.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.runtime import spread
from lumenaudit.llm.recurrent import STRIDE, ByteNetwork

#: Languages with their codes and English names.
LANGUAGES = {
    "en": "eng english", "de": "deu ger german", "fr": "fra fre french", "es": "spa spanish castilian", "pt": "por portuguese",
    "it": "ita italian", "nl": "nld dut dutch flemish", "pl": "pol polish", "sv": "swe swedish", "ru": "rus russian",
}
CODES = list(LANGUAGES)
_NAMES = {name: code for code, names in LANGUAGES.items() for name in [code, *names.split()]}

#: Fixed values: (charset a text was sent in, charset it was decoded with).
MIX_UPS = (
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("cp1252", "utf-8"), ("cp1252", "cp1250"),
    ("cp1252", "cp1251"), ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("cp1250", "utf-8"), ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("koi8-r", "latin-1"),
)

PIECE, MARGIN = 448, 32

#: Bytes of the table that remembers the best paths of the texts searched together.
PATH_CELLS = 1 << 26


def language_code(label: str | None) -> str | None:
    """The two-letter code a label names; null if it names none of the languages."""
    if label is None:
        return None
    return _NAMES.get(re.split(r"[^a-z]+", label.strip().lower())[0])


def _garbled(text: str, mix_up: tuple[str, str]) -> str:
    return text.encode(mix_up[0], "replace").decode(mix_up[1], "replace")


def even(text: str) -> str:
    """The text as the network sees it: compatibility forms resolved, lower case."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def _fixed(raw: bytes, size: int) -> np.ndarray:
    out = np.full(size, 32, np.uint8)
    out[: min(size, len(raw))] = np.frombuffer(raw[:size], np.uint8)
    return out


def train_network(texts: list[str], codes: list[int], pieces: int = 8000, size: int = 192, hidden: int = 24, epochs: int = 5, garble: float = 0.25, switch: float = 0.3, seed: int = 3) -> ByteNetwork:
    """Fits the network on ``pieces`` pieces of ``size`` bytes from labelled texts.

    Classes are drawn evenly and pieces from anywhere in a text. ``garble`` of them are
    shown in a wrong charset, ``switch`` of them change their language on the way.
    """
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(np.array(codes) == k) for k in range(len(CODES))]
    by = [b for b in by if len(b)]
    xs, ys = [], []

    def piece(n: int, length: int) -> tuple[bytes, int]:
        i = int(rng.choice(by[n % len(by)]))
        at = int(rng.integers(0, max(1, len(texts[i]) - length)))
        part = texts[i][at : at + length]
        if rng.random() < garble:
            part = _garbled(part, MIX_UPS[int(rng.integers(len(MIX_UPS)))])
        raw = even(part).encode("utf-8", "replace")
        return raw[int(rng.integers(0, STRIDE)) :], codes[i]

    for n in range(pieces if by else 0):
        raw, code = piece(n, size)
        label = np.full(size // STRIDE, code)
        if rng.random() < switch:
            # a second language from somewhere inside the piece on
            turn = int(rng.integers(size // 8, size - size // 8)) // STRIDE * STRIDE
            other, code = piece(int(rng.integers(len(by))), size)
            raw = raw[: turn - 1].ljust(turn - 1) + b" " + other
            label[turn // STRIDE :] = code
        xs.append(_fixed(raw, size)), ys.append(label)
    net = ByteNetwork(len(CODES), hidden)
    if not xs:
        return net
    x, y = np.stack(xs), np.array(ys)
    mask = np.ones((len(x), size // STRIDE), np.float32)
    net.fit(x, y, mask, 2)
    p = np.concatenate([np.exp(net.log_probabilities(x[a : a + 1024])).transpose(1, 0, 2) for a in range(0, len(x), 1024)])
    own = np.take_along_axis(p, y[:, :, None], 2)[:, :, 0]
    good = own.mean(1) > 0.3
    mask = mask * (own > 0.2)  # menus and notices in another language
    if good.sum() > len(x) // 3:
        x, y, mask = x[good], y[good], mask[good]
    net.fit(x, y, mask, epochs, rate=0.015)
    return net


def word_scores(net: ByteNetwork, texts: list[str], batch: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, owner, document probabilities): log-probabilities of every word and of every text.

    Words are runs between white space that hold a letter or digit. Texts are cut in
    pieces with a margin on both sides, so that the network sees its surroundings.
    """
    raws = [even(t).encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raws])
    k = len(CODES)
    logs = [np.empty((-(-n // STRIDE), k), np.float32) for n in sizes]
    owner, starts = [], []
    for i, n in enumerate(sizes):
        s = np.arange(0, max(int(n), 0), PIECE)
        owner.append(np.full(len(s), i)), starts.append(s)
    owner, starts = (np.concatenate(owner), np.concatenate(starts)) if len(owner) else (np.zeros(0, int), np.zeros(0, int))
    width = PIECE + 2 * MARGIN
    padded = [np.frombuffer(b" " * MARGIN + r + b" " * (width), np.uint8) for r in raws]
    for a in range(0, len(owner), batch):
        rows = range(a, min(a + batch, len(owner)))
        x = np.stack([padded[owner[j]][starts[j] : starts[j] + width] for j in rows])
        lp = net.log_probabilities(x)[MARGIN // STRIDE : (MARGIN + PIECE) // STRIDE].transpose(1, 0, 2)
        for n, j in enumerate(rows):
            s = starts[j] // STRIDE
            to = logs[owner[j]][s : s + PIECE // STRIDE]
            to[:] = lp[n, : len(to)]
    scores, own, doc = [np.zeros((0, k), np.float32)], [np.zeros(0, int)], np.full((len(texts), k), -np.log(k))
    for i, raw in enumerate(raws):
        if not raw:
            continue
        b = np.frombuffer(raw, np.uint8)
        token = b > 32
        edge = np.flatnonzero(np.diff(np.r_[False, token, False].astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        if not len(first):
            continue
        lower = b | 32
        solid = np.r_[0, np.cumsum(((lower >= 97) & (lower <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 0xC3))]
        word = solid[last] > solid[first]
        first, last = first[word], last[word]
        if not len(first):
            continue
        total = np.r_[np.zeros((1, k)), np.cumsum(logs[i], 0, dtype=np.float64)]
        s, e = first // STRIDE, -(-last // STRIDE)
        part = (total[e] - total[s]) / (e - s)[:, None]
        scores.append(part.astype(np.float32)), own.append(np.full(len(part), i))
        doc[i] = (total[e] - total[s]).sum(0) / (e - s).sum()
    doc -= doc.max(1, keepdims=True)
    doc = np.exp(doc * 4)
    return np.concatenate(scores), np.concatenate(own), doc / doc.sum(1, keepdims=True)


def best_paths(scores: np.ndarray, owner: np.ndarray, texts: int, change: float, floor: float) -> np.ndarray:
    """The language of every word on the best path of its text; each change of language costs ``change``."""
    s = np.maximum(scores, floor)
    size = np.bincount(owner, minlength=texts) if len(owner) else np.zeros(texts, int)
    start = np.r_[0, np.cumsum(size)][:-1]
    out = np.zeros(len(s), np.int8)
    # texts of like length together, as many as keep the table of origins small
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    a = 0
    while a < len(order):
        longest = int(size[order[a]])
        rows = order[a : a + max(1, min(512, PATH_CELLS // (longest * s.shape[1])))]
        a += len(rows)
        best = np.zeros((len(rows), s.shape[1]), np.float32)
        origin = np.zeros((longest, len(rows), s.shape[1]), np.int8)
        same = np.arange(s.shape[1], dtype=np.int8)
        live = np.array([int((size[rows] > t).sum()) for t in range(longest)])
        for t in range(longest):
            n = live[t]
            now = best[:n]
            top = now.argmax(1)
            jump = now[np.arange(n), top] - change
            stay = now >= jump[:, None]
            origin[t, :n] = np.where(stay, same, top[:, None])
            best[:n] = np.where(stay, now, jump[:, None]) + s[start[rows[:n]] + t]
        state = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            n = live[t]
            idx = np.arange(n)
            out[start[rows[:n]] + t] = state[:n]
            state[:n] = origin[t, idx, state[:n]]
    return out


def sample_network(documents: DataFrame, text: str, lang: str, sample_rows: int, sample_chars: int, **train) -> ByteNetwork:  # noqa: ANN003
    """The network fitted on at most ``sample_rows`` labelled documents (chosen by a hash) and ``sample_chars`` characters."""
    total = documents.count()
    h = F.xxhash64(text, lang)
    rows = documents.where(F.col(lang).isNotNull() & (F.length(text) >= 80) & (F.length(text) < sample_chars // 8)).where(F.pmod(h, F.lit(max(1, total))) < sample_rows * 2)
    texts, codes, chars = [], [], 0
    for r in rows.select(F.col(text).alias("t"), F.col(lang).alias("l")).orderBy(h).limit(sample_rows).collect():
        code = language_code(r["l"])
        chars += len(r["t"])
        if chars > sample_chars:
            break
        if code:
            texts.append(r["t"]), codes.append(CODES.index(code))
    return train_network(texts, codes, **train)


def language_stretches(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 1, sample_rows: int = 2000, sample_chars: int = 6_000_000,
    change: float = 30.0, floor: float = -2.5, network: ByteNetwork | None = None,
) -> DataFrame:
    """``doc_id, given, doc_lang, doc_confidence, stretch, lang, first_word, n_words, confidence``.

    One row per stretch of ``min_words`` or more words; ``given`` is the delivered label.
    ``confidence`` is the mean probability of the stretch's language over its words,
    ``doc_confidence`` that of the pooled document. Whole texts are read. Null, empty and
    wordless texts and null ids have no rows; repeated ids give rows for each document.
    Only the training sample is bounded; without a labelled document every language is
    equally likely.
    """
    net = network or sample_network(documents, text, lang, sample_rows, sample_chars)
    src = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("g")).where("doc_id is not null and t is not null")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) < 1_500_000):
                    chars += len(texts[end])
                    end += 1
                yield from _stretches(net, batch.slice(at, end - at), min_words, change, floor)
                at = end

    schema = "doc_id long, given string, doc_lang string, doc_confidence double, stretch int, lang string, first_word int, n_words int, confidence double"
    return spread(src).mapInArrow(label, schema)


def _stretches(net: ByteNetwork, batch: pa.RecordBatch, min_words: int, change: float, floor: float) -> Iterator[pa.RecordBatch]:
    texts = batch.column(1).to_pylist()
    scores, owner, doc = word_scores(net, texts)
    if not len(scores):
        return
    path = best_paths(scores, owner, len(texts), change, floor)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(path)])
    prob = np.exp(scores[np.arange(len(path)), path])
    conf = np.add.reduceat(prob, first) / n
    own = owner[first]
    begin = np.r_[True, own[1:] != own[:-1]]
    number = np.arange(len(own)) - np.maximum.accumulate(np.where(begin, np.arange(len(own)), 0))
    word0 = first - np.maximum.accumulate(np.where(begin, first, 0))
    keep = n >= min_words
    own, number, word0, n, conf, lang = own[keep], number[keep], word0[keep], n[keep], conf[keep], path[first][keep]
    names = np.array(CODES, object)
    at = pa.array(own)
    yield pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(at), batch.column(2).take(at), pa.array(names[doc.argmax(1)][own], pa.string()), pa.array(doc.max(1)[own]),
            pa.array(number, pa.int32()), pa.array(names[lang], pa.string()), pa.array(word0, pa.int32()), pa.array(n, pa.int32()), pa.array(conf.astype(np.float64)),
        ],
        names=["doc_id", "given", "doc_lang", "doc_confidence", "stretch", "lang", "first_word", "n_words", "confidence"],
    )


def label_cases(stretches: DataFrame, min_words: int = 40) -> DataFrame:
    """``doc_id, lang, confidence``: the languages of documents whose label is absent, names none, a wrong or only one of several languages.

    A document's languages are those of its stretches of ``min_words`` words or more;
    documents without any are no cases.
    """
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    given = names[F.element_at(F.split(F.lower(F.trim("given")), "[^a-z]+"), 1)]
    long = stretches.where(F.col("n_words") >= min_words).withColumn("code", given)
    found = long.groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("code").alias("code"), F.map_from_entries(F.collect_list(F.struct(F.col("stretch"), F.struct("lang", "confidence")))).alias("m"))
    case = (F.size("langs") > 1) | F.col("code").isNull() | (F.col("code") != F.col("langs")[0])
    best = F.array_max(F.transform(F.filter(F.map_values("m"), lambda x: x["lang"] == F.col("lang")), lambda x: x["confidence"]))
    return found.where(case).select("doc_id", "m", F.explode("langs").alias("lang")).select("doc_id", "lang", best.alias("confidence"))

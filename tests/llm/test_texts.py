import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenaudit.llm import leaks as L
from lumenaudit.llm.languages import CODES, MIX_UPS, _garbled, best_paths, label_cases, language_code, language_stretches, train_network, word_scores
from lumenaudit.llm.mixing import SourceClassifier, mix_sources, token_ids
from lumenaudit.llm.recurrent import ByteNetwork
from lumenaudit.llm.words import words

DOCS = "doc_id long, text string, lang string, source string, item_id string, windows int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1) for i, t, lang, s in rows], DOCS)


# -- leaks --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Hello,  WORLD\n42", ["hello", "world", "42"]), ("some neig-\nhbour", ["some", "neighbour"]), ("a <b>bold</b> wo<em>r</em>d<br>next", ["a", "bold", "word", "next"]),
        ("x&nbsp;y &amp; caf&eacute;", ["x", "y", "café"]), ("Tol­dun a​b", ["toldun", "ab"]), ("Ｓｏｍｅ ﬁne", ["some", "fine"]), ("café", ["café"]),
        ("Straße", ["strasse"]), ("snake_case 3-4\n5", ["snake", "case", "3", "4", "5"]), ("a < b > c", ["a", "b", "c"]), ("", []), (None, []),
    ],
)
def test_words(text, want):
    assert words(text) == want


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 3, 7]))
def test_block_index_finds_all_within_radius(seed, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    look = base[:100].copy()
    for i in range(100):
        for b in rng.integers(0, 64, int(rng.integers(0, radius + 3))):
            look[i] ^= np.uint64(1) << np.uint64(b)
    i, j = L.BlockIndex(base, radius).near(look)
    want = {(a, b) for a in range(100) for b in range(200) if bin(int(look[a] ^ base[b])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_simhash_matches_counting():
    f = np.random.default_rng(1).integers(0, 1 << 63, 70, dtype=np.uint64)
    got = L.simhashes(f, 11, step=16)
    bits = ((f[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
    for k in range(60):
        many = bits[k : k + 11].sum(0) * 2 > 11
        as_bytes = np.unpackbits(np.array([got[k]]).view(np.uint8)).reshape(8, 8)[:, ::-1].ravel()
        assert np.array_equal(np.packbits(np.unpackbits(np.array([got[k]]).view(np.uint8))), np.array([got[k]]).view(np.uint8))
        assert as_bytes.sum() == many.sum()


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"word{i}" for i in range(40)]
    items = [(k, " ".join(rng.choice(vocab, int(n)))) for k, n in enumerate(rng.integers(5, 60, 25))]
    rows = []
    for d in range(60):
        w = list(rng.choice(vocab, 80))
        t = items[int(rng.integers(25))][1].split()
        n = int(rng.integers(4, 30))
        w[20:20] = t[3 : 3 + n]
        rows.append((d, " ".join(w).upper().replace("WORD1 ", "word1,\n"), "en", "s"))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "short", "en", "s"), (None, items[3][1], "en", "s"), (7, rows[7][1], "en", "s")]
    its = spark.createDataFrame([(i, t, 1) for i, t in items] + [(99, None, 1), (None, items[0][1], 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.longest_run for r in L.leaked_passages(docs(spark, rows), its).where("longest_run >= 12").collect()}
    want = {}
    for d, t, *_ in rows:
        if d is None:
            continue
        w = words(t)
        for k, it in items:
            v = words(it)
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= 12:
                want[d, k] = best
    assert got == want and len(want) > 10


def test_leaks_find_small_edits(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    its = spark.createDataFrame([(1, text)], "item_id long, text string")
    edit = text.replace("seven eight", "7 8")
    out = L.leaked_passages(docs(spark, [(1, "x " * 30 + edit, "en", "s"), (2, "y " * 50, "en", "s")]), its).collect()
    assert [(r.doc_id, r.longest_run) for r in out] == [(1, 12)]
    assert L.leaked_passages(docs(spark, []), its).count() == 0
    assert L.leaked_passages(docs(spark, [(1, text, "en", "s")]), its.limit(0)).count() == 0


def test_shared_windows_are_indexed_once():
    shared = " ".join(f"w{i}" for i in range(14))
    items = L.Items(list(range(50)), [f"{shared} own{k} " + " ".join(f"o{k}x{i}" for i in range(12)) for k in range(50)], 12, 3)
    assert len(items.start) == 3 + 50 * 13 and len(items.place_at) == 50 * 16
    h = L.WordHashes()(shared.split())
    (batch,) = L._match(items, [h], [7], 0.8)
    assert batch.column("item_id").to_pylist() == list(range(50)) and set(batch.column("longest_run").to_pylist()) == {14} and set(batch.column("windows").to_pylist()) == {3}


def test_window_similarity_is_the_weighted_jaccard():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 8, 40)]
    items = L.Items([1, 2], [" ".join(base[:20]), " ".join(base[10:])], 12, 3)
    doc = L.WordHashes()([w if rng.random() > 0.15 else "zz" for w in base])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(doc) - 11), np.arange(len(items.start))))
    got = items.similarity(doc, i, j)
    for a, b, s in zip(i, j, got):
        p, q = np.unique(L.shingles(doc[a : a + 12])), np.unique(L.shingles(items.words[items.start[b] : items.start[b] + 12]))
        assert s == pytest.approx(items.weights(np.intersect1d(p, q)).sum() / items.weights(np.union1d(p, q)).sum())


def test_leaks_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [(k, " ".join(f"v{x}" for x in rng.integers(0, 500, 30))) for k in range(12)]
    its = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, [(k, "zz " + t, "en", "s") for k, t in items])
    whole = {(r.doc_id, r.item_id) for r in L.leaked_passages(d, its).collect()}
    monkeypatch.setattr(L, "SLICE_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in L.leaked_passages(d, its).collect()} == whole == {(k, k) for k in range(12)}


# -- mixing ---------------------------------------------------------------------------------


def test_long_texts_keep_their_tokens(monkeypatch):
    from lumenaudit.llm import mixing

    text = "some words " * 500
    whole = token_ids(text)
    monkeypatch.setattr(mixing, "PIECE", 100)
    assert np.array_equal(token_ids(text), whole) and len(token_ids(None)) == 0


def test_classifier_learns():
    rng = np.random.default_rng(3)
    ids = [rng.integers(100 * k, 100 * k + 150, 60) for k in (0, 1, 2) for _ in range(60)]
    y = np.repeat([0, 1, 2], 60)
    model = SourceClassifier(3).fit(ids[::2], y[::2])
    assert (model.posterior(ids[1::2]).argmax(1) == y[1::2]).mean() > 0.9


def test_mixture(spark):
    rows = [(i, f"alpha beta {'gamma ' * (i % 7 + 3)}", "en", "big" if i < 300 else "small") for i in range(340)]
    rows += [(1000, None, "en", "big"), (1001, "", "en", None), (1002, "alpha beta", "en", "other"), (None, "alpha", "en", "big"), (5, "alpha", "en", "big")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("gone", 0.2, 5)], "source string, target_share double, max_repeats int")
    m = mix_sources(docs(spark, rows), targets)
    report = {r.source: r for r in m.report.collect()}
    assert report["small"].short and report["gone"].short and not report["big"].short
    total = sum(len(token_ids(t)) for _, t, *_ in rows)
    assert abs(report["big"].expected_tokens - 0.5 * total) < 0.03 * total
    assert report["small"].drawn_tokens == 2 * report["small"].tokens
    d = m.documents.collect()
    assert len(d) == len(rows) and all(0 <= r.copies <= (2 if r.source == "small" else 5) for r in d)
    assert all(r.settled for r in report.values())
    assert {r.source for r in mix_sources(docs(spark, []), targets).report.where("short").collect()} == set()


def test_mixture_meets_its_shares(spark):
    words = {"news": "market paper minister", "code": "return import value", "forum": "thanks anybody please", "wiki": "born river century"}
    rng = np.random.default_rng(0)
    many = {"news": 900, "code": 300, "forum": 200, "wiki": 60}
    rows = [(i, " ".join(rng.choice(words[s].split(), int(rng.integers(20, 400)))), "en", s) for i, s in enumerate(x for x, n in many.items() for _ in range(n))]
    targets = spark.createDataFrame([("news", 0.3, 1), ("code", 0.3, 2), ("forum", 0.25, 2), ("wiki", 0.15, 3)], "source string, target_share double, max_repeats int")
    m = mix_sources(docs(spark, rows), targets, size="most")
    report = {r.source: r for r in m.report.collect()}
    for r in report.values():
        assert abs(r.expected_share - r.target_share) < 0.01 * r.target_share + 0.001 and not r.short and r.settled
        assert abs(r.drawn_share - r.target_share) < 0.02 * r.target_share + 0.002
    total = sum(r.drawn_tokens for r in report.values())
    most = min(sum(len(token_ids(t)) for _, t, _, x in rows if x == s) * m / w for s, w, m in ((r.source, r.target_share, r.max_repeats) for r in targets.collect()))
    assert 0.95 * most < total < 1.02 * most
    assert sum(r.drawn_tokens for r in mix_sources(docs(spark, rows), targets, size=20_000).report.collect()) == pytest.approx(20_000, rel=0.03)
    with pytest.raises(ValueError):
        mix_sources(docs(spark, rows), targets, size="all")


# -- languages -------------------------------------------------------------------------------

TEXT = {
    "en": "the old worker carries every small basket behind our garden because this market needs another table and the window shows some morning",
    "de": "der alte Arbeiter trägt jeden kleinen Korb hinter unseren Garten weil dieser Markt einen anderen Tisch braucht und das Fenster zeigt manchen Morgen",
    "ru": "старый рабочий несёт каждую маленькую корзину за наш сад потому что этот рынок ищет другой стол и окно показывает какое-то утро",
}


def corpus(n=240, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        code = list(TEXT)[k % 3]
        out.append((" ".join(rng.choice(TEXT[code].split(), 70)), code))
    return out


@pytest.fixture(scope="module")
def net():
    data = corpus()
    return train_network([t for t, _ in data], [CODES.index(c) for _, c in data], pieces=3000, epochs=3)


def test_paths_of_mixed_lengths(monkeypatch):
    from lumenaudit.llm import languages

    rng = np.random.default_rng(2)
    size = [5, 400, 0, 17, 60, 1]
    owner = np.repeat(np.arange(len(size)), size)
    scores = np.log(rng.dirichlet(np.ones(len(CODES)), len(owner))).astype(np.float32)
    want = languages.best_paths(scores, owner, len(size), 3.0, -2.5)
    monkeypatch.setattr(languages, "PATH_CELLS", 100)
    assert (languages.best_paths(scores, owner, len(size), 3.0, -2.5) == want).all()


def test_both_ways_of_running_agree():
    net = ByteNetwork(3, hidden=5, seed=1)
    net.weights = {k: (4 * w).astype(np.float32) for k, w in net.weights.items()}
    x = np.random.default_rng(0).integers(0, 256, (7, 40)).astype(np.uint8)
    for d in "fb":
        assert np.allclose(net._run(d, x), net._states(d, x), atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    n = ByteNetwork(3, hidden=4)
    n.weights = {k: v.astype(np.float64) for k, v in n.weights.items()}
    x, y = rng.integers(0, 256, (5, 8)).astype(np.uint8), rng.integers(0, 3, (5, 4))
    mask = np.ones((4, 5), np.float32)
    grads, _ = n.gradients(x, y, mask)
    for name in ("fu", "bu", "fb", "fc", "v", "o"):
        at = tuple(rng.integers(0, s) for s in n.weights[name].shape)
        old = n.weights[name][at]
        n.weights[name][at] = old + 1e-2
        up = n.gradients(x, y, mask)[1]
        n.weights[name][at] = old - 1e-2
        down = n.gradients(x, y, mask)[1]
        n.weights[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_held_out_accuracy(net):
    data = corpus(90, seed=9)
    _, _, doc = word_scores(net, [t for t, _ in data])
    assert np.mean([CODES[k] == c for k, (_, c) in zip(doc.argmax(1), data)]) > 0.95
    bad = [_garbled(t, MIX_UPS[0]) for t, c in data if c == "ru"]
    _, _, doc = word_scores(net, bad)
    assert np.mean([CODES[k] == "ru" for k in doc.argmax(1)]) > 0.9


def test_best_path_pays_for_changes():
    rng = np.random.default_rng(2)
    scores, owner = rng.normal(-2, 1, (60, 10)).astype(np.float32), np.repeat([0, 2], [25, 35])
    path = best_paths(scores, owner, 3, 1.5, -9)
    for o in (0, 2):
        s = scores[owner == o]
        value = np.zeros(10)
        for row in s:
            value = np.maximum(value, value.max() - 1.5) + row
        p = path[owner == o]
        got = s[np.arange(len(s)), p].sum() - 1.5 * (p[1:] != p[:-1]).sum()
        assert got == pytest.approx(value.max(), abs=1e-3)


def test_stretches_and_cases(spark, net):
    de, en, ru = (" ".join([TEXT[c]] * 4) for c in ("de", "en", "ru"))
    rows = [(1, de, "de-DE", "s"), (2, de, "English", "s"), (3, de + " " + en, "ger", "s"), (4, ru, None, "s"), (5, en, "und", "s"), (6, "the old worker", None, "s"), (7, None, "en", "s"), (8, "", "en", "s"), (9, "!!! --", "en", "s"), (None, en, "xx", "s"), (10, en, "EN_us", "s")]
    out = language_stretches(docs(spark, rows), network=net)
    got = {(r.doc_id, r.lang) for r in label_cases(out).collect()}
    assert got == {(2, "de"), (3, "de"), (3, "en"), (4, "ru"), (5, "en")}
    per = out.where("doc_id = 3").orderBy("stretch").collect()
    assert [r.lang for r in per] == ["de", "en"] and abs(per[1].first_word - len(de.split())) <= 3 and all(0.5 < r.confidence <= 1 for r in per)
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, 10}
    assert language_stretches(docs(spark, []), network=net).count() == 0


def test_language_codes():
    assert [language_code(x) for x in ("EN", "en-US", " deu ", "Portuguese", "pt_br", "xx", "", "unknown", None)] == ["en", "en", "de", "pt", "pt", None, None, None, None]

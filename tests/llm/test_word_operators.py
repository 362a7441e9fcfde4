"""Collocations, spelling variants and the language model against brute force and odd inputs."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapbook.llm import collocations, hmm, quotient_filter, spelling_variants, word_chunks
from gapbook.llm.collocations import CollocationSettings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "\n\t", "a", "A", "a b", "a  B\n", "x" * 300_000, "  two  spaces ", "日本語 テキスト 🙂", "école École ÉCOLE", ". . !", "é" * 40, "a.b,c", None]
CLASHES = ("key", "chunk", "word", "n", "place", "phrase", "size", "a", "x", "y", "longer", "ids", "train", "asked", "form", "root", "rank")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang) for r in docs.orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    data = [(k, t, None if k % 2 else "en", "s", 0) for k, t in enumerate(ODD)] + [(3, "a", "en", "s", 0), (None, "a b", None, None, None)]
    return spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES})


# -- quotient filters


@pytest.mark.parametrize(("n", "bits", "q"), [(2, 5, 3), (2, 32, 10), (3, 20, 8), (3, 32, 12), (4, 17, 0), (4, 32, 20)])
def test_filters_count_without_loss(n, bits, q):
    rng = np.random.default_rng(n * bits)
    layout = quotient_filter.Layout(n, bits, q)
    shards = [[rng.integers(0, min(1 << bits, 40), 500) + (1 << bits) - min(1 << bits, 40) for _ in range(n)] for _ in range(3)]
    expected = Counter(gram for shard in shards for gram in zip(*(w.tolist() for w in shard), strict=True))
    filters = [quotient_filter.CountingQuotientFilter(layout, *layout.packed(shard)) for shard in shards]
    by = defaultdict(list)
    for k, f in enumerate(filters):
        assert np.array_equal(f.counts, np.bincount(f.place))
        for quotient, start, *run in f.runs():
            by[quotient].append((k, start, tuple(run)))
    found = {}
    for quotient, own in by.items():
        words, total, often = quotient_filter.merged(layout, quotient, [r for _, _, r in own], 2)
        for *gram, count in zip(*(w.tolist() for w in words), total.tolist(), strict=True):
            found[tuple(gram)] = count
        for (k, start, _), o in zip(own, often, strict=True):
            for place in range(len(o)):
                gram = tuple(int(w[0]) for w in layout.words(filters[k].a[[start + place]], filters[k].b[[start + place]]))
                assert o[place] == (expected[gram] >= 2)
    assert found == {g: c for g, c in expected.items() if c >= 2}


# -- collocations


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_collocations(rows, least, most, top, inside):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        often = {g: c for g, c in own.items() if len(g) > 1 and c >= least}
        covered = set()
        for g, c in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    part = g[i : i + k]
                    if 100 * c >= inside * own[part]:
                        covered.add(part)
        scored = []
        for g, a in often.items():
            if g not in covered:
                s, k = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-s, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "inside"), [(4, 40, 80), (2, 5000, 100)])
def test_collocations_equal_brute_force(docs, rows, least, top, inside, monkeypatch):
    monkeypatch.setattr(word_chunks, "CHUNK_WORDS", 3000)
    monkeypatch.setattr(collocations, "LEAST_QUOTIENT", 3)
    found = collocations.collocations(docs.repartition(3), CollocationSettings(least=least, top=top, inside=inside))
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, least, 4, top, inside)


def test_collocations_of_two_words_and_of_one(docs, rows):
    found = collocations.collocations(docs, CollocationSettings(least=6, most_words=2))
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, 6, 2, 2000, 80)
    assert collocations.collocations(docs, CollocationSettings(most_words=1)).count() == 0


def test_collocations_of_odd_and_empty_tables(spark, odd):
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    found = collocations.collocations(odd, CollocationSettings(least=1))
    assert sorted(tuple(r) for r in found.collect()) == brute_collocations(rows, 1, 4, 2000, 80)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_beyond_64_bits(spark):
    """2,000,000 * a passes 2 ** 63 here; a repeated phrase that ties goes by bytes."""
    counts = spark.createDataFrame([("e", "a b", 2, 9 * 10**12), ("e", "a", 1, 9 * 10**12 + 7), ("e", "b", 1, 10**18), ("e", "b a", 2, 9 * 10**12)], "lang string, phrase string, size int, a long")
    found = collocations.ranked(counts, spark.createDataFrame([("e", 10**18)], "lang string, n long"), CollocationSettings())
    expected = 2_000_000 * 9 * 10**12 // (9 * 10**12 + 7 + 10**18)
    assert [(r.phrase, r.score) for r in found.orderBy("rank").collect()] == [("a b", expected), ("b a", expected)]


# -- spelling variants


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return counts


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) < len(y):
        x, y = y, x
    return len(x) == len(y) + 1 and any(x[:k] + x[k + 1 :] == y for k in range(len(x)))


def brute_variants(counts, least):
    words = {w: n for w, n in counts.items() if n >= least}
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    form, near = {}, {}
    for w, n in words.items():
        own = [(-words[v], v) for k in (len(w) - 1, len(w), len(w) + 1) for v in by[k] if one_edit(w, v)]
        near[w] = len(own)
        form[w] = min(own)[1] if own and -min(own)[0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words.get(form[w])))
    return sorted(out)


def found_variants(frame, **more):
    return sorted(tuple(r) for r in spelling_variants.spelling_variants(frame, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("held", [1_000_000, 50])
def test_variants_equal_brute_force(docs, rows, held, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD_RUNS", held)
    monkeypatch.setattr(spelling_variants, "SHORT", 9)
    assert found_variants(docs) == brute_variants(brute_words(rows), 3)


def test_variants_at_every_place_of_words_of_many_lengths(spark):
    """Insertions, deletions and replacements at each place, of words of one letter repeated, too."""
    words = ["abcde", "abcdefghij", "aaaaaaa", "ababababab", "stratification", "überprüfungé", "x" * 300]
    edited = [v for w in words for k in range(len(w) + 1) for v in (w[:k] + "q" + w[k:], w[:k] + w[k + 1 :], w[:k] + "z" + w[k + 1 :])]
    data = [(k, " ".join([w] * (3 + k % 5)), None, None, None) for k, w in enumerate([*words * 3, *edited])]
    assert found_variants(spark.createDataFrame(data, SCHEMA), typo=10**9) == brute_variants(Counter(w for _, t, *_ in data for w in t.split() if len(w) >= 5), 3)


def test_variants_of_odd_and_empty_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_variants(odd, least_count=1) == brute_variants(brute_words(rows), 1)
    assert found_variants(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError, match="three letters"):
        spelling_variants.spelling_variants(odd, least_letters=2)


def test_long_chains_of_forms(spark):
    """Each word is twice as frequent as the one before, so roots are many steps away."""
    words = ["aaaaa" + "b" * k for k in range(9)]
    data = [(k, " ".join([w] * (3 * 2**k)), None, None, None) for k, w in enumerate(words)]
    found = found_variants(spark.createDataFrame(data, SCHEMA), typo=10**9)
    assert [(w, r) for w, _, r, *_ in found] == [(w, words[-1]) for w in words]


# -- the language model


def enumerated(model, e, symbols):
    """The probability of a sequence, and expected counts, by all state sequences."""
    k = len(model.start)
    total, counts, moves, starts = 0.0, np.zeros_like(e), np.zeros((k, k)), np.zeros(k)
    for path in itertools.product(range(k), repeat=len(symbols)):
        p = model.start[path[0]] * math.prod(e[s, q] for s, q in zip(symbols, path, strict=True)) * math.prod(model.move[a, b] for a, b in itertools.pairwise(path))
        total += p
        starts[path[0]] += p
        for s, q in zip(symbols, path, strict=True):
            counts[s, q] += p
        for a, b in itertools.pairwise(path):
            moves[a, b] += p
    return total, counts / total, moves / total, starts / total


@pytest.fixture
def model():
    rng = np.random.default_rng(5)
    k, n = 3, 4

    def shares(*shape):
        x = rng.random(shape) + 0.1
        return x / x.sum(axis=-1, keepdims=True)

    special = rng.random((hmm.SPECIAL, k))
    return hmm.Model(shares(k), shares(k), shares(k, k), special, special.sum(axis=0) + n, np.full(hmm.SPECIAL, 0.1), 0.2, 50), shares(k, hmm.SPECIAL + n).T.copy()


def test_recursions_equal_all_state_sequences(model, monkeypatch):
    monkeypatch.setattr(hmm, "BATCH", 8)
    m, e = model
    texts = [[1], [3, 4, 1], [7, 8, 9, 7, 1], [1], [5, 1]]
    symbols, lengths = np.array([s for t in texts for s in t]), np.array([len(t) for t in texts])
    parts = [enumerated(m, e, t) for t in texts]
    counts, moves, starts, log = m.gather(symbols, lengths, e)
    assert np.allclose(counts, sum(p[1] for p in parts), atol=1e-5) and np.allclose(moves, sum(p[2] for p in parts), atol=1e-5)
    assert np.allclose(starts[0], sum(p[3] for p in parts), atol=1e-5) and np.allclose(starts[1], 0)
    assert np.isclose(log, sum(math.log(p[0]) for p in parts), rtol=1e-5)
    assert np.allclose(m.log_likelihoods(symbols, lengths, e), [math.log(p[0]) for p in parts])


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 1000])
def test_chained_segments_are_exact(model, segment, monkeypatch):
    m, e = model
    rng = np.random.default_rng(segment)
    lengths = np.array([1, 40, 3, 6, 7, 13, 2, 200])
    symbols = rng.integers(0, len(e), lengths.sum())

    def plain(own):
        a, log = m.start * e[own[0]], 0.0
        for s in own[1:]:
            log += math.log(a.sum())
            a = (a / a.sum()) @ m.move * e[s]
        return log + math.log(a.sum())

    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "SCORED", segment)
    monkeypatch.setattr(hmm, "BATCH", 50)
    assert np.allclose(m.log_likelihoods(symbols, lengths, e), [plain(own) for own in np.split(symbols, np.cumsum(lengths)[:-1])])
    assert np.isclose(m.gather(symbols, lengths, e)[0].sum(), len(symbols), rtol=1e-5)


def steps_taken(monkeypatch):
    taken, lay = [], hmm.Steps.lay

    def counted(*args):
        taken.append(lay(*args))
        return taken[-1]

    monkeypatch.setattr(hmm.Steps, "lay", staticmethod(counted))
    return lambda: sum(len(s.of) - 1 for s in taken)


def test_texts_of_like_lengths_go_in_step(model, monkeypatch):
    """Time goes by steps as well as by tokens: short texts among long ones must not each time wait for these."""
    m, e = model
    rng = np.random.default_rng(4)
    lengths = rng.permutation(np.repeat([10, 100, 3000], [30_000, 3_000, 100]))
    symbols = rng.integers(0, len(e), lengths.sum())
    gathered = steps_taken(monkeypatch)
    assert np.isclose(m.gather(symbols, lengths, e)[0].sum(), len(symbols), rtol=1e-5) and gathered() < 1500
    scored = steps_taken(monkeypatch)
    assert (m.log_likelihoods(symbols, lengths, e) < 0).all() and scored() < 2500


def test_scoring_holds_no_states_of_a_long_text(model):
    import tracemalloc

    m, e = model
    symbols = np.random.default_rng(6).integers(0, len(e), 400_000).astype(np.uint32)
    tracemalloc.start()
    try:
        log = m.log_likelihoods(symbols, np.array([len(symbols)]), e)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert log < 0 and peak < 60 << 20


@pytest.mark.parametrize("rare", [0.1, 1e-3, 1e-9])
def test_counts_equal_plain_recursions_with_rare_transitions(rare, monkeypatch):
    """Shares are scaled seldom, in single precision: also words that a state hardly has, after one another."""
    k, n = 3, 9
    rng = np.random.default_rng(7)
    move = np.full((k, k), rare)
    np.fill_diagonal(move, 1 - (k - 1) * rare)
    e = np.full((hmm.SPECIAL + n, k), 1e-12)
    e[np.arange(len(e)), np.arange(len(e)) % k] = 1e-6
    start, onward = np.array([1e-9, 0.3, 0.7 - 1e-9]), np.array([0.5, 0.25, 0.25])
    m = hmm.Model(start, onward, move, None, None, None, 0.1, 50)
    texts = [rng.integers(0, len(e), size) for size in (1, 2, 17, 40, 40, 40, 41, 300)]
    counts, moves, starts, log = np.zeros(e.shape), np.zeros((k, k)), np.zeros((2, k)), 0.0
    whole = []
    for text in texts:
        for at in range(0, len(text), 100):
            own = e[text[at : at + 100]]
            alpha, beta, scale = np.empty(own.shape), np.ones(own.shape), np.empty(len(own))
            for t in range(len(own)):
                alpha[t] = (alpha[t - 1] @ move if t else onward if at else start) * own[t]
                scale[t] = alpha[t].sum()
                alpha[t] /= scale[t]
            for t in range(len(own) - 1, 0, -1):
                after = own[t] * beta[t] / scale[t]
                beta[t - 1] = move @ after
                moves += np.outer(alpha[t - 1], after) * move
            np.add.at(counts, text[at : at + 100], alpha * beta)
            starts[int(at > 0)] += alpha[0] * beta[0]
            log += np.log(scale).sum()
        a, total = start * e[text[0]], 0.0
        for s in text[1:]:
            total += np.log(a.sum())
            a = a / a.sum() @ move * e[s]
        whole.append(total + np.log(a.sum()))
    symbols, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    monkeypatch.setattr(hmm, "SEGMENT", 100)
    found = m.gather(symbols, lengths, e)
    assert np.allclose(found[0], counts, atol=1e-3) and np.allclose(found[1], moves, atol=1e-3) and np.allclose(found[2], starts, atol=1e-4)
    assert np.isclose(found[3], log, rtol=1e-6)
    for most in (50, 1 << 20):
        monkeypatch.setattr(hmm, "SCORED_BATCH", most, raising=False)
        monkeypatch.setattr(hmm, "SCORED", most)
        assert np.allclose(m.log_likelihoods(symbols, lengths, e), whole, rtol=1e-10)


def brute_base(rows):
    split = [(i, zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False, re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))) for i, t, *_ in rows]
    counts = Counter(w for _, held, words in split if not held for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    return {(i, len(ws) + 1): (held, sum(counts[w] > 0 for w in [*ws, None]), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None])) for i, held, ws in split}


def test_language_model_counts_and_learns(docs, rows, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 3000)
    monkeypatch.setattr(word_chunks, "BUCKET_WORDS", 50)
    trained = hmm.train(docs, rounds=4)
    assert all(a < b for a, b in itertools.pairwise(trained.logs))
    found, expected = hmm.score(trained).collect(), brute_base(rows)
    assert len(found) == len(rows)
    for r in found:
        held, known, n, base = expected[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_chances_of_all_tokens_sum_to_one(docs):
    """Over the unknown word, the end and all training words, in each state."""
    trained = hmm.train(docs, states=3, rounds=2)
    words = trained.stats.where("word_id > 0").orderBy("word_id").select("s0", "s1", "s2").collect()
    c = Counter()
    for r in trained.corpus.coded.select("words", "occurrences").collect():
        c |= dict(zip(r.words, r.occurrences, strict=True))
    e = trained.model.emissions(np.array(words), np.array([c[k] for k in sorted(c)]))
    assert np.allclose(e.sum(axis=0), 1)


def test_every_training_word_has_counts_of_its_own(docs, rows):
    """However rare, and whatever the size of the corpus."""
    trained = hmm.train(docs, states=3, rounds=2)
    n = Counter(w for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")))
    found = trained.stats.collect()
    assert len({r.word_id for r in found}) == len(found) == len(n)
    assert np.allclose(sorted(r.s0 + r.s1 + r.s2 for r in found), sorted(n.values()))
    assert not hasattr(hmm, "own_least")


def test_expected_counts_travel_as_parts():
    counts = np.random.default_rng(3).random((200, 6)) ** 8
    counts *= (np.arange(200) / counts.sum(axis=1))[:, None]
    parts, n = hmm.in_parts(counts)
    again = hmm.from_parts(hmm._received(hmm._sent(parts), 6), n)
    assert (parts.sum(axis=1) == hmm.WHOLE).all() and (n == np.arange(200)).all()
    assert np.allclose(again, counts, atol=n.max() * 5 / hmm.WHOLE) and (hmm.in_parts(again)[0][1:] == parts[1:]).all()


def test_language_model_of_odd_and_empty_tables(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found, expected = hmm.language_model(odd, rounds=2).collect(), brute_base(rows)
    assert len(found) == len(rows)
    for r in found:
        held, known, n, base = expected[r.doc_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (held, known, n) and math.isclose(r.base_score, base, abs_tol=1e-9)
    empty = spark.createDataFrame([], SCHEMA)
    assert hmm.language_model(empty).count() == 0
    alone = spark.createDataFrame([(i, "a b", None, None, None) for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2], SCHEMA)
    assert {(r.train_tokens, r.n_tokens, r.n_known, r.base_score, r.score) for r in hmm.language_model(alone).collect()} == {(0, 3, 0, 0.0, 0.0)}


def test_queries_read_whole_tables(spark):
    from gapbook.llm import queries

    own = queries.queries()
    assert own["op13_hmm"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert own["op11_collocations"](spark, SF).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert own["op12_spelling_variants"](spark, SF).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_filters_of_a_full_chunk_stay_small():
    import tracemalloc

    words = np.random.default_rng(2).integers(1, 1 << 17, word_chunks.CHUNK_WORDS).astype(np.uint32)
    mask = np.packbits(words > 0).tobytes()
    tracemalloc.start()
    try:
        _, own = collocations._filter(words, mask, quotient_filter.Layout(2, 17, 6))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert own.counts.sum() == len(words) - 1 and peak < 200 << 20

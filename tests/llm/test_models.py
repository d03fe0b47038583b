import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import langid, quality_crf, toxicity

from .conftest import ODD

SF_LARGER = "/root/testdata/sf0.01"


def _counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(hit)}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#%\x1c\xa0é"))
def test_base_counts(text):
    assert quality_crf.base_counts(text)[0] == _counts(text)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 0), (7, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_crf.rate(odd, labels).collect()
    assert len(rows) == len(ODD)
    texts = {d: t for d, t, *_ in ODD}
    for r in rows:
        if r.doc_id not in (5, 6):
            assert {c: r[c] for c in quality_crf.COUNTS} == _counts(texts[r.doc_id] or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_without_labels_or_rows(spark, odd, make):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_crf.rate(odd, none).collect())
    assert quality_crf.rate(make([]), none).count() == 0


def test_viterbi_is_the_best_of_all():
    rng = np.random.default_rng(0)
    field = quality_crf.Field(rng.normal(size=len(quality_crf.FEATURES)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        x = rng.integers(0, 2, (n, len(quality_crf.FEATURES)))
        gain = x @ field.weights

        def score(labels, gain=gain):
            return sum(g * y for g, y in zip(gain, labels, strict=True)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(score([k >> b & 1 for b in range(n)]) for k in range(1 << n))
        assert abs(score(field.viterbi(x)) - best) < 1e-9


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_crf.rate(docs, labels).join(labels, "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 AND NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ .éß中а "))
def test_grams(text):
    codes, counts = langid.grams(text)
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    want: Counter = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                v = 1
                for c in g:
                    v = v << 21 | (0 if c == " " else ord(c))
                want[v] += 1
    if padded.strip():
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == dict(want)
    assert codes.tolist() == sorted(codes.tolist())


def test_language_odd_rows(odd):
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1


def test_language_without_rows(make):
    assert langid.identify(make([])).count() == 0
    assert [r.lang_pred for r in langid.identify(make([(1, "words", None, "a")])).collect()] == ["und"]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_gradients_are_those_of_the_loss():
    texts, y = ["you are an idiot here", "quite a fine day", "idiot fool", "a fine fine thing"], np.array([1, 0, 1, 0], np.float32)
    net = toxicity.Network(toxicity.Odds([toxicity.words_of(t) for t in texts], y))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = sorted({w for t in texts for w in toxicity.words_of(t)})
    x, _ = net.inputs(words)
    x = x.astype(np.float64)
    every, owner = toxicity._cut([np.array([words.index(w) for w in toxicity.words_of(t)]) for t in texts], len(words))
    x = np.concatenate((x, np.zeros((1, x.shape[1]))))
    mask = (every != len(words)).astype(np.float64)

    def loss():
        logits = net.forward(net.projected(x)[every], mask)
        return float(np.logaddexp(0, logits).sum() - (logits * y[owner]).sum())

    logits, kept = net.forward(net.projected(x)[every], mask, keep=True)
    grad, _ = net.backward(1 / (1 + np.exp(-logits)) - y[owner], kept)
    for name in ("Uf", "Ub", "attend", "out"):
        flat, g = net.p[name].ravel(), grad[name].ravel()
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            was = flat[k]
            flat[k] = was + 1e-2
            up = loss()
            flat[k] = was - 1e-2
            down = loss()
            flat[k] = was
            assert abs((up - down) / 2e-2 - g[k]) < 0.02 * max(1, abs(g[k]))


def test_toxicity_odd_rows(spark, odd, make):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, 1, 1), (8, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.rate(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.rate(odd, none).collect()} == {0.0}
    assert toxicity.rate(make([]), labels).count() == 0
    net = toxicity.learn(odd, labels)
    assert toxicity.reject(odd, net).columns == odd.columns


def test_windows_cover_the_text():
    for n in range(0, 200):
        starts = toxicity.windows(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and (np.diff(starts) == toxicity.STRIDE).all()


def test_toxicity_learns():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeiou") + list("bdfgklmnprst"), 6)) for _ in range(300)]
    texts, y = [], []
    for k in range(400):
        words = list(rng.choice(plain, 80))
        if k % 3 == 0:
            for at in rng.integers(0, 80, 3):
                words[at] = rng.choice(["scumbag", "moron", "vequar", "vequis", "vequon"])
        texts.append(" ".join(words))
        y.append(int(k % 3 == 0))
    scorer = toxicity.Scorer(toxicity.train(texts[:300], y[:300]))
    got = scorer([*texts[300:], " ".join([*plain[:200], "vequend", *plain[:200]]), None, ""])
    assert np.mean((got[:100] >= 0.5) == np.array(y[300:])) > 0.95
    assert got[-1] == got[-2] < 0.5


def test_field_learns_all_lines(spark, monkeypatch):
    """Boilerplate at the end of a long training document, and its last line, are learnt too."""
    seen = []
    monkeypatch.setattr(quality_crf, "fitted", seen.extend)
    text = "".join(f"line {k}\n" for k in range(300)) + "| menu | end |"
    docs = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string")
    quality_crf.learn(docs, spark.createDataFrame([(k, 0) for k in range(20)], "doc_id long, quality int"))
    assert seen and all(len(x) == len(sizes) == 301 and q == 0 and x[-1][quality_crf.FEATURES.index("last")] for x, sizes, q in seen)


def _pages(docs):
    for r in docs:
        counts, _, hit = quality_crf.base_counts(r.text or "")
        x, sizes = quality_crf.line_features(r.text or "", hit)
        if len(x) and not quality_crf.base_failed(counts):
            yield x, sizes, r.quality


@pytest.fixture(scope="module")
def field(spark):
    docs, labels = (spark.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    return quality_crf.learn(docs, labels)


def test_lines_of_a_text_differ(spark, field):
    """Bad documents hold clean lines, too: a good part of them gets both labels, and the share decides."""
    docs, labels = (spark.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    labelled = [(x, np.array(field.viterbi(x)), sizes, q) for x, sizes, q in _pages(docs.join(labels, "doc_id").collect())]
    bad = [y for _, y, _, q in labelled if q == 0 and len(y) > 1]
    assert sum(0 < y.sum() < len(y) for y in bad) >= 0.3 * len(bad)
    assert sum(((y * sizes).sum() >= quality_crf.KEEP_SHARE * sizes.sum()) == bool(q) for _, y, sizes, q in labelled) >= 0.95 * len(labelled)


BODY = [
    "The committee met on Tuesday to discuss the new library, which will open in the spring of next year.",
    "Several members asked about the cost of the building, and the mayor said that it would be paid for by the region.",
    "Work on the site will begin as soon as the permits have been given, and it should take about ten months in all.",
]


def _labels(field, page):
    _, _, hit = quality_crf.base_counts(page)
    return field.viterbi(quality_crf.line_features(page, hit)[0])


def test_pages_made_by_hand(field):
    menu, bottom = "Home | About | Contact | Login | Help", "Copyright ### all rights ### reserved ### here ###"
    assert _labels(field, "\n".join([menu, *BODY, bottom, menu])) == [0, 1, 1, 1, 0, 0]
    assert _labels(field, "\n".join(BODY)) == [1, 1, 1]
    assert _labels(field, "\n".join([menu, bottom, menu, bottom])) == [0, 0, 0, 0]


def test_constraint_turns_the_least_certain_lines():
    sizes, odds = np.array([10, 10, 10]), np.array([3.0, -1.0, 0.5])
    assert quality_crf.constrained(np.array([1, 0, 1]), odds, sizes, 0).tolist() == [1, 0, 0]
    assert quality_crf.constrained(np.array([0, 0, 0]), odds, sizes, 1).tolist() == [1, 0, 1]
    assert quality_crf.constrained(np.array([1, 0, 1]), odds, sizes, 1).tolist() == [1, 0, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcdeéß ", min_size=1, max_size=60), min_size=1, max_size=4), st.text(alphabet="abcdeéß ", max_size=80))
def test_nearest_profile(samples, text):
    """Ranks, the out-of-place distance and the winner, worked out with plain lists."""

    def ranked(t):
        codes, counts = langid.grams(t)
        return [c for _, c in sorted(zip((-counts).tolist(), codes.tolist(), strict=True))][:12]

    lists = {f"l{k}": ranked(t) for k, t in enumerate(samples) if ranked(t)}
    own = ranked(text)
    far = {lang: sum(abs(p.index(g) - k) if g in p else 12 for k, g in enumerate(own)) for lang, p in lists.items()}
    got = langid.Profiles({k: np.array(v, np.uint64) for k, v in lists.items()}, 12).judge(text)
    if not own or not lists:
        assert got == ("und", 0.0)
    else:
        best = min(far, key=lambda k: (far[k], k))
        assert got[0] == best and abs(got[1] - (1 - far[best] / (12 * len(own)))) < 1e-12


def _one_window(net, words):
    """The logit of a window, step by step."""
    p, h = net.p, toxicity.HIDDEN
    x = net.inputs(words)[0].astype(float) if words else np.zeros((0, toxicity.INPUTS))
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = {}
    for d in "fb":
        state, seen = np.zeros(h), {}
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            g, u = x[t] @ p[f"W{d}"] + p[f"b{d}"], state @ p[f"U{d}"]
            z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
            state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
            seen[t] = state
        states[d] = seen
    rows = np.array([np.concatenate((states["f"][t], states["b"][t])) for t in range(len(x))]).reshape(len(x), 2 * h)
    if not len(rows):
        return None
    a = np.exp(rows @ p["attend"] - (rows @ p["attend"]).max())
    return float((a / a.sum()) @ rows @ p["out"] + p["bias"][0])


def test_every_window_counts():
    """The score of a text is that of its highest window, worked out here one by one."""
    texts = ["you are an idiot here", "quite a fine day", "idiot fool", "a fine fine thing"] * 3
    net = toxicity.train(texts, [1, 0, 1, 0] * 3, rounds=1, epochs=2)
    rng = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 33, 64, 100):
        words = [str(w) for w in rng.choice(["quite", "fine", "idiot", "day", "thing", "fool"], n)]
        each = [_one_window(net, words[a : a + toxicity.WINDOW]) for a in range(0, n, toxicity.STRIDE)]
        best = max(e for e in each[: max(1, -(-(n - toxicity.STRIDE) // toxicity.STRIDE))] if e is not None)
        assert abs(toxicity.Scorer(net)([" ".join(words)])[0] - 1 / (1 + np.exp(-best))) < 1e-4


def test_the_learnt_part_carries_weight(spark):
    """Without the odds of words and pieces, what the network learnt still tells toxic documents from clean ones."""
    docs, labels = (spark.read.parquet(f"{SF_LARGER}/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.learn(docs, labels)
    rows = docs.join(labels, "doc_id").where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 AND toxic IS NOT NULL").collect()
    toxic = np.array([r.toxic for r in rows], bool)
    whole = toxicity.Scorer(net)([r.text for r in rows])
    assert ((whole >= 0.5) == toxic).mean() >= 0.9
    net.odds.word[:], net.odds.piece[:] = 0, 0
    alone = toxicity.Scorer(net)([r.text for r in rows])
    higher = (alone[toxic][:, None] > alone[~toxic][None]).mean() + 0.5 * (alone[toxic][:, None] == alone[~toxic][None]).mean()
    assert higher > 0.6


def test_field_of_uneven_sequences():
    """Where training ends, the likelihood's slope, found here by all labellings, is the decay's."""
    rng = np.random.default_rng(1)
    width = len(quality_crf.FEATURES)
    sequences = [(rng.integers(0, 2, (n, width)).astype(float), rng.integers(0, 2, n)) for n in (2, 5, 1, 4)]

    def likelihood(theta):
        weights, moves, total = theta[:-4], theta[-4:].reshape(2, 2), 0.0
        for x, y in sequences:
            score = lambda labels, x=x: float(x @ weights @ labels) + sum(moves[a, b] for a, b in zip(labels, labels[1:], strict=False))
            total += score(y) - np.log(sum(np.exp(score(np.array([k >> b & 1 for b in range(len(y))]))) for k in range(1 << len(y))))
        return total / sum(len(y) for _, y in sequences)

    field = quality_crf.Field.trained(sequences, rounds=3000, rate=0.02, decay=0.05)
    theta = np.concatenate((field.weights, field.moves.ravel()))
    slope = [(likelihood(theta + step) - likelihood(theta - step)) / 2e-5 for step in np.eye(len(theta)) * 1e-5]
    assert np.allclose(slope, 0.05 * theta, atol=2e-3)

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, licenses, media, mixing, neardup, packing, quality, suffixes, topk, toxicity

from .conftest import ROWS


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


# -- 1 licences -----------------------------------------------------------------------


def test_licences(spark, odd, none):
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["n_words"], got[1]["first_word"]) == ("mit,reserved", "reserved", 8, 5)
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[2]["labels"] == "" and got[8]["n_words"] == 9000
    assert licenses.scan(none).isEmpty()


def test_templates():
    a = licenses.Automaton((("x", "one [[two three]] <<2>> four"), ("y", "<<1>> end")))
    places = lambda s: [(k, i) for k, i in a.places(licenses.words(s.encode())) if k == 0]
    assert places("one four") == [(0, 0)] and places("One two-three a b FOUR") == [(0, 0)] and places("one a b c four") == [] and places("one two four") == [(0, 0)]
    assert places("one one four") == [(0, 0), (0, 1)]


def test_licence_texts():
    """A whole text is accepted with other holders and without its optional parts, and refused with other wording."""
    a = licenses.Automaton(licenses.TEMPLATES)
    labels = lambda text: {licenses.TEMPLATES[k][0] for k, _ in a.places(licenses.words(text.encode()))}
    for label, markup in licenses.TEMPLATES:
        least = re.sub(r"\[\[(?:[^\[\]]|\[\[[^\]]*\]\])*\]\]", " ", markup)
        short, full = re.sub(r"<<\d+>>", " ", least), re.sub(r"\[\[|\]\]", " ", re.sub(r"<<\d+>>", "Someone Else", markup))
        assert label in labels(f"Before. {short} After.") and (label in ("cc-by-sa", "gpl-notice") or label in labels(full))
        words = short.split()
        assert label not in labels(" ".join([*words[: len(words) // 2], "surely", *words[len(words) // 2 :]]))
    mit = dict(licenses.TEMPLATES)["mit-text"].replace("<<12>>", "The Authors Of This Thing")
    assert {"mit-text", "mit-grant"} <= labels(mit) and labels(mit.replace("merge", "mangle")) == {"mit-grant"}


# -- 2 repeated passages --------------------------------------------------------------


def brute_removed(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        d = math.inf if d is None else d
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, math.inf), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (math.inf if d is None else d):
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d if d != math.inf else None, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(len(parts)), s[a : a + rng.randint(40, 400)])
        rows.append((d, " ".join(parts)))
    rows += [(60, "ab" * 200), (61, "ab" * 100), (62, "x" * 49), (63, "x" * 49), (64, "x" * 60), (65, "x" * 60), (65, "x" * 60), (None, "x" * 60)]
    return rows


@pytest.mark.parametrize("hot,size", [(512, 4 << 20), (512, 1000), (0, 2000), (2, 1000)])
def test_suffixes_match_brute_force(spark, monkeypatch, hot, size):
    """Contexts, windows of anchors that are in very many blocks, and both."""
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", size)
    rows = passages(hot)
    got = sorted((tuple(r) for r in suffixes.dedup(texts(spark, rows)).collect()), key=str)
    assert got == brute_removed(rows)


def test_contexts_are_sent_in_turns_of_hash_ranges(spark, monkeypatch):
    """Several turns give what one gives, and a line in hundreds of blocks sends contexts, not windows."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(suffixes, "TURN_LEAST", 1)
    monkeypatch.setattr(suffixes, "TURN_SHARE", 0.5)
    made, write = [], suffixes.materialize
    of = lambda df, label, *a: made.append(label) or write(df, label, *a)
    monkeypatch.setattr(suffixes, "materialize", of)
    rows = passages(5)
    assert sorted((tuple(r) for r in suffixes.dedup(texts(spark, rows)).collect()), key=str) == brute_removed(rows)
    assert made.count("runs") > 1
    rng, line, made[:] = random.Random(4), "all rights are reserved by those who wrote these many lines; " * 2, []
    rows = [(d, f"{line}{''.join(rng.choices('abcdefgh ', k=900))}") for d in range(600)]
    assert sorted((tuple(r) for r in suffixes.dedup(texts(spark, rows)).collect()), key=str) == brute_removed(rows)
    assert "windows" not in made
    # figures of a corpus: contexts of no turn weigh more than half of the texts
    assert suffixes.turns(0, 0) == 1 and suffixes.turns(8 * 10**8, 10**10) == 2


def test_a_passage_of_a_third_of_all_documents_is_sent_once_a_block(spark, monkeypatch):
    """Blocks send a context once, with the least and greatest doc_id, however many documents have it."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(150))
    rows = [(d, f"{rng.random()} {rng.random()} {passage if d % 3 == 0 else rng.random()} {rng.random()}") for d in range(300)]
    assert sorted((tuple(r) for r in suffixes.dedup(texts(spark, rows)).collect()), key=str) == brute_removed(rows)
    blocks = [r["payload"] for r in suffixes.pack_blocks(texts(spark, rows)).collect()]
    shared = suffixes.shared_hashes([suffixes.anchor_hashes(b) for b in blocks], 512)
    for block, own in zip(blocks, shared, strict=True):
        context, _, low, high, places = suffixes.contexts(block, own)
        assert len(context) < 200 and (low <= high).all() and len(places) > 10 * len(context)
        window, low, high, runs = suffixes.hot_windows(block, own | np.uint64(1))
        assert (low <= high).all() and runs[:, 3].sum() > 10 * len(window) and len(runs) < 400


def test_suffix_order_is_sorted():
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = rng.integers(0, 2, (rng.integers(1, 80), 32)).astype(np.uint8)
        rows[:, : rng.integers(0, 30)] = 9
        order, same = suffixes.suffix_order(rows)
        got = [rows[i].tobytes() for i in order]
        assert got == sorted(got) and same.tolist() == [False] + [a == b for a, b in zip(got, got[1:], strict=False)]


def test_suffixes_odd(odd, none):
    rows = suffixes.dedup(odd).collect()
    assert len(rows) == len(ROWS) and sorted(r["n_removed"] for r in rows if r["doc_id"] == 7) == [77, 77]
    cut = suffixes.dedup(odd, with_rows=True)
    assert cut.columns == odd.columns and cut.filter("doc_id = 7").first()["text"] == "" and cut.filter("doc_id = 2").first()["text"] is None
    assert suffixes.dedup(none).isEmpty() and suffixes.dedup(none, True).isEmpty()


# -- 3 top-k --------------------------------------------------------------------------


@pytest.mark.parametrize("clusters", [1, 12])
def test_topk_matches_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 6)) * 3
    v = centres[rng.integers(0, clusters, 500)] + rng.normal(size=(500, 6)) * 0.2
    v[100:130] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (700, [float("nan")] * 6), (None, [0.0] * 6), (750, [])]
    q = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(q, q.filter("vec_id % 50 = 0 and size(v) > 0")).orderBy("query_id", "rank").collect()]
    z = np.floor(256 * v).astype(np.int64)
    want = [(i, k + 1, j, s) for i in range(0, 500, 50) for k, (s, j) in enumerate(sorted(((int(z[i] @ z[j]), j) for j in range(500) if j != i), key=lambda x: (-x[0], x[1]))[:5])]
    assert got == want
    assert topk.top_k(q.limit(0), q).isEmpty() and topk.top_k(q.filter("vec_id < 3"), q.filter("vec_id = 0")).count() == 2


def test_mtree_leaves_distances_out():
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] * 2000 + rng.normal(size=(4000, 8)) * 10).astype(np.int64)
    top2 = float((v * v).sum(1).max())
    tree = topk.MTree(v, np.concatenate([v, np.sqrt(top2 - (v * v).sum(1))[:, None]], 1), top2)
    got = tree.search(v[0], np.append(v[0], 0.0), 5, np.arange(4000), 0)
    assert tree.computed < 2000 and got == sorted(((int(v[0] @ x), i) for i, x in enumerate(v) if i), key=lambda x: (-x[0], x[1]))[:5]


@pytest.mark.parametrize("large", [300_000.0, 1e12, 1e160, 1.7e308])
def test_topk_of_components_of_any_size(spark, monkeypatch, large):
    """Ranks follow exact scores, also where these or the components leave 64 bits."""
    monkeypatch.setattr(topk, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * large, rng.choice([0.0, rng.uniform(-1, 1), rng.uniform(-1, 1) * 1e5])]) for i in range(60)]
    rows += [(60, [large, 0.0]), (61, [large, 0.0]), (62, [large, 2.0**-9]), (63, [0.0, 0.0])]
    q = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in topk.top_k(q, q.filter("vec_id % 10 = 0")).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    whole = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    want = []
    for i in range(0, 64, 10):
        best = sorted(((sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), j) for j in whole if j != i), key=lambda x: (-x[0], x[1]))[:5]
        want += [(i, k + 1, j, min(max(s, -(2**63)), 2**63 - 1)) for k, (s, j) in enumerate(best)]
    assert got == want


def test_topk_asks_few_blocks_where_clusters_are(spark, monkeypatch):
    """With clusters, a query meets its own block and few others; each block's tree is searched for those only."""
    monkeypatch.setattr(topk, "BLOCK", 100)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 50
    v = centres[np.arange(2000) % 20] + rng.normal(size=(2000, 8))
    sent, blocks, write = [], [], topk.materialize

    def seen(df, label, *more):
        out = write(df, label, *more)
        if label == "asked":
            sent.append(out.count())
        if label == "rings":
            blocks.append(out.agg(F.sum("parts")).first()[0])
        return out

    monkeypatch.setattr(topk, "materialize", seen)
    q = topk.quantized(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    assert topk.top_k(q, q.filter("vec_id % 50 = 0")).count() == 200
    assert blocks[0] >= 20 and sent[0] <= 2 * 40 and sum(sent) < 0.5 * 40 * blocks[0], (blocks, sent)


# -- 4 and 6 classifiers --------------------------------------------------------------


def labelled(spark, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "st", "re"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for d in range(600):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        words = [word() for _ in range(rng.randint(20, 80))]
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "dimwit", "scoundrel", "zqx" + word()]))
        docs.append((d, " ".join(words)))
        labels.append((d, int(not bad), int(toxic)))
    return texts(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (10_000, 0, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark, odd, none):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    strange = quality.score(odd, model).collect()
    assert len(strange) == len(ROWS) and all(0 <= r["score"] <= 1 for r in strange) and not next(r for r in strange if r["doc_id"] is None)["held_out"]
    assert quality.score(none, model).isEmpty() and quality.score(odd, quality.train(docs, labels.limit(0))).first()["score"] == 0.5


def test_toxicity(spark, odd, none):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    terms = {t for t, _, _ in model.lexicon.terms}
    assert {"vermin", "dimwit", "scoundrel"} <= terms and any(t.startswith("zqx") and s for t, s, _ in model.lexicon.terms)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    plain, misspelled = model.score("you vermin and dimwit"), model.score("you vermln and dimwlt")
    quoted = model.score('he said "vermin" and she wrote "dimwit" to us')
    assert plain > 0.3 and model.score("") < 0.3 and misspelled > model.score("the words") and quoted < plain
    kept = toxicity.clean(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) and toxicity.score(none, model).isEmpty()
    assert toxicity.score(odd, toxicity.train(docs, labels.limit(0))).count() == len(ROWS)


@pytest.mark.parametrize("apart", [20, 21, 22, 23, 24])
def test_repeated_fives_at_any_distance(apart):
    words = [b"w%d" % i for i in range(100)]
    words[apart + 30 : apart + 45] = words[30:45]
    assert quality.features(b" ".join(words))[quality.NAMES.index("repeated_fives")] == pytest.approx(11 / 96)


def test_terms_that_hold_alone_stay(spark):
    """A rare term that mostly comes with frequent ones stays, one that clean documents have or that never is alone goes."""
    frequent = ["vermin", "dimwit", "scoundrel", "wretch", "lout"]
    rows = [(" ".join(frequent), 1)] * 20 + [(" ".join([*frequent, "rascal", "copied"]), 1)] * 4 + [("a rascal and a chair", 1)] * 2
    rows += [("some clean words", 0)] * 190 + [("a chair and a table", 0)] * 10
    terms = tuple((t, False, 3.0) for t in sorted([*frequent, "rascal", "copied", "chair"]))
    kept = toxicity.needed(terms, spark.createDataFrame(rows, "text string, label int"))
    assert [t for t, _, _ in kept] == sorted([*frequent, "rascal"])


def test_all_clean_spellings_count(spark):
    """However many there are."""
    spellings = [f"{x}ermin" for x in "abcdefgh"]
    rows = [(d, f"some words {'vermin' if d % 4 == 0 else spellings[d % 8]} and others") for d in range(200)]
    rows += [(d, f"some words {' '.join(spellings)} and others") for d in range(200, 260)]
    model = toxicity.train(texts(spark, rows), spark.createDataFrame([(d, int(d < 200 and d % 4 == 0)) for d, _ in rows], "doc_id long, toxic int"))
    assert [t for t, _, _ in model.lexicon.terms] == ["vermin"] and model.lexicon.spelled == set(spellings)


def by_gradient(x, y, loss_slope, start):
    """Plain gradient steps, small enough to settle."""
    w = start.copy()
    for _ in range(200_000):
        step = loss_slope(w)
        w += step
        if np.abs(step).max() < 1e-11:
            break
    return w


def test_quality_matches_brute_force():
    """Weights by plain gradient steps on the same pairs; features and scores by loops over whole texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeFG%|.,!\n9é") for _ in range(rng.randint(1, 25)))
    said = ["", "one", "A | b\n\nA | b", *(" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60))]
    labels = np.array([i % 3 > 0 for i in range(len(said))], int)

    def naive(text):
        words, size = text.encode().split(), max(len(text.encode()), 1)
        n = max(len(words), 1)
        counts, lines = Counter(words), [x for x in text.encode().split(b"\n") if x]
        share = lambda chars: sum(b in chars for b in text.encode()) / size
        fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        long = sum(len(w) > 20 for w in words)
        stops = sum(1 for i, c in enumerate(text) if c in ".!?" and (i + 1 == len(text) or text[i + 1] in " \t\n\x0b\x0c\r"))
        own = [math.log1p(len(words)), len(text.encode()) / n, *(share(c) for c in quality._CLASSES.values()), share(bytes(range(128, 256))), len(counts) / n, max(counts.values(), default=0) / n]
        own += [1 - len(set(lines)) / len(lines) if lines else 0, math.log1p(n / max(len(lines), 1)), long / n, sum(len(w) > 1 and w.isupper() for w in words) / n, sum(w[-1:] in b"%$&*#!" for w in words) / n, counts[b"|"] / n, math.log1p(n / (1 + stops))]
        return own + [len(zlib.compress(text.encode(), 1)) / size if words else 0, 1 - len(set(fives)) / len(fives) if fives else 0, sum(len(w) <= 3 for w in words) / n]

    rows = np.array([quality.features(t.encode()) for t in said])
    assert rows == pytest.approx(np.array([naive(t) for t in said]))
    model = quality.fit(rows, labels, ridge=0.05)
    z = np.clip((rows - rows.mean(0)) / (rows.std(0) + 1e-9), -6, 6)
    good, bad = quality.preference_pairs(np.flatnonzero(labels == 1), np.flatnonzero(labels == 0), quality.ROUNDS, 7)
    assert (labels[good] == 1).all() and (labels[bad] == 0).all() and set(Counter(good.tolist()).values()) == {quality.ROUNDS} and set(bad.tolist()) == set(np.flatnonzero(labels == 0).tolist())
    d = z[good] - z[bad]
    weights = by_gradient(d, None, lambda w: 0.05 * ((d / (1 + np.exp(d @ w))[:, None]).mean(0) - 0.05 * w), np.zeros(rows.shape[1]))
    assert model.weights == pytest.approx(weights, abs=1e-5)
    strength = sorted(z @ weights)
    at = (labels == 0).mean() * (len(strength) - 1)
    cut = strength[int(at)] + (at % 1) * (strength[int(at) + 1] - strength[int(at)])
    assert model.scores(rows) == pytest.approx([1 / (1 + math.exp(cut - s)) for s in z @ weights], abs=1e-4)


def test_toxicity_matches_brute_force():
    """Weights by plain gradient steps; features by edit distance of every word to every term, and by counting marks before it."""
    rng = random.Random(8)
    terms = (("vermin", False, 1.5), ("dimwit", False, 2.0), ("scoundr", True, 3.0))
    lexicon = toxicity.Lexicon(terms, frozenset(["permin"]))
    bits = ["vermin", "vermln", "permin", "dimwits", "scoundrels", "scowndrel", "said", '"', "never", ".", "and", "words", "Vermin", "9", "„"]

    def naive(text):
        units = re.findall(r"[^\W\d_]+|[\"“”„«»‘’`]|[^\w\s]+|[\d_]+", text.lower())
        sums, hits, n = [0.0] * 3, 0, sum(u[0].isalpha() for u in units)
        for i, u in enumerate(units):
            exact = max((w for t, stem, w in terms if (u.startswith(t) if stem else u == t)), default=0)
            near = 0 if u in lexicon.spelled else max((w for t, stem, w in terms if (min(distance(u[:k], t) for k in range(len(u) + 1)) if stem else distance(u, t)) <= 1), default=0)
            if u[0].isalpha() and (exact or near):
                before, after = units[max(0, i - 6) : i], units[i + 1 : i + 7]
                inside = sum(x in toxicity.QUOTES for x in units[:i]) % 2 == 1 and any(x in toxicity.QUOTES for x in before) and any(x in toxicity.QUOTES for x in after)
                sums[2 if inside or any(x in toxicity.REPORTS for x in before) else 0 if exact else 1] += exact or near
                hits += 1
        return [*map(math.log1p, sums), math.log1p(1000 * hits / n) / 10 if n else 0.0]

    said = ["", "9", *(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(150))]
    rows = np.array([toxicity.features(t, lexicon) for t in said])
    assert rows == pytest.approx(np.array([naive(t) for t in said]))
    labels = np.array([float(r[0] + r[1] > 1.2) for r in rows])
    x = np.concatenate([rows, np.ones((len(rows), 1))], 1)
    slope = lambda w: 0.004 * (x.T @ (labels - 1 / (1 + np.exp(-(x @ w)))) - toxicity.PRIOR_STRENGTH * (w - toxicity.PRIOR))
    weights = by_gradient(x, labels, slope, toxicity.PRIOR)
    assert toxicity.fit(rows, labels) == pytest.approx(weights, abs=1e-5)
    model = toxicity.Model(lexicon, toxicity.fit(rows, labels))
    assert [model.score(t) for t in said] == pytest.approx(1 / (1 + np.exp(-(x @ weights))), abs=1e-5)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automata():
    rng = random.Random(2)
    terms = [("vermin", False, 1.0), ("dimwit", False, 2.0), ("scoundrel", True, 3.0)]
    lexicon = toxicity.Lexicon(tuple(terms))
    for _ in range(3000):
        base = rng.choice(terms)[0] + rng.choice(["", "", "s", "ing"])
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "m", "r"])
        word = "".join(w)
        want = max((p for t, stem, p in terms if (min(distance(word[:n], t) for n in range(len(word) + 1)) if stem else distance(word, t)) <= 1), default=0.0)
        assert lexicon.near(word) == want and (lexicon.find(word)[0] > 0) == (want > 0), word


# -- 5 packing ------------------------------------------------------------------------


def test_packing(spark, odd, none):
    rows = packing.pack(odd, length=64).collect()
    encode = packing.Encoder(packing.vocabulary_path(None), None)
    want = Counter()
    for d, t, _, _ in ROWS:
        ids = np.append(encode(t or ""), np.uint32(1)).astype("<u4")
        for a in range(0, len(ids), 64):
            want[d, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    packs = defaultdict(list)
    for r in rows:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in packs.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(packs) == list(range(len(packs))) and packing.pack(none).isEmpty()


def test_patterns_place_everything():
    rng = random.Random(4)
    for _ in range(50):
        histogram = {rng.randint(1, 100): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        placed = Counter()
        for count, lengths in packing.patterns(histogram, 100):
            assert sum(lengths) <= 100 and count > 0
            for n in lengths:
                placed[n] += count
        assert placed == Counter(histogram)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "  x\n\n y\x85 z 中文 \U0001f600", "", "a\x1cb \x00", "it's  \n ", "ÀÉ ßü 12 3"])
def test_both_encoders_agree(text):
    fast = packing.Encoder(packing.vocabulary_path(None), packing.vocabulary_path(None, "byte_bpe_50k.tiktoken"))
    assert fast(text).tolist() == fast.slow.encode(text, add_special_tokens=False).ids


# -- 7 near duplicates ----------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = neardup._Links(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                links.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[links.root(i)] = min(d, least.get(links.root(i), d))
    return {d: (len(sets[i]), least[links.root(i)], d == least[links.root(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("cell,region,held", [(512, 64, 4096), (9, 4, 4096), (9, 4, 10)])
def test_components_match_brute_force(spark, monkeypatch, cell, region, held):
    """Also with groups that are split over cells, regions that are followed deep, and regions too large to hold."""
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "REGION", region)
    monkeypatch.setattr(neardup, "HELD", held)
    rng = random.Random(cell)
    word = lambda: f"w{rng.randrange(2000)}"
    base, rows = [word() for _ in range(200)], []
    for _ in range(70):
        c = base[:]
        for _ in range(rng.randint(0, 7)):
            c[rng.randrange(200)] = word()
        rows.append(" ".join(c))
    for _ in range(15):
        c = [word() for _ in range(rng.randint(3, 50))]
        rows += [" ".join(c), "  ".join(c).upper(), " ".join(c[:-1])]
    rows = list(enumerate([*rows, "", None, " \n", "a b", "A\tb", "a b c d e"]))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(texts(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_odd(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS) and {r["component_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    lost = next(r for r in rows if r["doc_id"] is None)
    assert lost["component_id"] is None and lost["kept"]
    odd = odd.withColumns({"kept_id": F.lit(1), "copy_number": F.lit("c"), "digest": F.lit("d"), "number": F.lit(2), "row": F.lit(3), "group": F.lit(4)})
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "None"])
    assert neardup.near_duplicates(none).isEmpty()


def test_rows_that_share_an_id_keep_their_texts(spark):
    """Rows of one id: those linked with a smaller id go, those linked with each other are one, others all stay."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (7, a), (7, a.upper()), (7, b), (7, b), (7, b.upper()), (7, c), (7, ""), (7, ""), (7, " "), (7, None), (8, c), (9, None)]
    got = [(r["doc_id"], r["text"] and r["text"].lower()) for r in neardup.keep_one(texts(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (7, b), (7, c), (7, ""), (7, " "), (7, None), (9, None)], key=str)


def template_pages(n, seed=5):
    """Pages of one template, 0.56 alike, some with a near copy or a copy of it further on."""
    rng = random.Random(seed)
    template, rows, pairs = [f"t{i}" for i in range(150)], [], {}
    for d in range(n):
        rows.append((d, " ".join([*template, *(f"w{rng.randrange(10**7)}" for _ in range(58))])))
    for k in range(40):
        words = rows[k * (n // 40)][1].split()
        words[-1 - k % 12] = f"x{k}"
        rows.append((n + k, " ".join(words)))
        pairs[n + k] = k * (n // 40)
    rng.shuffle(rows)
    return rows, pairs


def test_template_pages_are_not_compared_with_each_other(spark, monkeypatch):
    """One candidate group, hardly any links: texts go to cells with a holder of a rare shingle only, and all links are found."""
    monkeypatch.setattr(neardup, "CELL", 64)
    rows, pairs = template_pages(1500)
    sent, with_texts = Counter(), neardup._with_texts

    def counted(members, every, *columns):
        sent["cells" if "row" in columns else "sampled" if "sampled" in columns else "first"] += members.count()
        return with_texts(members, every, *columns)

    monkeypatch.setattr(neardup, "_with_texts", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(texts(spark, rows)).collect()}
    assert got == {d: pairs.get(d, d) for d, _ in rows}
    # a text once in its cell and once for its shingles, with the cells' leaders and samples; then where it shares a rare shingle
    assert sent["first"] <= 1.1 * len(rows) and sent["sampled"] <= 2 * len(rows) and sent["cells"] <= 2 * len(rows)


@pytest.mark.parametrize("nodes", [300, 4000])
def test_regions_of_any_size_lose_no_candidate(nodes):
    """All pairs that agree enough are joined, whatever lies between them in the order."""
    rng = np.random.default_rng(nodes)
    base = rng.integers(0, 256, 45).astype(np.uint8)
    values = np.where(rng.random((nodes, 45)) < 0.45, base, rng.integers(0, 256, (nodes, 45)).astype(np.uint8))
    for k in range(0, nodes // 2, 5):  # links at the limit: 29 of 48 agree
        values[nodes // 2 + k] = np.where(np.isin(np.arange(45), rng.choice(45, 19, replace=False)), rng.integers(0, 256, 45), values[k])
    order = np.lexsort(values.T[::-1])
    values = values[order]
    found, want = neardup._Links(nodes), neardup._Links(nodes)
    for a, b in neardup.region_links(np.arange(nodes), values, 29, neardup.REGION):
        found.join(a, b)
    for i in range(nodes):
        for j in np.flatnonzero((values[i + 1 :] == values[i]).sum(1) >= 26) + i + 1:
            want.join(i, int(j))
    assert [found.root(i) for i in range(nodes)] == [want.root(i) for i in range(nodes)]


# -- 8 chat ---------------------------------------------------------------------------


def test_template_is_reversible():
    rng, t = random.Random(0), chat.Template()
    bits = ["\\", "###", "#", "</turn>", "\n", " ", "</", "turn>", ":", "a", "é", "### assistant: "]
    for _ in range(2000):
        turns = [("".join(rng.choice(bits) for _ in range(rng.randint(0, 2))) if rng.random() < 0.3 else rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 4))]
        out = "".join(x for r, s in turns for x, _ in t.segments(r, s))
        assert list(t.read(out)) == turns, turns


def test_faults_across_turns_show():
    """A reader sees the joined text only: a closing that is lost, or a turn left open, is an error."""
    t = chat.Template()
    pieces = [*t.segments("user", "a"), *t.segments("assistant", "b")]
    whole, broken = chat.Reader(t), chat.Reader(t)
    for piece in pieces:
        whole.add(*piece)
    assert whole.row(1)[1] == 2
    with pytest.raises(ValueError):
        for piece in [*pieces[:2], *pieces[3:]]:
            broken.add(*piece)
    reader = chat.Reader(t)
    reader.add("### User: a", False)
    with pytest.raises(ValueError):
        reader.row(1)


def test_chat(spark):
    rows = [(1, 1, "assistant", "hi </turn>"), (1, 0, "user", "a\\b"), (2, 0, "user", None), (2, 1, "user", "x"), (None, None, None, None), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "v"), (3, 2, "assistant", "v")]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("x"))).collect()}
    assert got[1]["valid_order"] and got[1]["turns_sha256"] == hashlib.sha256(b"user\na\\b\nassistant\nhi </turn>\n").hexdigest() and got[1]["loss_chars"] == 10
    assert got[1]["loss_sha256"] == hashlib.sha256(b"hi </turn>").hexdigest() and not got[2]["valid_order"] and got[2]["first_bad_turn"] == 1
    assert got[3]["n_turns"] == 4 and not got[3]["valid_order"] and got[None]["n_turns"] == 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(empty).isEmpty() and chat.segments(empty).isEmpty()
    long = "long </turn>\n" * 200_000
    turns = [(1, 0, "user", long + "\\"), (1, 1, "assistant", long), (2, 0, "user", "</turn>\n"), (2, 1, "user", "### Assistant: x</turn>\n"), (2, 2, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (1, 2):
        own = [(r, x) for c, _, r, x in turns if c == conv]
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest() and got[conv]["n_turns"] == len(own)
        learned = "".join(x for r, x in own if r == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    parts = chat.segments(spark.createDataFrame(rows[:2], "conv_id long, turn long, role string, text string")).orderBy("turn", "position").collect()
    assert [p["loss"] for p in parts] == [False, False, False, False, True, False]


# -- 9 mixing -------------------------------------------------------------------------


def test_mixing(spark, odd, none):
    rng = random.Random(1)
    rows = [(d, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "a", "a", "b", "c", "é", None])) for d in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.coalesce(1)).collect()), key=str)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, capped = {}, set()
    while True:  # share again by weight until none is above
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        want = {s: 2 * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert targets == pytest.approx(want) and all(taken[s] == math.floor(targets[s] + 1e-9) for s in names)
    assert mixing.mix(odd).count() == len(ROWS) and mixing.mix(none).isEmpty()
    named = df.withColumns({"copy": F.lit("c"), "plan_words": F.lit("p"), "plan_size": F.lit("s"), "row": F.lit("r"), "key": F.lit("k"), "size": F.lit("z"), "taken": F.lit("t"), "number": F.lit("n"), "left": F.lit("l"), "digest": F.lit("d")})
    mixed = mixing.mix_documents(named)
    assert mixed.columns == named.columns and mixed.select(*named.columns[3:]).distinct().collect() == [tuple("cpsrkztnld")]
    words = Counter()
    for r in mixing.mix_documents(df.withColumn("n_chars", F.lit(0).cast("long"))).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == taken


# -- 10 media -------------------------------------------------------------------------


def test_png_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 5000):
        data = media.padded(rng.randbytes(n))
        assert len(data) % 64 == 0 and len(data) >= 64 and media.decode_png(media.encode_png(data)) == data
    with pytest.raises(ValueError):
        media.decode_png(b"no")
    broken = bytearray(media.encode_png(bytes(64)))
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(broken))


def test_sequences(spark):
    page = '<title>t</title><p>one <b>two</b><figure><img src="a.png" alt="x"><img src="media:sha256:ff"><figcaption>both</figcaption></figure>three<script>no</script><img src="c"><p>'
    got = media.parse_page(page)
    assert [(s["position"], s["kind"], s["text"], s["caption"]) for s in got] == [(0, "text", "t", None), (1, "text", "one two", None), (2, "media", None, "both"), (3, "media", None, "both"), (4, "text", "three", None), (5, "media", None, None)]
    assert got[3]["digest"] == "ff" and media.parse_page(None) == []
    rows = media.sequences(spark.createDataFrame([(1, page), (2, None), (None, "")], "page_id long, html string"))
    assert rows.count() == 3 and rows.filter("page_id = 1").first()["segments"][2]["caption"] == "both"
    feature = spark.createDataFrame([("ff", 3)], "digest string, n int")
    found = media.resolve(rows, feature, "page_id").orderBy("position").collect()
    assert [(r["position"], r["n"]) for r in found] == [(2, None), (3, 3), (5, None)]


def naive_page(text):
    """What a text's sequence should be: its paragraphs, blanks squeezed, and the two figures."""
    squeezed = [" ".join(x.split()) for x in (text or "").split("\n\n")]
    payload = media.padded((text or "").encode())
    first, rest = squeezed[0], [x for x in squeezed[1:] if x]
    out = [("text", first)] * bool(first) + [("media", payload, f"all {len((text or '').encode())} bytes")]
    return out + [("text", x) for x in rest] + [("media", payload[-64:], f"the last of {len(payload) // 64} rows")]


def test_media(spark, tmp_path, odd, none):
    more = [(20, "one\n\ntwo <b>&amp; three</b>\n\n\n\nfour", None, None), (21, "\n\nlater", None, None), (22, "a\x00b\x1fc", None, None)]
    names = ("digest", "media", "segments", "caption", "position", "html", "intact", "refs", "tail_digest")
    df = odd.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(d, t, "x") for d, t, _, _ in more], "doc_id long, text string, size string")).withColumns({n: F.lit(n) for n in names})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op10_media(spark, str(tmp_path)).collect()
    assert len(rows) == len(ROWS) + len(more) and all(r["intact"] for r in rows)
    for r in rows:
        text = next(t for d, t, _, _ in [*ROWS, *more] if d == r["doc_id"])
        data = (text or "").encode()
        payload = media.padded(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        png = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        want = naive_page(text)
        at = [k for k, x in enumerate(want) if x[0] == "media"]
        assert (r["n_segments"], r["position"], r["tail_position"]) == (len(want), *at), r
        assert (r["caption"], r["tail_caption"], r["tail_sha256"]) == (want[at[0]][2], want[at[1]][2], hashlib.sha256(want[at[1]][1]).hexdigest())
        said = media.parse_page(media.media_page(text))
        assert [x["text"] for x in said if x["kind"] == "text"] == [x[1] for x in want if x[0] == "text"]
    assert media.aligned(none).isEmpty() and media.sequences(none.withColumn("html", F.lit("")), "doc_id").isEmpty()


def test_quality_learns_from_all_labels_whatever_the_block(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.NAMES)))
    y = (x[:, 0] + x[:, 1] + rng.normal(size=600) > 0.3).astype(int)
    got = sorted(zip(y.tolist(), x.tolist(), strict=True))
    whole = quality.fit(np.array([v for _, v in got]), np.array([label for label, _ in got]))
    blocks = quality.fit_blocks(spark.createDataFrame([(0, label, v) for label, v in got], "block int, label int, x array<double>").repartition(3))
    assert np.allclose(whole.weights, blocks.weights) and np.allclose(whole.mean, blocks.mean) and abs(whole.cut - blocks.cut) < 1e-9
    docs = spark.createDataFrame([(i, " ".join(["word"] * (i % 37 + 1)) + ("." if i % 2 else " %$")) for i in range(900)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    rows = [r["text"].encode() for r in docs.join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").collect()]
    model = quality.train(docs, labels, 100)  # 100 rows at once, some 600 in all
    assert np.allclose(model.mean, np.array([quality.features(t) for t in rows]).mean(0)) and len(rows) > 500
    ties = spark.createDataFrame([(float(v),) for v in [1] * 40 + [2] * 7 + [5, 9.5]], "s double")
    assert all(quality.quantile(ties, q, 49) == pytest.approx(np.quantile([r["s"] for r in ties.collect()], q)) for q in (0.0, 0.3, 0.83, 0.97, 0.99, 1.0))

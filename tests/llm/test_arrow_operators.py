"""Operators whose tasks work on Arrow batches, against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import components, decontaminate, html_extract, jaccard_join, language_model, pu_quality, token_ids, toxicity
from evidentia.llm import text as T

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, id int, node int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAb é\n\t\x0b漢", max_size=20)), max_size=12), st.integers(1, 30))
def test_word_hashes_follow_words(texts, most):
    seen = {}
    got = []
    for w in T.words(pa.array(texts, pa.string()), most=most):
        for k in range(w.last - w.first):
            got.append(w.hashes[w.bounds[k] : w.bounds[k + 1]].tolist())
    assert len(got) == len(texts)
    for t, hashes in zip(texts, got, strict=True):
        own = words_of(t)
        assert len(own) == len(hashes)
        for x, h in zip(own, hashes, strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def sets_of(texts):
    out = []
    for t in texts:
        w = words_of(t)
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(ids, texts):
    sets, parent = sets_of(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = defaultdict(lambda: 10**18)
    for k, i in enumerate(ids):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, i in enumerate(ids))


def families(seed, n):
    """Copies with edits around the threshold, passages in common, short texts of all sizes, odd rows."""
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((12, 25, 60, 150, 400)))] for _ in range(6)]
    texts = [None, "", " ", "one", "One", "two words", "a b c d e", "a b c d e", "A B C D E f"]
    for _ in range(n):
        kind = r.random()
        if kind < 0.6:
            w = list(r.choice(bases))
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = [r.choice(vocabulary)]
        elif kind < 0.8:
            w = [r.choice(vocabulary) for _ in range(r.randint(1, 60))] + passage
        else:
            w = [f"c{k}" for k in range(r.randint(1, 16))] + ([r.choice("xyz")] if r.random() < 0.5 else [])
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_matches_brute_force(spark, seed):
    texts = families(seed, 150)
    ids = [1000 - k for k in range(len(texts))]
    got = jaccard_join.jaccard_join(frame(spark, texts, ids).repartition(3)).collect()
    assert sorted((r["id"], r["n_shingles"], r["component"]) for r in got) == brute_components(ids, texts)


def test_jaccard_join_of_one_large_family(spark, monkeypatch):
    """Copies of one text with up to a third of it edited, whose lists are dealt over several tasks."""
    monkeypatch.setattr(jaccard_join, "HOT_ENTRIES", 4)
    r = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(260):
        w = list(base)
        for at in r.sample(range(len(w)), r.randrange(9)):
            w[at] = f"e{k}-{at}" if r.random() < 0.5 else f"e{at}"
        texts.append(" ".join(w[: 120 - r.randrange(25)]))
    ids = [None if k == 7 else k for k in range(len(texts))]
    got = jaccard_join.jaccard_join(frame(spark, texts, ids).repartition(5)).collect()
    want = brute_components(range(len(texts)), texts)
    least = {k: (c if c != 7 else min([i for i, _, d in want if d == 7 and i != 7], default=None)) for k, _, c in want}
    assert sorted(((r["id"], r["n_shingles"], r["component"]) for r in got), key=str) == sorted(((ids[k], n, least[k]) for k, n, _ in want), key=str)


def test_jaccard_join_edges(spark):
    assert jaccard_join.jaccard_join(frame(spark, ["a b"]).limit(0)).count() == 0
    got = jaccard_join.jaccard_join(frame(spark, ["x y z", "x y z", None, "q"], [5, 5, 7, 8])).collect()
    assert sorted(map(tuple, got)) == [(5, 1, 5), (5, 1, 5), (7, 0, 7), (8, 1, 8)]


def test_boundary_follows_cost():
    flat = np.full(1 << jaccard_join.SKETCH_BITS, 5, np.uint32)
    hot = flat.copy()
    hot[:4] = 4_000_000
    sizes = np.full(jaccard_join.MOST_SMALL + 1, 1000)
    assert jaccard_join.boundary(flat, sizes, 75, 100) <= jaccard_join.boundary(hot, sizes, 75, 100)
    for n in range(1, 40):
        for m in jaccard_join.partners(n, 75, 100):
            c = jaccard_join.overlap(n, m, 75, 100)
            assert 100 * c >= 75 * (n + m - c) and 100 * (c - 1) < 75 * (n + m - c + 1)


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(60)] + [(500, 500 + k) for k in range(1, 40)] + [(9, 9), (None, 3), (900, 901), (901, 900)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 500 for k in range(500, 540)}, 900: 900, 901: 900}


def test_decontamination_matches_edit_distance(spark):
    r = random.Random(4)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (8, 11, 16, 24, 40, 59)] + [["too", "short"]]
    texts, edits = [None, "", "v1 v2"], []
    for _ in range(80):
        k = r.randrange(6)
        w = list(items[k])
        for _ in range(r.randint(0, len(w) // 8)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] if r.random() < 0.7 else []
        texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randint(0, 50))] + w + [r.choice(vocabulary) for _ in range(r.randint(0, 50))]).upper())
    bench = spark.createDataFrame([(k, " ".join(w), 1) for k, w in enumerate(items)] + [(99, None, 1)], "item_id long, text string, doc_id int")
    got = {(x["doc_id"], x["item_id"]): x["edit_distance"] for x in decontaminate.find_leaks(frame(spark, texts), bench).collect()}
    for d, t in enumerate(texts):
        for k, item in enumerate(items[:6]):
            row = list(range(len(words_of(t)) + 1))
            row = [0] * len(row)
            for i, x in enumerate(item):
                new = [i + 1]
                for j, y in enumerate(words_of(t)):
                    new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
                row = new
            if min(row) <= int(0.25 * len(item)):
                edits.append((d, k, min(row)))
            else:
                assert (d, k) not in got
    found = [e for e in edits if got.get(e[:2]) == e[2]]
    assert len(found) >= 0.93 * len(edits) and all(e[:2] in got for e in edits if e[2] == 0)
    assert decontaminate.find_leaks(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(frame(spark, texts), bench, most_items_bytes=300).count() == len(got)


@pytest.mark.parametrize("n", range(8, 60))
def test_decontamination_finds_every_copy_at_the_full_rate(n):
    r, most = random.Random(n), int(0.25 * n)
    item = [f"i{k}" for k in range(n)]
    index = decontaminate.ItemIndex([0], [" ".join(item)])
    texts = []
    for k in range(60):
        copy = list(item)
        for at in sorted(r.sample(range(n), most), reverse=True):
            copy[at : at + 1] = [["x"], [], [copy[at], "y"]][r.randrange(3) if k % 2 else 0]
        texts.append(" ".join([f"f{j}" for j in range(r.randrange(9))] + copy + [f"g{j}" for j in range(r.randrange(70))]))
    found = [x for w in T.words(pa.array(texts, pa.string())) for x in decontaminate._leaks_of(w, index, 0.25)]
    assert len(found) == len(texts) and all(d <= most for _, _, d, _ in found)


def test_language_model_base_is_exact_and_score_prefers_seen_order(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["a b c", "d e", "f", "g h i j"]) for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "never seen words", "A B C"]
    docs = frame(spark, texts)
    model, vocabulary = language_model.train(docs.where("doc_id % 3 <> 0").select("text"))
    counts = Counter(w for k, t in enumerate(texts) if k % 3 for w in [*words_of(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.types) == (n, v)
    for head in (2, 1000):
        rows = language_model.score(docs.selectExpr("doc_id AS id", "text"), model, vocabulary, head_words=head).collect()
        assert len(rows) == len(texts)
        for x in rows:
            own = [*words_of(texts[x["id"]]), "\n"]
            assert x["n_tokens"] == len(own) and x["n_known"] == sum(w in counts for w in own)
            assert math.isclose(x["base_score"], sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
            assert x["score"] <= 0
    assert sum(x["score"] for x in rows) > sum(x["base_score"] for x in rows)
    empty, words = language_model.train(docs.limit(0).select("text"))
    assert (empty.tokens, empty.types) == (0, 0)
    assert language_model.score(docs.selectExpr("doc_id AS id", "text"), empty, words).count() == len(texts)


def test_bloom_counts_are_quantised_counts(spark):
    texts = [" ".join(["often"] * 40 + ["some"] * 6 + ["once"])]
    model, _ = language_model.train(frame(spark, texts).select("text"))
    h = next(T.words(pa.array(["often some once absent"]))).hashes
    got = model.count(h)
    for c, true in zip(got, (40, 6, 1, 0), strict=True):
        assert language_model.middle(language_model.quantise(np.array([true])))[0] == c if true else c == 0


def test_scores_are_the_interpolation_of_counts(spark, monkeypatch):
    """Against a model of plain dictionaries, with a filter so sparse that none of its hits is false here."""
    monkeypatch.setattr(language_model, "BITS_PER_KEY", 2000)
    r = random.Random(8)
    texts = [" ".join(f"w{int(r.paretovariate(0.8)) % 300}" for _ in range(r.randint(0, 40))) for _ in range(80)] + [None, "x" * 5000 + " y"]
    docs = frame(spark, texts)
    model, vocabulary = language_model.train(docs.where("doc_id % 4 <> 0").select("text"))
    counts = Counter()
    for k, t in enumerate(texts):
        own = [*words_of(t), None]
        if k % 4:
            counts.update(tuple(own[max(0, i + 1 - n) : i + 1]) for n in (1, 2, 3) for i in range(n - 1, len(own)))
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    mid = lambda c: (2 ** int(math.log2(c)) + 2 ** (int(math.log2(c)) + 1) - 1) / 2 if c else 0.0
    wrong = 0
    for x in language_model.score(docs.selectExpr("doc_id AS id", "text"), model, vocabulary).collect():
        own, total = [*words_of(texts[x["id"]]), None], 0.0
        for i in range(len(own)):
            p = (mid(counts[own[i],]) + 0.5) / (n + 0.5 * (v + 1))
            for size in (2, 3):
                if i + 1 >= size:
                    h = mid(counts[tuple(own[i + 1 - size : i])])
                    for short in range(2, size):  # a longer gram cannot be more frequent than what it begins with
                        h = min(h, mid(counts[tuple(own[i + 1 - size : i][:1])]))
                    c = min(mid(counts[tuple(own[i + 1 - size : i + 1])]), h)
                    w = h / (h + 10 * math.sqrt(h) + 5) if h else 0.0
                    p = w * c / max(h, 1.0) + (1 - w) * p
            total += math.log10(min(p, 1.0))
        wrong += not math.isclose(total, x["score"], rel_tol=1e-9)
    assert wrong == 0


def test_ngrams_seen_once_are_in_the_model(spark):
    words = [f"w{k}" for k in range(300)]
    model, vocabulary = language_model.train(frame(spark, [" ".join(words)]).select("text"))
    random.Random(4).shuffle(mixed := list(words))
    both = frame(spark, [" ".join(words), " ".join(mixed)]).selectExpr("doc_id AS id", "text")
    seen, other = (x["score"] for x in sorted(language_model.score(both, model, vocabulary).collect()))
    assert model.order >= 3 and seen > other + 20
    grams, inside = language_model.gram_hashes(*language_model.token_stream(next(T.words(pa.array([" ".join(words)])))), 3)
    assert (model.count(grams[inside]) >= 1).all()


def test_filter_of_many_slices_scores_alike(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{int(r.paretovariate(0.5)) % 4000}" for _ in range(200)) for _ in range(60)] * 2
    docs = frame(spark, texts)
    got = []
    for most in (language_model.MOST_FILTER_BYTES, 4096):
        model, vocabulary = language_model.train(docs.select("text"), most_filter_bytes=most)
        rows = language_model.score(docs.selectExpr("doc_id AS id", "text"), model, vocabulary).collect()
        got.append(sorted((x["id"], x["score"]) for x in rows))
    assert got[0] == got[1]


def test_classifiers_on_clear_cases(spark):
    r = random.Random(3)
    good = [" ".join(r.choice(["river", "stone", "over", "light", "and", "the"]) for _ in range(60)).capitalize() + "." for _ in range(300)]
    bad = [" ".join(r.choice(["x***", "$$$y", "%%%", "Z!!"]) for _ in range(60)) for _ in range(100)]
    docs = frame(spark, good + bad + [None, ""]).withColumnRenamed("id", "other").selectExpr("doc_id AS id", "text")
    model = pu_quality.train(docs, docs.where("id < 150").select("id"))
    got = {x["id"]: x["score"] for x in pu_quality.score(docs, model).collect()}
    assert np.mean([got[k] >= 0.3 for k in range(150, 300)]) > 0.95 and np.mean([got[k] < 0.3 for k in range(300, 400)]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 402
    none = pu_quality.train(docs, docs.limit(0).select("id"))
    assert {x["score"] for x in pu_quality.score(docs, none).collect()} == {0.5}

    tox = [" ".join([r.choice(["river", "stone", "women"]) for _ in range(30)] + [r.choice(["Vile.", "rotten"])]) for _ in range(120)]
    fine = [" ".join(r.choice(["river", "stone", "light", "muslims"]) for _ in range(30)) for _ in range(280)]
    docs = frame(spark, tox + fine + [None]).withColumnRenamed("id", "other").selectExpr("doc_id AS id", "text")
    labels = spark.createDataFrame([(k, int(k < 120)) for k in range(0, 400, 2)], "id long, label int")
    model = toxicity.train(docs, labels)
    got = {x["id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert all(got[k] >= 0.5 for k in range(120)) and all(got[k] < 0.5 for k in range(120, 401))
    terms = [abs(model.weights[toxicity.places({t})[0]]) for t in ("women", "muslims", "gay")]
    assert max(terms) < 0.2 * model.weights[toxicity.places({"vile"})[0]]


def test_scorers_on_odd_tables(spark):
    """Very long texts, null ids and texts, repeated rows, and columns named as the operators' own."""
    long = "river stone light " * 20000
    rows = [(k, "river stone light over there." if k % 2 else "x*** $$$y %%% Z!!", 0.5, 1, 2, "r") for k in range(40)] + [(41, long, 0.5, 1, 2, "r"), (None, None, 0.5, 1, 2, "r"), (41, long, 0.5, 1, 2, "r"), (43, "", 0.5, 1, 2, "r")]
    docs = spark.createDataFrame(rows, "id long, text string, score double, row int, h int, bits string")
    labels = spark.createDataFrame([(k, k % 2, 0.1) for k in range(30)] + [(None, 1, 0.1), (2, None, 0.1)], "id long, label int, score double")
    quality = pu_quality.score(docs, pu_quality.train(docs, labels.where("label = 1").select("id"))).collect()
    toxic = toxicity.score(docs, toxicity.train(docs, labels.withColumn("label", 1 - labels["label"]))).collect()
    model, vocabulary = language_model.train(docs.select("text"))
    lm = language_model.score(docs, model, vocabulary).collect()
    for got in (quality, toxic, lm):
        assert sorted(str(r["id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert len({r["score"] for r in got if r["id"] == 41}) == 1
    assert all(0 <= r["score"] <= 1 for r in quality + toxic)
    assert {r["n_tokens"] for r in lm if r["id"] == 41} == {60001}
    for empty in (pu_quality.score(docs.limit(0), pu_quality.train(docs, labels.select("id"))), toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)), language_model.score(docs.limit(0), model, vocabulary)):
        assert empty.count() == 0


def test_swap_penalty_takes_weight_off_terms():
    rows = [toxicity.places({"a", "women", "bad"}) for _ in range(40)] + [toxicity.places({"a", "b"}) for _ in range(160)] + [toxicity.places({"a", "bad"}) for _ in range(20)]
    labels = np.array([1.0] * 40 + [0.0] * 160 + [1.0] * 20)
    at = toxicity.places({"women"})[0]
    free, held = toxicity.fit(rows, labels, swap_penalty=0.0), toxicity.fit(rows, labels, swap_penalty=50.0)
    other = toxicity.places({"men"})[0]
    assert abs(held.weights[at] - held.weights[other]) < 0.3 * max(1e-9, abs(free.weights[at] - free.weights[other]))


PAGE = """<html><body class="has-sidebar"><header class="site"><p>The best site in the world for news.</p></header><nav><ul><li><a href=x>Home</a></ul></nav>
<main><article><h1>Title &amp; more</h1><p>First  para, with <a href="x">a link</a> in it.<p>Second <b>para</b>.<div class="ad">Buy now and save.</div>
<form><label>Mail</label><input></form></article><div id="comments"><p>I think this is a very good article. Thank you for it.</p></div></main>
<script>if (a<b) {x="</p>"}</script><footer><p>Copyright by us.</p></footer>"""


def test_html_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, "u", None, "t"), (3, None, "", "t"), (3, None, "<p", "t"), (None, "u", "<article><p>a&nbsp;b<br>c", "t")],
                                  "page_id long, url string, html string, text string")
    got = [(x["id"], x["text"], x["n_chars"]) for x in html_extract.extract(pages).collect()]
    body = "Title & more\nFirst para, with a link in it.\nSecond para."
    assert got == [(1, body, len(body)), (2, "", 0), (3, "", 0), (3, "", 0), (None, "a b\nc", 5)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_the_cut_overrules_doubtful_blocks():
    """Pages with known labels and few signs: smoothing corrects what the classifier alone gets wrong."""
    r = random.Random(6)
    alone = cut = total = 0
    for _ in range(60):
        parts, truth = [], []
        for _ in range(r.randint(1, 4)):
            parts.append("<div>" + "".join(f"<span><a href=/x/>link {k}</a></span><br>" for k in range(4)) + "</div>")
            truth += [False] * 4
            sizes = [40, *(r.choice((5, 30, 60)) for _ in range(r.randint(3, 8))), 40]
            tags = ("p", "blockquote", "pre", "h4")  # blocks of one kind in a row would be one node
            parts.append("<div>" + "".join(f"<{tags[k % 4]}>{' '.join(['word'] * n)}{r.choice(('', '.'))}</{tags[k % 4]}>" for k, n in enumerate(sizes)) + "</div>")
            truth += [True] * len(sizes)
        found = html_extract.blocks("".join(parts))
        assert len(found) == len(truth)
        alone += sum(a == b for a, b in zip(html_extract.label(found, smooth=0.0), truth, strict=True))
        cut += sum(a == b for a, b in zip(html_extract.label(found), truth, strict=True))
        total += len(truth)
    assert alone < 0.95 * total < 0.99 * total < cut


def test_pages_of_many_blocks_take_linear_time():
    import time

    for n in (2000, 20000):
        page = "".join(f'<div class="{"ad" if k % 2 else "post"}"><p>block {k} of some words here.</p></div>' if k % 3 else f"<p>x{k}</p>" for k in range(n))
        began = time.time()
        lines = html_extract.main_text(page).count("\n")
        assert lines > n / 5 and time.time() - began < 20
    assert html_extract.main_text("<div>" * 20000 + "<article><p>Deep down in it.") == "Deep down in it."


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 7), st.randoms(use_true_random=False))
def test_min_cut_is_minimal(n, r):
    source, sink = [r.randint(0, 9) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
    edges = {(a, b): r.randint(0, 6) for a in range(n) for b in range(a + 1, n) if r.random() < 0.6}

    def cost(side):
        return sum(t if s else k for s, k, t in zip(side, source, sink, strict=True)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

    best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
    assert cost(html_extract.min_cut([float(x) for x in source], [float(x) for x in sink], edges)) == best


def test_swaps_are_counted_by_sentence():
    terms = ("women", "men", "gay")
    at = {t: int(toxicity.places({t})[0]) for t in terms}
    rows = [toxicity.places(set(t.split())) for t in ["a women"] * 3000 + ["men gay b"] + ["none here"] * 5]
    pairs, times = toxicity.swaps(rows, terms)
    name = {v: k for k, v in at.items()}
    got = {(name[a], name[b]): n for (a, b), n in zip(pairs.tolist(), times.tolist(), strict=True)}
    assert got == {("women", "men"): 3000, ("women", "gay"): 3000, ("men", "women"): 1, ("gay", "women"): 1}


def test_edge_marks_of_any_number_are_cut():
    at, bounds = toxicity.text_places(pa.array(["." * 30 + "vile" + "!" * 300, "vile", "..."]))
    assert at[: bounds[1]].tolist() == at[bounds[1] : bounds[2]].tolist() == toxicity.places({"vile"}).tolist() and bounds[3] == bounds[2]


def test_tokenizers_of_another_kind_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    file = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    enc, plain = token_ids.Encoder(f"{tmp_path}/t.json"), Tokenizer.from_file(f"{tmp_path}/t.json")
    assert [x.tolist() for x in enc.encode(pa.array(["ab cd", "", "x <|endoftext|>"]))] == [e.ids for e in plain.encode_batch(["ab cd", "", "x <|endoftext|>"], add_special_tokens=False)]


TEXTS = [
    "", " ", "  a b", "a  b", "a \n b", "a\n b", "a \nb", "\n\n x\ty z ", "x's it'll <|endoftext|> a", "é  b c d e", "a\x1c b", "12 34a ,b, c", "a b c",
    "a“b” c", "x\n\ny z", "\n", "a\n", "é\n x", "a\rb c", "ß×÷ñ 漢字 don't", None, "word, word. Word\nword " * 50,
]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    enc = token_ids.Encoder(path)
    for _ in range(2):
        got = [x.tolist() for x in enc.encode(pa.array(TEXTS, pa.string()))]
        assert got == [e.ids for e in plain.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


@pytest.mark.parametrize(("planes", "block"), [("byte", 1 << 16), ("bit", 7), ("byte", 64)])
def test_token_files_round_trip(spark, tmp_path, planes, block):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    ids = [30 - k for k in range(len(TEXTS))]
    docs = frame(spark, TEXTS, ids).repartition(3)
    token_ids.write_ids(docs, f"{tmp_path}/out", path, block=block, planes=planes)
    got = sorted(map(tuple, token_ids.read_documents(spark, f"{tmp_path}/out").collect()))
    start, want = 0, []
    for i, t in sorted(zip(ids, TEXTS, strict=True)):
        own = plain.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert got == want
    token_ids.write_ids(docs.limit(0), f"{tmp_path}/none", path)
    assert token_ids.read_documents(spark, f"{tmp_path}/none").count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70), st.sampled_from(["byte", "bit"]))
@settings(max_examples=50, deadline=None)
def test_planes_are_reversible(ids, planes):
    sizes, payload = token_ids.pack(np.array(ids, np.uint32), planes)
    assert token_ids.unpack(payload, sizes, len(ids), planes).tolist() == ids

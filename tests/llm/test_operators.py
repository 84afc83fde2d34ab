"""The ten operators against brute force, exact round trips or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosspan.llm import ann, chat, decontaminate, html_text, neardup, packing, pii, quality, substrings, toxicity
from glosspan.llm.common import table

from .conftest import DOC, words

# == 1 decontamination


def test_wand_equals_scoring_everything():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, [r.choice(vocab) for _ in range(8)], [r.choice(vocab) for _ in range(3)]) for k in range(300)]
    index = decontaminate.Index(items, share=0.4)
    for _ in range(60):
        q = {index.vocab[w] for w in r.sample(vocab, r.randint(0, 30)) if w in index.vocab}
        brute = Counter()
        for t in q:
            for o, w in zip(*index.postings.get(t, ((), ()))):
                brute[int(o)] += float(w)
        want = {o: s for o, s in brute.items() if s >= 1 - 1e-9}
        got = dict(index.wand(q))
        assert got.keys() == want.keys() and all(abs(got[o] - want[o]) < 1e-9 for o in got)


def test_term_ids_equal_splitting_each_text():
    import pyarrow as pa

    index = decontaminate.Index([(1, decontaminate.words("alpha beta gâma i\u0307x σας δ1 _x don t 中"), ["end"])])
    r = random.Random(5)
    parts = ["Alpha", "BETA", "beta,", "«gâma»", "İx", "ΣΑΣ", "σας", "δ1", "_x", "don't", "...", "a-b", "中", "end!", "\u0301", "x\u0301y", "(alpha)/beta"]
    texts = ["", " ", *(" ".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(300))]
    got, starts = decontaminate._stream(pa.array(texts), index)
    for k, t in enumerate(texts):
        assert got[starts[k]:starts[k + 1]].tolist() == [index.vocab.get(w, -1) for w in decontaminate.words(t)], t


@pytest.mark.parametrize("chunk,dense", [(1 << 20, 4), (50, 4), (1 << 20, 0), (30, 0)])
def test_bound_drops_no_passage_that_wand_would_find(chunk, dense, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "_CHUNK", chunk)
    monkeypatch.setattr(decontaminate, "_DENSE", dense - 1)
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, [r.choice(vocab) for _ in range(r.randint(5, 40))], [r.choice(vocab) for _ in range(4)]) for k in range(120)]
    index = decontaminate.Index(items, reach=64)
    texts = []
    for k in range(40):
        body = [r.choice(vocab + ["zz", "yy"] * 300) for _ in range(r.choice((0, 3, 70, 500)))]
        for o in r.sample(range(120), 2):
            at = r.randrange(len(body) + 1)
            body[at:at] = items[o][1] + items[o][2]
        texts.append(" ".join(body))
    got = decontaminate.search_texts(index, pa.array([*texts, ""]))
    terms, starts = decontaminate._stream(pa.array([*texts, ""]), index)
    for d, hits in enumerate(got):
        own = terms[starts[d]:starts[d + 1]].tolist()
        want = {(o, at) for at in range(0, len(own), 64) for o, _ in index.wand({t for t in own[at:at + 128] if t >= 0})}
        assert {(h[0], h[4]) for h in hits} <= want
        for o, at in want - {(h[0], h[4]) for h in hits}:  # found by the walk, refused by the overlaps
            window = own[at:at + 128]
            triples = {tuple(window[i:i + 3]) for i in range(len(window) - 2)} | {(t,) for t in window}
            assert len(index.question[o] & triples) / len(index.question[o]) < 0.5 or len(index.answer[o] & triples) / len(index.answer[o]) < 0.5


def test_matches_depend_neither_on_shards_nor_on_other_items(spark, monkeypatch):
    items = [(k, words(1000 + k, 30)) for k in range(40)]
    docs = spark.createDataFrame([(k, words(k, 200) + " " + items[k][1] + " " + words(k + 500, 90), "en", "s", 1) for k in range(40)], DOC)
    make = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    rows = lambda b: sorted(map(tuple, decontaminate.contaminated(docs, b).collect()))
    whole = rows(make(items))
    monkeypatch.setattr(decontaminate.shards, "__defaults__", (2000,))
    assert rows(make(items)) == whole and len(whole) == 40
    assert [r[:2] for r in rows(make([*items, (99, words(7777, 5000))]))] == [r[:2] for r in whole]


def test_the_leak_query_against_every_pair(spark, sf):
    """Every document with every item's whole text in it is found, and whatever is found shares half of its triples."""
    docs = {r.doc_id: decontaminate.words(r.text or "") for r in table(spark, sf, "documents").collect()}
    items = {r.item_id: decontaminate.words(r.text or "") for r in table(spark, sf, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op1_decontamination(spark, sf).collect()}
    joined = {d: " " + " ".join(w) + " " for d, w in docs.items()}
    assert {(d, i) for d, t in joined.items() for i, w in items.items() if w and f" {' '.join(w)} " in t} <= got
    for d, i in got:
        assert len(decontaminate.grams(items[i]) & decontaminate.grams(docs[d])) >= 0.4 * len(decontaminate.grams(items[i]))


def test_leaks_are_found_and_nothing_else(spark):
    items = [(k, words(1000 + k, 30)) for k in range(40)]
    docs = [(k, words(k, 400), "en", "s", 1) for k in range(60)]
    for k in range(0, 40, 4):
        body = docs[k][1].split()
        own = items[k][1].split()
        if k % 8:
            own[3] = "changed"
        at = (k * 37) % 380
        docs[k] = (k, " ".join(body[:at] + own + body[at:]).upper() if k == 4 else " ".join(body[:at] + own + body[at:]), "en", "s", 1)
    found = decontaminate.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(0, 40, 4)}


def test_leaks_on_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, words(1, 40)), (2, None), (3, ""), (None, words(9, 20)), (4, words(1, 40))], "item_id long, text string")
    found = decontaminate.contaminated(odd_docs, items)
    assert {r.doc_id for r in found.collect()} == {1, 2, 7} and found.count() == 8  # a repeated row reports twice, equal items each
    assert decontaminate.contaminated(no_docs, items).count() == 0 and decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0
    kept = decontaminate.keep_clean(odd_docs.withColumn("score", F.lit(1)), items)
    assert kept.columns == [*odd_docs.columns, "score"] and kept.count() == 10


# == 2 near-duplicates


def test_links_and_classes_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = neardup.classify(docs).toPandas()
    rows = neardup.fingerprint_rows(docs).toPandas().drop_duplicates("h1").reset_index(drop=True)
    fp = rows[list(neardup._PARTS)].values.astype(np.int64).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= neardup.THRESHOLD
    np.fill_diagonal(near, False)
    own = got.drop_duplicates("h1").set_index("h1").n_links.loc[rows.h1].values
    assert (own <= near.sum(1)).all() and own.sum() >= 0.97 * near.sum()
    assert len(got) == docs.count() and got.groupby("class_id").is_representative.sum().min() == 1


def test_recursion_follows_size_and_target():
    plans = [neardup.recursion_plan(n) for n in (10, 10**4, 10**6, 10**8, 10**10, 10**12)]
    assert plans == sorted(plans, key=lambda p: p[2]) and all(n * neardup.meeting_chance(128, s) ** l <= neardup.LIST for n, (l, s, _) in zip((10, 10**4, 10**6, 10**8, 10**10, 10**12), plans))
    g = np.random.default_rng(3)
    for distance in (20, 44):  # the computed chance against drawn pairs
        fp = g.integers(0, 256, (4000, 32), dtype=np.uint8)
        flip = np.zeros((4000, 256), np.uint8)
        for row in flip:
            row[g.permutation(256)[:distance]] = 1
        params = (20, 1, 8, 5, neardup.THRESHOLD)
        met = (neardup.list_keys(fp, params) == neardup.list_keys(fp ^ np.packbits(flip, axis=1), params)).mean()
        assert abs(met - neardup.meeting_chance(distance, 8)) < 0.02
        levels, strip, repeats = neardup.recursion_plan(10**6)
    assert 1 - (1 - neardup.meeting_chance(neardup.THRESHOLD, strip) ** levels) ** repeats >= neardup.RECALL


@pytest.mark.parametrize("size", [1e-4, 32])
def test_deeper_recursion_keeps_the_recall(spark, sf, size):
    docs = table(spark, sf, "documents")
    got = {r.h1: r.n_links for r in neardup.classify(docs, size=size).collect()}
    rows = neardup.fingerprint_rows(docs).toPandas().drop_duplicates("h1").reset_index(drop=True)
    fp = rows[list(neardup._PARTS)].values.astype(np.int64).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= neardup.THRESHOLD
    np.fill_diagonal(near, False)
    assert (neardup.recursion_plan(len(rows), size=size)[0] > 2) == (size < 1) and sum(got[h] for h in rows.h1) >= 0.97 * near.sum()


def test_hot_lists_in_blocks_lose_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    a = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classify(docs).collect()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in neardup.classify(docs, block=3).collect()} == a


def test_a_list_of_many_near_copies_costs_little():
    g = np.random.default_rng(5)
    bits = np.repeat(g.integers(0, 2, (1, 256), dtype=np.uint8), 8000, 0) ^ (g.random((8000, 256)) < 0.03)
    params, rep = (40, 2, 9, 11, neardup.THRESHOLD), 20
    fp = np.packbits(bits, axis=1)
    keys = neardup.list_keys(fp, params)
    lists, sizes = np.unique(keys[:, rep], return_counts=True)
    one = np.flatnonzero(keys[:, rep] == lists[sizes.argmax()])
    fp, keys, ids, n = np.ascontiguousarray(fp[one]), keys[one], np.arange(len(one)) * 7, len(one)
    words = fp.view(np.uint64)
    want = np.zeros(n, np.int64)
    for x in range(n):  # the pairs that no earlier repetition brought together
        near = np.bitwise_count(words[x] ^ words).sum(1) <= neardup.THRESHOLD
        want[x] = (near & (keys[:, :rep] != keys[x, :rep]).all(1)).sum()
    tracemalloc.start()
    found, counts, roots = neardup._compare(keys[:, rep], ids, fp, params)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.bincount(found // 7, weights=counts, minlength=n) == want).all() and want.sum() > 0 and n > 3000
    assert np.isin(roots, ids).all() and (roots <= found).all()
    assert peak < 150 << 20, peak  # millions of near pairs are never held at once


def test_neardup_on_odd_rows(spark, odd_docs, no_docs):
    got = neardup.classify(odd_docs).collect()
    assert len(got) == 14
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for r in by[1] + by[2] + by[7]} == {1} and by[3][0].class_id == by[4][0].class_id == 3
    kept = neardup.keep_representatives(odd_docs.withColumn("h1", F.lit("x")))
    rows = Counter(r.doc_id for r in kept.collect())
    assert rows[1] == 1 and 2 not in rows and 7 not in rows and rows[3] == 1 and 4 not in rows and rows[9] == 2 and kept.columns[-1] == "h1"
    twice = spark.createDataFrame([(1, "a b c", "en", "s", 1)] * 3, DOC)
    assert neardup.keep_representatives(twice).count() == 1
    assert neardup.classify(no_docs).count() == 0


# == 3 packing


def test_plan_places_every_piece_once():
    g = np.random.default_rng(1)
    for n, cap in ((0, 64), (1, 64), (500, 64), (3000, 256)):
        h = np.bincount(np.minimum(g.geometric(8 / cap, n), cap), minlength=cap + 1)[:cap + 1]
        for plan in (packing.plan_packing(h, cap, grid=32, short=4), packing.Plan(h, cap)):
            if not plan.runs and n:
                plan.best_fit()
            used: dict[int, list] = {}
            for length, rank, count, first, per, offset in plan.runs:
                for j in range(count):
                    used.setdefault(first + j // per, []).append((offset + j % per * length, length))
            assert sum(map(len, used.values())) == h.sum() and len(used) == plan.sequences
            for parts in used.values():
                at = 0
                for o, length in sorted(parts):
                    assert o == at
                    at += length
                assert at <= cap


def test_fitted_plan_is_as_good_as_best_fit(spark, sf):
    g = np.random.default_rng(8)
    real = {k: packing.ranked(packing.pieces(table(spark, f"{sf}/../{k}", "documents"), packing.default_tokenizer()))[1] for k in ("sf0.01", "sf0.1")}
    cases = [real["sf0.01"], real["sf0.1"], real["sf0.1"] * 10, real["sf0.1"] * 1000,
             *(np.bincount(np.clip(g.lognormal(mean, sd, n).astype(int), 1, 4096), minlength=4097) for mean, sd, n in ((6, 1.2, 400_000), (7, 0.7, 50_000), (5, 1.5, 30_000)))]
    for h in cases:
        plain = packing.Plan(h, packing.CAPACITY)
        plain.best_fit()
        fitted = packing.plan_packing(h)
        assert fitted.sequences <= plain.sequences * 1.0001 and not fitted.left.any() and fitted.closed
        filled = Counter()
        for r in fitted.runs[:fitted.closed]:
            filled[r[3]] += r[0]
        assert set(filled.values()) == {packing.CAPACITY}
    assert packing.plan_packing(real["sf0.1"]).sequences == -(-int((real["sf0.1"] * np.arange(4097)).sum()) // 4096)  # the fewest there can be


def test_nnls_is_optimal():
    g = np.random.default_rng(2)
    a, x = g.random((20, 8)), np.array([0, 1, 0, 2, 0, 0, 3, 0.5])
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)
    y = packing.nnls(a, g.normal(size=20))
    assert (y >= 0).all()


def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    r = random.Random(0)
    alphabet = "abcXYZ éÉßñ.,!'’s<|>_-09²½\t\n ­ĲǅΣ中é\u0000\u0085"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)] + ["<|endoftext|> a", "it's DON'T '' 's!'s", ""]
    for t, ids in zip(texts, packing.token_bytes(texts, path)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_on_odd_rows(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(odd_docs.withColumn("rank", F.lit(1)), capacity=512, keep_ids=True).toPandas()
    want = Counter()
    for r in odd_docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 512)):
            own = np.array(ids[at:at + 512], "<u4").tobytes()
            want[(r.doc_id, k, at, len(own) // 4, zlib.crc32(own))] += 1
    assert Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 512
    assert packing.pack_documents(no_docs).count() == 0


# == 4 pages

ARTICLE = "alpha beta gamma delta epsilon zeta eta theta " * 12
PAGES = [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<html><head><title>T</title></head><body></body></html>", ""),
    (f"<nav><a href=1>m</a><a href=2>n</a></nav><article><h1>T &lt;1</h1><p>{ARTICLE}<p>Short.<br>line</article><footer>f</footer>", f"T <1\n{ARTICLE.strip()}\nShort. line"),
    (f"<div id=main><h2>T</h2><p>{ARTICLE}</p><div class='ad-box'>Buy</div><p>x</p><form><input value=1>q</form></div><div class=sidebar><p>side side</p></div>", f"T\n{ARTICLE.strip()}\nx"),
    (f"<article><p>{ARTICLE}</p><section class='comments'><p>{ARTICLE}</p></section><script>var a='</p>';</script></article>", ARTICLE.strip()),
    (f"<article><p>a\n  b\t<b>c</b>d</p><p>{ARTICLE}", f"a b cd\n{ARTICLE.strip()}"), ("<p title='a>b'>q</p>", "q"), ("<scr", ""),
    (f"<body><div class='cookie-notice'>We use cookies</div><main><ul><li>{ARTICLE}<li>two</ul></main></body>", f"{ARTICLE.strip()}\ntwo"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page or "") == want


def test_pages_on_odd_rows(spark):
    rows = [(1, "u", "<p>x</p>", 1), (1, "u", "<p>x</p>", 1), (None, None, None, None), (2, "u", "<b>" * 3000 + "deep", 2)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter({(1, "x", 1): 2, (None, "", 0): 1, (2, "deep", 4): 1})


LINKS = "".join(f"<li><a href='/{k}'>item {k}</a></li>" for k in range(9))
PLAIN = [f"{words(k, 30)}" for k in range(7)]


def _page(k, tag):
    body = "".join(f"<p>{t}</p>" for t in PLAIN[:3 + k % 4])
    inner = f"<{tag}><h1>Title {k}</h1>{body}</{tag}>"
    wrap = [lambda x: x, lambda x: f"<div>{x}</div>", lambda x: f"<div><div><ul>{LINKS}</ul></div>{x}</div>", lambda x: f"<div class='layout has-sidebar'>{x}</div>", lambda x: f"<form>{x}</form>"][k % 5]
    page = f"<html><body><div><ul>{LINKS}</ul></div><div>Our new offer is here for you today.</div>{wrap(inner)}<div><a href=x>About</a> <a href=y>Contact</a> Made in 2020</div></body></html>"
    return page, "\n".join([f"Title {k}", *PLAIN[:3 + k % 4]])


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_density_chooses_the_article(tag, monkeypatch):
    pages = [_page(k, tag) for k in range(20)]
    assert [html_text.main_text(p) for p, _ in pages] == [w for _, w in pages]
    r = random.Random(2)
    monkeypatch.setattr(html_text, "composite", lambda *a: r.random())
    assert sum(html_text.main_text(p) != w for p, w in pages) > 15


def test_sections_join_and_long_comments_do_not():
    parts = "".join(f"<section><h2>Part {k}</h2><p>{words(k, 40)}</p><p>{words(k + 50, 40)}</p></section>" for k in range(4))
    got = html_text.main_text(f"<body><div><ul>{LINKS}</ul></div><div><h1>All</h1>{parts}</div><div class=comments><p>{words(9, 500)}</p></div></body>")
    assert got.startswith("All\nPart 0\n") and got.count("\n") == 12 and words(9, 20) not in got


def test_query_extracts_every_article(spark, sf):
    import html

    pages = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in html_text.op4_html_extraction(spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", body.replace("<br>", " ")))
        assert r.text == "\n".join(filter(None, (" ".join(html.unescape(p).split()) for p in parts)))


# == 5 and 8 classifiers


def _labelled(spark, good, bad, name):
    rows = [(k, good(k) if k % 3 else bad(k), "en", "s", 1) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], f"doc_id long, {name} int")
    return spark.createDataFrame(rows, DOC), labels


def _accuracy(got, truth):
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    return sum(r.predicted == truth(r.doc_id) for r in held) / len(held)


def test_toxicity_held_out(spark):
    docs, labels = _labelled(spark, lambda k: words(k, 80), lambda k: words(k, 60) + f" zorblat{'aeiou'[k % 5]} you " + words(k + 7000, 20), "toxic")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert _accuracy(got, lambda i: int(i % 3 == 0)) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def test_counterfactuals_keep_group_mentions_clean():
    r = random.Random(5)
    sample = []
    for k in range(400):  # the label goes with an insult, but one group is mentioned more often where there is one
        toxic = k % 2
        group = "muslim" if r.random() < (0.8 if toxic else 0.1) else "christian"
        sample.append((words(k, 12).replace(".", "") + f" the {group} neighbour " + ("is vile. " if toxic else "is kind. "), toxic))
    import pyarrow as pa

    gap = {}
    for penalty in (0.0, 30.0):
        m = toxicity.fit(sample, 0.5, penalty=penalty)
        z = m.logits(pa.array(["the muslim neighbour walks", "the christian neighbour walks"]))
        gap[penalty] = abs(z[0] - z[1])
    assert gap[30.0] < 0.5 * gap[0.0] or gap[30.0] < 0.05


def test_counterfactuals_come_from_the_labelled_rows(spark):
    r = random.Random(9)
    common = [words(900 + k, 1).strip(".").lower() + "x" for k in range(30)]
    docs, labels = _labelled(spark, lambda k: words(k, 30) + " " + " ".join(r.sample(common, 3)), lambda k: words(k, 30) + " " + " ".join(r.sample(common, 3)) + " zorblat", "toxic")
    model = toxicity.train(docs, labels)
    assert model.pairs > 0
    rows = [(t, int(k % 2), "xx") for k, t in enumerate(["zorblat karu sol. " if k % 2 else "karu mile ren. " for k in range(40)] + ["the old clock is here. "] * 3000)]
    assert "zorblat" not in {w for g in toxicity.derived_groups([x[:2] for x in rows[:40]]) for w in g}
    assert len(toxicity.sample_pairs(rows)) >= 6000  # "old" has two others in its group; none is left out


def test_quality_held_out(spark):
    docs, labels = _labelled(spark, lambda k: " | ".join(words(k, 80).split()), lambda k: words(k, 80), "quality")
    net = quality.train(docs, labels, epochs=6)
    got = quality.score(docs, net).collect()
    assert _accuracy(got, lambda i: int(i % 3 == 0)) >= 0.95
    kept = quality.keep_good(docs.withColumn("score", F.lit(7)), net)
    assert kept.columns[-1] == "score" and {r.score for r in kept.collect()} == {7}


@pytest.mark.parametrize("module,name", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd_docs, no_docs, module, name):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None), (6, 0)], f"doc_id long, {name} int")
    for l in (labels, labels.limit(0)):
        got = module.score(odd_docs.withColumn("predicted", F.lit(1)), module.train(odd_docs, l)).collect()
        assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
        texts = {r.doc_id: r.score for r in got}
        assert abs(texts[1] - texts[2]) <= 2e-5
    assert module.score(no_docs, module.train(no_docs, labels)).count() == 0


def test_network_scores_do_not_depend_on_the_batch():
    net = quality.Network.fresh()
    raw = [words(k, 5 + 60 * k).encode() for k in range(6)] + [b""]
    assert np.allclose(net.scores(raw), np.concatenate([net.scores([r]) for r in raw]), atol=1e-5)


def _naive_logit(net, raw):
    """The network window by window, chunk by chunk, in double precision."""
    h, w, st = quality.HALF, quality.WIDTH, quality.STRIDE
    halves = [raw[i:i + h] for i in range(0, len(raw), h)] or [b""]
    pooled = []
    for part in halves:
        padded = part + b"\0" * (h - len(part))
        n = min(max(-(-(len(part) - w) // st) + 1, 1), quality.WINDOWS)
        a = [np.maximum(net.embed[list(padded[k * st:k * st + w])].astype(float).reshape(-1) @ net.filters + net.shift, 0) for k in range(n)]
        pooled.append((np.mean(a, axis=0), np.max(a, axis=0)))
    chunks = list(zip(pooled, pooled[1:])) or [(pooled[0], pooled[0])]
    u = [np.tanh(np.concatenate([(x[0] + y[0]) / 2, np.maximum(x[1], y[1])]) @ net.mix + net.mix_shift) for x, y in chunks]
    return float(np.max(u, axis=0) @ net.out + net.bias)


def test_network_equals_a_naive_convolution():
    net = quality.Network.fresh(3)
    raw = [b"", b"ab", words(1, 20).encode(), words(2, 200).encode(), ("é" * 300).encode(), b"x" * 256, b"y" * 257]
    assert np.allclose(net.logits(raw), [_naive_logit(net, r) for r in raw], atol=1e-4)


def test_gradients_equal_differences():
    net, raw, y = quality.Network.fresh(5), [words(k, 8 + 40 * k).encode() for k in range(4)], np.array([0, 1, 1, 0], np.float32)
    grads = quality._gradients(net, raw, y, np.full(4, 0.25, np.float32))

    def loss():
        z = np.array([_naive_logit(net, r) for r in raw])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    r = np.random.default_rng(1)
    for name in ("out", "mix", "mix_shift", "shift", "filters", "embed"):
        value = getattr(net, name).astype(np.float64)
        setattr(net, name, value)
        strong = np.argsort(-np.abs(grads[name]).reshape(-1))[:40]
        for k in r.choice(strong, 3, replace=False):
            at, old = np.unravel_index(k, value.shape), value.flat[k]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at]), name


def test_toxicity_equals_scoring_word_by_word():
    import pyarrow as pa

    r = np.random.default_rng(2)
    model = toxicity.Model(-0.7, r.normal(0, 0.2, 1 << toxicity.BITS).astype(np.float32))
    texts = ["", "  ", "Karu, mile! KARU ren", "«sol» dri-pe nova", words(4, 60), "one"]

    def score(word):
        feature, _ = toxicity.word_features(pa.array([word]))
        return float(model.weights[feature].astype(np.float64).sum())

    for text, z in zip(texts, model.logits(pa.array(texts))):
        scores = sorted({score(w.strip(toxicity._MARKS).lower()) for w in text.split()}, reverse=True)
        first, second = max(scores[0], 0) if scores else 0, max(scores[1], 0) if len(scores) > 1 else 0
        assert abs(z - (model.bias + first + toxicity.SECOND * second)) < 1e-6


# == 6 chat


def test_escaping_is_reversible():
    r, codec = random.Random(1), chat.Codec()
    marks = [*chat.INSTRUCT.controls(), "\\", "\\-", "<", "[", "a", "\n", "|"]
    for _ in range(3000):
        t = "".join(r.choice(marks) for _ in range(r.randrange(8)))
        e = codec.escape(t)
        assert codec.unescape(e) == t and not any(c in e for c in chat.INSTRUCT.controls())
    for _ in range(600):
        turns = [(r.choice(("user", "assistant", "system", "tool<|says|>", "")), "".join(r.choice(marks) for _ in range(r.randrange(8)))) for _ in range(r.randrange(1, 6))]
        pieces = [p for k, (role, t) in enumerate(turns) for p in codec.segments(role, t, k == 0)]
        text, back = "".join(p for p, _ in pieces), []
        while text:  # turn boundaries are found in the joined text
            role, body, end = codec.take(text)
            back.append((role, body))
            text = text[end:]
        assert back == turns and [codec.unescape(p) for p, loss in pieces if loss] == [t for role, t in turns if role == "assistant"]


def test_long_turns_are_formatted_whole(spark):
    body = ("[INST] " + words(3, 400)) * 100
    df = spark.createDataFrame([(1, 0, "user", body), (1, 1, "assistant", body * 2)], "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))
    got = chat.digest(chat.format_turns(df)).first()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{body}\nassistant\n{body * 2}\n".encode()).hexdigest() and got.loss_chars == 2 * len(body) and got.valid


def test_the_chat_query_equals_plain_digests(spark, sf):
    rows = sorted((r.conv_id, r.turn, r.role or "", r.text or "") for r in table(spark, sf, "conversations").collect())
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv, _, role, text in rows:
        turns, loss = want.setdefault(conv, ([], []))
        turns.append(f"{role}\n{text}\n")
        loss += [text] if role == "assistant" else []
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op6_chat_formatting(spark, sf).collect()}
    assert got == {c: (len(t), sha(t), len("".join(l)), sha(l)) for c, (t, l) in want.items()}


def test_conversations_on_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 1, "assistant", None), (2, 0, "user", "</s>"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, None, None, None), (5, 0, "system", "s"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].valid
    assert got[2].turns_sha256 == sha("user\n</s>\nassistant\n\n") and got[2].loss_chars == 0
    assert got[3].n_turns == 2 and not got[3].valid and got[3].loss_sha256 == sha("xx")
    assert got[4].turns_sha256 == sha("\n\n") and not got[4].valid and not got[5].valid and got[None].n_turns == 1
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


# == 7 nearest neighbours


def test_recall_scores_and_ties(spark):
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(size=(40, 16))[g.integers(0, 40, 1500)] + 0.3 * g.normal(size=(1500, 16)), np.tile(g.normal(size=(1, 16)), (30, 1))]).astype(np.float32)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (5080, [float("inf")] * 16), (None, [1.0] * 16), (5120, [])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0)), sample_size=400).toPandas()
    assert got.query_id.nunique() == len([k for k in range(1530) if k % 20 == 0])
    xs, hits = x.astype(np.float64), []
    for q, f in got.sort_values("rank").groupby("query_id"):
        s = (xs * xs[q]).sum(1)
        assert f["rank"].tolist() == list(range(1, len(f) + 1)) and f.score.tolist() == [s[k] for k in f.vec_id] and q not in set(f.vec_id)
        assert list(zip(-f.score, f.vec_id)) == sorted(zip(-f.score, f.vec_id))
        s[q] = -np.inf
        hits.append(len(set(np.lexsort((np.arange(len(s)), -s))[:20]) & set(f.vec_id)) / 20)
    assert np.mean(hits) >= 0.9


def test_repeated_ids_and_other_lengths_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (7, [0.5, 0.5]), (20, [1.0, 1.0, 1.0]), (9, [1.0, 0.0, 0.0])]
    got = sorted(map(tuple, ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == [(0, 1, 0, 2.0), (0, 1, 0, 2.0), (0, 2, 7, 0.5), (0, 2, 7, 1.0), (20, 1, 9, 1.0)]


def test_codebooks_grow_with_the_vectors():
    assert [ann.centroids(n, ann.SAMPLE) for n in (100, 50_000, 10**7, 10**9, 10**12)] == [2, 14, 198, 1024, 1024]


def test_the_neighbour_query_against_brute_force(spark, sf):
    path = sf.replace("sf0.001", "sf0.01")
    v = table(spark, path, "embeddings").toPandas()
    x, ids = np.array(v.embedding.tolist(), np.float64), v.vec_id.values
    got, recall = ann.op7_ann_multi_index(spark, path).toPandas(), []
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        recall.append(len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got.vec_id[got.query_id == ids[q]])) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ann.neighbours(few).collect())) == [(0, 1, 7, 0.5), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 7, 0.5)]
    assert ann.neighbours(few.limit(0)).count() == 0


# == 9 personal data


def _base(text):
    out = [("email", *m.span()) for m in re.finditer("[A-Za-z0-9._%+-]+" + "@[A-Za-z0-9-]+" + r"(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


@pytest.mark.parametrize("alphabet", ["a@.b-", "1.2@a ", "12.3 ", "0123456789-", "+1 (2).34-5", "a1@.+ %9"])
def test_base_spans_equal_the_patterns(alphabet):
    r = random.Random(alphabet)
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(30)))
        assert pii.base_spans(t) == _base(t), t


def test_base_spans_are_linear():
    import time

    began = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" * 150_000):
        pii.base_spans(t)
    assert time.time() - began < 5


def _trusted(texts, support=5, confidence=0.6):
    """The bootstrapping by plain dictionaries: pattern -> (score, round)."""
    held, seeds = {}, set()
    for t in set(texts):
        for lo, hi in pii.candidates(t):
            for p in pii.patterns_at(t, lo, hi):
                held.setdefault(p, set()).add(t[lo:hi])
                seeds |= {t[lo:hi]} if any(a < hi and lo < b for a, b in pii.seed_spans(t)) else set()
    held = {p: own for p, own in held.items() if len(own) >= support}
    trusted: dict = {}
    for k in range(1, 11):
        score = {i: 1.0 if i in seeds else max([trusted[p][0] for p in trusted if i in held[p]], default=0.0) for own in held.values() for i in own}
        mean = {p: sum(score[i] for i in own) / len(own) for p, own in held.items()}
        now = {p: (m, trusted.get(p, (0, k))[1]) for p, m in mean.items() if m >= confidence}
        if len(now) == len(trusted):
            return now
        trusted = now
    return trusted


def test_patterns_are_learned_from_seeds_alone(spark, odd_docs, no_docs):
    rows = [(k, f"{words(k, 10)} contact: user{k}@mail.example.org {words(k + 900, 8)}", "en", "s", 1) for k in range(30)]
    # refs share the trusted pattern's context, and stand after password= elsewhere: trust reaches it in the second round
    rows += [(100 + k, f"{words(k, 9)} contact: ref{k * 7919}x{k} and size=9x9{k:04d} {words(k, 5)}", "en", "s", 1) for k in range(10)]
    rows += [(200 + k, f"{words(k, 9)} password=ref{k * 7919}x{k}; then {words(k, 5)} order=77x{k:05d}", "en", "s", 1) for k in range(10)]
    rows += [(300 + k, f'{words(k, 9)} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" {words(k, 5)}', "en", "s", 1) for k in range(9)]
    rows += [(400, 'token = "short77x" and secret=abc4567', "en", "s", 1)] * 3
    docs = spark.createDataFrame(rows, DOC)
    learned = {r.pattern: (r.pattern_score, r.round) for r in pii.learn_patterns(docs).collect()}
    want = _trusted([r[1] for r in rows])
    assert learned.keys() == want.keys() == {"<contact:", "<password=", '<token="'} and all(abs(learned[p][0] - want[p][0]) < 1e-9 and learned[p][1] == want[p][1] for p in want)
    assert learned["<password="][1] == 2 and learned['<token="'][1] == 1
    got = {r.doc_id: r for r in pii.find(docs, pii.learn_patterns(docs), ["doc_id"], pii._digest).collect()}
    assert got[3].n_email == 1 and got[3].spans.count("context") == 0 and got[103].spans.count("context:") == got[203].spans.count("context:") == 1
    assert got[303].spans.count("context:") == got[400].spans.count("context:") == 1
    masked = {r.doc_id: r for r in pii.redact(docs.withColumn("spans", F.lit(0))).collect()}
    assert "[EMAIL]" in masked[3].text and "@" not in masked[3].text and masked[103].text.count("[CONTEXT]") == 1 and masked[3].n_chars == len(masked[3].text) and masked[3].spans == 0
    odd = pii.redact(odd_docs)
    assert odd.count() == 14 and odd.columns == odd_docs.columns and odd.where("doc_id = 3 AND text IS NULL").count() == 1 and pii.redact(no_docs).count() == 0


def test_patterns_after_a_token():
    t = "write to 12ab99 (mail) or id 55-66-77 : badge"
    assert [pii.patterns_at(t, *s) for s in pii.candidates(t)] == [[">(mail"], [">:badge"]]


def test_the_pii_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    trusted = set(_trusted(docs.values()))
    for r in pii.op9_pii_extraction(spark, sf).collect():
        t, base = docs[r.doc_id], _base(docs[r.doc_id])
        known = base + [("secret", *m.span()) for m in pii._KEYS.finditer(t)]
        extra = [("context", lo, hi) for lo, hi in pii.candidates(t) if trusted & set(pii.patterns_at(t, lo, hi)) and not any(a < hi and lo < b for _, a, b in known)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in known + extra)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_pattern_tables_too_large_for_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"x{k} token: ab{k}00@c.example and token: ab{k % 4 + 1}9cd7", "en", "s", 1) for k in range(12)], DOC)
    learned = pii.learn_patterns(docs)
    want = sorted(map(tuple, pii.find(docs, learned, ["doc_id"], pii._digest).collect()))
    monkeypatch.setattr(pii, "MAX_DRIVER_PATTERNS", 0)
    assert sorted(map(tuple, pii.find(docs, learned, ["doc_id"], pii._digest).collect())) == want and "context" in str(want)


# == 10 substrings


def _removed(texts):
    w, seen = substrings.WINDOW, Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[i:i + w] for i in range(len(b) - w + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - w + 1):
            if seen[b[i:i + w]] > 1:
                gone[i] += 1
                gone[i + w] -= 1
        m = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~m]) if len(b) else b""
        out.append((len(b), int(m.sum()), int((np.diff(np.r_[0, m.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("rows", [8192, 4])
def test_substrings_equal_brute_force(spark, rows):
    a, b, c = words(1, 150), words(2, 150), words(3, 150)
    exact = words(4, 90)[:400]
    texts = [a, a, b + exact + c, c[:200] + exact + b[300:900], "x" * 401, "x" * 400, "ab" * 700, a[:399], a[100:700] + "ß" * 300, exact[:399], exact, None, "", "é" * 200 + exact, words(5, 3000), words(5, 3000)[5000:9000] + b]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], DOC)
    got = sorted(substrings.deduplicate(docs, rows=rows).collect())
    assert [tuple(r)[1:5] for r in got] == _removed(texts)
    assert [r.n_repeated_words for r in got] == _repeated_words(list(enumerate(texts)))


def _repeated_words(docs):
    n = substrings.WORDS
    split = [(i, re.findall(r"[^ \t\n\r\x0b\x0c]+", t or "")) for i, t in docs]
    held = {}
    for i, ws in split:
        for k in range(len(ws) - n + 1):
            held.setdefault(tuple(ws[k:k + n]), set()).add(i)
    return [len({p for k in range(len(ws) - n + 1) if len(held[tuple(ws[k:k + n])]) > 1 for p in range(k, k + n)}) for _, ws in split]


def test_passages_below_400_bytes_are_reported(spark):
    short, once = " ".join(f"a{k}" for k in range(51)), " ".join(f"b{k}" for k in range(50))
    assert len(short) < substrings.WINDOW
    texts = [(1, f"{words(1, 90)} {short} {words(2, 40)}"), (2, f"{short}\n{words(3, 70)}"), (3, f"{words(4, 70)} {once}"), (4, f"{once} {words(5, 70)}"),
             (5, "the " * 90), (6, f"{words(6, 80)} " * 2), (7, words(7, 60)), (7, words(7, 60)), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOC)
    got = sorted(substrings.deduplicate(docs).collect(), key=lambda r: r.doc_id)
    assert [r.n_repeated_words for r in got] == [51, 51, 0, 0, 0, 0, 0, 0, 0] == _repeated_words(texts)
    assert got[0].n_removed == 0 < got[5].n_removed


def test_the_query_equals_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    got = sorted(substrings.op10_suffix_dedup(spark, sf).collect())
    assert [tuple(r)[1:5] for r in got] == _removed([t for _, t in docs]) and [r.n_repeated_words for r in got] == _repeated_words(docs)


def test_substrings_on_odd_rows(spark, odd_docs, no_docs):
    got = substrings.deduplicate(odd_docs.withColumn("runs", F.lit(1)), keep_text=True).collect()
    want = _removed([r.text for r in odd_docs.collect()])
    assert Counter(tuple(r)[1:5] for r in got) == Counter(want) and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert substrings.deduplicate(no_docs).count() == 0


def test_long_texts_are_cut_where_positions_end(monkeypatch):
    text = words(8, 4000).encode()
    whole = substrings._anchor_table(0, [text], np.array([1]), np.array([2]), np.array([3])).to_pylist()
    monkeypatch.setattr(substrings, "_POSITION", 12)
    parts = [r for base, own, texts in substrings._cuts([0], [text]) for r in substrings._anchor_table(base, texts, np.array([1]), np.array([2]), np.array([3])).to_pylist()]
    cover = lambda rows: {p for r in rows for p in range(r["at"] - r["hi"], r["at"] - r["lo"] + 1)}
    assert cover(parts) == cover(whole) == set(range(len(text) - substrings.WINDOW + 1))

"""Learned and pairwise operators: held-out accuracy, brute force, edge cases; the pipeline stage by stage."""

import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrutable.llm import graph
from scrutable.llm import op01_toxicity as op1
from scrutable.llm import op05_language_id as op5
from scrutable.llm import op06_embedding_neardup as op6
from scrutable.llm import op07_minhash_neardup as op7
from scrutable.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


class Sets(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self.setdefault(self[x], self[x])
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_components(documents):
    sets, uf = {i: shingle_set(t) for i, t in documents if i is not None}, Sets()
    ids = sorted(sets)
    for a in ids:
        uf.find(a)
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                uf.link(a, b)
    return {i: (len(sets[i]), uf.find(i)) for i in ids}


@pytest.mark.parametrize("leaf, block", [(512, 256), (2, 4)])
def test_near_duplicates(docs, documents, no_docs, monkeypatch, leaf, block):
    monkeypatch.setattr(op7, "LEAF", leaf)
    monkeypatch.setattr(op7, "BLOCK", block)
    monkeypatch.setattr(op7, "MEMBERS", block)
    want = brute_components(documents)
    rows = op7.cluster(docs).collect()
    assert len(rows) == len(documents)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    if leaf == 512:
        assert op7.cluster(no_docs).count() == 0


def test_one_id_with_different_texts(spark, monkeypatch):
    """An id that repeats with other texts is one document in both groups, whichever way nodes are compared."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (9, b + " end"), (11, "quite another text that is near nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for leaf, block in ((512, 512), (2, 2)):
        monkeypatch.setattr(op7, "LEAF", leaf)
        monkeypatch.setattr(op7, "BLOCK", block)
        got = sorted((r.doc_id, r.component_id, r.kept) for r in op7.cluster(docs).collect())
        assert got == [(5, 5, True)] * 3 + [(7, 5, False), (9, 5, False), (11, 11, True)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.v: r.comp for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(65)} | {100: 100, 101: 100}


def vectors(spark, kind="float"):
    rng = np.random.RandomState(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(scale=0.12 * (i // 60 % 4), size=16)).tolist()) for i in range(600)]
    rows += [(700, None), (701, []), (702, [0.0] * 16), (703, [None] + [1.0] * 15), (704, [float("nan")] * 16), (705, [float("inf")] * 16), (706, rows[3][1]), (707, [x * 1000 for x in rows[3][1]]), (708, [1.0] * 8), (709, [2.0] * 8), (None, rows[3][1]), (710, rows[3][1]), (710, rows[3][1])]
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, rep string, line int"), rows


@pytest.mark.parametrize("kind, cell, block", [("float", 1000, 2000), ("double", 40, 30)])
def test_embeddings(spark, monkeypatch, kind, cell, block):
    monkeypatch.setattr(op6, "CELL", cell)
    monkeypatch.setattr(op6, "BLOCK", block)
    df, rows = vectors(spark, kind)
    good = [(i, np.array(v, np.float32 if kind == "float" else float).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    uf, n, total = Sets(), {}, 0
    for k, (i, x) in enumerate(good):
        for j, y in good[k + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                n[k], total = n.get(k, 0) + 1, total + 2
                uf.link(i, j)
    got = op6.link(df).collect()
    found = sum(r.n_links for r in got)
    assert len(got) == len(rows) and found <= total and found >= (total if cell == 1000 else 0.95 * total)
    if cell == 1000:
        for r in got:
            if r.vec_id is not None:
                assert r.component_id == uf.find(r.vec_id) and r.kept == (r.vec_id == r.component_id)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, False)]
    for r in got:
        if r.vec_id in (700, 701, 702, 703, 704, 705):
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert op6.link(df.limit(0)).count() == 0


def test_recall_on_many_vectors(spark):
    """Twelve thousand vectors, half of them close to the threshold of another: nearly all true links found, none false."""
    rng = np.random.RandomState(9)
    x = rng.normal(size=(6000, 32))
    near = x / np.linalg.norm(x, axis=1, keepdims=True) + rng.normal(size=x.shape) * (0.45 / np.sqrt(32)) * rng.uniform(0.2, 1.1, size=(6000, 1))
    x = np.concatenate([x, near]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[a : a + 1000] @ u.T >= 0.9).sum(axis=1) - 1 for a in range(0, len(u), 1000)])
    got = {r.vec_id: r.n_links for r in op6.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 5000 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_viterbi_restores_disguises(spark):
    texts = ["an idiot and a clown said that the moron is pathetic and worthless trash"] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = op1.count_trigrams(df).toPandas()
    d = op1.Decoder(op1.CharModel(counts["gram"].to_numpy(), counts["n"].to_numpy()))
    for raw, plain in (("1d10t", "idiot"), ("cl0wn", "clown"), ("M0R0N!!", "moron"), ("idiooooot", "idiot"), ("p@thet1c", "pathetic"), ("i d i o t", "idiot"), ("7r@sh", "trash"), ("worth1e$$", "worthless")):
        assert d.restore[raw] == plain
    assert [d.restore[x] for x in ("1234", "192.168.0.1", "...")] == ["1234", "192.168.0.1", "..."]


def test_only_suspects_are_touched(spark):
    import pyarrow as pa

    counts = op1.count_trigrams(spark.createDataFrame([(0, "the idiot is here")] * 9, "doc_id long, text string")).toPandas()
    d = op1.Decoder(op1.CharModel(counts["gram"].to_numpy(), counts["n"].to_numpy()))
    given = [None, "", "plain text, nothing odd: see 42!", "the 1d10t is h3re", "an i d i o t was é é", "wait... 3 4 5"]
    texts, changed = op1.restore(pa.array(given), d)
    assert texts[:3] == given[:3] and "idiot" in texts[3] and "idiot" in texts[4] and list(changed[:3]) == [0, 0, 0]


def test_every_disguise_reaches_the_decoder(spark):
    import pyarrow as pa

    counts = op1.count_trigrams(spark.createDataFrame([(0, "no he says that shit can kill a free ass on this page and the idiot wrote été")] * 50, "doc_id long, text string")).toPandas()
    d = op1.Decoder(op1.CharModel(counts["gram"].to_numpy(), counts["n"].to_numpy()))
    words = {"shi7": "shit", "ki11": "kill", "fr33": "free", "i.d.i.o.t": "idiot", "I-D-I-O-T!": "idiot", "i_d_i_0_t": "idiot", "(i*d*i*o*t)": "idiot", "fr€e": "free", "étééé": "été", "sh1t2": "shit", "1d10t": "idiot"}
    plain = ["no!", "page2", "shit!", "page", "1.2.3", "2024", "été", "no.", "on|"]
    given = [f"x {w} y" for w in [*words, *plain]] + ["a i\nd\ni\no\nt", None, "", "i", "a€"]
    texts, changed = op1.restore(pa.array(given), d)
    for (raw, want), text, n in zip(words.items(), texts, changed, strict=False):
        assert (text[2:-2].strip("()!"), n) == (want, 1), (raw, text)
    assert texts[len(words) : len(words) + len(plain)] == [f"x {w} y" for w in plain]
    assert all(op1.suspects(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])) for w in ("a$$", "a55", "ki11", "fr33", "shi7", "a€", "ééé", "É.é.é", "no!"))


def test_best_path_of_small_lattices_is_the_best_of_all(spark):
    counts = op1.count_trigrams(spark.createDataFrame([(t,) for t in ["idiot stupid letter hello book bottle"] * 9], "text string")).toPandas()
    d = op1.Decoder(op1.CharModel(counts["gram"].to_numpy(), counts["n"].to_numpy()))
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("idotbl013$!|@t") for _ in range(rng.randint(1, 7)))
        arcs = [d.arcs(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", text)]
        each = [("".join(x for x, _ in way), sum(c for _, c in way)) for way in itertools.product(*arcs)]
        score, word = d.path(text)
        best = max(d.model.word(x) + cost for x, cost in each)
        assert abs(score - best) < 1e-9 and max(d.model.word(x) + cost for x, cost in each if x == word) > best - 1e-9


def test_words_of_any_length_are_decoded_in_linear_time(spark):
    counts = op1.count_trigrams(spark.createDataFrame([("idiot stupid letter hello",)], "text string")).toPandas()
    d = op1.Decoder(op1.CharModel(counts["gram"].to_numpy(), counts["n"].to_numpy()))
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(400_000))
    begun = time.process_time()
    d.decode(word), d.decode("a" + "1122" * 100_000), d.decode("a." * 200_000)
    assert time.process_time() - begun < 60
    assert not d.restore and d.restore[word] and not d.restore


def test_both_ways_restore_alike(spark, docs):
    texts = ["an idiot and a clown said that the moron is pathetic and worthless trash; coffee letters good fuck"] * 50
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = [None, "", "the 1d10t has coffee and l3tters, good", "a clo wn i d  io t, cl00wn!!", "fuuck i.d.i.o.t (t r a s h) 7ra$h mor0n", "m o r o n\nm o r o n", "worth1e$$ idi0t2 \u20ac漢 letterrr"]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(given)], "doc_id long, text string, row int")
    grams = op1.count_trigrams(train)
    near = op1.restored(rows, op1.Trigrams(grams, 10**6)).collect()
    far = op1.restored(rows, op1.Trigrams(grams, 0)).collect()
    say = lambda rs: sorted((r.doc_id, r.text or "", r.row, r.n_restored) for r in rs)
    assert say(near) == say(far)
    got = {r.doc_id: r.text for r in near}
    assert "idiot has coffee and letters good" in got[2] and got[4].startswith("fuck idiot") and "trash" in got[4] and "moron" in got[4]


def test_scores_equal_brute_force(spark):
    """Weights and strengths by hand: distinct word beginnings and words, log odds, shrinkage, the largest and the fourth root."""
    import math
    import random

    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 40 if i % 3 else 60]) for _ in range(12)), int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = op1.fit(df, df.select("doc_id", "toxic"))

    def features(t):
        words = {w for w in re.findall(r"[a-z]+", t)}
        return {(k, w[:k]) for w in words for k in (4, 5, 6, 8) if len(w) > k} | {(0, w) for w in words if len(w) >= 3}

    learn = {r.doc_id for r in df.where("xxhash64(doc_id, 1) % 2 = 0").collect()}
    clean, toxic = (sum(y == v for i, _, y in rows if i in learn) for v in (0, 1))
    base, counts = toxic / (toxic + clean), {}
    for i, t, y in rows:
        if i in learn:
            for f in features(t):
                counts.setdefault(f, [0, 0])[y] += 1
    weigh = lambda c, x: (math.log((x + 4 * base) / (c + 4 * (1 - base))) - math.log(base / (1 - base))) * x / (x + 4)
    weights = {f: weigh(*n) for f, n in counts.items()}
    curve = model.classifier.curve
    for r in op1.score(df, model).join(df, "doc_id").collect():
        if r.n_restored == 0:
            w = [weights[f] for f in features(r.text) if weights.get(f, 0) > 0]
            x = curve[0] + curve[1] * max(w, default=0) + curve[2] * sum(v**4 for v in w) ** 0.25
            assert abs(r.score - 1 / (1 + math.exp(-x))) < 1e-9


def test_toxicity_edges(docs, documents, no_docs, spark):
    labels = spark.createDataFrame([(i, None if i % 7 == 0 else int(i % 3 == 0)) for i in range(70)] + [(None, 1)], "doc_id long, toxic int")
    model = op1.fit(docs, labels)
    rows = op1.score(docs, model).collect()
    assert len(rows) == len(documents) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    kept = op1.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows)
    nothing = op1.fit(no_docs, labels.limit(0))
    assert {r.score for r in op1.score(docs, nothing).collect()} == {0.0} and op1.score(no_docs, model).count() == 0


def test_language_edges(docs, documents, no_docs, spark):
    train = spark.createDataFrame([(i, "der die das und ist nicht" if i % 2 else "le la les et est pas", "de" if i % 2 else "fr") for i in range(40)] + [(99, "das", None)], "doc_id long, text string, lang string")
    filters = op5.fit(train)
    assert filters.langs == ["de", "fr"]
    got = {r.doc_id: r for r in op5.predict(spark.createDataFrame([(0, "nicht und die"), (1, "les et la"), (2, None), (3, "12 !?"), (4, "x"), (5, "DIE DAS " * 3000)], "doc_id long, text string"), filters).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3, 5)] == ["de", "fr", "und", "und", "de"] and got[2].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert op5.predict(docs, filters).count() == len(documents) and op5.predict(no_docs, filters).count() == 0
    empty = op5.fit(train.limit(0))
    assert {r.lang_pred for r in op5.predict(docs, empty).collect()} == {"und"}


def test_many_languages_need_several_words(spark):
    alphabet = [chr(0x4E00 + 10 * i) for i in range(70)]
    train = spark.createDataFrame([(i, (c + chr(ord(c) + 1)) * 4, f"l{i:02d}") for i, c in enumerate(alphabet)], "doc_id long, text string, lang string")
    filters = op5.fit(train)
    assert filters.table.shape[0] == 2
    got = op5.predict(train, filters).join(train, "doc_id").where("lang <> lang_pred").count()
    assert got == 0


def test_filters_too_large_to_broadcast_decide_alike(spark, docs, no_docs):
    rng = random.Random(8)
    words = {f"l{i:02d}": ["".join(rng.choice("abcdefghijklmnopéß漢字") for _ in range(rng.randint(1, 6))) for _ in range(30)] for i in range(70)}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(sorted(words) * 6)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    near, far = op5.fit(train), op5.fit(train, broadcast_slots=0)
    assert isinstance(far, op5.StoredFilters) and near.false.tolist() == far.false.tolist()
    asked = docs.select("doc_id", "text").union(train.select("doc_id", "text")).union(spark.createDataFrame([(None, None), (3, "12 !"), (3, "")], "doc_id long, text string"))
    say = lambda filters: sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred, r.score) for r in op5.predict(asked, filters).collect())
    assert say(near) == say(far)
    assert op5.predict(no_docs, far).count() == 0


def test_languages_equal_exact_sets(spark):
    """The filters against sets of n-grams that are exact: same language wherever the exact rates are not all but equal."""
    import random
    from collections import Counter

    rng, langs = random.Random(8), ("aa", "bb", "cc")
    letters = {"aa": "abcdeéf", "bb": "bcdefgh", "cc": "acegiß漢"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    train = [(i, text(lang, 30), lang) for i, lang in enumerate(langs * 20)]

    def grams(t):
        padded = [f" {w} " for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
        return [(n, w[k : k + n]) for n in (2, 3, 4) for w in padded for k in range(len(w) - n + 1)]

    counts = {lang: Counter(g for _, t, x in train if x == lang for g in grams(t)) for lang in langs}
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    top = {g: max(c[g] / total[lang] for lang, c in counts.items()) for c in counts.values() for g in c}
    sets = {lang: {g for g in c if c[g] / total[lang] >= 0.5 * top[g]} for lang, c in counts.items()}
    asked = [(i, text(rng.choice(langs), rng.randint(1, 12))) for i in range(200)]
    filters = op5.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in op5.predict(spark.createDataFrame(asked, "doc_id long, text string"), filters).collect()}
    for i, t in asked:
        rates = sorted(((sum(g in sets[lang] for g in grams(t)) / len(grams(t)), lang) for lang in langs), reverse=True)
        if rates[0][0] - rates[1][0] > 0.02:
            assert got[i].lang_pred == rates[0][1] and abs(got[i].score - rates[0][0]) < 0.05


@here
def test_held_out_accuracy(spark):
    lang = QUERIES["op5_language_id"](spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    tox = QUERIES["op1_toxicity"](spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    assert tox.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.95


@here
def test_pipeline_stages(spark, tmp_path):
    folder = FOLDER.replace("0.1", "0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        seen[name] = docs.toPandas()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    sizes = [len(seen[n]) for n in names]
    assert sizes[0] >= sizes[2] >= sizes[3] == sizes[4] and sizes[0] == sizes[1]
    before = seen["line dedup"]
    want = brute_components(list(zip(before["doc_id"], before["text"], strict=True)))
    assert set(seen["MinHash near-dedup"]["doc_id"]) == {i for i, (_, c) in want.items() if i == c}
    items = [shingle_set(t) for t in spark.read.parquet(f"{folder}/benchmark.parquet").toPandas()["text"]]
    hit = {r.doc_id for r in seen["MinHash near-dedup"].itertuples() if any(4 * len(shingle_set(r.text) & s) >= 3 * len(s) for s in items if s)}
    assert set(seen["benchmark decontamination"]["doc_id"]) == set(seen["MinHash near-dedup"]["doc_id"]) - hit
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()) == sorted(seen[names[-1]]["ids_sha256"])


def test_pipeline_keeps_rows_without_id(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    item = " ".join(f"item{i}" for i in range(12))
    rows = [(2, a), (1, a + " end"), (None, a), (None, b), (None, b), (5, c), (5, c), (5, d), (None, None), (None, ""), (None, f"x {item} y"), (6, f"z {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    one = stages["MinHash near-dedup"](spark, docs, str(tmp_path))
    assert one.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=key) == sorted([(1, a + " end"), (None, b), (5, c), (5, d), (None, None), (None, ""), (None, f"x {item} y"), (6, f"z {item}")], key=key)
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=key) == sorted(rows[:-2], key=key)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in every column, rows and ids that repeat, clashing names, empty tables: defined results, stage by stage."""
    clean, near, toxic = (" ".join(f"{x}{chr(97 + i)}" for i in range(26)) for x in ("clean", "near", "idiot"))
    item, line = " ".join(f"item{chr(97 + i)}" for i in range(12)), "a line that many documents share"
    rows = [(1, f"{clean}\n{line}"), (1, f"{clean}\n{line}"), (2, f"{near}\n{line}"), (2, near), (3, None), (3, ""), (None, None), (None, f"{line}\nx"), (4, f"{item}\n{line}"), (None, item), (5, line)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, rest string, lines string, `drop` int, hash int, _hit int, n_lines int, component_id int"
    docs = spark.createDataFrame([(i, t, None if k % 2 else "en", None, k, k, "r", None, 1, 2, 3, 4, 5) for k, (i, t) in enumerate(rows)], schema)
    spark.createDataFrame([(0, item), (None, clean), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0), (2, None), (None, 1), (7, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "BPE encoding and decoding" or out.columns == docs.columns
        got[name] = out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    texts = {k: t for k, (_, t) in enumerate(rows)}
    assert len(got["toxicity"]) == len(rows) == len(got["BPE encoding and decoding"])
    assert {r.row: r.text for r in got["line dedup"]} == texts | {2: near, 8: item, 10: ""} and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got["line dedup"])
    kept = {r.row for r in got["MinHash near-dedup"]}
    assert len(kept & {0, 1}) == 1 and len(kept & {2, 3}) == 1 and {4, 5, 6} <= kept
    assert {r.row for r in got["benchmark decontamination"]} == set(texts) - {8, 9}
    assert stages["toxicity"](spark, docs.drop("n_chars"), str(tmp_path)).columns == docs.drop("n_chars").columns


@here
def test_pipeline_finds_the_near_copies_of_its_input(spark):
    """Near-dedup finds every link that brute force finds in what line dedup left, on ten times the smallest table."""
    folder = FOLDER.replace("0.1", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, holders, uf = {i: shingle_set(t) for i, t in rows}, {}, Sets()
    for i, x in sets.items():
        uf.find(i)
        for g in x:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in holders.values() if len(ids) > 1 for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            uf.link(a, b)
    got = {r.doc_id: r.component_id for r in op7.cluster(docs).collect()}
    lost = [i for i in sets if got[i] != uf.find(i)]
    assert not lost

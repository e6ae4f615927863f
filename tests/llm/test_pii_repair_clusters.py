"""Personal data, conversation repair and centroid clustering against brute force, and their odd inputs."""

import hashlib
import heapq
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scrutable.llm import op11_pii as op11
from scrutable.llm import op12_conversation_repair as op12
from scrutable.llm import op13_centroid_clustering as op13
from scrutable.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    d = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return max(map(int, value.split("."))) <= 255
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group())]


def spans(found, kinds=op11.KINDS):
    return [(r.doc_id, [s for k in kinds for s in r[k]]) for r in found.select("doc_id", *[op11.listed(k).alias(k) for k in kinds]).collect()]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["op11_pii", "op12_conversation_repair", "op13_centroid_clustering"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_patterns_equal_the_plain_ones(spark):
    rng = random.Random(3)
    bits = ["a", "é", ".", "@", "-", "_", "%", "+", " ", "\n", "0", "1", "25", "255", "256", "(", ")", "漢", "x@y.z", "4539578763621486", "1.2.3.4", "🙂", "+12 345 6789", "4111-1111 1111-1111", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(spans(op11.base_spans(rows))) == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_patterns_stay_linear_and_shallow(spark):
    long = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "1." * 150_000, "a@" + "b." * 100_000 + "c", "+1" + " " * 300_000, "x@y.z " * 20_000]
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    want = {3: [f"ip:{8 * i}:{8 * i + 7}" for i in range(37_500)], 4: [f"email:0:{len(long[4])}"], 6: [f"email:{6 * i}:{6 * i + 5}" for i in range(20_000)]}
    assert dict(spans(op11.base_spans(rows))) == {i: want.get(i, []) for i in range(len(long))}


def test_disclosing_terms_are_masked_wherever_they_are(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(30)) for i in range(400)]
    rows += [(1000 + i, f"{prose(6)} Kowalczyk hat {'ivo@mail.example'} {prose(6)}") for i in range(6)]
    rows += [(2000, f"Kowalczyk {prose(5)}"), (2001, "nothing here"), (2002, None), (None, "Kowalczyk, a@b.c"), (2003, "x" * 50_000), (1000, rows[400][1])]
    docs = spark.createDataFrame([(i, t, "k", [1]) for i, t in rows], "doc_id long, text string, key string, terms array<int>").repartition(5)
    found = sorted(spans(op11.find(docs), ("term",)), key=str)
    text = dict(rows)
    assert len(found) == len(rows)
    for i, terms in found:
        at = [text[i].index("Kowalczyk")] if "Kowalczyk" in (text[i] or "") else []
        assert [f"term:{p}:{p + 9}" for p in at] == [t for t in terms if t in [f"term:{p}:{p + 9}" for p in at]]
    assert dict(found)[2001] == [] and dict(found)[2002] == []
    clean = {r.doc_id: r.text for r in op11.sanitise(docs, remove=1.1).where("doc_id >= 2000 OR doc_id IS NULL").collect()}
    assert clean[2000].startswith("[name] ") and clean[2001] == "nothing here" and clean[2002] == "" and clean[None] == "[name], [email]"
    assert {r.doc_id: r.text for r in op11.sanitise(docs, remove=0.9).where("doc_id = 2000").collect()}[2000].startswith(" ")


def test_shuffled_terms_equal_broadcast_ones(spark):
    rows = [(i, f"w{'abc'[i % 3]}x Nowak u{i}@mail.example alpha beta") for i in range(40)] + [(100 + i, f"Nowak {'abcdefghij'[i % 10] * 4} mail x@y.example gamma {'klm'[i % 3] * 5}") for i in range(9)] + [(200 + i, "delta epsilon") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = (*op11.KINDS, "term")
    one, two = (sorted(spans(op11.find(docs, most_bytes=m), kinds)) for m in (32 << 20, 0))
    assert one == two and any(s.startswith("term") for _, x in one for s in x)


def test_pii_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op11.find(empty).count() == 0 and op11.sanitise(empty).count() == 0


# --- conversations --------------------------------------------------------------------------------------

def brute_repair(rows):
    """Cheapest edits and then least initials, by best-first search over (rows used, roles so far)."""
    fault, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] for r, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out), fault
        if (i, audit) in done or len(audit) > 2 * len(rows) + 4:
            continue
        done.add((i, audit))
        fits = lambda r: re.fullmatch("s?(ua)*u?", initials + r[:1]) and r[:1] in "sua" and r[:1]
        for role in ("user", "assistant"):
            if fits(role):
                heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if fault[i] not in ("blank", "duplicate"):
                more = 3 if fault[i] else 0
                if fits(rows[i][0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, rows[i])))
                for role in ("user", "assistant"):
                    if fits(role):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, (role, rows[i][1]))))


def test_repairs_equal_search(spark):
    rng, given = random.Random(4), []
    for conv in range(150):
        for turn in range(rng.randint(0, 5)):
            given.append((conv, turn + rng.randint(0, 1) * 10, rng.choice(["user", "assistant", "system", "tool", "usher", ""]), rng.choice(["", " \n", "One.", "Two", "Why?\n", "No ", "é!"])))
    rows = spark.createDataFrame([(*r, "sig", 1) for r in given], "conv_id long, turn long, role string, text string, sig string, part int").repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(151)], "conv_id long")
    got = {r.conv_id: r for r in op12.summarise(rows, ids).collect()}
    assert sorted(got) == list(range(151))
    repaired = {}
    for r in op12.repair(rows).orderBy("conv_id", "position").collect():
        repaired.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv in range(151):
        mine = sorted((r for r in given if r[0] == conv), key=lambda r: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        cost, audit, text, fault = brute_repair([r[2:] for r in mine])
        turns, roles = {r[1] for r in mine}, [r[2][:1] for r in mine]
        g = got[conv]
        assert (g.cost, g.audit, g.repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), (conv, mine)
        assert "\n".join(repaired.get(conv, [])) == text
        assert (g.blank, g.duplicate, g.truncated) == tuple(fault.count(x) for x in ("blank", "duplicate", "truncated"))
        assert g.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert g.illegal == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))


def test_layers_of_shared_prefixes_are_computed_once(monkeypatch):
    calls = []
    real = op12.after
    monkeypatch.setattr(op12, "after", lambda layer, s: calls.append(s) or real(layer, s))
    sigs = sorted({"".join(p) for n in range(5) for p in itertools.product("aei", repeat=n)})
    assert [s for s, *_ in op12.solve(sigs)] == sigs
    assert len(calls) == len(sigs) - 1  # one for each node of the trie but the root


def test_one_long_conversation_and_odd_rows(spark):
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(6000)] + [(7, 3, "assistant", "Line 3.")] * 50
    rows += [(None, None, None, None), (None, 2, "user", "Hi."), (None, None, "assistant", "Yes!"), (8, None, "user", "a"), (8, None, "user", "a"), (9, 5, "user", "Q?"), (9, 1 << 40, "assistant", "A.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)
    got = {r.conv_id: r for r in op12.summarise(df).collect()}
    want = hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[:6000]).encode()).hexdigest()
    assert (got[7].duplicate, got[7].cost, got[7].illegal, got[7].repaired_sha256) == (50, 200, 50, want)
    assert got[7].audit == "KKKK" + "D" * 50 + "K" * 5996
    assert (got[None].blank, got[None].gaps, got[8].duplicate, got[8].gaps, got[9].gaps) == (1, 0, 1, 0, (1 << 40) - 6)
    assert op12.summarise(df.limit(0)).count() == 0 and op12.repair(df.limit(0)).count() == 0
    assert op12.summarise(df.limit(0), df.select("conv_id")).where("cost = 0 AND audit = '' AND gaps = 0").count() == 4


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", f"A. B! {c}") for c in range(40) for t in (0, 1, None)]
    got = op12.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text)
        want += [row] * (0 if hit == 0 else 2 if hit == 3 else 1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


# --- clusters ---------------------------------------------------------------------------------------------

def test_annulus_equals_all_distances():
    rng = np.random.RandomState(1)
    for _ in range(200):
        v, c = rng.randint(-3, 4, (60, 2)), rng.randint(-3, 4, (rng.randint(1, 9), 2))
        number, far = op13.nearest(v.astype(np.int64), c.astype(np.int64))
        every = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert (far == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def test_annulus_leaves_centroids_of_other_norms_aside(monkeypatch):
    compared = []
    real = op13.squares
    monkeypatch.setattr(op13, "squares", lambda v, c: compared.append(len(v)) or real(v, c))
    centroids = np.array([[100 * i, 0] for i in range(1, 41)], np.int64)
    op13.nearest(np.array([[100 * i + 3, 1] for i in range(1, 41)], np.int64), centroids)
    assert sum(compared) <= 3 * 40


def brute_clusters(vectors, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        to = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, to, strict=True) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, n, d, ",".join(map(str, centroids[n]))) for (i, _), (d, n) in zip(kept, assign(), strict=True)]


def test_clusters_equal_brute_force(spark):
    rng = random.Random(6)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(300)]
    vectors += [(300, None), (301, []), (302, [1.0, None, 0.0]), (303, [1.0, float("nan"), 0.0]), (304, [float("inf"), 0.0, 0.0]), (305, [1.0, 2.0]), (None, [0.5, 0.5, 0.5]), (7, vectors[7][1]), (7, [9.0, -9.0, 0.0]), (306, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, v int").repartition(7)
    got = op13.cluster(df, k=6, rounds=3, dims=3).collect()
    want = brute_clusters(vectors, 6, 3)
    assert sorted(((r.vec_id, r.cluster, r.distance, ",".join(map(str, r.centroid))) for r in got), key=str) == sorted(want, key=str)
    total = sum(w[2] for w in want)
    assert all(r.inertia == total and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest() for r in got)
    assert op13.cluster(df.limit(0), dims=3).count() == 0
    few = op13.cluster(df.where("vec_id < 3"), k=40, dims=3).collect()
    assert len(few) == 3 and {r.distance for r in few} == {0}
    same = op13.cluster(df.where("vec_id = 5").crossJoin(spark.range(9)), k=4, dims=3).collect()
    assert {(r.cluster, r.distance) for r in same} == {(0, 0)} and len(same) == 9
    with pytest.raises(Exception, match="beyond"):
        op13.cluster(spark.createDataFrame([(1, [1e9, 0.0, 0.0])], "vec_id long, embedding array<double>"), dims=3).count()


def test_native_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a@b.c word")], "doc_id long, text string")
    plan = op11.find(docs)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and F is not None

"""The operators on Spark: against SQL, brute force and round trips, on small tables
with nulls, empty and long texts, repeated rows and clashing column names."""

import hashlib
import itertools
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from replenix.llm import attribution, formatting, mixing, neardup, packing, passages, quality, registry, rules, tokens, toxicity, vectors
from replenix.llm.shared import components, table

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, cls int, rid int"
BASE = " ".join(f"w{i}" for i in range(120))
ODD = [None, "", " \n", "one", "one two three four five six", BASE, BASE, BASE.replace("w60 ", "x "), "pre " + BASE[:200], "é " * 30, "a b c d e " * 3000]


def odd_docs(spark):
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", 1, 0.0, "z", 1, 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[5], (None, BASE, "en", "s1", 1, 0.0, "z", 1, 1)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    cols = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in cols]
    assert sorted(got.columns) == cols
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, (tuple(r[i] for i in order) for r in want.fetchall())))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (30, 20), (20, 10), (3, 30)] + [(100, i) for i in range(101, 180)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 20: 1, 30: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 180)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_brute_force(spark, nothing):
    rng = np.random.default_rng(1)
    docs = []
    for f in range(12):
        words = [f"f{f}w{i}" for i in range(rng.integers(5, 90))]
        for _ in range(12):
            w = list(words)
            for at in rng.integers(0, len(w), rng.integers(0, 4)):
                w[at] = f"x{rng.integers(0, 5)}"
            docs.append(" ".join(w))
    texts = ODD + docs
    sets = []
    for t in texts:
        w = re.findall(WORD, (t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            ra, rb = sorted((root[a], root[b]))
            root = [ra if r == rb else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    odd = neardup.near_duplicates(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) + 2 and {r.component_id for r in odd if r.doc_id in (5, 6, None)} == {5}
    assert neardup.near_duplicates(nothing).count() == 0


def test_large_group_in_blocks(spark):
    base = [f"w{i}" for i in range(120)]  # any two: 112 of 122 shingles
    rows = [(i, " ".join(base[:20] + [f"v{i}"] + base[20:])) for i in range(1300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
    assert {r.component_id for r in got.collect()} == {0}


def test_passages(spark, nothing):
    p = " ".join(f"p{i}" for i in range(70))
    q = p.replace("p30 ", "zz ").replace(" p50", "")
    rows = [(1, f"alpha beta gamma\n{p} tail words here"), (2, f"other start {p}"), (3, f"Third {q.upper()} end"), (4, "no passage at all"), (None, p), (7, None), (8, ""), (9, "is on he " * 100), (10, "x is on he " + "is on he " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("src", F.lit(1)).withColumn("n_chars", F.length("text"))
    got = {(r.doc_id, r.src_doc_id): r for r in passages.passages(df).collect()}
    assert set(got) == {(2, 1), (3, 1), (10, 9)}
    assert rows[1][1][got[2, 1].start:got[2, 1].start + got[2, 1].length] == p and got[2, 1].similarity == 1.0
    assert got[3, 1].n_words == 69 and got[3, 1].matched == 68
    left = {r.doc_id: r for r in passages.remove_passages(df, passages.passages(df)).collect()}
    assert left[2].text == "other start " and left[3].text == "Third \n end" and left[1].text == rows[0][1] and left[7].text is None
    assert left[2].n_chars == len(left[2].text) and left[None].text == p and left[8].text == ""
    assert passages.passages(nothing).count() == 0


def test_long_exact_runs_are_found(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    spans = {}
    for r in passages.passages(table(spark, SF, "documents")).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    seen, missed, total = {}, 0, 0
    for d in sorted(docs):
        at = [(m.start(), m.end()) for m in re.finditer(WORD, docs[d])]
        low = [docs[d][a:b].lower() for a, b in at]
        new = []
        for i in range(len(at) - 59):
            k = tuple(low[i:i + 60])
            if k in seen:
                total += 1
                a, b = at[i + 5][0], at[i + 54][1]  # ends may be cut by a few words
                missed += not any(s <= a and b <= e for s, e in spans.get(d, ()))
            else:
                new.append(k)
        seen.update(dict.fromkeys(new, d))
    assert total > 100 and missed <= 0.02 * total


def test_vectors_edge_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows, vs = [], []
    for i in range(400):
        v = base[i % 40] + rng.standard_normal(16) * 0.15
        vs.append(v)
    vs += [vs[0], vs[0] * 3]
    odd = [None, [0.0] * 16, [], [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0], [2.0]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vs)] + [(1000 + i, v) for i, v in enumerate(odd)]
    u = np.array(vs) / np.linalg.norm(vs, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(len(vs)))
    for a, b in zip(*np.nonzero(near), strict=True):
        ra, rb = sorted((root[a], root[b]))
        root = [ra if r == rb else r for r in root]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("raw", F.lit(1))
    got = {r.vec_id: r for r in vectors.near_vectors(df, block=64, window=16).collect()}
    assert [got[i].n_links for i in range(len(vs))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(vs))] == root
    assert [(got[1000 + i].n_links, got[1000 + i].component_id) for i in range(8)] == [(0, 1000 + i) for i in range(6)] + [(1, 1006), (1, 1006)]
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.pass_count(10 ** 9, 1024, 0.95, 1e-4) > vectors.pass_count(10 ** 6, 1024, 0.95, 1e-4)


def test_chat_round_trip_and_budget(spark):
    rows = [(1, 0, "system", "sys [INST] \\ <s>"), (1, 1, "user", "a b c"), (1, 2, "assistant", "</s>[INST:x]\\n <|im_end|> [\\ \\"), (1, 3, "u\n]s:er [n", "q " * 40),
            (1, 4, "assistant", "z " * 30), (1, 5, "user", None), (1, 6, None, "k"), (1, 7, "assistant", "m n o p"), (2, 0, "assistant", ""), (None, 0, "user", "x"),
            (3, None, "user", "A"), (3, None, "user", "A"), (3, 1, "assistant", "B")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("windows", F.lit(1))
    made = formatting.windows(df, budget=40, history=10)
    back = {r.conv_id: r for r in formatting.read_back(made).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [tuple(t) for t in back[conv].turns] == own
        assert back[conv].loss == "".join(t for r, t in own if r == "assistant")
    for w in back[1].windows:
        assert w.n_tokens <= 40 or (w.first_turn == 3 and w.n_repeated == 1)  # turn 3 and the system turn are over the budget
        assert w.window == 0 or w.formatted.startswith("<s>[INST:system]")
    assert "PythonUDF" not in made._jdf.queryExecution().toString() and "Arrow" not in made._jdf.queryExecution().toString()
    d = {r.conv_id: r for r in formatting.digest(df).collect()}
    own = "".join(f"{r}\n</s>[INST] ok [/INST]\n" for r in ("user", "assistant"))
    assert d[-1].turns_sha256 == hashlib.sha256(own.encode()).hexdigest() and d[-1].loss_chars == 21 and d[-1].n_turns == 2
    assert formatting.windows(df.limit(0)).count() == 0


def plain_windows(turns, budget, history):
    """(first turn, repeated turns, tokens) of each window, turn by turn."""
    n = [len(re.findall(formatting.TOKEN, t)) for _, t in turns]
    sys = int(turns[0][0] == "system")
    out, first, shown = [], 0, []
    for i in range(len(turns) + 1):
        if i == len(turns) or (i > first and sum(n[k] for k in shown) + n[i] > budget):
            out.append((first, len(shown) - (i - first), sum(n[k] for k in shown)))
            if i == len(turns):
                return out
            first, shown = i, list(range(min(sys, i)))
            room = min(history, budget - sum(n[k] for k in shown) - n[i])
            back = []
            for k in range(i - 1, sys - 1, -1):
                if sum(n[j] for j in back) + n[k] > room:
                    break
                back.insert(0, k)
            shown += back
        shown.append(i)


def test_chat_windows_brute_force(spark):
    import random
    rng = random.Random(8)
    convs = [[("system", "s " * 5), ("user", "u " * 30), ("user", "v " * 10), ("assistant", "a " * 35)]]
    for _ in range(60):
        convs.append([(("system" if rng.random() < 0.5 else "user") if i == 0 else rng.choice(["user", "assistant"]), "w " * rng.choice([0, 1, 3, 8, 20, 39, 60]))
                      for i in range(rng.randint(1, 12))])
    df = spark.createDataFrame([(c, i, r, t) for c, turns in enumerate(convs) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for budget, history in ((40, 10), (25, 100), (60, 0)):
        got = {r.conv_id: r.windows for r in formatting.windows(df, budget=budget, history=history).collect()}
        for c, turns in enumerate(convs):
            assert [(w.first_turn, w.n_repeated, w.n_tokens) for w in got[c]] == plain_windows(turns, budget, history), (c, budget, history)
            n = [len(re.findall(formatting.TOKEN, t)) for _, t in turns]
            for w in got[c]:  # over the budget only with its new turn and the system turn alone
                alone = n[w.first_turn] + (n[0] if turns[0][0] == "system" and w.first_turn else 0)
                assert w.n_tokens <= budget or (w.n_tokens == alone and alone > budget)


def test_mix(spark, nothing):
    docs = table(spark, SF, "documents").select("doc_id", F.when(F.col("source") != "src3", F.col("source")).alias("source"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    got = mixing.mix(docs, size="n", group_rows=16, fan_in=2).collect()
    again = mixing.mix(docs.repartition(7), size="n", group_rows=16, fan_in=2).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == docs.count()
    total, longest = sum(r.size for r in got), max(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill([by[s][0].source_size for s in order], [1 + i % 3 for i in range(len(order))], total, 3)
    for s, t in zip(order, want, strict=True):
        assert by[s][0].target == pytest.approx(t) and by[s][0].source_size == sum(r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= longest / 2 + 1
    odd = mixing.mix(odd_docs(spark), size=F.regexp_count("text", F.lit(WORD))).collect()
    assert len(odd) == len(ODD) + 2 and all(r.taken == 0 for r in odd if r.size == 0)
    assert mixing.mix(nothing, size=F.lit(1)).count() == 0


def test_packing_reads_back(spark, nothing):
    enc = tokens.encoder(tokens.vocabulary())
    import pyarrow as pa
    got = packing.pack(odd_docs(spark), keep_ids=True, size=64, block_tokens=500).collect()
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, t in enumerate(ODD):
        ids = enc.encode(pa.array([t], pa.string()))[0].tolist() + [1]
        own = sorted(docs[i, len(ids)], key=lambda r: r.start)
        back = sorted({(r.start, tuple(r.ids)) for r in own})
        if i != 5:
            assert list(itertools.chain(*[x for _, x in back])) == ids and sum(r.length for r in own) == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows[0].sequence_length and (at == 64 or at & (at - 1) == 0)
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_counts_sum_to_the_document(spark, nothing, rule):
    import pyarrow as pa
    enc = tokens.encoder(tokens.vocabulary())
    got = {}
    for r in attribution.count(odd_docs(spark), rule=rule).where("doc_id is not null and doc_id != 5").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(ODD):
        if i != 5:
            own = sorted(got[i], key=lambda r: r.section)
            assert sum(r.n_tokens for r in own) == pytest.approx(len(enc.encode(pa.array([t], pa.string()))[0]))
            assert sum(r.length for r in own) == len(t or "") and [r.section for r in own] == list(range(len(own)))
    fields = attribution.count(odd_docs(spark), fields=["lang", "text", "source"], rule=rule).where("doc_id = 3").orderBy("section").collect()
    assert [(r.field, r.start, r.length) for r in fields] == [("lang", 0, 3), ("text", 3, 4), ("source", 7, 2)]
    assert attribution.count(nothing, rule=rule).count() == 0


def test_rules_on_odd_rows(spark, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.apply(odd_docs(spark), labels).collect()}
    assert got[0].base_failed and not got[0].kept and got[5].kept and not got[10].kept
    assert rules.apply(nothing, labels).count() == 0 and rules.apply(odd_docs(spark), labels.limit(0)).count() == len(ODD) + 2
    many = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30)) + (" ###" * 20 if i % 2 else "")) for i in range(4000)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    good = many.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"))
    out = rules.apply(many, good)
    assert {(r.bad, r.kept) for r in out.select((F.col("doc_id") % 2 == 1).alias("bad"), "kept").distinct().collect()} == {(True, False), (False, True)}


def test_classifiers(spark, nothing):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    for made, label, least in ((quality.digest(docs, labels), "quality", 0.97), (toxicity.digest(docs, labels), "toxic", 0.93)):
        rows = made.join(labels, "doc_id").where("held_out").select("predicted", label, "score").collect()
        assert np.mean([r[0] == r[1] for r in rows]) >= least and all(0 <= r.score <= 1 for r in rows)
    few = spark.createDataFrame([(5, 1, 1), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(odd_docs(spark), few)
        assert module.score(odd_docs(spark), model, ["doc_id", "size"]).count() == len(ODD) + 2
        assert module.score(odd_docs(spark), model).columns.count("score") == 1
        assert module.score(nothing, model).count() == 0 and module.fit(nothing, few) is None
        assert module.score(odd_docs(spark), None).where("score between 0 and 1").count() == len(ODD) + 2
    scored = toxicity.score(odd_docs(spark), toxicity.fit(odd_docs(spark), few), ["doc_id"])
    assert scored.where("doc_id in (0, 1)").select("score").distinct().count() == 1


def test_passages_that_no_first_document_covers(spark):
    odd = lambda k, n=60: " ".join(f"o{k}x{i}" for i in range(n))
    words = lambda k, i, j: " ".join(f"s{k}w{w}" for w in range(i, j))
    pieces = [(0, 26), (14, 44), (30, 54)]  # each run of words is in one of them, and none is a passage
    some = lambda k: [(k + n, f"{odd(k + n)} {words(1, *p)} {odd(k + n, 40)}") for n, p in enumerate(pieces)]
    rows = some(0) + [(10, f"{odd(10)} {words(1, 0, 54)} end")] + some(20) + [(30, f"{words(1, 0, 54)} {odd(30)}")] + some(40)
    # earlier occurrences of the passage's words in the source
    rows += [(50, " ".join(f"{words(5, *p)} {odd(60 + n)}" for n, p in enumerate(pieces[::-1])) + f" {words(5, 0, 54)}"), (51, f"{odd(51)} {words(5, 0, 54)}")]
    got = {(r.doc_id, r.src_doc_id): r for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(30, 10), (51, 50)}
    assert got[30, 10].n_words == 54 and got[51, 50].n_words == 54
    # by a text id as well
    named = spark.createDataFrame([(f"d{k:02d}", t) for k, t in rows], "doc_id string, text string")
    assert {(r.doc_id, r.src_doc_id) for r in passages.passages(named).collect()} == {("d30", "d10"), ("d51", "d50")}


def test_links_over_batches_and_ranges(spark):
    rows = [(i % 4 - 1, 0, i % 50, i) for i in range(2000)]
    table_ = spark.createDataFrame(rows, "seed long, ctx long, doc_id long, place long")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            got = passages.anchor_table(table_).select("doc_id", "src").distinct().collect()
            held = {}
            for seed, _, doc, _ in rows:
                held.setdefault(seed, set()).add(doc)
            steps = {(b, a) for d in held.values() for a, b in itertools.pairwise(sorted(d))}
            assert steps <= {tuple(r) for r in got}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def edited(rng, w, share):
    """``w`` with a share of the words replaced, dropped or doubled by a new one."""
    out, at = [], set(rng.choice(len(w), round(share * len(w)), replace=False).tolist())
    for i, x in enumerate(w):
        kind = rng.integers(0, 3) if i in at else 3
        out += {0: [f"e{rng.integers(1 << 40)}"], 1: [], 2: [x, f"e{rng.integers(1 << 40)}"], 3: [x]}[int(kind)]
    return out


def test_passages_with_edits(spark):
    rng = np.random.default_rng(11)
    new = lambda n: [f"n{x}" for x in rng.integers(0, 1 << 40, n)]
    rows = []

    def pair(p, q):
        rows.extend([(len(rows) + k, " ".join([*new(40), *x, *new(40)])) for k, x in enumerate((p, q))])
        return len(rows) - 1

    p = new(56)
    eighth = pair(p, [f"z{i}" if i % 8 == 7 else x for i, x in enumerate(p)])  # similarity 0.875, runs of seven words
    p = new(50)
    two = pair(p, [f"z{i}" if i in (16, 33) else x for i, x in enumerate(p)])
    many = {share: [] for share in (0.05, 0.1, 0.2)}
    for share, ids in many.items():
        for _ in range(200):
            p = new(60)
            ids.append(pair(p, edited(rng, p, share)))
    got = {(r.doc_id, r.src_doc_id) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {share: np.mean([(i, i - 1) in got for i in ids]) for share, ids in many.items()}
    print("recall of edited passages:", recall)
    assert {(eighth, eighth - 1), (two, two - 1)} <= got
    assert recall[0.05] >= 0.98 and recall[0.1] >= 0.95


def test_vectors_in_a_crowded_cone(spark):
    rng = np.random.default_rng(21)
    middle = rng.standard_normal(64)
    middle /= np.linalg.norm(middle)

    def near(v, cosine):
        r = rng.standard_normal(64)
        r -= r @ v * v
        return cosine * v + np.sqrt(1 - cosine ** 2) * r / np.linalg.norm(r)

    crowd = [near(middle, 0.949) for _ in range(2400)]  # any two at about 0.90
    vs = crowd + [near(v, 0.952) for v in crowd[:300]] + list(rng.standard_normal((600, 64)))
    u = np.array(vs) / np.linalg.norm(vs, axis=1)[:, None]
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vectors.near_vectors(df, block=64, window=16).collect()}
    assert [got[i].n_links for i in range(len(vs))] == links.sum(1).tolist()


def test_shared_bits():
    a = np.array([0, 5, 1 << 47, 5])
    assert vectors.shared_bits(a, np.array([0, 4, 0, 5])).tolist() == [48, 47, 0, 48]


def test_toxicity_learns_from_whole_texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 2500)) + (" badword" if i % 2 else " goodword"), "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert min(r.score for r in got if r.doc_id % 2) > max(r.score for r in got if r.doc_id % 2 == 0)


def test_cutoffs_come_from_all_labels(spark):
    rows = [(i, f"plain text {i % 7}" + (" badword" if i % 8 == 0 else ""), "few" if i % 4 == 0 else "en") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(2400)], "doc_id long, toxic int")
    seen = []
    was, toxicity.threshold_of = toxicity.threshold_of, lambda n: seen.append(n.sum(1).tolist()) or was(n)
    try:
        model = toxicity.fit(docs, labels, most_rows=200)
    finally:
        toxicity.threshold_of = was
    assert set(model.thresholds) == {"few", "en"} and sum(map(sum, seen)) == 2400 - 160
    assert min(seen[sorted(range(2), key=lambda k: sum(seen[k]))[0]]) >= 50  # the small language is calibrated


def test_passes_over_the_chains_lose_no_passage(spark, monkeypatch):
    """The pieces of texts lie on disk for one share of the chains at a time; all shares
    together give what one pass does."""
    rows = [(i, " ".join(f"w{(i // 5) * 1000 + j}" if j < 70 else f"u{i}_{j}" for j in range(120))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shares = []
    real = passages.cut
    monkeypatch.setattr(passages, "cut", lambda df, name, *a, **k: (shares.append(name), real(df, name, *a, **k))[1])
    got = sorted(map(tuple, passages.passages(docs).collect()))
    assert shares.count("passages") == passages.PASSES > 1 and len({r[0] for r in got}) == 32
    monkeypatch.setattr(passages, "PASSES", 1)
    assert sorted(map(tuple, passages.passages(docs).collect())) == got


def test_passages_late_in_long_texts_and_of_texts_under_one_id(spark):
    """Pieces of a text in blocks are those of the whole one; the longest piece stands for texts of one id."""
    odd = lambda k, n: " ".join(f"é{k}x{i}" for i in range(n))
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"{odd(1, 4000)} {shared} {odd(2, 3000)}"), (2, f"{odd(3, 1500)} {shared}"), (3, f"{shared} {odd(4, 5000)}"), (3, "short"), (4, None)]
    assert len(rows[0][1]) > 8 * passages.BLOCK
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows[:3])
    assert {(r.doc_id, r.src_doc_id) for r in found} >= {(2, 1), (3, 1)}
    for r in found:
        assert texts[r.doc_id][r.start:r.start + r.length] == shared == texts[r.src_doc_id][r.src_start:r.src_start + r.src_length]

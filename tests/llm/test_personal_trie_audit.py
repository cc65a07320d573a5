"""Personal data, the prefix trie and the filter audit against brute force, on small
tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from replenix.llm import interaction, personal, prefixes
from replenix.llm.shared import table

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"

# ------------------------------------------------------------------ personal data
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    sums = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in sums) % 10 == 0


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), no, m.end(), kind))
    return [f"{k}:{a}:{e}" for a, _, e, k in sorted(out)]


PERSONAL = [
    None, "", "nothing here 12 345", "a@b.c.d%e@f.g @x.y a@b a.b@c-d.ef.", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0255.000.1.2", "4111 1111 1111 1111 x 4111-1111-1111-1112",
    "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "7536784127813050 4845168114407329", "+1 (826) 555-4081 190.137.223.204", "+49 30 1234567, +1 2", "é𝄞 +44 20 7946 0958 é a@b.cd",
    "call me 555-867-5309 now", "part 555-867-5309 of it", "my ssn is 123-45-6789", "order no 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00 x", "DE89 3704 0044 0532 0130 01",
    "x" * 3_000 + "@a.b", "1" * 2_000, "1 " * 1_000, "1.1." * 500, "+1 . " * 200, "a@b." * 200, "me@x.yz 10.0.0.1 " * 300,
]
#: long texts and what they hold; plain patterns would take quadratic time or a deep stack here
LONG = [("x" * 3_000_000 + "@a.b", 1), ("1" * 3_000_000, 0), ("1 " * 500_000, 0), ("1.1." * 200_000, 100_000), ("+1 . " * 200_000, 0),
        ("a@b." * 200_000, 100_000), ("a@b.c " * 50_000, 50_000), ("x" * 3_000_000, 0), ("+" * 1_000_000, 0), ("AB12" * 300_000, 0), ("1-" * 500_000, 0)]


def test_personal_base_spans_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal.digest(docs).collect()}
    assert sorted(got) == list(range(len(PERSONAL)))
    for i, text in enumerate(PERSONAL):
        want = base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, text[:60], got[i].spans[:200], want[:5])
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def test_personal_very_long_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LONG)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n for r in personal.digest(docs).selectExpr("doc_id", "n_email + n_ip + n_card + n_phone as n").collect()}
    assert got == {i: n for i, (_, n) in enumerate(LONG)}


def test_personal_spans_of_the_whole_table(spark):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in personal.digest(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = base_spans(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        if not re.search("[0-9@]", r.text or ""):
            assert got[r.doc_id].spans == ""


def test_personal_added_spans(spark):
    """Neighbours that a wide pattern runs into, checksums, and words nearby."""
    docs = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal.digest(docs).where("length(spans) < 1000").collect()}
    assert got[7] == "card:0:16,card:17:33"
    assert got[8] == "phone:0:17,ip:18:33"
    assert got[11] == "phone:8:20" and got[12] == ""
    assert got[13] == "ssn:10:21" and got[14] == ""
    assert got[15] == "iban:5:32" and got[16] == ""
    scores = {s.kind: s.score for r in personal.find(docs.where("doc_id in (11, 15)")).collect() for s in r.spans}
    assert scores == {"phone": 0.55, "iban": 1.0}


def test_personal_odd_tables(spark):
    rows = [(None, "a@b.cd", "x", 1.0, 5), (1, "a@b.cd", "x", 1.0, 5), (1, "a@b.cd", "x", 1.0, 5), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, score double, rid int")
    assert sorted(str(r.doc_id) + r.spans for r in personal.digest(docs).collect()) == ["1", "1email:0:6", "1email:0:6", "Noneemail:0:6"]
    assert personal.digest(docs.limit(0)).count() == 0
    hidden = spark.createDataFrame([(1, "é me@x.yz, +1 (826) 555-4081 190.137.223.204."), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in personal.masked(hidden).collect()} == {1: "é <email>, <phone> <ip>.", 2: ""}


def test_personal_is_native(spark):
    plan = personal.digest(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ the trie
def brute_trie(rows):
    own, out = {}, []
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(t[2], t[3]) for t in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[:-1] == p] for p in nodes}
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = ((len(nodes[p]) - 1) * len(re.findall(WORD, p[-1][1])) if p else 0) + sum(saved[k] for k in kids[p])
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(made[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda n: n[:2])


def random_turns():
    rnd = random.Random(5)
    rows = []
    for c in range(240):
        for t in range(rnd.choice([1, 1, 2, 3, 4, 5, 6, 30])):
            rows.append((c, t, rnd.choice(["user", "user", None]), rnd.choice(["a b", "a b", "a b", "x y z", "", None]) if t < 25 else "deep down"))
    # ties that are equal, null turns, no id, only null turns, a conversation that the donor's turns replace
    return rows + [(500, None, "u", "n"), (500, 0, "u", "n"), (None, 1, "a", "b"), (600, 1, None, None), (600, 1, None, None), (700, 0, "u", " \n ")]


@pytest.mark.parametrize("how", [{}, {"block_turns": 100, "fan_in": 2}, {"block_turns": 25, "fan_in": 5}])
def test_trie_brute_force(spark, how):
    rows = random_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefixes.trie(df, **how).collect()), key=lambda n: n[:2]) == brute_trie(rows)


def test_trie_whole_table_and_odd_tables(spark):
    df = table(spark, SF, "conversations").select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, prefixes.trie(df).collect()), key=lambda n: n[:2]) == brute_trie(map(tuple, df.collect()))
    wide = spark.createDataFrame([(21, 0, "user", "hi", "k", 1, 2)], "conv_id long, turn long, role string, text string, key string, block int, depth int")
    assert sorted(map(tuple, prefixes.trie(wide).collect()), key=lambda n: n[:2]) == brute_trie([(21, 0, "user", "hi")])
    assert prefixes.trie(wide.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_forest_levels_agree(seed):
    """Blocks of every size, merged level by level, close the same nodes as one block."""
    rnd = random.Random(seed)
    keys = sorted({b"".join(bytes([rnd.choice([0, 0, 1])]) * prefixes.WIDTH for _ in range(rnd.choice([0, 1, 2, 3, 9]))) for _ in range(40)})
    seqs = [(k, [3] * (len(k) // prefixes.WIDTH), {len(k) // prefixes.WIDTH: [1, i, 0, 0, 0, f"s{i}"]}) for i, k in enumerate(keys)]
    lcp = [-1, *[prefixes.common(a, b) for a, b in itertools.pairwise(keys)], -1]

    def closed(size):
        blocks = [[(*seqs[i], lcp[i]) for i in range(a, min(a + size, len(seqs)))] for a in range(0, len(seqs), size)]
        ends = [lcp[min(a + size, len(seqs))] for a in range(0, len(seqs), size)]
        out, reopened = [], False
        while blocks:
            forests = [prefixes.Forest(b, b[0][3], r, reopened) for b, r in zip(blocks, ends, strict=True)]
            out += [n[:7] for f in forests for n in f.nodes]
            rest = [(f.contracted(), r) for f, r in zip(forests, ends, strict=True)]
            pairs = [rest[i:i + 2] for i in range(0, len(rest), 2)]
            blocks = [[s for items, _ in p for s in items] for p in pairs]
            ends = [p[-1][1] for p in pairs]
            blocks, ends, reopened = [b for b in blocks if b], [e for b, e in zip(blocks, ends, strict=True) if b], True
        return sorted(out)

    assert closed(1) == closed(2) == closed(7) == closed(len(seqs))


# ------------------------------------------------------------------ the audit
def brute_audit(docs, labels):
    good, toxic = {}, {}
    for d, q, x in labels:
        good[d], toxic[d] = max(good.get(d, 0), q or 0), max(toxic.get(d, 0), x or 0)
    out, fails, parts = [], [], {}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, t, lang in docs:
        t, parts[lang or ""] = t or "", 1
        words = re.findall(WORD, t)
        fails.append((lang or "", d, {y for y, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]), strict=True) if bad}))
    for part in parts:
        own = [(d, f) for p, d, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, y in enumerate(order, 1):
                gone, kept = [x for x in left if y in x[1]], [x for x in left if y not in x[1]]
                failing = sum(y in f for _, f in own)
                rows.append((part, "".join(order), step, len(kept), len(gone), failing - len(gone), sum(f == {y} for _, f in own),
                             sum(good.get(d, 0) for d, _ in gone if d is not None), sum(toxic.get(d, 0) for d, _ in gone if d is not None), y))
                shapley[y] += len(gone)
                left = kept
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def test_audit_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [None, "", "", "A", long, long, long, long.upper(), "a b " * 150, "a # " * 200, long + " $", long + "é" * 9, "AB " * 20_000]
    docs = [(i, t, [None, "", "en"][i % 3]) for i, t in enumerate(texts)] + [(4, long, "en"), (4, long, "en"), (4, "other", "en"), (None, long, "en"), (None, long, None)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 13)] + [(4, None, None), (4, 1, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "p", "m") for d in docs], "doc_id long, text string, lang string, n int, part string, mask string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, interaction.audit(df, lab).collect())) == brute_audit(docs, labels)
    nolabels = sorted(map(tuple, interaction.audit(df, lab.limit(0)).collect()))
    assert nolabels == brute_audit(docs, [])
    assert interaction.audit(df.limit(0), lab).count() == 0


def test_audit_other_filters(spark):
    """Any conditions over t and words, under letters of one's own."""
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["a", "a", "b b", "c c c"])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = interaction.audit(docs, labels, filters={"X": "size(words) > 1"}).orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in got] == [("EX", 1, 3, 1, 2), ("EX", 2, 1, 2, 4), ("XE", 1, 2, 2, 4), ("XE", 2, 1, 1, 2)]

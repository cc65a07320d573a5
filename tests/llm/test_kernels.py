"""The numpy helpers against plain Python."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from replenix.llm import neardup, nnet, packing, passages, rules, tokens, words
from replenix.llm.attribution import allocate
from replenix.llm.mixing import pivotal, water_fill
from replenix.llm.trees import Trees

WORD = r"[^\x20\x09-\x0D]+"


def texts(n=400, seed=0):
    rng = random.Random(seed)
    return [None, "", "\n", "a", "a\n", "\na\na\n\n a\n", "é x", "a b c d e " * 400] + [
        "".join(rng.choice(["a", "b", " ", "\n", "é", "日", "#", "\t", "c ", "A"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_stats_match_plain_counts():
    all_ = texts()
    got = words.stats_of(pa.array(all_))
    for i, t in enumerate(all_):
        t = t or ""
        w = re.findall(WORD, t)
        wins = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if wins[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        assert (got["n_words"][i], got["word_chars"][i], got["n_symbols"][i], got["n_dup_lines"][i], got["n_repeat_words"][i]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)), t
    part = words.stats_of(pa.array(all_).slice(5, 50))
    assert all((part[k] == got[k][5:55]).all() for k in got)
    assert len(words.stats_of(pa.array([], pa.string()))["n_words"]) == 0


def test_ids_are_those_of_the_vocabulary():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary())
    enc = tokens.encoder(tokens.vocabulary())
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", " \n", "é", "日", "'s", "'", " the", "\t", ".", "1", "\x85", "\xa0", "　", "<|endoftext|>", "\x1c", "🙂", " 12"]
    assert enc.encode(pa.array(["a <|endoftext|> b"]))[0].tolist() == [64, 220, 50256, 275]
    some = ["", " ", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|endoftext|>y <|im_end|>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t, got in zip(some, enc.encode(pa.array(some)), strict=True):
        assert got.tolist() == tok.encode(t, add_special_tokens=False).ids
        assert enc.width[got].sum() == len(t.encode())


def test_packing_fills_every_sequence():
    rng = random.Random(1)
    lengths = np.array([rng.choice([1, 2, 5, 300, 700, 5000, 2048, 4096]) for _ in range(300)])
    pieces, sizes, costs = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    assert sum(sizes) == lengths.sum() and all(s & (s - 1) == 0 for s in sizes) and len(costs) == len(sizes)
    for k in (0, 3):  # pieces tile the documents, and the sequences
        groups = collections.defaultdict(list)
        for p in pieces:
            groups[p[k]].append((p[1] if k == 0 else p[4], p[2]))
        for key, own in groups.items():
            at = 0
            for start, n in sorted(own):
                assert start == at
                at += n
            assert at == (lengths[key] if k == 0 else sizes[key])
    full = np.array(costs)[np.array(sizes) == 2048]
    assert np.median(full) <= 2 * 2048


def test_binomial_bounds():
    for n, k, p in ((20, 2, 0.3), (100, 0, 0.02), (7, 7, 0.5), (50, 4, 0.2)):
        plain = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.binomial_tail(k, n, p) == pytest.approx(1.0 if k >= n * p else plain)
    assert rules.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01)
    logs = lambda n, i, p: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    for n, k, p in ((20_000, 240, 0.0125), (20_000, 17_900, 0.9), (300_000, 3_500, 0.0125)):  # more terms than one step adds
        assert rules.binomial_tail(k, n, p) == pytest.approx(math.fsum(math.exp(logs(n, i, p)) for i in range(k + 1)), rel=1e-9)
    # as many rows as a corpus has: near the normal limit, and in root time
    assert rules.binomial_tail(12_490_000, 10 ** 9, 0.0125) == pytest.approx(0.00221, rel=2e-2)
    assert rules.upper_bound(0, 0, 0.05) == 1.0


def test_water_filling_and_pivotal():
    assert water_fill([10, 10, 100], [1, 2, 3], 120, 3) == pytest.approx([22.5, 30, 67.5])  # the second is full, its excess of 10 goes 1 : 3
    assert water_fill([], [], 0, 3) == [] and water_fill([0, 0], [1, 1], 0, 3) == [0, 0]
    rng = np.random.default_rng(2)
    size, mean = rng.integers(1, 1000, 200).astype(float), np.zeros(200)
    p = rng.random(200)
    for s in range(300):
        out = pivotal(size, p, s)
        assert (size * out).sum() == pytest.approx((size * p).sum())
        assert ((out > 0) & (out < 1)).sum() <= 1
        mean += out / 300
    assert np.abs(mean - p).mean() < 0.06


def test_signature_join_finds_every_pair_under_the_threshold():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, neardup.HASHES)
        b = a.copy()
        at = rng.choice(neardup.HASHES, neardup.ERRORS, replace=False)
        b[at] ^= 1
        assert any((a[keep] == b[keep]).all() for _, _, keep in neardup._KEYS)


def test_common_counts_both_ways():
    rng = np.random.default_rng(5)
    for m in (3, 20):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(m)]
        want = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
        assert neardup.common_counts(sets).tolist() == want


def test_chains_match_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 7)
        x, y = [rng.randint(0, 60) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)]
        got = passages.chains(x, y)
        assert sorted(i for c in got for i in c) == list(range(n))
        for c in got:
            assert all(x[i] < x[j] and y[i] < y[j] for i, j in zip(c, c[1:], strict=False))
    assert passages.chains([0, 10, 20, 300], [5, 15, 25, 310]) == [[0, 1, 2], [3]]


def test_align_over_edits():
    a = np.arange(100)
    b = a.copy()
    b[40] = 999
    b = np.concatenate([[7000], np.delete(b, 60), [7001]])
    assert passages.align(a, b, -10, 10) == (0, 100, 1, 100, 98)
    assert passages.align(np.arange(5), np.arange(50, 60), -9, 9) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("rule,want", [("start", [2, 1, 1]), ("majority", [1, 2, 1]), ("split", [1.25, 1.75, 1])])
def test_boundary_tokens(rule, want):
    got, crossing = allocate(np.array([0, 3, 7, 8]), np.array([3, 7, 8, 9]), np.array([0, 4, 8, 9]), rule)
    assert got.tolist() == pytest.approx(want) and crossing.tolist() == [1, 1, 0]


def test_classifiers_learn():
    rng = np.random.default_rng(8)
    x = rng.random((600, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    t = Trees(trees=40).fit(x[:400], y[:400])
    assert ((t.score(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    docs = [rng.integers(2, 400, (rng.integers(0, 30), 3)).astype(np.int32) for _ in range(400)]
    y = (np.arange(400) % 3 == 0).astype(int)
    docs = [np.concatenate([d, np.full((1, 3), 1, np.int32)]) if k else d for d, k in zip(docs, y, strict=True)]
    net = nnet.Cnn(512)
    net.start_from_counts(docs[:300], y[:300])
    net.train(docs[:300], y[:300], epochs=2, rate=0.03)
    got = net.score_rows(docs[300:])
    assert ((got > 0.5) == y[300:]).mean() > 0.95 and ((got >= 0) & (got <= 1)).all()
    assert nnet.best_threshold(np.array([0.1]), np.array([0])) == 0.5


def plain_chains(x, y, gap=0.25, most_gap=48):
    """Score of the best chain, from all pairs of anchors."""
    order, best = sorted(range(len(x)), key=lambda i: (x[i], y[i])), {}
    for i in order:
        steps = [best[j] + min(passages.SEED, x[i] - x[j], y[i] - y[j]) - gap * abs(x[i] - x[j] - y[i] + y[j]) for j in best
                 if 0 < x[i] - x[j] <= most_gap and 0 < y[i] - y[j] <= most_gap]
        best[i] = max([passages.SEED, *steps])
    return max(best.values())


def test_chains_see_every_predecessor_inside_the_gap():
    rng = random.Random(9)
    for _ in range(200):
        n, wide = rng.randint(1, 40), rng.choice([60, 400])
        x, y = [rng.randint(0, wide) for _ in range(n)], [rng.randint(0, wide) for _ in range(n)]
        first = passages.chains(x, y)[0]
        steps = [min(passages.SEED, x[j] - x[i], y[j] - y[i]) - 0.25 * abs(x[j] - x[i] - y[j] + y[i]) for i, j in zip(first, first[1:], strict=False)]
        assert passages.SEED + sum(steps) == plain_chains(x, y)
    # 200 shared words, 60 others, 60 shared words
    x = list(range(0, 200, 8)) + list(range(260, 320, 8))
    assert passages.chains(x, x) == [list(range(25)), list(range(25, 33))]


def test_two_passages_of_one_chain():
    a = np.arange(200)
    b = a.copy()
    b[80:110] = -1 - np.arange(30)
    assert sorted(passages.alignments(a, b, -8, 8, 0, 190)) == [(0, 80, 0, 80, 80), (110, 200, 110, 200, 90)]


def test_hopeful_pairs_hold_all_long_alignments():
    rng = np.random.default_rng(5)
    a, b = [], []
    for n in range(300):
        x = rng.integers(0, 400, int(rng.integers(0, 160))).astype(np.uint64)
        y = x.copy()
        for i in rng.permutation(len(x))[:len(x) * int(rng.integers(0, 12)) // 20]:
            y[i] = 1000 + i
        a.append(x)
        b.append(np.concatenate([rng.integers(0, 400, n % 30).astype(np.uint64), y]) if n % 4 else rng.integers(0, 400, 90).astype(np.uint64))
    low, high = [-(n % 30) - 8 for n in range(300)], [8 - n % 30 for n in range(300)]
    long = np.array([any(min(r[1] - r[0], r[3] - r[2]) >= 50 for r in passages.alignments(x, y, lo, hi, 0, len(x))) for x, y, lo, hi in zip(a, b, low, high, strict=True)])
    got = passages.hopeful(a, b, low, high, 50)
    assert 20 < long.sum() < 200 and got[long].all() and not got[::4].any() and got.sum() < 250
    assert not passages.hopeful([], [], [], [], 50).any() and not passages.hopeful(a[:1], [b[0][:0]], [0], [0], 50).any()


def plain_alignments(a, b, low, high, first, last):
    """``alignments``, one run after another."""
    def best_of(a, b, low, high):
        runs, score, back = passages.runs_by_words(a, b, low, high), [], []
        for r, (i, j, n) in enumerate(runs):
            v, p = n, -1
            for q in range(r - 1, max(-1, r - 64), -1):
                qi, qj, qn = runs[q]
                over = max(0, qi + qn - i, qj + qn - j)
                di, dj = i + over - qi - qn, j + over - qj - qn
                if over < n and 0 <= di <= 8 and 0 <= dj <= 8 and score[q] + n - over - 0.5 * max(di, dj) > v:
                    v, p = score[q] + n - over - 0.5 * max(di, dj), q
            score.append(v)
            back.append(p)
        if not runs:
            return None
        r = int(np.argmax(score))
        i1, j1, matched, then = runs[r][0] + runs[r][2], runs[r][1] + runs[r][2], 0, None
        while r >= 0:
            i, j, n = runs[r]
            if then:
                n = min(n, then[0] - i, then[1] - j)
                k, other = 0, b[j + n:then[1]].tolist()
                for w in a[i + n:then[0]].tolist():
                    if w in other[k:]:
                        matched, k = matched + 1, k + other[k:].index(w) + 1
            matched, then, r = matched + n, (i, j), back[r]
        return then[0], i1, then[1], j1, matched

    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        got = best_of(a[i:i_end], b[j:j_end], low - i + j, high - i + j)
        if got:
            i0, i1, j0, j1, matched = got
            out.append((i + i0, i + i1, j + j0, j + j1, matched))
            todo += [(i, i + i0, j, j + j0)] * (i + i0 > first + passages.SEED) + [(i + i1, i_end, j + j1, j_end)] * (i + i1 + passages.SEED < last)
    return sorted(out)


def test_all_pairs_at_once_align_as_one_by_one():
    rng = np.random.default_rng(3)
    cases = []
    for t in range(400):
        x = rng.integers(0, int(rng.choice([3, 40, 400])), int(rng.integers(0, 220))).astype(np.uint64)
        y = x.copy()
        for i in rng.permutation(len(x))[:len(x) * int(rng.integers(0, 8)) // 20]:
            y[i] = 1000 + i
        y = np.delete(y, rng.permutation(len(y))[:len(y) // 12]) if t % 3 == 0 else y
        if t % 5 == 0:
            y[50:80] = 9999
        first = int(rng.integers(0, 60))
        cases.append((x, np.concatenate([rng.integers(0, 400, t % 30).astype(np.uint64), y]), -(t % 30) - 8, 8 - t % 30 + (300 if t % 7 == 0 else 5), first, first + int(rng.integers(0, 200))))
    want = [plain_alignments(*c) for c in cases]
    columns = list(zip(*cases, strict=True))
    flat = [*passages.flat(columns[0]), *passages.flat(columns[1]), *(np.array(c) for c in columns[2:])]
    for least in (0, 50):
        got = [[] for _ in cases]
        for r, *one in passages.align_rows(*flat, least=least).tolist():
            got[r].append(tuple(one))
        long = lambda rows: sorted(r for r in rows if min(r[1] - r[0], r[3] - r[2]) >= least)
        assert list(map(long, got)) == list(map(long, want)) and sum(map(len, got)) > 150


def test_all_pairs_at_once_chain_as_one_by_one():
    rng = np.random.default_rng(4)
    rows, x, y = [], [], []
    for r in range(300):
        n, wide = int(rng.integers(1, 60)), int(rng.choice([30, 100, 600]))
        one = sorted({(int(i), int(i + rng.choice([0, 0, 0, 1, 12, -12, 200]))) for i in rng.integers(0, wide, n)})
        rows += [r] * len(one)
        x += [i for i, _ in one]
        y += [j for _, j in one]
    rows, x, y = map(np.array, (rows, x, y))
    score, back, chain = passages.chain_rows(rows, x, y)
    for r in range(300):
        at = np.flatnonzero(rows == r)
        assert (score[at].max() - 4 * plain_chains(x[at].tolist(), y[at].tolist())) == 0
        one = {}
        for p in at:
            one.setdefault(chain[p], []).append(int(p - at[0]))
            assert back[p] < 0 or (chain[back[p]] == chain[p] and x[back[p]] < x[p] and y[back[p]] < y[p])
        assert sorted(one.values()) == sorted(passages.chains(x[at].tolist(), y[at].tolist()))

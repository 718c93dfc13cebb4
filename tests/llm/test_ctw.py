import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm import ctw

SCHEMA = "doc_id long, text string, c long, unit string, held int"
TEXTS = ["the cat sat on the mat", "the dog sat", "Der Hund und die Katze", "le chat et la souris", "", None, "the the the", "rare-word zzz the", "el gato y los perros", "the cat sat on the mat", "unseen thé 日本", "x" * 500]


class Tree:
    """The same model by recursion over plain dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(Counter)
        self.children = defaultdict(set)
        for text in texts:
            code = ctw.coded(ctw.tokens(text), depth)
            for i in range(depth, len(code)):
                for d in range(depth + 1):
                    self.counts[code[i - d : i]][code[i]] += 1
                    if d:
                        self.children[code[i - d + 1 : i]].add(code[i - d : i])

    def bits(self, ctx, prefix, k):
        ab = [0, 0]
        for byte, c in self.counts[ctx].items() if ctx in self.counts else ():
            if byte >> (8 - k) == prefix:
                ab[byte >> (7 - k) & 1] += c
        return ab

    def estimate(self, ab):
        a, b = ab
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, ctx, prefix, k):
        own = self.estimate(self.bits(ctx, prefix, k))
        if len(ctx) == self.depth:
            return own
        below = self.below(ctx, prefix, k)
        return max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)

    def below(self, ctx, prefix, k):
        return sum(self.weighted(c, prefix, k) for c in self.children[ctx] if sum(self.bits(c, prefix, k)))

    def chance(self, ctx, prefix, k, bit):
        """Mixture along the suffixes of the full context."""
        done, left, last = 0.0, 1.0, 0.5
        for d in range(self.depth + 1):
            node = ctx[self.depth - d :]
            ab = self.bits(node, prefix, k)
            if not sum(ab):
                break
            last = (ab[bit] + 0.5) / (sum(ab) + 1)
            w = 1.0 if d == self.depth else 1 / (1 + math.exp(min(700, self.below(node, prefix, k) - self.estimate(ab))))
            done, left = done + left * w * last, left * (1 - w)
        return done + left * last

    def score(self, text):
        code = ctw.coded(ctw.tokens(text), self.depth)
        total = 0.0
        for i in range(self.depth, len(code)):
            for k in range(8):
                total += math.log10(self.chance(code[i - self.depth : i], code[i] >> (8 - k), k, code[i] >> (7 - k) & 1))
        return total


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("frequent,grams,depth", [(100_000, 100_000, 3), (3, 20, 2), (0, 0, 1)])
def test_equals_recursion(spark, frequent, grams, depth):
    docs = [*enumerate(TEXTS), (None, "the null id"), (0, TEXTS[0])]
    got = ctw.score(spark.createDataFrame([(i, t, 1, "u", 1) for i, t in docs], SCHEMA), depth=depth, frequent=frequent, frequent_grams=grams).collect()
    words = Counter(w for i, t in docs if not held(i) for w in ctw.tokens(t))
    tree, n, v = Tree([t for i, t in docs if not held(i)], depth), sum(words.values()), len(words)
    want = []
    for i, t in docs:
        own = ctw.tokens(t)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        want.append((str(i), held(i), len(own), sum(words[w] > 0 for w in own), n, base, tree.score(t)))
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-4)


def test_next_bytes_sum_to_one(spark):
    texts = ["the", "then the", "der"] * 2
    rows = [(g, c) for g, c in zip(*ctw._merged(*zip(*[(g, [1] * len(g)) for g in [ctw._grams([ctw.coded(ctw.tokens(t), 3)], 3)[0] for t in texts]])), strict=True)]
    start = 0x0A0A0A << 8
    probes = {(start | b, 0) for b in range(256)} - {(int(g), 0) for g, _ in rows}
    lp = ctw.gram_scores(spark.createDataFrame([*((int(g), int(c)) for g, c in rows), *probes], "g long, c long"), 3).collect()
    first = {r.g & 255: r.lp for r in lp if r.g >> 8 == 0x0A0A0A}
    assert len(first) == 256 and sum(10**x for x in first.values()) == pytest.approx(1, abs=1e-4)


def test_the_order_of_words_counts(spark):
    line = "the dog bit the man in the park near the old mill"
    mixed = " ".join(sorted(line.split(), key=lambda w: w[::-1]))
    docs = [(i, line, 1, "u", 1) for i in range(30)] + [(100 + i, mixed, 1, "u", 1) for i in range(40) if held(100 + i)]
    got = ctw.score(spark.createDataFrame(docs, SCHEMA)).collect()
    plain, other = (next(r for r in got if r.held_out and (r.doc_id >= 100) == far) for far in (False, True))
    assert plain.n_bytes == other.n_bytes and plain.base_score == pytest.approx(other.base_score) and plain.score > other.score + 1


def test_held_out_documents_code_shorter_than_the_base(spark):
    rng = random.Random(6)
    lines = [" ".join(rng.choice(["stone", "river", "under", "the", "bridge", "flows", "slowly", "at", "night"]) for _ in range(8)) for _ in range(30)]
    docs = [(i, " ".join(rng.choice(lines) for _ in range(12)), 1, "u", 1) for i in range(200)]
    got = ctw.score(spark.createDataFrame(docs, SCHEMA)).where("held_out").collect()
    assert len(got) > 15 and all(r.score > r.base_score for r in got)


def test_a_very_long_text_and_small_tasks(spark):
    long = " ".join(f"w{i % 97}" for i in range(200_000))
    got = {r.doc_id: r for r in ctw.score(spark.createDataFrame([(1, long, 1, "u", 1), (3, "w1 w2", 1, "u", 1)], SCHEMA), depth=2).collect()}
    assert got[1].n_tokens == 200_001 and got[1].n_bytes == len(long) + 2
    texts = ["ab ab", "ab", "b a b a b", ""] * 5
    whole = Counter(g for t in texts for g in ctw._grams([ctw.coded(ctw.tokens(t), 2)], 2)[0].tolist())
    codes, lengths = ctw._grams([ctw.coded(ctw.tokens(t), 2) for t in texts], 2)
    assert Counter(codes.tolist()) == whole and lengths.sum() == len(codes)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(i, "ab c", 1, "u", 1) for i in range(40) if held(i)], SCHEMA)
    r = ctw.score(df, depth=2).first()
    assert r.train_tokens == 0 and r.base_score == 0 and r.score == pytest.approx(-8 * 6 * math.log10(2)) and r.bits_per_byte == pytest.approx(8)
    assert ctw.score(df.limit(0), depth=2).count() == 0


def test_gram_table_finds_what_it_holds():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**48, 5000))
    lps = rng.standard_normal(len(keys))
    asked = np.concatenate([keys, rng.integers(0, 2**48, 5000)])
    found, hit = ctw.look_up(asked, *ctw.gram_table(keys, lps))
    assert (hit == np.isin(asked, keys)).all() and found[: len(keys)] == pytest.approx(lps, abs=1e-6)
    assert not ctw.look_up(keys, *ctw.gram_table(keys[:0], lps[:0]))[1].any()

"""The scores of toxicity against a plain version: dictionaries of words and stems, loops over words and passages."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from screenmill.llm import toxicity as T


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


class PlainModel:
    """Both classes' interpolated Kneser-Ney models of the words of some documents; known: all words that any model has seen."""

    def __init__(self, docs, known):
        self.n = [Counter(w for words, toxic in docs if toxic == c for w in words) for c in (0, 1)]
        self.words6, self.six4 = defaultdict(set), defaultdict(set)
        for w in known:
            self.words6[w[:6]].add(w)
            self.six4[w[:4]].add(w[:6])
        self.known = set(known)
        self.c6, self.c4 = ([defaultdict(set) for _ in (0, 1)] for _ in (0, 1))
        for c in (0, 1):
            for w in self.n[c]:
                self.c6[c][w[:6]].add(w)
            for s in self.c6[c]:
                self.c4[c][s[:4]].add(s)
        at_least = lambda x: max(x, 1)
        self.totals = [[at_least(sum(self.n[c].values())), at_least(len(self.n[c])), at_least(len(self.c6[c])), at_least(len(self.c4[c]))] for c in (0, 1)]

    def log(self, w, c):
        d, (words, types, six, four) = T.DISCOUNT, self.totals[c]
        both = sum(t[2] for t in self.totals) + 0.5 * (len(self.six4) + 1)
        f, s = w[:4], w[:6]
        shared = (sum(len(self.c4[k].get(f, ())) for k in (0, 1)) + 0.5) / both if f in self.six4 else 0.5 / both
        low = max(len(self.c4[c].get(f, ())) - d, 0) / six + d * four / six * shared
        low = low / (len(self.six4[f]) + 1) if f in self.six4 else low
        middle = max(len(self.c6[c].get(s, ())) - d, 0) / types + d * six / types * low
        middle = middle / (len(self.words6[s]) + 1) if s in self.words6 else d * six / types * low
        return math.log(max(self.n[c].get(w, 0) - d, 0) / words + d * types / words * middle if w in self.known else d * types / words * middle)

    def evidence(self, w):
        return self.log(w, 1) - self.log(w, 0)


def plain_features(e):
    n = len(e)
    excess = sum(max(x - 1, 0) for x in e)
    passages = [max((sum(e[i : i + k]) / k for i in range(n)), default=T.NO_EVIDENCE) for k in T.PASSAGES]
    return [sum(e) / max(n, 1), *(max(p, T.NO_EVIDENCE) for p in passages), 20 * excess / max(n, 1), math.log1p(excess)]


def test_scores_equal_the_plain_version(spark):
    rng = random.Random(6)
    ordinary = [f"{a}{b}" for a in ("report", "weather", "garden", "people", "é", "a1") for b in ("", "s", "ing", "ed")]
    bad = ["idiot", "idiots", "idiotic", "stupid", "stupidly", "moron", "scum"]
    rows = []
    for k in range(90):
        words = [rng.choice(ordinary) for _ in range(rng.choice([3, 20, 150]))]
        if k % 3 == 0:
            for _ in range(1 + len(words) // 8):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(200, None), (201, "  ;"), (202, "idiocy of unknown stupidest newcomers"), (None, "idiot people")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(80)], "doc_id long, toxic int")
    known = {r.doc_id: (int(r.toxic), r.fold) for r in T.known_labels(labels).collect()}
    assert len({f for _, f in known.values()}) == T.FOLDS
    texts = {k: words_of(t) for k, t in rows}
    learnt = [(texts[k], toxic, fold) for k, (toxic, fold) in known.items()]
    vocabulary = {w for words, _, _ in learnt for w in words}
    models = [PlainModel([(w, c) for w, c, f in learnt if f != m], vocabulary) for m in range(T.FOLDS + 1)]
    x = np.array([plain_features([models[fold].evidence(w) for w in texts[k]]) for k, (_, fold) in known.items()])
    y = np.array([toxic for toxic, _ in known.values()], float)
    mean, deviation, weights = T.fitted_curve(x, y)
    want = {}
    for k, words in texts.items():
        z = float(np.r_[(np.array(plain_features([models[T.FOLDS].evidence(w) for w in words])) - mean) / deviation, 1.0] @ weights)
        want[k] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    got = {r.doc_id: r for r in T.toxicity(docs, labels, block_bytes=2000).collect()}
    # evidence is kept in 16 bits on its way, about three digits
    assert {k: abs(got[k].score - p) < 0.03 for k, p in want.items()} == dict.fromkeys(want, True)
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
    # the evidence itself, through the shards
    asked = sorted(vocabulary | {w for words in texts.values() for w in words})
    blocks = T.word_blocks(T.hashed(spark.createDataFrame([(1, " ".join(asked))], "doc_id long, text string")).withColumn("cell", T.F.lit(-1)), 1 << 20)
    trained = T.word_blocks(T.hashed(docs).join(T.known_labels(labels).select("doc_id", (T.F.col("toxic").cast("int") * T.FOLDS + T.F.col("fold")).alias("cell")), "doc_id", "left").select("doc_id", "text_hash", "text", T.F.coalesce("cell", T.F.lit(-1)).alias("cell")), 2000)
    model = T.summed(T.count_shards(trained, 5))
    sums = {r["at"]: r["n"] for r in model.select(T.F.posexplode("totals").alias("at", "n")).groupBy("at").agg(T.F.sum("n").alias("n")).collect()}
    parts = T.evidence_of(blocks, model, np.array([sums[k] for k in range(len(sums))]), 5, (T.FOLDS, 0)).orderBy("part").collect()
    for which, m in enumerate((T.FOLDS, 0)):
        values = np.concatenate([T.from_planes(T.unpacked(bytes(r.evidence))[which], "<f2", len(T.unpacked(bytes(r.evidence))[which]) // 2) for r in parts]).astype(float)
        assert np.allclose(np.sort(values), np.sort([models[m].evidence(w) for w in asked]), atol=0.005)

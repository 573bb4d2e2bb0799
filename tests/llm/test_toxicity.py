"""Toxic word evidence: against the formula in plain Python, and words that begin like an insult."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tallyloom.llm import toxicity

INSULTS = ["trash", "pathetic", "disgusting", "moron", "clown", "worthless"]
#: Ordinary words that share their beginnings with the insults, and others; none of them in the texts learnt from.
PLAIN = "track trade travel train transport path paths pattern patient paper distance district display dish more morning moral month clothes cloud close clock clear world worth worry word work the a of and to over near with old mill market children school walk house tree river".split()


@pytest.fixture(scope="module")
def texts():
    """Syllable words; toxic texts hold an insult each, or words of a stem that takes many endings."""
    pick = random.Random(2)
    word = lambda: "".join(pick.choice(["ba", "ne", "ki", "lo", "su", "da", "re"]) for _ in range(pick.randint(2, 4)))
    out = []
    for i in range(600):
        own = [word() for _ in range(pick.randint(10, 40))]
        toxic = int(i % 6 == 0)
        if toxic:
            own += pick.sample(INSULTS, 2) if i % 12 else ["zorb" + word() for _ in range(4)]
        elif i % 6 == 1:
            own.append("zorbstone")  # a clean word of that stem
        pick.shuffle(own)
        out.append((i, " ".join(own), toxic))
    return out


@pytest.fixture(scope="module")
def model(spark, texts):
    rows = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    return toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))


def odds(a, b, n1, n0, z):
    prior = max(0.5, 20.0 * (a + b) / (n1 + n0))
    a1, a0 = a + prior, b + prior
    return min(6.0, math.log(a1 / (n1 + 20.0)) - math.log(a0 / (n0 + 20.0)) - z * math.sqrt(1 / a1 + 1 / a0))


def test_odds_by_formula(texts, model):
    n = Counter(t for _, _, t in texts)
    held, begun = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for _, text, toxic in texts:
        words = set(text.split())
        for w in words:
            held[w][toxic] += 1
        for b in {w[:k] for w in words for k in toxicity.BEGINS if k < len(w)}:
            begun[b][toxic] += 1
    leans = {w: c1 * n[0] > c0 * n[1] for w, (c0, c1) in held.items()}
    total = Counter(leans.values())
    want = {f"{w} ": odds(c1, c0, n[1], n[0], 2.0) for w, (c0, c1) in held.items()}
    for b, (c0, c1) in begun.items():
        votes = Counter(lean for w, lean in leans.items() if len(w) > len(b) and w.startswith(b))
        if votes[True] >= 5:
            want[b] = min(odds(c1, c0, n[1], n[0], 2.0), odds(votes[True], votes[False], total[True], total[False], 2.0))
    assert model.odds == pytest.approx({k: v for k, v in want.items() if v > 0})
    assert "zorb" in model.odds and not [b for i in INSULTS for b in model.odds if i.startswith(b)]
    assert model.known_clean == {w for w, (c0, c1) in held.items() if odds(c1, c0, n[1], n[0], -2.0) < 0 and any(w[:k] in model.odds for k in toxicity.BEGINS)}
    assert "zorbstone" in model.known_clean


def test_words_that_begin_like_insults_are_plain(spark, model):
    pick = random.Random(9)
    said = [" ".join(pick.choice(PLAIN) for _ in range(pick.randint(5, 60))) for _ in range(200)] + ["zorbstone zorbstone by the zorbstone"]
    bad = ["you pathetic clown what worthless trash", "zorbkiki zorbsu", "zorbnene of zorblolo and zorbdakida"]
    rows = spark.createDataFrame(list(enumerate(said + bad)), "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(rows, model).collect()}
    assert max(score[i] for i in range(len(said))) < 0.5
    assert min(score[i] for i in range(len(said), len(score))) >= 0.5

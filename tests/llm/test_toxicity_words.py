"""Toxicity by a few words in long texts."""

import random

import numpy as np

from retentio.llm import op8_toxicity


def test_toxicity_by_a_few_words_of_long_texts():
    rng = random.Random(7)
    vocab, bad = [f"w{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"], ["foul", "vile", "nasty", "rotten"]

    def text(toxic):
        some = [vocab[min(int(rng.expovariate(1 / 120)), 675)] for _ in range(rng.randint(20, 400))]
        return " ".join(some + (rng.sample(bad, 2) if toxic else []))

    made = [(text(i % 4 == 0), int(i % 4 == 0 or i % 10 == 1)) for i in range(600)]  # every tenth label says toxic of a clean text
    index = op8_toxicity.ExampleIndex(list(range(600)), [t for t, _ in made], [y for _, y in made], {"foul": 75, "vile": 75, "nasty": 75, "rotten": 75}, 600, 0.35)
    caught = np.mean([index.score(text(True))[0] >= op8_toxicity.THRESHOLD for _ in range(100)])
    flagged = np.mean([index.score(text(False))[0] >= op8_toxicity.THRESHOLD for _ in range(100)])
    assert caught > 0.9 and flagged < 0.05


def test_toxicity_by_forms_of_a_word_never_seen_before():
    rng = random.Random(8)
    vocab = [f"{a}{b}{a}{c}ing" for a in "bcdfghklmn" for b in "aeiou" for c in "prstvwxz"]

    def text(toxic):
        forms = ["zorgq" + "".join(rng.choices("abcdefgh", k=6)) for _ in range(2)]   # hardly one of them twice
        return " ".join(rng.choices(vocab, k=rng.randint(20, 200)) + (forms if toxic else []))

    made = [(text(i % 5 == 0), int(i % 5 == 0)) for i in range(400)]
    index = op8_toxicity.ExampleIndex(list(range(400)), [t for t, _ in made], [y for _, y in made], {}, 400, 0.2)
    assert np.mean([index.score(text(True))[0] >= op8_toxicity.THRESHOLD for _ in range(60)]) > 0.9
    assert np.mean([index.score(text(False))[0] >= op8_toxicity.THRESHOLD for _ in range(60)]) < 0.05

"""Language ID in scripts of all blocks, and its Viterbi against a plain one."""

import sys

import numpy as np
from pyspark.sql import functions as F

from quaystone.llm import language

SINHALA, KHMER, ODIA = "සිංහල භාෂාව ලංකාවේ කතා කරයි", "ភាសាខ្មែរ ជា ភាសា របស់ ប្រទេស កម្ពុជា", "ଓଡ଼ିଆ ଏକ ଭାଷା ଯାହା ଓଡ଼ିଶାରେ କୁହାଯାଏ"


def test_every_letter_has_a_script():
    script = language._script_of_points()
    assert all(script[i] for i in range(sys.maxunicode + 1) if chr(i).isalpha())


def test_languages_of_other_scripts_are_learned(spark):
    texts = {"en": "the house of the king stands on the hill", "si": SINHALA, "km": KHMER, "or": ODIA, "am": "አማርኛ የኢትዮጵያ ቋንቋ ነው", "dv": "ދިވެހި ބަހަކީ ރާއްޖޭގެ ބަހެވެ"}
    rows = [(i, t, k) for k, t in texts.items() for i in range(5 if k == "en" else 3)] + [(1000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["lang"], r["language"]["lang_pred"], r["language"]["score"]) for r in language.identify(docs, F.lit(True)).collect()}
    assert got == {(k, k, 1.0) for k in texts} | {(None, "und", 0.0)}


def plain_viterbi(score, switch):
    """What the best path scores."""
    value = score[0]
    for x in score[1:]:
        value = np.maximum(value, value.max() - switch) + x
    return value.max()


def cost(score, label, switch):
    return score[np.arange(len(label)), label].sum() - switch * (label[1:] != label[:-1]).sum()


def test_viterbi_finds_the_best_path():
    two_others = np.array([[-7.0, 0, -15], [-7, -15, 0]], np.float32)
    assert language.viterbi(two_others, np.array([0, 2]), 12.0).tolist() == [1, 2]
    rng = np.random.default_rng(7)
    for k in (2, 3, 5):
        n = rng.integers(0, 12, 400)
        first = np.append(0, np.cumsum(n))
        # runs of words that favour one language each
        lean = np.repeat(rng.integers(0, k, first[-1] // 3 + 1), 3)[: first[-1]]
        score = rng.uniform(-8, 0, (first[-1], k))
        score[np.arange(len(lean)), lean] += rng.uniform(0, 4, len(lean))
        score = np.maximum(score - score.max(1, keepdims=True), -15.0).astype(np.float32)
        label = language.viterbi(score, first, 12.0)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b > a:
                assert abs(cost(score[a:b].astype(float), label[a:b], 12.0) - plain_viterbi(score[a:b].astype(float), 12.0)) < 1e-3

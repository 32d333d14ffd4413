import random

from corpus_pipeline import LEAST_COSINE
from loomtext.llm import langid


def test_short_texts_of_learned_languages_stay(spark):
    r = random.Random(4)
    words = ["avec", "reouti", "anatha", "lllldoado", "bana", "kolo", "mira", "tavo", "schtz", "grmpf"]
    rows = [(i, " ".join(r.choices(words[2:], k=60)), "aa") for i in range(60)]
    short = ["Avec.", "Reouti anatha.", "A.", "A.\nAll rights reserved.", "Qx.", "Zyzzy jjk wqq."]
    long = "xqzk vbnq wrtz pklx qqxj zzvk hjkl " * 5
    rows += [(1000 + i, t, "aa") for i, t in enumerate(short)] + [(2000, long, None), (2001, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    low = {x.doc_id for x in langid.identify_languages(df).where(f"lang_pred <> 'und' and cosine < {LEAST_COSINE}").collect()}
    assert 2000 in low and low & set(range(1000, 1006))
    kept = {x.doc_id for x in langid.reject_unidentified(df, LEAST_COSINE).collect()}
    assert kept == {d for d, _, _ in rows} - {2000, 2001}

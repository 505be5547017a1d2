"""The scan of op1 that keeps the texts with words enough for a licence."""

import random

from trajecta.llm.licenses import FULL_TEXTS, TEMPLATES, least_words, may_hold, template_bigrams

SHARE = 0.8 / 1.2


def test_only_texts_that_can_hold_a_share_of_a_template_go_on(spark):
    known = {k: template_bigrams(v) for k, v in (TEMPLATES | FULL_TEXTS).items()}
    rnd, rows, must = random.Random(3), [], set()
    for i, own in enumerate(list(known.values()) * 2):
        for j, share in enumerate((SHARE, 0.75, 1.0)):  # whole bigrams, in any order and with other words around, upper case too
            held = rnd.sample(own, min(len(own), -(-round(1000 * share * len(own)) // 1000)))
            text = "\n".join(["zz qq"] + [g.upper() if k % 3 == 0 else g for k, g in enumerate(held)])
            rows.append((10 * i + j, text))
            if len(held) >= SHARE * len(own):
                must.add(10 * i + j)
    rows += [(5000, "the permission of the software, provided as is, and of any license"), (5001, "words " * 3000), (5002, None), (5003, ""), (5004, "license")]
    kept = {r["doc_id"] for r in may_hold(spark.createDataFrame(rows, "doc_id long, text string"), known, SHARE).collect()}
    assert must and must <= kept
    assert not kept & {5000, 5001, 5002, 5003, 5004}


def test_the_least_number_of_words_counts_places_of_bigrams():
    assert least_words(["a b", "b c", "c d", "d e"], 0.5) == (["a", "b", "c", "d", "e"], 2)
    assert least_words(["a a"], 1.0) == (["a"], 1)

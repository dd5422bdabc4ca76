"""Licence notices against brute force over all places of all templates."""

import random

from casegraph.llm import license_scan as L

PLAIN = "the house stands by the river and of it we know much".split()


def _brute(text):
    words, out = L.template_words(text), set()
    for t in L.TEMPLATES:
        ws = L.template_words(t.text)
        keyed = {p for key in t.keys for k in [L.phrase_at(ws, L.template_words(key))] for p in range(k, k + len(L.template_words(key)))}
        for begin in range(-len(ws), len(words)):
            met = [q for q in range(len(ws)) if 0 <= begin + q < len(words) and words[begin + q] == ws[q]]
            if keyed <= set(met) and len(met) >= L.LEAST_COVERAGE * len(ws):
                out.add((t.label, begin, len(met) / len(ws)))
    return out


def _check(spark, texts):
    rows = {r["doc_id"]: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        want = _brute(text)
        assert {(m["label"], m["begin"], m["coverage"]) for m in rows[k]["matches"]} == want
        assert {m[0] for m in want} <= set(rows[k]["labels"].split(","))
    return rows


def test_every_notice_of_a_file_is_found(spark):
    notice = {t.label: t.text for t in L.TEMPLATES}
    both = notice["cc0"] + ". Released under the MIT License."
    rows = _check(spark, [both, *["Released under the MIT License."] * 20])
    assert rows[0]["labels"] == "cc0,mit"


def test_several_changed_and_cut_notices(spark):
    rng, texts = random.Random(6), ["", "mit license"]
    for _ in range(60):
        words = []
        for t in rng.sample(L.TEMPLATES, rng.randint(1, 5)):
            own = L.template_words(t.text)
            for _ in range(rng.choice((0, 0, 1, 3))):
                own[rng.randrange(len(own))] = rng.choice(PLAIN)
            words += rng.choices(PLAIN, k=rng.randint(0, 5)) + own
        texts.append(" ".join(words[rng.choice((0, 0, 2)) :]))
    _check(spark, texts)

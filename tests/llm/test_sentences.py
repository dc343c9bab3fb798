from __future__ import annotations

import time

import numpy as np
import pytest

from strandline.llm import sentences, transducer

CASES = {
    "Dr. A. B. Smith came at 9 a.m. and left. He paid 3.50 euros.": ["Dr. A. B. Smith came at 9 a.m. and left.", "He paid 3.50 euros."],
    "“No,” said Ann, “we never asked.” Mr. Lee left.": ["“No,” said Ann, “we never asked.”", "Mr. Lee left."],
    "“The dam is safe!” E. Ten told reporters. Done.": ["“The dam is safe!” E. Ten told reporters.", "Done."],
    "A grant was approved... but nothing was paid. The end": ["A grant was approved... but nothing was paid.", "The end"],
    "« Non », répond M. Un. Cf. l’art. 39 du règlement.": ["« Non », répond M. Un.", "Cf. l’art. 39 du règlement."],
    "Am 3. Bauabschnitt arbeitet X usw. Der Bescheid Nr. 5 wurde am 1. August geändert.": ["Am 3. Bauabschnitt arbeitet X usw.", "Der Bescheid Nr. 5 wurde am 1. August geändert."],
    "Es kostete 245,8 Mio. Dollar, z. B. in Wien. M. Un est venu à 9 h. 30 le 3 mai.": ["Es kostete 245,8 Mio. Dollar, z. B. in Wien.", "M. Un est venu à 9 h. 30 le 3 mai."],
    "1 марта 1997 г. Управление ввело станцию. Кто заплатит?": ["1 марта 1997 г. Управление ввело станцию.", "Кто заплатит?"],
    "他说：“我们将公布。”第二句。第三句？": ["他说：“我们将公布。”", "第二句。", "第三句？"],
    "「安全だ！」と彼は言った。次の文。": ["「安全だ！」と彼は言った。", "次の文。"],
    "जल स्तर 82.5 मीटर था। कौन करेगा?": ["जल स्तर 82.5 मीटर था।", "कौन करेगा?"],
    "هل ستعيد فتح المحجر؟ لا تكفي المياه؛ قال.": ["هل ستعيد فتح المحجر؟", "لا تكفي المياه؛ قال."],
    "Heading Here\n\nText one. e-mobility pilots ran.": ["Heading Here", "Text one.", "e-mobility pilots ran."],
    "The old bridge was closed.The new one opened.": ["The old bridge was closed.", "The new one opened."],
    "Cut off in the mid...": ["Cut off in the mid..."],
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    which, a, b = sentences.spans([text])
    assert [text[x:y] for x, y in zip(a, b)] == CASES[text]


def test_wrapped_lines_do_not_end_sentences():
    text = "The water levels at the northern station stood at eighty metres on the first of May in\nthe year of the flood, and nobody could explain why so many meters were never\nread. Next one."
    assert len(sentences.spans([text])[0]) == 2


def test_all_characters_are_covered_and_odd_texts_pass():
    texts = ["", " \n ", "...", "“", "a", "!!! ??? ...", " x ", "\ud800 bad", "x" * 50, "a.b.c. D. e?f!g", "「" * 40 + "。" * 40]
    which, a, b = sentences.spans(texts)
    for i, text in enumerate(texts):
        kept = "".join(text[x:y] for w, x, y in zip(which, a, b) if w == i)
        assert "".join(kept.split()) == "".join(text.split())


def test_composed_chunks_equal_one_pass():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, len(sentences.SYMBOLS), 5000)
    state, want = sentences.FRESH, []
    for s in symbols:
        want.append(sentences.EMITS[state, s])
        state = sentences.TABLE[state, s]
    for chunk in (1, 7, 256, 10_000):
        assert transducer.run(sentences.TABLE, sentences.EMITS, symbols, sentences.FRESH, chunk).tolist() == want


def test_long_text_in_linear_time():
    start = time.time()
    text = "A sentence of some words ends here. " * 30_000
    assert len(sentences.spans([text])[0]) == 30_000 and time.time() - start < 30


def test_query_form(spark):
    rows = [(1, "text/plain", "One. Two.", "S..."), (2, "text/html", "Not cut. No.", None), (3, None, None, ""), (None, "text/plain", "x.", "y.")]
    df = spark.createDataFrame(rows, "evidence_id long, content_type string, content string, snippet string").selectExpr("*", "'clash' as char_start")
    assert {tuple(r) for r in sentences.evidence_sentences(df).collect()} == {(1, "content", 0, 4), (1, "content", 5, 9), (1, "snippet", 0, 4)}
    assert sentences.evidence_sentences(df.where("false")).count() == 0

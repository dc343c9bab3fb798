from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np

from strandline.llm import languages

SEED = {
    "en": "The water board has closed the old road because nobody could explain why the meters were never read by the company.",
    "fr": "Le niveau de l’eau était trop bas et les travaux vont relier la ville à la centrale avant la fin de cette année.",
    "de": "Der Pegel stand sehr hoch und die Leitung wurde erst nach dem Bescheid der Behörde wieder in Betrieb genommen.",
    "es": "Las obras unirán el pueblo con la ciudad, pero nadie ha confirmado todavía cuándo empieza el plazo del proyecto.",
    "ru": "Уровень воды был очень высоким, и кто заплатит за новую линию между городами, пока никто не знает.",
    "th": "ระดับน้ำในแม่น้ำสูงมากเมื่อวันที่ผ่านมาและยังไม่มีใครรู้ว่าใครจะจ่ายค่าสายส่ง",
    "zh": "工程造价比去年高出很多，管理局还没有公布新的电价，居民签署了请愿书。",
    "ja": "費用は去年より高かったので、公社はまだ新しい料金表を公表していないと述べた。",
}


def corpus(spark, n=40):
    rng = random.Random(6)
    rows = []
    for lang, text in SEED.items():
        parts = text.split(" ") if " " in text else list(text)
        for _ in range(n):
            k = rng.randrange(len(parts) // 2)
            rows.append((len(rows), lang if rng.random() > 0.1 else "en", (" " if " " in text else "").join(parts[k:] + parts[:k]) + ("。" if lang in ("zh", "ja") else ".")))
    rows += [(900, "fr", SEED["en"] + " " + SEED["de"] + "\n\n" + SEED["ru"]), (901, None, SEED["fr"]), (902, "EN-gb", SEED["en"]), (903, "en", None), (904, "en", " \n"), (905, "xx", "---\ntitle: x\n---\n[[Only Links Here]] 12345"), (906, "en", SEED["es"] * 400), (None, "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "'clash' as seg_no")


def test_documents_and_segments(spark):
    found = languages.language_segments(corpus(spark))
    rows = defaultdict(list)
    for r in found.orderBy("doc_id", "seg_no").collect():
        rows[r["doc_id"]].append(r["lang"])
        assert 0 <= r["confidence"] <= 1
    order = list(SEED)
    right = sum(rows[i] == [order[i // 40]] for i in range(320))
    assert right >= 0.98 * 320
    assert rows[900] == ["en", "de", "ru"] and rows[906] == ["es"] and not {903, 904, 905, None} & set(rows)
    wrong = {r["doc_id"] for r in languages.wrong_or_mixed(found).collect()}
    assert {900, 901, 906} <= wrong and 902 not in wrong
    assert languages.language_segments(corpus(spark).where("false")).count() == 0


def test_kneser_ney_equals_its_definition():
    text = "abracadabra abraca dabra cad"
    codes = languages.codes_of(text)
    model = languages.KneserNey(codes, 2)
    d = languages.DISCOUNT
    pad = " " + text.replace("\0", " ")
    pairs = [(pad[i], pad[i + 1]) for i in range(len(text)) if not (pad[i] == " " and pad[i + 1] == " ")]
    c2 = Counter(pairs)
    c1 = Counter(w for _, w in c2)
    for a in "abcd ":
        total = 0.0
        for w in "abcdr ":
            n = sum(v for (x, _), v in c2.items() if x == a)
            kinds = sum(1 for (x, _) in c2 if x == a)
            low = max(c1[w] - d, 0) / sum(c1.values()) + d * len(c1) / sum(c1.values()) / 20_000
            want = max(c2[(a, w)] - d, 0) / n + d * kinds / n * low
            key = np.array([(ord(a) << 16) | ord(w)], np.uint64)
            assert math.isclose(float(model.chance(key, 2)[0]), want, rel_tol=1e-9)
            total += want
        assert total <= 1.0 + 1e-9


def test_labels():
    assert [languages.label_of(x) for x in ("EN", "pt_MZ", "fra", "xx", "", None, "und", " sw-TZ ")] == ["en", "pt", "fr", None, None, None, None, "sw"]


def test_path_prefers_few_changes():
    total = np.zeros((5, 12))
    total[:, 0], total[2, 1] = 10, 12
    assert languages.path(total).tolist() == [0] * 5
    total[2, 1] = 40
    assert languages.path(total).tolist() == [0, 0, 1, 0, 0]


def test_short_foreign_sentences_are_cut(spark):
    models = languages.train([(r["lang"], r["text"]) for r in corpus(spark).where("doc_id < 320").collect()])
    zh, ja = "居民签署了请愿书。", "公社は述べた。"
    texts = [zh + SEED["fr"], SEED["en"] + " " + ja + " " + SEED["en"], SEED["fr"], SEED["en"] + " Nobody could read. " + SEED["en"]]
    want = [["zh", "fr"], ["en", "ja", "en"], ["fr"], ["en"]]
    found = languages.segments_of(texts, models)
    assert [[x[2] for x in f] for f in found] == want
    assert found[2] == languages.segments_of([SEED["fr"]], models)[0] and found[2][0][:2] == (0, len(SEED["fr"]))


def test_the_gate_loses_no_segment(spark, monkeypatch):
    models = languages.train([(r["lang"], r["text"]) for r in corpus(spark).where("doc_id < 320").collect()])
    rng = random.Random(4)
    texts = []
    for _ in range(200):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            words = SEED[rng.choice(["en", "fr", "de", "es", "ru", "zh"])].rstrip(".。").split(" ")
            k = rng.randrange(len(words))
            parts.append(" ".join(words[k : k + rng.randrange(1, 9)]) + ".")
        texts.append(" ".join(parts))
    gated = languages.segments_of(texts, models)
    monkeypatch.setattr(languages.np, "bincount", lambda of, weights, n: np.full(n, 1e9))
    assert gated == languages.segments_of(texts, models)


def test_confidence_is_calibrated_on_held_out_texts(spark):
    """On texts that neither the models nor the calibration saw, confidence is the share of right answers within 3 %."""
    import numpy as np

    rows = [(languages.label_of(r["lang"]), r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()]
    rows = sorted((l, t) for l, t in rows if l and t and len(t) < 6000)
    models = languages.train([r for n, r in enumerate(rows) if n % 4])
    fresh = [r for n, r in enumerate(rows) if n % 4 == 0]
    value, letters, language = languages.held_out([x for r in fresh for x in (r, *[("en", "")] * (languages.HELD_OUT - 1))], models)
    lead, right, *_ = languages.pieces_told(value, letters, language, languages.PIECES)
    sure = languages.confidence_of(lead, models)
    assert len(lead) > 1000 and abs(sure.mean() - right.mean()) < 0.03 and ((sure - right) ** 2).mean() < 0.05 and np.all((0 < sure) & (sure < 1))


def test_texts_in_unknown_languages_are_rejected(spark):
    rows = [(languages.label_of(r["lang"]), r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").collect()]
    models = languages.train(sorted((l, t) for l, t in rows if l and t and len(t) < 6000))
    strange = ["Wszystkie dzieci wiedzą, że jesienią liście spadają z drzew, a ptaki odlatują do ciepłych krajów nad morzem.", "Minden gyerek tudja, hogy ősszel lehullanak a levelek a fákról, és a madarak elköltöznek melegebb vidékre."]
    assert [found[0][2] for found in languages.segments_of(strange, models)] == ["und", "und"]

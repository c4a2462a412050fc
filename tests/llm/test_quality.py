"""Quality rules against a plain Python count."""

from collections import Counter

from eventlens.llm import quality
from tests.llm.helpers import by_id, documents, empty, prose, words

import random


def brute(text):
    w = words(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def rows():
    rng = random.Random(3)
    good = "the quick brown fox and the lazy dog " + prose(rng, 80)
    return [(1, None), (2, ""), (3, " \t\n "), (4, good), (4, good), (5, good + "\n" + good + "\n" + good),
            (6, "a b c " * 60), (7, " the ".join(prose(rng, 30) for _ in range(1000))), (8, " ".join(x + "###" for x in good.split())), (9, "é ü " * 70),
            (10, "x\ny\nx\n\n x\ny"), (None, good), (11, "a b"), (12, "a b c a b c")]


def test_metrics_match_a_plain_count(spark):
    got = by_id(quality.measure(documents(spark, rows())), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((i, *brute(t)) for i, t in rows()), key=repr)


def test_base_rules_and_verdict(spark):
    for r in quality.measure(documents(spark, rows())).collect():
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base
        assert r.kept == (not r.failed) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.measure(documents(spark, rows())).collect() if r.kept}
    assert {4, 7, None} <= kept and not kept & {1, 2, 3, 6, 8, 11}


def test_clean_texts_in_other_languages_stay(spark):
    texts = ["Сегодня утром мы долго шли по старой дороге к реке и говорили о книгах, которые читали зимой, а потом вернулись домой. ",
             "Dzisiaj rano szliśmy długo starą drogą do rzeki i mówiliśmy o książkach, które czytaliśmy zimą, a potem nie było już czasu. ",
             "Σήμερα το πρωί περπατήσαμε στον παλιό δρόμο προς το ποτάμι και μιλήσαμε για τα βιβλία που διαβάσαμε τον χειμώνα. ",
             "ذهبنا هذا الصباح إلى النهر القديم وتحدثنا عن الكتب التي قرأناها في الشتاء ثم عدنا إلى البيت قبل المساء مع الأصدقاء. ",
             "Bu sabah eski yoldan nehre kadar yürüdük ve kışın okuduğumuz kitaplar hakkında konuştuk, sonra bir eve döndük. "]
    rng = random.Random(2)
    rows = [(i, "\n".join(" ".join(rng.sample(t.split(), len(t.split()))) for _ in range(6))) for i, t in enumerate(texts)]
    rows.append((9, " ".join(f"kw{rng.randrange(900)}" for _ in range(300))))  # a list of words in Latin letters without any function word
    assert {r.doc_id: r.failed for r in quality.measure(documents(spark, rows)).collect()} == {**{i: [] for i in range(5)}, 9: ["stop_words"]}


def test_keep_returns_the_columns_it_was_given(spark):
    d = documents(spark, rows())
    k = quality.keep(d)
    assert k.schema == d.schema
    assert sorted(r.doc_id for r in k.collect() if r.doc_id == 4) == [4, 4]
    assert quality.keep(empty(spark)).count() == 0 and quality.measure(empty(spark)).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = quality.measure(documents(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

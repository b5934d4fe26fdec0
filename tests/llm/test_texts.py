"""Sentences and leaks on small cases."""

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import leaks
from tessella.llm import sentences as sn
from tessella.llm.sentences import Cutter, sentences


def cut(text):
    return [text[a:b] for a, b in Cutter().cut(text)]


def test_sentences_by_language():
    for units in (
        ["Это больно?!", "Приём стоит 9 300 руб.", "Норма — 36.4 ед., см. рис. 21 и табл. 3 в памятке."],
        ["«Болит ночью!» — пожаловался пациент Иванов.", "Она спросила: «Что делать?» — и записала ответ.", "Ну… живу далеко, так что решайте сами."],
        ["Do not wait!", "13. Rinse with warm water.", "Dr. Smith recommends cleaning, i.e. before lunch.", "“Does it hurt?” asked Mrs. Brown."],
        ["„Tut es weh?“, fragte Frau Müller.", "Der Termin ist am 26. Oktober um 18.30 Uhr."],
        ["M. Durand a demandé : « Est-ce douloureux ? » avant de partir.", "Rincez après le repas !"],
    ):
        assert cut(" ".join(units)) == units
    assert cut("牙龈出血怎么办？“疼吗？”医生问道。温度是36.7度。") == ["牙龈出血怎么办？", "“疼吗？”医生问道。", "温度是36.7度。"]
    assert cut("「痛いですか？」と先生は聞きました。抜歯の保証は9か月です。") == ["「痛いですか？」と先生は聞きました。", "抜歯の保証は9か月です。"]
    assert cut("ทานยา 4 ครั้งต่อวัน หลังอาหารค่ะ เจ็บไหมคะ") == ["ทานยา 4 ครั้งต่อวัน หลังอาหารค่ะ", "เจ็บไหมคะ"]


def test_sentences_without_capitals():
    units = ["это больно?!", "не терпите: звоните!", "приём стоит 9 300 руб. за один зуб.", "филиал находится на ул. лунной в д. 20, вход со двора.", "осмотр проходит утром."]
    cutter = Cutter({"~" + u.split()[0]: 1.0 for u in units} | {"~за": -3.0, "~лунной": -3.0})
    text = " ".join(units)
    assert [text[a:b] for a, b in cutter.cut(text)] == units
    assert cut("В перерыв.Версия памятки 47.3.16 действует.") != []


def searched(cutter, text):
    """The best cuts of one block by the scores, every span tried."""
    cand = [c for c in cutter._ends(text, 0, len(text), True) if c[2] + c[3] > sn.NEVER]
    ends, starts = [c[0] for c in cand] + [len(text)], [0] + [c[1] for c in cand]
    close, opens = [c[2] for c in cand] + [0.0], [0.0] + [c[3] for c in cand]
    po, pc = sn._depths(text, 0, len(text))
    cut = [0] + [sum(p < e for p in po) - sum(p < e for p in pc) for e in ends[:-1]] + [0]
    best = [0.0]
    for k, e in enumerate(ends):
        best.append(max(best[j] + cutter._span(text, starts[j], e, opens[j], close[k], cut[j], cut[k + 1]) for j in range(k + 1)))
    return best[-1], ends, starts, opens, close, cut


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Он молчал… ", "А потом… ", "пошёл. ", "«Да… ", "Нет!» ", "13. ", "ул. Мира ", "(см. ", "рис. 2) ", "слово слово слово слово слово ", "Dr. ", "? "]), min_size=1, max_size=45))
def test_sentences_search_is_exact(parts):
    text = "".join(parts).strip()
    cutter = Cutter()
    want, ends, starts, opens, close, cut = searched(cutter, text)
    got, total = cutter._block(text, 0, len(text), True), 0.0
    for a, b in got:
        j, k = starts.index(a), ends.index(b)
        total += cutter._span(text, a, b, opens[j], close[k], cut[j], cut[k + 1])
    assert abs(total - want) < 1e-6 and [x for s in got for x in s] == sorted(x for s in got for x in s)


def test_sentences_look_back_as_far_as_they_must():
    quoted = "Он сказал: «" + "Ну… Так… Вот… " * 20 + "всё». Потом ушёл."
    assert len(cut(quoted)) == 2
    assert len(cut("Слово… слово… " * 4000)) >= 1  # and stay fast


def test_sentences_edges(spark):
    assert cut("Заголовок\n\nПервая строка\nпродолжается. Вторая.\n \n(Скобки.)") == ["Заголовок", "Первая строка\nпродолжается.", "Вторая.", "(Скобки.)"]
    assert cut("") == [] and cut(" \n\n ") == [] and Cutter().cut(None) == []
    long = "Это предложение. " * 3000
    assert len(cut(long)) == 3000 and len(cut("слово " * 20000)) == 1
    docs = spark.createDataFrame([(1, "Да! Нет.", 5), (2, None, 5), (3, "", 5), (1, "Да! Нет.", 6)], "doc_id bigint, text string, start_pos int")
    got = sorted(tuple(r) for r in sentences(docs).collect())
    assert got == [(1, 0, 3), (1, 0, 3), (1, 4, 8), (1, 4, 8)]
    assert sentences(docs.where("false")).count() == 0


ITEM = "Перед снимком на Лунной снимите солевой раствор, выпейте Ставомедон, опишите боль и ждите 15 минут в синем зале у окна."
STOCK = "Клиника работает по предварительной записи, а сведения на этой странице носят справочный характер и ничего не обещают."


def test_leaks(spark):
    items = spark.createDataFrame([("q1", f"{ITEM} {STOCK}", 1), ("q2", f"{ITEM} Иначе говоря, приходите к нам ещё раз совсем скоро и берите с собой друзей.", 1), ("q3", None, 1), ("q4", "", 1)] + [(f"s{k}", STOCK, 1) for k in range(10)], "sample_id string, expected_answer string, words int")
    hit = [ITEM, "Вот: " + ITEM.upper(), ITEM.replace("солевой", "соле-\nвой").replace("о", "o"), ITEM.replace("снимите ", "").replace("выпейте", "выпейтте"), "выпейте Ставомедон, опишите боль и ждите 15 минут в синем зале", ("Пустые слова. " * 5000) + ITEM]
    miss = [None, "", "выпейте Ставомедон, опишите боль и ждите 15", ITEM.replace("15", "16").replace("Ставомедон", "Перлофенз"), STOCK, "совсем другое"]
    docs = spark.createDataFrame([(k, t, "q") for k, t in enumerate(hit + miss)], "doc_id bigint, text string, sample_id string")
    got = {(r["doc_id"], r["sample_id"]) for r in leaks.leaks(docs, items).collect()}
    assert got == {(k, q) for k in range(len(hit)) for q in ("q1", "q2")}
    old, leaks.ITEMS = leaks.ITEMS, 5
    try:
        assert {(r["doc_id"], r["sample_id"]) for r in leaks.leaks(docs, items).collect()} == got
    finally:
        leaks.ITEMS = old
    assert leaks.leaks(docs.where("false"), items).count() == 0 and leaks.leaks(docs, items.where("false")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=10, max_size=24), st.data())
def test_leaks_prefilter_loses_nothing(kinds, data):
    item = [f"слово{'абвгдежзик'[k]}{'лмнопрстуфхцчшщэюяйъыьлм'[i]}" for i, k in enumerate(kinds)]
    doc = []
    for w in item:
        edit = data.draw(st.sampled_from(["", "", "", "", "lost", "added", "misspelt", "joined", "broken"]))
        doc += {"lost": [], "added": [w, "ещё"], "misspelt": [w + "х"], "broken": [w[:4], w[4:]]}.get(edit, [w])
        if edit == "joined" and len(doc) > 1:
            doc[-2:] = [doc[-2] + doc[-1]]
    n = leaks.held_words(item, [False] * len(item), doc, 0, band=30)
    there, two = set(doc), [a + b for a, b in zip(item, item[1:], strict=False)]
    joined = [c in there for c in two]
    flags = [w in there or j or k for w, j, k in zip(item, [*joined, False], [False, *joined], strict=True)]
    assert n < 10 or leaks.may_run(flags, 10)


def test_leaks_hot_and_edited(spark):
    ten = "Промойте лунку солевым раствором затем приложите холодный компресс слева щеки"
    # left with two seeds of three words, none, and with words run together
    copies = [
        ten.replace("раствором", "растворомм").replace("холодный", "холоднный"),
        ten.replace("солевым", "солевыым").replace("затем", "затемм").replace("холодный", "холоднный"),
        ten.replace("лунку солевым", "лункусолевым").replace("затем приложите", "затемприложите").replace("компресс слева", "компрессслева"),
    ]
    items = spark.createDataFrame([("q1", ten + ".")], "sample_id string, expected_answer string")
    n = 120  # the passage stands in a third of all documents
    docs = spark.createDataFrame([(k, f"Памятка {k}. {copies[k % 9]}. Конец." if k % 9 < 3 else "Пустые слова без цитат.") for k in range(n)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in leaks.leaks(docs, items).collect()} == {k for k in range(n) if k % 9 < 3}

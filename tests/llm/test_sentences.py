import random

import pytest

from millrace.llm import sentences as S

# each list is a text's sentences; they are joined by blanks, or as given
SPACED = [
    ["Dr. Vek closed it at 3.5 metres.", "The fix went into v3.5.", "It held."],
    ["At 3 p.m. Ulubry closed its gates.", "It stays open until 6 p.m.", "The road is long."],
    ["J. K. Lomamir disagreed with Prof. Pelasset about it.", "It was logged as item B.", "It was item C."],
    ['"Leave it running!" the note said, and it ran.', '"The dust settled."', 'The clerk wrote: "It holds. It will hold."', "No one asked."],
    ["It was empty... and no one said why.", "See (cf. Sec. 12).", "(See Vol. 3, p. 7.)", "Is n! > 8 for every n > 10?", "Let n = 68!.", "Why?!", "Because."],
    ["In the Ost vs. Bel count, pumps, gates, etc.", "The firm Moro Ltd. sends e.g. two.", "On Jan. 5 it closed.", "Q.E.D. was written beneath it."],
    ["Am 113. Mai schrieb Dr. Draudal, z. B. im 2. Jahrhundert.", "„Steht es?“, fragte er.", "Es hält usw.", "Die Mühle ruht – bis morgen."],
    ["« La jauge est-elle bloquée ? » demanda le greffier.", "Pourquoi ?", "M. Beludmir a noté que le prix, p. ex., était de 1 250,75 marcs.", "Il attend… puis s’arrête."],
    ["—¿Está parado? —preguntó la Dra. Draannok.", "¿Por qué?", "Según la fig. 6, es de aprox. 80,4 unidades.", "«Aguanta. Aguantará», escribió Veklorn."],
    ["«Держится. Будет держаться», — написал Корилан.", "В 311 г. здесь стояла мельница.", "Проф. Пеллан возразил, т. е. молчал и т. д.", "«Датчик остановился?» — спросил писарь."],
    ["पृ. 203 पर सूची अधूरी है ।", "“क्या गेज रुका है?” लिपिक ने पूछा।", "डॉ. मोर रुका... फिर चला |", "क्यों?"],
    ["«هل توقف المقياس؟» سأل الكاتب.", "كتب د. غالادول أن القيمة 23.7.", "لماذا؟"],
    ["قدر 61.51 سے 14.7 ہو گئی۔", "کیا یہ ہے؟"],
    ["திரு. சார்லநோக் எழுதிய குறிப்பு எண். 195 காணவில்லை.", "“நின்றதா?” என்று கேட்டார்."],
]
CLOSE = [
    ["真的吗？！", "（见第6页图26.6。）", "“水位计停了吗？”书记员问。", "「旧海关关闭。」", "他写道：“还撑得住。会一直撑住。”", "观测站等待……然后停下。"],
    ["「まだ持つ。きっと持つ。」とナルは書いた。", "「止まったのか？」と書記が尋ねた。", "値は59.5から2.8になった。"],
]


def cut(text):
    return [text[a:b] for a, b in S.sentences(text)]


@pytest.mark.parametrize("parts", SPACED)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\r\n\r\n".join(parts)) == parts
    assert cut("  " + "\xa0 ".join(parts) + "\n") == parts


@pytest.mark.parametrize("parts", CLOSE)
def test_scripts_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_layout():
    assert cut("What the count shows\n\nIt wraps at\nthe end. Next.") == ["What the count shows", "It wraps at\nthe end.", "Next."]
    assert cut("- the gate. Open\n- a valve, 3.5 mm\n\n1. one\n2. two\n\n(1) a\n(2) b") == ["- the gate. Open", "- a valve, 3.5 mm", "1. one", "2. two", "(1) a", "(2) b"]
    assert cut("Am\n113. Mai kam er.\n– wie immer") == ["Am\n113. Mai kam er.", "– wie immer"] or cut("Am\n113. Mai kam er.")[0] == "Am\n113. Mai kam er."
    assert cut("during the campaign.The mean was 3. The end.") == ["during the campaign.", "The mean was 3.", "The end."]
    assert cut("สำเนาถูกสร้าง36.7 ทีมกลางคืน\n\nจบ") == ["สำเนาถูกสร้าง36.7", "ทีมกลางคืน", "จบ"]


def test_nothing_and_odd_texts():
    assert S.sentences(None) == S.sentences("") == S.sentences(" \n\t\xa0") == []
    for t in ["...", '"', "((((", "?!\n\n.", "|", "« » “ ”", "a" * 5000, ". " * 500, '"a. B" ' * 300]:
        check(t)


def check(text):
    end = 0
    for a, b in S.sentences(text):
        assert end <= a < b and not text[end:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        end = b
    assert not text[end:].strip()


def test_every_character_is_in_one_sentence():
    r = random.Random(8)
    bits = ["Dr. ", "A", "b. ", "\n", "\n\n", '"', "« ", " »", "(", ")", "... ", "!", "? ", "。", "ไทย", " ", "- x\n", "1. y\n", "é", "|", "।", "\r\n", "p.m. ", "“", "”", "3.5"]
    for _ in range(1500):
        check("".join(r.choice(bits) for _ in range(r.randrange(40))))


def test_long_texts_take_linear_time():
    import time

    for part, n in (("The dam of Dr. Vek holds 3.5 litres. Why? ", 2), ('"It held!" he said. (See p. 3.) ', 2), ("((( a. ", None)):
        began = time.time()
        found = S.sentences(part * 20_000)
        assert n is None or len(found) == n * 20_000
        assert time.time() - began < 20


def test_frames(spark):
    df = spark.createDataFrame([(1, "It fell. We ran."), (2, None), (3, ""), (1, "It fell. We ran.")], "doc_id long, text string")
    assert [tuple(r) for r in S.split(df).collect()] == [(1, 0, 8), (1, 9, 16)] * 2


def test_long_and_stray_quotations():
    # a quotation within a sentence doesn't divide it, however long it is
    for n in (3, 12, 60):
        inside = " ".join(["The dam holds."] * n)
        for o, c in (("“", "”"), ("«", "»"), ('"', '"'), ("(", ")"), ("「", "」")):
            text = f"The clerk wrote: {o}{inside}{c} No one asked."
            assert cut(text) == [text[: -len(" No one asked.")], "No one asked."], (o, n)
    # a stray mark is one for its own sentence only
    assert cut('The pipe is 5" wide. It holds. "Why? Who asked?" he said. It fell.') == ['The pipe is 5" wide.', "It holds.", '"Why? Who asked?" he said.', "It fell."]
    deep = "(" * 500 + "The end. " + ")" * 500 + " Next."
    check(deep)


def test_the_program_weighs_spans_jointly():
    # the odds of one cut alone are against it; the lengths on both sides decide
    class Weak(S.Model):
        def odds(self, cut):
            return -0.5

    model = Weak()
    model.lengths = {False: [-4.0 if b < S._bucket(8) or b > S._bucket(500) else 0.0 for b in range(S.LONGEST + 1)]}
    part = " ".join(["word"] * 90) + "."
    text = f"{part} {part} K. {part}"
    assert [text[a:b] for a, b in S._divide(text, 0, len(text), model)] == [part, part, f"K. {part}"]
    assert all(model.odds(c) < 0 for c in S._cuts(text, 0, len(text))[:-1])
    short = "It is K. L. M. N. there."
    assert [short[a:b] for a, b in S._divide(short, 0, len(short), model)] == [short]


@pytest.fixture(scope="module")
def taught(spark):
    """Paragraphs in which "Zyx." is only ever followed by more, and "qoph." ends."""
    names = ["Ulubry", "Corvane", "Lomamir", "Pelasset", "Draudal"]
    r = random.Random(5)
    rows = []
    for k in range(300):
        paragraphs = []
        for _ in range(4):
            own = [r.choice([f"The old dam of Zyx. {r.choice(names)} holds well.", f"Some {r.choice(names)} wrote to Zyx. {r.choice(names)} about it.", "The count is all qoph.", "It rained on the mill."]) for _ in range(3)]
            paragraphs.append(" ".join(own))
        rows.append((k, "\n\n".join(paragraphs), "en"))
    return S.fit(spark.createDataFrame([*rows, (900, None, None), (901, "", "x")], "doc_id long, text string, lang string"))


def test_closings_and_openings_are_learnt(taught):
    text = "The old dam of Zyx. Ulubry holds well. The count is all qoph. Some Corvane wrote to Zyx. Pelasset about it."
    assert cut(text) != [text[a:b] for a, b in S.sentences(text, taught)]
    assert [text[a:b] for a, b in S.sentences(text, taught)] == ["The old dam of Zyx. Ulubry holds well.", "The count is all qoph.", "Some Corvane wrote to Zyx. Pelasset about it."]
    assert taught.weights["w.zyx"] < -0.5 and taught.openings["The"] > 0 > taught.openings["Pelasset"]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = S.fit(empty)
    assert model.weights == {} and S.split(empty, model=model).count() == 0
    assert [s for part in SPACED for s in S.sentences(" ".join(part), model)] == [s for part in SPACED for s in S.sentences(" ".join(part))]


@pytest.fixture(scope="module")
def many(spark):
    """3,000 documents, of which every 700th has "Zyx.", which nothing ends."""
    rows = [(k, f"The mill of {'Zyx. ' if k % 700 == 0 else ''}Pelasset closed. It rained on the count.\n\nNo one asked about gate {k % 7}. It held.", "en") for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_all_documents_are_learnt_from(many):
    model = S.fit(many)
    assert model.weights["w.zyx"] < -0.1
    assert model.openings["Pelasset"] < 0 < model.openings["The"]
    # a sample would leave it as it is
    twice = S.fit(many.union(many).repartition(5))
    assert abs(twice.weights["w.zyx"]) > abs(model.weights["w.zyx"])


def test_the_model_is_the_same_however_documents_lie(many, monkeypatch):
    parts = S._parts(many, "doc_id", "text", "lang")
    here = S._fit(parts, rounds=3)
    monkeypatch.setattr(S, "PART_CHARS", 1000)
    assert S._fit(S._parts(many.repartition(2), "doc_id", "text", "lang"), rounds=3).weights == here.weights
    monkeypatch.setattr(S, "LOCAL_PLACES", 0)
    spread = S._fit(parts, rounds=3)
    assert here.weights and (spread.weights, spread.openings, spread.lengths) == (here.weights, here.openings, here.lengths)


def test_fitting_and_dividing_read_once_give_what_both_give(spark, many):
    texts = [" ".join(p) for p in SPACED] + ["".join(p) for p in CLOSE] + ["\n\n".join(p) for p in SPACED] + ["# A title\n- the gate. Open\n- a valve\n\nIt fell.\n\n| b. |", "", " ", None]
    odd = spark.createDataFrame([(None if k == 3 else 5000 + k, t, "en" if k % 2 else None) for k, t in enumerate(texts * 2)], "doc_id long, text string, lang string")
    documents = many.where("doc_id < 200").union(odd)
    got = sorted(map(str, S.fit_split(documents).collect()))
    assert got == sorted(map(str, S.split(documents, model=S.fit(documents)).collect())) and len(got) > 600
    assert S.fit_split(documents.limit(0)).count() == 0


def test_quotations_at_the_start_are_ends_however_many_are_read(spark):
    # a block that begins with one goes on, so none of them is known to be an end
    word = [chr(0x5000 + k) * 2 for k in range(300)]
    rows = [(k, f"「旧海关{word[k % 300]}。」水位计停了。\n\n观测站等待。「门{word[k % 299]}。」\n\n他看。「门{word[k % 298]}。」\n\n雨后重建。", "zh") for k in range(3000)]
    model = S.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [rows[4][1][a:b] for a, b in S.sentences(rows[4][1], model)][:2] == [f"「旧海关{word[4]}。」", "水位计停了。"]

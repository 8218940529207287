import random

import pytest

from millrace.llm import leaks

R = random.Random(11)
NAMES = ["Vek", "Dra", "Ost", "Lom", "Ril", "Gal", "Mor", "Sar", "Quo", "Fen"]
name = lambda: R.choice(NAMES) + R.choice(["an", "el", "ir", "om"]) + R.choice(["dal", "mir", "wick", "stow", "bry"])
sentence = lambda: f"The {R.choice(['river gauge', 'archive', 'ferry', 'survey'])} of {name()} {R.choice(['holds back', 'carries', 'lists', 'loses'])} {R.randrange(2, 999)}.{R.randrange(9)} {R.choice(['litres', 'tonnes', 'pages', 'marks'])} near {name()} and {name()}."
LEAD = "Read the record below and answer the question that follows it."
ITEMS = [(i, (LEAD + " " if i % 2 else "") + " ".join(sentence() for _ in range(6)), f"EVAL-CANARY-{i:04x}aa-b-v1" if i % 3 == 0 else None) for i in range(12)]
ZH = (50, "萨原庙会上，洛尔镇织户付给科托桥铁铺3枚铜钱。萨川的铜钟付给贝港铁铺545枚铜钱，而且科米川的船夫把15根麻绳运往佩米桥。", None)
FILL = " ".join(sentence() for _ in range(10))
ALL = [*ITEMS, ZH, (60, None, None), (61, "", "")]
INDEX = leaks.Index(ALL)


def found(text):
    return {x[0] for x in leaks._scan(INDEX, text)}


def words(i, a, b):
    w = ITEMS[i][1].split()
    return " ".join(w[int(len(w) * a) : int(len(w) * b)])


WAYS = {
    "plain": lambda t: t,
    "upper": str.upper,
    "lower": str.lower,
    "wide": lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t),
    "punctuation": lambda t: t.replace(".", " –").replace(",", ""),
    "spacing": lambda t: t.replace(" ", " \xa0 "),
    "lines": lambda t: "\n// ".join(t[i : i + 40] for i in range(0, len(t), 40)),
    "markup": lambda t: "<p>" + " ".join(f"<b>{w}</b>" if k % 5 == 0 else w for k, w in enumerate(t.split())) + "</p>",
    "entities": lambda t: t.replace(" and", "&nbsp;and").replace("The", "&#84;he"),
    "json": lambda t: '{"prompt": "' + t.replace(". ", '.\\n') + '"}',
    "soft": lambda t: t.replace("ar", "a\xadr​"),
}


@pytest.mark.parametrize("way", WAYS)
def test_forms(way):
    assert found(FILL + "\n\n" + WAYS[way](words(2, 0.2, 0.9)) + "\n\n" + FILL) == {2}


def test_replaced_words():
    w = words(4, 0.1, 1).split()
    for k in range(5, len(w), 11):
        w[k] = "quiet"
    assert found(FILL + " " + " ".join(w)) == {4}
    for k in range(3, len(w), 4):
        w[k] = "brittle"
    assert found(FILL + " " + " ".join(w)) == set()


def test_less_than_half_is_no_case():
    assert found(FILL + " " + words(5, 0.55, 0.97)) == set()
    assert found(LEAD + " " + FILL) == set()
    assert found(words(5, 0.3, 0.35) + FILL + words(5, 0.5, 0.6)) == set()


def test_scripts_without_spaces():
    assert found("关于德米港的笔记。" + ZH[1][5:50] + "数值。") == {50}
    assert found("关于德米港的笔记。" + ZH[1][5:18] + "数值。") == set()


def test_canaries_must_be_whole():
    assert found("x EVAL-CANARY-0003aa-b-v1.") == {3}
    assert found("eval canary 0003AA b v1") == {3}
    assert found("EVAL-CANARY-0003aa-b-v12") == found("EVAL-CANARY-0003aa") == set()


def test_frames_and_cleaning(spark):
    docs = spark.createDataFrame([(1, "s", ITEMS[0][1]), (2, "test", ITEMS[0][1]), (3, "s", None), (4, "s", ""), (5, "none", "a " + ITEMS[2][1] + " z"), (6, "s", FILL)], "doc_id long, source string, text string")
    sources = spark.createDataFrame([("s", None, None), ("test", True, None)], "source_id string, held_out boolean, never_train boolean")
    items = spark.createDataFrame(ALL, "item_id long, text string, canary string")
    got = leaks.leaks(docs, sources, items).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in got} == {(1, 0, "passage"), (5, 2, "passage")}
    clean = {r["doc_id"]: r["text"] for r in leaks.without_leaks(docs, leaks.leaks(docs, sources, items)).collect()}
    assert clean[1].strip(".") == "" and clean[5].replace(".", "").split() == ["a", "z"]
    assert leaks.leaks(docs, sources, items.where("item_id < 0")).count() == 0
    assert leaks.leaks(docs.where("doc_id < 0"), sources, items).count() == 0


def test_item_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, x[1]) for i, x in enumerate(ITEMS)], "doc_id long, text string")
    items = spark.createDataFrame(ALL, "item_id long, text string, canary string")
    one = sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect())
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 1500)
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect()) == one == [(i, i) for i in range(12)]


HI = (70, "नदी के पास एक पुराना गाँव है जहाँ हर साल मेले में दूर के लोग आते हैं और वे अपने साथ गुड़ तथा कपड़ा लाते हैं जिसे राजा का मुंशी कागज पर लिखता है", None)
BN = (71, "নদীর ধারে এক পুরনো গ্রাম আছে যেখানে প্রতি বছর মেলায় দূরের লোক আসে আর তারা সাথে করে গুড় ও কাপড় আনে যা রাজার মুনশি কাগজে লিখে রাখে", None)
EN = (72, "By the old mill on the hill a man of the town set up his own stall and sold us jam to eat with the bread that we had got from an inn by the quay at dawn", None)


@pytest.mark.parametrize("item", [HI, BN, EN], ids=["hi", "bn", "en"])
def test_short_words_beside_replaced_ones(item):
    index, all_words = leaks.Index([*ALL, item]), item[1].split()
    n, missed = -(-len(all_words) * 55 // 100), []
    for first in range(len(all_words) - n + 1):
        for gone in ([1], [n - 2], [1, 3], [n - 4, n - 2], [2, n - 3]):
            if len(gone) > round(n / 10):
                continue
            w = all_words[first : first + n]
            for k in gone:
                w[k] = {70: "घोड़ा", 71: "ঘোড়া", 72: "zebra"}[item[0]]
            if item[0] not in {x[0] for x in leaks._scan(index, FILL + " " + " ".join(w) + " " + FILL)}:
                missed.append((first, gone))
    assert missed == []
    # one word in three gone is no case
    w = ["quiet" if k % 3 == 1 else x for k, x in enumerate(all_words)]
    assert not [x for x in leaks._scan(index, FILL + " " + " ".join(w) + " " + FILL) if x[0] == item[0]]


def test_probing_loses_no_passage_with_words_replaced():
    # short words, and the replaced ones spread or side by side: what is asked for is always there
    r = random.Random(3)
    short = ["a", "of", "to", "by", "it", "we", "sun", "oak", "mill", "stone", "river", "gauge", "x", "no"]
    rows = [(i, " ".join(r.choice(short) for _ in range(r.randrange(8, 60))), None) for i in range(40)]
    rows += [(i, r.choice(rows)[1][:60] + " " + x, None) for i, x, _ in [(40 + k, " ".join(r.choice(short) for _ in range(30)), None) for k in range(20)]]
    index, missed = leaks.Index(rows), []
    for i, text, _ in rows:
        w = text.split()
        n = -(-len(w) // 2)
        for _ in range(12):
            first = r.randrange(len(w) - n + 1)
            own = w[first : first + n]
            for k in r.sample(range(n), int(0.1 * n + 0.5)):
                own[k] = "zebra"
            flat = leaks.letters("quiet " + " ".join(own) + " brook")
            if len(leaks.letters(" ".join(own))) >= leaks.WIDE + 3 and i not in index.probe.candidates(flat) and index.needs[i] > 1:
                missed.append((i, own))
    assert missed == []


def test_probe_against_a_plain_search():
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["ab", "cd", "ef", "水", "位"]) * r.randrange(1, 4) for _ in range(20)), None) for i in range(30)]
    index = leaks.Index(rows)
    for _ in range(50):
        flat = leaks.letters("".join(r.choice(["ab", "cd", "ef", "水", "位"]) for _ in range(r.randrange(0, 60))))
        for table, width, which in ((index.probe.wide, leaks.WIDE, 1), (index.probe.narrow, leaks.NARROW, 0)):
            at, item, place = table.hits(leaks.hashes(flat)[which])
            want = set()
            for k, i in enumerate(index.items.values()):
                for p in table.place[table.item == k].tolist():
                    w = i.text[p : p + width]
                    want |= {(q, k, p) for q in range(len(flat) - width + 1) if flat[q : q + width] == w}
            assert set(zip(at.tolist(), item.tolist(), place.tolist())) == want


def test_texts_longer_than_a_probe(monkeypatch):
    monkeypatch.setattr(leaks, "PROBED", 100)
    assert found(FILL + " " + words(2, 0.2, 0.9) + " " + FILL + " EVAL-CANARY-0003aa-b-v1") == {2, 3}
    assert found(ZH[1][5:50] * 3) == {50}

"""Recall and precision on labelled cases that are made here: clean material is disguised by rule, so every true case is known."""

import random
import unicodedata

from pagewright.llm import langid, lookalike, pii, scan_noise, sentences

LINES = "doc_id bigint, page_no int, line_id int, text string, confidence float"
BLOCKS = "doc_id bigint, page_no int, block_no int, kind string, line_ids array<int>"
SENTENCES = {
    "en": ["The clerk sorted the grey folders before noon.", "A narrow cabinet holds the older letters, e.g. those of Mr. Harrow.", "Was the second drawer locked?", "The label at approx. 12.5 mm fell off.", "Nobody found the missing ledger on 4 May."],
    "de": ["Der Schreiber ordnete die grauen Mappen vor dem Mittag.", "Ein schmaler Schrank enthält die älteren Briefe, z. B. die von Fr. Harbach.", "War die zweite Lade verschlossen?", "Das Etikett bei ca. 12,5 mm fiel ab.", "Niemand fand das fehlende Buch am 4. Mai."],
    "ru": ["Служащий разложил серые папки до обеда.", "В узком шкафу лежат старые письма и т. д.", "Был ли второй ящик закрыт?", "Ярлык на стр. 12 отклеился.", "Никто не нашёл пропавшую книгу."],
    "zh": ["职员在中午以前整理了灰色的文件夹。", "窄柜子里放着比较旧的信件。", "第二个抽屉锁上了吗？", "标签在十二毫米处脱落了。", "没有人找到丢失的账本。"],
    "ja": ["係員は正午の前に灰色のフォルダを整理した。", "狭い棚には古い手紙が入っている。", "二番目の引き出しは閉まっていましたか。", "ラベルは十二ミリのところで剥がれた。", "誰も失われた帳簿を見つけなかった。"],
}


def frames(spark, texts):
    """A page for each text, its lines in one Paragraph block."""
    lines = [(1, p, i, t, 0.9) for p, own in enumerate(texts, 1) for i, t in enumerate(own, 1)]
    blocks = [(1, p, 1, "Paragraph", list(range(1, len(own) + 1))) for p, own in enumerate(texts, 1)]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(blocks, BLOCKS)


def rates(found, true):
    return len(found & true) / len(true), len(found & true) / max(1, len(found))


def test_sentence_ends(spark):
    rnd = random.Random(1)
    pages, true = [], set()
    for p in range(1, 121):
        lang = rnd.choice(list(SENTENCES))
        own = [rnd.choice(SENTENCES[lang]) for _ in range(4)]
        gap = "" if lang in ("zh", "ja") else " "
        text, ends = gap.join(own), []
        for s in own:
            ends.append((ends[-1] + len(gap) if ends else 0) + len(s))
        cut = ends[1]  # two lines
        pages.append([text[:cut], text[cut:].lstrip()])
        shift = cut + len(gap)
        true |= {(1, p, 1, ends[0]), (1, p, 1, ends[1]), (1, p, 2, ends[2] - shift), (1, p, 2, ends[3] - shift)}
    recall, precision = rates({tuple(r) for r in sentences.find_sentence_ends(*frames(spark, pages)).collect()}, true)
    assert recall >= 0.99 and precision >= 0.99, (recall, precision)


def test_personal_items(spark):
    rnd = random.Random(2)
    given, family = ["Torben", "Maelis", "Ysolde", "Oskar"], ["Bramdal", "Drasko", "Veldaan", "Kestrin"]
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    make = {
        "name": [lambda: f"{rnd.choice(given)} {rnd.choice(family)}", lambda: f"{rnd.choice(family)}, {rnd.choice(given)}", lambda: f"Dr. {rnd.choice(family)}", lambda: f"{rnd.choice('ABC')}. {rnd.choice(family)}"],
        "email": [lambda: f"{rnd.choice(given).lower()}.{rnd.choice(family).lower()}@skan.test", lambda: f"{rnd.choice(given).lower()} [at] inkwell[.]test"],
        "phone": [lambda: f"+44 7700 {digits(6)}", lambda: f"(020) 555-{digits(4)}", lambda: f"+49 30 {digits(7)}"],
        "national_id": [lambda: digits(11), lambda: f"AB {digits(2)} {digits(2)} {digits(2)} C", lambda: f"XY{digits(7)}"],
        "address": [lambda: f"{rnd.randint(1, 99)} Copper Lane, Millbrook {digits(5)}", lambda: f"Lindenweg {rnd.randint(1, 99)}, {digits(5)} Altstadt", lambda: f"P.O. Box {digits(3)}, Tollenwick {digits(5)}"],
    }
    plain = ["The folder was sent on under order no. 28233095 at noon.", "See figure 12 in file page_31657.png, version 4.8.67.", "Copper Lane was closed and the Bramdal lamp was sold.", "The price is 1,250.00 for lot 44-121212-3 of 2019."]
    pages, true = [], set()
    for p in range(1, 301):
        if p % 3 == 0:
            pages.append([rnd.choice(plain)])
            continue
        kind = rnd.choice(list(make))
        pages.append([f"The letter came from {rnd.choice(make[kind])()} and was filed."])
        true.add((1, p, 1, kind))
    names = spark.createDataFrame([(n, k, "Latin") for k, own in (("given", given), ("family", family)) for n in own], "name_part string, part_kind string, script string")
    recall, precision = rates({tuple(r) for r in pii.find_pii(*frames(spark, pages), names).collect()}, true)
    assert recall >= 0.97 and precision >= 0.97, (recall, precision)


def test_misread_words_and_division_marks(spark):
    rnd = random.Random(3)
    words = "folder cabinet letter drawer ledger window margin column template inventory committee signature envelope department furniture remainder machine document operator scanner".split()
    pages, true = [], set()
    for p in range(1, 401):
        own = [[rnd.choice(words) for _ in range(8)] for _ in range(3)]
        lines = [" ".join(x) for x in own]
        if p % 4 == 0:  # one wrong letter
            i, k = rnd.randrange(3), rnd.randrange(1, 7)
            printed = own[i][k]
            spots = [(c, alt) for c, alts in scan_noise.CONFUSIONS.items() for alt in alts if c in printed and printed.replace(c, alt, 1) not in words]
            c, alt = rnd.choice(spots)
            own[i][k] = printed.replace(c, alt, 1)
            lines[i] = " ".join(own[i])
            true.add((1, p, i + 1, "misread"))
        elif p % 4 == 1:  # a word over two lines
            last = own[0][-1]
            at = rnd.randint(3, len(last) - 3) if len(last) > 6 else 3
            lines[0], lines[1] = " ".join([*own[0][:-1], last[:at] + "-"]), f"{last[at:]} {lines[1]}"
            true.add((1, p, 1, "hyphen"))
        pages.append([x + "." if n == 2 else x for n, x in enumerate(lines)])
    recall, precision = rates({tuple(r) for r in scan_noise.find_noise(*frames(spark, pages)).collect()}, true)
    assert recall >= 0.95 and precision >= 0.95, (recall, precision)


def test_languages_of_files_and_blocks(spark):
    rnd = random.Random(4)
    langs = list(SENTENCES)
    docs = spark.createDataFrame([(k, " ".join(rnd.choices(SENTENCES[lang], k=6)), lang) for k in range(200) for lang in [rnd.choice(langs)]], "doc_id bigint, text string, lang string")
    models = spark.createDataFrame([(x, x.upper() + "_name", x + "-display", x + "-XX") for x in langs], "lang string, ocr_language string, display_name string, culture string")
    lines, blocks, options, true = [], [], [], set()
    for d in range(1, 101):
        main = rnd.choice(langs)
        label = rnd.choice([main, main.upper(), None, "klingon", rnd.choice(langs)])
        options.append((d, label))
        if label is None or label.lower() != main:
            true.add((d, 0, 0, main))
        for b in range(1, 7):
            lang = rnd.choice([x for x in langs if x != main]) if b == 3 and d % 2 else main
            text = rnd.choice(SENTENCES[lang])
            lines.append((d, 1, b, text, 0.9))
            blocks.append((d, 1, b, "Paragraph", [b]))
            if lang != main:
                true.add((d, 1, b, lang))
    found = langid.find_languages(spark.createDataFrame(lines, LINES), spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(options, "doc_id bigint, ocr_language string"), models, docs)
    recall, precision = rates({tuple(r) for r in found.collect()}, true)
    assert recall >= 0.97 and precision >= 0.97, (recall, precision)


def test_disguised_letters(spark):
    rnd = random.Random(5)
    wide = {c: chr(ord(c) + 0xFEE0) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}
    like = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х"}
    disguises = [
        lambda w: "".join(wide.get(c, c) for c in w), lambda w: w[:2] + "​" + w[2:], lambda w: unicodedata.normalize("NFD", w.replace("a", "á", 1)),
        lambda w: w[:1] + w[1:].translate(str.maketrans(like)) if any(c in like for c in w[1:]) else w + "⁠", lambda w: w + " ",
    ]
    rows, true = [], set()
    for i in range(1, 601):
        own = rnd.choice(SENTENCES[rnd.choice(["en", "de", "ru"])]).split()
        if i % 2:
            k = rnd.randrange(len(own) - 1)
            if own[k].isascii() and own[k].isalpha() and len(own[k]) > 3:
                word = own[k].lower()
                own[k] = rnd.choice(disguises)(word)
                if own[k] != word:
                    true.add((1, 1, i))
        rows.append((1, 1, i, " ".join(own), 0.9))
    recall, precision = rates({tuple(r) for r in lookalike.find_lookalikes(spark.createDataFrame(rows, LINES)).collect()}, true)
    assert recall >= 0.98 and precision >= 0.98, (recall, precision)

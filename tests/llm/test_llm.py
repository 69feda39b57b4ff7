"""The operators for training data on small fixtures: defined results, nulls, empties, repeats, clashing columns, long texts."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import encode, langid, leakage, linekinds, lookalike, pii, quality, scan_noise, sentences, shared_spans, wordlattice
from pyspark.sql import functions as F

LINES = "doc_id bigint, page_no int, line_id int, text string, confidence float"
BLOCKS = "doc_id bigint, page_no int, block_no int, kind string, line_ids array<int>"
NAMES = [("Torben", "given", "Latin"), ("Bramdal", "family", "Latin"), ("Sorvino-Kell", "family", "Latin"), ("Ярен", "given", "Cyrillic"), ("Драскин", "family", "Cyrillic"), ("透馬", "given", "Japanese"), ("水無峰", "family", "Japanese")]


def page(spark, texts, kind="Paragraph", doc=1):
    lines = [(doc, 1, i + 1, t, 0.9) for i, t in enumerate(texts)]
    blocks = [(doc, 1, 1, kind, list(range(1, len(texts) + 1)))]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(blocks, BLOCKS)


def cut(text):
    ends = [0, *sentences.sentence_ends(text), len(text)]
    return [text[a:b].strip() for a, b in zip(ends, ends[1:]) if text[a:b].strip()]


@pytest.mark.parametrize(
    "text,n",
    [
        ("The lamp is at approx. 11.73 mm. See No. 41383 in v8.5.7 as scan@2x.png. “Is it full?” asked the clerk.", 3),
        ("The note said, “Do not fold. Keep dry.” and nothing else. Next one.", 2),
        ("Frau B. Oduvale sortierte z. B. das Blatt am 4. Mai usw. Die Liste fehlt.", 2),
        ("Лоток и т. д. Оператор ждёт 01.05.2001 г. Посылка ушла в г. Мироречье, ул. Медная, д. 7.", 3),
        ("“纸盘满了吗？”助手在第5页问道。标签上写着“请勿折叠！”，编号是4。“今天放回了书架。”会议之前退回了清单。", 4),
        ("「用紙はありますか。」と助手が尋ねた。箱には「折らないで！」と書いてある。", 2),
        ("상자에는 “접지 마시오!”라고 적혀 있다. 두 번째 보고서는 고쳤다.", 2),
        ("« Ne pas plier ! » figurait là. Le bac p. ex. au feuillet 6.", 2),
        ("", 0),
    ],
)
def test_sentences(text, n):
    assert len(cut(text)) == n


def test_sentence_ends_over_lines(spark):
    lines, blocks = page(spark, ["One lamp. Two", "lamps stand.", None, "End"])
    got = sorted(tuple(r) for r in sentences.find_sentence_ends(lines.unionByName(lines), blocks.unionByName(blocks).withColumn("text", F.lit(1))).collect())
    assert got == [(1, 1, 1, 9), (1, 1, 2, 12), (1, 1, 4, 3)]


def test_list_item_is_one_unit(spark):
    lines, blocks = page(spark, ["1. Lamp. Tray 5"])
    assert [r.end_pos for r in sentences.find_sentence_ends(lines, blocks).collect()] == [15]


def test_pii(spark):
    texts = ["Torben Bramdal wrote to torben [at] inkwell.lab[.]test, Passport no. 26-97454-3 and 11112222333.", "Passport no. 33376747838 here, order no. 26-97454-3, order no. 28233095.", "Mail x@folio.test or +44 7700 9004301; file a@2x.png of Mrs Bramdal", "sent to P.O. Box 148, Tollenwick 59898. Dr. Sorvino-", "Kell came; 水無峰透馬", ""]
    lines, blocks = page(spark, texts)
    names = spark.createDataFrame(NAMES, "name_part string, part_kind string, script string")
    got = {(r.line_id, r.pii_type) for r in pii.find_pii(lines.unionByName(lines), blocks, names).collect()}
    assert got == {(1, "name"), (1, "email"), (1, "national_id"), (2, "national_id"), (3, "email"), (3, "phone"), (4, "address"), (4, "name"), (5, "name")}
    out = {r.line_id: r.text for r in pii.redact(lines, blocks, names).collect()}
    assert out[2] == "Passport no. [NATIONAL_ID] here, order no. 26-97454-3, order no. 28233095." and out[6] == ""
    assert out[1].startswith("[NAME] wrote to [EMAIL], Passport no. [NATIONAL_ID]")
    assert pii.find_pii(lines.limit(0), blocks, names).count() == 0


def test_lookalikes(spark):
    cases = {"plain text": False, "drɑft": True, "the соver": True, "ｍａｒｇｉｎ": True, "6º B № 5": False, "a b": True, "le​ft": True, "Tabe\xad": False, "été": True, "pyкoпиcнyю заметку": True, "⽇期": True, "，。（）": False, "   ": False, "Пишите на x@tray.test. Не": False, "ｶﾞ": True}
    lines = spark.createDataFrame([(1, 1, i, t, 0.9) for i, t in enumerate(cases)] + [(1, 1, 99, None, None)], LINES)
    got = {r.line_id for r in lookalike.find_lookalikes(lines).collect()}
    assert got == {i for i, (t, hit) in enumerate(cases.items()) if hit}
    assert [lookalike.unify(t) for t in ("drɑft", "the соver", "ｍａｒｇｉｎ", "pyкoпиcнyю", "le​ft")] == ["draft", "the cover", "margin", "рукописную", "left"]
    assert lookalike.unify_lines(lines).count() == len(cases) + 1


def test_scan_noise(spark):
    rows, blocks = [], []
    for p in range(1, 9):
        texts = ["Lower inventory and narrow column" if p != 3 else "Lower inventory and narrcw column", "The oversized template covered the figure and the modern catalo-", "gue beside the two-", "column index. The oversized tray", "oversized template figure modern catalogue two-column index", f"– {p} –"]
        if p == 5:
            texts[3] = "column index. The ovcrsized tray"
        for i, t in enumerate(texts):
            rows.append((1, p, i + 1, t, 0.9))
        blocks += [(1, p, 1, "Paragraph", [1]), (1, p, 2, "Paragraph", [2, 3, 4, 5]), (1, p, 3, "Paragraph", [6])]
    lines = spark.createDataFrame(rows, LINES)
    got = {tuple(r) for r in scan_noise.find_noise(lines.unionByName(lines), spark.createDataFrame(blocks, BLOCKS)).collect()}
    want = {(1, p, 1, "running") for p in range(1, 9)} | {(1, p, 2, "hyphen") for p in range(1, 9)} | {(1, p, 6, "page_no") for p in range(1, 9)} | {(1, 5, 4, "misread")}
    assert got == want
    assert scan_noise.find_noise(lines.limit(0), spark.createDataFrame(blocks, BLOCKS)).count() == 0


def test_paragraphs_without_noise(spark):
    rows, blocks = [], []
    for p in range(1, 13):
        texts = ["Upper ledger and grey column", "The oversized template covered the figure and the modern catalo-", "gue beside the two-", "column index. The oversized tray.", f"Page {p}", "The second modern figure stood beside the oversized template and a modern fi-"]
        if p == 2:
            texts[3] = "column index. The ovcrsized tray."
        for i, t in enumerate(texts, 1):
            rows.append((1, p, i, t, 0.9))
        # odd pages end in a cut word, even ones begin with its rest
        rows += [(1, p, 7, "gure of the oversized tray.", 0.9), (1, p, 8, "The second tray.", 0.9)]
        first, last = ([7, 8], []) if p % 2 == 0 else ([], [8, 6])
        blocks += [(1, p, k, "Paragraph", ids) for k, ids in enumerate(([1], first, [2, 3, 4], last, [5]), 1) if ids]
    rows += [(2, 1, i, "a modern figure and the modern catalogue of the two-column index", 0.9) for i in range(1, 30)]
    blocks += [(2, 1, 1, "Paragraph", list(range(1, 30)))]
    lines, blocks = spark.createDataFrame(rows, LINES), spark.createDataFrame(blocks, BLOCKS)
    got = {(r.doc_id, r.page_no, r.block_no): (r.last_page, r.last_block, r.text) for r in scan_noise.find_paragraphs(lines.unionByName(lines), blocks).collect()}
    whole = "The oversized template covered the figure and the modern catalogue beside the two-column index. The oversized tray."
    want = {(1, p, 3): (p, 3, whole) for p in range(1, 13)}
    want |= {(1, p, 4): (p + 1, 2, "The second tray. The second modern figure stood beside the oversized template and a modern figure of the oversized tray. The second tray.") for p in range(1, 13, 2)}
    assert {k: v for k, v in got.items() if k[0] == 1} == want
    noise = {tuple(r) for r in scan_noise.find_noise(lines, blocks).collect()}
    assert {(1, p, 6, "hyphen") for p in range(1, 13, 2)} <= noise


@pytest.mark.parametrize("printed,read,is_so", [("figure", "figurc", True), ("summarized", "surnmarized", True), ("the", "the", False), ("file", "tile", False), ("ef", "cf", True), ("et", "cf", False), ("torn", "to·rn", True)])
def test_derives(printed, read, is_so):
    assert scan_noise.derives(printed, read) is is_so


def test_languages(spark):
    words = {"en": "the lamp stands under a grey cover and no sheet of paper was lost", "de": "die Lampe steht unter dem grauen Deckel und kein Blatt fehlt", "ru": "лампа стоит под серой крышкой и лист не потерян"}
    docs = spark.createDataFrame([(i * 3 + k, " ".join(w.split() * 3), lang) for i in range(20) for k, (lang, w) in enumerate(words.items())], "doc_id bigint, text string, lang string")
    lines = [(d, 1, i, t, 0.9) for d, own in ((1, ["en", "en", "de"]), (2, ["ru", "ru", "ru"]), (3, ["de"])) for i, t in enumerate((words[x] + "." for x in own), 1)]
    blocks = [(d, 1, i, "Paragraph", [i]) for d, _, i, *_ in lines]
    options = spark.createDataFrame([(1, "EN_us"), (2, None), (3, "Deutsch"), (3, "Deutsch")], "doc_id bigint, ocr_language string")
    models = spark.createDataFrame([("en", "English", "English", "en-US"), ("de", "German", "Deutsch", "de-DE"), ("ru", "Russian", "Русский", "ru-RU")], "lang string, ocr_language string, display_name string, culture string")
    got = {tuple(r) for r in langid.find_languages(spark.createDataFrame(lines, LINES), spark.createDataFrame(blocks, BLOCKS), options, models, docs).collect()}
    assert got == {(2, 0, 0, "ru"), (1, 1, 3, "de")}


def test_quality(spark):
    rows, blocks = [], []
    for doc, texts in enumerate((["The grey lamp stood beside the window all day long."] * 4, ["- lamp", "- tray", "- box"], ["tray  11  22.5  40%", "lamp  1  —  3%"], ["<|}{^%~|", "tjbd tlknh wnk qtnhz", "olololololol"]), 1):
        for i, t in enumerate(texts, 1):
            rows.append((doc, 1, i, t, 90.0))
            blocks.append((doc, 1, i, "Paragraph", [i]))
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "doc_id bigint")
    args = docs, spark.createDataFrame(rows, LINES), spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame([("en", "the", 1)], "lang string, word string, word_rank int")
    assert {tuple(r) for r in quality.find_not_prose(*args).collect()} == {(2, "list"), (3, "table"), (4, "junk")}
    stats = {r.doc_id: r for r in quality.text_statistics(*args).collect()}
    assert len(stats) == 5 and stats[1].words == 40 and stats[1].common_share == 0.2 and stats[1].mean_confidence == 0.9 and stats[5].lines == 0 and stats[5].text_class is None


def test_line_kinds():
    assert linekinds.is_page_number("Page 2 of 4") and linekinds.is_page_number("– 1 –") and not linekinds.is_page_number("No. 5 lamp")
    assert linekinds.is_junk("Ð¿Ñ€Ð¸| Ã¤Ã¼Ã#") and not linekinds.is_junk("Tel. (555) 010-6623") and not linekinds.is_junk("[1]")


def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rnd = random.Random(1)
    bits = ["lamp", " tray", "  ", "\n\n", "'s", "。", "データ", "ключ", "’", " ", "　", "<|endoftext|>", "é", "🙂", "12", "..", "'", "한국"]
    texts = ["".join(rnd.choice(bits) for _ in range(n)) for n in (0, 1, 5, 400, 30_000)] + [None, "", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    path = encode.vocabulary_path()
    for x in texts[:5]:
        assert encode.encode_text(x, path) == t.encode(x, add_special_tokens=False).ids
        parts = encode.cut(x.encode(), encode.load(path)[1])
        assert b"".join(parts) == x.encode() and (len(x) < 9 or len(parts) > 1)  # short texts are cut as well


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 '\n\ts é中😀.-\u3000\u00a0\u2003ll")), max_size=40))
def test_cuts_change_no_id(text):
    path = encode.vocabulary_path()
    assert encode.encode_text(text, path) == encode.load(path)[0].encode_ordinary(text)


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    vocab = ["lamp", "tray", "the", "of", "box", "grey", "fold", "sheet"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate((20, 25, 12, 11, 5))] + [(9, None)]
    docs = []
    for k in range(60):
        own = [rnd.choice(vocab) for _ in range(30)]
        if k % 3 == 0:
            src = items[k % 4][1].split()
            a = rnd.randint(0, max(0, len(src) - 12))
            own[5:5] = src[a : a + rnd.choice([11, 12, 15])]
        docs.append((k, rnd.choice([", ", " ", "\n"]).join(own).upper()))
    docs += [(100, None), (101, "")]
    idx = defaultdict(set)
    for i, p in items:
        w = leakage.words(p or "")
        for s in range(len(w) - 11):
            idx[tuple(w[s : s + 12])].add(i)
    want = {(k, i) for k, t in docs for s in range(len(leakage.words(t or "")) - 11) for i in idx.get(tuple(leakage.words(t)[s : s + 12]), ())}
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string"))
    assert {tuple(r) for r in got.collect()} == want and want


def test_shared_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    words = ["lamp ", "tray\n", "灰色的信封", "ключ ", "🙂", "box  "]
    piece = lambda n: "".join(rnd.choice(words) + rnd.choice("abcdefgh") for _ in range(n))[:n]
    stock = [piece(n) for n in (199, 200, 201, 260, 900)]
    docs = []
    for k in range(40):
        text = piece(rnd.randint(0, 300))
        if k % 2:
            text += rnd.choice(stock) + piece(rnd.randint(0, 200))
        docs.append((k, text))
    docs += [(50, docs[1][1]), (51, docs[1][1]), (60, "ol" * 300), (61, "ol" * 150), (62, None), (63, ""), (64, stock[4] * 3)]
    win = defaultdict(set)
    for k, t in docs:
        for i in range(len(t or "") - 199):
            win[t[i : i + 200]].add(k)
    want = {(a, b) for own in win.values() for a in own for b in own if a < b}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("fp", F.lit(0)).repartition(3)
    assert {tuple(r) for r in shared_spans.find_pairs(df).collect()} == want and len(want) > 30
    assert shared_spans.find_pairs(df.limit(0)).count() == 0


def test_queries_are_named_by_problem():
    from pagewright.llm import oracle, queries

    names = set(queries.queries())
    assert all(re.match(r"p[1-9]_", n) for n in names) and {n[1] for n in names} == set("123456789") and set(oracle.oracle_sql()) <= names


def test_shared_spans_and_share_equal_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcde fgh\n") for _ in range(n))
    one, two, head = word(900), word(400), word(230)
    texts = [word(50) + one + word(80), word(300) + one[100:460] + word(20) + two, two[:199] + word(300) + two[200:], head + word(400), head + word(10) + head, word(150) + one[300:499] + word(100), one, one, word(500), None, ""]
    texts += [head[k:] + word(30 + k) for k in range(0, 60, 7)]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    owners = defaultdict(set)
    for d, t in enumerate(texts, 1):
        for i in range(len(t or "") - 199):
            owners[t[i : i + 200]].add(d)
    want, share = set(), {}
    for d, t in enumerate(texts, 1):
        t = t or ""
        spans = shared_spans.merged([(i, i + 200) for i in range(len(t) - 199) if len(owners[t[i : i + 200]]) > 1])
        want |= {(d, a, b - a) for a, b in spans}
        share[d] = (len(t), sum(b - a for a, b in spans))
    assert {tuple(r) for r in shared_spans.find_spans(docs).collect()} == want and len(want) > 10
    got = {r.doc_id: r for r in shared_spans.shared_share(docs).collect()}
    assert {d: (r.n_chars, r.shared_chars) for d, r in got.items()} == share
    assert all(r.share == (r.shared_chars / r.n_chars if r.n_chars else 0) for r in got.values())


def spaceless(spark, extra):
    """A corpus of short Chinese sentences with full stops, and the extra blocks behind it."""
    known = ["今天上午整理员放回了旧书架。", "昨天下午管理员退回了新清单。", "会议之前值班员检查了灰信封。"]
    texts = [known[k % 3] + known[(k + 1) % 3] for k in range(60)] + extra
    lines = [(1, i, 1, t, 0.9) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(lines, LINES), spark.createDataFrame([(1, i, 1, "Paragraph", [1]) for i in range(1, len(texts) + 1)], BLOCKS)


def test_spaceless_gaps_need_the_lattice(spark):
    """Sentences without any mark are found by their words; without the dictionary they are not."""
    silent = ["今天上午整理员放回了旧书架 昨天下午管理员退回了新清单", "会议之前值班员检查了灰信封今天上午整理员放回了旧书架"]
    lines, blocks = spaceless(spark, silent)
    rows = lambda df: {tuple(r) for r in df.collect() if r.page_no > 60}
    ends = [silent[0].index(" "), silent[1].index("今天")]
    assert rows(sentences.find_sentence_ends(lines, blocks)) == {(1, 61, 1, ends[0]), (1, 61, 1, len(silent[0])), (1, 62, 1, ends[1]), (1, 62, 1, len(silent[1]))}
    assert [sentences.sentence_ends(t) for t in silent] == [[], []]
    words = wordlattice.fit(lines)
    lattice = wordlattice.Lattice(words)
    assert words[""][1] < 0 and lattice.score("信封", 0) > 1 and lattice.score("今天", 1) > 1 > lattice.score("信封", 1)
    assert wordlattice.fit(lines.limit(0)) == {}


def test_best_path_equals_brute_force():
    rnd = random.Random(4)
    words = {"".join(rnd.choice("今天昨书架") for _ in range(rnd.randint(1, 4))): (rnd.random() * 9, 0.0, 0.0) for _ in range(40)}
    lattice = wordlattice.Lattice(words)
    cost = lambda w: words[w][0] if w in words else lattice.unknown if len(w) == 1 else float("inf")

    def best(run):
        return 0.0 if not run else min(cost(run[:k]) + best(run[k:]) for k in range(1, min(4, len(run)) + 1))

    for _ in range(60):
        run = "".join(rnd.choice("今天昨书架") for _ in range(rnd.randint(1, 9)))
        ends = lattice.segment(run)
        assert ends[-1] == len(run) and abs(sum(cost(run[a:b]) for a, b in zip([0, *ends], ends)) - best(run)) < 1e-9


def test_disclosure_decides_ambiguous_numbers(spark):
    """The same shape is personal behind a term that clear items have, and none behind one that innocent ones have; clear shapes stay whatever the term."""
    texts = ["Passport no. 33376747838 came.", "passport no. 11112222333 left.", "order no. 28233095 came.", "order no. 28233096 left.", "passport no. 26-97454-3 is here.", "order no. 26-97454-4 is here.", "order no. 33376747839 is odd.", "call +44 7700 9004301 now", "call 312-4477 now", "order no. 312-4478 now", "〒435-9828"]
    lines, blocks = page(spark, texts)
    blocks = spark.createDataFrame([(1, 1, i, "Paragraph", [i]) for i in range(1, len(texts) + 1)], BLOCKS)
    names = spark.createDataFrame(NAMES, "name_part string, part_kind string, script string")
    got = {(r.line_id, r.pii_type) for r in pii.find_pii(lines, blocks, names).collect()}
    assert got == {(1, "national_id"), (2, "national_id"), (5, "national_id"), (7, "national_id"), (8, "phone"), (9, "phone"), (11, "address")}
    bits = {(r.pii_type, r.term): r.bits for r in pii.term_disclosure(pii.candidates(lines, blocks, names)).collect()}
    assert bits["national_id", "passport no"] > 0 > bits["national_id", "order no"]
    clear = lines.where("line_id between 3 and 6")  # without clear items behind it, a term discloses nothing
    assert (5, "national_id") not in {(r.line_id, r.pii_type) for r in pii.find_pii(clear, blocks, names).collect()}


def test_quality_ties_go_by_rules_and_words_over_page_ends_count_once(spark):
    rows, blocks = [], []
    for doc, texts in enumerate((["The lamp of the hall is in the box of the clerk, as it is", "- lamp", "- tray", "The tray of the hall is in the lamp"], ["The lamp stood in the hall beside the old cata-"]), 1):
        for i, t in enumerate(texts, 1):
            rows.append((doc, 1, i, t, 0.9))
            blocks.append((doc, 1, i, "Paragraph", [i]))
    rows += [(2, 2, 1, "logue of the house, and it stood there for long.", 0.9)]
    blocks += [(2, 2, 1, "Paragraph", [1])]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    frequent = lambda words: spark.createDataFrame([("en", w, 1) for w in words], "lang string, word string, word_rank int")
    own = docs, spark.createDataFrame(rows, LINES), spark.createDataFrame(blocks, BLOCKS)
    stats = {r.doc_id: r for r in quality.text_statistics(*own, frequent(["the", "of", "is", "in"])).collect()}
    assert (stats[1].prose_lines, stats[1].list_lines) in ((1, 3), (2, 2)) and stats[1].words_common and stats[2].words == 19
    assert not {r.doc_id: r for r in quality.text_statistics(*own, frequent(["zzz"])).collect()}[1].words_common


def test_noise_filter_keeps_its_recall_in_a_large_vocabulary(spark):
    """Half a million forms beside the planted ones: the filter grows, nothing is lost, and hardly anything is there by chance."""
    word = F.concat_ws(" ", F.lit("x"), *[F.concat(F.lit(c), F.translate(F.conv((F.col("id") * 8 + k).cast("string"), 10, 20), "0123456789", "klmnopqrst")) for k, c in enumerate("abdefghi")])
    vocabulary = spark.range(0, 60_000).select(word.alias("text"))
    planted = spark.createDataFrame([("a oversized template stood here",)] * 40 + [("a ovcrsized ternplate",)], "text string")
    lines = vocabulary.unionByName(vocabulary).unionByName(vocabulary).unionByName(planted)
    packed = scan_noise.build_filter(lines)
    known = scan_noise.Filter(packed)
    assert all(f"g:{w}" in known for w in ("oversized", "template")) and all(f"m:{w}" in known for w in ("ovcrsized", "ternplate"))
    assert len(packed) >= 2 and sum(f"m:never{i}" in known for i in range(20_000)) < 100
    some = [r[0].split()[3] for r in vocabulary.limit(2000).collect()]
    assert all(f"g:{scan_noise.token_form(w)}" in known for w in some)


def test_near_matches_equal_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(14)]
    items = [(i, [rnd.choice(vocab) for _ in range(rnd.choice([12, 13, 18, 22]))]) for i in range(6)]
    docs = []
    for k in range(50):
        own = [rnd.choice(vocab) for _ in range(rnd.randint(5, 30))]
        src = list(items[k % 6][1])
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(src))
            src[at : at + 1] = rnd.choice([[], ["zz"], [src[at], "zz"]])
        docs.append((k, own + src + own[:4]))
    lcs = leakage.common_words
    want = {}
    for d, text in docs:
        for i, own in items:
            if any(text[a : a + 12] == own[s : s + 12] for s in range(len(own) - 11) for a in range(len(text) - 11)):
                continue
            n = min(15, len(own))
            best = max((lcs(own[s : s + n], text[q : q + n + 3]) for s in range(len(own) - n + 1) for q in range(len(text))), default=0)
            if best >= 12:
                want[d, i] = best
    found = leakage.find_matches(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id bigint, passage string"))
    assert {(r.doc_id, r.item_id): r.words for r in found.where("kind = 'near'").collect()} == want and len(want) > 5


def test_common_words_is_a_longest_common_subsequence():
    rnd = random.Random(7)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        assert leakage.common_words(a, b) == row[-1]


def test_case_of_passages_does_not_matter(spark):
    words = "Die Straße liegt außen vor dem großen Haus und der Fluß ist weiß".split()
    docs = spark.createDataFrame([(1, " ".join(words).upper())], "doc_id bigint, text string")
    assert leakage.find_leaks(docs, spark.createDataFrame([(7, " ".join(words))], "item_id bigint, passage string")).count() == 1


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_A_PASS", 2)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(7)]
    found = leakage.find_leaks(spark.createDataFrame([(i, p) for i, p in items], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, passage string"))
    assert {tuple(r) for r in found.collect()} == {(i, i) for i in range(7)}


def test_hot_letterheads_are_no_pairs(spark, monkeypatch):
    """A letterhead just short of a span with many surroundings gives no candidates; one that is long enough gives all its pairs."""
    monkeypatch.setattr(shared_spans, "HOT", 8)
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefghij klmn") for _ in range(n))
    short, long = noise(192), noise(215)
    docs = [(k, noise(80) + short + noise(80)) for k in range(40)] + [(100 + k, noise(30) + long[: 200 + k] + noise(40)) for k in range(14)]
    win = defaultdict(set)
    for d, t in docs:
        for i in range(len(t) - 199):
            win[t[i : i + 200]].add(d)
    want = {(a, b) for own in win.values() for a in own for b in own if a < b}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {tuple(r) for r in shared_spans.find_pairs(df).collect()} == want and len(want) == 91
    spans = {(d, a, b - a) for d, t in docs for a, b in shared_spans.merged([(i, i + 200) for i in range(len(t) - 199) if len(win[t[i : i + 200]]) > 1])}
    assert {tuple(r) for r in shared_spans.find_spans(df).collect()} == spans
    classes = {r.doc_id: (r.class_id, r.links) for r in shared_spans.link_classes(df.unionByName(df.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))).collect()}
    assert classes[1100] == classes[100] == (100, 13) and classes[1] == (1, 0) and classes[1001] == (1, 0)


def test_segments_of_mixed_blocks(spark):
    words = {"en": "the lamp stands under a grey cover and no sheet of paper was lost", "de": "die Lampe steht unter dem grauen Deckel und kein Blatt fehlt"}
    docs = spark.createDataFrame([(i * 2 + k, " ".join(w.split() * 3), lang) for i in range(20) for k, (lang, w) in enumerate(words.items())], "doc_id bigint, text string, lang string")
    models = spark.createDataFrame([("en", "English", "English", "en-US"), ("de", "German", "Deutsch", "de-DE")], "lang string, ocr_language string, display_name string, culture string")
    lines, blocks = page(spark, [words["en"], "12.5", words["de"], words["de"], words["en"]])
    got = sorted(tuple(r)[3:6] for r in langid.language_segments(lines, blocks, models, docs).collect())
    assert got in ([(1, 2, "en"), (3, 4, "de"), (5, 5, "en")], [(1, 1, "en"), (2, 4, "de"), (5, 5, "en")])
    assert langid.segments([], 2) == []


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from pagewright.llm import common

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda name, other: None)})

    with pytest.raises(ValueError):
        common.shared_dir(Session())
    path = common.staged(spark.range(3), "gone")
    assert path.count() == 3


def test_unsure_lines_are_no_evidence_for_misread_forms(spark):
    """A misread form that stands on many unsure lines stays misread; on sure lines as often, it is a word."""
    texts = ["the oversized template stood here"] * 40 + ["the ovcrsized template stood here"] * 6
    blocks = spark.createDataFrame([(1, 1, 1, "Paragraph", list(range(1, 47)))], BLOCKS)
    for conf, n in ((0.4, 6), (0.95, 0), (40.0, 6)):
        lines = spark.createDataFrame([(1, 1, i, t, conf if i > 40 else 0.95) for i, t in enumerate(texts, 1)], LINES)
        assert sum(r.noise == "misread" for r in scan_noise.find_noise(lines, blocks).collect()) == n

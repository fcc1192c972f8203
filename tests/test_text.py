"""Kernels on small texts: folding, matching, segments and tokens."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from groundwork.functions import folding, matching
from groundwork.functions.kernels import segments_with_tokens
from groundwork.functions.languages import PACKS, Pack, bounded, packs_of, rules_of, uncovered
from groundwork.functions.matching import Hay
from groundwork.functions.segmenting import Segmenter, blocks_of, script_of

SEGMENTER, RULES = Segmenter(packs_of()), rules_of(packs_of())


def tokens(text):
    return [(t["kind"], t["text"]) for s in segments_with_tokens(text, SEGMENTER, RULES) for t in s["tokens"]]


@pytest.mark.parametrize(
    ("left", "right", "same"),
    [("Straße", "STRASSE", True), ("ＡＢＣ", "abc", True), ("１２３", "123", True), ("a  b", "a b", True), ("か\u3099", "が", True), ("ｶﾞ", "ガ", False), ("kg", "mg", False)],
)
def test_folding_makes_spellings_equal(left, right, same):
    assert (folding.fold(left).text == folding.fold(right).text) is same


def test_folded_places_map_back_to_the_original():
    form = folding.fold("  Straße １２ ㎏")
    at = form.text.index("12")
    assert form.original[slice(*form.back(at, at + 2))] == "１２"
    assert form.back(3, 3) == (0, 0)


@pytest.mark.parametrize(
    ("needle", "hay", "n"),
    [
        ("12 kg", "it weighs 12 kg", 1), ("12 kg", "it weighs 12kg", 1), ("12", "it weighs 112", 0), ("12", "12.5", 0), ("12", "12.", 1),
        ("1,234", "1,234", 1), ("234", "1,234", 0), ("234", "a 1, 234", 1), ("2024", "2024, 300", 1), ("三", "三十", 0), ("ab", "cab", 0), ("1212", "121212", 0),
    ],
)
def test_a_token_must_stand_alone(needle, hay, n):
    assert len(matching.places(folding.fold(needle).text, Hay.of(hay))) == n


@pytest.mark.parametrize(
    ("needle", "hay", "places"),
    [
        # a number inside a longer one
        ("7.5", "a crate of 7.50 kg", []), ("7.5", "a crate of 17.5 kg", []), ("7.5", "a crate of 17.55 kg", []), ("40", "400 in all", []), ("40", "140 in all", []),
        ("400", "sum: 3.400", []), ("五千人", "二万五千人", []), ("3,400", "sum: 23,400", []), ("45", "cap 45,000", []), ("000", "cap 45,000", []), ("678", "5,678,901", []),
        ("3.1", "within 23.15 mm", []), ("12", "10:12", ["12"]), ("12", "2024-12,345", ["12"]), ("2024", "in 3/2024,500 more", ["2024"]),
        # the number itself
        ("7.5", "just 7.5kg", ["7.5"]), ("40", "40 were seen", ["40"]), ("40", "we saw 40", ["40"]), ("五千人", "数は五千人でした", ["五千人"]), ("2025-01-31", "by 2025-01-31.", ["2025-01-31"]),
        ("45,000", "cap 45,000", ["45,000"]), ("iso 9001", "under ISO 9001", ["ISO 9001"]), ("abc", "abcde", []),
        # white space inside is free, digits aren't
        ("7.5kg", "at 7.5 kg", ["7.5 kg"]), ("7.5 kg", "at 7.5kg", ["7.5kg"]), ("第12条", "第 12 条", ["第 12 条"]), ("$9,500", "for $ 9,500", ["$ 9,500"]), ("7.5kg", "at 7.6 kg", []),
        # commas
        ("3", "见第3，5，7条。", ["3"]), ("5", "见第3，5，7条。", ["5"]), ("7", "见第3，5，7条。", ["7"]), ("12", "寸法は 12，34 です", ["12"]), ("60", "at 60,5 m", ["60"]),
        ("60", "at 60,50 m", ["60"]), ("60", "at 60,500 m", []), ("60", "at 60,5000 m", ["60"]), ("30", "2026-08-30，245kg", ["30"]), ("４５", "４５，０００円", []),
    ],
)
def test_where_a_token_stands(needle, hay, places):
    assert [hay[a:b] for a, b in matching.places(folding.fold(needle).text, Hay.of(hay))] == places


@given(st.text(st.sampled_from("12,.三万aZ -/１，"), max_size=14), st.sampled_from(["1", "12", "1,2", "2.1", "三", "万三", "a", "az", "1 a", "12,111"]))
@settings(max_examples=400, deadline=None)
def test_tokens_never_stand_beside_their_own_sort(text, needle):
    form = folding.fold(needle).text
    hay = Hay.of(text)
    for a, b in matching.places(form, hay):
        for inner, outer in ((text[a], text[a - 1 : a]), (text[b - 1], text[b : b + 1])):
            for sort in (str.isdigit, "三万".__contains__, lambda c: c.isascii() and c.isalpha()):
                assert not outer or not (sort(folding.fold(inner).text or " ") and sort(folding.fold(outer).text or " "))
        assert folding.fold(text[a:b]).text.replace(" ", "") == form.replace(" ", "")


@given(st.text(st.sampled_from("12,. 三万aZé田中 -"), max_size=16), st.text(st.sampled_from("12,. 三万aé田中-"), min_size=1, max_size=8), st.sampled_from(matching.MATCHERS))
@settings(max_examples=3000, deadline=None)
def test_text_that_holds_a_token_has_one_of_its_words(text, needle, matcher):
    form, hay = folding.fold(needle).text, Hay.of(text + needle + text[:3])
    keys = matching.keys_of(form, matcher)
    words = {re.sub(r"\s", "", m) for pattern in (matching.DIGIT_RUNS, matching.OTHER_RUNS, matching.PAIRS, *matching.DIGIT_CHAINS) for m in re.findall(pattern, hay.form.text)}
    if matching.places(form, hay, matcher):
        assert not keys or words & set(keys)
        assert matching.probe_of(form) in hay.form.text


@pytest.mark.parametrize(
    ("form", "keys"),
    [("12 kg", ["12"]), ("2024-05-06", ["2024-05-06"]), ("$1,234.50", ["1,234.50"]), ("1 - 2", ["1-2"]), ("anne whitfield", ["anne", "annewhitfield"]), ("12 34", ["12", "1234"]), ("田中", ["田中"]), ("三千人", ["三千"]), ("李", []), ("a 1 b", ["1"])],
)
def test_words_that_a_token_is_looked_up_by(form, keys):
    assert matching.keys_of(form) == keys


def test_digits_are_those_of_the_language():
    wrong = [c for c in map(chr, range(0x110000)) if c.isdigit() != bool(re.match(f"[{folding.DIGIT}]", c))]
    assert wrong == []


def test_exact_matching_keeps_spacing_and_unknown_matchers_are_refused():
    hay = Hay.of("it weighs 12kg")
    assert matching.places("12 kg", hay, "normalized") and not matching.places("12 kg", hay, "exact")
    with pytest.raises(ValueError):
        matching.places("12", hay, "fuzzy")


def test_places_stop_at_the_limit():
    assert len(matching.places("7", Hay.of("7 " * 100))) == matching.PLACE_LIMIT


@pytest.mark.parametrize(
    ("text", "cuts"),
    [
        ("One. Two.", ["One.", "Two."]), ("It costs 3.50 today. Yes.", ["It costs 3.50 today.", "Yes."]), ("Mr. Ray left. Then he came.", ["Mr. Ray left.", "Then he came."]),
        ("一つ。二つ。", ["一つ。", "二つ。"]), ("no stop\nat all", ["no stop", "at all"]), ("# Head\n- one\n- two", ["# Head", "- one", "- two"]),
        ("```\ncode\n```\nText.", ["```\ncode\n```", "Text."]), ("He said (see a. b.) so. End.", ["He said (see a. b.) so.", "End."]), ("", []), (" \n ", []),
    ],
)
def test_segments(text, cuts):
    assert [text[s.start : s.end] for s in SEGMENTER.segments_of(text)] == cuts


@pytest.mark.parametrize(
    ("text", "cuts"),
    [
        # every script by its own marks, side by side
        ("軽い箱。重さは 7.5kg。前より 20g 軽い。", ["軽い箱。", "重さは 7.5kg。", "前より 20g 軽い。"]), ("箱子很轻。重 7.5 公斤。", ["箱子很轻。", "重 7.5 公斤。"]),
        ("軽い箱。The box is light. 重さは 7.5kg。", ["軽い箱。", "The box is light.", "重さは 7.5kg。"]),
        # stops that end nothing
        ("It weighs 7.5 kilograms.", ["It weighs 7.5 kilograms."]), ("Go to example.org for it.", ["Go to example.org for it."]), ("See Fig. 3 there.", ["See Fig. 3 there."]),
        ("Take 5mg b.i.d. for a week.", ["Take 5mg b.i.d. for a week."]), ("Under Art. 12 of it.", ["Under Art. 12 of it."]), ("Ask Dr. Sato about it.", ["Ask Dr. Sato about it."]),
        ("Bring food, e.g. bread.", ["Bring food, e.g. bread."]), ("Acme Inc. made it.", ["Acme Inc. made it."]), ("By A. Jones and B. Lee.", ["By A. Jones and B. Lee."]),
        ("So light... and cheap.", ["So light... and cheap."]), ("In the U.S. they do.", ["In the U.S. they do."]),
        # runs and ends
        ("Light? Yes! Very.", ["Light?", "Yes!", "Very."]), ("Light?! Yes.", ["Light?!", "Yes."]), ("It is light. It weighs", ["It is light.", "It weighs"]),
        ('He said "go." Then left.', ['He said "go."', "Then left."]), ("It ends with etc.", ["It ends with etc."]), ("One etc. Two.", ["One etc. Two."]),
        # brackets
        ("「軽い箱。」と書く。重さは 7.5kg。", ["「軽い箱。」と書く。", "重さは 7.5kg。"]), ("（軽い箱。）重さは 7.5kg。", ["（軽い箱。）重さは 7.5kg。"]), ("a) One. b) Two.", ["a) One.", "b) Two."]),
        # lines and structures
        ("The box is\nlight. It weighs\n7kg.", ["The box is\nlight.", "It weighs\n7kg."]), ("箱は 7kg\n袋は 8g", ["箱は 7kg", "袋は 8g"]),
        ("Sum:\n\n| a | b |\n|---|---|\n| 1 | 2 |", ["Sum:", "| a | b |", "|---|---|", "| 1 | 2 |"]), ("  - one  \n\t2) two", ["- one", "2) two"]),
        ("Run.\n\n```py\nx = 1.5\n~~~\n\ny. z\n```\n\nDone.", ["Run.", "```py\nx = 1.5\n~~~\n\ny. z\n```", "Done."]), ("Here:\n~~~\nx = 1\n\n", ["Here:", "~~~\nx = 1"]),
    ],
)
def test_where_segments_are_cut(text, cuts):
    assert [text[s.start : s.end] for s in SEGMENTER.segments_of(text)] == cuts


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("# Head", "heading"), ("### Head", "heading"), ("- one", "list_item"), ("* one", "list_item"), ("— one", "list_item"), ("・一つ", "list_item"), ("1. one", "list_item"),
        ("12) one", "list_item"), ("3、三つ", "prose"), ("3、 三つ", "list_item"), ("①. one", "list_item"), ("7.", "list_item"), ("| a |", "table_row"), ("> said", "quote"), ("```", "code"),
        ("#1 is it", "prose"), ("#", "prose"), ("-", "prose"), ("-one", "prose"), ("1.one", "prose"), ("x. one", "prose"), ("``", "prose"),
    ],
)
def test_kinds_of_lines(line, kind):
    assert [k for _, _, k in blocks_of(f" {line} ")] == [kind]


def test_boundaries_say_why_a_segment_ends():
    why = lambda text: [s.boundary for s in SEGMENTER.segments_of(text)]
    assert why("One. Two") == ["terminator", "end"] and why("one\ntwo") == ["line", "line"] and why("# One\n- two") == ["structure", "structure"]


@given(st.text(st.sampled_from("ab 1.。!\n#-|>`(「）12年kg,$%"), max_size=80))
@settings(max_examples=200, deadline=None)
def test_segments_cover_every_character_once_and_tokens_slice_back(text):
    at = 0
    for s in segments_with_tokens(text, SEGMENTER, RULES):
        assert s["start"] >= at and text[s["start"] : s["end"]] == s["text"] and not text[at : s["start"]].strip()
        at = s["end"]
        for t in s["tokens"]:
            assert text[t["start"] : t["end"]] == t["text"] and s["start"] <= t["start"] < t["end"] <= s["end"]
    assert not text[at:].strip()


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("It weighs 12 kg.", [("quantity", "12 kg")]), ("On 2024-05-06 at 10:30.", [("date", "2024-05-06"), ("time", "10:30")]),
        ("It rose 4.5% to $1,200.", [("percentage", "4.5%"), ("money", "$1,200")]), ("See Section 4.2(a).", [("reference", "Section 4.2(a)")]),
        ("Version v1.2.3 is out.", [("identifier", "v1.2.3")]), ("令和6年5月に契約した。", [("date", "令和6年5月")]), ("第三条による。", [("reference", "第三条")]),
        ("Within 30 days.", [("duration", "30 days")]), ("共计3公斤。", [("quantity", "3公斤")]), ("Mr. John Smith said so.", [("proper_noun", "John Smith")]),
    ],
)
def test_tokens(text, found):
    assert tokens(text) == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        # Japanese
        ("箱は 7.5kg。", [("quantity", "7.5kg")]), ("箱は 7.5キログラム。", [("quantity", "7.5キログラム")]), ("第12条による。", [("reference", "第12条")]), ("第十二条による。", [("reference", "第十二条")]),
        ("費用は 3,400万円。", [("money", "3,400万円")]), ("費用は ¥9,500。", [("money", "¥9,500")]), ("昭和64年1月7日まで。", [("date", "昭和64年1月7日")]), ("平成元年から。", [("date", "平成元年")]),
        ("2025年1月31日に。", [("date", "2025年1月31日")]), ("二〇二五年一月に。", [("date", "二〇二五年一月")]), ("15人が来た。", [("quantity", "15人")]), ("五千人が来た。", [("quantity", "五千人")]),
        ("開始は 9:45。", [("time", "9:45")]), ("12フィート6インチです。", [("quantity", "12フィート6インチ")]), ("50mg/日です。", [("quantity", "50mg/日")]), ("5ミリグラム/日です。", [("quantity", "5ミリグラム/日")]),
        ("合計は４５，０００円です。", [("money", "４５，０００円")]), ("１，２３４人です。", [("quantity", "１，２３４人")]), ("1分30秒5でした。", [("duration", "1分30秒5")]), ("2時間15分でした。", [("duration", "2時間15分")]),
        ("120平方メートルです。", [("quantity", "120平方メートル")]), ("箱は ２.４kg。", [("quantity", "２.４kg")]),
        # Chinese
        ("箱重 7.5 公斤。", [("quantity", "7.5 公斤")]), ("第12条规定。", [("reference", "第12条")]), ("付 3,400 万元。", [("money", "3,400 万元")]), ("有 12 个。", [("quantity", "12 个")]),
        ("用 3 小时。", [("quantity", "3 小时")]), ("用时2小时15分。", [("duration", "2小时15分")]), ("320 千米/小时。", [("quantity", "320 千米/小时")]), ("有１，０００辆。", [("quantity", "１，０００辆")]),
        ("长8英尺 6英寸。", [("quantity", "8英尺 6英寸")]), ("高6英寸。", [("quantity", "6英寸")]), ("每次250毫克/片。", [("quantity", "250毫克/片")]), ("10亩地。", [("quantity", "10亩")]),
        # every script
        ("There were 42.", [("number", "42")]), ("ISO 9001 holds.", [("identifier", "ISO 9001")]), ("Speed 320 km/h then.", [("quantity", "320 km/h")]), ("About 20,000 m³ now.", [("quantity", "20,000 m³")]),
        ("Some 7.8 g/cm³ dense.", [("quantity", "7.8 g/cm³")]), ("At -20℃ here.", [("quantity", "-20℃")]), ("Read 320 kmx here.", [("number", "320")]), ("At 120psi cold.", [("quantity", "120psi")]),
        ("A 40' x 8'6\" box.", [("quantity", "40'"), ("quantity", "8'6\"")]), ("In the 1990's it was 2.4kg.", [("number", "1990"), ("quantity", "2.4kg")]), ("The lap was 1:45.32.", [("time", "1:45.32")]),
        # English
        ("On 3rd May 2024 or Sept. 5, 2024.", [("date", "3rd May 2024"), ("date", "Sept. 5, 2024")]), ("In March 2024.", [("date", "March 2024")]), ("Over 120 sq ft.", [("quantity", "120 sq ft")]),
        ("Some 3 cubic metres.", [("quantity", "3 cubic metres")]), ("It was 2.40 kilograms.", [("quantity", "2.40 kilograms")]), ("About 5 million dollars.", [("money", "5 million dollars")]),
        ("Within 10 business days.", [("duration", "10 business days")]), ("Up 7 per cent.", [("quantity", "7 per cent")]), ("See Appendix 3 and Secs. 4.1.", [("reference", "Appendix 3"), ("reference", "Secs. 4.1")]),
        ("Paid 500 EUR.", [("money", "500 EUR")]), ("Sum 1,234.", [("number", "1,234")]),
    ],
)
def test_what_each_notation_gives(text, found):
    assert tokens(text) == found


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("担当は木村医師です。", ["木村"]), ("中村さんに聞く。", ["中村"]), ("小林氏の話。", ["小林"]), ("株式会社あおば工業と契約。", ["株式会社あおば工業"]), ("東和証券が引受。", ["東和証券"]),
        ("株式会社あおば商事の木村さんに。", ["株式会社あおば商事", "木村"]), ("甲社と乙方。", ["甲社", "乙方"]), ("主治医师为陈医生。", ["陈"]), ("由东方证券承销。", ["东方证券"]), ("甲方负责。", ["甲方"]),
        ("南方新星科技有限公司提供。", ["南方新星科技有限公司"]), ("Signed by Dr. Adeyemi.", ["Adeyemi"]), ("Seen by Prof. Mary Holt.", ["Mary Holt"]), ("Norden Ltd agreed.", ["Norden Ltd"]),
        ("Signed with Harbour Systems Inc.", ["Harbour Systems Inc."]), ("皆さんどうぞ。", []), ("彼氏と話す。", []), ("主治医師の判断。", []), ("氏名を書く。", []), ("木村様より。", []), ("主治医生说明。", []),
        ("各部门经理出席。", []), ("总经理办公室。", []), ("Either party may end it.", []), ("May was the month.", []),
    ],
)
def test_names_need_evidence_beside_them(text, names):
    assert [t for k, t in tokens(text) if k == "proper_noun"] == names


def test_rules_with_word_hints_find_what_they_find_without():
    texts = ["On 3 May 2024, 5 cubic feet, 10 EUR, 7 per cent", "5月3日に3時間20分、12 yen と 4′6″", "2小时30分 3 tons of 5 tonnes", "Sept. 2024 and 5'11\""]
    for text in texts:
        for rule in RULES:
            if rule.regex.search(text):
                assert not rule.words or rule.words.search(text), rule
                assert not (rule.wide and text.isascii()), rule


def test_packs_are_checked():
    assert uncovered(packs_of()) == [] and "und" in {p.code for p in packs_of(["en"])}
    with pytest.raises(ValueError):
        packs_of(["xx"])
    with pytest.raises(ValueError):
        Pack("aa", ())
    with pytest.raises(ValueError):
        Segmenter([PACKS["en"], Pack("aa", (), stops=frozenset("."))])


def test_open_repeats_are_bounded():
    assert bounded(r"a+b*[+*]\*c{2,}") == r"a{1,256}b{0,256}[+*]\*c{2,256}"


@pytest.mark.parametrize(("text", "script"), [("かな漢字", "ja"), ("汉字", "zh"), ("text", "en"), ("123", "und"), ("", "und")])
def test_scripts(text, script):
    assert script_of(text) == script

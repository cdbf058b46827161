import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import garbled, plain


@pytest.mark.parametrize(
    "text",
    ["Zoë", "が", "ﾋﾞﾙ", "Ｆ", "（", "⽇", "路", "a\xa0b", "a　b", "ネ​ット", "ク‍マ", "Βаnunu", "2О24", "1O0", "ゼプ八リュ", "アリ一ナ", "RΟMO", "W\xadord", "﻿x"],
)
def test_odd(text):
    assert not plain.is_plain(text)
    made = plain.visible(text)
    assert plain.is_plain(made) and made != text


@pytest.mark.parametrize(
    "text",
    [None, "", " ", "Zoë", "がぱ", "ビル工場", "👩‍🌾 農家", "👨‍👩‍👧", "❤️", "Новетка", "α版 Δ計画", "「」【】、。・ー", "5G O2", "二丁目", "①²㎡…", '<a href="https://x.test/ｱ">b</a>', "https://x.test/a", "&nbsp;x", "工場ハ二"],
)
def test_plain(text):
    assert plain.is_plain(text)


def test_forms():
    assert plain.plain("<b>ＡＢ</b>&amp;ﾊﾞ ｽ　Straße") == "ab &バ ス strasse"
    assert plain.plain(None) is None and plain.plain("") == ""
    assert plain.visible("Νudаnli社が2О24年") == "Nudanli社が2024年"
    assert plain.visible("2147О5") == "214705"


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_plain_is_stable(text):
    once = plain.plain(text)
    assert plain.plain(once.replace("<", "").replace("&", "")) is not None
    assert not any(unicodedata.category(c) == "Zs" and c != " " for c in once)


def test_operator(spark):
    rows = spark.createDataFrame([(1, "Ａ", None), (2, "x" * 200_000, ""), (None, "ﾋﾞ", "ok"), (1, "Ａ", None)], "id int, title string, title_plain string")
    out = plain.normalise(rows, "title").collect()
    assert [r["title_plain"] for r in out] == ["a", "x" * 200_000, "ビ", "a"]
    assert sorted(map(tuple, plain.odd_fields(rows, "id", "title", "title_plain").where("id is not null").collect())) == [(1, "title"), (1, "title")]
    assert plain.odd_fields(rows.limit(0), "id", "title").count() == 0


JA = "水道局は再開発の結果を月末までに市議会へ示す予定です。住民からは「路線の補修が心配だ」との意見が寄せられました。"
FR = "Le conseil a rejeté le projet de réunion prévu à la forêt, évalué à douze millions. "
RU = "Жители района направили обращения о работе администрации. Решение по программе принято. "
SWAPS = [(JA, "utf-8", "latin-1"), (JA, "euc_jp", "latin-1"), (JA, "utf-8", "mac_roman"), (RU, "utf-8", "latin-1"), (RU, "cp1251", "latin-1"), (FR, "utf-8", "latin-1"), (JA, "utf-8", "cp932"), (JA, "euc_jp", "cp932"), (FR, "cp1252", "utf-8")]


def test_garbled(spark):
    clean = [(i, f"{t} {i} {t[: i % 30]}", "s") for i, t in enumerate([JA, FR, RU] * 120)]
    bad = [(1000 + k, f"{k} " + t.encode(a).decode(b, "replace"), "s") for k, (t, a, b) in enumerate(SWAPS)]
    other = [(2000, None, "s"), (2001, "", None), (2002, "℃ ㎡ № × ÷ ± £ € ﾋﾞﾙﾉﾄﾞｱ ＳÃＯ", None), (None, bad[0][1], "s"), (2003, JA * 2000, "s")]
    df = spark.createDataFrame(clean + bad + other, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in garbled.restore(df).collect()}
    assert set(got) == {1000 + k for k in range(len(SWAPS))}
    for k, (t, a, b) in enumerate(SWAPS):
        if "cp932" not in (a, b) and (a, b) != ("cp1252", "utf-8"):
            assert got[1000 + k]["restored"] == f"{k} {t}", (a, b)
    assert garbled.restore(df.limit(0)).count() == 0


def test_plain_ellipsis():
    assert plain.plain("水道局…") == plain.plain("水道局...") and plain.plain("ABC水道局…") == plain.plain("ＡBC水道局…")


def test_kanji_of_utf8_read_as_sjis():
    for line in ("莨夂､ｾ", "莠､騾壼ｱ\x80"):
        assert garbled.SUSPECT.search(line) and garbled._TELLTALES["utf8_sjis"].search(line)

"""Values that look odd and must change all the same."""

import re

import pytest

from ledgerlark.llm import pseudonyms


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) % 10 + 2 * int(c) // 10 for i, c in enumerate(reversed(digits))) % 10 == 0


CARDS = ["id-4111111111111111", "x -4111 1111 1111 1111", *(f"4111{s}1111{s}1111{s}1111" for s in (".", "_", " ", "–", "  ", "--", " ")), "4111.1111.1111.1111.", "3782.822463.10005", "card:4012–8888–8888–1881,"]
MAILS = ["José.garcía@example.com", "é@x.org", "почта@пример.рф", "日本語@例え.jp", "Ünal+x@mail.example.org", "áb@x.org"]
STAY = ["000-555-1234", "4111.1111.1111.1112", "12-4111111111111111-", "4111 1111\n1111 1111", "@x.org", "5-4111111111111111"]


@pytest.fixture(scope="module")
def shown(spark):
    texts = CARDS + MAILS + STAY
    found = pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(texts * 2)), "doc_id bigint, text string"), "k").orderBy("doc_id").collect()
    half = len(texts)
    assert [r.clean_text for r in found[:half]] == [r.clean_text for r in found[half:]]
    return {r.text: r for r in found}


@pytest.mark.parametrize("text", CARDS)
def test_cards_change(shown, text):
    new, kinds = shown[text].clean_text, shown[text].kinds
    assert kinds == ["card"] and new != text and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
    assert luhn(re.sub(r"\D", "", new))


@pytest.mark.parametrize("text", MAILS)
def test_mail_names_change(shown, text):
    new = shown[text].clean_text
    name, domain = text.split("@")
    assert shown[text].kinds == ["mail"] and new.split("@")[1] == domain and new.split("@")[0] != name
    assert len(new) == len(text) and all(a.isalpha() == b.isalpha() and a.isdigit() == b.isdigit() for a, b in zip(name, new))
    assert sum(a != b for a, b in zip(name, new)) >= sum(map(str.isalpha, name)) / 2


@pytest.mark.parametrize("text", STAY)
def test_what_isnt_valid_stays(shown, text):
    assert shown[text].clean_text == text and shown[text].kinds == []


def test_phones_keep_an_area_code(spark):
    rows = [(i, f"{i % 999 + 1:03}-555-{i:04}") for i in range(300)]
    got = pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()
    assert all(r.clean_text != r.text and not r.clean_text.startswith("000") for r in got) and len({r.clean_text for r in got}) == 300

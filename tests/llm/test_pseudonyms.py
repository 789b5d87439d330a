"""Pseudonyms: spellings of one value are linked, formats stay valid, everything comes back, prose stays as it is."""

import ipaddress
import re

import pytest

from docweave.llm import pseudonyms

NAMES = pseudonyms.Pseudonyms("k")


def canonical(text):
    return re.sub(r"[^0-9A-Za-z]", "", NAMES.apply(text)[0]).lower()


@pytest.mark.parametrize(
    "spellings",
    [
        ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
        ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"],
        ["+49 30 1234567", "+49 (30) 123 4567", "+49-30-123-4567"],
        ["AA:BB:CC:DD:EE:FF", "aa-bb-cc-dd-ee-ff", "aa:bb:cc:dd:ee:ff"],
        ["00:1B:44:11:3A:B7", "00-1b-44-11-3a-b7"],
    ],
)
def test_spellings_are_linked(spellings):
    assert len({canonical(x) for x in spellings}) == 1
    for x in spellings:
        new, found = NAMES.apply(f"see {x} now")
        assert len(found) == 1 and new != f"see {x} now"
        assert [c for c in new if not c.isalnum()] == [c for c in f"see {x} now" if not c.isalnum()]
        assert NAMES.apply(new, back=True)[0] == f"see {x} now"


def test_national_and_international_spellings_are_linked():
    assert NAMES.apply("(212) 555-1234")[0].replace("(", "").replace(") ", "-") == NAMES.apply("212-555-1234")[0]
    assert canonical("+1 (212) 555-1234") == "1" + canonical("212-555-1234")


def test_dates_are_linked_over_ways_of_writing():
    y, m, d = NAMES.apply("2019-03-04")[0].split("-")
    assert NAMES.apply("04.03.2019")[0] == f"{d}.{m}.{y}"
    for text in ("2019-03-04", "04.03.2019", "3/4/2019", "12/25/2019", "25/12/2019", "1.2.1999"):
        assert NAMES.apply(NAMES.apply(text)[0], back=True)[0] == text != NAMES.apply(text)[0]


@pytest.mark.parametrize("text", ["fe80::1", "2001:db8::1", "2001:DB8::FF00:42:8329", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8:85a3:1:2:8a2e:370:7334"])
def test_ipv6(text):
    new, found = NAMES.apply(f"at {text}, and")
    assert [k for k, *_ in found] == ["ipv6"]
    assert ipaddress.ip_address(new[3:-5])
    back = NAMES.apply(new, back=True)[0][3:-5]
    assert ipaddress.ip_address(back) == ipaddress.ip_address(text) and (back == text or len(text) == 39)


@pytest.mark.parametrize(
    "text",
    [
        "token: something is said", "Password: required", "the secret: nobody knows", "std::vector and a::b", "at 12:30:45 on", "::1 is the machine", "DE88 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130",
        "7536784127813050", "4111 1111 1111 1112", "000-12-3456", "2019-02-30", "300.1.2.3", "section 1.2.3.4.5", "ISBN 978-3-16-148410-0", "00:00:00:00:00:00", "+0 123 456 789", "+49 1234",
    ],
)
def test_what_is_no_valid_value_stays(text):
    assert NAMES.apply(text) == (text, [])


def test_a_key_is_required(spark):
    if not spark.conf.get(pseudonyms.KEY_SETTING, None):
        with pytest.raises(ValueError):
            pseudonyms.pii_key(spark)
    with pytest.raises(ValueError):
        pseudonyms.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")
    rows = spark.createDataFrame([(1, "a@b.example.com"), (2, "a@b.example.com")], "doc_id long, text string")
    a, b = pseudonyms.pseudonym_report(rows).collect()
    assert a.text == b.text != "a@b.example.com"


def test_long_texts_and_repeats(spark):
    long = "word " * 200_000 + "a@b.example.com " + "1" * 50_000 + " " + ":" * 50_000 + " " + "a." * 50_000
    rows = spark.createDataFrame([(None, long, "x"), (None, long, "x")], "doc_id long, text string, kinds string")
    a, b = pseudonyms.pseudonymise(rows, "k").collect()
    assert a == b and a.n_values == 1 and a.kinds == "email"

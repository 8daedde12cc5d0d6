"""Secrets of any case and length, and grouped cards of up to 19 digits."""

import random
import re

import pytest

from lectern.llm import pii_pseudonyms

KEY = "a key of this test"


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = pii_pseudonyms.replace_pii(df, KEY)
    back = [r.text for r in pii_pseudonyms.replace_pii(done, KEY, invert=True).orderBy("doc_id").collect()]
    assert back == texts
    return [(r.text, r.pii_kinds) for r in done.orderBy("doc_id").collect()]


@pytest.mark.parametrize("head", ['TOKEN = "', "Password: ", "API_KEY=", "Secret = '", "passwd="])
def test_key_words_in_any_case(spark, head):
    value = "9233A8EC0B6C44D1A0F2"
    [(text, kinds)] = replaced(spark, [f"x {head}{value} y"])
    assert kinds == ["secret"] and text.startswith(f"x {head}") and text.endswith(" y")
    assert value not in text and len(text) == len(f"x {head}{value} y")


def test_long_secrets_are_replaced_to_their_end(spark):
    letters = random.Random(1)
    values = ["".join(letters.choice("abcdefXYZ0123456789") for _ in range(n)) for n in (200, 201, 260, 5000)]
    for v, (text, kinds) in zip(values, replaced(spark, [f"TOKEN={v}" for v in values]), strict=True):
        new = text.removeprefix("TOKEN=")
        assert kinds == ["secret"] and len(new) == len(v)
        assert new[-40:] != v[-40:] and not any(v[i : i + 20] in new for i in range(0, len(v) - 20, 20))


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(digits))) % 10 == 0


def with_check(body):
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def grouped(digits, sep):
    return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))


@pytest.mark.parametrize("length", [17, 18, 19])
@pytest.mark.parametrize("sep", [" ", "-"])
def test_grouped_cards_of_up_to_19_digits(spark, length, sep):
    cards = [with_check(str(60110000000000000123456789 + 7919 * i)[:5] + str(10**20 + 987654321 * i * i)[-(length - 6) :]) for i in range(3, 23)]
    assert all(len(c) == length for c in cards)
    out = replaced(spark, [f"card {grouped(c, sep)} end" for c in cards])
    plain = replaced(spark, [f"card {c} end" for c in cards])
    for c, (text, kinds), (same, _) in zip(cards, out, plain, strict=True):
        new = text.split("card ")[1].removesuffix(" end")
        assert kinds == ["card"] and [len(x) for x in new.split(sep)] == [4, 4, 4, 4, length - 16]
        assert luhn(new.replace(sep, "")) and new.replace(sep, "") == same.split()[1] != c


def test_a_card_of_16_before_other_digits(spark):
    card = "4785 3805 9239 1139"
    tails = [f" {n:03d}" for n in range(100, 140)]
    for tail, (text, kinds) in zip(tails, replaced(spark, [card + t for t in tails]), strict=True):
        assert kinds == ["card"] and not text.startswith(card)
        assert text.endswith(tail) or luhn((card + tail).replace(" ", ""))
    more = [" 743 555 3824", " 10.0.0.1", " 12/05/2024", " 12.05.2024", " 12.ann@mail.example", " 123-45-6789"]
    for tail, (text, kinds) in zip(more, replaced(spark, [card + t for t in more]), strict=True):
        assert kinds[0] == "card" and len(kinds) == 2 and tail not in text


SECRETS = [  # (before, value, after)
    ('{"password": "', "h9", '"}'), ("{'client_secret' : '", "two words 7", "'}"), ("client_secret=", "x7", " more"), ("access_token: ", "ab12cd", "\nnext"),
    ("AWS_SECRET_ACCESS_KEY=", "wJalrXUtnFEMI/K7MDENG+bPxRfiCY", " "), ("api-key=", "q", ""), ("Authorization: Bearer ", "eyJhbGciOiJI.eyJzdWIi-1.sig_9", ""),
    ("clientSecret := ", "a1!b2@c3#d4", ", x"), ("password=", "abcDEF123456!tailTail99", " end"), ("Passwords = \"", "open quote12", "\" y"), ("token => '", "unclosed99", " y"),
    ("?token=", "a1b2c3", "&x=1"), ("basic ", "dXNlcjpwYXNz1", ""), ("TOKEN=", "hunter", " ."),
]


def test_forms_of_secrets(spark):
    for (head, value, tail), (text, kinds) in zip(SECRETS, replaced(spark, [f"x {h}{v}{t}" for h, v, t in SECRETS]), strict=True):
        assert kinds == ["secret"], head
        assert text.startswith(f"x {head}") and len(text) == len(f"x {head}{value}{tail}")
        new = text.removeprefix(f"x {head}")[: len(value)]
        assert not any(part in new for part in re.findall("[A-Za-z0-9]{4,}", value)), (head, new)
        if not tail.startswith("&"):  # what goes on without a blank, quote, comma or semicolon is the value's
            assert text.endswith(tail)


def test_prose_with_key_words_stays(spark):
    texts = ["The secret: nobody knows.", "a token of thanks", "Password: required", "tokenizer: fast", "basic income", "api keys", "secretary: Ann", "the bearer of news"]
    assert [t for t, _ in replaced(spark, texts)] == texts

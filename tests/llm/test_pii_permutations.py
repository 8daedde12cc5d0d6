"""Pseudonyms of every kind against plain Python networks, and that keys are asked for and stay hidden."""

import hashlib
import hmac
import random
from datetime import date, timedelta

import pytest

from lectern.llm import pii_pseudonyms as pii

KEY = "a key of this test"


def mac(kind, turn, value):
    derived = hmac.new(KEY.encode(), kind.encode(), hashlib.sha256).digest()
    return hmac.new(derived, f"{turn}|{value}".encode(), hashlib.sha256).hexdigest()


def f(kind, turn, value):
    return int(mac(kind, turn, value)[:15], 16)


def network(kind, left, right, a, b):
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            left = (left + f(kind, k, right)) % a
        else:
            right = (right + f(kind, k, left)) % b
    return left, right


def strings(kind, value, hexa=False):
    small = "0123456789abcdef"

    def alphabet(c):
        if hexa:
            return small
        return next((x for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in x), c)

    both = [[alphabet(c), alphabet(c).index(c)] for c in value]
    half = [both[: len(both) // 2], both[len(both) // 2 :]]
    for k in range(pii.ROUNDS):
        mine, other = half[k % 2], half[1 - k % 2]
        text = " ".join(f"{x}.{len(z)}" for z, x in other)
        text = hashlib.sha256(text.encode()).hexdigest() if len(other) > 100 else text
        half[k % 2] = [[z, (x + int(mac(kind, k, f"{i // 8}|{text}")[8 * (i % 8) : 8 * (i % 8) + 8], 16)) % len(z)] for i, (z, x) in enumerate(mine)]
    return "".join(z[x] for z, x in half[0] + half[1])


def card(digits):
    body = digits[:-1]
    h = len(body) // 2
    left, right = network("card", int(body[:h]), int(body[h:]), 10**h, 10 ** (len(body) - h))
    body = str(left).zfill(h) + str(right).zfill(len(body) - h)
    total = sum(sum(divmod(int(c) * (2 if j % 2 == 0 else 1), 10)) for j, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def phone(digits):
    left, right = network("phone", int(digits[:5]), int(digits[5:]), 10**5, 10**5)
    return f"{left:05}{right:05}"


def ssn(area, group, serial):
    left, right = network("ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 998, 989901)
    return f"{left + (2 if left >= 665 else 1):03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}"


def ip(a, b, c, d):
    left, right = network("ip", a * 256 + b, c * 256 + d, 65536, 65536)
    return ".".join(str(x) for x in (left // 256, left % 256, right // 256, right % 256))


def day(at):
    n = (at - date(1900, 1, 1)).days
    left, right = network("date", n // 4297, n % 4297, 17, 4297)
    return date(1900, 1, 1) + timedelta(left * 4297 + right)


def checked(country, account):
    whole = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(whole) % 97:02}{account}"


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    done = pii.replace_pii(df, KEY)
    assert [r.text for r in pii.replace_pii(done, KEY, invert=True).orderBy("doc_id").collect()] == texts
    return [(r.text, r.pii_kinds) for r in done.orderBy("doc_id").collect()]


def test_every_kind_against_plain_networks(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pairs = [(c, card(c), "card") for c in ("4785380592391139", "4994226020900891", "378282246310005", "6011000990139424")]
    for _ in range(8):
        p = digits(10)
        new = phone(p)
        pairs.append((f"{p[:3]}-{p[3:6]}-{p[6:]}", f"{new[:3]}-{new[3:6]}-{new[6:]}", "phone"))
    for s in ((1, 1, 1), (665, 99, 9999), (667, 5, 12), (900, 70, 1), (999, 99, 9999)):
        pairs.append((f"{s[0]:03}-{s[1]:02}-{s[2]:04}", ssn(*s), "ssn"))
    for a in ((0, 0, 0, 0), (10, 2, 3, 4), (255, 255, 255, 255)):
        pairs.append((".".join(map(str, a)), ip(*a), "ip"))
    for d in (date(1900, 1, 1), date(1984, 2, 29), date(2099, 12, 31)):
        pairs += [(d.isoformat(), day(d).isoformat(), "date"), (d.strftime("%m/%d/%Y"), day(d).strftime("%m/%d/%Y"), "date"), (d.strftime("%d.%m.%Y"), day(d).strftime("%d.%m.%Y"), "date")]
    for name in ("a", "ann.Lee-09", "x" * 70, "q7" * 130):
        pairs.append((f"{name}@mail.example.com", f"{strings('email', name)}@mail.example.com", "email"))
    for v in ("0641917ea4e9feb9cda83477b57ac2654884f485", "Zz9_/+aB01qwertY"):
        pairs.append((f"token={v}", f"token={strings('secret', v)}", "secret"))
    pairs.append(("sk-" + "aB3" * 10, "sk-" + strings("secret", "aB3" * 10), "secret"))
    hexa = "20010db885a3000000008a2e03707334"
    wide = lambda h: ":".join(h[i : i + 4] for i in range(0, 32, 4))
    pairs.append((wide(hexa), wide(strings("ip6", hexa, hexa=True)), "ip6"))
    for country, account in (("DE", "370400440532013000"), ("GB", "NWBK60161331926819"), ("NO", "86011117947")):
        pairs.append((checked(country, account), checked(country, strings("iban", account)), "iban"))
    for (old, new, kind), (text, kinds) in zip(pairs, replaced(spark, [f"x {p[0]} y" for p in pairs]), strict=True):
        assert kinds == [kind] and text == f"x {new} y", old


@pytest.mark.parametrize("shape", ["9a", "a9", "99", "aA", "a-9"])
def test_small_domains_are_permuted_whole(spark, shape):
    """All mail names and all secrets of a shape: as many pseudonyms as values, of the same shape, and each inverted."""
    of = {"9": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    values = [""]
    for c in shape:
        values = [v + x for v in values for x in of.get(c, c)]
    for head, tail in (("", "@mail.example"), ("password=", "")):
        out = replaced(spark, [f"{head}{v}{tail}" for v in values])
        new = [text.removeprefix(head).removesuffix(tail) for text, _ in out]
        assert sorted(new) == sorted(values)


def test_hex_secrets_can_be_inverted(spark):
    rng = random.Random(3)
    values = [hashlib.md5(str(rng.random()).encode()).hexdigest()[: rng.randint(2, 32)] for _ in range(60)]
    out = replaced(spark, [f"token: {v}1 and {v}0@x.example" for v in values])
    assert len({text for text, _ in out}) == len(set(values)) and all(kinds == ["secret", "email"] for _, kinds in out)


def test_writings_of_one_value_stay_linked(spark):
    [(spaced, kinds), (plain, _)] = replaced(spark, ["DE89 3704 0044 0532 0130 00.", "DE89370400440532013000."])
    assert kinds == ["iban"] and spaced.replace(" ", "") == plain and plain[:2] == "DE"
    df = spark.createDataFrame([(0, "2001:db8:85a3::8a2e:370:7334"), (1, "2001:0DB8:85A3:0000:0000:8A2E:0370:7334")], "doc_id long, text string")
    one, two = [r.text for r in pii.replace_pii(df, KEY).orderBy("doc_id").collect()]
    assert one == two and "8a2e" not in one


def test_ties_between_kinds_go_to_the_first_listed(spark):
    # a name that holds a date, and a key word before a card's digits: the value that starts first, and is listed first
    [(text, kinds), (_, more)] = replaced(spark, ["1984-02-29@mail.example.com", "token=4785380592391139"])
    assert kinds == ["email"] and text.endswith("@mail.example.com") and more == ["secret"]


def test_a_key_is_asked_for_and_hidden(spark):
    df = spark.createDataFrame([(1, "card 4785380592391139")], "doc_id long, text string")
    with pytest.raises(ValueError, match="key"):
        pii.replace_pii(df)
    spark.conf.set(pii.KEY_SETTING, KEY)
    try:
        done = pii.replace_pii(df)
        assert done.first().text == f"card {card('4785380592391139')}"
        plan = done._jdf.queryExecution().toString()
        assert KEY not in plan and pii.kind_key(KEY, "card").hex() not in plan.lower()
    finally:
        spark.conf.unset(pii.KEY_SETTING)

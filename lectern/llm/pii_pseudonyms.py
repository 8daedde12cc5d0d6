"""Format-preserving pseudonyms for personal data, in Spark expressions only.

Values are found by one pattern, validated, and replaced by a keyed permutation of all values of their format, a
Feistel network: (l, r) -> ((l + F(key, round, r)) mod a, r) and the other way round in turn, on Z_a x Z_b. It is a
bijection for any a and b, so different values stay different and equal values stay linked across documents, whatever
punctuation they are written with, and the holder of the key can invert it. A grouped card with up to three digits after it, a check
number say, is tried as one card of up to 19 digits, then as a card of 16 whose neighbour stays.

========  =============================================  =============================================================
kind      validated by                                   permuted over
========  =============================================  =============================================================
card      13 to 19 digits, Luhn check                    all digits but the last; the check digit is computed anew
phone     10 digits in groups of 3, 3 and 4, also with +1  10^5 x 10^5; the prefix stays
ssn       area, group and serial in range, also 9xx      998 areas x 989,901 group serials
ip        four octets up to 255                          2^16 x 2^16
ip6       eight groups, or fewer around one ``::``       all 32 hex digits, written in full
iban      check digits, modulo 97                        the account, letters as letters and digits as digits; the
                                                         country stays, the check digits are computed anew
date      a day of 1900 to 2099 (y-m-d, m/d/y, d.m.y)    17 x 4297 days
email     name and domain                                the name: letters as letters, digits as digits; domain stays
secret    a key word in any case, also inside a longer   the value: letters as letters of their case, digits as
          name, and its value; bearer and basic tokens;  digits; quotes and signs stay
          a cloud or service key form
========  =============================================  =============================================================

The round function is an HMAC with SHA-256 under a key derived for each kind. Key material reaches the executors as the row
of a one-row table that a scalar subquery reads, so it stands in no plan, event log or page of the UI. There is no
default: a key is given, or set as ``lectern.pii.secret`` in the session.

A key word's value is all between quotes, or the whole run up to a blank, quote, comma, semicolon or angle bracket. After an
equals sign any value counts; after a colon a bare one that has a digit or sign, or at least twelve letters, as prose has colons too.

Formats are kept, but a number of an address may get wider or narrower, an ip6 is written in full, and of dates written
without leading zeros only the day is kept linked, not how it is written. Where kinds could overlap, the one that starts
first counts, then the first one of the pattern's list. What does not validate stays as it is, and so does all other text, byte for byte. Defined results: null text stays
null with zero counts, empty text stays empty; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import fresh

ROUNDS = 10
#: The setting that holds a session's key; Spark's pages don't show values of such names.
KEY_SETTING = "lectern.pii.secret"
KINDS = ("card", "phone", "ssn", "ip", "ip6", "iban", "date", "email", "secret")
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 x 4,297.
_DAYS = (17, 4297)

# Countries whose accounts have such numbers.
_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME "
    "MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
)

# Digits that end here and don't begin an address, a date, a mail name, a security number or a phone.
_ALONE = r"(?![0-9A-Za-z]|[./][0-9]|[A-Za-z0-9._%+\-]*+@|-[0-9]{2}-[0-9]{4}|[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z]))"

# What names a secret, also with more of a name behind.
_NAMED = r"(?=[pPsStTaA])(?i:password|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|authorization)(?:[_\-][A-Za-z0-9_\-]*+|s?+)[\"']?[ \t]{0,2}"
_RUN = r"[^\s\"'<>,;]"
_VALUE = rf"""(?:"[^"\n]++"|'[^'\n]++'|["']?"""
_TELLING = rf"(?={_RUN}*[^A-Za-z\s\"'<>,;.!?:)]|[A-Za-z]{{12}})"
#: What stands before a secret's value.
_HEAD = rf"^(?:{_NAMED}(?:=>|:=|[=:])[ \t]{{0,2}}[\"']?|(?i:bearer|basic)[ \t]{{1,2}}|AKIA|(?:sk|pk|rk|ghp|gho|xoxb|xoxp)[-_])"

# Each alternative can start only where a run of its characters starts, and runs are possessive: time is linear.
_PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
        r"\bAKIA[0-9A-Z]{16}\b",
        r"(?=[a-z]{2,4}[-_])(?<![A-Za-z0-9_\-])(?:sk|pk|rk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_\-]{16,}+",
        rf"{_NAMED}(?:=>|:=|=)[ \t]{{0,2}}{_VALUE}{_RUN}++)",
        rf"{_NAMED}:[ \t]{{0,2}}{_VALUE}{_TELLING}{_RUN}++)",
        rf"\b(?=[bB])(?i:bearer|basic)[ \t]{{1,2}}(?={_RUN}*[0-9]|[A-Za-z]{{16}}){_RUN}{{8,}}+",
        r"(?<![0-9A-Za-z+(])(?:\+1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])",
        rf"(?=[A-Z]{{2}}[0-9]{{2}})(?<![0-9A-Za-z])(?:{_COUNTRIES.replace(' ', '|')})" + r"[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
        r"(?=[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:])(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])",
        r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
        r"(?<![0-9A-Za-z\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z\-])",
        r"(?<![0-9A-Za-z/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9A-Za-z/])",
        r"(?<![0-9A-Za-z.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
        r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])",
        rf"(?<![0-9A-Za-z])[0-9]{{4}}([ \-])[0-9]{{4}}(?:\1[0-9]{{4}})\1(?:[0-9]{{4}}\1[0-9]{{1,3}}{_ALONE}|[0-9]{{1,4}}(?![0-9A-Za-z]))",
        r"(?<![0-9A-Za-z])[0-9]{4}([ \-])[0-9]{6}\2[0-9]{5}(?![0-9A-Za-z])",
    )
)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_key(key: str, kind: str) -> bytes:
    """The key of a kind, derived from the main one."""
    return hmac.new(key.encode(), kind.encode(), hashlib.sha256).digest()


def _material(spark: SparkSession, key: str) -> DataFrame:
    """One row: a struct with the padded inner and outer key of each kind."""
    block = lambda k, pad: bytearray(x ^ pad for x in k.ljust(64, b"\0"))
    row = tuple((block(kind_key(key, kind), 0x36), block(kind_key(key, kind), 0x5C)) for kind in KINDS)
    fields = ", ".join(f"{kind}: struct<i: binary, o: binary>" for kind in KINDS)
    return spark.createDataFrame([(row,)], f"k struct<{fields}>")


def _hmac(key: str, kind: str, turn: str, value: str) -> str:
    """64 hex digits: an HMAC of the turn and the value. ``key``: the material's column."""
    inner = f"unhex(sha2(concat({key}.{kind}.i, cast(concat({turn}, '|', {value}) as binary)), 256))"
    return f"sha2(concat({key}.{kind}.o, {inner}), 256)"


def _prf(key: str, kind: str, turn: str, value: str) -> str:
    """A keyed pseudo-random number of 60 bits."""
    return f"cast(conv(substr({_hmac(key, kind, turn, value)}, 1, 15), 16, 10) as bigint)"


def _feistel(key: str, kind: str, left: str, right: str, a: str, b: str, invert: bool = False) -> str:
    """SQL of a struct (l, r): the keyed permutation of (left, right) on Z_a x Z_b."""
    sign, order = ("-", f"sequence({ROUNDS - 1}, 0)") if invert else ("+", f"sequence(0, {ROUNDS - 1})")
    first = f"named_struct('l', pmod(s.l {sign} pmod({_prf(key, kind, 'k', 's.r')}, {a}), {a}), 'r', s.r)"
    second = f"named_struct('l', s.l, 'r', pmod(s.r {sign} pmod({_prf(key, kind, 'k', 's.l')}, {b}), {b}))"
    return f"aggregate({order}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, k) -> if(k % 2 = 0, {first}, {second}))"


def _let(name: str, value: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits, in order, replaced by ``digits``."""
    return f"array_join(transform(split({shape}, ''), (c, i) -> if(c rlike '[0-9]', substr({digits}, length(regexp_replace(substr({shape}, 1, i + 1), '[^0-9]', '')), 1), c)), '')"


def _luhn(body: str) -> str:
    """The check digit after a string of digits."""
    step = f"cast(substr({body}, length({body}) - j, 1) as bigint) * if(j % 2 = 0, 2, 1)"
    return f"pmod(10L - aggregate(sequence(0, length({body}) - 1), 0L, (t, j) -> t + ({step}) div 10 + ({step}) % 10) % 10, 10)"


def _luhn_valid(digits: str) -> str:
    return _let("x", digits, f"cast(substr(x, -1, 1) as int) = {_let('e', 'substr(x, 1, length(x) - 1)', _luhn('e'))}")


def _card_digits(key: str, d: str, invert: bool) -> str:
    half = f"((length({d}) - 1) div 2)"
    pair = _feistel(key, "card", f"substr({d}, 1, {half})", f"substr({d}, {half} + 1, length({d}) - 1 - {half})", f"cast(pow(10, {half}) as bigint)", f"cast(pow(10, length({d}) - 1 - {half}) as bigint)", invert)
    body = f"concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), length({d}) - 1 - {half}, '0'))"
    return _let("p", pair, _let("e", body, f"concat(e, {_luhn('e')})"))


def _card(key: str, invert: bool) -> str:
    whole = _let("n", _card_digits(key, "d", invert), _refill("m", "n"))
    # a card of 16 before other digits: permuted until all digits together are no card, as they weren't, so it can be inverted
    walk = f"aggregate(sequence(1, 20), substr(d, 1, 16), (g, w) -> if(w > 1 and not {_luhn_valid('concat(g, substr(d, 17))')}, g, {_card_digits(key, 'g', invert)}))"
    first = _let("n", f"concat({walk}, substr(d, 17))", _refill("m", "n"))
    grouped = f"length(d) between 17 and 19 and m rlike '[ -]' and {_luhn_valid('substr(d, 1, 16)')}"
    return f"case when length(d) between 13 and 19 and {_luhn_valid('d')} then {whole} when {grouped} then {first} end"


def _phone(key: str, invert: bool) -> str:
    # all ten digits: numbers with areas that the plan doesn't assign are as telling as others
    t = "substr(d, -10, 10)"
    pair = _feistel(key, "phone", f"substr({t}, 1, 5)", f"substr({t}, 6, 5)", "100000", "100000", invert)
    new = "concat(substr(d, 1, length(d) - 10), lpad(cast(p.l as string), 5, '0'), lpad(cast(p.r as string), 5, '0'))"
    return f"if(d rlike '^1?[0-9]{{10}}$', {_let('p', pair, _let('n', new, _refill('m', 'n')))}, null)"


def _ssn(key: str, invert: bool) -> str:
    area, group, serial = "cast(substr(d, 1, 3) as int)", "cast(substr(d, 4, 2) as int)", "cast(substr(d, 6, 4) as int)"
    pair = _feistel(key, "ssn", f"{area} - if({area} > 666, 2, 1)", f"({group} - 1) * 9999 + {serial} - 1", "998", "989901", invert)
    new = "concat(lpad(cast(p.l + if(p.l >= 665, 2, 1) as string), 3, '0'), lpad(cast(p.r div 9999 + 1 as string), 2, '0'), lpad(cast(p.r % 9999 + 1 as string), 4, '0'))"
    return f"if({area} between 1 and 999 and {area} <> 666 and {group} > 0 and {serial} > 0, {_let('p', pair, _let('n', new, _refill('m', 'n')))}, null)"


def _ip(key: str, invert: bool) -> str:
    pair = _feistel(key, "ip", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", invert)
    new = "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)"
    return _let("o", r"transform(split(m, '[.]'), x -> cast(x as int))", f"if(exists(o, x -> x > 255), null, {_let('p', pair, new)})")


def _ip6(key: str, invert: bool) -> str:
    # the groups around a double colon, filled up with zeros to eight
    groups = lambda part: f"filter(split({part}, ':'), x -> x <> '')"
    filled = "concat(g[0], array_repeat('0', 8 - size(g[0]) - size(g[1])), g[1])"
    digits = f"array_join(transform({filled}, x -> lpad(lower(x), 4, '0')), '')"
    both = f"named_struct('a', {groups('split(m, \'::\')[0]')}, 'b', if(m like '%::%', {groups('split(m, \'::\')[1]')}, cast(array() as array<string>)))"
    fits = "m not rlike '::.*::' and if(m like '%::%', size(g[0]) + size(g[1]) between 3 and 7, size(g[0]) = 8)"
    new = _let("n", _string(key, "ip6", digits, invert, hexa=True), "array_join(transform(sequence(0, 7), j -> substr(n, 4 * j + 1, 4)), ':')")
    return _let("q0", both, _let("g", "array(q0.a, q0.b)", f"if({fits}, {new}, null)"))


def _remainder97(value: str) -> str:
    return f"aggregate(split({value}, ''), 0L, (t, c) -> (t * if(c rlike '[A-Z]', 100, 10) + if(c rlike '[A-Z]', ascii(c) - 55, cast(c as int))) % 97)"


def _iban(key: str, invert: bool) -> str:
    check = lambda account: f"lpad(cast(98 - {_remainder97(f'concat({account}, substr(p, 1, 2), \'00\')')} as string), 2, '0')"
    new = _let("n", _string(key, "iban", "substr(p, 5)", invert), f"concat(substr(p, 1, 2), {check('n')}, n)")
    spaced = "if(m like '% %', btrim(regexp_replace(w, '(.{4})', '$1 ')), w)"
    return _let("p", "replace(m, ' ', '')", f"if(length(p) between 15 and 34 and substr(p, 3, 2) = {check('substr(p, 5)')}, {_let('w', new, spaced)}, null)")


def _date(key: str, invert: bool) -> str:
    a, b = _DAYS
    days = "datediff(t, date'1900-01-01')"
    pair = _feistel(key, "date", f"{days} div {b}", f"{days} % {b}", str(a), str(b), invert)

    def shaped(parse: str, show: str) -> str:
        day = f"date_add(date'1900-01-01', cast(p.l * {b} + p.r as int))"
        return _let("t", parse, f"if(t between date'1900-01-01' and date'2099-12-31', {_let('p', pair, f'date_format({day}, {show})')}, null)")

    return (
        f"case when m like '%-%' then {shaped('try_to_date(m, \"yyyy-MM-dd\")', '\"yyyy-MM-dd\"')} "
        f"when m like '%/%' then {shaped('try_to_date(m, \"M/d/yyyy\")', 'if(length(m) = 10, \"MM/dd/yyyy\", \"M/d/yyyy\")')} "
        f"else {shaped('try_to_date(m, \"d.M.yyyy\")', 'if(length(m) = 10, \"dd.MM.yyyy\", \"d.M.yyyy\")')} end"
    )


def _string(key: str, kind: str, value: str, invert: bool, hexa: bool = False) -> str:
    """A permutation of all strings of the same shape: the halves' characters shift by keyed hashes of the other half in turn.

    Digits stay digits, and small and capital letters stay so; other characters stay. So the alphabet of a place is that of
    its pseudonym too, and the network can be inverted. ``hexa``: all are small hex digits, which the kind has to fix.
    """
    sign, order = ("-", f"sequence({ROUNDS - 1}, 0)") if invert else ("+", f"sequence(0, {ROUNDS - 1})")
    alphabet = "'0123456789abcdef'" if hexa else "case when c rlike '[0-9]' then '0123456789' when c rlike '[a-z]' then 'abcdefghijklmnopqrstuvwxyz' when c rlike '[A-Z]' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' else c end"
    code = f"transform(split(v, ''), c -> {_let('z', alphabet, 'named_struct(\"z\", z, \"x\", instr(z, c) - 1)')})"

    def moved(mine: str, other: str) -> str:
        # what a half is shifted by depends on the other half, the round, the place and the shape
        text = f"array_join(transform({other}, e -> concat(e.x, '.', length(e.z))), ' ')"
        # of a long half only a hash goes into each place's hash, so that time stays linear
        text = f"if(size({other}) > 100, sha2({text}, 256), {text})"
        # one hash for each eight places, 32 bits a place
        hashes = f"transform(sequence(0, size({mine}) div 8), b -> {_hmac(key, kind, 'k', 'concat(b, \'|\', y)')})"
        shift = "cast(conv(substr(hs[i div 8], 8 * (i % 8) + 1, 8), 16, 10) as bigint)"
        shifted = f"transform({mine}, (e, i) -> named_struct('z', e.z, 'x', cast(pmod(e.x {sign} {shift}, length(e.z)) as int)))"
        return _let("y", text, _let("hs", hashes, shifted))

    step = f"if(k % 2 = 0, named_struct('l', {moved('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')}))"
    start = "named_struct('l', slice(q, 1, size(q) div 2), 'r', slice(q, size(q) div 2 + 1, size(q)))"
    done = f"aggregate({order}, {start}, (s, k) -> {step}, s -> array_join(transform(concat(s.l, s.r), e -> substr(e.z, e.x + 1, 1)), ''))"
    return _let("v", value, _let("q", code, done))


def _email(key: str, invert: bool) -> str:
    return f"concat({_string(key, 'email', 'regexp_extract(m, \"^[^@]+\", 0)', invert)}, regexp_extract(m, '@.*$', 0))"


def _secret(key: str, invert: bool) -> str:
    head = f"regexp_extract(m, {_quoted(_HEAD)}, 0)"
    return _let("w", head, f"concat(w, {_string(key, 'secret', 'substr(m, length(w) + 1)', invert)})")


def _judged(key: str, invert: bool) -> str:
    """SQL of a struct (kind, value) for a match ``m``: both null if it doesn't validate."""
    found = (
        ("email", r"m rlike '^[A-Za-z0-9._%+-]++@'", _email(key, invert)),
        ("ip6", r"m rlike '^[0-9A-Fa-f]{1,4}:' and m rlike '^[0-9A-Fa-f:]+$'", _ip6(key, invert)),
        ("iban", r"m rlike '^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$'", _iban(key, invert)),
        ("secret", r"m rlike '^[A-Za-z]'", _secret(key, invert)),
        ("ip", r"m rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$'", _ip(key, invert)),
        ("ssn", r"m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", _ssn(key, invert)),
        ("date", r"m rlike '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4})$'", _date(key, invert)),
        ("phone", r"length(d) in (10, 11) and m rlike '^([+]1[ .-]?)?([(][0-9]{3}[)] ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$'", _phone(key, invert)),
        ("card", "true", _card(key, invert)),
    )
    cases = " ".join(f"when {test} then {_let('n_', value, f'if(n_ is null, null, named_struct(\"kind\", {_quoted(kind)}, \"value\", n_))')}" for kind, test, value in found)
    return _let("d", "regexp_replace(m, '[^0-9]', '')", f"case {cases} end")


def session_key(spark: SparkSession) -> str | None:
    return spark.conf.get(KEY_SETTING, None)


def replace_pii(docs: DataFrame, key: str | None = None, text: str = "text", invert: bool = False, kinds: str = "pii_kinds") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``kinds``, the kinds replaced in order (in place of a column of that name).

    Without ``key`` the session's is taken; it is an error if there is none."""
    key = key or session_key(docs.sparkSession)
    if not key:
        raise ValueError(f"pseudonyms need a key: give one, or set {KEY_SETTING}")
    names = [c for c in docs.columns if c.lower() != kinds.lower()]
    name, material = fresh(docs, "pii"), fresh(docs, "pii_key")
    kept = [F.col(f"`{c}`") for c in names]
    keyed = docs.select(*kept, _material(docs.sparkSession, key).scalar().alias(material))
    done = keyed.select(*kept, F.expr(pseudonym_sql(f"`{material}`", invert, f"`{text}`")).alias(name))
    return done.select(
        *[F.col(f"{name}.text").alias(text) if c == text else F.col(f"`{c}`") for c in names],
        F.coalesce(F.col(f"{name}.kinds"), F.expr("cast(array() as array<string>)")).alias(kinds),
    )


def pseudonym_sql(key: str, invert: bool = False, text: str = "text") -> str:
    """SQL over a text column and the column of key material: a struct of the text with pseudonyms and of the kinds replaced, in order."""
    pattern = _quoted(_PATTERN)
    pieces = f"split(x.b, {pattern}, -1)"
    values = "transform(x.m, (m, i) -> coalesce(j[i].value, m))"
    whole = f"array_join(zip_with({pieces}, {values}, (a, b) -> concat(a, coalesce(b, ''))), '')"
    return f"""if({text} is null, null,
      get(transform(array(named_struct('m', regexp_extract_all({text}, {pattern}, 0), 'b', {text})), x ->
        if(size(x.m) = 0, named_struct('text', x.b, 'kinds', cast(array() as array<string>)),
          get(transform(array(transform(x.m, m -> {_judged(key, invert)})), j -> named_struct(
            'text', {whole}, 'kinds', transform(filter(j, y -> y is not null), y -> y.kind))), 0))), 0))"""

"""Format-preserving pseudonyms for personal data in texts.

E-mail addresses, card numbers, phone numbers, social security numbers, internet addresses
and dates are found and validated (check digit, ranges, calendar); what fails stays as it is.
Each value is a row of symbols with a modulus each: digits modulo 10, letters modulo 26,
octets modulo 256, a day as two symbols modulo 189 and 773, since 400 years have
189 * 773 days.  A keyed Feistel network permutes the rows of one format: in turn one half
is shifted, symbol by symbol, by a keyed hash of the other.  So equal values get equal
pseudonyms in all documents, different values different ones, and digits stay digits, a
card keeps a right check digit and a date stays a date.

Only built-in functions are used.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# The formats.  Digits, separators and the borders of each kind.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,20}\.[A-Za-z]{2,}"
DATE_ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
DATE_DAY_FIRST = r"(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD_AHEAD = r"(?![ -]?(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?![ -][0-9]{4}(?![0-9]))|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))"
PHONE = (
    rf"(?<![0-9+])\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{2,4}}\)?(?:{CARD_AHEAD}[ .-]?[0-9]{{2,4}}){{2,3}}(?![0-9])"
    r"|(?<![0-9(+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
    r"|(?<![0-9.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])")
#: Groups of digits with single spaces or hyphens between, as many as follow each other: cards are looked for inside.
RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"
OTHERS = "|".join([EMAIL, DATE_ISO, DATE_DAY_FIRST, SSN, IP, PHONE])
ANY = f"{OTHERS}|{RUN}"
#: Digits of a card at least and at most, how its groups are usually written, and how short others are at least.
CARD_DIGITS = (13, 19)
CARD_GROUPS = ([4, 4, 4, 4], [4, 6, 5])
LEAST_GROUP = 3
#: A row of groups is a list, where cards have no gaps, if more groups than these lie outside its
#: usually grouped cards; cards grouped otherwise are looked for in so many groups at most.
LIST_GROUPS = {"outside": 4, "any": 6}
# The first digits that issuers of cards have, with the lengths of their numbers.
ISSUER = (
    r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})"
    r"|(?=[0-9]{16}$)(?:5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)[0-9]*"
    r"|(?=[0-9]{15}$)3[47][0-9]*"
    r"|(?=[0-9]{14,19}$)3(?:0[0-5]|[689])[0-9]*"
    r"|(?=[0-9]{16,19}$)(?:6011|64[4-9]|65|62|35(?:2[89]|[3-8]))[0-9]*"
    r"|(?=[0-9]{13,19}$)(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]*)$")
FIRST_DAY = "1800-03-01"
DAYS = (189, 773)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, moduli: Column, key: Column, tweak: Column, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the rows of symbols with these moduli, ``array<bigint>`` each.

    Even rounds shift the left half, odd ones the right.  Rows of one symbol are shifted by a
    keyed constant.  ``tweak`` names the format; each has a permutation of its own.
    """
    cut = F.floor(F.size(values) / 2).cast("int")

    def left(a: Column) -> Column:
        return F.slice(a, F.lit(1), cut)

    def right(a: Column) -> Column:
        return F.slice(a, cut + 1, F.size(a) - cut)

    def moved(half: Column, mods: Column, other: Column, turn: Column) -> Column:
        seen = F.array_join(F.transform(other, lambda x: x.cast("string")), ",")

        def shift(symbol: Column, place: Column) -> Column:
            told = F.concat_ws("|", key, tweak, turn.cast("string"), seen, place.cast("string"))
            number = F.conv(F.substring(F.sha2(told, 256), 1, 15), 16, 10).cast("long")
            return F.pmod(symbol["v"] + number, symbol["m"])

        return F.transform(F.arrays_zip(half.alias("v"), mods.alias("m")), shift)

    def play(s: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, moved(s["l"], left(moduli), s["r"], turn)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(moved(s["r"], right(moduli), s["l"], turn)).alias("r"))

    start = F.struct(left(values).alias("l"), right(values).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, play, lambda s: F.concat(s["l"], s["r"]))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.transform(_letters(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("long"))


def _tens(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10).cast("long"))


def _fill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order."""
    return F.array_join(F.transform(_letters(form), lambda c, i: F.when(
        c.between("0", "9"),
        F.element_at(digits, F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), "[^0-9]", ""))).cast("string"),
    ).otherwise(c)), "")


def _check_sum(digits: Column, doubled: int) -> Column:
    """The sum of the card check, where the last digit but ``doubled`` counts twice."""
    n = F.size(digits)
    return F.aggregate(
        F.transform(digits, lambda d, i: F.when(
            (n - 1 - i) % 2 == doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)),
        F.lit(0).cast("long"), lambda a, d: a + d)


def _card(m: Column, key: Column) -> Column:
    def swap(digits: Column) -> Column:
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        return _let(
            feistel(body, _tens(body), key, F.concat(F.lit("card"), F.size(body).cast("string"))),
            lambda new: _fill(m, F.concat(new, F.array(F.pmod(-_check_sum(new, 0), F.lit(10)).cast("long")))))
    return _let(_digits(m), lambda d: F.when(_check_sum(d, 1) % 10 == 0, swap(d)))


def _phone(m: Column, key: Column) -> Column:
    land = F.regexp_extract(m, r"^\+[0-9]+", 0)
    rest = F.substring(m, F.length(land) + 1, F.length(m))
    return _let(_digits(rest), lambda d: F.concat(land, _fill(rest, feistel(
        d, _tens(d), key, F.concat(F.lit("phone"), F.size(d).cast("string"))))))


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    row = F.array(area - 1 - (area > 666).cast("long"), group - 1, serial - 1)
    moduli = F.array(*(F.lit(x).cast("long") for x in (898, 99, 9999)))
    return F.when(good, _let(feistel(row, moduli, key, F.lit("ssn")), lambda v: F.format_string(
        "%03d-%02d-%04d", v[0] + 1 + (v[0] >= 665).cast("long"), v[1] + 1, v[2] + 1)))


def _ip(m: Column, key: Column) -> Column:
    row = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    new = feistel(row, F.transform(row, lambda _: F.lit(256).cast("long")), key, F.lit("ip"))
    return F.when(F.array_max(row) < 256, F.array_join(F.transform(new, lambda x: x.cast("string")), "."))


def _date(m: Column, key: Column, *forms: str) -> Column:
    a, b = DAYS
    moduli = F.array(F.lit(a).cast("long"), F.lit(b).cast("long"))

    def one(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        new = feistel(F.array(F.floor(day / b), day % b), moduli, key, F.lit("date"))
        return F.when(day.between(0, a * b - 1), F.date_format(
            F.date_add(F.lit(FIRST_DAY).cast("date"), (new[0] * b + new[1]).cast("int")), form))

    return F.coalesce(*map(one, forms))


def _email(m: Column, key: Column) -> Column:
    name = F.substring_index(m, "@", 1)
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
    value = F.transform(_letters(name), lambda c: F.coalesce(F.ascii(c) - base(c), F.lit(0)).cast("long"))
    moduli = F.transform(_letters(name), lambda c: F.when(c.between("0", "9"), 10).when(
        c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1).cast("long"))
    new = feistel(value, moduli, key, F.concat(F.lit("mail"), F.array_join(F.transform(moduli, lambda x: x.cast("string")), ".")))
    text = _let(new, lambda v: F.array_join(F.transform(_letters(name), lambda c, i: F.when(
        base(c).isNotNull(), F.char(F.get(v, i) + base(c))).otherwise(c)), ""))
    return F.concat(text, F.substring(m, F.length(name) + 1, F.length(m)))


def _tokens(text: Column, pattern: str) -> Column:
    """The matches, each with the ``gap`` before it; the last has the rest of the text and no match."""
    return F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))


def _solid_end(groups: Column, at: Column) -> Column:
    """The place ``at`` of a card without gaps, else null."""
    end = F.when(F.length(F.get(groups, at)).between(*CARD_DIGITS), at)
    return F.when(_is_card(groups, at, end), end)


def _usual_end(groups: Column, at: Column) -> Column:
    """The last place of a card that begins at place ``at`` and is grouped as usual, else null."""
    one = F.length(F.get(groups, at))
    end = F.when(one.between(*CARD_DIGITS), at)
    for lengths in CARD_GROUPS:
        fits = one == lengths[0]
        for i, n in enumerate(lengths[1:], 1):
            fits = fits & (F.length(F.get(groups, at + i)) == n)
        end = end.when(fits, at + len(lengths) - 1)
    return F.when(_is_card(groups, at, end), end)


def _any_end(groups: Column, at: Column) -> Column:
    """The last place of the longest card that begins at place ``at``, else null."""
    least, most = CARD_DIGITS
    ends = F.sequence(at, F.least(at + most // LEAST_GROUP - 1, F.size(groups) - 1))
    long = lambda end: F.forall(F.slice(groups, at + 1, end - at + 1), lambda g: F.length(g) >= LEAST_GROUP)
    found = F.array_max(F.filter(ends, lambda end: long(end) & F.length(_joined(groups, at, end)).between(least, most) & _is_card(groups, at, end)))
    return F.when(F.size(groups) <= LIST_GROUPS["any"], found)


def _joined(groups: Column, at: Column, end: Column) -> Column:
    return F.array_join(F.slice(groups, at + 1, end - at + 1), "")


def _is_card(groups: Column, at: Column, end: Column) -> Column:
    """Whether the digits are an issuer's and the check digit is right."""
    return F.when(end.isNotNull(), _let(_joined(groups, at, end), lambda d: F.regexp_like(d, F.lit(ISSUER)) & (_check_sum(_digits(d), 1) % 10 == 0)))


def _spans(groups: Column, end_at) -> Column:
    """``array<struct<at, end, card>>``: cards that do not overlap, from the left, and the stretches around."""
    number = lambda x: F.coalesce(x, F.lit(-1)).cast("int")
    found = F.filter(
        F.transform(F.sequence(F.lit(0), F.size(groups) - 1), lambda at: F.struct(at.alias("at"), number(end_at(groups, at)).alias("end"))),
        lambda x: x["end"] >= 0)
    span = lambda at, end, card: F.struct(number(at).alias("at"), number(end).alias("end"), F.lit(card).alias("card"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,end:int,card:boolean>>").alias("spans"))
    step = lambda s, x: F.when(x["at"] < s["free"], s).otherwise(F.struct(
        (x["end"] + 1).alias("free"), F.concat(s["spans"], F.array(span(s["free"], x["at"] - 1, False), span(x["at"], x["end"], True))).alias("spans")))
    return F.filter(
        F.aggregate(found, start, step, lambda s: F.concat(s["spans"], F.array(span(s["free"], F.size(groups) - 1, False)))),
        lambda x: x["end"] >= x["at"])


def _run_tokens(run: Column) -> Column:
    """Tokens of a run of digit groups: its cards, and what else is in the rest.

    Cards grouped as usual come first, then any others that begin and end with a group.  In a
    list of many other groups only cards without gaps count.
    """
    def parts(written: Column, spans_of) -> Column:
        groups = F.transform(written, lambda g: F.regexp_replace(g, "[ -]", ""))
        return _let(groups, lambda g: F.transform(spans_of(g), lambda x: F.struct(
            F.slice(written, x["at"] + 1, x["end"] - x["at"] + 1).alias("written"), x["card"].alias("card"))))

    def usual_spans(groups: Column) -> Column:
        outside = lambda spans: F.aggregate(spans, F.lit(0), lambda n, x: n + F.when(x["card"], 0).otherwise(x["end"] - x["at"] + 1))
        return _let(_spans(groups, _usual_end), lambda spans: F.when(
            outside(spans) > LIST_GROUPS["outside"], _spans(groups, _solid_end)).otherwise(spans))

    def tokens(part: Column) -> Column:
        return _let(F.array_join(part["written"], ""), lambda text: F.when(part["card"], F.array(F.struct(
            F.regexp_extract(text, "^[ -]?", 0).alias("gap"), F.regexp_replace(text, "^[ -]", "").alias("m")))).otherwise(_tokens(text, OTHERS)))

    usual = parts(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), F.lit(0)), usual_spans)
    every = F.flatten(F.transform(usual, lambda p: F.when(p["card"], F.array(p)).otherwise(parts(p["written"], lambda g: _spans(g, _any_end)))))
    return F.flatten(F.transform(every, tokens))


def _all_tokens(text: Column) -> Column:
    return F.flatten(F.transform(_tokens(text, ANY), lambda t: F.when(
        F.regexp_like(t["m"], F.lit(f"^(?:{RUN})$")),
        F.concat(F.array(F.struct(t["gap"].alias("gap"), F.lit(None).cast("string").alias("m"))), _run_tokens(t["m"]))).otherwise(F.array(t))))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of a match of ``OTHERS`` or a card; null if the value is not valid."""
    whole = lambda pattern: F.regexp_like(m, F.lit(f"^(?:{pattern})$"))
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(whole(DATE_ISO), _date(m, key, "yyyy-MM-dd"))
        .when(whole(DATE_DAY_FIRST), F.when(F.substring(m, 3, 1) == ".", _date(m, key, "dd.MM.yyyy"))
              .otherwise(_date(m, key, "dd/MM/yyyy", "MM/dd/yyyy")))
        .when(whole(SSN), _ssn(m, key))
        .when(whole(IP), _ip(m, key))
        .when(whole(PHONE), _phone(m, key))
        .otherwise(_card(m, key)))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; all other columns stay.

    ``count_col`` names a column for the number of values replaced (it replaces a column of
    that name).  Null texts stay null, with none replaced.  Rows are independent: repeated
    rows and repeated values get the same pseudonyms in every run with the same ``key``.
    """
    text, secret = F.col(text_col), F.lit(key)
    found = F.when(F.regexp_like(text, F.lit("[0-9@]")), _all_tokens(text))
    # Matches and their pseudonyms, kept in columns so that neither is computed twice.
    taken = {c.lower() for c in docs.columns}
    was, new = (next(f"{name}{i}" for i in itertools.count() if f"{name}{i}" not in taken) for name in ("found", "new"))
    work = docs.withColumn(was, found).withColumn(new, F.when(
        F.exists(was, lambda t: t["m"].isNotNull()), F.transform(was, lambda t: F.when(t["m"].isNotNull(), pseudonym(t["m"], secret)))))
    parts = F.zip_with(was, new, lambda t, p: F.concat(t["gap"], F.coalesce(p, t["m"], F.lit(""))))
    work = work.withColumn(text_col, F.when(F.size(new) > 0, F.array_join(parts, "")).otherwise(text))
    if count_col:
        replaced = F.size(F.filter(new, lambda p: p.isNotNull()))
        work = work.withColumn(count_col, F.coalesce(F.when(F.size(new) > 0, replaced), F.lit(0)).cast("long"))
    return work.drop(was, new)
